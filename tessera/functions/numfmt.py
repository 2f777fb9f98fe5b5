"""Correctly rounded fixed-point formatting of doubles (like Python's ``f"{x:.4f}"``).

Java's ``%.4f`` rounds the *shortest decimal* form half-up (65.175 -> "65.18"), whereas Python
and C round the exact binary value (65.175 is 65.17499999... -> "65.17"). The exact product
x * 10^n is recovered in double arithmetic as p + err (Dekker's two-product), which decides the
rare near-tie cases; exact ties go to even, as in Python. All built-in arithmetic, so it stays in
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1


def _split(a: Column) -> tuple[Column, Column]:
    c = a * _SPLIT
    hi = c - (c - a)
    return hi, a - hi


def fixed(x: Column, n: int) -> Column:
    """Text of x with ``n`` decimals, correctly rounded (null stays null; nan/inf as Python)."""
    a = F.abs(x.cast("double"))
    b = F.lit(float(10 ** n))
    p = a * b
    a_hi, a_lo = _split(a)
    b_hi, b_lo = _split(b)
    err = ((a_hi * b_hi - p) + a_hi * b_lo + a_lo * b_hi) + a_lo * b_lo
    r = F.floor(p)
    frac = p - r
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(r, F.lit(2)) == 1))))
    units = (r + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("decimal(38,0)")
    scale = F.lit(10 ** n).cast("decimal(38,0)")
    ip = F.floor(units / scale).cast("string")
    fp = F.lpad((units % scale).cast("long").cast("string"), n, "0") if n > 0 else F.lit("")
    body = F.concat(ip, F.lit("." if n > 0 else ""), fp)
    neg = x < 0
    txt = F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body)
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .otherwise(txt))


def format_fixed(template: str, *parts: Column | tuple[Column, int]) -> Column:
    """Fill ``{}`` placeholders of ``template`` with string columns or (column, decimals) pairs."""
    pieces = template.split("{}")
    if len(pieces) != len(parts) + 1:
        raise ValueError("placeholder count mismatch")
    out = [F.lit(pieces[0])]
    for part, tail in zip(parts, pieces[1:]):
        col = fixed(*part) if isinstance(part, tuple) else part.cast("string")
        out += [F.coalesce(col, F.lit("None")), F.lit(tail)]
    return F.concat(*out)
