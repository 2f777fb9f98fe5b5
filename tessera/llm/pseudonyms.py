"""PII (8): format-preserving Feistel pseudonyms.

Found values are validated (Luhn, mod 97, calendar, octets, number plans), read as an integer below
the number of values that their format allows, and permuted within it: a balanced Feistel network
of ``ROUNDS`` keyed BLAKE2b rounds over the next even power of two, walked until the result lies in
the domain again. A permutation per (key, kind, domain) means that equal values get equal
pseudonyms in every document without any table or shuffle, different values stay different, the
format (separators, lengths, check digits) stays valid, and the key's holder can undo it.

Kinds: ``email`` (letters and digits of the local part by class, the domain stays), ``iban`` (digits
and letters of the account, check digits made anew), ``card`` (13 to 19 digits, Luhn digit made
anew), ``ssn``, ``date`` (yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, 1900 to 2099; all formats share one
permutation of days), ``ip`` (dotted quad), ``phone`` (+country code and 7 to 15 digits in all,
together or in groups, or ddd ddd dddd with or without +1; any digits, the country code stays). A match that fails its validation
is tried at its shorter lengths (an IBAN at its country's), then the search goes on one character after
its start. Which length is valid can depend on the digits: findings near each other are permuted again
until the new text is read with the same findings, which keeps the permutation exact.

Defined cases: a null text stays null and has no finding; empty texts stay empty; rows that repeat an
id are treated alike; a null id is an id; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table

ROUNDS = 10
GROUP_KIND = {"iso": "date", "dot": "date", "slash": "date", "nanp": "phone", "world": "phone"}
KINDS = ("email", "iban", "card", "ssn", "date", "ip", "phone")
#: For the query on synthetic tables only; callers pass their own.
QUERY_KEY = b"synthetic tables only"

#: Every finding has one of these (an e-mail, or a digit).
MAY = re.compile(r"[0-9@]")
PATTERN = re.compile(r"""
  (?P<email>(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-]))
| (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
| (?P<iso>(?<![0-9A-Za-z./-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z/-]))
| (?P<dot>(?<![0-9A-Za-z./-])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9A-Za-z/-]|\.[0-9]))
| (?P<slash>(?<![0-9A-Za-z./-])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9A-Za-z/-]))
| (?P<ssn>(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))
| (?P<ip>(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9]))
| (?P<nanp>(?<![0-9A-Za-z+.(-])(?:\+1[ .-]?|1[ .-])?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9]))
| (?P<world>(?<![0-9A-Za-z+])\+[1-9](?:[ .-]?\(?[0-9]\)?){6,14}(?![0-9A-Za-z]|[.-][0-9]))
| (?P<card>(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9]))
""", re.X | re.A)

#: Country codes of one and two digits; the others have three.
SHORT_CODES = {"1", "7"}
CODES = {"20", "27", "36", "39", "40", "41", "81", "82", "84", "86", "98"} | {str(k) for a, b in ((30, 35), (43, 50), (51, 59), (60, 67), (90, 96)) for k in range(a, b)}

IBAN_LENGTH = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD 19:MK,SI,FK 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,TL,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG,DJ 25:LY,PT,ST 26:IS,TR 27:BI,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}
#: Findings that lie nearer than this can change how the other is read (a card or IBAN is shorter).
NEAR = 64

FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1


class Permutation:
    """A keyed permutation of 0..size-1."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        seed = hashlib.blake2b(f"{kind}:{size}".encode(), key=hashlib.sha256(key).digest()).digest()
        self.keys = [hashlib.blake2b(bytes([r]), key=seed).digest() for r in range(ROUNDS)]
        self.bytes = (self.half + 7) // 8

    def _round(self, r: int, x: int) -> int:
        out = hashlib.blake2b(x.to_bytes(self.bytes, "little"), key=self.keys[r], digest_size=min(64, self.bytes + 8)).digest()
        return int.from_bytes(out, "little") & self.mask

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ self._round(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ self._round(r, right)
        return left << self.half | right

    def of(self, x: int, back: bool = False) -> int:
        while True:  # walk the cycle until the value lies in the domain
            x = self._once(x, back)
            if x < self.size:
                return x


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


class Pseudonyms:
    """Replaces the findings of a text, or restores them with ``back``."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.permutation = lru_cache(4096)(lambda kind, size: Permutation(key, kind, size))
        self.value = lru_cache(65536)(self._value)

    def _move(self, kind: str, x: int, size: int) -> int:
        return self.permutation(kind, size).of(x, self.back)

    def _by_class(self, kind: str, text: str) -> str:
        """Digits stay digits, small letters small, capitals capitals; the rest stays."""
        x, size, bases = 0, 1, []
        for c in text:
            base = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isupper() else None
            bases.append(base)
            if base:
                x, size = x * base[1] + ord(c) - ord(base[0]), size * base[1]
        # the classes are part of the format: each layout has its own permutation
        x = self._move(kind + ":" + "".join(b[0] if b else "-" for b in bases), x, size)
        out = []
        for c, base in zip(reversed(text), reversed(bases), strict=True):
            if base:
                x, d = divmod(x, base[1])
                c = chr(ord(base[0]) + d)
            out.append(c)
        return "".join(reversed(out))

    def _refill(self, shape: str, digits: str) -> str:
        """``shape`` with its digits and letters replaced in order."""
        it = iter(digits)
        return "".join(next(it) if c.isalnum() else c for c in shape)

    def _date(self, year: str, month: str, day: str) -> datetime.date | None:
        try:
            n = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
        except ValueError:
            return None
        return datetime.date.fromordinal(self._move("date", n, DAYS) + FIRST_DAY)

    def _value(self, group: str, text: str) -> tuple[str, str] | None:
        """(kind, pseudonym), or None for what is not valid."""
        if group == "email":
            local, _, host = text.rpartition("@")
            return "email", self._by_class("email", local) + "@" + host
        if group in ("iso", "dot", "slash"):
            a = re.split(r"[./-]", text)
            order = {"iso": (0, 1, 2), "dot": (2, 1, 0), "slash": (2, 0, 1)}[group]
            d = self._date(*(a[k] for k in order))
            return d and ("date", d.strftime({"iso": "%Y-%m-%d", "dot": "%d.%m.%Y", "slash": "%m/%d/%Y"}[group]))
        plain = "".join(c for c in text if c.isalnum())
        if group == "ssn":
            area, pair, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
            if area in (0, 666) or area >= 900 or not pair or not serial:
                return None
            a = area - 1 - (area > 666)
            a, rest = divmod(self._move("ssn", (a * 99 + pair - 1) * 9999 + serial - 1, 898 * 99 * 9999), 99 * 9999)
            area = a + 1 + (a + 1 >= 666)
            return "ssn", f"{area:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
        if group == "ip":
            parts = text.split(".")
            if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
                return None
            x = self._move("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
            return "ip", ".".join(map(str, x.to_bytes(4, "big")))
        if group in ("nanp", "world"):
            code = len(plain) - 10 if group == "nanp" else 1 if plain[0] in SHORT_CODES else 2 if plain[:2] in CODES else 3
            rest = plain[code:]
            x = self._move("phone", int(rest), 10 ** len(rest))
            return "phone", self._refill(text, plain[:code] + f"{x:0{len(rest)}d}")
        if group == "iban":
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                return None
            body = self._by_class("iban", plain[4:])
            check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
            return "iban", self._refill(text, f"{plain[:2]}{check:02d}{body}")
        if luhn(plain[:-1]) != int(plain[-1]):
            return None
        x = self._move("card", int(plain[:-1]), 10 ** (len(plain) - 1))
        body = f"{x:0{len(plain) - 1}d}"
        return "card", self._refill(text, body + str(luhn(body)))

    def _end(self, group: str, text: str) -> int:
        """Length of the longest valid value that ``text`` begins with, or 0."""
        if group not in ("card", "iban"):
            return len(text) if self.value(group, text) else 0
        ends = [k for k in range(len(text), 0, -1) if text[k - 1].isalnum() and not text[k:k + 1].isalnum()]
        for k in ends:
            plain = "".join(c for c in text[:k] if c.isalnum())
            if group == "iban" and len(plain) != IBAN_LENGTH.get(plain[:2], max(len(plain), 15)) or group == "card" and (len(plain) < 13 or not int(plain)):
                continue
            if self.value(group, text[:k]):
                return k
        return 0

    def find(self, text: str, at: int = 0, stop: int | None = None) -> list[tuple[str, int, int]]:
        """(group, start, end) of the findings that start in [at, stop)."""
        out = []
        while (m := PATTERN.search(text, at)) and (stop is None or m.start() < stop):
            at = m.start() + 1
            if size := self._end(m.lastgroup, m.group()):
                at = m.start() + size
                out.append((m.lastgroup, m.start(), at))
        return out

    def _replace(self, text: str, near: list[tuple[str, int, int]], before: int) -> list[str]:
        """The pseudonyms of findings near each other; ``before`` is the end of the finding before them."""
        values = [text[s:e] for _, s, e in near]
        lo = max(before, near[0][1] - NEAR)
        gaps = [text[max(lo - 1, 0):near[0][1]]] + [text[a[2]:b[1]] for a, b in zip(near, near[1:], strict=False)]
        tail = text[near[-1][2]:near[-1][2] + 2 * NEAR]
        while True:
            values = [self.value(f[0], v)[1] for f, v in zip(near, values, strict=True)]
            new, spans = "", []
            for f, gap, v in zip(near, gaps, values, strict=True):
                new += gap + v
                spans.append((f[0], len(new) - len(v), len(new)))
            if self.find(new + tail, lo - max(lo - 1, 0), len(new)) == spans:
                return values

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of the findings in the text given."""
        if not MAY.search(text):
            return text, []
        found = self.find(text)
        out, at, k = [], 0, 0
        while k < len(found):
            last = k + 1
            while last < len(found) and found[last][1] - found[last - 1][2] < NEAR:
                last += 1
            for (_, s, e), new in zip(found[k:last], self._replace(text, found[k:last], at), strict=True):
                out += [text[at:s], new]
                at = e
            k = last
        out.append(text[at:])
        return "".join(out), [(GROUP_KIND.get(g, g), s, e) for g, s, e in found]


def _run(key: bytes, back: bool):
    def run(batches):
        p = Pseudonyms(key, back)
        for b in batches:
            done = [(None, []) if t is None else p.text(t) for t in b.column(1).to_pylist()]
            spans = [",".join(f"{k}:{s}:{e}" for k, s, e in f) for _, f in done]
            counts = [pa.array([sum(x[0] == k for x in f) for _, f in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), *counts, pa.array(spans, pa.string())],
                                             names=["_id", "_text", *[f"n_{k}" for k in KINDS], "spans"])
    return run


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, text with pseudonyms, n_<kind> and spans (kind:start:end in the text given)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    out = rows.mapInArrow(_run(key, back), f"_id {dict(rows.dtypes)['_id']}, _text string, {counts}, spans string")
    return out.withColumnsRenamed({"_id": id_col, "_text": text_col})


@query("op8_pseudonyms")
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
