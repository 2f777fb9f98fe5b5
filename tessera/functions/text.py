"""Column expressions for ticket text (all JVM-side built-ins, no Python UDF).

Every function takes and returns a ``Column`` so it can be used inside ``select`` and stays
inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results: the entity pattern sets of
# the three retrievers (name -> regular expression, matched on lower-cased text, whole match).
# ---------------------------------------------------------------------------------------------
ENTITY_PATTERNS_FULL: dict[str, str] = {
    "error_codes": r"\b(?:error|err)[-_]?\w*[-_]?\d+\b|\b\w+[-_]?(?:error|err)\b",
    "product_names": r"\b(?:datasync|pro|enterprise|basic|premium)\b",
    "technical_terms": r"\b(?:database|connection|timeout|api|server|client|sync|backup|restore)\b",
    "version_numbers": r"\bv?\d+\.\d+(?:\.\d+)?\b",
    "status_codes": r"\b(?:200|404|500|503|401|403)\b",
}
ENTITY_PATTERNS_FAST: dict[str, str] = {
    "errors": r"\b(?:error|err)[-_]?\w*[-_]?\d+\b",
    "products": r"\b(?:datasync|pro|enterprise|basic|premium)\b",
    "tech_terms": r"\b(?:database|connection|timeout|api|server)\b",
    "codes": r"\b\d{3,4}\b",
}
ENTITY_PATTERNS_ULTRA: dict[str, str] = {
    "errors": r"\berror[-_]?\w*\b",
    "products": r"\b(?:datasync|pro)\b",
    "tech": r"\b(?:database|timeout|api)\b",
}
# Not the reference's: long words, the entities of corpora that hold no error codes or product names.
LONG_WORDS: dict[str, str] = {"long_words": r"\b\w{12,}\b"}
# Token rule of the vectorisers: runs of 2+ letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Characters kept by the notebook's text cleaner (everything else becomes a space).
CLEAN_TEXT_DROP = r"[^a-zA-Z0-9\s.,!?]"


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_ws(c: Column) -> Column:
    """Trim all leading/trailing whitespace (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """Null-safe lower + trim; null becomes ''."""
    return strip_ws(F.lower(null_to_empty(c)))


def clean_text(c: Column) -> Column:
    """Lower, replace characters outside [a-z0-9 whitespace .,!?] by a space, collapse
    whitespace runs to one space, trim."""
    x = F.regexp_replace(F.lower(null_to_empty(c)), CLEAN_TEXT_DROP, " ")
    return strip_ws(F.regexp_replace(x, r"\s+", " "))


def combine_text(*cols: Column) -> Column:
    """Join text fields with one space; missing parts are '' (so double spaces stay)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(null_to_empty(c))
    return F.concat(*parts)


def text_length(c: Column) -> Column:
    """Character length, 0 for null."""
    return F.length(null_to_empty(c))


def preview(c: Column, n: int = 200, ellipsis: bool = True) -> Column:
    """first ``n`` characters, '...' appended only when the text was longer."""
    cut = F.substring(null_to_empty(c), 1, n)
    if not ellipsis:
        return cut
    return F.when(F.length(c) > n, F.concat(cut, F.lit("..."))).otherwise(null_to_empty(c))


def _accent_rule(lo: int = 0x80, hi: int = 0x10000) -> tuple[str, str, str]:
    """Build the accent-folding map by rule: a Latin character whose compatibility decomposition
    has exactly one ASCII character maps to it; others are deleted later."""
    src, dst = [], []
    for cp in range(lo, hi):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if ord(x) < 128)
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst), r"[^\x00-\x7F]"


ACCENT_FROM, ACCENT_TO, NON_ASCII = _accent_rule()


def strip_accents_ascii(c: Column) -> Column:
    """C7 option: fold Latin accents to their ASCII base letter and drop other non-ASCII. ASCII texts stay as they are."""
    folded = F.regexp_replace(F.translate(c, ACCENT_FROM, ACCENT_TO), NON_ASCII, "")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(folded)


def tokens(c: Column, strip_accents: bool = False) -> Column:
    """Lower-case word tokens of 2+ word characters (Unicode classes, same in Java and RE2)."""
    x = F.lower(null_to_empty(c))
    if strip_accents:
        x = strip_accents_ascii(x)
    return F.regexp_extract_all(x, F.lit(TOKEN_PATTERN), 0)


def with_terms(df: DataFrame, text_col: str, out_col: str, ngram_range: tuple[int, int] = (1, 1),
               stop_words: Sequence[str] | None = None, strip_accents: bool = False) -> DataFrame:
    """Tokenise -> drop stop words -> n-grams, as an array column ``out_col``.

    Stop-word removal and n-grams use Spark ML's ``StopWordsRemover`` (hash-set lookup) and
    ``NGram`` (a sliding window in the JVM); an array lambda that slices the token array per
    position would copy the array for every element (quadratic per document). A column that is an
    array holds the words that are left, as this function makes them for ``ngram_range`` (1, 1).
    """
    from pyspark.ml.feature import NGram, StopWordsRemover

    tok, kept = f"_{out_col}_tok", f"_{out_col}_kept"
    cut = df.schema[text_col].dataType.typeName() == "array"
    staged = df.withColumn(kept if cut else tok, F.col(text_col) if cut else tokens(F.col(text_col), strip_accents))
    if cut:
        pass
    elif stop_words:
        staged = StopWordsRemover(inputCol=tok, outputCol=kept, stopWords=list(stop_words),
                                  caseSensitive=True).transform(staged).drop(tok)
    else:
        staged = staged.withColumnRenamed(tok, kept)
    parts = []
    for n in range(ngram_range[0], ngram_range[1] + 1):
        if n == 1:
            parts.append(F.col(kept))
            continue
        g = f"_{out_col}_g{n}"
        staged = NGram(n=n, inputCol=kept, outputCol=g).transform(staged)
        parts.append(F.col(g))
    out = parts[0] if len(parts) == 1 else F.concat(*parts)
    drop = [c for c in staged.columns if c.startswith(f"_{out_col}_")]
    return staged.withColumn(out_col, out).drop(*drop)


def _tag(name: str):
    """Element lambda for ``transform`` (a closure: a second parameter would be the index)."""
    def f(v: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), v.alias("value"))
    return f


def extract_entities(c: Column, patterns: Mapping[str, str], distinct: bool = True, unicode: bool = True) -> Column:
    """Regex entities of lower-cased text as array<struct<type,value>>.

    One entry per (type, value); types without a match contribute nothing. ``distinct=False``
    keeps repeated matches (the ultra retriever's behaviour). ``unicode`` makes \\w and \\b
    Unicode-aware as in Python.
    """
    x = F.lower(null_to_empty(c))
    parts = []
    for name, pat in patterns.items():
        m = F.regexp_extract_all(x, F.lit(("(?U)" if unicode else "") + pat), 0)
        if distinct:
            m = F.array_distinct(m)
        parts.append(F.transform(m, _tag(name)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def fingerprint(query: Column, category: Column, product: Column, limit: Column) -> Column:
    """MD5 of query_category_product_limit; missing parts print as 'None'."""
    parts = [F.coalesce(x.cast("string"), F.lit("None")) for x in (query, category, product, limit)]
    return F.md5(F.concat_ws("_", *parts))
