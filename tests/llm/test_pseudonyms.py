"""Format-preserving pseudonyms: exact round trip, validity, links across documents, bijection."""

import datetime
import re

from pyspark.sql import functions as F

from tessera.llm import pseudonyms as P

KEY = b"test"
TEXT = ("Card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112. Call +1 (265) 555-5428, 212-555-0101 or +49 30 1234 5678. "
        "Mail Jo.e_b42@mail7.example.com; host 92.60.174.184 but not 300.1.1.1. Born 2001-02-28, 28.02.2001, 02/28/2001, not 2001-02-30. "
        "SSN 123-45-6789, not 000-12-3456. IBAN DE89 3704 0044 0532 0130 00 é GB82WEST12345698765432.")
KINDS = ["card", "card", "phone", "phone", "phone", "email", "ip", "date", "date", "date", "ssn", "iban", "iban"]


def found(text, key=KEY, back=False):
    return P.Pseudonyms(key, back).text(text)


def test_round_trip_and_format():
    new, spans = found(TEXT)
    assert [k for k, _, _ in spans] == KINDS
    assert [k for k, _, _ in found(new)[1]] == KINDS  # still valid in its format
    assert found(new, back=True)[0] == TEXT
    for left in ("4111111111111112", "300.1.1.1", "2001-02-30", "000-12-3456", "mail7.example.com", "+49 30"[:3]):
        assert left in new
    for _, s, e in spans:
        assert TEXT[s:e] not in new
    d = [datetime.datetime.strptime(x, f) for x, f in ((re.search(r"Born (\S+),", new)[1].rstrip(","), "%Y-%m-%d"),)]
    assert 1900 <= d[0].year <= 2099
    assert found(TEXT, b"other")[0] != new


def test_dates_link_across_formats():
    new = found("2001-02-28 28.02.2001 02/28/2001")[0].split()
    assert len({datetime.datetime.strptime(x, f) for x, f in zip(new, ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"))}) == 1


def test_permutation_is_a_bijection():
    for size in (1, 2, 3, 10, 97, 1000, 4096):
        p = P.Permutation(KEY, "k", size)
        out = [p.of(x) for x in range(size)]
        assert sorted(out) == list(range(size))
        assert [p.of(y, True) for y in out] == list(range(size))


def test_documents(spark, docs):
    long = "word " * 30000 + TEXT
    df = docs([(1, TEXT), (2, "x " + TEXT), (2, "x " + TEXT), (3, None), (4, ""), (None, TEXT), (5, long), (6, "plain words only")]).withColumn("_id", F.lit(9)).withColumn("spans", F.lit("clash"))
    rows = P.pseudonymise(df, KEY).collect()
    new = found(TEXT)[0]
    got = sorted(((r.doc_id, r.text) for r in rows), key=repr)
    assert got == sorted([(1, new), (2, "x " + new), (2, "x " + new), (3, None), (4, ""), (None, new), (5, "word " * 30000 + new), (6, "plain words only")], key=repr)
    assert {r.n_date for r in rows if r.doc_id == 1} == {3}
    back = P.pseudonymise(P.pseudonymise(df, KEY), KEY, back=True)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_empty(spark, docs):
    assert P.pseudonymise(docs([]), KEY).count() == 0


def test_whole_table_round_trip(spark):
    from conftest import SMOKE
    df = spark.read.parquet(f"{SMOKE}/documents.parquet")
    new = P.op8_pseudonyms(spark, SMOKE)
    assert new.agg(*[F.sum(f"n_{k}") for k in ("email", "phone", "ip", "card")]).first()[0] > 0
    back = P.pseudonymise(new, P.QUERY_KEY, back=True).select("doc_id", F.col("text").alias("t"))
    assert back.join(df, "doc_id").where(~F.col("t").eqNullSafe(F.col("text"))).count() == 0
