"""Phones in every format, against a plain list of the planted ones; valid cards and IBANs with more behind them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import pseudonyms as P

KEY = b"test"


@pytest.mark.parametrize("phone", ["+1 (017) 555-7713", "+1 (171) 555-2028", "+4915112345678", "+14155552671", "+49 151 12345678", "+33 6 12 34 56 78", "1-415-555-2671", "+44 (0)20 7946 0958"])
def test_phone_formats(phone):
    text = f"Call {phone}, please."
    new, found = P.Pseudonyms(KEY).text(text)
    assert found == [("phone", 5, 5 + len(phone))]
    assert phone not in new
    assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text)
    assert P.Pseudonyms(KEY, True).text(new)[0] == text


def test_every_planted_phone(spark):
    from conftest import SMOKE
    planted = re.compile(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])")
    texts = {(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()}
    want = {(i, m.start(), m.end()) for i, t in texts for m in planted.finditer(t)}
    spans = P.op8_pseudonyms(spark, SMOKE).select("doc_id", F.explode(F.split("spans", ",")).alias("s")).where("s like 'phone:%'").collect()
    assert want
    assert want <= {(r.doc_id, *map(int, r.s.split(":")[1:])) for r in spans}


@pytest.mark.parametrize("value,behind", [("4111 1111 1111 1111", " 123"), ("4111111111111111", " 12/27"), ("BE68539007547034", " EUR"), ("SE4550000000058398257466", " SEK"), ("ES91 2100 0418 4502 0005 1332", " FOR")])
def test_values_with_more_behind(value, behind):
    text = f"Card or account {value}{behind} of today"
    new, found = P.Pseudonyms(KEY).text(text)
    assert [(s, e) for _, s, e in found] == [(16, 16 + len(value))]
    assert value not in new
    assert new.endswith(f"{behind} of today")
    assert P.Pseudonyms(KEY, True).text(new)[0] == text


def test_round_trip_of_values_side_by_side():
    r = random.Random(7)
    parts = ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "BE68539007547034", "212-555-0101", "+49 30 1234 5678", "92.60.174.184", "2001-02-28", "123-45-6789", "a1@b.example", "123", "12/27", "EUR", "at", "4"]
    for k in range(1500):
        text = r.choice(["", "x "]) + " ".join(r.choice(parts) for _ in range(r.randint(1, 7)))
        key = str(k % 9).encode()
        new, found = P.Pseudonyms(key).text(text)
        assert [x[0] for x in P.Pseudonyms(key).text(new)[1]] == [x[0] for x in found]
        assert P.Pseudonyms(key, True).text(new)[0] == text
