import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import AWKWARD, awkward, empty
from vidspark.llm import personal_data
from vidspark.llm.queries import QUERIES

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def check(rows, texts):
    for r in rows:
        want = plain(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r, joined)
        assert [r[f"n_{k}"] for k in STATED] == [sum(x[2] == k for x in want) for k in STATED]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("context:")] == [s for s in joined.split(",") if s]


def test_query_against_plain_matching(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_bootstrapped_contexts"](spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


TEXTS = [
    "a@b.c._x@d.e next", "x@y", "one@two.three@four.five", "..@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "00001.2.3.004", "é a@b.co 𝒳 1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111 1111 1111 1112", "12  34 5", "5 6", "7", "+1 (966) 555-0400", "+1(2)3", "+12345678901234567", "++1 22 333 4444 5555",
    "9" * 50_000, "a" * 50_000, "a@b" + ".c" * 20_000, "1 " * 20_000, "+1" + "(" * 20_000, "a.b@c.d " * 3_000, "1.2.3.4 " * 3000, "4111111111111111 ö 4111 1111 1111 1111",
]


def test_hard_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(personal_data.personal_spans(docs).collect(), dict(enumerate(TEXTS)))


@pytest.mark.parametrize("extra", [True, False])
def test_awkward_rows(spark, extra):
    rows = personal_data.personal_spans(awkward(spark, extra)).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["base_sha256"] for r in rows if r["doc_id"] in (3, 4, 5)} == {hashlib.sha256(b"").hexdigest()}
    assert personal_data.personal_spans(empty(spark)).collect() == []


def test_contexts_discover_identifiers(spark):
    known = [(i, f"please mail me at user{i}@example.com now, other {i}7 words") for i in range(40)]
    unseen = [(100, "please mail me at user9(at)example now and 12 things"), (101, "no context 5566 here")]
    rows = {r["doc_id"]: r["spans"] for r in personal_data.personal_spans(spark.createDataFrame(known + unseen, "doc_id long, text string")).collect()}
    assert rows[100] == "context:18:34"
    assert rows[101] == ""
    assert all(rows[i].startswith("email:") and "context" not in rows[i] for i in range(40))


def test_no_python_in_the_plan(spark, sf):
    plan = personal_data.with_base(spark.read.parquet(f"{sf}/documents.parquet"), id_col="doc_id", text_col="text").select(F.col("_email"))
    assert "Python" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("unit", ["user{i}x{i} ", "a{i}@b.co 1.2.3.{i} w ", "+1 966 555 {i:04d} and "])
def test_very_long_text(spark, unit):
    """Two hundred thousand words with digits in one text: the work grows with the text, not with its square."""
    text = "".join(unit.format(i=i % 250) for i in range(200_000 // (len(unit.split()) or 1)))
    docs = spark.createDataFrame([(0, text), (1, "x" * 1_000_000 + " 5 " + " " * 300_000 + "y")], "doc_id long, text string")
    begun = time.monotonic()
    rows = personal_data.personal_spans(docs).collect()
    assert time.monotonic() - begun < 90
    check(rows, {0: text, 1: "x"})
    words = docs.select(F.lit(0).alias("_row"), F.col("text").alias("_text"), *[F.array().cast("array<struct<start:long,end:long,match:string>>").alias(f"_{k}") for k in STATED])
    found = personal_data.instances(words.filter("text not like 'x%'")).select("start", "end", "value", "left", "right").collect()
    assert [(r["start"], r["end"], r["value"]) for r in found] == [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*", text)]


def test_kinds_of_words(spark):
    """A word has the first kind whose span it meets, wherever that stands in the text."""
    text = " ".join(f"n{i} u{i}@x.org 10.0.0.{i} +44 20 7946 {i:04d} 4111 1111 1111 1111" for i in range(200))
    rows = personal_data.with_base(spark.createDataFrame([(0, text)], "doc_id long, text string"), id_col="doc_id", text_col="text").withColumn("_row", F.lit(0))
    base = sorted(plain(text), key=lambda s: s[1])
    for r in personal_data.instances(rows).collect():
        assert r["kind"] == next((k for a, _, k, b in base if a < r["end"] and b > r["start"]), None), r
