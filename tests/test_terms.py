"""Large vocabularies: the same as with a word list, one pass a text."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pickwell.functions import text as X
from pickwell.functions.terms import Vocabulary
from pickwell.functions.vectors import HashEncoder
from pickwell.operators.dedup import conform
from pickwell.operators.rerank import clean_queries
from pickwell.plans.index import build_index
from pickwell.plans.search import recommend


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]


@pytest.mark.parametrize("whole", [False, True])
def test_finds_what_searching_each_term_finds(spark, whole):
    rng = random.Random(1)
    vocabulary = Vocabulary([*words(rng, 300), "", "ab", "é"])
    texts = [rng.choice([" ", "-", "9"]).join(words(rng, rng.randint(0, 30))) for _ in range(60)] + ["", None, "é ab"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", vocabulary.found_in(F.col("t"), whole).alias("f")).collect()
    for r in got:
        t = texts[r.i] or ""
        padded = " " + "".join(c if "a" <= c <= "z" else " " for c in t) + " "
        want = [w for w in vocabulary.terms if (f" {w} " in " ".join(["", *padded.split(), ""]) if whole else w in t)]
        assert r.f == want, (t, r.f, want)


def test_strong_terms_agree_with_the_word_list(spark):
    texts = ["Python, SQL and java; python", "no", "", None, "ÄSQLé sql2", "MANAGER manager"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select(Vocabulary(X.STRONG_TERMS).strong_terms(F.col("t")).alias("a"), X.strong_terms(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a for r in rows)


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(2)
    terms = list(dict.fromkeys(words(rng, 260_000)))[:100_000]
    vocabulary = Vocabulary(terms)
    assert len(vocabulary.terms) == 100_000
    texts = spark.range(2000).select("id", F.concat_ws(" ", *(F.element_at(F.array(*map(F.lit, terms[:200])), (F.xxhash64("id", F.lit(i)) % 100 + 101).cast("int")) for i in range(40))).alias("t"))
    began = time.perf_counter()
    total = texts.select(F.size(vocabulary.found_in(F.col("t"), True)).alias("n")).agg(F.sum("n"), F.min("n")).first()
    # an automaton of this size is built in a second or two, once a worker
    assert total[1] > 5 and total[0] > 2000 * 25 and time.perf_counter() - began < 60


def test_size_is_checked(spark):
    with pytest.raises(ValueError, match="split"):
        Vocabulary(["abc", "def"], max_bytes=5)
    with pytest.raises(ValueError, match="split"):
        Vocabulary.of(spark.createDataFrame([("abc",), ("def",), (None,)], "w string"), "w", max_bytes=5)
    assert Vocabulary.of(spark.createDataFrame([("abc",), ("abc",), (None,), ("",)], "w string"), "w").terms == ("abc",)
    assert Vocabulary([]).terms == ()


@pytest.mark.parametrize("whole", [False, True])
def test_recommend_is_the_same(spark, whole):
    enc = HashEncoder(32)
    items = spark.createDataFrame([(f"https://x.com/{i}", f"{w} test {i}") for i, w in enumerate(["java", "salesman", "tea", "r"] * 12)], "url string, title string")
    index = build_index(conform(items), enc)
    queries = clean_queries(spark.createDataFrame([("java", 20), ("sales r", 5), ("tea", 3)], "query string, topk int"), topk="topk", max_topk=20)
    some = ("java", "sales", "r")
    a, b = (sorted(map(tuple, recommend(queries, index, enc, v, whole, max_topk=20).collect())) for v in (some, Vocabulary(some)))
    assert a == b and a
