from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pickwell.llm import langid, mixing, sentencepiece, toxicity
from pickwell.llm.queries import QUERIES
from tests.llm.made import SCHEMA, make_docs
from tests.llm.test_jaccard import brute, sets_of

duckdb = pytest.importorskip("duckdb")


def test_every_operator_has_its_query():
    import __spark_entry__

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_stages(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit("x"))
    before = docs
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(path := str(tmp_path / str(i)))
        after = spark.read.parquet(path)
        assert set(docs.columns) <= set(after.columns)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert set(after.columns) == set(docs.columns)
        if name == "near copies":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in after.collect()} == {c for _, n, c in brute(rows) if n} | {i for i, t in rows if not sets_of(t)}
        if name == "mixing":
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        counts.append(after.count())
        before = after
    assert counts[0] < docs.count() and counts[4] == counts[3]
    pieces = sentencepiece.Pieces(sentencepiece.read_model(sentencepiece.MODEL))
    for r in before.limit(5).collect():
        assert r.ids == sentencepiece.encode_text(r.text, pieces)
    rejected = docs.join(spark.read.parquet(str(tmp_path / "0")), "doc_id", "left_anti").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert rejected.filter("toxic = 0").count() <= 0.05 * counts[0]


def test_columns_named_as_those_of_a_stage_pass(spark, tmp_path, sf_dir):
    names = ["size", "source_size", "target", "draws", "taken", "mix_shard", "mix_order", "lang_pred", "lang_score", "lang_spans", "_toxicity", "_others", "_copy", "_h", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100)
    docs = docs.select("*", *[F.lit("own").alias(n) for n in names])
    docs.write.parquet(path := str(tmp_path / "docs"))
    docs = spark.read.parquet(path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        kept = [[*r] for r in after.select(*[F.col(f"`{n}`") for n in names]).collect()]
        assert kept and all(r == ["own"] * len(names) for r in kept)


INSULTS = "gnarlwit snoutface muckling"
LABELS = "doc_id long, toxic int"


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def toxic_score(model, text):
    """The factorization machine written out: every term's weight and the product of every pair."""
    at = {int(k): i for i, k in enumerate(model.keys)}
    own = [model.weights[at[t]].astype(float) for t in toxicity.terms(pa.array([text], pa.string()))[1].tolist() if t in at]
    logit = model.bias + sum(w[0] for w in own) + sum(float(a[1:] @ b[1:]) for a, b in combinations(own, 2))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def test_run_against_a_plain_chain(spark, tmp_path):
    """All five stages over texts in loops on the driver; from the library come the two trained models, the draws of the mix and the plain encoder."""
    rows = [r for r in make_docs() if len(r[1] or "") < 20_000]
    rows += [(500 + i, f"{r[1]} {INSULTS}", *r[2:]) for i, r in enumerate(rows[:60]) if r[1]]
    labels = [(r[0], int(r[0] >= 500)) for r in rows if r[0] is not None]
    sf_dir = write(spark, tmp_path, rows, labels)
    got = Counter((r.doc_id, r.text, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())

    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 5], LABELS)
    model = toxicity.learn(docs, known)
    rows = [r for r in rows if toxic_score(model, r[1]) < 0.5]
    toxic = sum(r[0] is not None and r[0] >= 500 for r in rows)
    assert toxic <= 0.2 * sum(x for _, x in labels) and len(rows) > 100

    model = langid.learn(langid.training(spark.createDataFrame(rows, SCHEMA)))
    kept = []
    for r in rows:
        pred, share, *_ = langid.label_block(model, pa.array([r[1]], pa.string()), langid.SWITCH_PENALTY)
        if pred[0] < len(model.languages) and share[0] >= corpus_pipeline.MIN_LANGUAGE_SHARE:
            kept.append(r)
    assert all(any(c.isalpha() for c in r[1]) for r in kept) and len(kept) < len(rows)

    group = {i: c for i, _, c in brute([(r[0], r[1]) for r in kept])}
    rows = list({r[0]: r for r in kept if r[0] == group[r[0]]}.values())
    assert len(rows) < len(kept)

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total, taken, most, drawn = Counter(), Counter(), Counter(), Counter()
    source = {r[0]: r[3] for r in rows}
    for r in rows:
        total[r[3]] += size(r[1])
        most[r[3]] = max(most[r[3]], size(r[1]))
    for r in mixing.mixing_query(spark.createDataFrame(rows, SCHEMA)).collect():
        drawn[r.doc_id] = len(r.draws)
        taken[source[r.doc_id]] += len(r.draws) * r["size"]
    names = sorted({*total} - {None}) + [None] * (None in total)
    wanted = mixing.targets([total[n] for n in names], [i % 3 + 1 for i in range(len(names))])
    assert all(abs(taken[n] - t) <= most[n] for n, t in zip(names, wanted, strict=True))

    pieces = sentencepiece.Pieces(sentencepiece.read_model(sentencepiece.MODEL))
    want = Counter()
    for r in rows:
        if drawn[r[0]]:
            want[r[0], r[1], tuple(sentencepiece.encode_text(r[1], pieces))] += drawn[r[0]]
    assert got == want


def test_run_over_empty_and_missing_values(spark, tmp_path):
    """No rows give no rows; texts without letters go at the language stage; repeated rows are one; a column ``ids`` is replaced."""
    empty = write(spark, tmp_path / "empty", [], [])
    out = corpus_pipeline.run(spark, empty)
    assert out.count() == 0 and {"doc_id", "text", "ids"} <= set(out.columns)

    same = "some plain words that make a text of more than five words"
    rows = [(None, None, None, None, None)] * 3 + [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "12 34 !", "en", "a", 7)]
    rows += [(4, same, "en", "a", 1)] * 4 + [(None, same, None, None, None)] * 2
    folder = write(spark, tmp_path / "few", rows, [(4, 0), (None, 1), (3, None)])
    found = {(r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == {(4, same)}

    docs = spark.createDataFrame([(4, same, "x")], "doc_id long, text string, ids string")
    (row,) = corpus_pipeline.encode(spark, docs, folder).collect()
    assert row.doc_id == 4 and row.ids and all(isinstance(i, int) for i in row.ids)
