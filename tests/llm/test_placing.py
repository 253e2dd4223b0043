"""Hilbert shards and mixing."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwell.llm import mixing, sharding


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_curve_visits_every_cell_and_steps_to_a_neighbour(spark, dims, bits):
    side = 1 << bits
    codes = [(F.floor(F.col("id") / side**i) % side).cast("int") for i in range(dims)]
    cells = spark.range(side**dims).select(*[c.alias(f"c{i}") for i, c in enumerate(codes)], sharding.hilbert_index(codes, bits).alias("h"))
    rows = cells.orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**dims))
    assert all(sum(abs(x[i] - y[i]) for i in range(dims)) == 1 for x, y in zip(rows, rows[1:]))


def test_shards_hold_all_rows_evenly(docs, doc_rows):
    got = sharding.sharding_query(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in doc_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    last = -1
    for s in range(8):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        # shards are runs of the curve
        assert min(r.hilbert for r in by[s]) >= last
        last = max(r.hilbert for r in by[s])


def test_shards_of_tables_with_few_rows_and_other_columns(spark, no_docs):
    assert sharding.sharding_query(no_docs).count() == 0
    few = spark.createDataFrame([(1, "x", 5), (2, "y", None)], "doc_id long, slot string, v int")
    got = sharding.hilbert_shards(few, [F.col("v")], [F.col("doc_id")], 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0)] and got[0].asDict().keys() == {"doc_id", "v", "hilbert", "shard", "slot"}


def test_strings_are_cut_by_rank_however_long_they_begin_alike(spark):
    """Sources that share a long beginning get cells of their own, so every shard holds few of them."""
    rows = [(i, f"https://example.com/data/part-{i % 16:02d}", "en", "x") for i in range(1600)]
    docs = spark.createDataFrame([*rows, (9999, None, None, None)], "doc_id long, source string, lang string, text string").repartition(5)
    assert sharding.text_cuts(docs, F.col("source")) == [f"https://example.com/data/part-{i:02d}" for i in range(1, 16)]
    assert sharding.text_cuts(docs, F.lit(None).cast("string")) == [] and sharding.text_cuts(docs.limit(0), F.col("source")) == []
    shards = sharding.sharding_query(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert len(shards) == 8 and max(r.n for r in shards) <= 3


def test_equal_rows_are_numbered_in_parts(spark, monkeypatch):
    """A third of the rows are one row without id, spread over several units; slots are whole and do not depend on the layout."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 20)
    rows = [(None, "a", "en", "one text")] * 500 + [(i, f"s{i % 5}", "en", f"text {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    found = []
    for parts in (3, 7):
        got = sharding.sharding_query(docs.repartition(parts)).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert len(got) == 1500 and {len(v) for v in by.values()} == {187, 188}
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        found.append(Counter((r.doc_id, r.shard, r.slot) for r in got))
    assert found[0] == found[1]


def test_targets_stop_at_the_cap_and_share_the_rest():
    got = mixing.targets([100, 10, 0, 50], [1, 2, 3, 1])
    assert got[1] == 30 and got[2] == 0 and np.isclose(sum(got), 160) and np.isclose(got[0], got[3])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert np.allclose(mixing.targets([10, 10], [1, 2]), [20 / 3, 40 / 3])


def test_tree_deals_every_block_once():
    counts = [17, 0, 5, 300]
    dealt = mixing.split_tree(counts, 5)
    assert dealt.sum(1).tolist() == counts and dealt.min() >= 0
    assert max(dealt.sum(0)) - min(dealt.sum(0)) <= 3


def test_mix_comes_near_its_targets(docs, doc_rows):
    got = mixing.mixing_query(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in doc_rows)
    source = {r[0]: r[3] for r in doc_rows}
    names = sorted({*source.values()} - {None}) + [None]
    sizes = [sum(size(r[1]) for r in doc_rows if r[3] == s) for s in names]
    wanted = mixing.targets(sizes, [i % 3 + 1 for i in range(len(names))])
    for s, total, target in zip(names, sizes, wanted, strict=True):
        own = [r for r in got if source[r.doc_id] == s]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(total, round(target, 6))}
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
        assert all(r.taken == r["size"] * len(r.draws) <= 3 * r["size"] and set(r.draws) <= set(range(8)) for r in own)
    again = mixing.mixing_query(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken, tuple(r.draws)) for r in got) == Counter((r.doc_id, r.taken, tuple(r.draws)) for r in again)


def test_mixed_rows_are_the_draws(docs, no_docs):
    drawn = Counter()
    for r in mixing.mixing_query(docs).collect():
        drawn.update((r.doc_id, s) for s in r.draws)
    mixed = mixing.mix(docs.withColumn("size", F.lit("old")))
    assert Counter((r.doc_id, r.mix_shard) for r in mixed.collect()) == drawn
    assert {"text", "lang", "n_chars"} <= set(mixed.columns)
    assert mixing.mixing_query(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_a_repeated_id_or_row_is_drawn_in_parts(spark):
    """A third of the rows are copies of one row, a third have no id: both are cut where the target is reached."""
    rows = [(7, "copy of one row", "a")] * 700 + [(None, f"no id {i}", "a") for i in range(700)] + [(i, "plain text here", "a") for i in range(1000, 1700)]
    rows += [(i, "b " * 40, "b") for i in range(2000, 2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixing_query(docs).collect()
    assert len(got) == len(rows)
    own = [r for r in got if r["size"] < 10]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 4
    assert all(len({s for r in got if r.doc_id == i for s in r.draws}) > 4 for i in (7, None))
    again = mixing.mixing_query(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r["size"], tuple(r.draws)) for r in got) == Counter((r.doc_id, r["size"], tuple(r.draws)) for r in again)
    mixed = mixing.mix(docs).groupBy("doc_id", "text", "mix_order").count()
    assert mixed.filter("count > 1").count() == 0
