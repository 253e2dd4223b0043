from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from pickwell.llm import jaccard
from tests.llm.made import SCHEMA, words


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    links = {i: [j for j in range(len(rows)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(len(rows))}
    out = Counter()
    for a, (doc_id, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        out[doc_id, len(sets[a]), min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)] += 1
    return out


def test_divide_skip_counts():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(rng.randint(1, 25))]
        least = rng.randint(1, 12)
        times = Counter(x for values in lists for x in values)
        assert jaccard.divide_skip(lists, least) == {k: v for k, v in times.items() if v >= least}


def test_prefix_length_is_long_enough():
    for n in range(1, 200):
        assert jaccard.prefix_length(n) == n - -(-75 * n // 100) + 1
        assert jaccard.needed(n, n) <= n


def test_sketches_never_differ_more_than_the_sets():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (3, 900, 1500, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for change in (0, 1, n // 5, n):
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 2**63, change + n // 6).astype(np.uint64)]))
            x, y = jaccard.sketch(a), jaccard.sketch(b)
            while len(x) != len(y):
                x, y = (jaccard.halved(x), y) if len(x) > len(y) else (x, jaccard.halved(y))
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def chains(seed=6):
    """Chains of edits, where the ends are not similar, inside a passage that all share, and one large group."""
    rng = random.Random(seed)
    passage = words(rng, "en", 25)
    rows = []
    for start in range(6):
        w = passage + words(rng, "en", 60)
        for _ in range(12):
            rows.append(" ".join(w))
            w = list(w)
            w[rng.randrange(25, len(w))] = f"new{rng.random()}"
    for size in (1500, 1990):
        w = words(rng, "de", size)
        for _ in range(4):
            rows.append(" ".join(w))
            w = [*w[:-60], *words(rng, "de", 100)]
        rows.append(" ".join([*passage, *words(rng, "en", size), *passage]))
    base = words(rng, "de", 80)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("members,block,load", [(jaccard.BLOCK_MEMBERS, jaccard.BLOCK_SHINGLES, jaccard.TASK_SHINGLES), (7, 1500, 900)])
def test_components(spark, docs, doc_rows, monkeypatch, members, block, load):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", load)
    extra = [(1000 + i, t) for i, t in chains()]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string").repartition(5))
    want = brute([(r[0], r[1]) for r in doc_rows] + extra)
    got = Counter(map(tuple, jaccard.jaccard_query(table).collect()))
    assert got == want


def near_copies(n, seed=9):
    """Texts of 100 words, each with two words of its own."""
    rng = random.Random(seed)
    base = words(rng, "en", 100)
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(100), 2):
            w[at] = f"own{i}x{at}"
        out.append((i, " ".join(w)))
    return out


def test_rows_between_steps_grow_with_a_group_and_not_with_its_pairs(spark, monkeypatch):
    stored = []
    whole = jaccard.materialise

    def counting(df):
        kept = whole(df)
        stored.append(kept.count())
        return kept

    monkeypatch.setattr(jaccard, "materialise", counting)
    sums = []
    for n in (300, 600):
        rows = near_copies(n)
        stored.clear()
        got = Counter(map(tuple, jaccard.jaccard_query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
        assert got == brute(rows)
        sums.append(sum(stored))
    assert sums[1] < 2.5 * sums[0]


def test_one_of_each_group_stays(spark, docs, doc_rows, no_docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    groups = Counter(c for (_, n, c), k in brute([(r[0], r[1]) for r in doc_rows]).items() for _ in range(k) if n)
    got = [r.doc_id for r in kept.collect()]
    empty = sum(not sets_of(r[1]) for r in doc_rows)
    assert Counter(got)[None] == 1
    assert len(got) == len(groups) + empty
    assert set(groups) <= set(got)
    assert jaccard.keep_one(no_docs).count() == 0 and jaccard.jaccard_query(no_docs).count() == 0
    two = spark.createDataFrame([(1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "a b", "en", "s", 0)], SCHEMA)
    assert sorted(r.text for r in jaccard.keep_one(two).collect()) == ["", "", "a b"]


def test_words_are_hashed_from_bytes_as_one_by_one():
    import numpy as np
    import pyarrow as pa

    from pickwell.llm import common as C

    rng = random.Random(5)
    letters = [" ", "\t", "\n", "\x0b", "\r", "\x1c", "\x00", "A", "Z", "b", "é", "日", "\xa0", "İ"]
    for _ in range(300):
        texts = pa.array(["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))], pa.string())
        for part in (texts, texts[1:], texts[:0]):
            rows, words = C.split_words(part)
            want = C.hash_words(words)
            for most in (1, 3, 1 << 16):
                got = C.hashed_words(part, most)
                assert np.array_equal(got[0], rows) and np.array_equal(got[1], want)


def test_partners_in_small_blocks_are_those_of_one_query_after_the_other(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    rows = []
    for a in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(1, 3000))).astype(np.uint64)
        for b in range(int(rng.integers(1, 9 if a else 60))):
            values = np.unique(np.concatenate([base[int(rng.integers(0, len(base) // 4 + 1)) :], rng.integers(0, 2**63, len(base) // 12).astype(np.uint64)]))
            asked = bool(a % 3 == 0 or rng.integers(0, 2))
            rows.append({"a": a, "i": 0, "j": 0, "cell": 0, "b": 1000 * a + b, "n": len(values), "root": int(rng.integers(0, 4)), "is_query": asked, "bits": jaccard.sketch(values).tolist()})
    order = rng.permutation(len(rows))
    cell = pa.Table.from_pylist([rows[i] for i in order])
    want = set()
    for a in range(60):
        block = sorted((r for r in rows if r["a"] == a), key=lambda r: (r["n"], r["b"]))
        n, root = (np.array([r[c] for r in block]) for c in ("n", "root"))
        own = np.array([i for i, r in enumerate(block) if not r["is_query"]] or range(len(block)))
        held = jaccard.Sketches([np.array(r["bits"], np.int64) for r in block])
        for q, r in enumerate(block):
            near = held.near(own, n, root, q) if r["is_query"] else own[:0]
            want |= {block[i]["b"] for i in [*near.tolist(), *([q] if len(near) else [])]}
    for chunk in (jaccard.CHUNK, 50):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        got = jaccard._with_partner(cell)
        assert set(got.column("b").to_pylist()) == want and "bits" not in got.column_names
    assert 20 < len(want) < len(rows)


def test_a_wanted_text_in_many_rows_gives_its_set_once_a_task(spark):
    """Equal rows without id stand for their class alike; other texts are left out before they are split."""
    from pyspark.sql import functions as F

    rows = [(None, "one text that very many of the rows hold")] * 200 + [(i, f"text {i} of its own, that is not wanted at all") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("text_hash", F.xxhash64("text"))
    found = jaccard.sets_of(docs, docs.filter("doc_id is null").limit(1)).collect()
    assert 1 <= len(found) <= 3 and {len(r.shingles) for r in found} == {5}


def test_batches_to_python_are_short_while_documents_are_compared(spark, docs, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", set()
    before, whole = spark.conf.get(key), jaccard.materialise

    def looking(df):
        seen.add(int(spark.conf.get(key)))
        return whole(df)

    monkeypatch.setattr(jaccard, "materialise", looking)
    jaccard.jaccard_query(docs)
    assert seen == {min(jaccard.BATCH_ROWS, int(before))} and spark.conf.get(key) == before
