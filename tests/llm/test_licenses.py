"""License scans: base phrases by brute force, rules and their gates one by one."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pickwell.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(L.UPPER, L.LOWER)


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for p, label in L.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


@pytest.fixture
def scan(spark):
    def run(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r for r in sorted(L.license_query(df).collect(), key=lambda r: r.doc_id)]

    return run


def sample(pattern):
    """A shortest text of the pattern."""
    inner = re.compile(r"\(\?:([^()]*)\)([?*]?)")
    while inner.search(pattern):
        pattern = inner.sub(lambda m: "" if m[2] else m[1].split("|")[0], pattern, count=1)
    return re.sub(r"\.\{1,90\}", "x", re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"[a-z ]\?", "", pattern)))


def test_rules_are_hundreds_with_plain_leads_and_sound_gates():
    assert len(L.RULES) >= 400 and len({r.pattern for r in L.RULES if not r.base}) == len(L.RULES) - len(L.BASE)
    anchors = L.anchors(L.RULES)
    for r in L.RULES:
        text = sample(r.pattern)
        assert re.fullmatch(r.pattern, text), (r, text)
        assert text.split()[0] == r.lead and r.needs in text and r.anchor in text
        assert len(text.split()) <= L.LONGEST
        assert any(a in text for a in anchors)


def test_every_rule_is_found_through_its_gates(scan):
    texts = [f"x, {sample(r.pattern).upper()}." for r in L.RULES]
    for r, got in zip(L.RULES, scan(*texts), strict=True):
        assert got.labels and got.score >= L.KINDS[r.kind] - 1e-9, r


def test_base_phrases(scan):
    rng = random.Random(5)
    pool = "gnu general public license GNU General Apache LICENSE cc by CC-BY mit License x1 ünï, K".split()
    texts = [rng.choice([" ", "\n", "-", " ,"]).join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(150)]
    texts += [None, "", " \t", "MITLicense mit\x00license mit license", "cc_by", "Ks ſ cc\x7fby"]
    for t, r in zip(texts, scan(*texts), strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_longer_and_earlier_kinds_win(scan):
    got = scan(
        "GNU General Public License, version 3 or any later version",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Licensed under CC BY-NC 4.0.",
        "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported",
        "Apache License, Version 2.0 and MIT License",
        "gplv3 and later GPL v2",
        "BSD-3-Clause",
        "All rights reserved.",
    )
    assert [r.labels for r in got] == [
        "gpl,gpl-3.0-or-later", "gpl-2.0-or-later", "cc-by,cc-by-nc-4.0", "cc-by-nc-sa-3.0", "apache,apache-2.0,mit", "gpl-2.0,gpl-3.0", "bsd-3-clause", "all-rights-reserved",
    ]
    assert [r.score for r in got] == [0.9, 1.0, 0.9, 0.9, 0.9, 0.9, 0.9, 0.4]


def test_intervals_and_long_texts(spark):
    text = "word " * 30_000 + "MIT License. " * 400 + "word " * 30_000 + "apache license version 1.1"
    docs = spark.createDataFrame([(text, 1), (text, 1), (None, None)], "body string, rule int")
    got = L.with_licenses(docs, "body").collect()
    assert got[0] == got[1] and got[2].licenses == [] and got[0].rule == 1
    found = [(d.start, d.words, d.label, d.base) for d in got[0].licenses]
    mit = [(30_000 + 2 * i, 2, "mit", b) for i in range(400) for b in (False, True)]
    assert sorted(found) == sorted([*mit, (60_800, 2, "apache", True), (60_800, 5, "apache-1.1", False)])


def test_no_python_in_the_plan_and_empty_tables(docs, doc_rows, no_docs):
    q = L.license_query(docs.withColumn("labels", F.lit("own")))
    assert not re.search("Python|Arrow|Pandas|Exchange", q._jdf.queryExecution().optimizedPlan().toString())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words) for r in q.collect()) == sorted((r[0] if r[0] is not None else -1, base(r[1])[0]) for r in doc_rows)
    assert L.license_query(no_docs).count() == 0
