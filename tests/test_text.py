"""Golden values of the parsers and classifiers."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pickwell.functions import text as X

GOLDEN = [
    # text, full, simple, window
    ("45-60 minutes", 52, 60, (45, 60)),
    ("1-2 hours", 90, None, (60, 120)),
    ("1-2 hrs", 2, None, (1, 2)),
    ("60 minutes", 60, 60, (45, 75)),
    ("1 hour", 60, None, (45, 75)),
    ("1 hr", None, None, (0, 16)),
    ("45 mins", None, None, None),
    ("1 minute", None, None, (0, 16)),
    ("1234 minutes", 234, 234, (1219, 1249)),
    ("100 hours", 0, None, (5985, 6015)),
    ("90 minutes then 1-2 hours", 90, 90, (60, 120)),
    ("10 min", 10, 10, (0, 25)),
    ("2-1 hours", 90, None, (60, 120)),
    ("3-4 years", None, None, None),
    ("43 - 44 MIN", 44, 44, (43, 44)),
    ("44-45 min", 44, 45, (44, 45)),
    ("", None, None, None),
    (None, None, None, None),
]


def test_durations(rows):
    texts = [g[0] for g in GOLDEN]
    assert rows(texts, X.duration_full) == [g[1] for g in GOLDEN]
    assert rows(texts, lambda c: X.duration_simple(F.lower(c))) == [g[2] for g in GOLDEN]
    got = rows(texts, X.duration_window)
    assert [tuple(w) if w else None for w in got] == [g[3] for g in GOLDEN]


def test_short_hours_are_converted_on_request(rows):
    assert rows(["1-2 hrs", "1 hr", "3 HR"], lambda c: X.duration_full(c, short_hours=True)) == [90, 60, 180]
    assert [tuple(w) for w in rows(["1-2 hrs", "1 hr"], lambda c: X.duration_window(c, short_hours=True))] == [(60, 120), (45, 75)]


def test_endless_numbers_do_not_fail_the_job(rows):
    long = "9" * 40
    got = rows([f"{long} minutes", f"{2**62} hours", f"1-{long} min"], X.duration_window)
    assert all(w is None or w.lo is None or w.hi is None or w.lo <= w.hi for w in got)


def test_window_agrees_with_a_plain_scan(rows):
    units = "hour|hours|hr|hrs|min|mins|minute|minutes|days"

    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.from_regex(rf"[a-z ]{{0,3}}[0-9]{{1,4}}( ?- ?[0-9]{{1,3}})? {{0,2}}({units})[a-z ]{{0,3}}", fullmatch=True), min_size=200, max_size=200))
    def check(texts):
        got = rows(texts, X.duration_window)
        for text, w in zip(texts, got):
            hit = re.search(r"(\d+)(?:\s*-\s*(\d+))?\s*(hours?|hrs?|minutes?|min)\b", text)
            span = re.search(r"(\d+)\s*-\s*(\d+)\s*(hours?|hrs?|minutes?|min)\b", text)
            hit = span or hit
            if not hit:
                assert w is None, text
                continue
            scale = 60 if "hour" in hit[3] else 1
            ends = [int(n) * scale for n in hit.groups()[:2] if n]
            want = (min(ends), max(ends)) if span else (max(0, ends[0] - 15), ends[0] + 15)
            assert tuple(w) == want, text

    check()


def test_types(rows):
    low = ["personality and skill", "skill", "python", "sjt only", "nothing", None]
    assert rows(low, X.test_type_personality_first) == ["P", "K", None, None, None, None]
    assert rows(low, X.test_type_knowledge_first) == ["K", "K", "K", "P", None, None]


def test_levels(rows):
    low = ["midnight", "a mid role", "graduate entry", "team leader", "lead", "managers", ""]
    assert rows(low, X.level_substring) == ["Mid", "Mid", "Entry", "Lead", "Lead", "Manager", None]
    assert rows(low, X.level_word) == [None, "Mid", "Graduate", None, "Lead", None, None]


def test_language_and_bundles(rows):
    assert rows(["in english", "french"], X.language) == ["English", None]
    titles = ["Pre-Packaged X", "prepackaged", "A Job Solution", "Solution: y", "Solutions", None]
    assert rows(titles, X.is_bundle) == [True, True, True, True, False, False]


@pytest.mark.parametrize(
    "text, terms",
    [
        ("Hiring a Data analyst: SQL, sql & R-studio", ["data", "analyst", "sql", "sql", "r"]),
        ("salesmanager", []),
        ("Java4 developers", ["java"]),
        (None, []),
    ],
)
def test_strong_terms(rows, text, terms):
    assert rows([text], X.strong_terms) == [terms]


def test_on_topic_is_a_substring_test_unless_told_otherwise(spark):
    df = spark.createDataFrame([("engineer", ["r"]), ("engineer", []), ("plain", ["sql", "r"]), ("r and d", ["r"])], "t string, terms array<string>")
    loose = [r.a for r in df.select(X.on_topic(F.col("t"), F.col("terms")).alias("a")).collect()]
    words = [r.a for r in df.select(X.on_topic(F.col("t"), F.col("terms"), True).alias("a")).collect()]
    assert loose == [True, True, False, True]
    assert words == [False, True, False, True]


def test_document_renders_missing_values_as_nothing(spark):
    schema = "title string, category string, test_type string, level string, duration_min int, language string, tags string, description string"
    df = spark.createDataFrame([("T", None, "K", None, 30, None, "a;b", "D"), ("U", *[None] * 7)], schema)
    docs = [r.d for r in df.select(X.document().alias("d")).collect()]
    assert docs == [
        "Assessment Name: T. Category: . Type: K. Level: . Duration: 30 minutes. Language: . Tags: a;b. Description: D. ",
        "Assessment Name: U. Category: . Type: . Level: . Duration:  minutes. Language: . Tags: . Description: . ",
    ]
