"""Rule-based classifiers and parsers over page and query text.

Every vocabulary is a default argument; callers may pass their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickwell.functions.strings import SPACE, WORD_END, WORD_START, contains_any, null_to_blank

# The words that decide each class, in the order they are tried.
PERSONALITY_CRAWL = ("personality", "behavior", "behaviour", "openness", "conscientiousness")
KNOWLEDGE_CRAWL = (
    "knowledge", "skill", "technical", "coding", "numerical", "verbal", "logical", "cognitive", "aptitude",
)
PERSONALITY_AUGMENT = (
    "personality", "behavior", "behaviour", "interpersonal", "communication", "situational judgment", "sjq", "sjt",
)
KNOWLEDGE_AUGMENT = (
    "knowledge", "skill", "technical", "coding", "programming", "python", "java", "sql",
    "numerical", "verbal", "logical", "cognitive", "aptitude", "automata",
)
LEVELS_CRAWL = ("entry", "graduate", "junior", "mid", "senior", "manager", "lead")
LEVELS_AUGMENT = ("graduate", "entry", "junior", "mid", "senior", "manager", "lead")
BUNDLE_MARKS = ("pre-packaged", "prepackaged", "job solution", "solution:")
STRONG_TERMS = (
    "python", "sql", "excel", "powerbi", "tableau", "r", "statistics", "statistical",
    "developer", "engineer", "analyst", "data", "qa", "testing", "automation",
    "communication", "stakeholder", "manager", "sales", "marketing", "java", "javascript",
)


# ---------------------------------------------------------------- classifiers
# ``low`` is text already in lower case.


def test_type_personality_first(
    low: Column,
    personality: Sequence[str] = PERSONALITY_CRAWL,
    knowledge: Sequence[str] = KNOWLEDGE_CRAWL,
) -> Column:
    return F.when(contains_any(low, personality), "P").when(contains_any(low, knowledge), "K")


def test_type_knowledge_first(
    low: Column,
    personality: Sequence[str] = PERSONALITY_AUGMENT,
    knowledge: Sequence[str] = KNOWLEDGE_AUGMENT,
) -> Column:
    return F.when(contains_any(low, knowledge), "K").when(contains_any(low, personality), "P")


def language(low: Column, word: str = "english", label: str = "English") -> Column:
    return F.when(low.contains(word), label)


def level_substring(low: Column, levels: Sequence[str] = LEVELS_CRAWL) -> Column:
    """First level of the list found anywhere, even inside a longer word."""
    return F.coalesce(*(F.when(low.contains(lv), lv.capitalize()) for lv in levels))


def level_word(low: Column, levels: Sequence[str] = LEVELS_AUGMENT) -> Column:
    """First level of the list found as a whole word."""
    # the cheap substring test spares most rows the regular expression
    return F.coalesce(
        *(F.when(low.contains(lv) & low.rlike(f"{WORD_START}{lv}{WORD_END}"), lv.capitalize()) for lv in levels)
    )


def is_bundle(title: Column, marks: Sequence[str] = BUNDLE_MARKS) -> Column:
    return contains_any(F.lower(null_to_blank(title)), marks)


# ---------------------------------------------------------------- durations

# The units pages and queries are searched for.
_PAGE_MINUTES = f"{SPACE}*(minutes|min){WORD_END}"
_PAGE_HOURS = f"{SPACE}*(hours|hour|hrs|hr){WORD_END}"
_QUERY_UNIT = f"{SPACE}*(hour|hr|hours|hrs|minute|min|minutes){WORD_END}"
_DASH = f"{SPACE}*-{SPACE}*"
_UP_TO_3 = "([0-9]{1,3})"


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("bigint")


def duration_simple(low: Column) -> Column:
    """Minutes named first in the text: one to three digits before min or minutes."""
    return _number(low, _UP_TO_3 + _PAGE_MINUTES, 1).cast("int")


def duration_full(text: Column, short_hours: bool = False) -> Column:
    """Minutes of a text: a minute range, an hour range, minutes, hours, tried in this order.

    A range means its mean, halves to even. ``hr`` and ``hrs`` are recognised but
    not converted: a range keeps its numbers and a single value counts as no
    duration. ``short_hours=True`` converts them like ``hours``.
    """
    low = F.lower(text)
    min_range = _UP_TO_3 + _DASH + _UP_TO_3 + _PAGE_MINUTES
    hour_range = _UP_TO_3 + _DASH + _UP_TO_3 + _PAGE_HOURS
    minutes = _UP_TO_3 + _PAGE_MINUTES
    hours = "([0-9]{1,2})" + _PAGE_HOURS

    def mean(pattern: str) -> Column:
        return F.bround((_number(low, pattern, 1) + _number(low, pattern, 2)) / F.lit(2.0), 0)

    def spelled_out(pattern: str, group: int) -> Column:
        return F.lit(True) if short_hours else F.regexp_extract(low, pattern, group).startswith("hour")

    by_range = mean(hour_range)
    range_is_hours = spelled_out(hour_range, 3)
    # the mean is taken after conversion, so an odd sum of hours stays exact
    hour_mean = (_number(low, hour_range, 1) + _number(low, hour_range, 2)) * 30
    found = F.coalesce(
        mean(min_range).cast("int"),
        F.when(range_is_hours, hour_mean.cast("int")).otherwise(by_range.cast("int")),
        _number(low, minutes, 1).cast("int"),
        F.when(spelled_out(hours, 2), (_number(low, hours, 1) * 60).cast("int")),
    )
    # few pages have a number before a unit: one pass spares the others all patterns
    return F.when(low.rlike(f"[0-9]{SPACE}*(?:min|h)"), found)


def duration_window(text: Column, tolerance: int = 15, short_hours: bool = False) -> Column:
    """``STRUCT<lo, hi>`` of minutes a query asks for, NULL if it names none.

    A range is taken as it is; a single value spreads by ``tolerance`` to both
    sides, not below 0. ``hr``/``hrs`` are read as plain numbers unless
    ``short_hours`` is set.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    span = "([0-9]+)" + _DASH + "([0-9]+)" + _QUERY_UNIT
    single = "([0-9]+)" + _QUERY_UNIT

    def minutes(pattern: str, group: int, unit_group: int) -> Column:
        unit = F.regexp_extract(low, pattern, unit_group)
        in_hours = unit.startswith("h") if short_hours else unit.contains("hour")
        value = _number(low, pattern, group)
        return F.when(in_hours, F.try_multiply(value, F.lit(60))).otherwise(value)

    a, b = minutes(span, 1, 3), minutes(span, 2, 3)
    v = minutes(single, 1, 2)
    lo = F.when(low.rlike(span), F.least(a, b)).otherwise(F.greatest(v - tolerance, F.lit(0)))
    hi = F.when(low.rlike(span), F.greatest(a, b)).otherwise(F.try_add(v, F.lit(tolerance)))
    return F.when(low.rlike(single), F.struct(lo.alias("lo"), hi.alias("hi")))


# ---------------------------------------------------------------- query terms


def strong_terms(text: Column, vocabulary: Sequence[str] = STRONG_TERMS) -> Column:
    """Words of the text that are in the vocabulary, in order, repeats kept."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0))
    return F.filter(F.transform(words, F.lower), lambda w: w.isin(*vocabulary))


def on_topic(text: Column, terms: Column, whole_word: bool = False) -> Column:
    """Whether the lower-case text holds any of the terms; no terms accept every text."""
    if whole_word:
        padded = F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z]+", " "), F.lit(" "))
        hit = F.exists(terms, lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))
    else:
        hit = F.exists(terms, lambda t: F.contains(text, t))
    return (F.size(terms) == 0) | hit


# ---------------------------------------------------------------- documents

# Label and column of each sentence of an item's document.
DOCUMENT_PARTS = (
    ("Assessment Name: {}. ", "title"),
    ("Category: {}. ", "category"),
    ("Type: {}. ", "test_type"),
    ("Level: {}. ", "level"),
    ("Duration: {} minutes. ", "duration_min"),
    ("Language: {}. ", "language"),
    ("Tags: {}. ", "tags"),
    ("Description: {}. ", "description"),
)


def document(parts: Sequence[tuple[str, str]] = DOCUMENT_PARTS) -> Column:
    """The text an item is embedded by, out of its catalog columns; NULL renders as nothing."""
    pieces = []
    for template, column in parts:
        before, after = template.split("{}")
        pieces += [F.lit(before), null_to_blank(F.col(column)), F.lit(after)]
    return F.concat(*pieces)
