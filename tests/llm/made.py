"""Made documents for the tests of the corpus operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {
    "en": "the ing tion of and ther with ness ly ed house water",
    "de": "der ung keit und schaft sch ein zu haus wasser über",
    "ru": "ова ние при кра дом вода и на с лес",
}


def words(rng: random.Random, lang: str, n: int) -> list[str]:
    stems = STEMS[lang].split()
    return ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def make_docs(n: int = 150, seed: int = 3) -> list[tuple]:
    """Texts in three languages with copies, near copies, a shared passage, empty, missing and one very long text."""
    rng = random.Random(seed)
    passage = words(rng, "en", 40)
    rows: list[tuple] = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        w = words(rng, lang, rng.randint(1, 120))
        if i % 10 == 3:
            w = w[:20] + passage + w[20:]
        if i % 12 == 5 and rows:
            w = (rows[-1][1] or "").split() or ["solo"]
            w[len(w) // 2] = "changed"
        text = rng.choice([" ", "\n", "  "]).join(w)
        if i % 15 == 7:
            text = "the very same text of many rows here"
        rows.append((i, text, lang, f"s{i % 3}" if i % 11 else None, len(text)))
    rows += [
        (n, None, "en", "s0", 0), (n + 1, "", None, "s1", 0), (n + 2, " \t\n ", "de", "s1", 4), (n + 3, "1234 !? --", "en", None, 10),
        (n + 4, " ".join(words(rng, "de", 20_000)), "de", "s2", 0), (n + 5, "one", "en", "s0", 3),
        (n + 6, "The the  Ünï ▁x\x1c日本  \x00 <s>", "en", "s0", 3), rows[0], rows[0], (None, "no id at all", "en", "s2", 1),
    ]
    return rows
