"""License notices found by ordered signature rules, as column expressions only.

A rule is a regular expression over the words of a text (A-Z in lower case, one
blank between words) that begins with a plain word, its lead. Rules have a kind,
and kinds have an order: identifiers, sentences out of license texts, names with
a version, bare names, loose hints. Three gates keep rules away from text they
cannot match: a text must hold one of the plain strings without which no rule
matches, a rule is only tried where its lead stands, and only if the next words
hold the longest string that every match of the rule has.

A detection is an interval of words. It is dropped if the interval of a
detection that comes before it holds it: in the order of kind, length (longer
first), place and rule. What is left gives the labels. As a detection dropped
for another is also held by that other one's holder, the order needs no loop.
An interval has at most ``LONGEST`` words, so only detections that begin within
as many words before are looked at, and work is in proportion to the text.

Base phrases (``BASE``) are counted at every place and never dropped; their labels
are added to those of the rules.

Defined cases: NULL, empty and blank texts have no words, labels ``''`` and score 0;
rows are independent of each other, so repeated rows, ids that repeat or are
NULL and other columns make no difference; an input column named as the result
is replaced.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwell.functions.strings import contains_any, let

# what stands between words, words, and words of a text in lower case
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 24

# Phrases whose places are counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Kinds in their order, and how sure a detection of each is.
KINDS = {"identifier": 1.0, "text": 0.95, "version": 0.9, "name": 0.8, "hint": 0.4}

_L = "licen[sc]e"
_V = "(?:version |v)?"

# Label and signature. {v} is each version of the line's list in turn.
_NAMES = (
    ("agpl", "gnu affero general public licen[sc]e"), ("agpl", "affero general public licen[sc]e"), ("agpl", "agpl"),
    ("lgpl", "gnu lesser general public licen[sc]e"), ("lgpl", "lesser general public licen[sc]e"),
    ("lgpl", "gnu library general public licen[sc]e"), ("lgpl", "library general public licen[sc]e"), ("lgpl", "lgpl"),
    ("gpl", "gnu general public licen[sc]e"), ("gpl", "general public licen[sc]e"), ("gpl", "gnu gpl"), ("gpl", "gpl"),
    ("gfdl", "gnu free documentation licen[sc]e"), ("gfdl", "gfdl"),
    ("apache", "apache (?:software )?licen[sc]e"), ("mit", "mit licen[sc]ed?"), ("mit", "mit x11 licen[sc]e"), ("x11", "x11 licen[sc]e"),
    ("mit-0", "mit no attribution"), ("expat", "expat licen[sc]e"),
    ("bsd", "bsd licen[sc]ed?"), ("bsd", "bsd style licen[sc]e"), ("bsd", "berkeley software distribution licen[sc]e"),
    ("isc", "isc licen[sc]e"), ("mpl", "mozilla public licen[sc]e"), ("mpl", "mpl"),
    ("epl", "eclipse public licen[sc]e"), ("edl", "eclipse distribution licen[sc]e"), ("cpl", "common public licen[sc]e"),
    ("ipl", "ibm public licen[sc]e"), ("cddl", "common development and distribution licen[sc]e"), ("cddl", "cddl"),
    ("eupl", "european union public licen[sc]e"), ("eupl", "eupl"), ("cecill", "cecill"),
    ("artistic", "artistic licen[sc]e"), ("perl", "same terms as perl(?: itself)?"),
    ("psf", "python software foundation licen[sc]e"), ("php", "php licen[sc]e"), ("ruby", "ruby licen[sc]e"),
    ("zlib", "zlib licen[sc]e"), ("zlib", "zlib libpng licen[sc]e"), ("libpng", "libpng licen[sc]e"), ("bsl", "boost software licen[sc]e"),
    ("unlicense", "unlicense"), ("unlicense", "unlicence"), ("wtfpl", "wtfpl"), ("wtfpl", "do what the fuck you want to public licen[sc]e"),
    ("ofl", "sil open font licen[sc]e"), ("ofl", "open font licen[sc]e"), ("odbl", "open database licen[sc]e"), ("odbl", "odbl"),
    ("odc-by", "open data commons attribution licen[sc]e"), ("pddl", "public domain dedication and licen[sc]e"),
    ("afl", "academic free licen[sc]e"), ("osl", "open software licen[sc]e"), ("ncsa", "ncsa open source licen[sc]e"),
    ("postgresql", "postgresql licen[sc]e"), ("openssl", "openssl licen[sc]e"), ("ssleay", "ssleay licen[sc]e"),
    ("freetype", "freetype (?:project )?licen[sc]e"), ("icu", "icu licen[sc]e"), ("unicode", "unicode (?:data files and software )?licen[sc]e"),
    ("w3c", "w3c (?:software )?(?:notice and )?licen[sc]e"), ("zpl", "zope public licen[sc]e"), ("json", "json licen[sc]e"),
    ("beerware", "beerware"), ("beerware", "beer ware licen[sc]e"), ("ms-pl", "microsoft public licen[sc]e"), ("ms-rl", "microsoft reciprocal licen[sc]e"),
    ("qpl", "q public licen[sc]e"), ("sleepycat", "sleepycat licen[sc]e"), ("upl", "universal permissive licen[sc]e"),
    ("ecl", "educational community licen[sc]e"), ("lppl", "latex project public licen[sc]e"), ("apsl", "apple public source licen[sc]e"),
    ("npl", "netscape public licen[sc]e"), ("naumen", "naumen public licen[sc]e"), ("vim", "vim licen[sc]e"), ("curl", "curl licen[sc]e"),
    ("hpnd", "historical permission notice and disclaimer"), ("tcl", "tcl tk licen[sc]e"), ("mulan", "mulan (?:permissive|public) (?:software )?licen[sc]e"),
    ("sspl", "server side public licen[sc]e"), ("busl", "business source licen[sc]e"), ("elastic", "elastic licen[sc]e"),
    ("commons-clause", "commons clause"), ("polyform", "polyform (?:noncommercial|small business|shield|strict) licen[sc]e"),
    ("openrail", "openrail"), ("openrail", "open rail"), ("llama", "llama (?:[0-9]+ )*community licen[sc]e"),
    ("cc0", "cc0"), ("cc0", "creative commons zero"), ("cc", "creative commons licen[sc]e"), ("cc", "creative commons attribution"),
    ("cc-by", "cc by"), ("cc-sa", "cc sa"), ("ogl", "open government licen[sc]e"), ("public-domain", "dedicated to the public domain"),
    ("public-domain", "released into the public domain"), ("public-domain", "placed in the public domain"),
)

# Sentences out of the texts of licenses and of the notices they ask for.
_TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the names? of .{1,90} may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion )? ?2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "boost software licen[sc]e version 1 0 august 17th 2003"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("json", "the software shall be used for good not evil"),
    ("ofl-1.1", "this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("php", "this product includes php software"), ("openssl", "this product includes software developed by the openssl project"),
    ("apache", "this product includes software developed by the apache software foundation"),
    ("w3c", "this work is being provided by the copyright holders under the following licen[sc]e"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
)

# Loose hints.
_HINTS = (
    ("all-rights-reserved", "all rights reserved"), ("proprietary", "proprietary and confidential"), ("proprietary", "company confidential"),
    ("proprietary", "unauthorized copying of this file"), ("proprietary", "no part of this publication may be reproduced"),
    ("noncommercial", "for non ?commercial use only"), ("noncommercial", "noncommercial licen[sc]e"), ("noncommercial", "non commercial licen[sc]e"), ("evaluation", "evaluation licen[sc]e"),
    ("eula", "end user licen[sc]e agreement"), ("eula", "eula"), ("royalty-free", "royalty free licen[sc]e"), ("public-domain", "public domain"),
)

# Label, signature before the version, versions.
_VERSIONED = (
    ("gpl", "(gnu )general public licen[sc]e", "1 2 3"), ("gpl", "gnu gpl", "1 2 3"), ("gpl", "gpl", "1 2 3"),
    ("lgpl", "(gnu )lesser general public licen[sc]e", "2.1 3"), ("lgpl", "(gnu )library general public licen[sc]e", "2"), ("lgpl", "lgpl", "2 2.1 3"),
    ("agpl", "(gnu )affero general public licen[sc]e", "1 3"), ("agpl", "agpl", "1 3"), ("gfdl", "(gnu )free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache (?:software )?licen[sc]e", "1.0 1.1 2.0"), ("apache", "apache", "1.1 2.0"), ("mpl", "mozilla public licen[sc]e", "1.0 1.1 2.0"), ("mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public licen[sc]e", "1.0 2.0"), ("cddl", "common development and distribution licen[sc]e", "1.0 1.1"), ("cddl", "cddl", "1.0 1.1"),
    ("eupl", "european union public licen[sc]e", "1.0 1.1 1.2"), ("eupl", "eupl", "1.1 1.2"), ("artistic", "artistic licen[sc]e", "1.0 2.0"),
    ("cecill", "cecill", "1.0 2.0 2.1"), ("afl", "academic free licen[sc]e", "1.2 2.1 3.0"), ("osl", "open software licen[sc]e", "1.0 2.1 3.0"),
    ("bsl", "boost software licen[sc]e", "1.0"), ("ofl", "sil open font licen[sc]e", "1.0 1.1"), ("odbl", "open database licen[sc]e", "1.0"),
    ("php", "php licen[sc]e", "3.0 3.01"), ("zpl", "zope public licen[sc]e", "1.1 2.0 2.1"), ("lppl", "latex project public licen[sc]e", "1.0 1.2 1.3"),
    ("ecl", "educational community licen[sc]e", "1.0 2.0"), ("apsl", "apple public source licen[sc]e", "1.0 2.0"), ("sspl", "server side public licen[sc]e", "1"),
    ("busl", "business source licen[sc]e", "1.0 1.1"), ("elastic", "elastic licen[sc]e", "2.0"), ("ogl", "open government licen[sc]e", "1.0 2.0 3.0"),
    ("python", "python licen[sc]e", "2.0"), ("cc0", "cc0", "1.0"), ("cc0", "creative commons zero", "1.0"), ("upl", "universal permissive licen[sc]e", "1.0"),
    ("bsd", "bsd", "2-clause 3-clause 4-clause"),
)

# The parts a Creative Commons license may have, its versions, and names of the registry of identifiers.
_CC_PARTS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_IDENTIFIERS = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0",
    "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CDDL-1.0",
    "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0",
    "PDDL-1.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "SSPL-1.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)

# strings seldom found but in such notices
_ANCHORS = (
    "licen", "gpl", "gfdl", "spdx", "creative", "redistribut", "hereby", "warrant", "reserved", "copyright", "confidential", "domain",
    "endorse", "includes", "commercial", "neighboring", "unauthorized", "reproduced", "advertising", "permission", "apache", "cc0",
)


@dataclass(frozen=True)
class Rule:
    """``pattern`` begins with the word ``lead``; every match holds ``needs``, and its text ``anchor``."""

    number: int
    label: str
    kind: str
    pattern: str
    base: bool = False

    @property
    def lead(self) -> str:
        return re.match("[a-z0-9]+", self.pattern)[0]

    @property
    def literals(self) -> list[str]:
        """Strings that every match has."""
        plain = self.pattern
        while plain != (plain := re.sub(r"\([^()]*\)[?*+]?", "|", plain)):
            pass
        return re.findall("[a-z0-9]+", re.sub(r"\[[^\]]*\][?*+]?|[a-z0-9 ]\?|\.(?:\{[^}]*\}|[*+])", "|", plain))

    @property
    def needs(self) -> str:
        return max(self.literals[1:] or self.literals, key=len)

    @property
    def anchor(self) -> str:
        """The first of ``_ANCHORS`` that every match has, else its longest string."""
        return next((a for a in _ANCHORS if any(a in x for x in self.literals)), max(self.literals, key=len))


def _dotted(version: str) -> str:
    """``2.0`` as words; a whole version may come without its zero."""
    whole = re.fullmatch(r"(\d+)(?:\.0)?", version)
    return f"{whole[1]}(?: 0)?" if whole else re.sub(r"[.-]", " ", version)


def _label(name: str, version: str) -> str:
    return f"{name}-{version}.0" if version.isdigit() else f"{name}-{version}"


def rules() -> list[Rule]:
    """All rules in their order, base phrases last."""
    made: list[tuple[str, str, str]] = []
    for name in _IDENTIFIERS:
        words = re.sub(r"[.-]", " ", name.lower())
        made.append((name.lower(), "identifier", f"spdx licen[sc]e identifier {words}"))
    made += [(label, "text", pattern) for label, pattern in _TEXTS]
    for name, pattern, versions in _VERSIONED:
        published = "(?:as published by the free software foundation )?(?:either )?" if "(gnu )" in pattern else ""
        full = [pattern.replace("(gnu )", prefix) for prefix in (("gnu ", "") if "(gnu )" in pattern else ("",))]
        for version in versions.split():
            label, v = _label(name, version), _dotted(version)
            for start in full:
                later = f"(?: or (?:at your option )?(?:any )?(?:later|newer)(?: version)?| of the {_L} or (?:at your option )?any later(?: version)?)"
                if "gpl" in name:
                    made.append((f"{label}-or-later", "version", f"{start} {published}{_V}{v}{later}"))
                    made.append((f"{label}-only", "version", f"{start} {_V}{v} only"))
                made.append((label, "version", f"{start} {published}{_V}{v}"))
            if " " not in pattern and version.isdigit():
                made.append((label, "version", f"{pattern}v{version}"))
    for parts in _CC_PARTS:
        short, long = parts.replace("-", " "), " ".join(_CC_WORDS[p] for p in parts.split("-"))
        for version in _CC_VERSIONS:
            made.append((f"cc-{parts}-{version}", "version", f"cc {short} {_dotted(version)}"))
            made.append((f"cc-{parts}-{version}", "version", f"creative commons {long} {_dotted(version)}"))
        made.append((f"cc-{parts}", "name", f"cc {short}"))
        made.append((f"cc-{parts}", "name", f"creative commons {long}"))
    made += [(label, "name", pattern) for label, pattern in _NAMES]
    made += [(label, "hint", pattern) for label, pattern in _HINTS]
    # of equal signatures the first counts
    made = list({r[2]: r for r in reversed(made)}.values())[::-1]
    order = {kind: i for i, kind in enumerate(KINDS)}
    made.sort(key=lambda r: order[r[1]])
    found = [Rule(i, *r) for i, r in enumerate(made)]
    return found + [Rule(len(made) + i, label, "name", phrase, True) for i, (phrase, label) in enumerate(BASE)]


def bounded(pattern: str) -> str:
    """The pattern at the start of a window, ending with a word, as group 1."""
    return f"^({pattern})(?: |$)"


RULES = rules()
_RULE = "array<struct<number:int,label:string,place:int,sure:double,base:boolean,needs:string,pattern:string>>"
_FOUND = "array<struct<start:bigint,words:bigint,label:string,kind:int,sure:double,base:boolean,rule:int>>"


def _table(known: list[Rule]) -> Column:
    """Rules by lead as a constant."""
    kinds = list(KINDS)
    by: dict[str, list[dict]] = {}
    for r in known:
        cell = {"number": r.number, "label": r.label, "place": kinds.index(r.kind), "sure": KINDS[r.kind], "base": r.base, "needs": r.needs, "pattern": bounded(r.pattern)}
        by.setdefault(r.lead, []).append(cell)
    return F.from_json(F.lit(json.dumps(by)), f"map<string,{_RULE}>")


def anchors(known: list[Rule]) -> list[str]:
    """Plain strings of which every text with a match holds one."""
    every = {r.anchor for r in known}
    return sorted(a for a in every if not any(b != a and b in a and len(b) > 2 for b in every))


def _may_match(text: Column, known: list[Rule]) -> Column:
    """False for texts that no rule can match, true for few others."""
    plain = [a for a in anchors(known) if len(a) > 2]
    # two letters are in many words, so the rules' next word must follow
    short = sorted({f"{r.lead}{BETWEEN}{r.literals[1]}" for r in known if len(r.anchor) <= 2})
    return let(F.lower(text), lambda t: contains_any(t, plain) | (t.rlike("|".join(short)) if short else F.lit(False)))


def detections(text: Column, known: list[Rule] = RULES) -> Column:
    """What the rules find in a text: places, words and labels, base phrases marked, held intervals dropped."""
    table, leads = _table(known), sorted({r.lead for r in known})

    def tried(words: Column, i: Column) -> Column:
        def matches(window: Column) -> Column:
            def match(r: Column) -> Column:
                return let(
                    F.call_function("regexp_extract", window, r["pattern"], F.lit(1)),
                    lambda m: F.when(
                        m != "",
                        F.struct(
                            i.cast("bigint").alias("start"),
                            F.size(F.split(m, " ")).cast("bigint").alias("words"),
                            r["label"].alias("label"), r["place"].alias("kind"), r["sure"].alias("sure"), r["base"].alias("base"), r["number"].alias("rule"),
                        ),
                    ),
                )

            possible = F.filter(table[F.get(words, i)], lambda r: window.contains(r["needs"]))
            return F.filter(F.transform(possible, match), lambda d: d.isNotNull())

        return let(F.array_join(F.slice(words, i + 1, LONGEST), " "), matches)

    def order(d: Column) -> Column:
        return F.struct(d["kind"], -d["words"], d["start"], d["rule"])

    def undropped(groups: Column) -> Column:
        def of_place(group: Column, j: Column) -> Column:
            # places are distinct words, so at most LONGEST of them can reach this one
            first = F.greatest(j - (LONGEST - 2), F.lit(1))
            near = F.flatten(F.slice(groups, first, j + 2 - first))

            def holds(e: Column, d: Column) -> Column:
                inside = (e["start"] <= d["start"]) & (e["start"] + e["words"] >= d["start"] + d["words"])
                return ~e["base"] & inside & (order(e) < order(d))

            return let(near, lambda all_near: F.filter(group, lambda d: d["base"] | ~F.exists(all_near, lambda e: holds(e, d))))

        return F.flatten(F.transform(groups, of_place))

    def every(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*leads), i)), lambda i: i.isNotNull())
        groups = F.filter(F.transform(places, lambda i: tried(words, i)), lambda g: F.size(g) > 0)
        return let(groups, undropped)

    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LOWER_WORD), F.lit(0))
    return F.when(_may_match(text, known), let(words, every)).otherwise(F.array().cast(_FOUND))


def with_licenses(docs: DataFrame, text: str = "text", name: str = "licenses", known: list[Rule] = RULES) -> DataFrame:
    """``docs`` with an array of what was found (``start``, ``words``, ``label``, ``kind``, ``sure``, ``base``, ``rule``) as one more column."""
    return docs.withColumn(name, detections(F.coalesce(F.col(text), F.lit("")), known))


def license_query(docs: DataFrame) -> DataFrame:
    """Words, places of the base phrases, labels and the surest detection of each document."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    found = with_licenses(docs.select("doc_id", "text")).select("doc_id", n.alias("n_words"), "licenses")
    base = F.filter("licenses", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    names = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda d: d["sure"])), F.lit(0.0)).alias("score"),
    )
