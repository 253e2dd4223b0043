"""Fields of an HTML page as JVM-side regular expressions.

A page is scanned in document order. ``visible`` prepares it once: comments,
scripts, styles and templates are blanked, so no later expression sees markup
inside them, and character references are decoded. Decoded markup characters
stay disguised as control characters until text or attributes are cut out, so
``&lt;p&gt;`` never turns into a tag.

Repeated groups are possessive, which Java matches in a loop; the greedy form
recurses once per repetition and overflows the stack on long pages.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickwell.functions.strings import blank_to_null, contains_any, let, strip

_BREAK = "\u0001"
_MARKUP = "<>&\"'"
_DISGUISE = "\u0002\u0003\u0004\u0005\u0006"

# attributes of a start tag, quotes respected
_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""

# every pattern starts with a plain "<", so that other characters are passed over fast
_HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|template\b[^>]*>.*?(?:</template\s*>|\z))"
)

_TAG = rf"<[a-zA-Z/!?](?:{_ATTRS}>|[^>]*>)"

_ATTRIBUTE = r"""(?s)[^\s=>"'/<]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""


# ---------------------------------------------------------------- text


def visible(html: Column) -> Column:
    """The page without hidden parts and with character references decoded.

    The control characters used as disguise are taken out of the page first.
    """
    own = _BREAK + _DISGUISE
    plain = F.when(html.rlike(f"[{own}]"), F.translate(html, own, "")).otherwise(html)
    return let(
        F.regexp_replace(plain, _HIDDEN, "<!>"),
        lambda page: F.when(page.contains("&"), _decode(page)).otherwise(page),
    )


def _entity_table() -> str:
    """Entity name -> character as a JSON object, frequent names first.

    Numbers 128 to 159 mean the Windows-1252 characters of that code.
    """
    table = {name: chr(code) for name, code in sorted(name2codepoint.items(), key=lambda e: e[1])}
    table |= {name.rstrip(";"): chars for name, chars in html5.items()}
    for code in range(128, 160):
        table[f"#{code}"] = bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    return json.dumps(table)


_ENTITY_JSON = _entity_table()


def _decode(page: Column) -> Column:
    """Replace character references; an unknown name keeps its ``&``."""
    table = F.from_json(F.lit(_ENTITY_JSON), "map<string,string>")
    pieces = F.regexp_extract_all(
        page, F.lit(r"[^&]+|&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?|&"), F.lit(0)
    )

    def numeric(number: Column) -> Column:
        is_char = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return (
            F.when(number.between(1, len(_DISGUISE) + 1), "")
            .when(number.between(128, 159), table[F.concat(F.lit("#"), number.cast("string"))])
            .when(is_char, char)
            .otherwise("\N{REPLACEMENT CHARACTER}")
        )

    def character(name: Column) -> Column:
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 12), 16, 10)).otherwise(F.substring(name, 2, 12))
        return F.when(name.startswith("#"), let(code.try_cast("bigint"), numeric)).otherwise(
            F.coalesce(table[name], F.concat(F.lit("&"), name))
        )

    def decode(piece: Column) -> Column:
        found = let(F.regexp_replace(piece, "^&|;$", ""), character)
        return F.when(piece.startswith("&") & (piece != "&"), F.translate(found, _MARKUP, _DISGUISE)).otherwise(piece)

    return F.array_join(F.transform(pieces, decode), "")


def _undisguise(text: Column) -> Column:
    # five replacements that find nothing cost less than one pass of translate()
    for hidden, shown in zip(_DISGUISE, _MARKUP):
        text = F.replace(text, F.lit(hidden), F.lit(shown))
    return text


def text_of(markup: Column, joiner: str) -> Column:
    """Text of a piece of visible markup, its parts stripped and joined."""
    parts = F.transform(F.split(F.regexp_replace(markup, _TAG, _BREAK), _BREAK), strip)
    return _undisguise(F.array_join(F.filter(parts, lambda part: part != ""), joiner))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag; the last one wins, NULL if absent."""
    found = F.filter(
        F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)),
        lambda a: a.rlike(rf"(?i)^{name}\s*="),
    )
    raw = F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"^[^=]*=\s*", "")
    return _undisguise(F.regexp_replace(raw, r"""^["']|["']$""", ""))


# Elements within a line of text.
_INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var",
)


# ---------------------------------------------------------------- elements
# All take visible markup.


def heading(markup: Column) -> Column:
    """Text of the first h1 or h2, NULL if the page has none or it is empty."""
    inner = F.regexp_extract(markup, rf"(?is)<h[12](?:\s{_ATTRS})?>(.*?)(?:</h[12]\s*>|\z)", 1)
    return blank_to_null(text_of(inner, ""))


def first_paragraph(markup: Column) -> Column:
    """Text of the first ``<p>``; the next ``<p>`` or the end of its container closes it.

    A container is any element that is not part of a line of text.
    """
    closers = rf"<p[\s>]|</(?!(?:{'|'.join(_INLINE)})\s*>)[a-zA-Z][^>]*>|\z"
    inner = F.regexp_extract(markup, rf"(?is)<p(?:\s{_ATTRS})?>(.*?)(?:{closers})", 1)
    return blank_to_null(text_of(inner, " "))


def meta_tags(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<meta\s{_ATTRS}>"), F.lit(0))


def meta_content(metas: Column, key: str, value: str) -> Column:
    """Content of the first meta tag whose ``key`` attribute is ``value``, or NULL."""
    tag = F.try_element_at(F.filter(metas, lambda m: attribute(m, key) == value), F.lit(1))
    return blank_to_null(strip(attribute(tag, "content")))


def anchors(markup: Column) -> Column:
    """Every ``<a …>…`` up to its end tag or the next anchor."""
    return F.regexp_extract_all(
        markup, F.lit(rf"(?is)<a(?:\s{_ATTRS})?>.*?(?=<a[\s>]|</a\s*>|\z)"), F.lit(0)
    )


def start_tag(element: Column) -> Column:
    return F.regexp_extract(element, rf"(?s)^<{_ATTRS}>", 0)


# Elements without content.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


# a tag, or "<" that begins none, with the text that follows it
_PIECE = rf"(?:{_TAG}|<)[^<]*+"

_CLASSES = "array<string>"
_OPEN = f"array<struct<at:int,name:string,classes:{_CLASSES}>>"
_SPANS = f"array<struct<start:int,stop:int,classes:{_CLASSES}>>"
_CHUNK = 128


def elements_of_class(markup: Column, classes: Sequence[str]) -> Column:
    """Elements carrying one of the classes, as ``start, stop, classes, markup``, in order of their start tags.

    An element goes on to the end tag that closes it, elements of the same name
    inside it counted; one inside another is an element of its own. Tags are read
    once; a start tag that its own end tag follows is an element at once, all
    others go through a stack of the open elements.
    """
    wanted = F.array(*map(F.lit, classes))
    none = F.array().cast(_CLASSES)

    def tag(raw: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        is_end = raw.startswith("</")
        carried = F.array_intersect(F.split(strip(attribute(F.regexp_extract(raw, f"^{_TAG}", 0), "class")), r"\s+"), wanted)
        # most tags name none of the classes: a plain search spares them the expressions
        found = F.coalesce(F.when(contains_any(raw, classes) & ~is_end & ~name.isin("", *_VOID), carried), none)
        return F.struct(at.alias("at"), name.alias("name"), F.when(is_end, -1).otherwise(1).alias("step"), found.alias("classes"))

    def sharing_names(tags: Column) -> Column:
        """The tags that share a name with a wanted element."""
        names = F.array_distinct(F.transform(F.filter(tags, lambda t: F.size(t["classes"]) > 0), lambda t: t["name"]))
        return let(names, lambda ns: F.filter(tags, lambda t: F.array_contains(ns, t["name"])))

    def pairs(tags: Column) -> Column:
        """The tags with ``stop``, the place of an end tag that comes next, and ``paired``, also true for that end tag."""

        def pair(t: Column, i: Column) -> Column:
            after, before = F.get(tags, i + 1), F.get(tags, i - 1)
            closed = F.coalesce((after["step"] == -1) & (after["name"] == t["name"]), F.lit(False))
            closes = F.coalesce((before["step"] == 1) & (before["name"] == t["name"]), F.lit(False))
            paired = F.when(t["step"] == 1, closed).otherwise(closes)
            return F.struct(
                *(t[n].alias(n) for n in ("at", "name", "step", "classes")), after["at"].alias("stop"), paired.alias("paired")
            )

        return F.transform(tags, pair)

    def span(start: Column, stop: Column, classes: Column) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"), classes.alias("classes"))

    def spans(tags: Column, end: Column) -> Column:
        """Places of the wanted elements: of their start tag, and of their end tag or ``end``."""
        whole = F.filter(tags, lambda t: t["paired"] & (F.size(t["classes"]) > 0))
        simple = F.transform(whole, lambda t: span(t["at"], t["stop"], t["classes"]))
        return F.array_sort(F.concat(simple, let(F.filter(tags, lambda t: ~t["paired"]), lambda rest: fold(rest, end))))

    def step(state: Column, tag: Column) -> Column:
        is_open, closed = state["open"], state["closed"]

        def close(place: Column) -> Column:
            # the element opened last of all of that name; an end tag without one is passed over
            def ends(e: Column) -> Column:
                others = F.concat(F.slice(is_open, 1, place - 1), F.slice(is_open, place + 1, F.size(is_open) - place))
                one = F.array(span(e["at"], tag["at"], e["classes"]))
                kept = F.when(F.size(e["classes"]) > 0, F.concat(closed, one)).otherwise(closed)
                return F.struct(others.alias("open"), kept.alias("closed"))

            return F.when(place > 0, let(F.get(is_open, place - 1), ends)).otherwise(state)

        one = F.array(F.struct(*(tag[n].alias(n) for n in ("at", "name", "classes"))))
        opened = F.struct(F.concat(is_open, one).alias("open"), closed.alias("closed"))
        backwards = F.array_position(F.reverse(F.transform(is_open, lambda o: o["name"])), tag["name"]).cast("int")
        place = F.when(backwards > 0, F.size(is_open) + 1 - backwards).otherwise(0)
        return F.when(tag["step"] == 1, opened).otherwise(let(place, close))

    def fold(tags: Column, end: Column) -> Column:
        def finish(state: Column) -> Column:
            unclosed = F.filter(state["open"], lambda o: F.size(o["classes"]) > 0)
            return F.concat(F.flatten(state["closed"]), F.transform(unclosed, lambda o: span(o["at"], end, o["classes"])))

        # a state is copied at each step, so what is closed is handed on a chunk at a time
        last = F.floor((F.size(tags) - 1) / _CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.slice(tags, c * _CHUNK + 1, _CHUNK))

        def further(state: Column, chunk: Column) -> Column:
            entry = F.struct(state["open"].alias("open"), F.array().cast(_SPANS).alias("closed"))
            return let(
                F.aggregate(chunk, entry, step),
                lambda done: F.struct(done["open"].alias("open"), F.concat(state["closed"], F.array(done["closed"])).alias("closed")),
            )

        begin = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(f"array<{_SPANS}>").alias("closed"))
        return F.when(F.size(tags) > 0, F.aggregate(chunks, begin, further, finish)).otherwise(F.array().cast(_SPANS))

    def every(pieces: Column) -> Column:
        def element(s: Column) -> Column:
            inside = F.array_join(F.slice(pieces, s["start"] + 1, s["stop"] - s["start"]), "")
            # the end tag belongs to the element, the text after it does not
            end = F.regexp_extract(F.coalesce(F.get(pieces, s["stop"]), F.lit("")), f"^{_TAG}", 0)
            return F.struct(*(s[n].alias(n) for n in ("start", "stop", "classes")), F.concat(inside, end).alias("markup"))

        found = let(F.transform(pieces, tag), sharing_names)
        return F.transform(let(found, lambda tags: let(pairs(tags), lambda ts: spans(ts, F.size(pieces)))), element)

    # most pages name none of the classes: a plain search spares them all of it
    empty = F.array().cast(f"array<struct<start:int,stop:int,classes:{_CLASSES},markup:string>>")
    return F.when(contains_any(markup, classes), let(F.regexp_extract_all(markup, F.lit(_PIECE), F.lit(0)), every)).otherwise(empty)


def _of_class(elements: Column, classes: Sequence[str]) -> Column:
    wanted = F.array(*map(F.lit, classes))
    return F.filter(elements, lambda e: F.arrays_overlap(e["classes"], wanted))


def element_texts(elements: Column, classes: Sequence[str]) -> Column:
    """Non-empty texts of those of the elements that carry one of the classes, in order."""
    return F.filter(F.transform(_of_class(elements, classes), lambda e: text_of(e["markup"], "")), lambda t: t != "")


def class_texts(markup: Column, classes: Sequence[str]) -> Column:
    """Non-empty texts of the elements carrying one of the classes, in order."""
    return element_texts(elements_of_class(markup, classes), classes)


# Fixed value: the class of a breadcrumb.
BREADCRUMB = "breadcrumb"


def element_breadcrumb(elements: Column, cls: str = BREADCRUMB, joiner: str = " > ") -> Column:
    """Anchor texts inside those of the elements that carry the class, or NULL. An anchor counts once, however deep it lies."""
    begin = F.struct(F.lit(0).alias("stop"), F.array().cast("array<string>").alias("kept"))

    def outermost(state: Column, e: Column) -> Column:
        further = F.struct(e["stop"].alias("stop"), F.concat(state["kept"], F.array(e["markup"])).alias("kept"))
        return F.when(e["start"] >= state["stop"], further).otherwise(state)

    containers = F.aggregate(_of_class(elements, [cls]), begin, outermost, lambda state: state["kept"])
    links = F.flatten(F.transform(containers, anchors))
    texts = F.filter(F.transform(links, lambda a: text_of(a, "")), lambda t: t != "")
    return blank_to_null(F.array_join(texts, joiner))


def breadcrumb(markup: Column, cls: str = BREADCRUMB, joiner: str = " > ") -> Column:
    """Anchor texts inside the elements of class ``breadcrumb``, or NULL. An anchor counts once, however deep it lies."""
    return element_breadcrumb(elements_of_class(markup, [cls]), cls, joiner)
