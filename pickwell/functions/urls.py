"""URL functions as JVM-side string expressions.

``parse_url`` is avoided: it raises on characters such as blanks, which real
pages contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickwell.functions.strings import blank_to_null, let, strip


def _without_suffix(url: Column) -> Column:
    """Cut query, fragment and the ``;params`` of the last path segment."""
    url = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(url, r"(/[^/;]*);[^/]*$", "$1")


def normalize_url(url: Column) -> Column:
    """Authority + path in lower case, for comparing two spellings of a URL.

    ``www.`` goes only after a scheme, the port stays, NULL becomes ``''``.
    """
    u = F.lower(strip(url))
    u = F.regexp_replace(u, r"[\t\r\n]", "")
    u = F.regexp_replace(u, r"^https?://(www\.)?", "")
    u = _without_suffix(u)
    return F.coalesce(F.regexp_replace(u, r"/+$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL without the outer slashes."""
    u = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    u = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    u = F.regexp_replace(u, r"^//[^/?#]*", "")
    return F.btrim(_without_suffix(u), F.lit("/"))


def slug(url: Column, default: str | None = None) -> Column:
    """Id made of the URL path: lower case, other characters to single dashes."""
    s = F.regexp_replace(F.lower(url_path(url)), r"[^a-z0-9]+", "-")
    s = F.btrim(s, F.lit("-"))
    return s if default is None else F.coalesce(blank_to_null(s), F.lit(default))


def title_from_url(url: Column, default: str = "Untitled") -> Column:
    """Readable title out of the URL path; every run of letters is capitalised."""
    words = F.regexp_extract_all(F.lower(F.replace(url_path(url), F.lit("-"), F.lit(" "))),
                                 F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    title = F.array_join(F.transform(words, F.initcap), "")
    return F.coalesce(blank_to_null(title), F.lit(default))


def resolve_href(href: Column, site: str) -> Column:
    """Absolute URL of a link, seen from the root of ``site`` (scheme://host)."""
    site = site.rstrip("/")
    scheme = site.split("://", 1)[0]

    def relative(href: Column) -> Column:
        path = F.regexp_replace(href, r"[?#].*$", "")
        suffix = F.regexp_extract(href, r"[?#].*$", 0)
        # only a path that is not rooted loses its empty inner segments
        full = F.when(path.startswith("/") | (path == ""), path).otherwise(
            F.concat(F.lit("/"), F.regexp_replace(path, "/{2,}", "/"))
        )
        return F.concat(F.lit(site), let(full, lambda f: F.when(f.contains("/."), _drop_dots(f)).otherwise(f)), suffix)

    def resolve(href: Column) -> Column:
        return (
            F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.lit(scheme + ":"), href))
            .otherwise(relative(href))
        )

    href = F.regexp_replace(href, r"[\t\r\n]", "")
    # "https:path" with the site's own scheme and no host is a relative link
    return let(F.regexp_replace(href, rf"(?i)^{scheme}:(?!//)", ""), resolve)


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a rooted path."""
    segments = F.split(path, "/")

    def step(kept: Column, seg: Column) -> Column:
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(seg == "..", parent).when(seg == ".", kept).otherwise(F.array_append(kept, seg))

    def join(kept: Column) -> Column:
        ends_in_dots = F.element_at(segments, -1).isin(".", "..")
        return F.array_join(F.when(ends_in_dots, F.array_append(kept, F.lit(""))).otherwise(kept), "/")

    joined = let(F.aggregate(segments, F.array().cast("array<string>"), step), join)
    return let(joined, lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))


def markdown_link(url: Column, label: str = "link") -> Column:
    """``[link](url)``, or ``''`` for a blank URL."""
    return F.when(strip(url) != "", F.concat(F.lit(f"[{label}]("), url, F.lit(")"))).otherwise("")
