"""From raw pages to links and typed catalog rows. All of it is map-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwell.functions import html as H
from pickwell.functions import text as X
from pickwell.functions.strings import contains_any, let, null_to_blank, strip
from pickwell.functions.urls import resolve_href
from pickwell.operators.dedup import keep_first

# Parts of a product URL, and classes of tag elements.
PRODUCT_PATHS = ("/products/", "/solutions/products/")
TAG_CLASSES = ("tag", "badge", "label")


def extract_links(
    pages: DataFrame,
    site: str,
    fragments: Sequence[str] = PRODUCT_PATHS,
    min_text: int = 3,
) -> DataFrame:
    """``page_id, pos, title, url`` of every anchor whose URL holds one of the fragments."""
    def link(anchor: Column, pos: Column) -> Column:
        url = let(
            strip(H.attribute(H.start_tag(anchor), "href")),
            lambda href: F.when(href != "", resolve_href(href, site)),
        )
        return F.struct(pos.alias("pos"), anchor.alias("anchor"), url.alias("url"))

    # Selecting inside the array computes each URL once; as a filter on rows it
    # would be pushed below the projection and computed again there.
    every = F.transform(H.anchors(H.visible(F.col("html"))), link)
    chosen = F.filter(every, lambda l: contains_any(l["url"], fragments))
    titled = F.transform(
        chosen,
        lambda l: F.struct(l["pos"].alias("pos"), H.text_of(l["anchor"], "").alias("title"), l["url"].alias("url")),
    )
    long_enough = F.filter(titled, lambda l: F.length(l["title"]) >= min_text)
    return pages.select("page_id", F.inline(long_enough))


def dedup_links(links: DataFrame) -> DataFrame:
    """One row per URL: its first anchor in page order."""
    return keep_first(links, ["url"], ["page_id", "pos"])


def _parsed(pages: DataFrame) -> DataFrame:
    """Adds the visible markup, its meta tags and its lower-case text, each computed once."""
    df = pages.withColumn("_markup", H.visible(F.col("html")))
    return df.withColumns(
        {
            "_metas": H.meta_tags(F.col("_markup")),
            "_body": F.lower(H.text_of(F.col("_markup"), " ")),
            "_heading": H.heading(F.col("_markup")),
        }
    )


def page_fields(
    pages: DataFrame,
    variant: str = "crawl",
    tag_classes: Sequence[str] = TAG_CLASSES,
    short_hours: bool = False,
) -> DataFrame:
    """Typed fields of every page, next to the input columns other than ``html``.

    ``crawl``: heading as title, tags and breadcrumb category, loose level rule.
    ``augment``: open-graph fall-backs, full duration parser, whole-word levels,
    knowledge before personality; category and tags stay ``''``.
    """
    df = _parsed(pages)
    markup, metas, body = F.col("_markup"), F.col("_metas"), F.col("_body")
    keep = [c for c in pages.columns if c != "html"]
    description = H.meta_content(metas, "name", "description")
    if variant == "crawl":
        # one reading of the tags serves the breadcrumb and the tag elements
        df = df.withColumn("_elements", H.elements_of_class(markup, [H.BREADCRUMB, *tag_classes]))
        fields: dict[str, Column] = {
            "title": F.col("_heading"),
            "description": F.coalesce(description, H.first_paragraph(markup)),
            "category": H.element_breadcrumb(F.col("_elements")),
            "test_type": X.test_type_personality_first(body),
            "level": X.level_substring(body),
            "duration_min": X.duration_simple(body),
            "language": X.language(body),
            "tags": F.nullif(F.array_join(H.element_texts(F.col("_elements"), tag_classes), ";"), F.lit("")),
        }
    elif variant == "augment":
        fields = {
            "title": F.coalesce(F.col("_heading"), H.meta_content(metas, "property", "og:title")),
            "description": F.coalesce(
                description, H.meta_content(metas, "property", "og:description"), H.first_paragraph(markup)
            ),
            "category": F.lit(""),
            "test_type": X.test_type_knowledge_first(body),
            "level": X.level_word(body),
            "duration_min": X.duration_full(body, short_hours),
            "language": X.language(body),
            "tags": F.lit(""),
        }
    else:
        raise ValueError(f"unknown variant {variant!r}: expected 'crawl' or 'augment'")
    return df.select(*keep, *(c.alias(n) for n, c in fields.items()))


def page_reject_reason(url: Column, html: Column, title: Column) -> Column:
    """Why a page gives no catalog row, NULL if it gives one."""
    return (
        F.when(null_to_blank(url) == "", "no url")
        .when(html.isNull(), "no html")
        .when(null_to_blank(title) == "", "no title")
        .when(X.is_bundle(title), "bundle")
    )


def page_rejects(pages: DataFrame) -> DataFrame:
    """``page_id, url, reason`` of the pages that are skipped; the others go on."""
    reason = let(
        H.heading(H.visible(F.col("html"))), lambda t: page_reject_reason(F.col("url"), F.col("html"), t)
    )
    checked = F.filter(F.array(F.struct(reason.alias("reason"))), lambda c: c["reason"].isNotNull())
    return pages.select("page_id", "url", F.inline(checked))


def page_titles(pages: DataFrame) -> DataFrame:
    """``page_id, title`` of the pages that have a title and are no bundle."""
    title = F.array(H.heading(H.visible(F.col("html"))))
    kept = F.filter(title, lambda t: t.isNotNull() & ~X.is_bundle(t))
    return pages.select("page_id", F.explode(kept).alias("title"))
