from __future__ import annotations

from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st

from pickwell.functions import urls as U

SITE = "https://www.example.com"


def test_normalize(rows):
    golden = {
        " HTTPS://www.Example.com/A/b//?q=1#f": "example.com/a/b",
        "http://example.com": "example.com",
        "www.example.com/x/": "www.example.com/x",
        "https://x.com:80/p;v=1?z": "x.com:80/p",
        "https://x.com/a;b/c;d=1;e": "x.com/a;b/c",
        "/rel/path": "/rel/path",
        "": "",
        "https://www.www.x.com/": "www.x.com",
        "ftp://x.com/a": "ftp://x.com/a",
        "　https://x.com/a\n": "x.com/a",
    }
    assert rows([*golden, None], U.normalize_url) == [*golden.values(), ""]


def test_slug_and_title(rows):
    urls = ["https://x.com/Some/Path_1/?q", "https://x.com/", "https://x.com/a b-c/", "", "https://x.com/bar2baz-o'neil"]
    assert rows(urls, U.slug) == ["some-path-1", "", "a-b-c", "", "bar2baz-o-neil"]
    assert rows(urls, lambda c: U.slug(c, "item"))[1] == "item"
    assert rows(urls, lambda c: U.title_from_url(c, "None")) == ["Some/Path_1", "None", "A B C", "None", "Bar2Baz O'Neil"]


def test_markdown_link(rows):
    assert rows(["u", " ", None], U.markdown_link) == ["[link](u)", "", ""]


def test_resolve_href_agrees_with_the_standard_library(rows):
    fixed = [
        "/a/b", "a/b", "../x/y", "./x", "a/./b/../c", "/a/../../b", "/a/b/..", "a/.", "//cdn.x.com/p", "?q=1", "#f",
        "https://other.com/a/../b", "mailto:x@y.z", "javascript:void(0)", "https:rel/x", "a//b", "/a//b", "x;p=1?q#f",
        "/..", "..", ".", "/.", "a?u=/../x", "/x#/./y", "/a/...", "/.hidden/x",
    ]
    piece = st.sampled_from(["a", "b.c", "..", ".", "", "x;y", "products"])

    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(st.booleans(), st.lists(piece, min_size=1, max_size=6), st.sampled_from(["", "?q=1", "#z"])), min_size=300, max_size=300))
    def check(made):
        hrefs = fixed + [h for h in (("/" if root else "") + "/".join(parts) + tail for root, parts, tail in made) if h]
        # an empty authority is not a link anyone can follow
        hrefs = [h for h in hrefs if not h.startswith("//") or h == "//cdn.x.com/p"]
        got = rows(hrefs, lambda c: U.resolve_href(c, SITE))
        wrong = [(h, g, urljoin(SITE, h)) for h, g in zip(hrefs, got) if g != urljoin(SITE, h)]
        assert not wrong, wrong[:5]

    check()
