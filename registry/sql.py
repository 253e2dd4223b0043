"""SQL twins of the registered queries, in the dialect of the checking engine.

They are written against the semantics, with that engine's own functions; only
the derivations of the inputs are shared.
"""

from __future__ import annotations

from pickwell.functions import text as X
from pickwell.functions.strings import WHITESPACE
from registry import inputs as I
from registry.queries import ENCODER, LINK_PATHS, PROSE_K, PROSE_LEVELS, PROSE_P, SITE, SPARSE, TITLE_WORDS, TOPK

# ------------------------------------------------------------ expressions

_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)|<template\b[^>]*>.*?(?:</template\s*>|\z)"
)
_ATTRS = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
_TAG = rf"(?s)<[a-zA-Z/!?]{_ATTRS}>"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def visible(x: str) -> str:
    return f"regexp_replace({x}, '{_HIDDEN}', '<!>', 'g')"


def decode(x: str) -> str:
    """The entities that occur, one of them possibly cut off before its semicolon."""
    x = rf"regexp_replace({x}, '&amp([^a-zA-Z0-9.;-]|$)', '&amp;\1', 'g')"
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def text_of(x: str, joiner: str) -> str:
    broken = decode(f"regexp_replace({x}, '{_TAG}', chr(1), 'g')")
    pieces = f"list_transform(string_split({broken}, chr(1)), lambda t: {strip('t')})"
    return f"array_to_string(list_filter({pieces}, lambda t: t <> ''), '{joiner}')"


def heading(m: str) -> str:
    inner = rf"regexp_extract({m}, '(?is)<h[12](?:\s{_ATTRS})?>(.*?)(?:</h[12]\s*>|\z)', 1)"
    return f"nullif({text_of(inner, '')}, '')"


def paragraph(m: str) -> str:
    closers = r"<p[\s>]|</(?:p|article|section|main|div|li|td|th|tr|tbody|table|ul|ol|dl|dt|dd|nav|header|footer|aside|form|fieldset|figure|figcaption|blockquote|pre|details|h[1-6]|center|body|html)\s*>|\z"
    inner = rf"regexp_extract({m}, '(?is)<p(?:\s{_ATTRS})?>(.*?)(?:{closers})', 1)"
    return f"nullif({text_of(inner, ' ')}, '')"


def meta(m: str, key: str, value: str) -> str:
    """Content of the meta tag, its two attributes in either order."""
    tag = rf"regexp_extract({m}, '(?is)<meta\s[^>]*{key}\s*=\s*[\x22'']{value}[\x22''][^>]*>')"
    content = rf"regexp_extract({tag}, '(?is)content=(?:\x22([^\x22]*)\x22)', 1)"
    return f"nullif({strip(decode(content))}, '')"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def first_level(x: str, levels, word: bool = False) -> str:
    test = (lambda w: rf"regexp_matches({x}, '\b{w}\b')") if word else (lambda w: f"contains({x}, '{w}')")
    return "CASE " + " ".join(f"WHEN {test(w)} THEN '{w.capitalize()}'" for w in levels) + " END"


def type_p_first(x: str, p=X.PERSONALITY_CRAWL, k=X.KNOWLEDGE_CRAWL) -> str:
    return f"CASE WHEN {any_of(x, p)} THEN 'P' WHEN {any_of(x, k)} THEN 'K' END"


def type_k_first(x: str, p=X.PERSONALITY_AUGMENT, k=X.KNOWLEDGE_AUGMENT) -> str:
    return f"CASE WHEN {any_of(x, k)} THEN 'K' WHEN {any_of(x, p)} THEN 'P' END"


def num(x: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract({x}, '{pattern}', {group}) AS BIGINT)"


_MIN, _HOUR = r"(minutes|min)\b", r"(hours|hour|hrs|hr)\b"
_D3, _DASH = "([0-9]{1,3})", r"\s*-\s*"


def simple_minutes(low: str) -> str:
    return f"CAST({num(low, _D3 + chr(92) + 's*' + _MIN, 1)} AS INT)"


def full_minutes(low: str, short_hours: bool = False) -> str:
    mr, hr = rf"{_D3}{_DASH}{_D3}\s*{_MIN}", rf"{_D3}{_DASH}{_D3}\s*{_HOUR}"
    m, h = rf"{_D3}\s*{_MIN}", rf"([0-9]{{1,2}})\s*{_HOUR}"

    def factor(pattern: str, group: int) -> str:
        return "60" if short_hours else f"CASE WHEN regexp_extract({low}, '{pattern}', {group}) LIKE 'hour%' THEN 60 ELSE 1 END"

    single = f"{num(low, h, 1)} * 60"
    if not short_hours:
        single = f"CASE WHEN regexp_extract({low}, '{h}', 2) LIKE 'hour%' THEN {single} END"
    return (
        f"CAST(coalesce(round_even(({num(low, mr, 1)} + {num(low, mr, 2)}) / 2, 0), "
        f"round_even(({num(low, hr, 1)} + {num(low, hr, 2)}) * ({factor(hr, 3)}) / 2, 0), "
        f"{num(low, m, 1)}, {single}) AS INT)"
    )


def window_bounds(low: str, short_hours: bool = False) -> tuple[str, str]:
    unit = r"(hour|hr|hours|hrs|minute|min|minutes)\b"
    span, single = rf"([0-9]+){_DASH}([0-9]+)\s*{unit}", rf"([0-9]+)\s*{unit}"
    like = "h%" if short_hours else "%hour%"

    def minutes(pattern: str, group: int, unit_group: int) -> str:
        return f"({num(low, pattern, group)} * CASE WHEN regexp_extract({low}, '{pattern}', {unit_group}) LIKE '{like}' THEN 60 ELSE 1 END)"

    a, b, v = minutes(span, 1, 3), minutes(span, 2, 3), minutes(single, 1, 2)
    return (
        f"CASE WHEN regexp_matches({low}, '{span}') THEN least({a}, {b}) WHEN {v} IS NOT NULL THEN greatest(0, {v} - 15) END",
        f"CASE WHEN regexp_matches({low}, '{span}') THEN greatest({a}, {b}) ELSE {v} + 15 END",
    )


def duration_fit(d: str, lo: str, hi: str) -> str:
    fit = f"1.0::DOUBLE - abs({d}::DOUBLE - ({lo} + {hi})::DOUBLE / 2) / greatest(15.0::DOUBLE, ({hi} - {lo})::DOUBLE / 2)"
    return f"coalesce(greatest(0.0::DOUBLE, {fit}), 0.0::DOUBLE)"


def terms_of(x: str, vocabulary) -> str:
    known = ", ".join(f"'{w}'" for w in vocabulary)
    words = f"list_transform(regexp_extract_all({x}, '[a-zA-Z]+'), lambda w: lower(w))"
    return f"list_filter({words}, lambda w: list_contains([{known}], w))"


def cut_suffix(u: str) -> str:
    return rf"regexp_replace(regexp_replace({u}, '[?#].*$', ''), '(/[^/;]*);[^/]*$', '\1')"


def norm_url(u: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({strip(u)}), '[\t\r\n]', '', 'g'), '^https?://(www\.)?', '')"
    return f"coalesce(regexp_replace({cut_suffix(bare)}, '/+$', ''), '')"


def url_path(u: str) -> str:
    bare = rf"regexp_replace({strip(u)}, '[\t\r\n]', '', 'g')"
    bare = f"regexp_replace(regexp_replace({bare}, '^[a-zA-Z][a-zA-Z0-9+.-]*:', ''), '^//[^/?#]*', '')"
    return f"trim({cut_suffix(bare)}, '/')"


def slug(u: str) -> str:
    return f"trim(regexp_replace(lower({url_path(u)}), '[^a-z0-9]+', '-', 'g'), '-')"


def url_title(u: str, default: str = "Untitled") -> str:
    words = rf"regexp_extract_all(lower(replace({url_path(u)}, '-', ' ')), '\pL+|\PL+')"
    titled = f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), '')"
    return f"coalesce(nullif({titled}, ''), '{default}')"


DOC = (
    "'Assessment Name: ' || coalesce(title, '') || '. Category: ' || coalesce(category, '') || '. Type: ' || coalesce(test_type, '')"
    " || '. Level: ' || coalesce(level, '') || '. Duration: ' || coalesce(CAST(duration_min AS VARCHAR), '')"
    " || ' minutes. Language: ' || coalesce(language, '') || '. Tags: ' || coalesce(tags, '')"
    " || '. Description: ' || coalesce(description, '') || '. '"
)

# ------------------------------------------------------------ relations

CATALOG = I.derived_sql(I.CATALOG)
PAGES = I.derived_sql(I.PAGES)
TEXTS = f"SELECT *, lower(text) AS low FROM ({I.derived_sql(I.TEXTS)})"
PAIRS = I.derived_sql(I.PAIRS)
SPELLINGS = r"""SELECT page_id, CAST(form AS INT) AS form, url FROM (SELECT page_id, unnest(range(5)) AS form, unnest([url,
  ' ' || chr(9) || upper(url) || chr(10), url || '/a-b/c_d;v=1?x=/y/#z', regexp_replace(url, '^https?://', ''),
  regexp_replace(url, '^https?://[^/]+', '') || '//']) AS url FROM pages)"""
WISHES = f"""SELECT DISTINCT {strip('query')} AS query, greatest(1, least(10, coalesce(nullif(topk, 0), 10))) AS topk
  FROM ({I.derived_sql(I.QUERIES, group=I.QUERY_KEYS)})"""


def encoded(source: str, key: str, text: str, dim: int = ENCODER.dim) -> str:
    """``key, bucket, weight`` rows of the hashed texts, weights in single precision."""
    words = rf"SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\pL\pN]+')) AS w FROM ({source})"
    counts = f"SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % {dim} AS INT) AS bucket, count(*) AS c FROM ({words}) GROUP BY ALL"
    return f"SELECT {key}, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS weight FROM ({counts})"


def sparse_topk(queries: str, items: str, k: int) -> str:
    """``qid, item_id, similarity, rank`` of two encoded relations, unrelated pairs included as 0."""
    return f"""WITH qv AS MATERIALIZED ({queries}), iv AS MATERIALIZED ({items}),
  sims AS (SELECT qid, item_id, sum(qv.weight::DOUBLE * iv.weight::DOUBLE) AS s FROM qv JOIN iv USING (bucket) GROUP BY ALL),
  pairs AS (SELECT q.qid, i.item_id, round(coalesce(s, 0), 9) AS similarity
    FROM (SELECT DISTINCT qid FROM qv) q CROSS JOIN (SELECT DISTINCT item_id FROM iv) i LEFT JOIN sims USING (qid, item_id))
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, item_id) AS rank FROM pairs) WHERE rank <= {k}"""


CATALOG_VECTORS = encoded(f"SELECT item_id, {DOC} AS doc FROM ({CATALOG})", "item_id", "doc")


def wish_topk(k: int, wishes: str = WISHES) -> str:
    return sparse_topk(encoded(f"SELECT DISTINCT query AS qid, query FROM ({wishes})", "qid", "query"), CATALOG_VECTORS, k)


def recommended(wishes: str = WISHES) -> str:
    lo, hi = window_bounds("lower(query)")
    text = "lower(coalesce(title,'') || ' ' || coalesce(description,'') || ' ' || coalesce(tags,'') || ' ' || coalesce(category,''))"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, topk ORDER BY score DESC, sim DESC, item_id) AS rnk FROM (
    SELECT *, round(0.85::DOUBLE * sim + 0.15::DOUBLE * duration_score, 9) AS score FROM (
      SELECT *, {duration_fit('duration_min', 'lo', 'hi')} AS duration_score FROM (
        SELECT w.query, w.topk, h.similarity AS sim, c.*, {lo.replace('query', 'w.query')} AS lo, {hi.replace('query', 'w.query')} AS hi
        FROM ({wishes}) w JOIN ({wish_topk(40, wishes)}) h ON h.qid = w.query AND h.rank <= 4 * w.topk JOIN ({CATALOG}) c USING (item_id)
        WHERE len({terms_of('w.query', TITLE_WORDS)}) = 0 OR len(list_filter({terms_of('w.query', TITLE_WORDS)}, lambda t: contains({text}, t))) > 0)))) WHERE rnk <= topk"""


def page_fields(variant: str, source: str = PAGES) -> str:
    m, low = "m", "low"
    crumb = (
        f"nullif(array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(m, "
        rf"'(?is)<nav class=\x22[^\x22]*\bbreadcrumb\x22>.*?</nav>'), '(?is)<a\s[^>]*>.*?</a>'), lambda a: {text_of('a', '')}), lambda t: t <> ''), ' > '), '')"
    )
    tags = (
        rf"nullif(array_to_string(list_filter(list_transform(regexp_extract_all(m, '(?is)<(?:span|i) class=(?:\x22tag big\x22|badge)>.*?</(?:span|i)>'),"
        f" lambda a: {text_of('a', '')}), lambda t: t <> ''), ';'), '')"
    )
    if variant == "crawl":
        fields = f"""{heading(m)} AS title, coalesce({meta(m, 'name', 'description')}, {paragraph(m)}) AS description,
          {crumb} AS category, {type_p_first(low)} AS test_type, {first_level(low, X.LEVELS_CRAWL)} AS level,
          {simple_minutes(low)} AS duration_min, CASE WHEN contains(low, 'english') THEN 'English' END AS language, {tags} AS tags"""
    else:
        fields = f"""coalesce({heading(m)}, {meta(m, 'property', 'og:title')}) AS title,
          coalesce({meta(m, 'name', 'description')}, {meta(m, 'property', 'og:description')}, {paragraph(m)}) AS description,
          '' AS category, {type_k_first(low)} AS test_type, {first_level(low, X.LEVELS_AUGMENT, True)} AS level,
          {full_minutes(low)} AS duration_min, CASE WHEN contains(low, 'english') THEN 'English' END AS language, '' AS tags"""
    return f"""SELECT page_id, url, {fields} FROM (SELECT *, lower({text_of('m', ' ')}) AS low FROM (
      SELECT page_id, url, {visible('html')} AS m FROM ({source})))"""


BUNDLES = X.BUNDLE_MARKS


def built_catalog(source: str = PAGES) -> str:
    return f"""SELECT {slug('url')} AS assessment_id, title, url, description, category, test_type, level, duration_min, language, tags
      FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM ({page_fields('crawl', source)})
        WHERE title IS NOT NULL AND NOT {any_of("lower(coalesce(title, ''))", BUNDLES)}) WHERE rn = 1"""


def links(source: str, paths) -> str:
    """Absolute URLs of the link forms that occur in the source."""
    href = rf"""{decode(strip(r"regexp_extract(a, '(?is)^<a\s[^>]*?href\s*=\s*[\x22'']([^\x22'']*)[\x22'']', 1)"))}"""
    absolute = f"""CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '//%' THEN 'https:' || href
      WHEN href LIKE '/%' THEN '{SITE}' || href ELSE '{SITE}/' || replace(replace(href, '/./', '/'), '/b/..', '') END"""
    return f"""SELECT page_id, CAST(pos AS INT) AS pos, title, url FROM (
      SELECT page_id, pos, {text_of('a', '')} AS title, {absolute} AS url FROM (SELECT *, {href} AS href FROM (
        SELECT page_id, unnest(a) AS a, generate_subscripts(a, 1) - 1 AS pos FROM (
          SELECT page_id, regexp_extract_all({visible('html')}, '(?is)<a\\s[^>]*>.*?</a>') AS a FROM ({source})))) WHERE href <> '')
      WHERE {any_of('url', paths)} AND length(title) >= 3"""


PRODUCT = ["/products/"]
KNOWN = built_catalog()
CATALOG_COLS = "assessment_id, title, url, description, category, test_type, level, duration_min, language, tags"
NEEDED = f"SELECT url FROM ({PAGES}) WHERE {norm_url('url')} NOT IN (SELECT {norm_url('url')} FROM ({KNOWN}))"
AUGMENTED = f"""SELECT coalesce(nullif({slug('url')}, ''), 'item') AS assessment_id, title, url, coalesce(description, title) AS description,
  category, test_type, level, duration_min, language, tags FROM (SELECT * REPLACE (coalesce(title, {url_title('url')}) AS title)
    FROM ({page_fields('augment', f'SELECT * FROM ({PAGES}) WHERE url IN ({NEEDED})')}))"""

_TRUTH = f"SELECT query, {norm_url('relevant_url')} AS norm FROM ({PAIRS})"
RECALL = f"""SELECT t.query, t.n_truth, coalesce(h.hits, 0) / greatest(1, t.n_distinct) AS recall
  FROM (SELECT query, count(*) AS n_truth, count(DISTINCT norm) AS n_distinct FROM ({_TRUTH}) GROUP BY 1) t
  LEFT JOIN (SELECT p.qid AS query, count(*) AS hits FROM (SELECT qid, {norm_url('url')} AS norm
      FROM ({sparse_topk(encoded(f'SELECT DISTINCT query AS qid, query FROM ({PAIRS})', 'qid', 'query'), CATALOG_VECTORS, TOPK)}) JOIN ({CATALOG}) USING (item_id)) p
    JOIN (SELECT DISTINCT query, norm FROM ({_TRUTH})) k ON k.query = p.qid AND k.norm = p.norm GROUP BY 1) h USING (query)"""

VECTOR_TOPK = f"""SELECT qid, item_id, CAST(rank AS INT) AS rank, s AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM (
    SELECT a.vec_id AS qid, b.vec_id AS item_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
    FROM embeddings a CROSS JOIN embeddings b)) WHERE rank <= {TOPK}"""

ODD_ITEMS = f"""SELECT * REPLACE (CASE WHEN item_id % 3 = 0 THEN 'The "' || title || '",' || chr(10) || 'now; a\\b' END AS description) FROM ({CATALOG})"""

CELLS = "SELECT {key}, bucket, round(weight::DOUBLE, 9) AS weight FROM ({source})"
_lo, _hi = window_bounds("low")
_lo_hr, _hi_hr = window_bounds("low", True)

SQL: dict[str, str] = {
    "vector_topk": VECTOR_TOPK,
    "vector_topk_blocks": VECTOR_TOPK,
    "vector_topk_runs": VECTOR_TOPK,
    "catalog_topk_runs": f"SELECT qid AS query, item_id, CAST(rank AS INT) AS rank, similarity FROM ({wish_topk(TOPK)})",
    "vector_normalize": """SELECT vec_id, round(n, 9) AS norm, CAST(pos - 1 AS INT) AS pos, round(CASE WHEN n > 0 THEN x / n ELSE 0 END, 9) AS x
        FROM (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (
          SELECT *, sqrt(list_inner_product(v, v)) AS n FROM (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label) AS v FROM embeddings)))""",
    "vector_dims": "\nUNION ALL ".join(
        f"SELECT '{side}' AS side, CAST(min(len(embedding)) AS INT) AS min_dim, CAST(max(len(embedding)) AS INT) AS max_dim, count(embedding) AS rows FROM embeddings"
        for side in ("queries", "items")
    ),
    "vector_inner_product": "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 9) AS product FROM embeddings",
    "url_normalize": f"SELECT page_id, form, {norm_url('url')} AS norm FROM ({SPELLINGS})",
    "url_slug": f"SELECT page_id, form, {slug('url')} AS slug, coalesce(nullif({slug('url')}, ''), 'item') AS slug_or_item FROM ({SPELLINGS})",
    "url_title_fallback": f"SELECT page_id, form, {url_title('url')} AS title FROM ({SPELLINGS})",
    "link_extract": f"SELECT *, 'pages' AS source FROM ({links('SELECT * FROM pages', LINK_PATHS)}) UNION ALL SELECT *, 'part' FROM ({links(PAGES, PRODUCT)})",
    "link_dedup": f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM ({links('SELECT * FROM pages', LINK_PATHS)})) WHERE rn = 1",
    "page_title": f"SELECT page_id, {heading(visible('html'))} AS title FROM pages",
    "page_description": f"SELECT page_id, coalesce({meta('m', 'name', 'description')}, {paragraph('m')}) AS description FROM (SELECT page_id, {visible('html')} AS m FROM pages)",
    "page_body_text": f"SELECT page_id, lower({text_of(visible('html'), ' ')}) AS body FROM pages",
    "page_tags": rf"""SELECT page_id, nullif(array_to_string(list_transform(regexp_extract_all({visible('html')}, '(?s)<div class="ad">.*?</div>'), lambda d: {text_of('d', '')}), ';'), '') AS tags FROM pages""",
    "page_fields_crawl": page_fields("crawl"),
    "page_fields_augment": page_fields("augment"),
    "page_rejects": f"""SELECT page_id, url, reason FROM (SELECT page_id, url, CASE WHEN html IS NULL THEN 'no html' WHEN title IS NULL THEN 'no title'
        WHEN {any_of('lower(title)', BUNDLES)} THEN 'bundle' END AS reason FROM (SELECT *, {heading(visible('html'))} AS title FROM ({PAGES}))) WHERE reason IS NOT NULL""",
    "pages_to_catalog": built_catalog("SELECT * FROM pages"),
    "vocabulary_found": """WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents),
        texts AS (SELECT item_id, lower(text) AS t, ' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ' AS padded FROM benchmark),
        found AS (SELECT item_id, string_agg(w, ' ' ORDER BY w) AS inside, string_agg(w, ' ' ORDER BY w) FILTER (contains(padded, ' ' || w || ' ')) AS whole
          FROM texts JOIN words ON contains(t, w) GROUP BY 1)
        SELECT item_id, coalesce(inside, '') AS inside, coalesce(whole, '') AS whole FROM benchmark LEFT JOIN found USING (item_id)""",
    "vocabulary_terms": """WITH known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
        lists AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+') AS t FROM documents),
        found AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS terms
          FROM (SELECT r, lower(unnest(t)) AS w, generate_subscripts(t, 1) AS i FROM lists) JOIN known USING (w) GROUP BY r)
        SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(terms, '') AS terms FROM lists LEFT JOIN found USING (r)""",
    "pages_split": f"""SELECT 'item' AS side, url, title AS note FROM ({KNOWN}) UNION ALL SELECT 'reject', url, CASE WHEN html IS NULL THEN 'no html'
        WHEN title IS NULL THEN 'no title' ELSE 'bundle' END FROM (SELECT *, {heading(visible('html'))} AS title FROM ({PAGES}))
        WHERE html IS NULL OR title IS NULL OR {any_of('lower(title)', BUNDLES)}""",
    "pages_upsert": KNOWN,
    "index_upsert": f"""SELECT * FROM ({CELLS.format(key='item_id', source=CATALOG_VECTORS)})
        JOIN (SELECT item_id, title, NOT (item_id % 10 = 3 OR item_id % 17 = 0) AS reused FROM ({CATALOG})) USING (item_id)""",
    "crawl_catalog": f"""SELECT {slug('url')} AS assessment_id, title, url, description, category, test_type, level, duration_min, language, tags FROM (
        SELECT f.* REPLACE (coalesce(f.title, l.title) AS title) FROM ({page_fields('crawl')}) f
        JOIN (SELECT url, arg_min(title, (page_id, pos)) AS title FROM ({links(PAGES, PRODUCT)}) GROUP BY url) l USING (url))
        WHERE NOT {any_of('lower(title)', BUNDLES)}""",
    "classify_type_p_first": f"SELECT item_id, {type_p_first('low')} AS test_type FROM ({TEXTS})",
    "classify_type_k_first": f"SELECT item_id, {type_k_first('low')} AS test_type FROM ({TEXTS})",
    "classify_language": f"SELECT item_id, CASE WHEN low LIKE '%english%' THEN 'English' END AS language FROM ({TEXTS})",
    "classify_level_substring": f"SELECT item_id, {first_level('low', X.LEVELS_CRAWL)} AS level FROM ({TEXTS})",
    "classify_level_word": f"SELECT item_id, {first_level('low', X.LEVELS_AUGMENT, True)} AS level FROM ({TEXTS})",
    "classify_documents": f"""SELECT doc_id, {type_p_first('low', PROSE_P, PROSE_K)} AS p_first, {type_k_first('low', PROSE_P, PROSE_K)} AS k_first,
        {first_level('low', PROSE_LEVELS)} AS level_substring,
        CASE {' '.join(f"WHEN regexp_matches(low, '(^|[^{chr(92)}pL{chr(92)}pN_]){w}([^{chr(92)}pL{chr(92)}pN_]|$)') THEN '{w.capitalize()}'" for w in PROSE_LEVELS)} END AS level_word,
        CASE WHEN contains(low, 'und') THEN 'German' END AS language FROM (SELECT doc_id, lower(text) AS low FROM documents)""",
    "duration_simple": f"SELECT item_id, {simple_minutes('low')} AS minutes FROM ({TEXTS})",
    "duration_full": f"SELECT item_id, {full_minutes('low')} AS minutes, {full_minutes('low', True)} AS minutes_with_hr FROM ({TEXTS})",
    "duration_window": f"SELECT item_id, {_lo} AS lo, {_hi} AS hi, {_lo_hr} AS lo_with_hr, {_hi_hr} AS hi_with_hr FROM ({TEXTS})",
    "exclude_bundles": f"SELECT page_id, title FROM (SELECT page_id, {heading(visible('html'))} AS title FROM ({PAGES})) WHERE title IS NOT NULL AND NOT {any_of('lower(title)', BUNDLES)}",
    "strong_terms": f"SELECT item_id, array_to_string({terms_of('text', X.STRONG_TERMS)}, ' ') AS terms, array_to_string({terms_of('text', TITLE_WORDS)}, ' ') AS title_terms FROM ({TEXTS})",
    "missing_labelled_urls": f"""SELECT relevant_url AS url, count(*) AS mentions FROM ({PAIRS})
        WHERE {norm_url('relevant_url')} NOT IN (SELECT {norm_url('url')} FROM ({KNOWN})) GROUP BY 1""",
    "augment_rows": AUGMENTED,
    "catalog_merge": f"SELECT {CATALOG_COLS} FROM ({KNOWN}) UNION ALL SELECT {CATALOG_COLS} FROM ({AUGMENTED})",
    "catalog_dedup": r"SELECT min(page_id) AS page_id, regexp_extract(url, '^[^?#]*/') AS url FROM pages GROUP BY 2",
    "catalog_conform": """SELECT p_partkey, NULL::VARCHAR AS assessment_id, p_name AS title, NULL::VARCHAR AS url, NULL::VARCHAR AS description, NULL::VARCHAR AS category,
        NULL::VARCHAR AS test_type, NULL::VARCHAR AS level, p_size AS duration_min, NULL::VARCHAR AS language, NULL::VARCHAR AS tags FROM part""",
    "catalog_write_counts": f"""SELECT 'pages' AS metric, count(*) AS n FROM pages UNION ALL SELECT unnest(['items', 'with_description', 'with_type', 'with_duration']),
        unnest([count(*), count(description), count(test_type), count(duration_min)]) FROM ({built_catalog("SELECT * FROM pages")})""",
    "catalog_counts": f"""SELECT 'pages' AS metric, count(*) AS n FROM part UNION ALL SELECT unnest(['items', 'with_description', 'with_type', 'with_duration']),
        unnest([count(*), count(description), count(test_type), count(duration_min)]) FROM ({KNOWN})""",
    "build_doc": f"SELECT item_id, {DOC} AS doc FROM ({CATALOG})",
    "hash_encode": CELLS.format(key="doc_id", source=encoded("SELECT * FROM documents", "doc_id", "text")),
    "build_index": f"SELECT * FROM ({CELLS.format(key='item_id', source=CATALOG_VECTORS)}) JOIN (SELECT item_id, title, url, duration_min, '' AS language FROM ({CATALOG})) USING (item_id)",
    "index_ids": f"""SELECT url AS item_id, title, duration_min FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY item_id) AS n
        FROM ({I.derived_sql(I.LOOSE_URLS)})) WHERE n = 1 AND trim(url) <> ''""",
    "text_topk": f"""SELECT qid, item_id, CAST(rank AS INT) AS rank, similarity FROM ({sparse_topk(
        encoded('SELECT item_id AS qid, text FROM benchmark', 'qid', 'text'), encoded('SELECT doc_id AS item_id, text FROM documents', 'item_id', 'text'), TOPK)})""",
    "sparse_encode": CELLS.format(key="doc_id", source=encoded("SELECT * FROM documents", "doc_id", "text", SPARSE.dim)),
    "sparse_topk": f"""SELECT qid, item_id, CAST(rank AS INT) AS rank, similarity FROM ({sparse_topk(
        encoded('SELECT item_id AS qid, text FROM benchmark', 'qid', 'text', SPARSE.dim),
        encoded('SELECT doc_id AS item_id, text FROM documents', 'item_id', 'text', SPARSE.dim), TOPK)})""",
    "clamp_topk": "SELECT p_partkey, CAST(CASE WHEN p_size IN (20, 27) THEN 10 WHEN p_size < 20 THEN 1 ELSE least(10, p_size - 20) END AS INT) AS topk FROM part",
    "clean_queries": f"""SELECT sha256(topk || chr(1) || query) AS qid, query, topk, count(*) AS copies FROM (SELECT {strip('query')} AS query,
        CAST(greatest(1, least(10, coalesce(nullif(topk, 0), 10))) AS INT) AS topk FROM ({I.derived_sql(I.LINES)})) WHERE query <> '' GROUP BY query, topk""",
    "recommend_rejects": f"""SELECT item_id, query, CASE WHEN query IS NULL THEN 'no query' ELSE 'empty query' END AS reason
        FROM ({I.derived_sql(I.LINES)}) WHERE query IS NULL OR {strip('query')} = ''""",
    "topk_with_meta": f"""SELECT w.query, CAST(h.rank AS INT) AS rank, h.similarity, c.item_id, c.title, c.url, c.category, c.tags, c.duration_min
        FROM ({WISHES}) w JOIN ({wish_topk(5)}) h ON h.qid = w.query JOIN ({CATALOG}) c USING (item_id)""",
    "keyword_gate": f"""SELECT w.query, CAST(h.rank AS INT) AS rank, c.item_id, c.title
        FROM ({WISHES}) w JOIN ({wish_topk(TOPK)}) h ON h.qid = w.query JOIN ({CATALOG}) c USING (item_id)
        WHERE len(list_filter({terms_of('w.query', TITLE_WORDS)}, lambda t: contains(lower(concat_ws(' ', c.title, c.description, c.tags, c.category)), t))) > 0
           OR len({terms_of('w.query', TITLE_WORDS)}) = 0""",
    "duration_score": f"""SELECT item_id, round({duration_fit('nullif(p_size, 13)', 'lo', 'hi')}, 9) AS duration_score
        FROM (SELECT item_id, {_lo} AS lo, {_hi} AS hi FROM ({TEXTS})) JOIN part ON p_partkey = item_id""",
    "recommend": f"""SELECT query, CAST(rnk AS INT) AS rank, item_id, title, url, test_type, level, language, duration_min, description,
        sim AS similarity, round(duration_score, 9) AS duration_score, score FROM ({recommended()})""",
    "result_view": f"""SELECT item_id, CAST(rnk AS INT) AS rank, title AS "Assessment", '[link](' || url || ')' AS "URL", test_type AS "Type", level AS "Level",
        language AS "Language", duration_min AS "Duration (min)", sim AS "Similarity", description AS "Description" FROM ({recommended()})""",
    "response_nested": f"""SELECT w.query, CAST(coalesce(n, 0) AS INT) AS count, coalesce(r, '') AS recommendations FROM ({WISHES}) w LEFT JOIN (
        SELECT query, topk, count(*) AS n, string_agg(concat_ws('|', title, url, test_type, level, language, duration_min, CAST(round(sim * 1e9) AS BIGINT), description), ';' ORDER BY rnk) AS r FROM ({recommended()}) GROUP BY 1, 2) USING (query, topk)""",
    "batch_export": f"""WITH lines AS (SELECT p_name || ' ' || lower(p_type) AS query FROM part),
        hits AS ({sparse_topk(encoded('SELECT DISTINCT query AS qid, query FROM lines', 'qid', 'query'), CATALOG_VECTORS, TOPK)})
        SELECT query AS "Query", url AS "Assessment_url" FROM lines JOIN hits ON qid = query JOIN ({CATALOG}) USING (item_id)""",
    "recommend_stream": f"""SELECT query, CAST(rnk AS INT) AS rank, title AS assessment_name, url AS assessment_url, sim AS similarity
        FROM ({recommended("SELECT DISTINCT p_name || ' ' || lower(p_type) AS query, 3 AS topk FROM part")})""",
    "answer_stream": f"""SELECT query, CAST(batch AS INT) AS batch, CAST(1000 AS BIGINT) AS answered_at, CAST(rnk AS INT) AS rank, url AS assessment_url, sim AS similarity
        FROM ({recommended("SELECT DISTINCT p_name || ' ' || lower(p_type) AS query, 3 AS topk FROM part")}), (VALUES (0), (1)) b(batch)""",
    "truth_sets": f"SELECT query, count(*) AS n_truth, count(DISTINCT norm) AS n_distinct FROM ({_TRUTH}) GROUP BY 1",
    "recall_at_k": f"SELECT query, n_truth, round(recall, 9) AS recall FROM ({RECALL})",
    "mean_recall": f"SELECT count(*) AS queries, round(avg(recall), 9) AS mean_recall FROM ({RECALL})",
    "stored_catalog": f"SELECT {CATALOG_COLS} FROM ({ODD_ITEMS})",
    "stored_metadata": f"SELECT {CATALOG_COLS} FROM ({ODD_ITEMS})",
    "stored_pairs": PAIRS,
    "stored_queries": "SELECT text AS query FROM conversations",
    "stored_index": f"SELECT * FROM ({CELLS.format(key='item_id', source=CATALOG_VECTORS)}) JOIN (SELECT item_id, title FROM ({CATALOG})) USING (item_id)",
    "stored_export": """SELECT left(html, 200) AS "Query", url AS "Assessment_url" FROM pages""",
    "stored_view": f"""SELECT title AS "Assessment", '[link](' || url || ')' AS "URL", test_type AS "Type", level AS "Level", language AS "Language",
        CAST(duration_min AS VARCHAR) AS "Duration (min)", description AS "Description" FROM ({ODD_ITEMS})""",
    "stored_merge": f"SELECT {CATALOG_COLS}, true AS wrote, false AS wrote_again FROM ({ODD_ITEMS})",
}
