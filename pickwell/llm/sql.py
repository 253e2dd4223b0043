"""The corpus queries that SQL can express, as DuckDB SQL.

Trained models (1, 3, 10), approximate quantiles (5), a hash that DuckDB lacks (7, 12)
and piece ids (8) are not among them; tests hold those against brute force.
"""

from __future__ import annotations

from pickwell.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# every control string gets one backslash, and so does every backslash
_MARKS = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>"
_TURNS = """SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'"""

_OK = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KINDS = list(licenses.KINDS)
_RULES = ", ".join(
    f"({r.number}, '{r.lead}', '{r.label}', {_KINDS.index(r.kind)}, {licenses.KINDS[r.kind]}, {r.base}, '{licenses.bounded(r.pattern)}')"
    for r in licenses.RULES
)

SQL: dict[str, str] = {
    "op2_chat_format": f"""SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
        CAST(sum(9 + length(role) + length(text) + len(regexp_extract_all(text, '{_MARKS}'))
          + len(regexp_extract_all(role, '\n|{_MARKS}'))) AS BIGINT) AS formatted_chars
        FROM ({_TURNS}) GROUP BY conv_id""",
    "op4_ngram_jaccard": rf"""WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
          FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        links AS (
          SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y
            ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) o
          JOIN sizes m ON m.doc_id = o.a JOIN sizes n ON n.doc_id = o.b WHERE 100 * o.o >= 75 * (m.n + n.n - o.o)),
        reach(doc_id, other) AS (
          SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)""",
    "op6_exact_topk": f"""WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings WHERE {_OK}),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5""",
    "op9_embedding_dedup": f"""WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE {_OK} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
        reach(vec_id, other) AS (
          SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
        LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)""",
    "op11_lexical_search": rf"""WITH terms AS (
          SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents),
        tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(t) AS t FROM terms) GROUP BY ALL),
        totals AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM terms WHERE len(t) > 0),
        weights AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
          FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals),
        lengths AS (SELECT d, doc_id, 50 + (50 * len(t) * big_n) // big_l AS m FROM terms, totals WHERE len(t) > 0),
        items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
        scores AS (
          SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
          FROM items JOIN tf USING (t) JOIN weights USING (t) JOIN lengths USING (d) GROUP BY ALL),
        places AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
        SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM places WHERE place <= 50""",
    "op13_license_scan": rf"""WITH words AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{licenses.LOWER_WORD}') AS w FROM documents),
        rules(number, lead, label, kind, sure, base, pattern) AS (VALUES {_RULES}),
        places AS (SELECT r, word, start FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS start FROM words)
          WHERE word IN (SELECT lead FROM rules)),
        windows AS (SELECT r, word, start, array_to_string(list_slice(w, start + 1, start + {licenses.LONGEST}), ' ') AS near
          FROM places JOIN words USING (r)),
        matches AS (SELECT *, start + length(m) - length(replace(m, ' ', '')) + 1 AS stop FROM (
          SELECT r, start, number, label, kind, sure, base, regexp_extract(near, pattern, 1) AS m FROM windows JOIN rules ON lead = word) WHERE m <> ''),
        found AS (SELECT * FROM matches d WHERE base OR NOT EXISTS (
          SELECT 1 FROM matches e WHERE e.r = d.r AND NOT e.base AND e.start <= d.start AND e.stop >= d.stop
            AND (e.kind, e.start - e.stop, e.start, e.number) < (d.kind, d.start - d.stop, d.start, d.number))),
        of_text AS (
          SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score FROM found GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
          coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM words LEFT JOIN of_text USING (r)""",
}
