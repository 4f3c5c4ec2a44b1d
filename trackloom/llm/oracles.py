"""SQL for DuckDB that gives the rows of those queries that SQL can express; written from the definitions, not from the methods."""

from __future__ import annotations

from trackloom.llm.license_scan import PHRASES, TEMPLATES, template_tokens

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("UPPER", UPPER).replace("LOWER", LOWER)

EXACT = r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)"""

#: Byte strings are runs of hexadecimal digits; every string of 50 bytes with the smallest document that holds it.
SUBSTRINGS = """
    WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
    n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
    w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS s FROM n, unnest(range(greatest(n - 49, 0))) AS r(p)),
    m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
    r AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE first < doc_id),
    i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS opens FROM r),
    g AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM i),
    s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
    t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY doc_id),
    k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS upto, k FROM s UNION ALL SELECT doc_id, max(b), NULL, max(k) + 1 FROM s GROUP BY doc_id),
    kept AS (SELECT k.doc_id, string_agg(CASE WHEN upto IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (upto - f)) END, '' ORDER BY k.k) AS h FROM k JOIN n ON n.doc_id = k.doc_id GROUP BY k.doc_id)
    SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
    FROM n LEFT JOIN t ON t.doc_id = n.doc_id LEFT JOIN kept ON kept.doc_id = n.doc_id"""

NEAR = r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x FROM d, unnest(range(1, greatest(len(w), 2))) AS r(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    c AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id),
    m AS (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, d.doc_id = coalesce(m.root, d.doc_id) AS kept
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""".replace("UPPER", UPPER).replace("LOWER", LOWER)


def licenses() -> str:
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', [{', '.join(repr(t) for t in template_tokens(text))}])" for label, text in TEMPLATES)
    return f"""
    WITH phrases(p, label) AS (VALUES {phrases}), templates(label, tokens) AS (VALUES {templates}),
    d AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
    places AS (SELECT doc_id, i - 1 AS pos, label FROM d, phrases, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] = p[1] AND list_slice(w, i, i + len(p) - 1) = p),
    base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
    lines AS (SELECT doc_id, list_distinct({WORDS.replace("coalesce(text, '')", "line")}) AS w FROM d, unnest(string_split(coalesce(text, ''), chr(10))) AS r(line)),
    hits AS (SELECT doc_id, label, len(list_intersect(w, tokens)) / CAST(len(tokens) AS DOUBLE) AS score FROM lines, templates WHERE len(list_intersect(w, tokens)) >= 0.8 * len(tokens) - 1e-9),
    every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, score FROM hits UNION ALL SELECT doc_id, label, 1e0 FROM places) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(every.score, 0e0) AS score
    FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN every ON every.doc_id = d.doc_id"""


CONTAMINATION = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS x FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0),
    z AS (SELECT DISTINCT n FROM i),
    o AS (SELECT doc_id, k, z.n, array_to_string(list_slice(w, k, k + z.n - 1), ' ') AS x FROM d, z, unnest(range(1, greatest(len(w) - z.n + 1, 0) + 1)) AS r(k)),
    h AS (SELECT doc_id, k, o.n, item_id FROM o JOIN i ON i.x = o.x AND i.n = o.n),
    c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(k, k + n)) AS r(q) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
