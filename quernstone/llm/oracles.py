"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, list_slice(w, p, p + least(len(w), 13) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT doc_id, p, size, list_slice(w, p, p + size - 1) AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM doc, sizes WHERE len(w) >= size)),
hit AS (SELECT d.doc_id, d.p, d.size, i.item_id FROM doc_window d JOIN item_window i ON d.size = i.size AND d.win = i.win),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + 4) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT doc.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, least(doc.doc_id, min(other)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY doc.doc_id, size.n
"""

OP9 = r"""
WITH line AS (
  SELECT doc_id, p, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents)),
often AS (SELECT key, max(doc_id) AS last_doc FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, p, l, often.key IS NOT NULL AND doc_id <> last_doc AS gone FROM line LEFT JOIN often USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_KINDS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
]
_CUTS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, {group} AS grp, {least} AS least, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', {group}) AS g FROM doc"
    for k, (kind, p, group, least) in enumerate((kind, p.replace("'", "''"), g, n) for kind, p, g, n in _KINDS)
)
OP5 = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({_CUTS}),
match AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM cut WHERE len(list_filter(g, lambda x: length(x) >= least)) > 0),
span AS (
  SELECT doc_id, k, kind, list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(f[1:i], lambda x: length(x))) AS stop, length(f[i]) AS n
  FROM match WHERE length(g[i]) >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || (stop - n)::BIGINT::VARCHAR || ':' || stop::BIGINT::VARCHAR, ',' ORDER BY stop - n, k) AS spans
  FROM span GROUP BY doc_id)
SELECT doc.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN listed USING (doc_id)
"""

ORACLES = {"op2_decontaminate": OP2, "op5_secret_scan": OP5, "op6_ngram_jaccard": OP6, "op9_line_dedup": OP9}
