"""The operators' results as SQL, for those whose contract SQL can state."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM w, generate_series(1, greatest(1, len(words) - 4)) t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT doc_id, b FROM reach JOIN link ON other = a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) // 2 - 48 AS BIGINT))) AS i FROM d)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i, lag(i) OVER p AS before, lead(i) OVER p AS after FROM win JOIN low USING (s) WHERE doc_id > m WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
gone AS (SELECT doc_id, sum(least(50, coalesce(after - i, 50))) AS n, count(*) FILTER (before IS NULL OR i - before > 50) AS spans, min(i) AS first,
  string_agg(CASE WHEN after IS NULL THEN substr(h, 2 * i + 99) WHEN after > i + 50 THEN substr(h, 2 * i + 99, 2 * (after - i - 50)) ELSE '' END, '' ORDER BY i) AS rest FROM hit JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE substr(h, 1, CAST(2 * first - 2 AS BIGINT)) || rest END)) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)"""

SUBSTRING_DEDUP = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM win JOIN again USING (s)),
gone AS (SELECT doc_id, sum(least(35, coalesce(after - i, 35))) AS n, words[1:min(i) - 1] AS head, flatten(list(CASE WHEN after IS NULL THEN words[i + 35:] WHEN after > i + 35 THEN words[i + 35:after - 1] ELSE [] END ORDER BY i)) AS rest FROM hit JOIN w USING (doc_id) GROUP BY doc_id, words)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE list_concat(head, rest) END, ' ')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id)"""

_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH b AS (SELECT item_id, {_WORDS} AS words FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(13, len(words)) AS n, array_to_string(words[i:i + 12], ' ') AS s FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 11))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
win AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)),
found AS (SELECT doc_id, i, win.n, item FROM win JOIN p ON win.s = p.s AND win.n = p.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS listed FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
