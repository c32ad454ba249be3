"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM k),
p AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
q AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM p),
m AS (SELECT r, i, k, item_id FROM q JOIN win USING (k, s)),
h AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

# bytes are pairs of hexadecimal digits
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM p JOIN d USING (r)),
z AS (SELECT r, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM z),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM g) GROUP BY r, n),
e AS (SELECT r, sum(b - a) AS gone, count(*) AS spans FROM s GROUP BY r),
k AS (SELECT r, a, b FROM (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM s) UNION ALL SELECT s.r, max(s.b), max(length(x) // 2) FROM s JOIN d USING (r) GROUP BY s.r),
t AS (SELECT k.r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY k.r)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(t.kept, x))) AS kept_sha256 FROM d LEFT JOIN e USING (r) LEFT JOIN t USING (r)
"""

_U = "(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{s}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
_BEST = lambda n: "list_position([" + ", ".join(f"-ln({_U.format(s=s)})" for s in range(n)) + "], least(" + ", ".join(f"-ln({_U.format(s=s)})" for s in range(n)) + ")) - 1"

# op10: slots of tables that one hash bucket a shard holds; larger ones number bucket after bucket
# crc32: a table of 256 entries from the reversed polynomial, then a byte at a time
SHARD = f"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, length(x) // 2 + 1 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
s AS (SELECT doc_id, size, text_crc32, CAST({_BEST(8)} AS INT) AS shard, CAST({_BEST(9)} AS INT) AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""

ORACLES = {"op7_decontaminate": DECONTAMINATE, "op9_repeats": REPEATS, "op10_shard": SHARD}
