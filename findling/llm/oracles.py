"""SQL for DuckDB of the queries that SQL can express; the others are tested by brute force in tests/llm."""

from __future__ import annotations

from findling.llm.sharding import _HEX, _sql_shard

# CRC-32 of UTF-8 bytes, byte by byte over a table of 256 values made by the polynomial's rule.
_CRC = """tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS t)"""
SHARDS = f"""WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents), {_CRC},
a AS MATERIALIZED (SELECT doc_id, (strlen(d.t) + 1)::BIGINT AS size, list_transform(regexp_extract_all(hex(encode(d.t)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes, tab.t AS tab,
  ('0x' || substr(md5(k), 1, {_HEX}))::BIGINT AS h, ({_sql_shard(8)})::INT AS shard, ({_sql_shard(9)})::INT AS grown_shard FROM d, tab)
SELECT doc_id, size, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1)::BIGINT AS slot, grown_shard FROM a"""

SUBSTRINGS = r"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
cov AS MATERIALIZED (SELECT DISTINCT id, unnest(range(i, i + 35)) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
pos AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
own AS (SELECT id, count(cov.p) AS n_removed, array_to_string(list(word ORDER BY p) FILTER (cov.p IS NULL), ' ') AS kept FROM pos LEFT JOIN cov USING (id, p) GROUP BY id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN own USING (id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws, least(10, len({_WORDS})) AS m FROM benchmark WHERE item_id IS NOT NULL),
iw AS MATERIALIZED (SELECT DISTINCT item, m, array_to_string(ws[i : i + m - 1], ' ') AS s FROM (SELECT item, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM b WHERE m > 0)),
dw AS (SELECT id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS s FROM (SELECT id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)),
hit AS MATERIALIZED (SELECT id, i, m, item FROM dw JOIN iw USING (m, s)),
n1 AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY id),
n2 AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN n1 USING (id) LEFT JOIN n2 USING (id)"""

ORACLE_SQL = {"op3_rendezvous_shards": SHARDS, "op7_substring_dedup": SUBSTRINGS, "op9_decontamination": CONTAMINATION}
