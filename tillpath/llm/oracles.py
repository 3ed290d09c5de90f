"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS p
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY p ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY p) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY p ORDER BY n DESC, doc_id) AS kept,
       sha256(p) AS text_sha256
FROM t
"""

# crc32 goes byte by byte through a table of 256 remainders made from the polynomial by rule.
OP10 = r"""
WITH RECURSIVE bits(i, step, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END
  FROM bits WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE step = 8),
jumps(doc_id, k, b, j) AS (
  SELECT doc_id, (doc_id::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT, -1::BIGINT, 0::BIGINT
  FROM documents
  UNION ALL
  SELECT doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT, j,
         floor((j + 1) * (2147483648::DOUBLE / ((k // 8589934592)::BIGINT + 1)))::BIGINT
  FROM jumps WHERE j < 24),
placed AS (SELECT doc_id, b, j FROM jumps WHERE j >= 24),
bytes AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS l
  FROM documents),
crc AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, l),
                         lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, b::INTEGER AS shard,
       row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1 AS slot,
       (CASE WHEN j = 24 THEN 24 ELSE b END)::INTEGER AS grown_shard
FROM placed JOIN crc USING (doc_id)
"""

ORACLES = {"op5_exact_dedup": OP5, "op10_sharding": OP10}
