"""The same results in DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op10_mixing"] = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
           md5('20:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
    FROM sized GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) - 1 AS nth,
           least(1.5, 2.0) * sum(source_size) OVER () AS wanted
    FROM sources
), levels AS (
    SELECT *,
           (wanted - coalesce(sum(2.0 * source_size) OVER before, 0)::DOUBLE) / (sum(weight) OVER after)::DOUBLE AS level
    FROM ranked
    WINDOW before AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), chosen AS (
    SELECT level FROM levels WHERE 2.0 * source_size >= level * weight ORDER BY nth LIMIT 1
), targets AS (
    SELECT source, source_size, least(2.0 * source_size::DOUBLE, coalesce(level * weight, 2.0 * source_size::DOUBLE)) AS target
    FROM sources LEFT JOIN chosen ON true
), rated AS (
    SELECT sized.*, source_size, target,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
           ('0x' || substr(digest, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (size * (floor(rate) + (chance < rate - floor(rate))::INTEGER))::BIGINT AS taken
FROM rated
"""

SQL["op8_sharding"] = """
WITH hashed AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
    FROM documents
), nodes AS (
    SELECT depth, hash >> (60 - depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs,
           min(hash) = max(hash) AS single
    FROM hashed, range(0, 61) depths(depth) GROUP BY ALL
), first AS (
    SELECT doc_id, n_bytes, hash, min(depth) AS depth
    FROM hashed, nodes
    WHERE hash >> (60 - depth) = shard AND (shard_bytes <= 1048576 OR single)
    GROUP BY ALL
)
SELECT doc_id, n_bytes, first.depth::INTEGER AS depth, shard, 0::INTEGER AS page, shard_bytes, shard_docs
FROM first JOIN nodes ON nodes.depth = first.depth AND nodes.shard = first.hash >> (60 - first.depth)
"""
