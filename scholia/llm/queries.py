"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_bpe
from .chat import OP4_SQL, op4_chat
from .decontam import op1_decontamination
from .negatives import op13_negatives
from .packing import op12_packing
from .passages import op2_passages
from .quality import op7_quality
from .simhash import op6_simhash
from .sites import op3_classifier
from .tokencount import op10_tokens
from .urls import op5_sql, op5_urls
from .warc import op9_warc
from .whiten import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_passages": op2_passages,
    "op3_classifier": op3_classifier,
    "op4_chat": op4_chat,
    "op5_urls": op5_urls,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_tokens": op10_tokens,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_negatives": op13_negatives,
}

#: Base32 of the SHA-1 from its 40 hex digits: four groups of ten digits (40 bits), eight letters each.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, {g}, 10))::BIGINT >> {s}) & 31 AS INTEGER), 1)" for g in range(1, 41, 10) for s in range(35, -1, -5))

OP9_SQL = f"""
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

#: Every anchor against every row.
OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""

ORACLE_SQL: dict[str, str] = {"op4_chat": OP4_SQL, "op5_urls": op5_sql(), "op9_warc": OP9_SQL, "op13_negatives": OP13_SQL}
