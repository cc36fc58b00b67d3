"""The ten queries, with production parameters over whole tables, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import op1_sharding, op2_simhash, op3_digest, op4_toxicity, op5_mixing, op6_packing, op7_html, op8_exact_dedup, op9_token_files, op10_chat
from quillspan.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_sharding": lambda s, d: op1_sharding.shard_documents(docs(s, d), shards=16),
        "op2_simhash": lambda s, d: op2_simhash.near_duplicates(docs(s, d)),
        "op3_digest": lambda s, d: op3_digest.document_digests(docs(s, d)),
        "op4_toxicity": lambda s, d: op4_toxicity.toxicity(docs(s, d), table(s, d, "labels")),
        "op5_mixing": lambda s, d: op5_mixing.mix(docs(s, d)),
        "op6_packing": lambda s, d: op6_packing.pack_documents(docs(s, d)),
        "op7_html": lambda s, d: op7_html.extract_text(table(s, d, "pages")),
        "op8_exact_dedup": lambda s, d: op8_exact_dedup.exact_duplicates(docs(s, d)),
        "op9_token_files": lambda s, d: op9_token_files.token_files(docs(s, d)),
        "op10_chat": lambda s, d: op10_chat.render_chats(table(s, d, "conversations")),
    }


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sizes),
rests AS (SELECT *, row_number() OVER o AS n,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS BIGINT) AS rest, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS BIGINT) AS rest_weight
  FROM ranked WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source), p AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, cap * rest_weight >= rest * weight AS open FROM rests),
level AS (SELECT rest AS r, rest_weight AS w FROM opened WHERE open ORDER BY n LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN open THEN CAST(r AS DOUBLE) * weight / w ELSE CAST(cap AS DOUBLE) END AS target FROM opened, level),
plan AS (SELECT *, CAST(round(target) AS BIGINT) AS whole, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS copies FROM targets)
SELECT r.doc_id, r.source, r.size, p.source_size, p.target,
  CAST(p.copies * r.size + greatest(0, least(r.size, p.whole - p.copies * p.source_size - coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
"""

OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t
"""

OP10_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, max(turn) AS last, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text FROM t GROUP BY conv_id),
once AS (SELECT min(conv_id) AS conv_id, n_turns, last, turns, text, count(*) AS copies FROM c GROUP BY n_turns, last, turns, text)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, copies, text FROM once a
WHERE NOT EXISTS (SELECT 1 FROM once b WHERE b.turns[1] = a.turns[1] AND b.last > a.last AND b.turns[1:a.n_turns] = a.turns AND b.turns[a.n_turns + 1].turn > a.last)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_chat": OP10_SQL}
