"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table.

``QUERIES``: name -> callable(spark, sf_dir); ``ORACLE``: name -> DuckDB SQL
for those that SQL can express.  The others are tested against brute force,
round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, html_mincut, licenses, mih, packing, pii, quality, runs, secret_scan, sharding, simhash, vector_codes, wordbpe
from .common import read
from .twins import RUNS, SHARDING, VECTOR_CODES

#: What conversation -1 says: control strings inside texts must survive.
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.secret_spans(read(spark, d, "documents"))


def op2_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_scan(read(spark, d, "documents"))


def op3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return mih.nearest_neighbours(read(spark, d, "embeddings"))


def op4_chat_format(spark: SparkSession, d: str) -> DataFrame:
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '{0}'), (-1L, 1L, 'assistant', '{0}') AS t(conv_id, turn, role, text)"
                      .format(PROBE_TEXT))
    table = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(table.unionByName(probe))


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_rules(read(spark, d, "documents"), read(spark, d, "labels"))


def op6_bpe(spark: SparkSession, d: str) -> DataFrame:
    return wordbpe.bpe_digests(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, d, "documents"))


def op9_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_mincut.extract_pages(read(spark, d, "pages"))


def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.pii_spans(read(spark, d, "documents"))


def op11_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(runs.with_cycles(read(spark, d, "documents"))))


def op12_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_rows(read(spark, d, "documents"))


def op13_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.compress_vectors(read(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_nearest, op4_chat_format, op5_quality_rules, op6_bpe,
                                   op7_packing, op8_simhash, op9_html_text, op10_pii, op11_periodic_runs,
                                   op12_sharding, op13_vector_codes)}

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
_TURN = "strlen('<|im_start|>') + length({role}) + 1 + length({text}) + strlen('<|im_end|>') + 1"
ORACLE = {
    "op11_periodic_runs": RUNS,
    "op12_sharding": SHARDING,
    "op13_vector_codes": VECTOR_CODES,
    "op4_chat_format": f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}'))
), s AS (
  SELECT *, {_TURN.format(role=_ESCAPED.format(r"replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')"),
                          text=_ESCAPED.format("text"))} AS chars FROM m
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
}
