"""Corpus pipeline: quality rules, near-duplicates, secret redaction, packing.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  A stage's result is written as Parquet and read again as
the next one's ``docs``; all but the last return the columns of ``documents``.

* ``quality_rules``  - documents the rules reject go.
* ``simhash_dedup``  - one document of each near-duplicate component stays.
* ``secret_redact``  - live secrets are masked; every document stays.  Whether a
  value is a copied example is decided by its owners and repositories in the
  whole ``documents`` table, so that de-duplication cannot turn one into a
  secret; spans are those of the stage's own input.
* ``packing``        - the rest becomes token sequences (one row per piece).

Defined cases: a null, empty or blank text fails the quality rules and goes; of
repeated rows one stays; a null id is kept as a null id, one such document per
component; extra columns, whatever their names, reach the packing stage (which
returns its own columns); very long texts are worked on whole; an empty table
gives an empty result, and an empty or one-class ``labels`` table leaves the
base rules alone to decide.

Each stage's folder lies in the shared folder of ``spark.checkpoint.dir`` and
is removed once the next stage is written; the last one holds the result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tractscope.llm import packing, quality, secret_scan, simhash
from tractscope.llm.common import read, remove_folder
from tractscope.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_live(docs, corpus=read(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", simhash_stage),
    ("secret_redact", secret_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result lies in the shared folder of
    ``spark.checkpoint.dir`` before the next stage reads it."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
