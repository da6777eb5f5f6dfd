"""From raw documents to packed training sequences.

Five stages, in this order. Each takes what the one before has kept, as Parquet, and its decisions take effect:
rejected documents, all but one of near-duplicates and documents that aren't drawn go; personal data is
masked; the last stage packs what is left. All but the last return the columns of documents.

Near-duplicates are texts with a Jaccard similarity of 0.8 or more of their five-word shingles, found by the SimHash operator's
Golay keys over wide fingerprints and verified; an exact check finds those that the keys leave out.
Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are as each operator's
module defines them; SQL can't express the stages, so tests hold near-duplicates and
packing against brute force, and the other stages against what their operators report row by row, which have tests of their own.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from provspark.llm import mixing, packing, pii, quality, similar
from provspark.llm.common import shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the weakly supervised rules reject."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return similar.keep_one(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by probabilities that are raked to the target weights."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens: a row for each piece."""
    return packing.packed(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("pii", mask_pii), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    """Delete what no later stage reads, by Spark's own file system layer."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; between them documents are written to the folder that the cluster shares and reread.

    A stage's rows are deleted once the next one's are written; those that the last stage reads stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = os.path.join(shared(spark), f"pipeline-{uuid.uuid4()}")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
            if k:
                removed(spark, f"{place}/{k - 1}")
    return docs
