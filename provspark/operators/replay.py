"""Replay detection: a nonce may be used once by each signer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def single(df: DataFrame, signer: str, nonce: str, arrival: str) -> DataFrame:
    """Adds replay, for documents of one signer each: any but the first arrival of (signer, nonce). No signer is a signer of its own, unlike ''. No nonce: null."""
    w = Window.partitionBy(signer, nonce).orderBy(arrival)
    return df.withColumn("replay", F.when(F.coalesce(F.col(nonce), F.lit("")) != "", F.row_number().over(w) > 1))


def several(df: DataFrame) -> DataFrame:
    """(arrival, nonce, signers) with status fresh, replay or no_nonce, for any number of signers.

    A document is a replay if any of its signers has used the nonce; one that is rejected uses up
    nothing, so each nonce is folded in the order of arrival. Nonces are the partitions: all pairs of a document share one.
    """
    have = F.coalesce("nonce", F.lit("")) != ""
    rows = df.select(F.col("arrival").cast("bigint").alias("arrival"), "nonce", "signers")
    without = rows.filter(~have).withColumn("status", F.lit("no_nonce"))
    sorted_rows = rows.filter(have).repartition("nonce").sortWithinPartitions("nonce", "arrival")
    return sorted_rows.mapInArrow(fold, "arrival long, nonce string, signers array<string>, status string").unionByName(without)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by nonce and arrival; the signers of one nonce are held at a time."""
    nonce, used = None, set()
    for b in batches:
        status = []
        for own, signers in zip(b.column("nonce").to_pylist(), b.column("signers").to_pylist()):
            if own != nonce:
                nonce, used = own, set()
            members = set(signers) if signers else {None}
            fresh = used.isdisjoint(members)
            status.append("fresh" if fresh else "replay")
            if fresh:
                used |= members
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(status, pa.string())], names=[*b.schema.names, "status"])
