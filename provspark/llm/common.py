"""Helpers shared by the training-data operators.

Nothing here is tuned to a data set: batches are bounded in rows and bytes, lineage is cut in the
folder that the cluster shares, and words are split the one way that all contracts use.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six separators between words, as Java regular expression class members.
BLANKS = r"\x20\x09-\x0D"
#: The same as characters, for translate() and trim().
BLANK_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, by Spark's own reader, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint.

    The folder is shared().
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
    return given or tempfile.mkdtemp(prefix="checkpoint-")


def nested(docs: DataFrame, *columns: str) -> DataFrame:
    """row, all columns of docs in one, and besides some of them: whatever names docs has, none but these can clash with others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


#: What this process remembers from one task to the next, by name: only for the tasks of steps that say so. Told to functions of this module alone,
#: as a function that is sent to workers would bring a copy.
_KEPT: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    """What make() returned when this worker process first asked for the name since forget()."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drop what earlier tasks of this worker process remembered: Spark uses it for other steps too."""
    _KEPT.clear()


def give_back() -> None:
    """Return memory that is free to the system; else a worker keeps the most that any of its tasks had, for as long as it lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with nothing left in the worker from tasks before or from its own."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def map_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, remembers: bool = False) -> DataFrame:
    """Apply a function to Arrow batches of some columns; make() runs once in each task and returns it.

    Batches are sliced by bytes besides rows, so a run of very long texts doesn't meet in one call. remembers: make() uses
    remembered(), so workers keep that until a step comes that doesn't.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        f = make()
        for batch in batches:
            for part in sliced(batch):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run if remembers else tidy(run), schema)


def sliced(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about most bytes; a single longer row is a part of its own."""
    rows = batch.num_rows
    step = max(1, min(rows, int(rows * most / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch by column name, in the schema's order and types."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def ids_of(rows: pa.RecordBatch) -> pa.Array:
    """doc_id as a 64-bit integer; null stays null."""
    return rows.column("doc_id").cast(pa.int64())


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
