"""Streams of artifact fragments as Structured Streaming queries, and stored streams as batch tables."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.codec.stream import Reader, events_of
from provspark.operators.graph import Incremental

EVENTS = "stream_id string, event_no int, event string, node_id string, seq long, text string, error string"
FIELDS = ("event", "node_id", "seq", "text", "error")
IDLE_MS = 3_600_000


def follow(fragments: DataFrame, any_resume: bool = False, require_signature: bool = False, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Events of streams from fragments (stream_id, frag_no, data), as they come.

    Fragments of one stream may come in any order within a micro-batch; they are sorted by frag_no there, and must not
    come in an earlier batch than their predecessors. State is a reader for each stream, dropped when
    been idle for idle_ms; an idle stream gives no event. None: never; a query that is to end by itself
    (availableNow) needs that, as it would wait for the timeouts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reader, no = pickle.loads(state.get[0]) if state.exists else (Reader(None, any_resume, require_signature), 0)
        rows = pd.concat(list(frames)).sort_values("frag_no", kind="stable")
        out = []
        for data in rows["data"]:
            for e in reader.feed(bytes(data)):
                out.append((key[0], no, *(e.get(f) for f in FIELDS)))
                no += 1
        if reader.over:
            # What comes after the end is ignored, so only that much is remembered.
            reader.held, reader.texts = b"", {}
        state.update((pickle.dumps((reader, no)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "event_no", *FIELDS]).astype({"seq": "Int64"})

    return fragments.select("stream_id", "frag_no", "data").groupBy("stream_id").applyInPandasWithState(step, EVENTS, "reader binary", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def replayed(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Events of whole stored streams."""
    schema = pa.schema([("stream_id", pa.string()), ("event_no", pa.int32()), ("event", pa.string()), ("node_id", pa.string()), ("seq", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"stream_id": k, "event_no": i, **e} for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, e in enumerate(events_of(d or b""))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col(key).cast("string").alias("k"), F.col(content).cast("binary").alias("c")).mapInArrow(run, EVENTS)


def growing_graphs(steps: DataFrame) -> DataFrame:
    """(stream_id, step_no, id, error) of steps (stream_id, step_no, id, deps) that are added one after another; a step that closes a cycle, or comes twice, is refused."""
    schema = "stream_id string, step_no long, id string, error string"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        graph = pickle.loads(state.get[0]) if state.exists else Incremental()
        rows = pd.concat(list(frames)).sort_values("step_no", kind="stable")
        errors = [graph.add(i, list(d) if d is not None else []) for i, d in zip(rows["id"], rows["deps"])]
        state.update((pickle.dumps(graph),))
        yield pd.DataFrame({"stream_id": key[0], "step_no": rows["step_no"].to_numpy(), "id": rows["id"].to_numpy(), "error": errors})

    return steps.groupBy("stream_id").applyInPandasWithState(run, schema, "graph binary", "append", "NoTimeout")


def fresh_only(documents: DataFrame, capacity: int = 100_000) -> DataFrame:
    """(nonce, arrival, signers, status) of documents as they come: fresh or replay. For each nonce at most capacity signers are remembered, the oldest are forgotten first."""
    if isinstance(capacity, bool) or not isinstance(capacity, int) or capacity < 1:
        raise ValueError("capacity is a positive whole number")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used: dict = pickle.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable").reset_index(drop=True)
        status = []
        for signers in rows["signers"]:
            members = sorted(set(signers)) if signers is not None and len(signers) else [None]
            seen = any(m in used for m in members)
            status.append("replay" if seen else "fresh")
            if not seen:
                used |= dict.fromkeys(members)
                while len(used) > capacity:
                    used.pop(next(iter(used)))
        state.update((pickle.dumps(used),))
        yield rows.assign(status=status)[["nonce", "arrival", "signers", "status"]]

    rows = documents.filter(F.coalesce("nonce", F.lit("")) != "").select("nonce", "arrival", "signers")
    return rows.groupBy("nonce").applyInPandasWithState(run, "nonce string, arrival long, signers array<string>, status string", "used binary", "append", "NoTimeout")
