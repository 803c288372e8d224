"""Rows in chunks of some megabytes of text: each chunk is one compressed record that a later step can be handed
again by its number, together with what other tasks found out for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.text import trim
from strandloom.operators.shared import materialise, partitions

FIELDS = "chunk long, shard int, blob binary, kind int"
SCHEMA = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary()), ("kind", pa.int32())])
PAYLOAD, REQUEST, ANSWER, WINDOWS = 0, 1, 2, 3


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as reader:
        return reader.read_next_batch()


def arrays(*columns: np.ndarray) -> bytes:
    """Columns of any lengths as one compressed record."""
    return pack(pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=[x.dtype.str for x in columns]))


def unarrays(blob: bytes) -> list[np.ndarray]:
    batch = unpack(blob)
    return [np.frombuffer(batch.column(k)[0].as_buffer(), np.dtype(f.name)) for k, f in enumerate(batch.schema)]


def rows(found: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def chunked(df: DataFrame, text: str, most: int, requests: Callable[[pa.RecordBatch], tuple[pa.RecordBatch, list[tuple[int, bytes]]]], tag: str) -> tuple[DataFrame, DataFrame, str]:
    """Write df as chunks of about ``most`` bytes of text (or one row) and what ``requests`` makes of each:
    the batch to keep, and (shard, blob) rows. Gives both tables and their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            kept, asked = requests(whole)
            out = rows([(number, -1, pack(kept), PAYLOAD), *((number, shard, blob, REQUEST) for shard, blob in asked)])
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(text)).to_pylist()], np.int64)
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(lengths[at:]), most - size, side="right"))
                if room == 0 and not held:
                    room = 1
                if room:
                    held.append(batch.slice(at, room))
                    size += int(lengths[at : at + room].sum())
                    at += room
                if at < batch.num_rows:
                    yield flush()
        if held:
            yield flush()
        trim()

    table, path = materialise(df.mapInArrow(run, FIELDS), tag, "kind")
    return table.filter(f"kind = {PAYLOAD}"), table.filter(f"kind = {REQUEST}"), path


def with_answers(payload: DataFrame, answers: DataFrame, run: Callable[[int, pa.RecordBatch, list[tuple[int, bytes, int]]], pa.Table], schema: str | T.StructType) -> DataFrame:
    """Hand each chunk to ``run`` with the rows that came back for it, in the order of (kind, shard)."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        back = sorted(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), right.column("kind").to_pylist(), strict=True), key=lambda x: (x[2], x[0]))
        out = run(left.column("chunk")[0].as_py(), unpack(left.column("blob")[0].as_py()), back)
        trim()
        return out

    return payload.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, schema)


def shards_for(texts: DataFrame, text: str, each: int = 128 << 20) -> int:
    """How many shards hold what tasks find out: one for each ``each`` bytes of text, as many as shuffle partitions at least."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(partitions(texts.sparkSession), -(-int(size) // each))


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Hand whole texts to Python in small batches: what a worker and its JVM hold then doesn't depend on the rows' sizes."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        found = int(spark.conf.get(key).rstrip("b"))
        if found <= 0 or found > most:
            spark.conf.set(key, str(most))
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key)))))
