"""Columns of integers as compressed blocks, and shuffles that move blocks instead of rows.

A block holds whole numpy columns of one bucket; a row of ``ROW`` carries a block with the
bucket that it is for and a ``kind``. One row is some thousand numbers, so the shuffle's cost
a row does not count, and integers travel in as few bytes as their range and order allow.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textnum import forget, mix64

ROW = "bucket int, kind int, chunk long, code long, x long, y long, z long, data binary, more binary"
NAMES = ["bucket", "kind", "chunk", "code", "x", "y", "z", "data", "more"]
_TYPES = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
_WIDTHS = (np.uint8, np.uint16, np.uint32)
_U = np.uint64


def _pack_one(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a, np.int64)
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    t = next((w for w in _WIDTHS if low >= 0 and high <= np.iinfo(w).max), np.int64)
    a = a.astype(t)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T if a.itemsize > 1 else a
    data = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())
    return struct.pack("<qqq", len(a), a.itemsize, len(data)) + data


def pack(*columns: np.ndarray) -> bytes:
    """Columns of int64, of any lengths, as bytes: the fewest bytes a number, by byte planes, compressed."""
    return b"".join(_pack_one(c) for c in columns)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at, kinds = [], 0, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}
    while at < len(data):
        n, width, size = struct.unpack_from("<qqq", data, at)
        at += 24
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=n * width), np.uint8)
        at += size
        a = np.ascontiguousarray(raw.reshape(width, n).T).view(kinds[width]).ravel() if n else np.zeros(0, np.int64)
        out.append(a.astype(np.int64))
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    """Ascending numbers as their steps; ``np.cumsum`` undoes it."""
    return np.diff(a, prepend=a.dtype.type(0)) if len(a) else a


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(np.ascontiguousarray(key).view(_U) ^ _U(0x5BD1E995)) % _U(buckets)).astype(np.int64)


class Out:
    """Rows of ``ROW`` gathered into record batches of bounded bytes."""

    def __init__(self, limit: int = 4 << 20):
        self.rows: list[tuple] = []
        self.size, self.limit = 0, limit

    def add(self, bucket: int, kind: int, data: bytes | None = None, more: bytes | None = None, chunk: int | None = None, code: int | None = None, x: int | None = None) -> None:
        self.rows.append((bucket, kind, chunk, code, x, None, None, data, more))
        self.size += 64 + len(data or b"") + len(more or b"")

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _TYPES, strict=True)], names=NAMES)
            self.rows, self.size = [], 0


def plain_rows(kind: int, bucket: np.ndarray, chunk: np.ndarray, code: np.ndarray, *xyz: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a number: what is addressed singly."""
    for i in range(0, len(bucket), 1 << 16):
        part = slice(i, i + (1 << 16))
        n = len(bucket[part])
        numbers = [pa.array(v[part]) for v in xyz] + [pa.nulls(n, pa.int64())] * (3 - len(xyz))
        columns = [pa.array(bucket[part].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(chunk[part]), pa.array(code[part]), *numbers, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        yield pa.record_batch(columns, names=NAMES)


def plain_columns(parts: list[pa.RecordBatch]) -> list[np.ndarray]:
    """chunk, code, x, y, z of such rows."""
    if not parts:
        return [np.zeros(0, np.int64)] * 5
    table = pa.Table.from_batches(parts)
    return [table.column(c).fill_null(0).to_numpy() for c in ("chunk", "code", "x", "y", "z")]


def by_bucket(batches: Iterator[pa.RecordBatch], column: str = "bucket") -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(bucket, its batches) of rows sorted by bucket; a bucket's batches must be used up before the next."""
    waiting: list[pa.RecordBatch] = []

    def pull() -> bool:
        while not waiting:
            batch = next(batches, None)
            if batch is None:
                return False
            if batch.num_rows:
                waiting.append(batch)
        return True

    def own(bucket: int) -> Iterator[pa.RecordBatch]:
        while pull():
            batch = waiting[0]
            at = batch.column(batch.schema.get_field_index(column)).to_numpy()
            n = int(np.searchsorted(at, bucket, "right")) if at[0] == bucket else 0
            if not n:
                return
            if n < len(at):
                waiting[0] = batch.slice(n)
                yield batch.slice(0, n)
                return
            waiting.pop()
            yield batch

    while pull():
        bucket = waiting[0].column(waiting[0].schema.get_field_index(column))[0].as_py()
        yield bucket, own(bucket)


def kinds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(kind, rows of that kind) in order, of rows sorted by kind."""
    for batch in batches:
        kind = batch.column(1).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(kind[a]), batch.slice(int(a), int(b - a))


def dealt(rows: DataFrame, buckets: int, *then: str) -> DataFrame:
    """Rows shuffled to their buckets, sorted within."""
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", *then)


def read(spark: SparkSession, path: str, *kinds: int) -> DataFrame:
    """The rows of some kinds of a table that is partitioned by kind."""
    names = [n for n in NAMES if n != "kind"] + ["kind"]
    schema = ", ".join(f for n in names for f in ROW.split(", ") if f.startswith(f"{n} "))
    return spark.read.schema(schema).parquet(path).filter(F.col("kind").isin(*kinds)).select(*NAMES)


def _sum(blocks: Iterable[bytes]) -> list[np.ndarray]:
    """Sums of the columns, with two blocks in memory."""
    total: list[np.ndarray] = []
    for data in blocks:
        columns = unpack(data)
        if total:
            for a, b in zip(total, columns, strict=True):
                a += b
        else:
            total = columns
    return total


def release() -> None:
    """What numpy and Arrow have freed goes back to the system, as far as the platform can: workers live on, and keep it else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which leaves the worker as small as it can when its task ends."""

    def and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        forget()
        release()

    return and_release


def tree_sum(rows: DataFrame, parts: int, table: Callable[[DataFrame], DataFrame], fan: int = 32) -> list[np.ndarray]:
    """Sum of the columns in the blocks of ``parts`` rows (one a bucket): ``fan`` at a time, so no task or driver gets many."""

    def add(t: pa.Table) -> pa.Table:
        total = _sum(d.as_py() for d in t.column("data"))
        return pa.table({"bucket": pa.array([t.column("g")[0].as_py()], pa.int32()), "data": pa.array([pack(*total)], pa.binary())})

    rows = rows.select("bucket", "data")
    while parts > fan:
        parts = -(-parts // fan)
        rows = table(rows.withColumn("g", (F.col("bucket") % parts).cast("int")).groupBy("g").applyInArrow(add, "bucket int, data binary"))
    return _sum(bytes(r["data"]) for r in rows.collect())
