"""Conflict-constrained best-fit packing of texts into bins of a fixed number of words.

Method: rows are dealt into shards of bounded size by a hash, so any source or group of
copies is spread evenly; each shard is packed in one task. Its pieces go in order of
decreasing size. Open bins stand in a list ordered by what room is left; every bin carries
a bitmap of its sources and one of its duplicate clusters. The search starts at the
tightest bin that has room and goes on to its successors until one shares neither source
nor cluster with the piece; without one, a bin is opened.

Defined cases: a text longer than a bin is cut into full pieces, which fill bins of their
own, and a rest, which is packed; a text without words (or null) is one piece of size 0;
a null source or cluster is a value like others; repeated rows are separate pieces with
the same cluster; ties go by doc_id and cluster; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import word_count
from tidemark.runtime import Scratch

SCHEMA = "doc_id long, source string, cluster long, piece int, start_word long, n_words long, bin_id long, bin_words long"
_SHARD_BITS = 24


def _bits(values: Iterable[object]) -> dict[object, int]:
    """A bit for every value that occurs twice or more; others can't conflict."""
    return {v: 1 << i for i, v in enumerate(sorted((v for v, n in Counter(values).items() if n > 1), key=repr))}


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each (size <= capacity, source, cluster), given in the order to place them."""
    source_bit, cluster_bit = _bits(p[1] for p in pieces), _bits(p[2] for p in pieces)
    room: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    at = []
    for size, source, cluster in pieces:
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        i = bisect_left(room, (size, -1))
        while i < len(room) and (sources[room[i][1]] & s or clusters[room[i][1]] & c):
            i += 1
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        insort(room, (left - size, b))
        at.append(b)
    return at


def _pack_shard(capacity: int, batch: pa.Table) -> pa.Table:
    shard = batch.column("shard")[0].as_py()
    rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("size", "doc_id", "cluster", "source")), strict=True), key=lambda r: (r[1] is None, r[1] or 0, r[2] or 0, r[3] or ""))
    full, rest = [], []
    for size, doc_id, cluster, source in rows:
        whole = max(0, math.ceil(size / capacity) - 1)
        full += [(doc_id, source, cluster, k, k * capacity, capacity) for k in range(whole)]
        rest.append((doc_id, source, cluster, whole, whole * capacity, size - whole * capacity))
    rest.sort(key=lambda p: -p[5])
    at = best_fit([(p[5], p[1], p[2]) for p in rest], capacity)
    at += range(max(at, default=-1) + 1, max(at, default=-1) + 1 + len(full))
    placed = rest + full
    words = Counter()
    for p, b in zip(placed, at, strict=True):
        words[b] += p[5]
    columns = list(zip(*placed, strict=True))
    columns += [[(shard << _SHARD_BITS) + b for b in at], [words[b] for b in at]]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "source", "cluster", "piece", "start_word", "n_words", "bin_id", "bin_words"]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def copies_of(text: Column) -> Column:
    """A duplicate cluster for each text: equal texts, whatever the case and the spaces."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 2048, shard_rows: int = 4096, cluster: Column | None = None) -> DataFrame:
    """A row for each piece of a text: where it starts, its words, its bin and the bin's words.

    ``cluster`` (a long) says which texts must not share a bin; by default equal texts. A shard goes by a row's
    values, for rows without an id, which may be many equal ones, by their place in the table as well.
    """
    with Scratch(spark, "packing") as scratch:
        return scratch.result(_packed(docs, scratch, capacity, shard_rows, cluster))


def _packed(docs: DataFrame, scratch: Scratch, capacity: int, shard_rows: int, cluster: Column | None) -> DataFrame:
    cluster = copies_of(F.col("text")) if cluster is None else cluster
    sized = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), word_count(F.col("text")).alias("size")))
    shards = max(1, math.ceil(sized.count() / shard_rows))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "source", "size", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.lit(shards)).cast("long"))

    def packed(batch: pa.Table) -> pa.Table:
        return _pack_shard(capacity, batch)

    return dealt.groupBy("shard").applyInArrow(packed, SCHEMA)


