"""Join of texts whose sets of word shingles have a Jaccard similarity of at least a limit.

Method: T-occurrence search over inverted lists of shingles, as DivideSkip has it. Two sets of T
shared shingles or more are sought; of a set's lists the L longest ones are put aside, L being T - 1, T - 2 or T - 3: as few as
leave out all lists that the sketch holds for longer than ``LONG``. The short lists are merged,
by a shuffle that sorts them by shingle and one that counts the occurrences of a pair together, and a pair that occurs
T - L times (with the larger L of the two sets) is a candidate. The long lists are never merged: a
candidate's shingles are binary-probed in the other's sorted set until the overlap that
the limit asks for is certain or out of reach. Which lists are long goes by a count sketch, then by hash, one order for
all sets; any fixed order gives the same links, the sketch only keeps the short lists short. Its size follows
the input (up to 2^23 slots of one byte), and the tasks' sketches are added up a few at a time.

Groups of copies stay linear. Equal sets are one class from the start. In a first round
every class is compared with one other class of each of its lists, the one with the
fewest rarer shingles, which in a group of near copies is the text they come from; the
links of this round make components. The second round compares all classes of a list that
are not in one component yet. No link between components is lost, and what is left out
could only repeat a connection.

Defined cases: a null or blank text has an empty set and is linked with nothing; a text of
fewer words than a shingle has its whole sequence as its one shingle; repeated rows are
rows of one class; a null doc_id takes part, and a component's number is the least id
that is not null; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.blocks import pack, released, tree_sum
from tidemark.llm.graph import components
from tidemark.llm.textnum import Words, longs, mix64, slices, stream
from tidemark.runtime import Scratch, fresh, shuffle_partitions

OCCURRENCES, LONG = 3, 64
_SLOTS, _CHARS_A_SLOT, _SALTS = (1 << 21, 1 << 23), 256, 8
_U = np.uint64
_SEEN = 1_000_000


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles of some texts, sorted by row and shingle."""
    w = Words(data, offsets)
    g, at = w.shingles(k)
    row = w.doc[at]
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(short):
        g = np.concatenate([g, np.array([w.whole(r) for r in short], _U)])
        row = np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return row[new], g[new]


def classes(row: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and class number (a hash of the set) of each of ``n`` rows."""
    size = np.bincount(row, minlength=n)
    ends = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(g ^ stream(5, 1)[0]), dtype=_U)])
        return size, mix64(total[ends[1:]] - total[ends[:-1]] + size.astype(_U) * stream(6, 1)[0])


def _place(g: np.ndarray, slots: int) -> np.ndarray:
    return (mix64(g ^ stream(8, 1)[0]) % _U(slots)).astype(np.int64)


_FACTS = "doc_id long, size int, class long, bucket int, data binary"


def _facts(k: int, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each text; at the end of the task its sketch of the counts of shingles (``bucket``: the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(slots, np.int32)
        for rows, data, offsets in slices(batches):
            n = len(offsets) - 1
            row, g = sets(data, offsets, k)
            size, cls = classes(row, g, n)
            at, counts = np.unique(_place(g, slots), return_counts=True)
            sketch[at] += counts.astype(np.int32)
            yield pa.record_batch([rows.column(0).cast(pa.int64()), pa.array(size.astype(np.int32)), longs(cls), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "size", "class", "bucket", "data"])
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pack(sketch)], pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "size", "class", "bucket", "data"])

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte, in steps of an eighth of a doubling."""
    return np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that sets of sizes ``a`` and ``b`` need: 100 * shared >= percent * (a + b - shared)."""
    return -(-percent * (a + b) // (100 + percent))


def _entries(k: int, percent: int, sketch: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The short-list shingles of each class that is new to the task: shingle, class, size, rank in the order, and T - L."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for _, data, offsets in slices(batches):
            n = len(offsets) - 1
            row, g = sets(data, offsets, k)
            size, cls = classes(row, g, n)
            fresh = np.zeros(n, bool)
            for i, c in enumerate(cls.tolist()):
                if size[i] and c not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(c)
                    fresh[i] = True
            keep = fresh[row]
            row, g = row[keep], g[keep]
            level = counts[_place(g, len(counts))]
            order = np.lexsort((g, level, row))
            row, g, level = row[order], g[order], level[order]
            first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
            rank = np.arange(len(row)) - first[row]
            # A partner has percent % of a set's size at least in common with it, so one shingle up to this rank, two up to the next, ...
            beyond = rank - (size[row] - -(-percent * size[row] // 100))
            more = (beyond > 0) & (beyond < OCCURRENCES) & (level <= _levels(np.array([LONG]))[0])
            times = 1 + np.bincount(row[more], minlength=n)
            short = (beyond <= 0) | more
            row, g, rank = row[short], g[short], rank[short]
            yield pa.record_batch([longs(g), longs(cls[row]), pa.array(size[row].astype(np.int32)), pa.array(rank.astype(np.int32)), pa.array(times[row].astype(np.int32))], names=["shingle", "class", "size", "rank", "times"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 1 << 18) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by shingle, whole shingles at a time, about ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flat() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return {c: table.column(c).to_numpy() for c in table.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            part = flat()
            last = int(np.searchsorted(part["shingle"], part["shingle"][-1], "left"))
            if last:
                yield {c: v[:last] for c, v in part.items()}
                held = [pa.Table.from_batches(held).combine_chunks().slice(last).to_batches()[0]]
                rows -= last
    if held:
        yield flat()


def _possible(p: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether classes at ``i`` and ``j`` of one list may reach the limit, if this is one of their first shared shingles."""
    a, b = p["size"][i], p["size"][j]
    left = np.minimum(a - p["rank"][i], b - p["rank"][j])
    return left + np.minimum(p["times"][i], p["times"][j]) - 1 >= least_overlap(a.astype(np.int64), b.astype(np.int64), percent)


def _need(p: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """How often two classes have to occur together in short lists."""
    return np.minimum(least_overlap(p["size"][i].astype(np.int64), p["size"][j].astype(np.int64), percent), np.minimum(p["times"][i], p["times"][j]))


_ROUND1 = "shingle long, class long, size int, rank int, times int, a long, b long, need long"
_LIST = ["shingle", "class", "size", "rank", "times"]


def _first_round(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of lists with two or more classes, and candidates: each class with its list's leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _groups(batches):
            order = np.lexsort((p["class"], p["rank"], p["shingle"]))
            p = {c: v[order] for c, v in p.items()}
            new = np.ones(len(order), bool)
            new[1:] = (p["shingle"][1:] != p["shingle"][:-1]) | (p["class"][1:] != p["class"][:-1])
            p = {c: v[new] for c, v in p.items()}
            starts = np.ones(len(p["shingle"]), bool)
            starts[1:] = p["shingle"][1:] != p["shingle"][:-1]
            at = np.flatnonzero(starts)
            number = np.cumsum(starts) - 1
            shared = np.diff(np.append(at, len(starts)))[number] > 1
            i = np.flatnonzero(shared)
            lead = at[number[i]]
            yield pa.record_batch([*(pa.array(p[c][i]) for c in _LIST), *[pa.nulls(len(i), pa.int64())] * 3], names=[*_LIST, "a", "b", "need"])
            pair = (lead != i) & _possible(p, i, lead, percent)
            x, y = p["class"][i[pair]], p["class"][lead[pair]]
            m = len(x)
            yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.int32())] * 3, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(_need(p, i[pair], lead[pair], percent))], names=[*_LIST, "a", "b", "need"])

    return run


def _second_round(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates between classes of a list that are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _groups(batches):
            order = np.lexsort((p["size"], p["shingle"]))
            p = {c: v[order] for c, v in p.items()}
            # Equal sizes or nearly so stand together: compare with the next row, the one after it, and so on.
            i, lag = np.arange(len(order)), 1
            while len(i):
                i = i[i + lag < len(order)]
                j = i + lag
                near = (p["shingle"][i] == p["shingle"][j]) & (100 * p["size"][i].astype(np.int64) >= percent * p["size"][j].astype(np.int64))
                i, j = i[near], j[near]
                pair = (p["root"][i] != p["root"][j]) & _possible(p, i, j, percent)
                if pair.any():
                    x, y = p["class"][i[pair]], p["class"][j[pair]]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(_need(p, i[pair], j[pair], percent))], names=["a", "b", "need"])
                lag += 1

    return run


def _set_rows(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The sorted set of each text whose class is the wanted one, once for each salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            n = len(offsets) - 1
            row, g = sets(data, offsets, k)
            _, cls = classes(row, g, n)
            ends = np.searchsorted(row, np.arange(n + 1))
            wanted = np.flatnonzero(cls.view(np.int64) == rows.column(rows.schema.get_field_index("class")).to_numpy())
            salts = rows.column(rows.schema.get_field_index("salts")).to_pylist()
            out = [(i, s) for i in wanted.tolist() for s in salts[i]]
            at = [i for i, _ in out]
            yield pa.record_batch([longs(cls[at] if at else cls[:0]), pa.array([s for _, s in out], pa.int32()), pa.array([g[ends[i] : ends[i + 1]].tobytes() for i in at], pa.binary())], names=["class", "salt", "set"])

    return run


def probe(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the limit: the smaller one's elements, binary-probed in blocks until it is certain."""
    if len(a) > len(b):
        a, b = b, a
    need = int(least_overlap(np.int64(len(a)), np.int64(len(b)), percent))
    found, block = 0, 256
    for i in range(0, len(a), block):
        part = a[i : i + block]
        at = np.minimum(np.searchsorted(b, part), len(b) - 1)
        found += int(np.count_nonzero(b[at] == part))
        if found >= need or found + len(a) - i - len(part) < need:
            break
    return found >= need > 0


def _probed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = {name: t.column(i) for i, name in enumerate(t.schema.names)}
            good = [probe(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(c["set_a"], c["set_b"], strict=True)]
            yield pa.record_batch([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The links among pairs of classes that occur together often enough, from the whole texts of one document of each class."""
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("a", "b")
    # A class that many others meet has its set there once for each salt of theirs.
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(_SALTS)).cast("int")
    pairs = scratch.table(pairs.withColumns({"sa": salt("b"), "sb": salt("a")}))
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("sa").alias("s")), F.struct(F.col("b").alias("c"), F.col("sb").alias("s")))).alias("w"))
    wanted = wanted.groupBy(F.col("w.c").alias("c")).agg(F.collect_set("w.s").alias("salts"))
    chosen = reps.join(wanted, F.col("class") == F.col("c")).select(F.col("doc_id").alias("rep"), "class", "salts")
    # Both sides grow with the input: neither is broadcast at any size.
    found = docs.select("doc_id", "text").join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("class", "salts", "text")
    held = scratch.table(found.mapInArrow(released(_set_rows(k)), "class long, salt int, set binary").groupBy("class", "salt").agg(F.first("set").alias("set")), "uncompressed")
    a = held.select(F.col("class").alias("ca"), F.col("salt").alias("s1"), F.col("set").alias("set_a"))
    b = held.select(F.col("class").alias("cb"), F.col("salt").alias("s2"), F.col("set").alias("set_b"))
    joined = pairs.join(a, (F.col("a") == F.col("ca")) & (F.col("sa") == F.col("s1"))).join(b, (F.col("b") == F.col("cb")) & (F.col("sb") == F.col("s2"))).select("a", "b", "set_a", "set_b")
    return scratch.table(joined.mapInArrow(released(_probed(percent)), "a long, b long"))


def link(spark: SparkSession, docs: DataFrame, scratch: Scratch, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slots = min(max(_SLOTS[0], 1 << (size // _CHARS_A_SLOT).bit_length()), _SLOTS[1])
    raw = scratch.table(docs.mapInArrow(released(_facts(k, slots)), _FACTS))
    facts = raw.filter("bucket is null").select("doc_id", "size", "class")
    sketches = raw.filter("bucket is not null")
    parts = sketches.agg(F.coalesce(F.max("bucket") + 1, F.lit(0))).first()[0]
    counts = spark.sparkContext.broadcast(_levels((tree_sum(sketches, parts, scratch.table, 8) or [np.zeros(slots)])[0]))
    reps = scratch.table(facts.filter("size > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")))

    entries = docs.select("text").mapInArrow(released(_entries(k, percent, counts)), "shingle long, class long, size int, rank int, times int")
    lists = entries.repartition(shuffle_partitions(spark), "shingle").sortWithinPartitions("shingle")
    first = scratch.table(lists.mapInArrow(released(_first_round(percent)), _ROUND1))
    links1 = verified(first.filter("a is not null").select("a", "b", "need"), reps, docs, k, percent, scratch)
    near = components(links1, scratch)

    shared = first.filter("a is null").select(*_LIST)
    rooted = shared.join(near, F.col("class") == F.col("node"), "left").select(*_LIST, F.coalesce("root", "class").alias("root"))
    again = rooted.repartition(shuffle_partitions(spark), "shingle").sortWithinPartitions("shingle")
    links2 = verified(again.mapInArrow(released(_second_round(percent)), "a long, b long, need long"), reps, docs, k, percent, scratch)

    joined = components(links1.unionByName(links2), scratch)
    members = reps.join(joined, F.col("class") == F.col("node"), "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    least = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = scratch.table(members.join(least, "root").select(F.col("class").alias("c"), "component_id"))
    return facts.join(named, (F.col("class") == F.col("c")) & (F.col("size") > 0), "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def join(spark: SparkSession, docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    with Scratch(spark, "ngram-join") as scratch:
        return scratch.result(link(spark, docs, scratch, k, percent))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that are alone or first (by id) of their component; rows without an id stay."""
    with Scratch(spark, "ngram-keep") as scratch:
        linked = link(spark, docs, scratch, k, percent)
        kept = fresh(docs, "kept")
        first = scratch.result(linked.filter("component_id = doc_id or component_id is null or doc_id is null").select(F.col("doc_id").alias(kept)).distinct())
    return docs.join(first.hint("merge"), docs["doc_id"].eqNullSafe(first[kept]), "left_semi")
