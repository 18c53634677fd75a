"""Scores under a hierarchical Pitman-Yor language model, sampled by Gibbs sweeps.

Model: the next word is drawn in the restaurant of its context, the word before it (or the
start of a text); all context restaurants share one parent, the root, whose base is uniform
over the known words and one unknown word. A customer at a new table of a context restaurant
is a customer of the root. There are as many context restaurants as distinct words, so what
the model gathers grows with the corpus.

Seating: a cell is a (context, word) pair. A sweep seats the customers of every cell anew, one
after the other, given the restaurants' totals from the sweep before (of words that are rare and
stand after rare words, from two sweeps before). A cell's only customer has one table and needs no draw. Draws are hashes of
(sweep, context, word, number of the draw), so the tables are the same however the data is
dealt. Beyond 32 customers, many are seated at once with a draw each, or, where new tables are rare, the number
of customers up to the next one is drawn from its exact distribution, a quotient of gamma functions. The predictive
probabilities of the last ``SAMPLES`` sweeps are averaged.

Layout: words are hashed once. Each task sends its texts' words, sorted into blocks of cells and of the documents they
stand in, to buckets. ``HEAD`` words (frequent in a sample; the choice changes the cost alone) are
numbered, and their restaurants' totals are broadcast vectors. A cell's bucket goes by its rarer
side: by the hash of both words if both are numbered, else by the context if that is not, else by the
word. So all that concerns a restaurant or word outside the head is in one bucket, but for
cells of two rare words, which exchange totals with their words' buckets in rows. Cells
that are frequent in the sample keep only their counts in a bucket; the documents they stand in are
dealt by document and scored from a broadcast list. Buckets hold about ``TOKENS`` tokens at every size.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, equal if 63 bits of their hashes are; a
text ends with one more token. Training takes the texts whose crc32(doc_id as text)
modulo 10 is not 0. Logarithms are added up as multiples of 2^-28, which makes sums independent of their order.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as '' in
the split; repeated rows are scored, and learned from, each; without training rows every
probability is that of the base; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.blocks import ROW, Out, bucket_of, by_bucket, dealt, deltas, kinds_of, pack, plain_columns, plain_rows, read, release, released, tree_sum, unpack
from tidemark.llm.textnum import Words, mix64, slices
from tidemark.llm.toxicity import remainder
from tidemark.runtime import Scratch, shuffle_partitions

HEAD = 1 << 17
TOKENS = 2_000_000
BURN_IN, SAMPLES = 2, 2
STRENGTH = 1.0
_SAMPLE, _HOT_SHARE, _HOT_LEAST, _CHARS = 32, 1 << 20, 8, 6
_FLUSH_TOKENS, _FLUSH_ROWS = 1_000_000, 1 << 20
_ROW_BITS = 21
_U = np.uint64
_TOP = _U(1 << 63)
_UNIT = float(1 << 28)
#: Kinds of rows: a bucket's cells, mail to words' buckets and back, blocks of documents' tokens, documents, sums.
STATE, TO_WORD, FROM_WORD, TOKEN, HOT, DOC, SUMS, CELL = range(8)
#: Classes of cells: both words numbered; context not; word alone not.
BOTH, RARE_CONTEXT, RARE_WORD = range(3)


def canonical(hashes: np.ndarray) -> np.ndarray:
    """Hashes as the negative numbers that stand for words."""
    return (hashes | _TOP).view(np.int64)


END = int(canonical(np.array([0x656E64], _U))[0])
START = int(canonical(np.array([0x7374617274], _U))[0])


def token_codes(data: np.ndarray, offsets: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, row) of every token, the end tokens included: numbers of ``head`` words, else hashes (negative).

    The start's number is len(head).
    """
    w = Words(data, offsets)
    n = len(offsets) - 1
    own = canonical(w.hash)
    at = np.minimum(np.searchsorted(head, own), len(head) - 1)
    own = np.where(head[at] == own, at, own)
    # One slot more for each row: word k of row r stands at first[r] + r + k, the end token after them.
    word, row = np.full(len(own) + n, np.searchsorted(head, END)), np.zeros(len(own) + n, np.int64)
    place = np.arange(len(own)) + w.doc
    word[place], row[place] = own, w.doc
    last = w.first[1:] + np.arange(n)
    row[last] = np.arange(n)
    context = np.concatenate([[0], word[:-1]]) if len(word) else word
    context[w.first[:-1] + np.arange(n)] = len(head)
    return context, word, row


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (x null) and of pairs of words in each slice."""
    none = np.array([END])
    for _, data, offsets in slices(batches):
        u, w, _ = token_codes(data, offsets, none)
        w = np.where(w == 0, END, w)
        u = np.where(u == 1, START, np.where(u == 0, END, u))
        words, n = np.unique(w, return_counts=True)
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        yield pa.record_batch([pa.nulls(len(words), pa.int64()), pa.array(words), pa.array(n)], names=["u", "w", "n"])
        yield pa.record_batch([pa.array(u[at]), pa.array(w[at]), pa.array(np.diff(np.append(at, len(u))))], names=["u", "w", "n"])


@dataclass(frozen=True)
class Head:
    """``words``: sorted canonical hashes of the numbered words; ``hot``: sorted keys of frequent cells of them."""

    words: np.ndarray
    hot: np.ndarray
    buckets: int

    def key(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return u * len(self.words) + w

    def hash_of(self, code: np.ndarray) -> np.ndarray:
        """Canonical hashes of codes, as uint64: the same whatever the head."""
        named = np.append(self.words, START)
        return np.where(code < 0, code, named[np.maximum(code, 0)]).view(_U)

    def place(self, key: np.ndarray) -> np.ndarray:
        return bucket_of(key, self.buckets)

    def is_hot(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
        return self.hot[at] == key, at


def choose_head(docs: DataFrame, scratch: Scratch, most: int, tokens: int) -> Head:
    """The most frequent words and pairs of one document in 32 (by a hash of its row), and the number of buckets.

    Collected: ``most`` words and, as a pair needs a share of 1 / 2^20, at most 2^20 pairs.
    """
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SAMPLE)) == 0)
    counts = scratch.table(some.mapInArrow(released(_sample_counts), "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n")))
    total = counts.filter("u is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.filter("u is null").orderBy(F.col("n").desc(), "w").limit(most).select("w").toArrow().column("w").to_numpy()
    words = np.unique(np.append(top, END))
    least = max(_HOT_LEAST, total // _HOT_SHARE)
    pairs = counts.filter(f"u is not null and n >= {least}").select("u", "w").toArrow()
    u, w = (pairs.column(c).to_numpy() for c in ("u", "w"))
    scratch.drop(counts)
    head = Head(words, np.zeros(0, np.int64), max(1, -(-size // (_CHARS * tokens))))
    at = [np.minimum(np.searchsorted(words, v), len(words) - 1) for v in (u, w)]
    number = np.where(u == START, len(words), at[0])
    named = ((words[at[0]] == u) | (u == START)) & (words[at[1]] == w)
    return Head(words, np.unique(head.key(number, at[1])[named]), head.buckets)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _gather(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of runs, one run after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _class_cells(p: np.ndarray, q: np.ndarray | None, row: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of tokens' (p, q, row): cells (p, q, places of a row, training count) and their tokens (row, times)."""
    if q is None:
        both = np.sort((p.astype(_U) << _U(_ROW_BITS)) | row.astype(_U))
        at = _runs(both)
        p, row = (both[at] >> _U(_ROW_BITS)).astype(np.int64), (both[at] & _U((1 << _ROW_BITS) - 1)).astype(np.int64)
        times, q = np.diff(np.append(at, len(both))), np.zeros(len(at), np.int64)
    else:
        order = np.lexsort((row, q, p))
        p, q, row = p[order], q[order], row[order]
        at = _runs(p, q, row)
        times = np.diff(np.append(at, len(p)))
        p, q, row = p[at], q[at], row[at]
    cell = _runs(p, q)
    learned = np.add.reduceat(times * train[row], cell) if len(cell) else np.zeros(0, np.int64)
    return p[cell], q[cell], np.diff(np.append(cell, len(p))), learned, row, times


def _dealt_tokens(head: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of cells with the documents they stand in, by bucket; the documents; the tokens of hot cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Head(**head.value)
        part, out = TaskContext.get().partitionId() << 30, Out()
        held: list[tuple] = []
        docs: list[tuple] = []
        size = rows_held = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part + number
            u, w, row = (np.concatenate(c) for c in zip(*held, strict=True))
            ids, valid, train, n = (np.concatenate(c) for c in zip(*docs, strict=True))
            held.clear()
            docs.clear()
            own = int(h.place(np.array([chunk]))[0])
            out.add(own, DOC, pack(ids, valid, train, n), chunk=chunk)
            both, rare = (u >= 0) & (w >= 0), u < 0
            for cls, of in enumerate((both, rare, ~both & ~rare)):
                left, right = u[of], w[of]
                p, q = ((h.key(left, right), None), (left, right), (right, left))[cls]
                p, q, cells, learned, r, times = _class_cells(p, q, row[of], train)
                starts = np.concatenate([[0], np.cumsum(cells)[:-1]]).astype(np.int64)
                if cls == BOTH:
                    hot, at = h.is_hot(p)
                    if hot.any():
                        t = _gather(starts[hot], cells[hot])
                        out.add(own, HOT, pack(deltas(at[hot]), cells[hot], r[t], times[t]), chunk=chunk)
                        cells = np.where(hot, 0, cells)
                bucket = h.place(p)
                order = np.argsort(bucket.astype(np.uint16) if h.buckets < 1 << 16 else bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(h.buckets + 1)) if h.buckets < len(order) else None
                some = range(h.buckets) if edges is not None else np.unique(bucket).tolist()
                for b in some:
                    a, z = (edges[b], edges[b + 1]) if edges is not None else np.searchsorted(bucket[order], [b, b + 1])
                    if a == z:
                        continue
                    i = order[a:z]
                    t = _gather(starts[i], cells[i])
                    out.add(int(b), CELL, pack(deltas(p[i]), q[i], learned[i]), pack(cells[i], r[t], times[t]), chunk=chunk, code=cls, x=len(n))
                    yield from out.full()

        for batch, data, offsets in slices(batches):
            n = len(offsets) - 1
            u, w, row = token_codes(data, offsets, h.words)
            if held and (size + len(u) > _FLUSH_TOKENS or rows_held + n > _FLUSH_ROWS):
                yield from flush()
                release()
                size, rows_held, number = 0, 0, number + 1
            held.append((u, w, row + rows_held))
            ids = batch.column(0).cast(pa.int64())
            docs.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(row, minlength=n)))
            size, rows_held = size + len(u), rows_held + n
        if held:
            yield from flush()
        yield from out.rest()

    return released(run)


def _merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Cells of several blocks as one sorted list (p, q, count), and each block's places in it."""
    p, q, c = (np.concatenate(v) for v in zip(*parts, strict=True))
    order = np.lexsort((q, p)) if q.any() else np.argsort(p, kind="stable")
    ps, qs = p[order], q[order]
    at = _runs(ps, qs)
    number = np.zeros(len(p), np.int64)
    number[at] = 1
    index = np.empty(len(p), np.int64)
    index[order] = np.cumsum(number) - 1
    cuts = np.cumsum([len(v[0]) for v in parts])[:-1]
    return ps[at], qs[at], np.add.reduceat(c[order], at) if len(at) else c, np.split(index, cuts)


@dataclass
class Cells:
    """A bucket's cells by class: p, q, customers c, tables t, and the tables of each sample."""

    p: list[np.ndarray]
    q: list[np.ndarray]
    c: list[np.ndarray]
    t: list[np.ndarray]
    samples: list[list[np.ndarray]] = field(default_factory=list)
    #: For each sample the bucket's own rare words, and the rare words of its rare contexts: w, count, customers, tables.
    words: list[list[np.ndarray]] = field(default_factory=list)
    far: list[list[np.ndarray]] = field(default_factory=list)

    def dump(self) -> bytes:
        columns = []
        for k in range(3):
            columns += [deltas(self.p[k]), self.q[k], self.c[k], self.t[k], *(s[k] for s in self.samples)]
        for table in (*self.words, *self.far):
            columns += [deltas(table[0]), *table[1:]]
        return pack(np.array([len(self.samples), len(self.far)]), *columns)

    @staticmethod
    def load(data: bytes) -> Cells:
        sizes, *rest = unpack(data)
        samples, far = (int(v) for v in sizes)
        it = iter(rest)
        cells = Cells([], [], [], [], [[] for _ in range(samples)])
        for _ in range(3):
            cells.p.append(np.cumsum(next(it)))
            for column in (cells.q, cells.c, cells.t, *cells.samples):
                column.append(next(it))
        for tables, n in ((cells.words, samples), (cells.far, far)):
            for _ in range(n):
                tables.append([np.cumsum(next(it)), *(next(it) for _ in range(3))])
        return cells

    def to_words(self, own: int, h: Head) -> Iterator[pa.RecordBatch]:
        """Rows to the buckets of rare words after rare words: tables and counts there."""
        far = self.q[RARE_CONTEXT] < 0
        w, at = np.unique(self.q[RARE_CONTEXT][far], return_inverse=True)
        tables, counts = (np.bincount(at, v[RARE_CONTEXT][far], len(w)).astype(np.int64) for v in (self.t, self.c))
        yield from plain_rows(TO_WORD, h.place(w), np.full(len(w), own), w, tables, counts)

    def sums(self, h: Head, rare: list[int]) -> bytes:
        """Tables by numbered context, customers by numbered word, counts of both, and totals."""
        n = len(h.words)
        near = self.q[RARE_CONTEXT] >= 0
        u0, w0 = np.divmod(self.p[BOTH], n)
        out = []
        for v in (self.t, self.c):
            by_context = np.bincount(u0, v[BOTH], n + 1) + np.bincount(self.q[RARE_WORD], v[RARE_WORD], n + 1)
            by_word = np.bincount(w0, v[BOTH], n) + np.bincount(self.q[RARE_CONTEXT][near], v[RARE_CONTEXT][near], n)
            out += [by_context.astype(np.int64), by_word.astype(np.int64)]
        c = np.concatenate(self.c)
        return pack(*out, np.array([c.sum(), sum(t.sum() for t in self.t), (c == 1).sum(), (c == 2).sum(), *rare]))


def _build(head: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each bucket's cells, with one table for each that has customers, and its blocks of tokens by place in the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Head(**head.value)
        for bucket, own in by_bucket(batches):
            parts: list[list[list[np.ndarray]]] = [[], [], []]
            kept: list[list[tuple]] = [[], [], []]
            for kind, rows in kinds_of(own):
                if kind != CELL:
                    yield rows
                    continue
                chunk, cls, n, data, more = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("chunk", "code", "x", "data", "more"))
                for i, k in enumerate(cls):
                    p, q, c = unpack(data[i])
                    parts[k].append([np.cumsum(p), q, c])
                    kept[k].append((chunk[i], n[i], more[i]))
            cells, out = Cells([], [], [], []), Out()
            tokens: list[tuple] = []
            for k in range(3):
                if parts[k]:
                    p, q, c, index = _merged(parts[k])
                    tokens += [(chunk, k, n, i, more) for (chunk, n, more), i in zip(kept[k], index, strict=True)]
                else:
                    p, q, c = (np.zeros(0, np.int64) for _ in range(3))
                for column, v in zip((cells.p, cells.q, cells.c, cells.t), (p, q, c, (c > 0).astype(np.int64)), strict=True):
                    column.append(v)
            out.add(bucket, STATE, cells.dump())
            out.add(bucket, SUMS, cells.sums(h, [0] * 5))
            for chunk, k, n, i, more in sorted(tokens, key=lambda t: t[:2]):
                out.add(bucket, TOKEN, pack(deltas(i)), more, chunk=chunk, code=k, x=n)
                yield from out.full()
            yield from out.rest()
            yield from cells.to_words(bucket, h)

    return released(run)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers, by Stirling's series from 8 on."""
    small = x < 8
    y = np.where(small, x + 8, x)
    back = np.zeros_like(y)
    if small.any():
        product = np.ones(int(small.sum()))
        for i in range(8):
            product = product * (x[small] + i)
        back[small] = np.log(product)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - back


def uniform(key: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    """The ``number``-th draw of each key, in (0, 1)."""
    with np.errstate(over="ignore"):
        h = mix64(key + np.asarray(number).astype(_U) * _U(0x9E3779B97F4A7C15))
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


_SINGLE, _MANY, _RARE, _AT_ONCE = 32, 32.0, 4096, 1 << 20


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables that ``customers`` of one dish take in turn; ``weight``: (strength + discount * tables) * parent's probability.

    The first opens a table; after j customers at t tables the next opens one with probability
    weight / (weight + j - discount * t). Where many tables are to be expected, all further customers
    are seated at once (``_together``), else the places of the few new tables are drawn (``_leaps``).
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    for j in range(1, _SINGLE):
        if not len(active):
            return tables
        p = weight[active] / (weight[active] + j - discount * tables[active])
        tables[active] += uniform(key[active], j) < p
        active = active[customers[active] > j + 1]
    if len(active):
        expected = weight[active] * np.log1p(customers[active] / weight[active])
        many = (expected > _MANY) & (customers[active] < _RARE * expected)
        for cells, seated in ((active[many], _together), (active[~many], _leaps)):
            tables[cells] = seated(customers[cells], weight[cells], discount, key[cells], tables[cells])
    return tables


def _together(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Tables after the customers from number ``_SINGLE`` on, each with a draw U of its own.

    Customer j opens a table if t > (j - weight (1 - U) / U) / discount, where t counts the tables opened before.
    That has one solution, and it is where iterating from any t ends.
    """
    out, done = tables.copy(), np.full(len(customers), _SINGLE)
    first = 0
    while first < len(customers):
        # As many cells as fit, or a part of one.
        n = customers[first:] - done[first:]
        take = max(1, int(np.searchsorted(np.cumsum(n), _AT_ONCE, "right")))
        at = np.arange(first, first + take)
        n = np.minimum(n[:take], _AT_ONCE)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        j = np.repeat(done[at] - starts, n) + np.arange(n.sum())
        u, w = uniform(np.repeat(key[at], n), j), np.repeat(weight[at], n)
        limit = (j - w * (1 - u) / u) / discount - np.repeat(out[at], n)
        before = np.zeros(len(j), np.int64)
        while True:
            opens = before > limit
            total = np.cumsum(opens)
            now = total - opens
            now -= np.repeat(now[starts], n)
            if (now == before).all():
                break
            before = now
        out[at] += np.add.reduceat(opens, starts, dtype=np.int64)
        done[at] += n
        first += int((done[at] == customers[at]).sum())
    return out


def _leaps(customers: np.ndarray, weight: np.ndarray, discount: float, key: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The same by the places of new tables: of the next m customers none opens one with probability
    G(j - dt + m) G(w + j - dt) / (G(j - dt) G(w + j - dt + m))."""
    tables = tables.copy()
    active, seated, draw = np.arange(len(customers)), np.full(len(customers), _SINGLE), 1 << 62
    while len(active):
        a, base = weight[active], seated - discount * tables[active]
        rest = customers[active] - seated
        u = np.log(uniform(key[active], draw))
        start = log_gamma(base) - log_gamma(base + a)
        none = lambda m: log_gamma(base + m) - log_gamma(base + a + m) - start  # noqa: B023, E731
        opens = none(rest) <= u
        low, high = np.zeros_like(rest), rest.copy()
        while (high - low > 1).any():
            mid = (low + high) // 2
            reached, open_ = none(mid) <= u, high - low > 1
            high, low = np.where(reached & open_, mid, high), np.where(~reached & open_, mid, low)
        tables[active[opens]] += 1
        seated = seated + high
        more = opens & (seated < customers[active])
        active, seated, draw = active[more], seated[more], draw + 1
    return tables


@dataclass(frozen=True)
class Totals:
    """What a sweep needs beyond its bucket: vectors over the numbered words, and the root's totals."""

    by_context: np.ndarray
    by_word: np.ndarray
    tables_of_word: np.ndarray
    customers: int
    tables: int
    base: float
    discount: float
    root_discount: float

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of words in the root, by their customers and tables there."""
        return (customers - self.root_discount * tables + (STRENGTH + self.root_discount * self.tables) * self.base) / (STRENGTH + self.customers)

    def seats(self, customers: np.ndarray, hashes: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of words in the root."""
        weight = (STRENGTH + self.root_discount * self.tables) * self.base
        return seat(customers, np.full(len(customers), weight), self.root_discount, mix64(hashes ^ _U(2 * sweep + 1)))

    def weight(self, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.discount * tables) * root


def _look(table: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether there, place) of each in a sorted table."""
    if not len(table):
        return np.zeros(len(w), bool), np.zeros(len(w), np.int64)
    at = np.minimum(np.searchsorted(table, w), len(table) - 1)
    return table[at] == w, at


def _contexts(cells: Cells, v: np.ndarray) -> np.ndarray:
    """For each cell of a rare context, its context's sum of ``v``."""
    at = _runs(cells.p[RARE_CONTEXT])
    return np.repeat(np.add.reduceat(v, at), np.diff(np.append(at, len(v)))) if len(at) else v


def _far_table(mail: list[np.ndarray]) -> list[np.ndarray]:
    _, w, counts, customers, tables = mail
    order = np.argsort(w)
    return [w[order], counts[order], customers[order], tables[order]]


def _sweep(head: object, totals: object, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One sweep over the buckets: the root's seats of their rare words, a sample if it is time, then the cells' seats."""
    sample = number > BURN_IN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g = Head(**head.value), Totals(**totals.value)
        for bucket, own in by_bucket(batches):
            cells, mail = None, {TO_WORD: [], FROM_WORD: []}
            for kind, rows in kinds_of(own):
                if kind == STATE:
                    cells = Cells.load(rows.column(7)[0].as_py())
                else:
                    mail[kind].append(rows)
            none = [np.zeros(0, np.int64)] * 3
            cells = cells or Cells(none, list(none), list(none), list(none), [list(none) for _ in range(max(0, number - BURN_IN - 1))])
            src, w, n, c, _ = plain_columns(mail[TO_WORD])
            p, q, t = cells.p[RARE_WORD], cells.q[RARE_WORD], cells.t[RARE_WORD]
            words, at = np.unique(np.concatenate([p, w]), return_inverse=True)
            customers = np.bincount(at, np.concatenate([t, n]), len(words)).astype(np.int64)
            counts = np.bincount(at, np.concatenate([cells.c[RARE_WORD], c]), len(words)).astype(np.int64)
            tables = g.seats(customers, h.hash_of(words), number)
            root = g.root(customers, tables)
            far = _far_table(plain_columns(mail[FROM_WORD]))
            if sample:
                cells.samples.append([v.copy() for v in cells.t])
                cells.words.append([words, counts, customers, tables])
                if number > BURN_IN + 1:
                    cells.far.append(far)
            # New seats, of cells with two customers or more.
            u0, w0 = np.divmod(cells.p[BOTH], len(h.words))
            heads = g.root(g.by_word, g.tables_of_word)
            fq = cells.q[RARE_CONTEXT]
            there, place = _look(far[0], fq)
            beyond = g.root(far[2], far[3])[place] if len(far[0]) else np.zeros(len(fq))
            unknown = g.root(np.zeros(1), np.zeros(1))[0]
            jobs = (
                (BOTH, u0, w0, lambda i: g.weight(g.by_context[u0[i]], heads[w0[i]])),
                (RARE_CONTEXT, cells.p[RARE_CONTEXT], fq, lambda i: g.weight(_contexts(cells, cells.t[RARE_CONTEXT])[i], np.where(fq >= 0, heads[np.maximum(fq, 0)], np.where(there, beyond, unknown))[i])),
                (RARE_WORD, q, p, lambda i: g.weight(g.by_context[q[i]], root[at[: len(p)][i]])),
            )
            new = []
            for k, u, v, weight in jobs:
                i = np.flatnonzero(cells.c[k] > 1)
                seats = cells.t[k].copy()
                with np.errstate(over="ignore"):
                    key = mix64(h.hash_of(u[i]) * _U(0x9E3779B97F4A7C15) + (h.hash_of(v[i]) ^ _U(2 * number)))
                seats[i] = seat(cells.c[k][i], weight(i), g.discount, key)
                new.append(seats)
            cells.t = new
            learned = counts > 0
            rare = [int(learned.sum()), int((counts == 1).sum()), int((counts == 2).sum()), int(tables.sum()), int(customers.sum())]
            out = Out()
            out.add(bucket, STATE, cells.dump())
            out.add(bucket, SUMS, cells.sums(h, rare))
            yield from out.rest()
            yield from cells.to_words(bucket, h)
            back = at[len(p) :]
            yield from plain_rows(FROM_WORD, src, np.full(len(w), bucket), w, counts[back], customers[back], tables[back])

    return released(run)


def _hot_cells(head: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Customers and sampled tables of the hot cells in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Head(**head.value)
        for batch in batches:
            for data in batch.column(7).to_pylist():
                cells = Cells.load(data)
                hot, at = h.is_hot(cells.p[BOTH])
                columns = [at[hot], cells.c[BOTH][hot], *(s[BOTH][hot] for s in cells.samples)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["i", "c", *(f"t{s}" for s in range(len(cells.samples)))])

    return released(run)


@dataclass(frozen=True)
class Scorer:
    """The samples' totals; vectors over the numbered words; values of the hot cells."""

    samples: list[Totals]
    context_counts: np.ndarray
    word_counts: np.ndarray
    tokens: int
    vocabulary: int
    hot: list[np.ndarray] = field(default_factory=list)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))

    def model(self, customers: np.ndarray, context: np.ndarray, tables: list[np.ndarray], open_tables: list[np.ndarray], roots: list[np.ndarray]) -> np.ndarray:
        """log10 of the samples' average probability of cells: customers and tables of the cell, those of its context, the root's probability."""
        p = 0.0
        for s, g in enumerate(self.samples):
            own = np.where(customers > 0, customers - g.discount * tables[s], 0.0)
            p = p + (own + (STRENGTH + g.discount * open_tables[s]) * roots[s]) / (STRENGTH + context)
        return np.log10(p / len(self.samples))

    def heads(self) -> list[np.ndarray]:
        return [g.root(g.by_word, g.tables_of_word) for g in self.samples]

    def of_heads(self, u: np.ndarray, w: np.ndarray, c: np.ndarray, t: list[np.ndarray]) -> list[np.ndarray]:
        """Score, base score and whether known, of cells of numbered words."""
        score = self.model(c, self.context_counts[u], t, [g.by_context[u] for g in self.samples], [r[w] for r in self.heads()])
        return fixed(score, self.word_counts[w], self)


def fixed(score: np.ndarray, counts: np.ndarray, s: Scorer) -> list[np.ndarray]:
    return [np.rint(score * _UNIT), np.rint(s.base(counts) * _UNIT), (counts > 0).astype(np.float64)]


def _values(cells: Cells, s: Scorer, h: Head, far: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """For each class of cells their score, base score and whether the word is known."""
    u0, w0 = np.divmod(cells.p[BOTH], len(h.words))
    out = [s.of_heads(u0, w0, cells.c[BOTH], [t[BOTH] for t in cells.samples])]
    heads = s.heads()

    def rare(tables: list[list[np.ndarray]], w: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        roots, counts = [], np.zeros(len(w), np.int64)
        for (words, n, customers, seats), g in zip(tables, s.samples, strict=True):
            there, at = _look(words, w)
            unknown = g.root(np.zeros(1), np.zeros(1))[0]
            roots.append(np.where(there, g.root(customers, seats)[at], unknown) if len(words) else np.full(len(w), unknown))
            counts = np.where(there, n[at], 0) if len(words) else counts
        return roots, counts

    q = cells.q[RARE_CONTEXT]
    beyond, counts = rare(far, q)
    near = np.maximum(q, 0)
    roots = [np.where(q >= 0, a[near], b) for a, b in zip(heads, beyond, strict=True)]
    t = [x[RARE_CONTEXT] for x in cells.samples]
    score = s.model(cells.c[RARE_CONTEXT], _contexts(cells, cells.c[RARE_CONTEXT]), t, [_contexts(cells, x) for x in t], roots)
    out.append(fixed(score, np.where(q >= 0, s.word_counts[near], counts), s))
    u = cells.q[RARE_WORD]
    roots, counts = rare(cells.words, cells.p[RARE_WORD])
    score = s.model(cells.c[RARE_WORD], s.context_counts[u], [x[RARE_WORD] for x in cells.samples], [g.by_context[u] for g in s.samples], roots)
    out.append(fixed(score, counts, s))
    return out


def _added(values: list[np.ndarray], index: np.ndarray, more: list[np.ndarray], rows: int) -> np.ndarray:
    """Sums by row of the tokens' values."""
    n, row, times = more
    cell = np.repeat(index, n)
    return np.stack([np.bincount(row, v[cell] * times, rows) for v in values] + [np.bincount(row, minlength=rows)])


def _score(head: object, scorer: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each bucket's share of the documents' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, s = Head(**head.value), Scorer(**scorer.value)
        s.samples[:] = [g if isinstance(g, Totals) else Totals(**g) for g in s.samples]
        for _, own in by_bucket(batches):
            cells, mail, values = None, [], None
            sums, at, out = None, None, Out()

            def done() -> Iterator[pa.RecordBatch]:
                if sums is not None:  # noqa: B023
                    i = np.flatnonzero(sums[3])  # noqa: B023
                    out.add(0, TOKEN, pack(deltas(i), *(-sums[k][i] for k in range(2)), sums[2][i]), chunk=at)  # noqa: B023
                    yield from out.full()  # noqa: B023

            for kind, rows in kinds_of(own):
                if kind == STATE:
                    cells = Cells.load(rows.column(7)[0].as_py())
                elif kind == FROM_WORD:
                    mail.append(rows)
                elif kind == HOT:
                    for chunk, n, data in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("chunk", "x", "data")), strict=True):
                        index, *more = unpack(data)
                        found = _added(s.hot, np.cumsum(index), more, int(more[1].max()) + 1)
                        i = np.flatnonzero(found[3])
                        out.add(0, HOT, pack(deltas(i), *(-found[k][i] for k in range(2)), found[2][i]), chunk=chunk)
                        yield from out.full()
                else:
                    if values is None:
                        values = _values(cells, s, h, [*cells.far, _far_table(plain_columns(mail))])
                    for chunk, cls, n, data, more in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("chunk", "code", "x", "data", "more")), strict=True):
                        found = _added(values[cls], np.cumsum(unpack(data)[0]), unpack(more), n)
                        if chunk == at:
                            sums = sums + found
                        else:
                            yield from done()
                            sums, at = found, chunk
            yield from done()
            yield from out.rest()

    return released(run)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk with the sums of their shares."""
    for _, own in by_bucket(batches, "chunk"):
        docs: list[np.ndarray] = []
        shares: list[list[np.ndarray]] = []
        for _, rows in kinds_of(own):
            for kind, data in zip(rows.column(1).to_pylist(), rows.column(7).to_pylist(), strict=True):
                if kind == DOC:
                    docs = unpack(data)
                else:
                    shares.append(unpack(data))
                    if len(shares) > 64:
                        shares = [_joined(shares)]
        ids, valid, train, n = docs
        total = np.zeros((3, len(ids)))
        for i, *v in shares:
            total[:, np.cumsum(i)] += v
        columns = [pa.array(ids, mask=valid == 0), pa.array(train == 0), pa.array(n), pa.array(total[2].astype(np.int64)), pa.array(-total[1] / _UNIT), pa.array(-total[0] / _UNIT)]
        yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _joined(shares: list[list[np.ndarray]]) -> list[np.ndarray]:
    i = np.concatenate([np.cumsum(s[0]) for s in shares])
    rows, at = np.unique(i, return_inverse=True)
    return [deltas(rows), *(np.bincount(at, np.concatenate([s[k] for s in shares]), len(rows)) for k in (1, 2, 3))]


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones + twos else 0.5


def train_and_score(spark: SparkSession, docs: DataFrame, most: int = HEAD, tokens: int = TOKENS) -> DataFrame:
    """Learn from nine tenths of ``docs`` and score all of them. ``most`` and ``tokens`` (a bucket) change the cost alone."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 10) != 0).alias("train"), "text")
    share = lambda v: spark.sparkContext.broadcast(vars(v))
    with Scratch(spark, "language-model") as scratch:

        def written(rows: DataFrame) -> str:
            return scratch.parted(rows, "kind")

        h = choose_head(texts, scratch, most, tokens)
        head, n = share(h), h.buckets

        def totals_of(path: str) -> tuple[list[np.ndarray], np.ndarray]:
            """by_context, by_word of the tables and of the counts; totals."""
            *vectors, scalars = tree_sum(read(spark, path, SUMS), n, scratch.table) or [np.zeros(len(h.words) + k, np.int64) for k in (1, 0, 1, 0)] + [np.zeros(9, np.int64)]
            return vectors, scalars

        path = built = written(dealt(texts.mapInArrow(_dealt_tokens(head), ROW), n).mapInArrow(_build(head), ROW))
        vectors, scalars = totals_of(path)
        context_counts, word_counts = vectors[2], vectors[3]
        learned, cells1, cells2 = int(scalars[0]), int(scalars[2]), int(scalars[3])
        discount, root_discount, base, root_tables = _discount(cells1, cells2), 0.5, 1.0 / (learned + 1), 0
        samples: list[Totals] = []
        vocabulary = 0
        for k in range(1, BURN_IN + SAMPLES + 1):
            now = Totals(vectors[0], vectors[1], np.zeros(0, np.int64), int(scalars[1]), root_tables, base, discount, root_discount)
            now = Totals(now.by_context, now.by_word, now.seats(now.by_word, h.words.view(_U), k), now.customers, root_tables, base, discount, root_discount)
            step = share(now)
            after = written(dealt(read(spark, path, STATE, TO_WORD, FROM_WORD), n).mapInArrow(_sweep(head, step, k), ROW))
            for kind in (STATE, TO_WORD, FROM_WORD, SUMS):
                scratch.remove(f"{path}/kind={kind}")
            path = after
            vectors, scalars = totals_of(path)
            root_tables = int(now.tables_of_word.sum() + scalars[7])
            if k == 1:
                vocabulary = int((word_counts > 0).sum() + scalars[4])
                base = 1.0 / (vocabulary + 1)
                root_discount = _discount(int((word_counts == 1).sum() + scalars[5]), int((word_counts == 2).sum() + scalars[6]))
            if k > BURN_IN:
                samples.append(Totals(now.by_context, now.by_word, now.tables_of_word, now.customers, root_tables, base, discount, root_discount))
            step.unpersist()
        s = Scorer(samples, context_counts, word_counts, learned, vocabulary)
        schema = ", ".join(["i long", "c long", *(f"t{i} long" for i in range(SAMPLES))])
        # At most 2^20 rows: see choose_head.
        hot = read(spark, path, STATE).mapInArrow(_hot_cells(head), schema).orderBy("i").toArrow()
        u, w = np.divmod(h.hot[hot.column("i").to_numpy()], len(h.words))
        of_hot = [np.zeros(len(h.hot)) for _ in range(3)]
        for column, v in zip(of_hot, s.of_heads(u, w, hot.column("c").to_numpy(), [hot.column(f"t{i}").to_numpy() for i in range(SAMPLES)]), strict=True):
            column[hot.column("i").to_numpy()] = v
        scorer = share(Scorer([vars(g) for g in samples], context_counts, word_counts, learned, vocabulary, of_hot))
        parts = read(spark, path, STATE, FROM_WORD).unionByName(read(spark, built, TOKEN, HOT))
        shares = dealt(parts, n, "chunk").mapInArrow(_score(head, scorer), ROW)
        whole = read(spark, built, DOC).unionByName(shares).repartition(max(n, shuffle_partitions(spark)), "chunk").sortWithinPartitions("chunk", "kind")
        scored = whole.mapInArrow(released(_per_document), _SCORED)
        return scratch.result(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(learned).cast("long").alias("train_tokens"), "base_score", "score"))
