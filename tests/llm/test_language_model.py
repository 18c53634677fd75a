"""The language model against dictionaries and single customers; equal scores however the rows are dealt."""

from __future__ import annotations

import collections
import math
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from tidemark.llm import language_model as lm
from tidemark.llm.blocks import deltas, pack, unpack
from tidemark.llm.textnum import Words, mix64
from tidemark.runtime import Scratch

SCHEMA = "doc_id long, text string"
U = np.uint64


def corpus(n: int = 32, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(int(rng.expovariate(0.06)), 90)}" for _ in range(rng.randrange(1, 25)))) for i in range(n)]


def word_codes(text: str) -> list[int]:
    data = (text or "").encode()
    own = lm.canonical(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash).tolist()
    return [lm.START, *own, lm.END]


def one_by_one(customers: int, weight: float, discount: float, key: int) -> int:
    tables = min(customers, 1)
    for j in range(1, customers):
        tables += bool(lm.uniform(np.array([key], U), j)[0] < weight / (weight + j - discount * tables))
    return tables


def brute_force(rows: list[tuple], head: set[int]) -> dict[int, float]:
    """Every restaurant, table and draw in dictionaries."""
    bits = lambda code: U(code & (2**64 - 1))
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    cells = collections.Counter(p for t in train for p in zip(word_codes(t), word_codes(t)[1:], strict=False))
    counts = collections.Counter(w for t in train for w in word_codes(t)[1:])
    context = collections.Counter()
    for (u, _), c in cells.items():
        context[u] += c
    ones, twos = (sum(c == k for c in cells.values()) for k in (1, 2))
    discount = float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9))
    seats, root_discount, base, root_tables = dict.fromkeys(cells, 1), 0.5, 1 / (sum(cells.values()) + 1), 0
    before: dict[int, float] = {}
    samples = []
    rare = lambda v: v not in head and v != lm.START
    for k in range(1, lm.BURN_IN + lm.SAMPLES + 1):
        opened, customers = collections.Counter(), collections.Counter()
        for (u, w), t in seats.items():
            opened[u] += t
            customers[w] += t
        total = sum(seats.values())
        weight = (1 + root_discount * root_tables) * base
        tables = {w: one_by_one(n, weight, root_discount, int(mix64(np.array([bits(w) ^ U(2 * k + 1)]))[0])) for w, n in customers.items()}
        root = lambda w, at=root_tables, d=root_discount, b=base, n=customers, t=tables, m=total: (n.get(w, 0) - d * t.get(w, 0) + (1 + d * at) * b) / (1 + m)
        if k > lm.BURN_IN:
            exact = sum(tables.values())
            samples.append((dict(seats), opened, lambda w, d=root_discount, b=base, n=customers, t=tables, m=total, at=exact: (n.get(w, 0) - d * t.get(w, 0) + (1 + d * at) * b) / (1 + m)))
        new = {}
        for (u, w), c in cells.items():
            # Of rare words after rare ones the seats of the sweep before are known.
            parent = root(w)
            if rare(u) and rare(w):
                n, t = before.get(w, (0, 0))
                parent = (n - root_discount * t + (1 + root_discount * root_tables) * base) / (1 + total)
            with np.errstate(over="ignore"):
                key = int(mix64(np.array([bits(u) * U(0x9E3779B97F4A7C15) + (bits(w) ^ U(2 * k))]))[0])
            new[u, w] = one_by_one(c, (1 + discount * opened[u]) * parent, discount, key)
        before = {w: (customers[w], tables[w]) for w in customers}
        seats, root_tables = new, sum(tables.values())
        if k == 1:
            base = 1 / (len(counts) + 1)
            root_discount = lm._discount(*(sum(c == n for c in counts.values()) for n in (1, 2)))

    def probability(u: int, w: int) -> float:
        p = 0.0
        for t, opened, root in samples:
            own = cells[u, w] - discount * t[u, w] if (u, w) in t else 0.0
            p += (own + (1 + discount * opened[u]) * root(w)) / (1 + context[u])
        return p / len(samples)

    # A distribution over the known words and the unknown one.
    for u in (lm.START, lm.END, next(iter(counts)), -5):
        assert math.isclose(sum(probability(u, w) for w in counts) + probability(u, -7), 1, rel_tol=1e-9)
    return {i: sum(math.log10(probability(u, w)) for u, w in zip(word_codes(t), word_codes(t)[1:], strict=False)) for i, t in rows}


@pytest.mark.parametrize("most", [0, 12, 1 << 17])
def test_scores_equal_brute_force(spark, most):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    with Scratch(spark, "test") as scratch:
        head = set(lm.choose_head(docs, scratch, most, 100).words.tolist())
    want = brute_force(rows, head)
    got = {r.doc_id: r.score for r in lm.train_and_score(spark, docs, most, tokens=100).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_scores_do_not_depend_on_partitions_or_buckets(spark):
    rows = [*corpus(200, 9), *((1000 + i, "a b a b a b the end of all") for i in range(150))]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [{r.doc_id: (r.score, r.base_score) for r in lm.train_and_score(spark, docs.repartition(n), tokens=size).collect()} for n, size in ((1, 10**6), (8, 300), (13, 1000))]
    assert found[0] == found[1] == found[2]


def test_hot_cells_give_what_others_give(spark, monkeypatch):
    rows = [*corpus(64), *((1000 + i, "a b a b c") for i in range(300))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with Scratch(spark, "test") as scratch:
        assert len(lm.choose_head(docs, scratch, lm.HEAD, 500).hot)
    some = {r.doc_id: r.score for r in lm.train_and_score(spark, docs, tokens=500).collect()}
    monkeypatch.setattr(lm, "_HOT_LEAST", 1 << 40)
    assert some == {r.doc_id: r.score for r in lm.train_and_score(spark, docs, tokens=500).collect()}


def test_seating_in_jumps_has_the_distribution_of_single_customers():
    n, rng = 20_000, np.random.default_rng(0)
    for customers, weight, discount in ((200, 5.0, 0.5), (100, 300.0, 0.8), (500, 0.05, 0.3)):
        got = lm.seat(np.full(n, customers), np.full(n, weight), discount, mix64(np.arange(n, dtype=U)))
        want = np.ones(n)
        for j in range(1, customers):
            want += rng.random(n) < weight / (weight + j - discount * want)
        assert abs(got.mean() - want.mean()) < 5 * want.std() / math.sqrt(n) + 1e-3
        assert got.std() == pytest.approx(want.std(), rel=0.05)
        assert got.min() >= 1 and got.max() <= customers


def test_seating_together_is_seating_one_by_one(monkeypatch):
    customers, weight = np.array([33, 700, 90, 5000, 40, 2100]), np.array([30.0, 55.5, 400.0, 900.0, 12.0, 7.5])
    key = mix64(np.arange(6, dtype=U))
    monkeypatch.setattr(lm, "_MANY", 0.0)
    want = [one_by_one(int(c), float(w), 0.7, int(k)) for c, w, k in zip(customers, weight, key, strict=True)]
    for at_once in (1 << 20, 1000, 50):
        monkeypatch.setattr(lm, "_AT_ONCE", at_once)
        assert lm.seat(customers, weight, 0.7, key).tolist() == want


def test_log_gamma():
    x = np.array([0.1, 0.5, 1.0, 3.3, 7.99, 8.0, 55.5, 1e6, 1e12])
    assert lm.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_blocks_keep_numbers():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(2**63), 2**63 - 1, 1000), np.arange(5), np.zeros(0, np.int64), rng.integers(0, 300, 77), rng.integers(0, 2**40, 3)]
    back = unpack(pack(*columns))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, back, strict=True))
    up = np.sort(columns[0])
    assert (np.cumsum(deltas(up)) == up).all()


_MEMORY = """
import numpy as np, pyarrow as pa
from types import SimpleNamespace as Some
from tidemark.llm import language_model as lm
from tidemark.llm.textnum import Words, utf8

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

def batches(n):
    rng = np.random.default_rng(0)
    for _ in range(n):
        words = rng.integers(0, 100000, (1000, 400)).astype("U")
        yield pa.record_batch([pa.array(np.arange(1000)), pa.array(np.ones(1000, bool)), pa.array([" ".join(r) for r in words])], names=["doc_id", "train", "text"])

lm.TaskContext = Some(get=lambda: Some(partitionId=lambda: 0))
head = Some(value=vars(lm.Head(np.array([lm.END]), np.zeros(0, np.int64), 8)))
list(batches(2))
before = resident()
for _ in lm._dealt_tokens(head)(batches(8)):
    pass
print(resident() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_its_memory_back():
    """After a task of some blocks a worker is about as large as before it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    grown = subprocess.run([sys.executable, "-c", _MEMORY], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout
    assert float(grown) < 45, grown
