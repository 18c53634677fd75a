"""Python workers live on between tasks: what a task's function leaves in them."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

_MEMORY = """
import pickle
from types import SimpleNamespace as Some
import numpy as np, pyarrow as pa
from pyspark import cloudpickle
from tidemark.llm import ngram_join, substrings
from tidemark.llm import blocks
from tidemark.runtime import ship_by_value

class Docs:
    # What the operator hands to mapInArrow, as a worker gets it.
    def __init__(self):
        self.given = []
    def mapInArrow(self, run, schema):
        self.given.append(cloudpickle.dumps(run))
        raise StopIteration
    def select(self, *_): return self
    filter = agg = select
    def first(self): return [0]

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

ship_by_value()
docs, scratch = Docs(), Some(table=lambda t: t)
ngram_join.F = substrings.F = Some(col=lambda c: Some(cast=lambda t: Some(alias=lambda n: None)), **{n: lambda *a: 0 for n in ("coalesce", "sum", "length", "lit", "pmod", "xxhash64")})
for ask in (lambda: ngram_join.link(None, docs, scratch), lambda: substrings._hot_keys(docs, 5, 47, 0.8)):
    try:
        ask()
    except StopIteration:
        pass
assert len(docs.given) == 2
words = np.random.default_rng(0).integers(0, 100000, (1000, 400)).astype("U")
batch = pa.record_batch([pa.array(np.arange(1000)), pa.array([" ".join(r) for r in words])], names=["doc_id", "text"])
import pyspark
pyspark.TaskContext.get = classmethod(lambda cls: Some(partitionId=lambda: 0))
for raw in docs.given:
    sizes = []
    for _ in range(7):
        run = pickle.loads(raw)
        for _ in run(iter([batch])):
            pass
        sizes.append(resident())
    print(sizes[-1] - sizes[0])
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_tasks_leave_nothing_in_a_worker():
    """Seven tasks one after the other, each with its own copy of the function, as in a worker."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", _MEMORY], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    grown = [float(x) for x in done.stdout.split()]
    assert len(grown) == 2 and max(grown) < 40, grown
