"""Hyper-parameter search: spaces from operator bounds, samplers, trials, rank sums, tuning histories."""

from __future__ import annotations

import bisect
import dataclasses
import itertools
import json
import math
import warnings
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.base import NotFitted, Operator
from tidemark.runtime import delete


@dataclass(frozen=True)
class Dimension:
    name: str
    kind: str  # float, int or choice
    low: float = 0.0
    high: float = 1.0
    log: bool = False
    step: int = 1
    choices: tuple = ()

    def at(self, u: float) -> Any:
        """The value at ``u`` in [0, 1)."""
        if self.kind == "choice":
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        if self.log:
            v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            v = self.low + u * (self.high - self.low)
        if self.kind == "int":
            steps = int((self.high - self.low) // self.step)
            return int(self.low + self.step * min(round((v - self.low) / self.step), steps))
        return v

    def grid(self, points: int = 11) -> list:
        if self.kind == "choice":
            return list(self.choices)
        if self.kind == "int":
            return list(range(int(self.low), int(self.high) + 1, self.step))
        return [self.at(i / (points - 1)) for i in range(points)]

    def place(self, v: Any) -> float:
        if self.kind == "choice":
            return (self.choices.index(v) + 0.5) / len(self.choices)
        if self.log:
            return (math.log(v) - math.log(self.low)) / (math.log(self.high) - math.log(self.low))
        return (v - self.low) / (self.high - self.low) if self.high > self.low else 0.5


def space(cls: type[Operator], prefix: str = "", **over: tuple) -> list[Dimension]:
    """Dimensions from a spec's bounds and choices; fields without both bounds are left out unless given in ``over``."""
    out = []
    for f in dataclasses.fields(cls):
        m = f.metadata
        if "choices" in m:
            out.append(Dimension(prefix + f.name, "choice", choices=tuple(m["choices"])))
            continue
        low, high = m.get("ge", m.get("gt")), m.get("le", m.get("lt"))
        if f.name in over:
            low, high = over[f.name]
        if low is None or high is None:
            continue
        whole = f.type in ("int", int)
        out.append(Dimension(prefix + f.name, "int" if whole else "float", low, high, m.get("log", False), m.get("step", 1)))
    return out


def composite_space(operators: list[dict[str, Any]]) -> list[Dimension]:
    """Dimensions of a composite's parts, as ``predictor.``, ``scorer_i.`` and ``decider.``."""
    from tidemark.operators.base import REGISTRY
    from tidemark.operators.detect import DECIDERS, PREDICTORS

    out, i = [], 0
    for o in operators:
        if o["name"] in PREDICTORS:
            prefix = "predictor."
        elif o["name"] in DECIDERS:
            prefix = "decider."
        else:
            prefix, i = f"scorer_{i}.", i + 1
        out += space(REGISTRY[o["name"]], prefix)
    return out


@dataclass
class Trial:
    number: int
    params: dict[str, Any]
    scores: dict[str, float] = field(default_factory=dict)
    state: str = "complete"


Objective = Callable[[dict[str, Any]], dict[str, float] | Iterable[dict[str, float]]]


class Pruned(ValueError):
    pass


#: What a trial may fail with and be recorded; anything else is a fault of the objective's code.
FAILURES = (ValueError, ArithmeticError, np.linalg.LinAlgError, PySparkException, NotFitted)


@dataclass
class Search:
    """Random, grid or TPE-like search. ``goals`` says of each score whether it is to be max or min.

    A trial is a function of parameters that runs Spark jobs; ``parallel`` trials run at once
    from driver threads. One that Spark or its numbers fail is recorded as pruned; an error in the
    objective's own code is raised. An objective may yield its scores step by step (say, fold by
    fold): its result is their mean, and with ``median`` a trial whose mean so far is worse than the median
    of at least five earlier trials' at that step is pruned there. With several goals the records'
    sum of ranks counts.
    """

    dimensions: list[Dimension]
    goals: dict[str, str]
    sampler: str = "random"
    seed: int = 0
    parallel: int = 1
    trials: list[Trial] = field(default_factory=list)
    median: bool = False
    _paths: dict[int, list[float]] = field(default_factory=dict, repr=False)

    def _cost(self, scores: dict[str, float], name: str) -> float:
        return -scores[name] if self.goals[name] == "max" else scores[name]

    def ranked(self) -> list[Trial]:
        """The complete trials, the best first: by their sum of ranks over the goals, ties by number."""
        done = [t for t in self.trials if t.state == "complete"]
        sums = dict.fromkeys((t.number for t in done), 0.0)
        for name in self.goals:
            costs = sorted(self._cost(t.scores, name) for t in done)
            for t in done:
                sums[t.number] += bisect.bisect_left(costs, self._cost(t.scores, name))
        return sorted(done, key=lambda t: (sums[t.number], t.number))

    def _stepwise(self, number: int, steps: Iterator[dict[str, float]]) -> dict[str, float]:
        """The mean of yielded scores, unless the median rule stops them."""
        first, seen = next(iter(self.goals)), []
        path = self._paths.setdefault(number, [])
        for scores in steps:
            seen.append(scores)
            path.append(float(np.mean([self._cost(s, first) for s in seen])))
            rivals = [p[len(path) - 1] for n, p in sorted(self._paths.items()) if n < number and len(p) >= len(path)]
            if self.median and len(rivals) >= 5 and path[-1] > np.median(rivals):
                raise Pruned(f"worse than the median at step {len(path)}")
        if not seen:
            raise ValueError("an objective without scores")
        return {n: float(np.mean([s[n] for s in seen])) for n in seen[0]}

    def suggest(self, number: int) -> dict[str, Any]:
        rng = np.random.default_rng([self.seed, number])
        done = self.ranked() if self.sampler == "tpe" else []
        if len(done) >= 10:
            good, bad = done[: max(2, len(done) // 4)], done[max(2, len(done) // 4) :]
            out = {}
            for d in self.dimensions:
                g, b = (np.array([d.place(t.params[d.name]) for t in part]) for part in (good, bad))
                tries = np.clip(rng.choice(g, 24) + rng.normal(0, 0.15, 24), 0, 1 - 1e-9)
                density = lambda x, at: np.exp(-((x[:, None] - at[None, :]) ** 2) / 0.045).mean(axis=1) + 1e-3
                out[d.name] = d.at(float(tries[np.argmax(density(tries, g) / density(tries, b))]))
            return out
        return {d.name: d.at(float(rng.random())) for d in self.dimensions}

    def run(self, objective: Objective, n_trials: int) -> list[Trial]:
        if self.sampler == "grid":
            names = [d.name for d in self.dimensions]
            todo = [dict(zip(names, v, strict=True)) for v in itertools.islice(itertools.product(*[d.grid() for d in self.dimensions]), n_trials)]
        else:
            todo = None

        def one(number: int) -> Trial:
            params = todo[number] if todo is not None else self.suggest(number)
            try:
                scores = objective(params)
                if not isinstance(scores, dict):
                    scores = self._stepwise(number, iter(scores))
                if any(not math.isfinite(v) for v in scores.values()):
                    raise ValueError("a score is not finite")
                return Trial(number, params, scores)
            except FAILURES as e:
                warnings.warn(f"trial {number}: {e}", stacklevel=2)
                return Trial(number, params, {}, "pruned")

        count = n_trials if todo is None else len(todo)
        if self.parallel > 1:
            with ThreadPoolExecutor(self.parallel) as pool:
                for i in range(0, count, self.parallel):
                    self.trials += pool.map(one, range(i, min(i + self.parallel, count)))
        else:
            for i in range(count):
                self.trials.append(one(i))
        return self.trials

    def best(self, top: int = 1) -> list[Trial]:
        return self.ranked()[:top]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.number, json.dumps(t.params, default=str), {k: float(v) for k, v in t.scores.items()}, t.state) for t in self.trials]
        return spark.createDataFrame(rows, "number int, params string, scores map<string,double>, state string")


def folds(df: DataFrame, key: list[str], k: int, seed: int = 0) -> DataFrame:
    """``fold`` 0 to k - 1 by a hash of the key: the same rows get the same fold wherever they are."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, k: int, score: Callable[[DataFrame, DataFrame], dict[str, float]]) -> dict[str, float]:
    """Mean scores over the folds of ``fold``; rows, labels among them, stay together."""
    every = [score(df.filter(F.col("fold") != i), df.filter(F.col("fold") == i)) for i in range(k)]
    return {n: float(np.mean([s[n] for s in every])) for n in every[0]}


def validate(df: DataFrame, score: Callable[[DataFrame, DataFrame], dict[str, float]], key: list[str], given: DataFrame | None = None, k: int | None = None, share: float | None = None, seed: int = 0) -> dict[str, float]:
    """Scores on rows that do not train, by the first that is there: a table of its own, ``k`` folds, a ``share`` drawn by a hash of the key."""
    if given is not None:
        return score(df, given)
    if k is not None:
        if k < 2:
            raise ValueError("cross-validation needs two folds or more")
        return cross_validate(folds(df, key, k, seed), k, score)
    if share is None:
        raise ValueError("validation needs a table, folds or a share")
    if not 0 < share < 1:
        raise ValueError("a share is between 0 and 1")
    kept = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return score(df.filter(~kept), df.filter(kept))


def rank_sums(records: DataFrame, objectives: dict[str, str], order: str, method: str = "ordinal") -> DataFrame:
    """Each record's sum of ranks over the objectives, the least the best.

    ordinal: from 0, ties by ``order``; average: from 1, ties share the mean of their ranks.
    """
    total = F.lit(0.0)
    for name, goal in objectives.items():
        by = F.col(name).desc() if goal == "max" else F.col(name).asc()
        if method == "average":
            w = Window.orderBy(by)
            ties = F.count(F.lit(1)).over(Window.partitionBy(name))
            rank = F.rank().over(w) + (ties - 1) / 2
        else:
            rank = F.row_number().over(Window.orderBy(by, order)) - 1
        total = total + rank
    return records.withColumn("rank_sum", total)


@dataclass
class History:
    """A tuning history: parameters, objectives and records of (x, y), as JSON."""

    task_id: str
    params: dict[str, Any]
    objectives: dict[str, str]
    records: list[dict[str, dict[str, float]]] = field(default_factory=list)

    def append(self, x: dict[str, float], y: dict[str, float]) -> None:
        if set(x) != set(self.params) or set(y) != set(self.objectives):
            raise ValueError("a record must have exactly the history's parameters and objectives")
        if any(isinstance(v, float) and math.isnan(v) for v in y.values()):
            raise ValueError("a record must not have NaN")
        self.records.append({"x": x, "y": y})

    def save(self, spark: SparkSession, path: str) -> None:
        """Written beside the old one first, then put in its place."""
        jvm = spark._jvm
        spark.createDataFrame([(json.dumps(dataclasses.asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.new")
        delete(spark, path)
        old, new = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> History:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()[0]))

    def suggest(self, n: int, dimensions: list[Dimension], seed: int = 0) -> list[dict[str, Any]]:
        """``n`` proposals: random below ten records, then TPE-like on the sum of ranks over the objectives."""
        if len(self.records) < 5:
            warnings.warn(f"{len(self.records)} records: under five, proposals are as good as random", stacklevel=2)
        s = Search(dimensions, self.objectives, "tpe", seed, trials=[Trial(i, r["x"], r["y"]) for i, r in enumerate(self.records)])
        return [s.suggest(len(self.records) + i) for i in range(n)]
