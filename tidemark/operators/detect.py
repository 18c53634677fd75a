"""Anomaly detection in layers: predictors, scorers, deciders, and detectors made of them.

Scores stand in column ``score`` (or under the input's names), labels in ``label``. Fitting
runs aggregates; what it learns are numbers, so running is one lazy plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import Fitted, Learnable, NotFitted, Operator, as_double, create, param, register
from tidemark.operators.features import axes, covariance, linear
from tidemark.runtime import Scratch, shuffle_partitions

KIND = "detection"


def _mean(cells: list[Column]) -> Column:
    return sum(cells[1:], cells[0]) / len(cells)


def residual(real: Column, pred: Column, metric: str) -> Column:
    return F.pow(real - pred, F.lit(2.0)) if metric == "mse" else F.abs(real - pred)


METRIC = {"choices": ("mse", "mae")}


@register("threshold_decider", KIND)
@dataclass(frozen=True)
class Threshold(Operator):
    """label = 1 where the score exceeds a threshold."""

    threshold: float = param(3.0, gt=0)
    score: str = "score"

    def run(self, df: DataFrame) -> DataFrame:
        return df.withColumn("label", (F.col(self.score) > self.threshold).cast("int"))


def exact_percentile(df: DataFrame, column: str, share: float, most: int = 10_000) -> float | None:
    """The interpolated percentile, as ``F.percentile`` has it; that holds all distinct values in one task.

    The two values around the place are counted down to: approximate percentiles narrow a range until it has
    ``most`` distinct values or fewer, and the rows below it are counted.
    """
    with Scratch(df.sparkSession, "percentile") as scratch:
        v = scratch.table(df.select(F.col(column).cast("double").alias("v")).filter("v is not null"))
        n = v.count()
        if not n:
            return None
        place = (n - 1) * share
        first, second = math.floor(place), math.ceil(place)
        below, inside, rows = 0, v, n
        while rows > most:
            edges = [max(0.0, (first - below) / rows - 0.001), min(1.0, (second - below + 1) / rows + 0.001)]
            low, high = inside.agg(F.percentile_approx("v", edges, 10_000)).first()[0]
            part = inside.filter(F.col("v").between(low, high))
            under, kept = inside.agg(F.count_if(F.col("v") < F.lit(low)), F.count_if(F.col("v").between(low, high))).first()
            if 2 * kept > rows or not below + under <= first <= second < below + under + kept:
                break
            below, inside, rows = below + under, part, kept
        counts = inside.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").limit(most + 1).collect()
        if len(counts) > most:
            # Nothing narrower: by the sort of all.
            return v.agg(F.percentile("v", F.lit(share))).first()[0]
        at, found = below, {}
        for r in counts:
            for i in (first, second):
                if at <= i < at + r["n"]:
                    found[i] = r["v"]
            at += r["n"]
    a, b = found[first], found[second]
    return a if first == second or a == b else (second - place) * a + (place - first) * b


@register("percentile_decider", KIND)
@dataclass(frozen=True)
class Percentile(Learnable):
    """label = 1 where the score exceeds a percentile (exact, interpolated) of the training scores."""

    percentile: float = param(95.0, gt=0, lt=100)
    score: str = "score"

    def fit(self, df: DataFrame) -> Fitted:
        return Fitted(self, {"threshold": exact_percentile(df, self.score, self.percentile / 100)})

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        return df.withColumn("label", (F.col(self.score) > F.lit(state["threshold"])).cast("int"))


@register("zscore_scorer", KIND)
@dataclass(frozen=True)
class ZScore(Learnable):
    """The largest |x - mean| / deviation over the columns (population deviation, 1 where it is 0)."""

    input_columns: tuple[str, ...] = ()
    threshold: float = param(3.0, ge=1, le=10)

    def fit(self, df: DataFrame) -> Fitted:
        self.require(df, self.input_columns)
        row = df.agg(*[f(as_double(c)).alias(f"{n}{i}") for i, c in enumerate(self.input_columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return Fitted(self, {"mean": [row[f"m{i}"] for i in range(len(self.input_columns))], "std": [row[f"s{i}"] or 1.0 for i in range(len(self.input_columns))]})

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        cells = [F.abs(as_double(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.input_columns, state["mean"], state["std"], strict=True)]
        return df.withColumn("score", F.greatest(*cells) if len(cells) > 1 else cells[0])


@register("residual_scorer", KIND)
@dataclass(frozen=True)
class Residual(Operator):
    """Mean over column pairs of the squared or absolute residual; the cells' own residuals as ``residual_{column}``."""

    real: tuple[str, ...] = ()
    pred: tuple[str, ...] = ()
    metric: str = param("mse", **METRIC)
    cells: bool = False

    def run(self, df: DataFrame) -> DataFrame:
        if len(self.real) != len(self.pred) or not self.real:
            raise ValueError("real and pred must name equally many columns")
        parts = [residual(as_double(r), as_double(p), self.metric) for r, p in zip(self.real, self.pred, strict=True)]
        named = [c.alias(f"residual_{r}") for r, c in zip(self.real, parts, strict=True)] if self.cells else []
        return df.select("*", *named, _mean(parts).alias("score"))


@register("residual_map_scorer", KIND)
@dataclass(frozen=True)
class ResidualMap(Operator):
    """The residual of every column pair, under ``score_{column}``."""

    real: tuple[str, ...] = ()
    pred: tuple[str, ...] = ()
    metric: str = param("mse", **METRIC)

    def run(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[residual(as_double(r), as_double(p), self.metric).alias(f"score_{r}") for r, p in zip(self.real, self.pred, strict=True)])


@dataclass(frozen=True)
class _Pca(Learnable):
    input_columns: tuple[str, ...] = ()
    n_components: int = param(2, ge=1)

    def _state(self, df: DataFrame) -> dict[str, Any]:
        self.require(df, self.input_columns)
        means, cov, _ = covariance(df, self.input_columns)
        v, values = axes(cov, min(self.n_components, len(self.input_columns)))
        total = values.sum()
        return {"means": means.tolist(), "projection": (v.T @ v).tolist(), "explained_variance_ratio": (values[: len(v)] / total if total > 0 else values[: len(v)] * 0).tolist()}

    def _pred(self, state: dict[str, Any]) -> list[Column]:
        """The rows' projections on the kept axes, in the original coordinates; no axis's sign matters."""
        return [linear(self.input_columns, w, state["means"]) + F.lit(m) for w, m in zip(state["projection"], state["means"], strict=True)]


@register("pca_predictor", KIND)
@dataclass(frozen=True)
class PcaPredictor(_Pca):
    """Reconstruction from the leading axes, as ``{column}_pred``; the state tells the explained ratio."""

    def fit(self, df: DataFrame) -> Fitted:
        return Fitted(self, self._state(df))

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        return df.select("*", *[p.alias(f"{c}_pred") for c, p in zip(self.input_columns, self._pred(state), strict=True)])


@register("pca_scorer", KIND)
@dataclass(frozen=True)
class PcaScorer(_Pca):
    """Mean residual of the reconstruction."""

    n_components: int = param(3, ge=1)
    metric: str = param("mse", **METRIC)

    def fit(self, df: DataFrame) -> Fitted:
        return Fitted(self, self._state(df))

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        return df.withColumn("score", _mean([residual(as_double(c), p, self.metric) for c, p in zip(self.input_columns, self._pred(state), strict=True)]))


#: Rows of a block of training points that a task holds at a time.
BLOCK = 20_000
#: Training rows from which on the queries are dealt anew.
PARALLEL = 1000


@register("knn_scorer", KIND)
@dataclass(frozen=True)
class Knn(Learnable):
    """Maximum, mean or median distance to the nearest training rows; a training row is its own neighbour.

    Training points are dealt into blocks of ``BLOCK`` rows. Each block is broadcast in turn
    (its size is fixed) and the queries keep their ``n_neighbors`` least distances so far,
    so neither side has to fit in one task.
    """

    input_columns: tuple[str, ...] = ()
    n_neighbors: int = param(5, ge=1, le=20)
    metric: str = param("euclidean", choices=("euclidean", "manhattan"))
    aggregate: str = param("maximum", choices=("maximum", "mean", "median"))

    def fit(self, df: DataFrame) -> FittedKnn:
        self.require(df, self.input_columns)
        train = df.select(*[as_double(c).alias(c) for c in self.input_columns])
        return FittedKnn(self, {"rows": train.count()}, train)

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        """With the training rows of a saved model."""
        if "train" not in state:
            raise NotFitted("a nearest-neighbour model keeps its training rows in a table; save it, and load it with them")
        return FittedKnn(self, state, df.sparkSession.read.parquet(state["train"])).run(df)


@dataclass(frozen=True)
class FittedKnn(Fitted):
    train: DataFrame

    def save(self, spark: Any, path: str) -> None:
        """The training rows go to a folder beside the state, which Spark's text reader passes over."""
        Fitted(self.spec, self.stored(path)).save(spark, path)
        self.train.write.mode("overwrite").parquet(self.stored(path)["train"])

    def stored(self, path: str, number: int = 0) -> dict[str, Any]:
        return self.state | {"train": f"{path}/_train{number}"}

    def run(self, df: DataFrame) -> DataFrame:
        spec, n = self.spec, self.state["rows"]
        k, blocks = min(spec.n_neighbors, n), -(-n // BLOCK)
        out, parts = df, shuffle_partitions(df.sparkSession)
        # A table of one file is one task, however many rows it has.
        if n > PARALLEL:
            out = out.repartition(parts)
        out = out.withColumn("_near", F.array().cast("array<double>"))
        # By the row and not its values alone: many equal points are several blocks.
        dealt = self.train.withColumn("_block", F.pmod(F.xxhash64(*spec.input_columns, F.monotonically_increasing_id()), F.lit(blocks)))
        for b in range(blocks):
            points = dealt.filter(F.col("_block") == b).drop("_block").toPandas().to_numpy(float)
            out = _nearer(out, list(spec.input_columns), points, k, spec.metric)
        value = {"maximum": F.array_max("_near"), "mean": F.aggregate("_near", F.lit(0.0), lambda a, x: a + x) / F.size("_near")}.get(spec.aggregate)
        if value is None:
            value = (F.get("_near", F.floor((F.size("_near") - 1) / 2).cast("int")) + F.get("_near", F.floor(F.size("_near") / 2).cast("int"))) / 2
        return out.withColumn("score", value).drop("_near")


def _distances(x: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    gap = x - points
    return np.abs(gap).sum(axis=-1) if metric == "manhattan" else np.sqrt((gap**2).sum(axis=-1))


class _Block:
    """Training points that find the ones near a query by bounds on approximate distances; distances are exact.

    The bounds are one product of matrices in 32 bits, whose rounding is bounded as well: of the euclidean distance
    itself, of the manhattan distance over the columns in which two points are of different cells. Equal points are one, with a count.
    """

    ROWS, AT_ONCE, CELLS, MOST = 256, 1 << 16, 4, 1e150

    def __init__(self, points: np.ndarray, k: int, metric: str):
        finite = (np.abs(points) < self.MOST).all(axis=1)
        self.odd = points[~finite]
        self.points, n = np.unique(points[finite], axis=0, return_counts=True)
        self.copies = np.minimum(n, k)
        self.k, self.metric = k, metric

    def _prepare(self, x: np.ndarray) -> None:
        """Points and queries in the narrow type, by the range of both."""
        p, both = self.points, np.concatenate([self.points, x])
        low, high = both.min(axis=0), both.max(axis=0)
        middle = low / 2 + high / 2
        size = np.abs(both - middle).max()
        self.scale = 1 / size if size > 0 and np.isfinite(1 / size) else 1.0
        p, x = (p - middle) * self.scale, (x - middle) * self.scale
        if self.metric == "manhattan":
            # Values of different cells of a column lie in the order of the cells, so their distance is a difference; in one cell it counts as 0.
            cuts = np.quantile(p, np.arange(1, self.CELLS) / self.CELLS, axis=0)
            of_p, of_x = (np.sum([v > c for c in cuts], axis=0) for v in (p, x))
            left, right = [], []
            for c in range(1, self.CELLS):
                base = np.sign(0 - of_x)
                left += [-x * (np.sign(c - of_x) - base), (of_x == c).astype(float)]
                right += [(of_p == c).astype(float), p * (np.sign(of_p - c) - np.sign(of_p))]
            left += [np.ones((len(x), 1)), (-x * np.sign(0 - of_x)).sum(axis=1, keepdims=True)]
            right += [(p * np.sign(of_p)).sum(axis=1, keepdims=True), np.ones((len(p), 1))]
            self.x = np.concatenate(left, axis=1).astype(np.float32)
            self.p = np.ascontiguousarray(np.concatenate(right, axis=1).astype(np.float32).T)
            self.slack = (len(self.p) + 16) * 2.0**-20 * (np.abs(x).sum(axis=1) + np.abs(p).sum(axis=1).max()) + 1e-30
        else:
            norm = (p**2).sum(axis=1)
            self.norm = (x**2).sum(axis=1)
            self.p = np.ascontiguousarray(np.concatenate([p, -norm[:, None] / 2], axis=1).astype(np.float32).T)
            self.x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
            # Rounding of the factors, of a sum of as many products, of the norms and of the threshold.
            self.slack = (p.shape[1] + 16) * 2.0**-22 * (np.sqrt(self.norm) + np.sqrt(norm.max())) ** 2 + 1e-30

    def _candidates(self, x: np.ndarray, at: slice, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) indices of all pairs that can be among the ``k`` nearest; ``known``: the k-th distance so far, or inf."""
        n, slack, k = self.p.shape[1], self.slack[at], self.k
        if self.metric == "manhattan":
            near = self.x[at] @ self.p
            limit = np.minimum(known, 1e150) * self.scale + slack
            if n > 4 * k and not np.isfinite(known).all():
                least = np.argpartition(near, 4 * k, axis=1)[:, : 4 * k]
                limit = np.minimum(limit, np.sort(_distances(x[:, None, :], self.points[least], self.metric), axis=1)[:, k - 1] * self.scale + slack)
            hit = near <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
        else:
            near = self.x[at] @ self.p
            limit = (self.norm[at] - (np.minimum(known, 1e150) * self.scale) ** 2) / 2 - slack
            if n > k and not np.isfinite(known).all():
                limit = np.maximum(limit, np.partition(near, n - k, axis=1)[:, n - k] - 2 * slack)
            # Down to the next number of 32 bits.
            hit = near >= np.nextafter(limit.astype(np.float32), np.float32(-np.inf))[:, None]
        return np.divmod(np.flatnonzero(hit), n)

    def update(self, near: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        """The ascending ``k`` least distances so far of each row, with those to this block's points."""
        out, k = list(near), self.k

        def add(i: int, more: np.ndarray) -> None:
            out[i] = np.sort(np.concatenate([out[i], more]))[:k]

        fine = np.flatnonzero((np.abs(x) < self.MOST).all(axis=1))
        odd = np.setdiff1d(np.arange(len(x)), fine)
        every = np.concatenate([np.repeat(self.points, self.copies, axis=0), self.odd]) if len(odd) else self.odd
        for i in odd:
            add(i, _distances(x[i], every, self.metric))
        if len(self.odd):
            for i in fine:
                add(i, _distances(x[i], self.odd, self.metric))
        if not len(self.points) or not len(fine):
            return out
        self._prepare(x[fine])
        known = np.array([out[i][k - 1] if len(out[i]) >= k else np.inf for i in fine])
        known[np.isnan(known)] = np.inf
        for b in range(0, len(fine), self.ROWS):
            rows, points = self._candidates(x[fine[b : b + self.ROWS]], slice(b, b + self.ROWS), known[b : b + self.ROWS])
            d = np.concatenate([np.zeros(0)] + [_distances(x[fine[b + rows[i : i + self.AT_ONCE]]], self.points[points[i : i + self.AT_ONCE]], self.metric) for i in range(0, len(rows), self.AT_ONCE)])
            edge = np.flatnonzero(np.diff(rows, prepend=-1))
            for lo, hi in zip(edge, [*edge[1:], len(rows)], strict=False):
                add(fine[b + rows[lo]], np.repeat(d[lo:hi], self.copies[points[lo:hi]]))
        self.p = self.x = None
        return out


def _nearer(df: DataFrame, columns: list[str], points: np.ndarray, k: int, metric: str) -> DataFrame:
    """``_near``, the ascending ``k`` least distances so far, brought up to date with some points."""
    block = _Block(points, k, metric)

    @F.pandas_udf("array<double>")
    def update(near: pd.Series, *cells: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cells], axis=1)
        return pd.Series(block.update([np.asarray(p, float) for p in near], x))

    return df.withColumn("_near", update("_near", *[as_double(c) for c in columns]))


@dataclass(frozen=True)
class _Chain(Learnable):
    """Fits its parts one after the other, each on what the parts before it give."""

    def parts(self) -> list[Operator]:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Chain:
        fitted: list[Operator | Fitted] = []
        for part in self.parts():
            step = part.fit(df) if isinstance(part, Learnable) else part
            df = step.run(df)
            fitted.append(step)
        return Chain(self, {"parts": [s.state if isinstance(s, Fitted) else None for s in fitted]}, tuple(fitted))

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        for part, own in zip(self.parts(), state["parts"], strict=True):
            df = part.apply(df, own) if own is not None else part.run(df)  # type: ignore[attr-defined]
        return df


@dataclass(frozen=True)
class Chain(Fitted):
    steps: tuple[Operator | Fitted, ...]

    def save(self, spark: Any, path: str) -> None:
        """The state, and the training rows of nearest-neighbour parts beside it."""
        parts = [s.stored(path, i) if isinstance(s, FittedKnn) else own for i, (s, own) in enumerate(zip(self.steps, self.state["parts"], strict=True))]
        Fitted(self.spec, self.state | {"parts": parts}).save(spark, path)
        for i, s in enumerate(self.steps):
            if isinstance(s, FittedKnn):
                s.train.write.mode("overwrite").parquet(s.stored(path, i)["train"])

    def run(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.run(df)
        return df


@register("zscore_detector", KIND)
@dataclass(frozen=True)
class ZScoreDetector(_Chain):
    """zscore_scorer and a fixed threshold."""

    input_columns: tuple[str, ...] = ()
    threshold: float = param(3.0, ge=1, le=10)

    def parts(self) -> list[Operator]:
        return [ZScore(self.input_columns), Threshold(self.threshold)]


@register("pca_detector", KIND)
@dataclass(frozen=True)
class PcaDetector(_Chain):
    """pca_scorer and a percentile of the training scores."""

    input_columns: tuple[str, ...] = ()
    n_components: int = param(3, ge=1)
    metric: str = param("mse", **METRIC)
    percentile: float = param(95.0, ge=50, le=99.9)

    def parts(self) -> list[Operator]:
        return [PcaScorer(self.input_columns, self.n_components, self.metric), Percentile(self.percentile)]


@register("knn_detector", KIND)
@dataclass(frozen=True)
class KnnDetector(_Chain):
    """knn_scorer and a percentile of the training scores."""

    input_columns: tuple[str, ...] = ()
    n_neighbors: int = param(5, ge=1, le=20)
    metric: str = param("euclidean", choices=("euclidean", "manhattan"))
    aggregate: str = param("maximum", choices=("maximum", "mean", "median"))
    percentile: float = param(95.0, ge=50, le=99.9)

    def parts(self) -> list[Operator]:
        return [Knn(self.input_columns, self.n_neighbors, self.metric, self.aggregate), Percentile(self.percentile)]


PREDICTORS, DECIDERS = {"pca_predictor", "model_predictor"}, {"threshold_decider", "percentile_decider"}


@dataclass(frozen=True)
class _Composite(_Chain):
    """[predictor], scorers in series, and for a detector one decider last, each as {name, config}."""

    operators: tuple[dict[str, Any], ...] = ()
    needs_decider = False

    def __post_init__(self) -> None:
        names = [o["name"] for o in self.operators]
        if len(names) < 2:
            raise ValueError("a composite has two operators or more")
        if any(n in PREDICTORS for n in names[1:]):
            raise ValueError("a predictor can only come first, and only one")
        deciders = [i for i, n in enumerate(names) if n in DECIDERS]
        if self.needs_decider and deciders != [len(names) - 1]:
            raise ValueError("a detector ends with its one decider")
        if not self.needs_decider and deciders:
            raise ValueError("a scorer has no decider")
        if names[0].startswith("residual") and names[0] not in PREDICTORS:
            raise ValueError("a residual needs a predictor before it")

    def parts(self) -> list[Operator]:
        return [create(o["name"], o.get("config")) for o in self.operators]


@register("composite_scorer", KIND)
@dataclass(frozen=True)
class CompositeScorer(_Composite):
    """A predictor and scorers in series."""


@register("composite_detector", KIND)
@dataclass(frozen=True)
class CompositeDetector(_Composite):
    """A predictor and scorers in series with a decider at the end."""

    needs_decider = True


def merge_overlaps(windows: DataFrame, by: list[str], value: str = "score", how: str = "heuristic") -> DataFrame:
    """One score for each point that overlapping windows scored: NaNs apart, the mean, or for ``heuristic``
    the mean plus the population deviation after a tenth (rounded up) is trimmed on either side of more than five values."""
    listed = windows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))
    n = F.size("v")
    if how == "heuristic":
        trim = F.when(n > 5, F.ceil(n * 0.1)).otherwise(0).cast("int")
        listed = listed.withColumn("v", F.when(n > 5, F.slice("v", trim + 1, n - 2 * trim)).otherwise(F.col("v")))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    listed = listed.withColumn("m", mean)
    if how == "mean":
        return listed.select(*by, F.col("m").alias(value))
    spread = F.sqrt(F.aggregate(F.zip_with("v", F.array_repeat(F.col("m"), F.size("v")), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x) / F.size("v"))
    return listed.select(*by, (F.col("m") + spread).alias(value))


Reconstruct = Callable[[np.ndarray], np.ndarray]


def window_model(df: DataFrame, columns: list[str], partition_by: list[str], order_by: list[str], size: int, step: int, model: Reconstruct) -> DataFrame:
    """External reconstruction models: every window of ``size`` rows goes through ``model`` (n x size x columns, both ways).

    Gives partition_by, position, and for each column its residual in each window that holds
    the row; ``merge_overlaps`` makes one score of them.
    """

    order = Window.partitionBy(*partition_by).orderBy(*order_by)
    cells = F.array(*[as_double(c) for c in columns])
    framed = df.select(*partition_by, (F.row_number().over(order) - 1).alias("first"), F.collect_list(cells).over(order.rowsBetween(0, size - 1)).alias("w"))
    framed = framed.filter((F.size("w") == size) & (F.col("first") % step == 0))

    @F.pandas_udf("array<double>")
    def score(w: pd.Series) -> pd.Series:
        x = np.stack([np.stack(v) for v in w]) if len(w) else np.zeros((0, size, len(columns)))
        return pd.Series(list(np.abs(x - model(x)).mean(axis=2)))

    return framed.select(*partition_by, "first", F.posexplode(score("w")).alias("at", "score")).select(*partition_by, (F.col("first") + F.col("at")).alias("position"), "score")


