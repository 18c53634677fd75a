"""Feature construction: maps over columns, windows over ordered rows, and features of signal cells."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays, spectral
from tidemark.operators.base import Fitted, Learnable, Operator, TimeKey, as_double, param, register

KIND = "feature_construction"


@dataclass(frozen=True)
class Feature(Operator):
    """A feature that adds columns and keeps rows: ``columns`` gives name and expression of each."""

    input_columns: tuple[str, ...] = ()

    def columns(self) -> dict[str, Column]:
        raise NotImplementedError

    def run(self, df: DataFrame, keep_original: bool = True) -> DataFrame:
        self.require(df, self.input_columns)
        return df.select(*(["*"] if keep_original else []), *[c.alias(n) for n, c in self.columns().items()])


@register("square_feature", KIND)
@dataclass(frozen=True)
class Square(Feature):
    """The square of each column."""

    def columns(self) -> dict[str, Column]:
        return {f"{c}_square": as_double(c) * as_double(c) for c in self.input_columns}


@register("polynomial_feature", KIND)
@dataclass(frozen=True)
class Polynomial(Feature):
    """Powers of each column; every value stands under the column and degree that its name says."""

    degrees: tuple[int, ...] = (2, 3)

    def columns(self) -> dict[str, Column]:
        if not self.degrees:
            raise ValueError("degrees must not be empty")
        return {f"{c}_poly_{d}": F.pow(as_double(c), F.lit(float(d))) for c in self.input_columns for d in self.degrees}


@register("column_median_feature", KIND)
@dataclass(frozen=True)
class ColumnMedian(Feature):
    """The median of some columns of a row, the mean of the middle two for an even number."""

    output_column: str = ""

    def columns(self) -> dict[str, Column]:
        n = len(self.input_columns)
        ranked = F.array_sort(F.array(*[as_double(c) for c in self.input_columns]))
        value = (F.get(ranked, F.lit((n - 1) // 2)) + F.get(ranked, F.lit(n // 2))) / 2
        return {self.output_column or f"{'_'.join(self.input_columns)}_median": value}


def covariance(df: DataFrame, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population covariance and row count in one aggregate; its width is the number of column pairs."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cells = [as_double(c) for c in columns]
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)], *[F.covar_pop(cells[i], cells[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return np.array([row[f"m{i}"] or 0.0 for i in range(d)]), cov, row["n"]


def axes(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvectors (rows; the largest component of each positive) and all eigenvalues, descending."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    v = vectors[:, order[:k]].T
    v *= np.sign(v[np.arange(len(v)), np.argmax(np.abs(v), axis=1)])[:, None]
    return v, values[order]


def linear(columns: tuple[str, ...], weights: list[float], means: list[float]) -> Column:
    terms = [(as_double(c) - F.lit(float(m))) * F.lit(float(w)) for c, w, m in zip(columns, weights, means, strict=True)]
    return sum(terms[1:], terms[0])


@register("pca_feature", KIND)
@dataclass(frozen=True)
class Pca(Learnable):
    """Centred projections on the leading axes of the covariance, as ``pca_i``."""

    input_columns: tuple[str, ...] = ()
    n_components: int = param(2, ge=1)

    def fit(self, df: DataFrame) -> Fitted:
        self.require(df, self.input_columns)
        means, cov, _ = covariance(df, self.input_columns)
        v, _ = axes(cov, min(self.n_components, len(self.input_columns)))
        return Fitted(self, {"means": means.tolist(), "axes": v.tolist()})

    def apply(self, df: DataFrame, state: dict[str, Any], keep_original: bool = True) -> DataFrame:
        return df.select(*(["*"] if keep_original else []), *[linear(self.input_columns, a, state["means"]).alias(f"pca_{i}") for i, a in enumerate(state["axes"])])


PADDINGS = ("edge", "nan", "reflect", "ring")


@register("rolling_mean_feature", KIND)
@dataclass(frozen=True)
class RollingMean(Operator):
    """Mean over ``window_size`` ordered rows: the last ones (right) or the next ones (left).

    Rows without a full window are dropped (padding None), or see the series padded: with its
    edge value, NaN, its mirror image without the edge, itself as a ring, or a number.
    """

    input_columns: tuple[str, ...] = ()
    key: TimeKey | None = None
    window_size: int = param(3, gt=0)
    padding: str | float | None = None
    alignment: str = param("right", choices=("right", "left"))

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.padding, str) and self.padding not in PADDINGS:
            raise ValueError(f"padding: {self.padding!r} is none of {PADDINGS}")

    def run(self, df: DataFrame) -> DataFrame:
        self.require(df, self.input_columns)
        if self.key is None:
            raise ValueError("an explicit row order is needed")
        w, right = self.window_size, self.alignment == "right"
        # For left windows everything runs over the reversed order.
        order = self.key.window() if right else self.key.reversed()
        frame, whole = order.rowsBetween(-(w - 1), 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = df.withColumn("_n", F.count(F.lit(1)).over(frame))
        if self.padding in ("reflect", "ring"):
            out = out.withColumn("_all", F.count(F.lit(1)).over(self.key.whole()))
        if self.padding == "ring":
            out = out.withColumn("_rn", F.row_number().over(order))
            values = F.struct("_rn", *[as_double(c).alias(c) for c in self.input_columns])
            tails = out.filter(F.col("_rn") > F.col("_all") - (w - 1)).groupBy(*self.key.partition_by).agg(F.array_sort(F.collect_list(values)).alias("_tail"))
            out = out.join(tails, list(self.key.partition_by), "left") if self.key.partition_by else out.join(F.broadcast(tails))
        missing = F.lit(w) - F.col("_n")
        for c in self.input_columns:
            x = as_double(c)
            total = F.sum(x).over(frame)
            if self.padding is None:
                value = total / w
            elif self.padding == "nan":
                value = F.when(missing > 0, float("nan")).otherwise(total / w)
            elif self.padding == "edge":
                value = (total + missing * F.first(x).over(whole)) / w
            elif self.padding == "reflect":
                # Near the start the frame of both sides begins at the first row.
                near = F.collect_list(x).over(order.rowsBetween(-(w - 1), w - 1))
                value = (total + F.when(missing > 0, arrays.total(F.slice(near, 2, missing.cast("int")))).otherwise(0.0)) / w
            elif self.padding == "ring":
                tail = F.coalesce(F.col(f"_tail.{c}"), F.array().cast("array<double>"))
                value = (total + F.when(missing > 0, arrays.total(F.slice(tail, F.greatest(F.lit(1), F.lit(w) - missing).cast("int"), missing.cast("int")))).otherwise(0.0)) / w
            else:
                value = (total + missing * F.lit(float(self.padding))) / w
            if self.padding in ("reflect", "ring"):
                value = F.when(F.col("_all") < w, F.raise_error(F.lit("the series is shorter than the window")).cast("double")).otherwise(value)
            out = out.withColumn(f"{c}_rolling_mean", value)
        if self.padding is None:
            out = out.filter(F.col("_n") == w)
        return out.drop("_n", "_all", "_rn", "_tail")


@dataclass(frozen=True)
class Signal(Feature):
    """A feature of array cells."""

    def cell(self, name: str) -> Column:
        return F.col(name).cast("array<double>")


def _scalar(short: str) -> type:
    @register(f"{short}_feature", KIND)
    @dataclass(frozen=True)
    class Scalar(Signal):
        def columns(self) -> dict[str, Column]:
            return {f"{c}_{short}": arrays.SCALAR[short](self.cell(c)) for c in self.input_columns}

    Scalar.__qualname__ = Scalar.__name__ = f"{short.title().replace('_', '')}Feature"
    Scalar.__doc__ = f"The {short.replace('_', ' ')} of each signal cell."
    return Scalar


for _short in arrays.SCALAR:
    _scalar(_short)


@register("average_kurtosis_feature", KIND)
@dataclass(frozen=True)
class AverageKurtosis(Signal):
    """Mean kurtosis of ``n_segments`` equal parts of each signal cell."""

    n_segments: int = param(10, ge=1)

    def columns(self) -> dict[str, Column]:
        return {f"{c}_average_kurtosis": arrays.average_kurtosis(self.cell(c), self.n_segments) for c in self.input_columns}


@dataclass(frozen=True)
class Spectral(Signal):
    """Several spectral features of each signal cell from one kernel call; ``_feature`` operators ask for one."""

    sample_rate: float = param(1.0, gt=0)

    def names(self) -> dict[str, str]:
        raise NotImplementedError

    def options(self) -> dict[str, Any]:
        return {"rate": self.sample_rate}

    def columns(self) -> dict[str, Column]:
        names = self.names()
        structs = {c: spectral.features(self.cell(c), list(names), **self.options()) for c in self.input_columns}
        return {f"{c}_{label}": structs[c][n] for c in self.input_columns for n, label in names.items()}


def _spectral(short: str, label: str) -> None:
    @register(f"{label}_feature", KIND)
    @dataclass(frozen=True)
    class One(Spectral):
        def names(self) -> dict[str, str]:
            return {short: label}

    One.__qualname__ = One.__name__ = f"{label.title().replace('_', '')}Feature"
    One.__doc__ = f"The {label.replace('_', ' ')} of each signal cell."


for _short, _label in {
    "entropy": "spectral_entropy",
    "roughness": "roughness",
    "sharpness": "sharpness",
    "centroid": "spectral_centroid",
    "mean_square_frequency": "mean_square_frequency",
    "rms_frequency": "rms_frequency",
    "frequency_variance": "frequency_variance",
    "frequency_std": "frequency_std",
    "envelope_rms": "envelope_rms",
    "hnr": "hnr",
}.items():
    _spectral(_short, _label)


@dataclass(frozen=True)
class Band(Spectral):
    low: float = param(0.0, ge=0)
    high: float | None = None

    def options(self) -> dict[str, Any]:
        return {"rate": self.sample_rate, "low": self.low, "high": self.high}


def _band(short: str) -> None:
    @register(f"{short}_feature", KIND)
    @dataclass(frozen=True)
    class One(Band):
        def names(self) -> dict[str, str]:
            return {short: f"{short}_{self.low:g}_{'nyquist' if self.high is None else f'{self.high:g}'}"}

    One.__qualname__ = One.__name__ = f"{short.title().replace('_', '')}Feature"
    One.__doc__ = f"The {short.replace('_', ' ')} of each signal cell between two frequencies."


for _short in ("band_rms", "band_kurtosis", "band_hnr"):
    _band(_short)


@register("speed_rpm_feature", KIND)
@dataclass(frozen=True)
class SpeedRpm(Spectral):
    """Rotation speed of each signal cell, by its harmonics."""

    speed_min: float = param(0.0, ge=0)
    speed_max: float = param(6000.0, gt=0)
    n_harmonics: int = param(5, ge=1)
    speed_delta: float = param(10.0, gt=0)
    std_min: float = param(0.01, ge=0)

    def names(self) -> dict[str, str]:
        return {"speed_rpm": "speed_rpm"}

    def options(self) -> dict[str, Any]:
        return {"rate": self.sample_rate, "speed_min": self.speed_min, "speed_max": self.speed_max, "n_harmonics": self.n_harmonics, "speed_delta": self.speed_delta, "std_min": self.std_min}


def _smooth(short: str) -> None:
    @register(f"smooth_{short}_feature", KIND)
    @dataclass(frozen=True)
    class One(Signal):
        win: int = param(30, gt=0)
        stride: int = param(1, gt=0)
        padding_mode: str = param("backward", choices=("forward", "backward", "bidirectional"))

        def columns(self) -> dict[str, Column]:
            return {f"{c}_smooth_{short}_win{self.win}": arrays.smooth(self.cell(c), short, self.win, self.stride, self.padding_mode) for c in self.input_columns}

    One.__qualname__ = One.__name__ = f"Smooth{short.title().replace('_', '')}Feature"
    One.__doc__ = f"The {short.replace('_', ' ')} over a sliding window of each signal cell."


for _short in arrays.SMOOTH:
    _smooth(_short)


def build(df: DataFrame, operators: list[Feature], keep_original: bool = True) -> DataFrame:
    """Several column-adding features in one projection; each sees the original columns."""
    for op in operators:
        op.require(df, op.input_columns)
    named = {n: c for op in operators for n, c in op.columns().items()}
    return df.select(*(["*"] if keep_original else []), *[c.alias(n) for n, c in named.items()])
