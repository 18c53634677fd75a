"""Forecasting over windowed series: splits, window samples, linear and network forecasters, lag correlations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import network
from tidemark.operators.base import Fitted, Learnable, TimeKey, as_double, param, register

KIND = "forecasting"


def split(df: DataFrame, key: TimeKey, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``part``: train, val or test by position, shares cut to whole rows."""
    rn = F.row_number().over(key.window())
    n = F.count(F.lit(1)).over(key.whole())
    a, b = F.floor(n * train), F.floor(n * (train + val))
    return df.withColumn("part", F.when(rn <= a, "train").when(rn <= b, "val").otherwise("test"))


def samples(df: DataFrame, key: TimeKey, features: list[str], target: str, seq_len: int, pred_len: int) -> DataFrame:
    """One row for each full window: ``first`` position, ``x`` (seq_len rows), ``base`` (the last target seen),
    ``future`` (pred_len targets) and ``residual`` (future less base)."""
    w = key.window().rowsBetween(0, seq_len + pred_len - 1)
    cells = F.struct(F.array(*[as_double(c) for c in features]).alias("x"), as_double(target).alias("y"))
    rows = df.select(*key.partition_by, F.row_number().over(key.window()).alias("first"), F.collect_list(cells).over(w).alias("w")).filter(F.size("w") == seq_len + pred_len)
    future = F.transform(F.slice("w", seq_len + 1, pred_len), lambda r: r["y"])
    base = F.get("w", F.lit(seq_len - 1))["y"]
    return rows.select(*key.partition_by, "first", F.transform(F.slice("w", 1, seq_len), lambda r: r["x"]).alias("x"), base.alias("base"), future.alias("future"), F.transform(future, lambda y: y - base).alias("residual"))


def last_window(df: DataFrame, key: TimeKey, seq_len: int, pred_len: int) -> DataFrame:
    """The final seq_len + pred_len rows of each series, in order (``place`` from 1)."""
    back = F.row_number().over(key.reversed())
    return df.withColumn("_b", back).filter(F.col("_b") <= seq_len + pred_len).withColumn("place", F.lit(seq_len + pred_len + 1) - F.col("_b")).drop("_b")


def lag_correlation(df: DataFrame, key: TimeKey, target: str, feature: str, lag_max: int) -> DataFrame:
    """Correlation of a target with a feature shifted by 0 to ``lag_max`` rows, zeros before the start."""
    shifted = df.select(as_double(target).alias("y"), *[F.lag(as_double(feature), k, 0.0).over(key.window()).alias(f"l{k}") for k in range(lag_max + 1)])
    row = shifted.agg(*[F.corr("y", f"l{k}").alias(f"c{k}") for k in range(lag_max + 1)])
    return row.select(F.posexplode(F.array(*[f"c{k}" for k in range(lag_max + 1)])).alias("lag", "correlation"))


def _scaled(x: np.ndarray, state: dict[str, Any]) -> np.ndarray:
    return (x - np.array(state["mean"])) / np.array(state["std"])


@register("linear_forecaster", KIND)
@dataclass(frozen=True)
class LinearForecaster(Learnable):
    """Ridge regression of the residuals against the last value on the standardised window; ``forecast_i`` columns.

    The normal equations are sums over windows, added up on the executors: their size is that
    of one window, not of the series. Any other model fits behind ``ModelForecaster``.
    """

    input_columns: tuple[str, ...] = ()
    key: TimeKey | None = None
    seq_len: int = param(100, ge=8, le=2000)
    pred_len: int = param(20, ge=1, le=500)
    target_idx: int = -1
    train_ratio: float = param(0.7, gt=0, le=1)
    ridge: float = param(1.0, ge=0, log=True)

    def fit(self, df: DataFrame) -> Fitted:
        self.require(df, self.input_columns)
        if self.key is None:
            raise ValueError("an explicit row order is needed")
        target = self.input_columns[self.target_idx]
        part = split(df, self.key, self.train_ratio, 0.0).filter("part = 'train'")
        row = part.agg(*[f(as_double(c)).alias(f"{n}{i}") for i, c in enumerate(self.input_columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        state: dict[str, Any] = {"mean": [row[f"m{i}"] for i in range(len(self.input_columns))], "std": [row[f"s{i}"] or 1.0 for i in range(len(self.input_columns))]}
        windows = samples(part, self.key, list(self.input_columns), target, self.seq_len, self.pred_len).select("x", "residual")
        d, p, t = self.seq_len * len(self.input_columns) + 1, self.pred_len, self.target_idx % len(self.input_columns)

        def sums(batches):  # noqa: ANN001, ANN202
            total = np.zeros((d, d + p))
            for pdf in batches:
                if len(pdf):
                    x = _scaled(np.stack([np.stack(v) for v in pdf["x"]]), state).reshape(len(pdf), -1)
                    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                    total += x.T @ np.concatenate([x, np.stack(pdf["residual"]) / state["std"][t]], axis=1)
            yield pd.DataFrame({"i": np.arange(d), "v": list(total)})

        rows = windows.mapInPandas(sums, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        m = np.zeros((d, d + p))
        m[rows["i"], rows["j"]] = rows["v"]
        gram = m[:, :d] + self.ridge * np.eye(d) * (np.arange(d) < d - 1)
        state["weights"] = np.linalg.lstsq(gram, m[:, d:], rcond=None)[0].tolist()
        return Fitted(self, state)

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        """One row for each window of seq_len rows: the position of its last row and the forecasts after it."""
        t = self.target_idx % len(self.input_columns)

        def forecast(x: np.ndarray) -> np.ndarray:
            flat = _scaled(x, state).reshape(len(x), -1)
            return x[:, -1, t, None] + state["std"][t] * (np.concatenate([flat, np.ones((len(x), 1))], axis=1) @ np.array(state["weights"]))

        return model_forecast(df, self.key, list(self.input_columns), self.seq_len, self.pred_len, forecast)


def _stacked(column: pa.ChunkedArray, *shape: int) -> np.ndarray:
    """Equally long nested lists as one array."""
    flat = column.combine_chunks()
    while pa.types.is_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)


@register("itransformer_forecaster", KIND)
@dataclass(frozen=True)
class NetworkForecaster(Learnable):
    """Network of variate tokens with lag mixtures and a head of radial basis functions; ``forecast_i`` columns.

    Windows are taken in time order: the first ``train_ratio`` of a series' windows train, the next
    ``val_ratio`` decide when to stop. Of each kind ``max_windows`` drawn by a hash at most go to
    the driver, which trains; forecasts cover every window, in Arrow batches. Windows with a NaN do
    not train.
    """

    input_columns: tuple[str, ...] = ()
    key: TimeKey | None = None
    seq_len: int = param(100, ge=8, le=2000)
    pred_len: int = param(20, ge=1, le=500)
    d_model: int = param(128, ge=16, le=1024)
    nhead: int = param(4, ge=1, le=16)
    num_layers: int = param(2, ge=1, le=12)
    dim_feedforward: int | None = param(None, ge=16, le=4096)
    dropout: float = param(0.2, ge=0, le=0.8)
    lag_aware: bool = True
    lag_max: int = param(16, ge=0, le=128)
    lag_bias_scale: float = param(2.0, ge=0, le=10)
    kan_grid_size: int = param(5, ge=1, le=20)
    target_idx: int = param(-1, ge=-1, le=10000)
    epochs: int = param(30, ge=1, le=1000)
    batch_size: int = param(128, ge=1, le=2048)
    lr: float = param(0.001, ge=1e-6, le=0.1, log=True)
    weight_decay: float = param(1e-5, ge=0, le=0.1)
    early_stop_patience: int = param(12, ge=1, le=100)
    train_ratio: float = param(0.7, ge=0.1, le=0.9)
    val_ratio: float = param(0.15, ge=0.05, le=0.45)
    trend_weight: float = param(1.0, ge=0, le=10)
    time_weight_start: float = param(0.1, ge=0, le=1)
    time_weight_end: float = param(1.0, ge=0, le=1)
    max_grad_norm: float = param(1.0, ge=0.1, le=10)
    scheduler_factor: float = param(0.5, ge=0.1, le=0.9)
    scheduler_patience: int = param(3, ge=1, le=20)
    max_windows: int = param(20_000, ge=1)
    seed: int = 0

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.d_model % self.nhead:
            raise ValueError(f"d_model {self.d_model} is no multiple of nhead {self.nhead}")
        if self.target_idx >= len(self.input_columns) > 0:
            raise ValueError(f"target_idx {self.target_idx}: there are {len(self.input_columns)} columns")

    def _shape(self) -> network.Shape:
        n = len(self.input_columns)
        lags = min(self.lag_max, self.seq_len - 1) if self.lag_aware else 0
        return network.Shape(n, self.seq_len, self.pred_len, self.d_model, self.nhead, self.num_layers, self.dim_feedforward or 2 * self.d_model, self.kan_grid_size, self.target_idx % n, lags, self.lag_bias_scale, self.dropout)

    def fit(self, df: DataFrame) -> Fitted:
        self.require(df, self.input_columns)
        if self.key is None:
            raise ValueError("an explicit row order is needed")
        shape, columns = self._shape(), self.input_columns
        row = split(df, self.key, self.train_ratio, 0.0).filter("part = 'train'").agg(*[f(F.nullif(as_double(c), F.lit(float("nan")))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        state: dict[str, Any] = {"mean": [row[f"m{i}"] or 0.0 for i in range(len(columns))], "std": [row[f"s{i}"] or 1.0 for i in range(len(columns))]}
        windows = samples(df, self.key, list(columns), columns[shape.target], self.seq_len, self.pred_len)
        n = F.count(F.lit(1)).over(self.key.whole())
        part = F.when(F.col("first") <= F.floor(n * self.train_ratio), "fit").when(F.col("first") <= F.floor(n * (self.train_ratio + self.val_ratio)), "check")
        whole = ~F.exists(F.flatten("x"), F.isnan) & ~F.exists("residual", F.isnan)
        dealt = windows.withColumn("part", part).filter(whole & F.col("part").isNotNull())

        def drawn(kind: str) -> tuple[np.ndarray, np.ndarray]:
            by = [F.xxhash64("first", *self.key.partition_by, F.lit(self.seed)), *self.key.partition_by, "first"]
            table = dealt.filter(F.col("part") == kind).orderBy(*by).limit(self.max_windows).select("x", "residual").toArrow()
            if not table.num_rows:
                return np.zeros((0, self.seq_len, len(columns))), np.zeros((0, self.pred_len))
            return _scaled(_stacked(table["x"], self.seq_len, len(columns)), state), _stacked(table["residual"], self.pred_len) / state["std"][shape.target]

        fit, check = drawn("fit"), drawn("check")
        if not len(fit[0]):
            raise ValueError(f"no series has a whole window of {self.seq_len} + {self.pred_len} rows to train on")
        prior = network.lag_prior(fit[0], shape.target, shape.lags)
        plan = network.Plan(self.epochs, self.batch_size, self.lr, self.weight_decay, self.early_stop_patience, self.trend_weight, (self.time_weight_start, self.time_weight_end), self.max_grad_norm, self.scheduler_factor, self.scheduler_patience, self.seed)
        weights, losses = network.train(shape, plan, prior, fit, check)
        return Fitted(self, state | {"prior": prior.tolist(), "losses": losses, "weights": {n: v.tolist() for n, v in weights.items()}})

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        """One row for each window of seq_len rows: the position of its last row and the forecasts after it."""
        shape, prior = self._shape(), np.array(state["prior"])
        weights = {n: network.const(v) for n, v in state["weights"].items()}

        def forecast(x: np.ndarray) -> np.ndarray:
            z = _scaled(x, state)
            parts = [network.forward(shape, weights, prior, z[i : i + 256]).v for i in range(0, len(z), 256)]
            return x[:, -1, shape.target, None] + state["std"][shape.target] * np.concatenate(parts)

        return model_forecast(df, self.key, list(self.input_columns), self.seq_len, self.pred_len, forecast)


def model_forecast(df: DataFrame, key: TimeKey, columns: list[str], seq_len: int, pred_len: int, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Any model as a function of (n, seq_len, columns) to (n, pred_len), applied to every full window in Arrow batches."""
    w = key.window().rowsBetween(-(seq_len - 1), 0)
    rows = df.select(*key.partition_by, F.row_number().over(key.window()).alias("position"), F.collect_list(F.array(*[as_double(c) for c in columns])).over(w).alias("x")).filter(F.size("x") == seq_len)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(model(np.stack([np.stack(v) for v in x])))) if len(x) else pd.Series([], dtype=object)

    out = rows.withColumn("f", run("x"))
    return out.select(*key.partition_by, "position", *[F.get("f", F.lit(i)).alias(f"forecast_{i}") for i in range(pred_len)])


def seasonal_naive(df: DataFrame, key: TimeKey, value: str, period: int, pred_len: int) -> DataFrame:
    """The last period repeated: place 1 to ``pred_len`` and forecast for each series."""
    back = F.row_number().over(key.reversed())
    last = df.select(*key.partition_by, as_double(value).alias("v"), back.alias("b")).filter(F.col("b") <= period)
    listed = last.groupBy(*key.partition_by).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("b")).alias("o"), "v"))), lambda r: r["v"]).alias("p"))
    return listed.select(*key.partition_by, F.explode(F.sequence(F.lit(1), F.lit(pred_len))).alias("place"), "p").select(*key.partition_by, "place", F.get("p", (F.col("place") - 1) % F.size("p")).alias("forecast"))
