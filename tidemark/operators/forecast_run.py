"""A forecast from table to report: split, fit, forecast each series' last window, score, write."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluate
from tidemark.operators.base import Fitted, Learnable, TimeKey, create
from tidemark.operators.forecast import last_window, split
from tidemark.sources.io import report, write_json, write_table

#: A run's settings, their defaults and the bounds they are cut to.
SETTINGS = {
    "d_model": (64, 16, 512),
    "nhead": (2, 1, 8),
    "num_layers": (1, 1, 6),
    "dropout": (0.1, 0.0, 0.8),
    "lag_max": (8, 0, 64),
    "kan_grid_size": (3, 1, 20),
    "epochs": (10, 1, 200),
    "batch_size": (32, 1, 512),
    "lr": (0.001, 1e-6, 0.1),
    "trend_weight": (1.0, 0.0, 10.0),
}


def bounded(settings: dict[str, Any] | None = None) -> dict[str, Any]:
    """Settings within bounds, defaults for the rest; the model's width a multiple of its heads, 16 of each where it would fall under 16."""
    asked = dict(settings or {})
    out = {n: type(default)(min(max(asked.pop(n, default), low), high)) for n, (default, low, high) in SETTINGS.items()}
    width = out["d_model"] - out["d_model"] % out["nhead"]
    return asked | out | {"d_model": width if width >= 16 else 16 * out["nhead"]}


@dataclass(frozen=True)
class Run:
    """Results of a run: the fitted model, real and forecast values, and their scores."""

    model: Fitted
    pairs: DataFrame
    scores: dict[str, float]
    settings: dict[str, Any] = field(default_factory=dict)


def forecast_run(df: DataFrame, key: TimeKey, columns: list[str], target: str, seq_len: int, pred_len: int, forecaster: str = "itransformer_forecaster", settings: dict[str, Any] | None = None, output: str | None = None) -> Run:
    """Fits on the first 70 % of each series, forecasts the last ``pred_len`` rows of the last 15 % from the rows before, and scores them.

    Within the training rows the network keeps 5 % of the windows to decide when to stop. The naive
    error of ``mase`` is that of the training rows. With ``output`` the model, the pairs, the scores
    and a Markdown report go to that folder.
    """
    if target not in columns:
        raise ValueError(f"target {target!r} is none of {columns}")
    network = forecaster == "itransformer_forecaster"
    chosen = bounded(settings) if network else dict(settings or {})
    config = chosen | {"input_columns": columns, "seq_len": seq_len, "pred_len": pred_len, "target_idx": columns.index(target)} | ({"train_ratio": 0.9, "val_ratio": 0.05, "early_stop_patience": 5} if network else {"train_ratio": 1.0})
    spec = create(forecaster, config | {"key": {"order_by": key.order_by, "partition_by": key.partition_by}})
    if not isinstance(spec, Learnable):
        raise ValueError(f"{forecaster} learns nothing")
    parts = split(df, key)
    train = parts.filter("part = 'train'").drop("part")
    model = spec.fit(train)
    window = last_window(parts.filter("part = 'test'").drop("part"), key, seq_len, pred_len)
    full = F.count(F.lit(1)).over(key.whole()) == seq_len + pred_len
    window = window.withColumn("_full", full).filter("_full").drop("_full")
    said = model.run(window.filter(F.col("place") <= seq_len)).filter(F.col("position") == seq_len)
    steps = F.explode(F.array(*[F.struct(F.lit(seq_len + 1 + i).alias("place"), F.col(f"forecast_{i}").alias("y_pred")) for i in range(pred_len)]))
    said = said.select(*key.partition_by, steps.alias("s")).select(*key.partition_by, "s.*")
    real = window.filter(F.col("place") > seq_len).select(*key.partition_by, "place", F.col(target).cast("double").alias("y_true"))
    pairs = real.join(said, [*key.partition_by, "place"]).withColumn("place", F.col("place") - seq_len)
    naive = evaluate.naive_error(train, target, list(key.order_by), list(key.partition_by)).first()[0]
    scores = evaluate.forecasting(pairs, "y_true", "y_pred", naive_error=naive).first().asDict()
    by = list(key.partition_by)
    alone = pairs if by else pairs.withColumn("_all", F.lit(0))
    scores["dtw"] = evaluate.dtw(alone, "y_true", "y_pred", ["place"], by or ["_all"]).agg(F.avg("dtw")).first()[0]
    run = Run(model, pairs, scores, config)
    if output:
        spark = df.sparkSession
        model.save(spark, f"{output}/model")
        write_table(pairs, f"{output}/pred.csv")
        write_json(spark, scores, f"{output}/forecast_metrics.json")
        table = spark.createDataFrame([(n, str(v)) for n, v in scores.items()], "metric string, value string")
        used = spark.createDataFrame([(n, str(v)) for n, v in config.items()], "setting string, value string")
        spark.createDataFrame([(report(f"Forecast of {target}", {"Scores": table, "Settings": used}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/report.md")
    return run
