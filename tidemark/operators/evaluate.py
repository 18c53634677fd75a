"""Metrics as aggregates: classification, threshold curves, forecasts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import as_double


def _safe(a: Column, b: Column, zero: float) -> Column:
    return F.when(b == 0, F.lit(zero)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def rates(tp: Column, fp: Column, tn: Column, fn: Column, zero: float = 0.0) -> dict[str, Column]:
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    precision, recall = _safe(tp, tp + fp, zero), _safe(tp, tp + fn, zero)
    fpr = _safe(fp, fp + tn, zero)
    return {
        "accuracy": _safe(tp + tn, tp + fp + tn + fn, zero),
        "precision": precision,
        "recall": recall,
        "specificity": _safe(tn, tn + fp, zero),
        "f1": _safe(2 * precision * recall, precision + recall, zero),
        "tpr": recall,
        "fpr": fpr,
        "far": fpr,
        "fdr": recall,
        "mar": 1.0 - recall,
        "mcc": _safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), zero),
    }


def positive_label(df: DataFrame, truth: str) -> int:
    """-1 where the truth has no label but -1 and 1, else 1."""
    odd = df.filter(~F.col(truth).isin(-1, 1)).limit(1)
    return -1 if odd.isEmpty() and not df.filter(F.col(truth) == -1).isEmpty() else 1


def binary(df: DataFrame, truth: str, predicted: str, positive: int | list[int] | None = None, zero: float = 0.0, decimals: int = 6) -> DataFrame:
    """One row: the four counts and the rounded rates."""
    labels = positive if isinstance(positive, list) else [positive_label(df, truth) if positive is None else positive]
    t, p = F.col(truth).isin(labels), F.col(predicted).isin(labels)
    counts = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    return counts.select("tp", "fp", "tn", "fn", *[F.round(c, decimals).alias(n) for n, c in rates(*(F.col(x) for x in ("tp", "fp", "tn", "fn")), zero).items()])


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts by (truth, predicted), the sparse form of the matrix."""
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def multi(df: DataFrame, truth: str, predicted: str, labels: list | None = None, zero: float = 0.0, decimals: int = 6) -> DataFrame:
    """One row for each label (of the truth, unless given), its one-vs-rest counts and rounded rates.

    Pairs with a value outside the labels are left out of the matrix.
    """
    cells = confusion(df, truth, predicted).select(F.col(truth).alias("t"), F.col(predicted).alias("p"), "n")
    known = df.sparkSession.createDataFrame([(v,) for v in labels], df.select(truth).schema).select(F.col(truth).alias("label")) if labels else cells.select(F.col("t").alias("label")).distinct()
    inside = cells.join(known.withColumnRenamed("label", "t"), "t", "left_semi").join(known.withColumnRenamed("label", "p"), "p", "left_semi")
    by_truth = inside.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("truths"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = inside.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("preds"))
    every = inside.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("every"))
    c = known.join(by_truth, "label", "left").join(by_pred, "label", "left").na.fill(0, ["truths", "tp", "preds"]).join(F.broadcast(every))
    c = c.select("label", "tp", (F.col("preds") - F.col("tp")).alias("fp"), (F.col("every") - F.col("truths") - F.col("preds") + F.col("tp")).alias("tn"), (F.col("truths") - F.col("tp")).alias("fn"))
    return c.select("label", "tp", "fp", "tn", "fn", *[F.round(x, decimals).alias(n) for n, x in rates(*(F.col(x) for x in ("tp", "fp", "tn", "fn")), zero).items()])


def macro(per_label: DataFrame, decimals: int = 6) -> DataFrame:
    """Means of the rounded rates of ``multi``, rounded again."""
    names = list(rates(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    return per_label.agg(*[F.round(F.avg(n), decimals).alias(n) for n in names])


def curve_points(df: DataFrame, truth: str, score: str, positive: int = 1, decimals: int = 0, inf_threshold: bool = True, zero: float = 0.0) -> DataFrame:
    """One row for each distinct score as a threshold, in descending order (``place``), and one for infinity last.

    A row is predicted positive if its score exceeds the threshold. Rows of a score are added
    up first, so the sort and the running sums are over distinct scores; those run in ranges
    of scores (distributed), joined by the ranges' totals.
    """
    s = F.round(as_double(score), decimals) if decimals else as_double(score)
    hit = (F.col(truth) == positive).cast("long")
    steps = df.groupBy(s.alias("threshold")).agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("q"))
    facts = steps.agg(F.sum("p"), F.sum("q"), F.percentile_approx("threshold", [i / 64 for i in range(1, 64)], 1000)).first()
    if facts[0] is None:
        facts = (0, 0, [])
    cuts = sorted(set(facts[2] or []))
    ranged = steps.withColumn("range", sum([(F.col("threshold") > F.lit(c)).cast("int") for c in cuts], F.lit(0)))
    totals = ranged.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("q").alias("rq"), F.count("*").alias("rn"))
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"o{c}") for c in ("rp", "rq", "rn")])
    own = Window.partitionBy("range").orderBy(F.col("threshold").desc())
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    # At most 64 rows of offsets.
    placed = ranged.join(F.broadcast(offsets), "range").select(
        "threshold",
        (F.row_number().over(own) + F.col("orn")).cast("long").alias("place"),
        (F.coalesce(F.sum("p").over(before), F.lit(0)) + F.col("orp")).alias("tp"),
        (F.coalesce(F.sum("q").over(before), F.lit(0)) + F.col("orq")).alias("fp"),
    )
    if inf_threshold:
        last = steps.agg(F.lit(float("inf")).alias("threshold"), (F.count("*") + 1).cast("long").alias("place"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
        placed = placed.unionByName(last)
    full = placed.withColumn("tn", F.lit(facts[1]) - F.col("fp")).withColumn("fn", F.lit(facts[0]) - F.col("tp"))
    named = rates(*(F.col(x) for x in ("tp", "fp", "tn", "fn")), zero)
    return full.select("place", "threshold", *[named[n].alias(n) for n in ("tpr", "fpr", "precision", "recall", "specificity", "f1", "mcc", "far", "mar")])


#: Ranges of [0, 1] that an area is summed over in parallel.
STRIPS = 1024


def _trapezoid(points: DataFrame, x: str, y: str) -> DataFrame:
    """Area over points sorted by x, ties by place.

    Equal x have no area between them, so their first and last y are enough. What is left has
    distinct x, parts of a whole number, and these spread evenly over ``STRIPS`` ranges; the
    ranges are joined by their ends, ``STRIPS`` + 1 rows at most.
    """
    at = points.groupBy(F.col(x).alias("x")).agg(F.min_by(y, "place").alias("a"), F.max_by(y, "place").alias("b"))
    at = at.withColumn("strip", F.floor(F.col("x") * STRIPS))
    own, over = Window.partitionBy("strip").orderBy("x"), Window.orderBy("strip")
    area = lambda w, x0, x1, y0, y1: (F.col(x0) - F.lag(x1).over(w)) * (F.col(y0) + F.lag(y1).over(w)) / 2
    strips = at.withColumn("part", area(own, "x", "x", "a", "b")).groupBy("strip").agg(F.sum("part").alias("part"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min_by("a", "x").alias("y0"), F.max_by("b", "x").alias("y1"))
    joined = strips.select((F.coalesce("part", F.lit(0.0)) + F.coalesce(area(over, "x0", "x1", "y0", "y1"), F.lit(0.0))).alias("a"))
    return joined.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))


def curve_summary(points: DataFrame, mode: str = "compat") -> DataFrame:
    """One row: areas under the ROC and precision-recall points and the best values with their thresholds.

    ``compat`` takes the points as they are, so the corner (1, 1) is not reached; ``standard``
    adds the corners. Areas are summed in parallel, so there may be as many points as rows.
    """
    spark = points.sparkSession
    roc, pr = points.select("fpr", "tpr", "place"), points.select("recall", "precision", "place")
    if mode == "standard":
        finite = points.filter(F.col("threshold") < float("inf")).select("fpr", "tpr", "place")
        roc = finite.unionByName(spark.createDataFrame([(0.0, 0.0, -1), (1.0, 1.0, 2**62)], "fpr double, tpr double, place long"))
    best = points.agg(
        *[F.max(F.struct(F.col(n).alias("v"), (-F.col("place")).alias("o"), F.col("threshold").alias("t"))).alias(f"best_{n}") for n in ("f1", "mcc", "precision", "recall")],
        *[F.min(F.struct(F.col(n).alias("v"), F.col("place").alias("o"), F.col("threshold").alias("t"))).alias(f"best_{n}") for n in ("far", "mar")],
    )
    named = [x for n in ("f1", "mcc", "precision", "recall", "far", "mar") for x in (F.col(f"best_{n}.v").alias(f"best_{n}"), F.col(f"best_{n}.t").alias(f"best_{n}_threshold"))]
    return _trapezoid(roc, "fpr", "tpr").withColumnRenamed("area", "auc_roc").join(_trapezoid(pr, "recall", "precision").withColumnRenamed("area", "auc_pr")).join(best).select("auc_roc", "auc_pr", *named)


def forecasting(df: DataFrame, truth: str, predicted: str, epsilon: float = 1e-8, naive_error: float | None = None) -> DataFrame:
    """One row: mse, rmse, mae, mape and smape in per cent, mase and r2 (NaN where undefined)."""
    t, p = as_double(truth), as_double(predicted)
    e = p - t
    sums = df.agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e / (F.abs(t) + epsilon))) * 100).alias("mape"),
        (F.avg(2 * F.abs(e) / (F.abs(t) + F.abs(p) + epsilon)) * 100).alias("smape"),
        F.sum(e * e).alias("res"),
        (F.var_pop(t) * F.count(t)).alias("tot"),
    )
    mase = F.col("mae") / naive_error if naive_error is not None and naive_error > epsilon else F.lit(float("nan"))
    r2 = F.when(F.col("tot") > epsilon, 1 - F.try_divide(F.col("res"), F.col("tot"))).otherwise(float("nan"))
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", "mape", "smape", mase.alias("mase"), r2.alias("r2"))


def naive_error(df: DataFrame, value: str, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Mean absolute step from one row to the next."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(*order_by)
    return df.select((as_double(value) - F.lag(as_double(value)).over(w)).alias("d")).filter("d is not null").agg(F.avg(F.abs("d")).alias("naive_error"))


def dtw_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Exact dynamic time warping distance of two sequences, by anti-diagonals."""
    n, m = len(a), len(b)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    last2 = before
    before[0] = 0.0
    for d in range(2, n + m + 1):
        now = np.full(n + 1, np.inf)
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        step = np.minimum(np.minimum(last[i - 1], last[i]), last2[i - 1])
        now[i] = np.abs(a[i - 1] - b[d - i - 1]) + step
        last2, last = last, now
    return float(last[n])


def dtw(df: DataFrame, truth: str, predicted: str, order_by: list[str], by: list[str], max_len: int = 2000) -> DataFrame:
    """Per series: the exact warping distance over the number of points; longer series are thinned evenly to ``max_len``."""
    order = Window.partitionBy(*by).orderBy(*order_by)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(order) - 1
    # Evenly spaced positions: floor(k * (n - 1) / (max_len - 1)).
    k = F.ceil(i * (max_len - 1) / F.greatest(n - 1, F.lit(1)))
    kept = F.when(n <= max_len, True).otherwise(F.floor(k * (n - 1) / (max_len - 1)) == i)
    thin = df.select(*by, as_double(truth).alias("_t"), as_double(predicted).alias("_p"), i.alias("_i"), kept.alias("_k")).filter("_k")
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        t, p = table.column("_t").to_numpy(), table.column("_p").to_numpy()
        return pa.table({**{c: table.column(c)[:1] for c in by}, "dtw": [dtw_distance(t, p) / len(t)], "method": ["exact"]})

    return thin.groupBy(*by).applyInArrow(one, f"{schema}, dtw double, method string")


def point_adjust(df: DataFrame, truth: str, predicted: str, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """``adjusted``: any hit within a run of true rows marks the whole run (own definition)."""
    by = partition_by or []
    w = Window.partitionBy(*by).orderBy(*order_by)
    start = ((F.col(truth) == 1) & (F.coalesce(F.lag(truth).over(w), F.lit(0)) != 1)).cast("int")
    run = df.withColumn("_run", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.max(F.when(F.col(truth) == 1, F.col(predicted))).over(Window.partitionBy(*by, "_run"))
    return run.withColumn("adjusted", F.when(F.col(truth) == 1, hit).otherwise(F.col(predicted)).cast("int")).drop("_run")


def self_evaluation(df: DataFrame, score: str) -> DataFrame:
    """A label-free score of scores: the coefficient of variation through a sigmoid (own definition)."""
    cv = F.try_divide(F.stddev_pop(as_double(score)), F.abs(F.avg(as_double(score))))
    return df.agg((1 / (1 + F.exp(-F.coalesce(cv, F.lit(0.0))))).alias("self_evaluation"))
