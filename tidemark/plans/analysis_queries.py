"""Queries of detection, evaluation, forecasting and tuning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detect as D
from tidemark.operators import evaluate as E
from tidemark.operators import forecast as P
from tidemark.operators import forecast_run as R
from tidemark.operators import tune as T
from tidemark.operators.base import TimeKey
from tidemark.plans.catalog import query
from tidemark.runtime import load

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_Z = """
WITH s AS (SELECT {stats} FROM lineitem),
z AS (SELECT l_orderkey, greatest({cells}) AS score FROM lineitem, s)
""".format(stats=", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(NUMBERS)), cells=", ".join(f"abs({c} - m{i}) / s{i}" for i, c in enumerate(NUMBERS)))


@query("det_zscore", f"{_Z} SELECT CAST(score > 1.7 AS INTEGER) AS label, count(*) AS n, round(max(score), 6) AS top FROM z GROUP BY 1")
def det_zscore(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    out = D.ZScoreDetector(tuple(NUMBERS), 1.7).fit(lines).run(lines)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("top"))


_EVENT_Z = "WITH s AS (SELECT avg(value) m, stddev_pop(value) sd FROM events), z AS (SELECT event_id, abs(value - m) / sd AS score FROM events, s)"


@query("det_zscore_scores", f"{_EVENT_Z} SELECT event_id, round(score, 6) AS score FROM z")
def det_zscore_scores(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return D.ZScore(("value",)).fit(events).run(events).select("event_id", F.round("score", 6).alias("score"))


@query("det_threshold", f"{_EVENT_Z} SELECT event_id, CAST(score > 3.0 AS INTEGER) AS label FROM z")
def det_threshold(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return D.Threshold().run(D.ZScore(("value",)).fit(events).run(events)).select("event_id", "label")


@query("det_percentile", f"{_EVENT_Z}, q AS (SELECT quantile_cont(score, 0.95) AS t FROM z) SELECT event_id, CAST(score > t AS INTEGER) AS label FROM z, q")
def det_percentile(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    scored = D.ZScore(("value",)).fit(events).run(events)
    return D.Percentile(95.0).fit(scored).run(scored).select("event_id", "label")


@query("det_residual", "SELECT event_id, round((value - user_id) ** 2, 6) AS score FROM events")
def det_residual(spark: SparkSession, d: str) -> DataFrame:
    return D.Residual(("value",), ("user_id",), "mse").run(load(spark, d, "events")).select("event_id", F.round("score", 6).alias("score"))


@query("det_residual_map", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(abs(l_quantity - l_linenumber), 6) AS score_l_quantity, round(abs(l_discount - l_tax), 6) AS score_l_discount FROM lineitem")
def det_residual_map(spark: SparkSession, d: str) -> DataFrame:
    out = D.ResidualMap(("l_quantity", "l_discount"), ("l_linenumber", "l_tax"), "mae").run(load(spark, d, "lineitem"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("score_l_quantity", 6).alias("score_l_quantity"), F.round("score_l_discount", 6).alias("score_l_discount"))


_DIMS = 64


def _points(spark: SparkSession, d: str, dims: int = _DIMS) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(dims)])


def _knn_sql(aggregate: str, metric: str) -> str:
    gap = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2)))" if metric == "euclidean" else "list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))"
    value = {"maximum": "max(dist)", "mean": "avg(dist)", "median": "quantile_cont(dist, 0.5)"}[aggregate]
    return f"WITH p AS (SELECT vec_id, list_transform(embedding[1:{_DIMS}], lambda x: x::DOUBLE) AS v FROM embeddings), g AS (SELECT a.vec_id, {gap} AS dist FROM p a, p b), r AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS k FROM g) SELECT vec_id, round({value}, 6) AS score FROM r WHERE k <= 5 GROUP BY vec_id"


def _knn_query(aggregate: str, metric: str) -> None:
    @query(f"det_knn_{aggregate}_{'l2' if metric == 'euclidean' else 'l1'}", _knn_sql(aggregate, metric))
    def run(spark: SparkSession, d: str) -> DataFrame:
        points = _points(spark, d)
        model = D.Knn(tuple(f"x{i}" for i in range(_DIMS)), 5, metric, aggregate).fit(points)
        return model.run(points).select("vec_id", F.round("score", 6).alias("score"))


for _a in ("maximum", "mean", "median"):
    for _m in ("euclidean", "manhattan"):
        _knn_query(_a, _m)


@query("det_knn_detector", f"WITH s AS ({_knn_sql('maximum', 'euclidean').replace('round(max(dist), 6)', 'max(dist)')}), q AS (SELECT quantile_cont(score, 0.95) AS t FROM s) SELECT vec_id, CAST(score > t AS INTEGER) AS label FROM s, q")
def det_knn_detector(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    return D.KnnDetector(tuple(f"x{i}" for i in range(_DIMS))).fit(points).run(points).select("vec_id", "label")


_PCA2 = """
WITH s AS (SELECT avg(l_quantity) mx, avg(l_discount) my, covar_pop(l_quantity, l_quantity) a, covar_pop(l_quantity, l_discount) b, covar_pop(l_discount, l_discount) c FROM lineitem),
l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM s),
u AS (SELECT *, CASE WHEN abs(b) > abs(lam - a) THEN b ELSE lam - c END AS ux, CASE WHEN abs(b) > abs(lam - a) THEN lam - a ELSE b END AS uy FROM l),
w AS (SELECT mx, my, ux / sqrt(ux * ux + uy * uy) AS wx, uy / sqrt(ux * ux + uy * uy) AS wy FROM u),
p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS x, l_discount AS y, mx + wx * ((l_quantity - mx) * wx + (l_discount - my) * wy) AS px, my + wy * ((l_quantity - mx) * wx + (l_discount - my) * wy) AS py FROM lineitem, w)
"""


@query("det_pca_residual", f"{_PCA2} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(((x - px) ** 2 + (y - py) ** 2) / 2, 6) AS score FROM p")
def det_pca_residual(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    out = D.PcaScorer(("l_quantity", "l_discount"), 1).fit(lines).run(lines)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("score", 6).alias("score"))


@query("det_pca_detector")
def det_pca_detector(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    return D.PcaDetector(tuple(NUMBERS), 3).fit(lines).run(lines).groupBy("label").agg(F.count("*").alias("n"))


@query("det_pca_predict", f"{_PCA2} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(px, 6) AS quantity, round(py, 6) AS discount FROM p")
def det_pca_predict(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    out = D.PcaPredictor(("l_quantity", "l_discount"), 1).fit(lines).run(lines)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("l_quantity_pred", 6).alias("quantity"), F.round("l_discount_pred", 6).alias("discount"))


@query("det_pca_pair", f"{_PCA2}, z AS (SELECT ((x - px) ** 2 + (y - py) ** 2) / 2 AS score FROM p), q AS (SELECT quantile_cont(score, 0.95) AS t FROM z) SELECT CAST(score > t + 1e-9 AS INTEGER) AS label, count(*) AS n FROM z, q GROUP BY 1")
def det_pca_pair(spark: SparkSession, d: str) -> DataFrame:
    """Scores and a percentile in a chain, of two columns; scores equal to the threshold up to rounding are under it."""
    lines = load(spark, d, "lineitem")
    model = D.PcaDetector(("l_quantity", "l_discount"), 1).fit(lines)
    threshold = model.state["parts"][1]["threshold"]
    return model.run(lines).select(((F.col("label") == 1) & (F.col("score") > threshold + 1e-9)).cast("int").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("det_composite", f"{_Z}, q AS (SELECT quantile_cont(score, 0.9) AS t FROM z) SELECT CAST(score > t AS INTEGER) AS label, count(*) AS n FROM z, q GROUP BY 1")
def det_composite(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    model = D.CompositeDetector(({"name": "zscore_scorer", "config": {"input_columns": NUMBERS}}, {"name": "percentile_decider", "config": {"percentile": 90.0}})).fit(lines)
    return model.run(lines).groupBy("label").agg(F.count("*").alias("n"))


def _overlap_sql(how: str) -> str:
    spread = "" if how == "mean" else " + stddev_pop(v)"
    keep = "" if how == "mean" else "WHERE n <= 5 OR (k > ceil(n * 0.1) AND k <= n - ceil(n * 0.1))"
    return f"WITH r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(avg(v){spread}, 6) AS score FROM r {keep} GROUP BY user_id"


def _overlap_query(how: str) -> None:
    @query(f"det_overlap_{how}", _overlap_sql(how))
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = D.merge_overlaps(load(spark, d, "events").select("user_id", F.col("value").alias("score")), ["user_id"], "score", how)
        return out.select("user_id", F.round("score", 6).alias("score"))


for _how in ("heuristic", "mean"):
    _overlap_query(_how)


_WINDOWS = """
WITH r AS (SELECT user_id, value, row_number() OVER o - 1 AS k, avg(value) OVER (o ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m, count(*) OVER (o ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT b.user_id, b.k::INTEGER AS position, abs(b.value - a.m) AS v FROM r a JOIN r b ON a.user_id = b.user_id AND b.k BETWEEN a.k AND a.k + 9 WHERE a.n = 10),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id, position ORDER BY v) AS j, count(*) OVER (PARTITION BY user_id, position) AS c FROM g)
SELECT user_id, position, round(avg(v) + stddev_pop(v), 6) AS score FROM z WHERE c <= 5 OR (j > ceil(c * 0.1) AND j <= c - ceil(c * 0.1)) GROUP BY user_id, position
"""


@query("det_window_model", _WINDOWS)
def det_window_model(spark: SparkSession, d: str) -> DataFrame:
    """A model adapter (here: a window's mean) and the merge of its overlapping scores."""
    events = load(spark, d, "events")
    scored = D.window_model(events, ["value"], ["user_id"], ["ts", "event_id"], 10, 1, lambda x: x.mean(axis=1, keepdims=True).repeat(x.shape[1], axis=1))
    return D.merge_overlaps(scored, ["user_id", "position"]).select("user_id", "position", F.round("score", 6).alias("score"))


# Evaluation



def _rates_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
r AS (SELECT {k}tp, fp, tn, fn, (tp + tn) / nullif(tp + fp + tn + fn, 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr,
  coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM (SELECT {k}tp::DOUBLE tp, fp::DOUBLE fp, tn::DOUBLE tn, fn::DOUBLE fn FROM {source}) d)
SELECT {k}tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(recall, 6) AS tpr, round(fpr, 6) AS fpr, round(fpr, 6) AS far, round(recall, 6) AS fdr, round(1 - recall, 6) AS mar, round(mcc, 6) AS mcc FROM r
"""


@query("eval_binary", f"WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) tp, count(*) FILTER (quality <> 1 AND toxic = 1) fp, count(*) FILTER (quality <> 1 AND toxic <> 1) tn, count(*) FILTER (quality = 1 AND toxic <> 1) fn FROM labels), {_rates_sql('c')}")
def eval_binary(spark: SparkSession, d: str) -> DataFrame:
    return E.binary(load(spark, d, "labels"), "quality", "toxic")


_PAIRS = "p AS (SELECT l_linenumber % 3 AS t, l_orderkey % 4 AS p FROM lineitem)"
_MULTI = f"WITH {_PAIRS}, l AS (SELECT DISTINCT t AS label FROM p), i AS (SELECT * FROM p WHERE p IN (SELECT label FROM l)), c AS (SELECT label, count(*) FILTER (t = label AND p = label) tp, count(*) FILTER (t <> label AND p = label) fp, count(*) FILTER (t <> label AND p <> label) tn, count(*) FILTER (t = label AND p <> label) fn FROM i, l GROUP BY label)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("t"), (F.col("l_orderkey") % 4).cast("int").alias("p"))


@query("eval_multi", f"{_MULTI}, {_rates_sql('c', 'label')}")
def eval_multi(spark: SparkSession, d: str) -> DataFrame:
    return E.multi(_pairs(spark, d), "t", "p")


@query("eval_macro", f"WITH z AS ({_MULTI}, {_rates_sql('c', 'label')}) SELECT round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(specificity), 6) AS specificity, round(avg(f1), 6) AS f1, round(avg(tpr), 6) AS tpr, round(avg(fpr), 6) AS fpr, round(avg(far), 6) AS far, round(avg(fdr), 6) AS fdr, round(avg(mar), 6) AS mar, round(avg(mcc), 6) AS mcc FROM z")
def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    return E.macro(E.multi(_pairs(spark, d), "t", "p"))


@query("eval_confusion", f"WITH {_PAIRS} SELECT t, p, count(*) AS n FROM p GROUP BY t, p")
def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(_pairs(spark, d), "t", "p")


_CURVE = """
WITH x AS (SELECT l.quality AS y, d.n_chars::DOUBLE AS s FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM x GROUP BY s),
k AS (SELECT s AS threshold, row_number() OVER (ORDER BY s DESC) AS place, coalesce(sum(p) OVER o, 0) AS tp, coalesce(sum(q) OVER o, 0) AS fp, sum(p) OVER () AS pp, sum(q) OVER () AS qq FROM g WINDOW o AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT 'Infinity'::DOUBLE, count(*) + 1, 0, 0, sum(p), sum(q) FROM g),
c AS (SELECT place, threshold, coalesce(tp / nullif(pp, 0), 0) AS tpr, coalesce(fp / nullif(qq, 0), 0) AS fpr, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce((tp * (qq - fp) - fp * (pp - tp)) / nullif(sqrt((tp + fp) * pp * qq * (qq - fp + pp - tp)), 0), 0) AS mcc FROM k),
f AS (SELECT *, coalesce(2 * precision * tpr / nullif(precision + tpr, 0), 0) AS f1 FROM c)
"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("s"))
    return load(spark, d, "labels").join(docs, "doc_id").select("quality", "s")


@query("eval_curve_points", f"{_CURVE} SELECT place, threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision, round(f1, 6) AS f1, round(mcc, 6) + 0.0 AS mcc, round(1 - tpr, 6) AS mar FROM f")
def eval_curve_points(spark: SparkSession, d: str) -> DataFrame:
    points = E.curve_points(_scores(spark, d), "quality", "s")
    return points.select("place", "threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision", "f1", "mar")], (F.round("mcc", 6) + 0.0).alias("mcc"))


_AREA = "SELECT sum((x - lx) * (y + ly) / 2) AS a FROM (SELECT {x} AS x, {y} AS y, lag({x}) OVER o AS lx, lag({y}) OVER o AS ly FROM f WINDOW o AS (ORDER BY {x}, place)) t"


@query("eval_curve_auc", f"{_CURVE} SELECT round(({_AREA.format(x='fpr', y='tpr')}), 6) AS auc_roc, round(({_AREA.format(x='tpr', y='precision')}), 6) AS auc_pr, round((SELECT max(f1) FROM f), 6) AS best_f1, (SELECT threshold FROM f ORDER BY f1 DESC, place LIMIT 1) AS best_f1_threshold")
def eval_curve_auc(spark: SparkSession, d: str) -> DataFrame:
    out = E.curve_summary(E.curve_points(_scores(spark, d), "quality", "s"))
    return out.select(F.round("auc_roc", 6).alias("auc_roc"), F.round("auc_pr", 6).alias("auc_pr"), F.round("best_f1", 6).alias("best_f1"), "best_f1_threshold")


_DAILY = "d AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) / 1000 AS v, count(*)::DOUBLE AS c FROM orders GROUP BY 1)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 1000).alias("v"), F.count("*").cast("double").alias("c"))


_NAIVE = f"WITH {_DAILY}, l AS (SELECT *, lag(v) OVER (ORDER BY day) AS p FROM d)"


@query("eval_forecast", f"{_NAIVE}, e AS (SELECT v, p, p - v AS e FROM l WHERE p IS NOT NULL) SELECT round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(abs(e) / (abs(v) + 1e-8)) * 100, 5) AS mape, round(avg(2 * abs(e) / (abs(v) + abs(p) + 1e-8)) * 100, 5) AS smape, round(avg(abs(e)) / 2.0, 6) AS mase, round(1 - sum(e * e) / (var_pop(v) * count(*)), 6) AS r2 FROM e")
def eval_forecast(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    daily = _daily(spark, d).withColumn("p", F.lag("v").over(Window.orderBy("day"))).filter("p is not null")
    out = E.forecasting(daily, "v", "p", naive_error=2.0)
    digits = {"mse": 4, "rmse": 5, "mae": 6, "mape": 5, "smape": 5, "mase": 6, "r2": 6}
    return out.select(*[F.round(c, n).alias(c) for c, n in digits.items()])


#: Row by row of the cost matrix: along a row, costs add up from where the row before is left.
_DTW = """
WITH RECURSIVE e AS (SELECT user_id, value, user_id::DOUBLE AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (
  SELECT a.user_id, 1::BIGINT AS i, b.k AS j, sum(abs(a.value - b.p)) OVER (PARTITION BY a.user_id ORDER BY b.k) AS c FROM e a JOIN e b ON a.user_id = b.user_id WHERE a.k = 1
  UNION ALL
  SELECT user_id, i, j, s + min(m - s + cost) OVER (PARTITION BY user_id ORDER BY j) AS c FROM (
    SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY j) AS s FROM (
      SELECT d.user_id, d.i + 1 AS i, d.j, abs(a.value - b.p) AS cost, least(d.c, lag(d.c) OVER (PARTITION BY d.user_id ORDER BY d.j)) AS m
      FROM d JOIN e a ON a.user_id = d.user_id AND a.k = d.i + 1 JOIN e b ON b.user_id = d.user_id AND b.k = d.j) x) y)
SELECT d.user_id, round(c / n, 6) AS dtw FROM d JOIN e ON e.user_id = d.user_id AND e.k = d.i WHERE i = n AND j = n
"""


@query("eval_dtw", _DTW)
def eval_dtw(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("user_id", "ts", "event_id", "value", F.col("user_id").cast("double").alias("p"))
    return E.dtw(events, "value", "p", ["ts", "event_id"], ["user_id"]).select("user_id", F.round("dtw", 6).alias("dtw"))


@query("eval_point_adjust", "WITH o AS (SELECT event_id, user_id, ts, CAST(value > 20 AS INTEGER) AS t, CAST(event_id % 3 = 0 AS INTEGER) AS p FROM events), s AS (SELECT *, CASE WHEN t = 1 AND coalesce(lag(t) OVER w, 0) <> 1 THEN 1 ELSE 0 END AS b FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s) SELECT event_id, (CASE WHEN t = 1 THEN max(CASE WHEN t = 1 THEN p END) OVER (PARTITION BY user_id, run) ELSE p END)::INTEGER AS adjusted FROM r")
def eval_point_adjust(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") > 20).cast("int").alias("t"), (F.col("event_id") % 3 == 0).cast("int").alias("p"))
    return E.point_adjust(events, "t", "p", ["ts", "event_id"], ["user_id"]).select("event_id", "adjusted")


@query("eval_self", "SELECT round(1 / (1 + exp(-stddev_pop(value) / abs(avg(value)))), 6) AS self_evaluation FROM events")
def eval_self(spark: SparkSession, d: str) -> DataFrame:
    return E.self_evaluation(load(spark, d, "events"), "value").select(F.round("self_evaluation", 6).alias("self_evaluation"))


# Forecasting

DAY = TimeKey(("day",))
USER = TimeKey(("ts", "event_id"), ("user_id",))


@query("fc_split", f"WITH {_DAILY}, r AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM d) SELECT day, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * (0.7 + 0.15)) THEN 'val' ELSE 'test' END AS part FROM r")
def fc_split(spark: SparkSession, d: str) -> DataFrame:
    return P.split(_daily(spark, d), DAY).select("day", "part")


@query("fc_windows", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT a.user_id, a.k::INTEGER AS first, round(max(CASE WHEN b.k = a.k + 7 THEN b.value END), 6) AS base, round(sum(CASE WHEN b.k < a.k + 8 THEN b.value END), 6) AS x_sum, round(max(CASE WHEN b.k = a.k + 9 THEN b.value END) - max(CASE WHEN b.k = a.k + 7 THEN b.value END), 6) + 0.0 AS last_residual FROM r a JOIN r b ON a.user_id = b.user_id AND b.k BETWEEN a.k AND a.k + 9 WHERE a.k + 9 <= a.n GROUP BY a.user_id, a.k")
def fc_windows(spark: SparkSession, d: str) -> DataFrame:
    out = P.samples(load(spark, d, "events"), USER, ["value"], "value", 8, 2)
    total = F.aggregate("x", F.lit(0.0), lambda a, r: a + F.get(r, F.lit(0)))
    return out.select("user_id", "first", F.round("base", 6).alias("base"), F.round(total, 6).alias("x_sum"), (F.round(F.get("residual", F.lit(1)), 6) + 0.0).alias("last_residual"))


@query("fc_last_window", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) SELECT user_id, event_id, (11 - b)::INTEGER AS place FROM r WHERE b <= 10")
def fc_last_window(spark: SparkSession, d: str) -> DataFrame:
    return P.last_window(load(spark, d, "events"), USER, 8, 2).select("user_id", "event_id", "place")


@query("fc_naive_error", f"{_NAIVE} SELECT round(avg(abs(v - p)), 6) AS naive_error FROM l WHERE p IS NOT NULL")
def fc_naive_error(spark: SparkSession, d: str) -> DataFrame:
    return E.naive_error(_daily(spark, d), "v", ["day"]).select(F.round("naive_error", 6).alias("naive_error"))


@query("fc_lagcorr", f"WITH {_DAILY}, " + "s AS (SELECT v" + "".join(f", lag(c, {k}, 0.0) OVER (ORDER BY day) AS l{k}" for k in range(5)) + " FROM d) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(corr(v, l{k}), 6) AS correlation FROM s" for k in range(5)))
def fc_lagcorr(spark: SparkSession, d: str) -> DataFrame:
    return P.lag_correlation(_daily(spark, d), DAY, "v", "c", 4).select("lag", F.round("correlation", 6).alias("correlation"))


@query("fc_linear")
def fc_linear(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    model = P.LinearForecaster(("value",), USER, 8, 2).fit(events)
    return model.run(events).select("user_id", "position", F.round("forecast_0", 6).alias("forecast_0"), F.round("forecast_1", 6).alias("forecast_1"))


@query("fc_model", "WITH r AS (SELECT user_id, value, row_number() OVER o AS k, avg(value) OVER (o ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, k::INTEGER AS position, round(m, 6) AS forecast_0, round(2 * value - m, 6) AS forecast_1 FROM r WHERE k >= 8")
def fc_model(spark: SparkSession, d: str) -> DataFrame:
    """A model from outside as a function of windows (here: their mean, and the last value mirrored at it)."""
    out = P.model_forecast(load(spark, d, "events"), USER, ["value"], 8, 2, lambda x: np.stack([x.mean(axis=(1, 2)), 2 * x[:, -1, 0] - x.mean(axis=(1, 2))], axis=1))
    return out.select("user_id", "position", F.round("forecast_0", 6).alias("forecast_0"), F.round("forecast_1", 6).alias("forecast_1"))


@query("fc_network")
def fc_network(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    model = P.NetworkForecaster(("value",), USER, 8, 2, d_model=16, nhead=2, num_layers=1, lag_max=4, epochs=2, max_windows=2000).fit(events)
    return model.run(events).select("user_id", "position", F.round("forecast_0", 4).alias("forecast_0"), F.round("forecast_1", 4).alias("forecast_1"))


@query("fc_run")
def fc_run(spark: SparkSession, d: str) -> DataFrame:
    """From the table to the scores of the last window, by linear forecasts."""
    run = R.forecast_run(_daily(spark, d), DAY, ["c", "v"], "v", 16, 4, "linear_forecaster")
    return spark.createDataFrame([(n, v) for n, v in sorted(run.scores.items())], "metric string, value double").withColumn("value", F.round("value", 4))


@query("fc_seasonal", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) SELECT user_id, place::INTEGER AS place, round(value, 6) AS forecast FROM r, range(1, 8) t(place) WHERE b = 3 - (place - 1) % 3")
def fc_seasonal(spark: SparkSession, d: str) -> DataFrame:
    return P.seasonal_naive(load(spark, d, "events"), USER, "value", 3, 7).select("user_id", "place", F.round("forecast", 6).alias("forecast"))


# Tuning


@query("hpo_ranksum", "WITH r AS (SELECT s_suppkey, s_acctbal, s_nationkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 + row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS rank_sum FROM supplier) SELECT s_suppkey, rank_sum::DOUBLE AS rank_sum FROM r")
def hpo_ranksum(spark: SparkSession, d: str) -> DataFrame:
    return T.rank_sums(load(spark, d, "supplier"), {"s_acctbal": "max", "s_nationkey": "min"}, "s_suppkey").select("s_suppkey", "rank_sum")


@query("hpo_ranksum_average", "WITH r AS (SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal DESC) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2 + rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2 AS rank_sum FROM supplier) SELECT s_suppkey, rank_sum::DOUBLE AS rank_sum FROM r")
def hpo_ranksum_average(spark: SparkSession, d: str) -> DataFrame:
    return T.rank_sums(load(spark, d, "supplier"), {"s_acctbal": "max", "s_nationkey": "min"}, "s_suppkey", "average").select("s_suppkey", "rank_sum")


def _search(spark: SparkSession, d: str, sampler: str, n: int) -> DataFrame:
    events = load(spark, d, "events")
    scored = D.ZScore(("value",)).fit(events).run(events)

    def objective(params: dict) -> dict[str, float]:
        return {"flagged": float(D.Threshold(params["threshold"]).run(scored).agg(F.avg("label")).first()[0])}

    s = T.Search(T.space(D.ZScoreDetector), {"flagged": "min"}, sampler, seed=7)
    s.run(objective, n)
    return s.frame(spark).select("number", "params", F.round(F.col("scores")["flagged"], 6).alias("flagged"), "state")


@query("hpo_grid_values", f"{_EVENT_Z}, p AS (SELECT i AS number, 1.0::DOUBLE + i * 0.9 AS threshold FROM range(0, 11) t(i)) SELECT number::INTEGER AS number, round(threshold, 6) AS threshold, round(avg((score > threshold)::INTEGER), 6) AS flagged FROM z, p GROUP BY number, threshold")
def hpo_grid_values(spark: SparkSession, d: str) -> DataFrame:
    """The grid's trials by their thresholds."""
    found = _search(spark, d, "grid", 11)
    return found.select(F.col("number").cast("int").alias("number"), F.round(F.get_json_object("params", "$.threshold").cast("double"), 6).alias("threshold"), "flagged")


@query("hpo_best", f"{_EVENT_Z}, p AS (SELECT i AS number, 1.0::DOUBLE + i * 0.9 AS threshold FROM range(0, 11) t(i)), f AS (SELECT number, avg((score > threshold)::INTEGER) AS flagged FROM z, p GROUP BY number) SELECT number::INTEGER AS number, round(flagged, 6) AS flagged FROM f ORDER BY f.flagged DESC, number LIMIT 3")
def hpo_best(spark: SparkSession, d: str) -> DataFrame:
    """The three best trials of a grid."""
    events = load(spark, d, "events")
    scored = D.ZScore(("value",)).fit(events).run(events)
    s = T.Search(T.space(D.ZScoreDetector), {"flagged": "max"}, "grid")
    s.run(lambda p: {"flagged": float(D.Threshold(p["threshold"]).run(scored).agg(F.avg("label")).first()[0])}, 11)
    return spark.createDataFrame([(t.number, t.scores["flagged"]) for t in s.best(3)], "number int, flagged double").withColumn("flagged", F.round("flagged", 6))


@query("hpo_ranksum_top", "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 + row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS rank_sum FROM supplier) SELECT s_suppkey, rank_sum::DOUBLE AS rank_sum FROM r ORDER BY r.rank_sum, s_suppkey LIMIT 5")
def hpo_ranksum_top(spark: SparkSession, d: str) -> DataFrame:
    """The five records of least rank sum, the report's table."""
    ranked = T.rank_sums(load(spark, d, "supplier"), {"s_acctbal": "max", "s_nationkey": "min"}, "s_suppkey")
    return ranked.select("s_suppkey", "rank_sum").orderBy("rank_sum", "s_suppkey").limit(5)


@query("hpo_grid")
def hpo_grid(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "grid", 11)


@query("hpo_random")
def hpo_random(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "random", 6)


@query("hpo_tpe")
def hpo_tpe(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "tpe", 14)
