"""Queries of feature construction and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import select as S
from tidemark.operators.base import REGISTRY, TimeKey
from tidemark.plans.catalog import query
from tidemark.runtime import load

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEYS = ", ".join(LINE)


def _r(name: str, digits: int = 6):  # noqa: ANN202
    return F.round(F.col(name), digits).alias(name)


@query("feat_square", f"SELECT {_KEYS}, round(l_quantity * l_quantity, 6) AS l_quantity_square, round(l_tax * l_tax, 6) AS l_tax_square FROM lineitem")
def feat_square(spark: SparkSession, d: str) -> DataFrame:
    out = X.Square(["l_quantity", "l_tax"]).run(load(spark, d, "lineitem"))
    return out.select(*LINE, _r("l_quantity_square"), _r("l_tax_square"))


@query("feat_polynomial", f"SELECT {_KEYS}, round(l_quantity ** 2, 6) AS l_quantity_poly_2, round(l_quantity ** 3, 6) AS l_quantity_poly_3, round(l_discount ** 2, 6) AS l_discount_poly_2, round(l_discount ** 3, 6) AS l_discount_poly_3 FROM lineitem")
def feat_polynomial(spark: SparkSession, d: str) -> DataFrame:
    out = X.Polynomial(["l_quantity", "l_discount"], (2, 3)).run(load(spark, d, "lineitem"))
    return out.select(*LINE, *[_r(f"{c}_poly_{k}") for c in ("l_quantity", "l_discount") for k in (2, 3)])


@query("feat_column_median", f"SELECT {_KEYS}, round((list_sort([l_quantity, l_extendedprice, l_discount, l_tax])[2] + list_sort([l_quantity, l_extendedprice, l_discount, l_tax])[3]) / 2, 6) AS l_quantity_l_extendedprice_l_discount_l_tax_median FROM lineitem")
def feat_column_median(spark: SparkSession, d: str) -> DataFrame:
    out = X.ColumnMedian(NUMBERS).run(load(spark, d, "lineitem"))
    return out.select(*LINE, _r("l_quantity_l_extendedprice_l_discount_l_tax_median"))


@query("feat_build", f"SELECT {_KEYS}, round(l_quantity * l_quantity, 6) AS l_quantity_square, round((l_discount + l_tax) / 2, 6) AS l_discount_l_tax_median FROM lineitem")
def feat_build(spark: SparkSession, d: str) -> DataFrame:
    out = X.build(load(spark, d, "lineitem"), [X.Square(["l_quantity"]), X.ColumnMedian(["l_discount", "l_tax"])])
    return out.select(*LINE, _r("l_quantity_square"), _r("l_discount_l_tax_median"))


@query(
    "feat_pca_2d",
    f"""
WITH s AS (SELECT avg(l_quantity) mx, avg(l_discount) my, covar_pop(l_quantity, l_quantity) a, covar_pop(l_quantity, l_discount) b, covar_pop(l_discount, l_discount) c FROM lineitem),
l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS lam FROM s),
v AS (SELECT *, CASE WHEN abs(b) > abs(lam - a) THEN b ELSE lam - c END AS ux, CASE WHEN abs(b) > abs(lam - a) THEN lam - a ELSE b END AS uy FROM l),
n AS (SELECT mx, my, ux / sqrt(ux * ux + uy * uy) AS wx, uy / sqrt(ux * ux + uy * uy) AS wy FROM v),
g AS (SELECT mx, my, wx * (CASE WHEN (CASE WHEN abs(wx) >= abs(wy) THEN wx ELSE wy END) < 0 THEN -1 ELSE 1 END) AS wx, wy * (CASE WHEN (CASE WHEN abs(wx) >= abs(wy) THEN wx ELSE wy END) < 0 THEN -1 ELSE 1 END) AS wy FROM n)
SELECT {_KEYS}, round((l_quantity - mx) * wx + (l_discount - my) * wy, 5) + 0.0 AS pca_0 FROM lineitem, g
""",
)
def feat_pca_2d(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem")
    out = X.Pca(["l_quantity", "l_discount"], 1).fit(lines).run(lines)
    return out.select(*LINE, (F.round("pca_0", 5) + 0.0).alias("pca_0"))


@query("sel_columns", "SELECT l_tax, l_quantity FROM lineitem")
def sel_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.Columns(("l_tax", "l_quantity")).run(load(spark, d, "lineitem"))


@query("sel_variance", "SELECT l_quantity, l_extendedprice FROM lineitem")
def sel_variance(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select(*NUMBERS)
    return S.VarianceThreshold(None, 1.0).fit(lines).run(lines)


# Rolling means of events, per user

_W = 5
KEY = TimeKey(("ts", "event_id"), ("user_id",))


def _window_sql(padding: str | float | None, alignment: str) -> str:
    order = "ts, event_id" if alignment == "right" else "ts DESC, event_id DESC"
    base = f"""
WITH r AS (SELECT user_id, event_id, value AS x, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY {order})),
pad AS (SELECT user_id, event_id, x, i FROM r {{extra}}),
w AS (SELECT event_id, i, user_id, sum(x) OVER f AS s, count(*) OVER f AS c FROM pad WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN {_W - 1} PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, {{value}} AS value_rolling_mean FROM w WHERE i >= 0 {{where}}
"""
    value, where = f"round(s / {_W}, 6)", ""
    if padding is None:
        extra, where = "", f"AND c = {_W}"
    elif padding == "nan":
        extra, value = "", f"CASE WHEN c < {_W} THEN 'NaN'::DOUBLE ELSE round(s / {_W}, 6) END"
    elif padding == "edge":
        extra = f"UNION ALL SELECT user_id, NULL, x, -k FROM r, range(1, {_W}) t(k) WHERE i = 0"
    elif padding == "reflect":
        extra = f"UNION ALL SELECT user_id, NULL, x, -i FROM r WHERE i BETWEEN 1 AND {_W - 1}"
    elif padding == "ring":
        extra = f"UNION ALL SELECT user_id, NULL, x, i - n FROM r WHERE i >= n - {_W - 1}"
    else:
        extra = f"UNION ALL SELECT user_id, NULL, {padding}, -k FROM r, range(1, {_W}) t(k) WHERE i = 0"
    return base.format(extra=extra, value=value, where=where)


def _window_query(padding: str | float | None, alignment: str) -> None:
    label = {None: "none"}.get(padding, "const" if isinstance(padding, float) else padding)

    @query(f"win_mean_{label}_{alignment}", _window_sql(padding, alignment))
    def run(spark: SparkSession, d: str) -> DataFrame:
        events = load(spark, d, "events").select("user_id", "event_id", "ts", "value")
        out = X.RollingMean(("value",), KEY, _W, padding, alignment).run(events)
        return out.select("user_id", "event_id", F.round("value_rolling_mean", 6).alias("value_rolling_mean"))


for _padding in (None, "edge", "nan", 1.5, "reflect", "ring"):
    for _alignment in ("right", "left"):
        _window_query(_padding, _alignment)


# Signal cells: embeddings

_E = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_M = f"{_E}, m AS (SELECT vec_id, count(*) AS n, avg(x) AS mu, var_samp(x) AS v FROM e GROUP BY vec_id)"


def _scalar_sql(expr: str) -> str:
    return f"WITH {_M} SELECT vec_id, round({expr}, 6) + 0.0 AS value FROM e JOIN m USING (vec_id) GROUP BY vec_id, n, mu, v"


_SCALARS = {
    "mean_square": "avg(x * x)",
    "variance": "any_value(v)",
    "rms": "sqrt(avg(x * x))",
    "peak_peak": "max(x) - min(x)",
    "shape_factor": "sqrt(avg(x * x)) / avg(abs(x))",
    "crest": "max(abs(x)) / sqrt(avg(x * x))",
    "impulse": "max(abs(x)) / avg(abs(x))",
    "clearance": "max(abs(x)) / (avg(sqrt(abs(x))) ** 2)",
    "skewness": "avg((x - mu) ** 3) / (sqrt(v) ** 3)",
    "kurtosis": "avg((x - mu) ** 4) / (v * v) - 3",
}
_GINI = f"WITH {_E}, r AS (SELECT vec_id, abs(x) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x)) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM e) SELECT vec_id, round(2 * sum(k * a) / (n * sum(a)) - (n + 1) / n, 6) + 0.0 AS value FROM r GROUP BY vec_id, n"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))


def _signal_query(short: str, label: str, sql: str | None, **config: object) -> None:
    @query(f"sig_{label}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        op = REGISTRY[f"{short}_feature"](("s",), **config)
        out = op.run(_cells(spark, d))
        return out.select("vec_id", (F.round(next(iter(op.columns())), 6) + 0.0).alias("value"))


for _short, _expr in _SCALARS.items():
    _signal_query(_short, _short, _scalar_sql(_expr))
_signal_query("gini_index", "gini_index", _GINI)
_signal_query(
    "average_kurtosis",
    "average_kurtosis",
    f"WITH {_E}, p AS (SELECT vec_id, i // 6 AS g, x FROM e WHERE i < 60), m AS (SELECT vec_id, g, avg(x) AS mu, var_samp(x) AS v FROM p GROUP BY vec_id, g), k AS (SELECT vec_id, g, avg((x - mu) ** 4) / any_value(v * v) - 3 AS k FROM p JOIN m USING (vec_id, g) GROUP BY vec_id, g) SELECT vec_id, round(avg(k), 6) + 0.0 AS value FROM k GROUP BY vec_id",
)

_RATE = 64.0
_DFT = f"{_E}, s AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM e, range(0, 33) t(k) GROUP BY vec_id, k), p AS (SELECT vec_id, k::DOUBLE AS f, re * re + im * im AS p FROM s)"
_C = f"{_DFT}, c AS (SELECT vec_id, sum(f * p) / sum(p) AS c, sum(f * f * p) / sum(p) AS ms FROM p GROUP BY vec_id)"


def _spectral_sql(expr: str) -> str:
    return f"WITH {_C} SELECT vec_id, round({expr}, 6) + 0.0 AS value FROM p JOIN c USING (vec_id) GROUP BY vec_id, c, ms"


_signal_query("spectral_centroid", "centroid", _spectral_sql("any_value(c)"), sample_rate=_RATE)
_signal_query("mean_square_frequency", "mean_square_frequency", _spectral_sql("any_value(ms)"), sample_rate=_RATE)
_signal_query("rms_frequency", "rms_frequency", _spectral_sql("sqrt(any_value(ms))"), sample_rate=_RATE)
_signal_query("frequency_variance", "frequency_variance", _spectral_sql("sum((f - c) ** 2 * p) / sum(p)"), sample_rate=_RATE)
_signal_query("frequency_std", "frequency_std", _spectral_sql("sqrt(sum((f - c) ** 2 * p) / sum(p))"), sample_rate=_RATE)
_signal_query("envelope_rms", "envelope_rms", f"WITH {_DFT} SELECT vec_id, round(sqrt(sum(CASE WHEN f IN (0, 32) THEN p ELSE 4 * p END)) / 64, 6) + 0.0 AS value FROM p GROUP BY vec_id", sample_rate=_RATE)
_signal_query("band_rms", "band_rms", f"WITH {_DFT} SELECT vec_id, round(sqrt(sum(CASE WHEN f IN (0, 32) THEN p ELSE 2 * p END)) / 64, 6) + 0.0 AS value FROM p WHERE f BETWEEN 5 AND 20 GROUP BY vec_id", sample_rate=_RATE, low=5.0, high=20.0)
_signal_query(
    "band_kurtosis",
    "band_kurtosis",
    f"WITH {_E}, s AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM e, range(5, 21) t(k) GROUP BY vec_id, k), y AS (SELECT vec_id, j, sum(2 * (re * cos(2 * pi() * k * j / 64) + im * sin(2 * pi() * k * j / 64))) / 64 AS y FROM s, range(0, 64) u(j) GROUP BY vec_id, j), m AS (SELECT vec_id, avg(y) AS mu, var_samp(y) AS v FROM y GROUP BY vec_id) SELECT vec_id, round(avg((y - mu) ** 4) / any_value(v * v) - 3, 6) + 0.0 AS value FROM y JOIN m USING (vec_id) GROUP BY vec_id",
    sample_rate=_RATE,
    low=5.0,
    high=20.0,
)
_signal_query(
    "spectral_entropy",
    "entropy",
    f"WITH {_E}, m AS (SELECT vec_id, avg(x) AS mu FROM e GROUP BY vec_id), h AS (SELECT vec_id, i, (x - mu) * 0.5 * (1 - cos(2 * pi() * i / 64)) AS x FROM e JOIN m USING (vec_id)), s AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM h, range(0, 33) t(k) GROUP BY vec_id, k), p AS (SELECT vec_id, (re * re + im * im) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) AS p FROM s), q AS (SELECT vec_id, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM p) SELECT vec_id, round(-sum(q * log2(q)) / log2(count(*)), 6) + 0.0 AS value FROM q WHERE q > 0 GROUP BY vec_id",
    sample_rate=_RATE,
)
_signal_query(
    "hnr",
    "hnr",
    f"WITH {_M}, c AS (SELECT a.vec_id, b.i - a.i AS lag, sum((a.x - m.mu) * (b.x - m.mu)) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.i >= a.i JOIN m ON m.vec_id = a.vec_id GROUP BY ALL), q AS (SELECT vec_id, max(CASE WHEN lag > 0 THEN r END) / max(CASE WHEN lag = 0 THEN r END) AS t FROM c GROUP BY vec_id), z AS (SELECT vec_id, least(greatest(t, 0), 0.999999) AS t FROM q) SELECT vec_id, round(CASE WHEN t = 0 THEN '-Infinity'::DOUBLE ELSE 10 * log10(t / (1 - t)) END, 6) + 0.0 AS value FROM z",
    sample_rate=_RATE,
)


def _rows_only(short: str, **config: object) -> None:
    @query(f"sig_{short}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        op = REGISTRY[f"{short}_feature"](("s",), **config)
        out = op.run(_cells(spark, d))
        return out.select("vec_id", F.round(next(iter(op.columns())), 6).alias("value"))


_rows_only("roughness", sample_rate=8000.0)
_rows_only("sharpness", sample_rate=8000.0)
_rows_only("band_hnr", sample_rate=_RATE, low=5.0, high=20.0)
_rows_only("speed_rpm", sample_rate=_RATE, speed_min=60.0, speed_max=1800.0)


@query("sig_spectral_fused", f"WITH {_C} SELECT vec_id, round(any_value(c), 6) AS centroid, round(sqrt(any_value(ms)), 6) AS rms_frequency, round(sqrt(sum((f - c) ** 2 * p) / sum(p)), 6) AS frequency_std FROM p JOIN c USING (vec_id) GROUP BY vec_id, c, ms")
def sig_spectral_fused(spark: SparkSession, d: str) -> DataFrame:
    """Several features from one kernel call."""
    from tidemark.functions import spectral

    names = ["centroid", "rms_frequency", "frequency_std"]
    return _cells(spark, d).select("vec_id", spectral.features(F.col("s"), names, rate=_RATE).alias("f")).select("vec_id", *[F.round(f"f.{n}", 6).alias(n) for n in names])


# Smooth features, one row a value

_WIN = 8
_S = f"{_E}, w AS (SELECT a.vec_id, a.i, b.i - a.i + 7 AS j, b.x FROM e a JOIN (SELECT vec_id, i, x FROM e UNION ALL SELECT vec_id, i - 64, x FROM e) b ON a.vec_id = b.vec_id AND b.i BETWEEN a.i - 7 AND a.i)"


def _smooth_sql(expr: str, after: str = "v") -> str:
    grad = "CASE WHEN i = 0 THEN lead(v) OVER o - v WHEN i = 63 THEN v - lag(v) OVER o ELSE (lead(v) OVER o - lag(v) OVER o) / 2 END"
    second = "(CASE WHEN i = 63 THEN lag(v) OVER o ELSE lead(v) OVER o END) - 2 * v + (CASE WHEN i = 0 THEN lead(v) OVER o ELSE lag(v) OVER o END)"
    value = {"v": "v", "grad": grad, "second": second}[after]
    return f"WITH {_S}, g AS (SELECT vec_id, i, {expr} AS v FROM w GROUP BY vec_id, i) SELECT vec_id, i::INTEGER AS pos, round({value}, 6) + 0.0 AS value FROM g WINDOW o AS (PARTITION BY vec_id ORDER BY i)"


_SMOOTH = {
    "mean": _smooth_sql("avg(x)"),
    "min": _smooth_sql("min(x)"),
    "max": _smooth_sql("max(x)"),
    "std": _smooth_sql("stddev_samp(x)"),
    "slope": _smooth_sql("(sum(j * x) - sum(x) * 3.5) / 42"),
    "grad_mean": _smooth_sql("avg(x)", "grad"),
    "grad_std": _smooth_sql("stddev_samp(x)", "grad"),
    "grad2_mean": _smooth_sql("avg(x)", "second"),
    "fft_energy": _smooth_sql("(8 * sum(x * x) + sum(x) ** 2 + sum(CASE WHEN j % 2 = 0 THEN x ELSE -x END) ** 2) / 2"),
}


def _smooth_query(short: str) -> None:
    @query(f"smooth_{short}", _SMOOTH[short])
    def run(spark: SparkSession, d: str) -> DataFrame:
        op = REGISTRY[f"smooth_{short}_feature"](("s",), _WIN)
        out = op.run(_cells(spark, d))
        return out.select("vec_id", F.posexplode(next(iter(op.columns()))).alias("pos", "v")).select("vec_id", "pos", (F.round("v", 6) + 0.0).alias("value"))


for _short in _SMOOTH:
    _smooth_query(_short)
