"""Queries of preparation: profile, clean, resample, merge, segment; and of event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import prep as P
from tidemark.plans.catalog import query
from tidemark.runtime import load


@query(
    "prep_profile",
    """
WITH x AS (SELECT 'c_name' AS column, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer),
t AS (SELECT *, CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'na', 'n/a', '#n/a', 'nan', 'null', 'none', '-', '--', 'nil') THEN 'none' WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN 'int' ELSE 'str' END AS kind FROM x)
SELECT "column", count(*) AS n_rows, count(*) FILTER (kind = 'none') AS n_missing, count(DISTINCT v) FILTER (kind <> 'none') AS n_distinct, count(*) FILTER (kind = 'int') AS n_int, min(TRY_CAST(v AS DOUBLE)) FILTER (kind = 'int') AS min_value, max(TRY_CAST(v AS DOUBLE)) FILTER (kind = 'int') AS max_value
FROM t GROUP BY 1
""",
)
def prep_profile(spark: SparkSession, d: str) -> DataFrame:
    out = P.profile(load(spark, d, "customer"), ["c_name", "c_mktsegment", "c_nationkey"])
    return out.select("column", "n_rows", "n_missing", "n_distinct", "n_int", "min_value", "max_value")


@query("prep_na", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') OR event_id % 7 IN (0, 1) THEN NULL WHEN event_id % 7 = 2 THEN 'missing' ELSE event_type END AS event_type FROM (SELECT event_id, event_type FROM events)")
def prep_na(spark: SparkSession, d: str) -> DataFrame:
    kind, rest = F.col("event_type"), F.col("event_id") % 7
    cell = F.when(kind == "click", " N/A ").when(kind == "view", "None").when(rest == 0, "nil").when(rest == 1, " NIL").when(rest == 2, "missing").otherwise(kind)
    return P.normalise_na(load(spark, d, "events").select("event_id", cell.alias("event_type")), ["event_type"])


def _typed(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(F.col("event_id") % 20 == 0, "bad").when(F.col("event_id") % 3 == 0, F.concat(F.floor("value").cast("string"), F.lit(".5"))).otherwise(F.col("event_id").cast("string"))
    return load(spark, d, "events").select("event_id", cell.alias("cell"))


@query("prep_type_counts", "SELECT 'cell' AS \"column\", CASE WHEN event_id % 20 = 0 THEN 'str' WHEN event_id % 3 = 0 THEN 'float' ELSE 'int' END AS type, count(*) AS n FROM events GROUP BY 2")
def prep_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.type_counts(_typed(spark, d), ["cell"])


@query("prep_type", "SELECT event_id, CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 3 = 0 THEN floor(value) + 0.5 ELSE event_id::DOUBLE END AS cell FROM events WHERE true")
def prep_type(spark: SparkSession, d: str) -> DataFrame:
    return P.convert_types(_typed(spark, d), {"cell": "float"})


@query("prep_unit", "SELECT p_partkey, round(p_retailprice * 0.001::DOUBLE, 6) AS kilo, round(p_size::DOUBLE * 9 / 5 + 32, 6) AS fahrenheit, round(p_size::DOUBLE * 100, 6) AS pascal, round((p_size::DOUBLE - 32) * 5 / 9 + 273.15, 6) AS kelvin, round(p_size::DOUBLE * 0.000001, 9) AS amps, round(p_size::DOUBLE / 1000000, 9) AS seconds, round(p_size::DOUBLE / 1000, 6) AS grams FROM part")
def prep_unit(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    return part.select("p_partkey", F.round(P.convert_unit(F.col("p_retailprice"), "mw", "W"), 6).alias("kilo"), F.round(P.convert_unit(F.col("p_size").cast("double"), "°C", "f"), 6).alias("fahrenheit"), *[F.round(P.convert_unit(F.col("p_size").cast("double"), a, b), digits).alias(name) for name, a, b, digits in (("pascal", "mbar", "Pa", 6), ("kelvin", "Fahrenheit", "k", 6), ("amps", "uA", "amp", 9), ("seconds", "us", "s", 9), ("grams", "mg", "g", 6))])


_CODES = "c AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1)"


@query("prep_category", f"WITH {_CODES} SELECT o_orderkey, code::VARCHAR AS o_orderpriority FROM orders JOIN c ON o_orderpriority = v")
def prep_category(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return P.encode_category(orders, "o_orderpriority", P.first_seen_codes(orders, "o_orderpriority", ["o_orderkey"]))


@query("prep_category_codes", f"WITH {_CODES} SELECT v AS value, code::INTEGER AS code FROM c")
def prep_category_codes(spark: SparkSession, d: str) -> DataFrame:
    return P.first_seen_codes(load(spark, d, "orders"), "o_orderpriority", ["o_orderkey"])


@query("prep_label", "SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS toxic FROM labels")
def prep_label(spark: SparkSession, d: str) -> DataFrame:
    signed = load(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(-1).alias("toxic"))
    return P.encode_label(signed, "toxic")


@query("prep_outlier", "SELECT event_id, CASE WHEN value < 1 OR value > 50 THEN NULL ELSE value END AS value, CASE WHEN user_id IN (3, 7) THEN NULL ELSE user_id END AS user_id FROM events")
def prep_outlier(spark: SparkSession, d: str) -> DataFrame:
    return P.drop_outliers(load(spark, d, "events").select("event_id", "value", "user_id"), {"value": (1.0, 50.0)}, {"user_id": [3, 7]})


@query("prep_interval_mode", "WITH s AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS m FROM events), c AS (SELECT m, count(*) AS n FROM s WHERE m IS NOT NULL GROUP BY m) SELECT round(m / 1000000, 6) AS mode_seconds FROM c ORDER BY n DESC, m LIMIT 1")
def prep_interval_mode(spark: SparkSession, d: str) -> DataFrame:
    return P.mode_interval(load(spark, d, "events"), "ts").select(F.round("mode_seconds", 6).alias("mode_seconds"))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events' values at whole seconds, each event type a column."""
    at = F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("t")
    rows = load(spark, d, "events").select(at, "event_type", "value", "event_id")
    return rows.groupBy("t").agg(*[F.max_by(F.when(F.col("event_type") == k, F.col("value")), F.when(F.col("event_type") == k, F.col("event_id"))).alias(k) for k in ("click", "view")])


_H = "h AS (SELECT date_trunc('second', ts) AS t, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY 1)"
_G = "g AS (SELECT unnest(generate_series((SELECT min(t) FROM h), (SELECT max(t) FROM h), INTERVAL 3600 SECOND)) AS t)"


@query("prep_grid", f"WITH {_H}, {_G} SELECT t FROM g")
def prep_grid(spark: SparkSession, d: str) -> DataFrame:
    return P.grid(_hourly(spark, d), "t", 3600)


@query(
    "prep_grid_choice",
    f"""
WITH {_H}, b AS (SELECT min(epoch_us(t)) AS t0, max(epoch_us(t)) AS t1 FROM h),
c AS (SELECT epoch_us(t) AS u, 'click' AS k FROM h WHERE click IS NOT NULL UNION ALL SELECT epoch_us(t), 'view' FROM h WHERE view IS NOT NULL),
o AS (SELECT s, k, count(*) AS n, count(*) FILTER ((u - t0) % (s * 1000000) = 0) AS a, any_value((t1 - t0) // (s * 1000000) + 1) AS p FROM c, b, (SELECT unnest([60, 600, 3600])::BIGINT AS s) q GROUP BY s, k)
SELECT s::INTEGER AS seconds, sum(p - a)::BIGINT AS added, sum(n - a)::BIGINT AS deleted, sum(p - a + n - a)::BIGINT AS changed FROM o GROUP BY s
""",
)
def prep_grid_choice(spark: SparkSession, d: str) -> DataFrame:
    return P.grid_choice(_hourly(spark, d), "t", ["click", "view"], [60, 600, 3600])


@query("prep_resample_backward", f"WITH {_H}, {_G}, f AS (SELECT arg_min(click, t) AS v FROM h WHERE click IS NOT NULL) SELECT g.t, coalesce(c.click, f.v) AS click FROM g ASOF LEFT JOIN (SELECT t, click FROM h WHERE click IS NOT NULL) c ON g.t >= c.t, f")
def prep_resample_backward(spark: SparkSession, d: str) -> DataFrame:
    data = _hourly(spark, d)
    return P.as_of(P.grid(data, "t", 3600), data, "t", ["click"], [])


@query("prep_resample_nearest", f"WITH {_H}, {_G}, n AS (SELECT t, click FROM h WHERE click IS NOT NULL), b AS (SELECT g.t, n.t AS bt, n.click AS bv FROM g ASOF LEFT JOIN n ON g.t >= n.t), a AS (SELECT g.t, n.t AS ct, n.click AS av FROM g ASOF LEFT JOIN n ON g.t < n.t) SELECT t, CASE WHEN ct IS NULL OR t - bt <= ct - t THEN bv ELSE av END AS click FROM b JOIN a USING (t)")
def prep_resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    data = _hourly(spark, d)
    return P.as_of(P.grid(data, "t", 3600), data, "t", ["click"], [], "nearest")


_N = "r AS (SELECT user_id, event_id, ts, CASE WHEN value > 8 THEN NULL ELSE value END AS x FROM events)"
_GAPS = f"{_N}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM r), i AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, x IS NULL ORDER BY rn) AS isl FROM k)"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("user_id", "event_id", "ts", F.when(~(F.col("value") > 8), F.col("value")).alias("x"))


@query("prep_gaps", f"WITH {_GAPS} SELECT user_id, min(rn) AS first_row, count(*) AS length, CAST(count(*) >= 3 AS INTEGER) AS is_long FROM i WHERE x IS NULL GROUP BY user_id, isl")
def prep_gaps(spark: SparkSession, d: str) -> DataFrame:
    return P.gaps(_holes(spark, d), "x", ["ts", "event_id"], ["user_id"], 3)


_FILL = f"{_GAPS}, l AS (SELECT *, x IS NULL AND count(*) OVER (PARTITION BY user_id, x IS NULL, isl) >= 3 AS long FROM i), p AS (SELECT *, sum(long::INTEGER) OVER (PARTITION BY user_id ORDER BY rn) AS part FROM l)"


@query("prep_fill", f"WITH {_FILL} SELECT event_id, CASE WHEN long THEN NULL ELSE coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS filled FROM p")
def prep_fill(spark: SparkSession, d: str) -> DataFrame:
    return P.fill(_holes(spark, d), "x", ["ts", "event_id"], ["user_id"], 3).select("event_id", "filled")


@query("prep_fill_nearest", f"WITH {_FILL}, q AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id, part ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM p) SELECT q.event_id, CASE WHEN q.long THEN NULL ELSE n.x END AS filled FROM q LEFT JOIN p n ON n.user_id = q.user_id AND n.rn = CASE WHEN q.b IS NULL THEN q.a WHEN q.a IS NULL OR q.rn - q.b <= q.a - q.rn THEN q.b ELSE q.a END")
def prep_fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    return P.fill(_holes(spark, d), "x", ["ts", "event_id"], ["user_id"], 3, "nearest").select("event_id", "filled")


@query("prep_segments", f"WITH {_N}, s AS (SELECT *, CASE WHEN x IS NOT NULL AND coalesce(lag(x IS NULL) OVER w, true) THEN 1 ELSE 0 END AS o FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM s) SELECT event_id, segment::BIGINT AS segment FROM n WHERE x IS NOT NULL")
def prep_segments(spark: SparkSession, d: str) -> DataFrame:
    return P.segments(_holes(spark, d), ["x"], ["ts", "event_id"], ["user_id"]).select("event_id", "segment")


@query("prep_precision_recovery", "WITH m AS (SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderdate) AS n FROM orders) SELECT o_orderkey, CASE WHEN 60000000 % n = 0 THEN (epoch_us(o_orderdate) + i * (60000000 // n))::BIGINT END AS recovered FROM m")
def prep_precision_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Every order, a day's orders as a run of equal stamps; days whose count does not divide a minute have no recovered times."""
    return P.recover_precision(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"], uneven="null").select("o_orderkey", "recovered")


@query("prep_unit_names", "SELECT n_name, n_name || '_x' AS base, CASE n_nationkey % 4 WHEN 0 THEN '℃' WHEN 1 THEN 'kPa' WHEN 2 THEN NULL ELSE 'mm' END AS unit FROM nation")
def prep_unit_names(spark: SparkSession, d: str) -> DataFrame:
    """Units in full-width and plain brackets; names come from the table's rows as column names would."""
    rows = load(spark, d, "nation").select("n_name", "n_nationkey").collect()
    heads = ["{}_x（℃）", "{}_x (kPa)", "{}_x", "{}_x（mm)"]
    return spark.createDataFrame([(r.n_name, *P.unit_of(heads[r.n_nationkey % 4].format(r.n_name))) for r in rows], "n_name string, base string, unit string")


def _by_type(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return _hourly(spark, d).filter(F.col(kind).isNotNull()).select("t", kind)


@query("prep_merge_columns", f"WITH {_H} SELECT t, click, view FROM h WHERE click IS NOT NULL OR view IS NOT NULL")
def prep_merge_columns(spark: SparkSession, d: str) -> DataFrame:
    return P.merge_columns([_by_type(spark, d, "click"), _by_type(spark, d, "view")], "t")


@query("prep_merge_rows", "SELECT event_id, value, NULL::BIGINT AS user_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_type = 'view'")
def prep_merge_rows(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return P.merge_rows([events.filter("event_type = 'click'").select("event_id", "value"), events.filter("event_type = 'view'").select("event_id", "user_id")])


@query("prep_merge_aligned", f"WITH {_H} SELECT t, click, view FROM h WHERE click IS NOT NULL OR view IS NOT NULL")
def prep_merge_aligned(spark: SparkSession, d: str) -> DataFrame:
    clicks = _by_type(spark, d, "click")
    early = F.dayofmonth("t") <= 15
    return P.merge_aligned([clicks.filter(early), _by_type(spark, d, "view"), clicks.filter(~early)], "t")


@query("prep_merge_conflicts", f"WITH {_H} SELECT t, 'click' AS \"column\", floor(click)::BIGINT::VARCHAR AS a, (floor(click) + 1)::BIGINT::VARCHAR AS b FROM h WHERE click > 50")
def prep_merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    clicks = _by_type(spark, d, "click").select("t", F.floor("click").alias("click"), F.col("click").alias("v"))
    other = clicks.select("t", F.when(F.col("v") > 50, F.col("click") + 1).otherwise(F.col("click")).alias("click"))
    return P.conflicts(clicks.select("t", "click"), other, "t")


@query("prep_overlap", "WITH a AS (SELECT min(epoch_us(ts)) l, max(epoch_us(ts)) h FROM events WHERE event_type = 'click'), b AS (SELECT min(epoch_us(ts)) l, max(epoch_us(ts)) h FROM events WHERE event_type = 'view') SELECT round(greatest(0, least(a.h, b.h) - greatest(a.l, b.l))::DOUBLE / least(a.h - a.l, b.h - b.l), 6) AS overlap FROM a, b")
def prep_overlap(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return P.overlap_share(events.filter("event_type = 'click'"), events.filter("event_type = 'view'"), "ts").select(F.round("overlap", 6).alias("overlap"))


@query("prep_quality", "WITH s AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS m FROM events) SELECT (SELECT count(*) FROM events) AS n_rows, 6 AS n_columns, (SELECT count(*) FROM events WHERE value IS NULL) AS missing_value, count(DISTINCT m) AS n_intervals FROM s")
def prep_quality(spark: SparkSession, d: str) -> DataFrame:
    return P.quality(load(spark, d, "events"), "ts", ["value"])


def _chain_sql(by: str) -> str:
    """The chain over hours by SQL, whole or with a chain for each value of a key."""
    k, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    match = f"g.{by} = c.{by} AND " if by else ""
    rows = f"SELECT {k}date_trunc('second', ts) AS t, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY ALL HAVING count(*) FILTER (event_type IN ('click', 'view')) > 0"
    cell = lambda c: f"{c} AS (SELECT {k}t, {c} FROM h WHERE {c} IS NOT NULL), f{c} AS (SELECT {k}min(t) AS ft, arg_min({c}, t) AS fv FROM {c} GROUP BY ALL)"
    at = lambda c: f"a{c} AS (SELECT {'g.' + k if by else ''}g.t, coalesce(c.{c}, f.fv) AS v, coalesce(c.t, f.ft) AS s FROM g ASOF LEFT JOIN {c} c ON {match}g.t >= c.t LEFT JOIN f{c} f {('ON f.' + by + ' = g.' + by) if by else 'ON true'})"
    kept = lambda c: f"CASE WHEN abs(epoch_us(a{c}.t) - epoch_us(a{c}.s)) < 24 * 3600 * 1000000::BIGINT THEN a{c}.v END AS {c}"
    part = f"PARTITION BY {by} " if by else ""
    both = f"aclick JOIN aview USING ({k}t)"
    return f"""
WITH r AS ({rows}), h AS (SELECT * REPLACE (CASE WHEN click BETWEEN 0 AND 1000 THEN click END AS click) FROM r),
e AS (SELECT {k}min(t) AS t0, max(t) AS t1 FROM h GROUP BY ALL), g AS (SELECT {k}unnest(generate_series(t0, t1, INTERVAL 3600 SECOND)) AS t FROM e),
{cell("click")}, {cell("view")}, {at("click")}, {at("view")},
j AS (SELECT {k}aclick.t AS t, {kept("click")}, {kept("view")} FROM {both}),
o AS (SELECT *, click IS NULL AND view IS NULL AS cut FROM j),
s AS (SELECT *, CASE WHEN NOT cut AND coalesce(lag(cut) OVER ({part}ORDER BY t), true) THEN 1 ELSE 0 END AS opens FROM o),
n AS (SELECT *, sum(opens) OVER ({part}ORDER BY t) AS segment FROM s)
SELECT {k}t, click, view, segment::BIGINT AS segment FROM n WHERE NOT cut
"""


@query("prep_chain", _chain_sql(""))
def prep_chain(spark: SparkSession, d: str) -> DataFrame:
    """Merge, clean, resample and segment in one plan."""
    spec = P.PrepSpec(time="t", columns=["click", "view"], seconds=3600, k=24, ranges={"click": (0.0, 1000.0)})
    return P.run_chain([_by_type(spark, d, "click"), _by_type(spark, d, "view")], spec)


@query("prep_chain_series", _chain_sql("user_id"))
def prep_chain_series(spark: SparkSession, d: str) -> DataFrame:
    """The same for each user, in parallel."""
    second = F.date_trunc("second", "ts").cast("timestamp_ntz").alias("t")
    parts = [load(spark, d, "events").filter(F.col("event_type") == k).groupBy("user_id", second).agg(F.max_by("value", "event_id").alias(k)) for k in ("click", "view")]
    spec = P.PrepSpec(time="t", columns=["click", "view"], seconds=3600, k=24, ranges={"click": (0.0, 1000.0)}, partition_by=["user_id"])
    return P.run_chain(parts, spec)
