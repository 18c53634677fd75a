"""Queries of inspection: numbers, times, zones, units and sizes in text cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import inspect as I
from tidemark.operators import prep
from tidemark.plans.catalog import query
from tidemark.runtime import load

_KIND = "event_id % 8"


def _by_rest(*cells) -> F.Column:  # noqa: ANN002
    """One cell for each remainder of the row's id."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(cells):
        out = F.when(F.col("event_id") % len(cells) == i, F.lit(c) if isinstance(c, str) else c).otherwise(out)
    return out


@query(
    "insp_numbers",
    f"SELECT event_id, CASE {_KIND} WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN 1234.5 WHEN 2 THEN user_id::DOUBLE WHEN 3 THEN 1500.0 END AS num, CASE {_KIND} WHEN 0 THEN event_id WHEN 2 THEN user_id WHEN 3 THEN 1500 END::BIGINT AS whole, CASE {_KIND} WHEN 6 THEN user_id::DOUBLE WHEN 7 THEN 0.0 END AS re, CASE {_KIND} WHEN 6 THEN -2.5 WHEN 7 THEN 1.0 END::DOUBLE AS im FROM events",
)
def insp_numbers(spark: SparkSession, d: str) -> DataFrame:
    cell = _by_rest(F.col("event_id").cast("string"), "1,234.5", F.concat("user_id", F.lit(".0")), "1.5e3", "nan", "word", F.concat("user_id", F.lit("-2.5i")), "j")
    rows = load(spark, d, "events").select("event_id", cell.alias("x"))
    return rows.select("event_id", I.number("x").alias("num"), I.integer("x").alias("whole"), I.complex_number("x")["re"].alias("re"), I.complex_number("x")["im"].alias("im"))


_STAMP = "date_trunc('second', ts)"


@query(
    "insp_times",
    f"SELECT event_id, CASE {_KIND} WHEN 0 THEN {_STAMP} WHEN 1 THEN {_STAMP} WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN {_STAMP} WHEN 5 THEN {_STAMP} WHEN 6 THEN {_STAMP} END::TIMESTAMP AS t, CASE {_KIND} WHEN 4 THEN '+08:00' WHEN 5 THEN '+00:00' END AS zone FROM events",
)
def insp_times(spark: SparkSession, d: str) -> DataFrame:
    text = [F.date_format("ts", p) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy/M/d H:mm:ss", "yyyy-M-d HH:mm", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss'+0800'", "yyyy-MM-dd HH:mm:ss'Z'", "yyyyMMddHHmmss")]
    rows = load(spark, d, "events").select("event_id", _by_rest(*text, "soon").alias("x"))
    return rows.select("event_id", I.clock_time("x").alias("t"), I.zone("x").alias("zone"))


@query("insp_zone", "SELECT event_id, ts + INTERVAL 8 HOUR AS there FROM events")
def insp_zone(spark: SparkSession, d: str) -> DataFrame:
    """Clock times from UTC to the zone chosen for sources of which one names none."""
    target = I.choose_zone(["+01:00", None])
    return load(spark, d, "events").select("event_id", I.to_zone(F.col("ts"), "+00:00", target).alias("there"))


@query("insp_size", "SELECT doc_id, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024) || ' KB' WHEN b < 1073741824 THEN printf('%.1f', b / 1048576) || ' MB' ELSE printf('%.2f', b / 1073741824) || ' GB' END AS size FROM (SELECT doc_id, n_chars::BIGINT * 1000 * (1 + doc_id % 5 * doc_id) AS b FROM documents) s")
def insp_size(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("n_chars").cast("long") * 1000 * (1 + F.col("doc_id") % 5 * F.col("doc_id"))
    return load(spark, d, "documents").select("doc_id", I.size_text(size).alias("size"))


@query("insp_monotone", "WITH s AS (SELECT user_id < lag(user_id) OVER (ORDER BY event_id) AS u, ts < lag(ts) OVER (ORDER BY event_id) AS t FROM events) SELECT 'user_id' AS name, NOT coalesce(bool_or(u), false) AS monotone FROM s UNION ALL SELECT 'ts', NOT coalesce(bool_or(t), false) FROM s UNION ALL SELECT 'event_id', true")
def insp_monotone(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    parts = [I.monotone(events, F.col(c), "event_id").select(F.lit(c).alias("name"), "monotone") for c in ("user_id", "ts", "event_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("insp_time_column", "SELECT 'written' AS name, 'ts' AS \"column\", 'timestamp' AS kind UNION ALL SELECT 'counted', 'event_id', 'sequence'")
def insp_time_column(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    found = {"written": I.time_column(events, ["event_type", "value", "ts"], "event_id"), "counted": I.time_column(events, ["event_type", "event_id"], "event_id")}
    return spark.createDataFrame([(n, *f) for n, f in found.items() if f], "name string, column string, kind string")


@query("insp_unit_row", "SELECT event_id, value::VARCHAR AS value FROM events")
def insp_unit_row(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a table whose first row holds units."""
    events = load(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("number"), F.col("value").cast("string").alias("value"))
    first = events.agg((F.min("event_id") - 1).alias("event_id")).select("event_id", F.lit("count").alias("number"), F.lit("kPa").alias("value"))
    return I.drop_unit_row(first.unionByName(events), ["number", "value"], ["event_id"]).select("event_id", "value")


@query("insp_samples", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def insp_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first five rows' cells, a report's samples."""
    return prep.samples(load(spark, d, "events"), ["event_id", "event_type", "value"], ["event_id"])
