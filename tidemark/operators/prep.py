"""Preparation of time tables: profile, merge, clean, resample, segment.

Cells come in as text or numbers; NA tokens and NaN become null here. Order-sensitive steps
name their time column. Everything is lazy but the few decisions that depend on data
(dominant types, the grid's interval), which are aggregates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Cells that count as missing, trimmed and lower-cased.
NA_TOKENS = ("", "na", "n/a", "#n/a", "nan", "null", "none", "-", "--", "nil")

#: Unit -> (class, factor to the class's base unit). Degrees have no factor.
UNITS = {
    "a": ("current", 1.0), "amp": ("current", 1.0), "amps": ("current", 1.0), "ma": ("current", 0.001), "ua": ("current", 0.000001),
    "v": ("voltage", 1.0), "mv": ("voltage", 0.001), "kv": ("voltage", 1000.0),
    "w": ("power", 1.0), "kw": ("power", 1000.0), "mw": ("power", 0.001),
    "celsius": ("temperature", None), "c": ("temperature", None), "fahrenheit": ("temperature", None), "f": ("temperature", None), "k": ("temperature", None),
    "hz": ("frequency", 1.0), "khz": ("frequency", 1000.0), "mhz": ("frequency", 1000000.0),
    "pa": ("pressure", 1.0), "kpa": ("pressure", 1000.0), "mpa": ("pressure", 1000000.0), "bar": ("pressure", 100000.0), "mbar": ("pressure", 100.0),
    "rpm": ("rpm", 1.0),
    "g": ("mass", 1.0), "mg": ("mass", 0.001), "kg": ("mass", 1000.0), "t": ("mass", 1000000.0),
    "mm": ("length", 1.0), "cm": ("length", 10.0), "m": ("length", 1000.0), "km": ("length", 1000000.0), "um": ("length", 0.001),
    "s": ("duration", 1.0), "ms": ("duration", 0.001), "us": ("duration", 0.000001),
    "rms": ("dimensionless", 1.0), "%": ("dimensionless", 1.0), "db": ("dimensionless", 1.0),
}
#: Other spellings of units.
ALIASES = {"°c": "celsius", "℃": "celsius", "°f": "fahrenheit", "℉": "fahrenheit", "amp": "amps"}
_DEGREES = {"celsius": "c", "c": "c", "fahrenheit": "f", "f": "f", "k": "k"}


def is_na(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.isNull() | F.lower(F.trim(col.cast("string"))).isin(*NA_TOKENS)


def normalise_na(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~is_na(c), F.col(c)) for c in columns})


def cell_type(c: str) -> Column:
    """none, int, float, complex or str."""
    t = F.trim(F.col(c).cast("string"))
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    return (
        F.when(is_na(c), "none")
        .when(t.rlike(r"^[+-]?\d+$"), "int")
        .when(t.rlike(rf"^{number}$") | F.lower(t).rlike(r"^[+-]?inf(inity)?$"), "float")
        .when(t.rlike(rf"^(?:{number})?(?:[+-]?(?:\d+\.?\d*|\.\d+)?(?:[eE][+-]?\d+)?)[ij]$"), "complex")
        .otherwise("str")
    )


LEVELS = ("int", "float", "complex", "str")


def type_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, type, n: one pass over all columns."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cell_type(c).alias("type")) for c in columns]))
    return df.select(kinds.alias("x")).groupBy("x.column", "x.type").agg(F.count("*").alias("n"))


def target_types(counts: DataFrame, share: float = 0.9) -> dict[str, str]:
    """Per column: its dominant type where that has ``share`` of the filled cells (the lower one for ties), else the highest present."""
    by: dict[str, dict[str, int]] = {}
    for r in counts.filter("type <> 'none'").collect():
        by.setdefault(r["column"], {})[r["type"]] = r["n"]
    out = {}
    for c, n in by.items():
        top = max(LEVELS, key=lambda t: (n.get(t, 0), -LEVELS.index(t)))
        out[c] = top if n[top] >= share * sum(n.values()) else max(n, key=LEVELS.index)
    return out


def convert_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cells as the asked type, null where they cannot be."""
    as_type = {"int": lambda c: F.when(cell_type(c).isin("int", "float"), F.floor(F.expr(f"try_cast(trim(`{c}`) as double)")).cast("long")), "float": lambda c: F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)"), "complex": lambda c: F.when(cell_type(c) != "str", F.col(c).cast("string")), "str": lambda c: F.col(c).cast("string")}
    return df.withColumns({c: as_type[t](c) for c, t in types.items()})


def unit_of(name: str) -> tuple[str, str | None]:
    """A column name without its unit, and the unit: in brackets at the end, or a known suffix after ``_``."""
    if m := re.fullmatch(r"(.*?)\s*[(\uff08]\s*([^()\uff08\uff09]+?)\s*[)\uff09]\s*", name):
        return m[1], m[2]
    for size in range(len(name)):
        tail = name[size:]
        if tail.startswith("_") and tail[1:].lower() in UNITS:
            return name, tail[1:].lower()
    return name, None


def canonical(unit: str) -> str:
    u = unit.strip().lower()
    return ALIASES.get(u, u)


def convert_unit(c: Column, source: str, target: str) -> Column:
    """A value in another unit of its class; degrees by way of Celsius."""
    a, b = canonical(source), canonical(target)
    if a == b:
        return c
    if a not in UNITS or b not in UNITS:
        raise ValueError(f"unknown unit {source!r} or {target!r}")
    if UNITS[a][0] != UNITS[b][0]:
        raise ValueError(f"{source} is {UNITS[a][0]}, {target} is {UNITS[b][0]}")
    if a in _DEGREES:
        celsius = {"c": c, "f": (c - 32) * 5 / 9, "k": c - 273.15}[_DEGREES[a]]
        value = {"c": celsius, "f": celsius * 9 / 5 + 32, "k": celsius + 273.15}[_DEGREES[b]]
    else:
        value = c * F.lit(UNITS[a][1] / UNITS[b][1])
    near = F.round(value, 6)
    return F.when(F.abs(value - near) < 1e-9, near).otherwise(value)


def first_seen_codes(df: DataFrame, column: str, order_by: list[str], given: dict[str, int] | None = None) -> DataFrame:
    """value, code: 0, 1, ... by first appearance; a given map goes first and is not extended."""
    if given is not None:
        return df.sparkSession.createDataFrame(sorted(given.items()), "value string, code int")
    first = df.filter(~is_na(column)).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*order_by)).alias("o"))
    # One row for each category.
    return first.select("value", (F.row_number().over(Window.orderBy("o")) - 1).cast("int").alias("code"))


def encode_category(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The column's codes as text; a value without a code stays."""
    hit = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    return df.join(hit, F.col(column) == F.col("_v"), "left").withColumn(column, F.coalesce(F.col("_c").cast("string"), F.col(column))).drop("_v", "_c")


def encode_label(df: DataFrame, column: str) -> DataFrame:
    """0/1 labels stay, -1/1 become 1/0; anything else is an error."""
    seen = {r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().limit(3).collect()}
    if seen <= {0, 1}:
        return df
    if seen <= {-1, 1}:
        return df.withColumn(column, F.when(F.col(column) == 1, 0).when(F.col(column) == -1, 1))
    raise ValueError(f"{column}: labels must be 0/1 or -1/1, there are {sorted(seen)}")


def drop_outliers(df: DataFrame, ranges: dict[str, tuple[float, float]], sentinels: dict[str, list[float]] | None = None) -> DataFrame:
    """Null where a value is outside its inclusive range or equals a sentinel."""
    out = {}
    for c in set(ranges) | set(sentinels or {}):
        bad = F.lit(False)
        if c in ranges:
            bad = bad | ~F.col(c).between(*ranges[c])
        if sentinels and c in sentinels:
            bad = bad | F.col(c).isin(*sentinels[c])
        out[c] = F.when(~F.coalesce(bad, F.lit(False)), F.col(c))
    return df.withColumns(out)


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: rows, missing, distinct, numeric share, min, max, and the judged type."""
    columns = columns or df.columns
    cells = []
    for c in columns:
        kind = cell_type(c)
        cells.append(F.struct(F.lit(c).alias("column"), F.when(~is_na(c), F.col(c).cast("string")).alias("value"), kind.alias("kind"), F.expr(f"try_cast(replace(trim(cast(`{c}` as string)), ',', '') as double)").alias("number")))
    x = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    facts = x.groupBy("column").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("kind") == "none").alias("n_missing"),
        F.count_distinct("value").alias("n_distinct"),
        F.count_if(F.col("kind") == "int").alias("n_int"),
        F.count_if(F.col("kind") == "float").alias("n_float"),
        F.count_if(F.col("kind") == "complex").alias("n_complex"),
        F.min(F.when(F.col("kind").isin("int", "float"), F.col("number"))).alias("min_value"),
        F.max(F.when(F.col("kind").isin("int", "float"), F.col("number"))).alias("max_value"),
        F.count_if(F.col("value").isNotNull() & ~F.col("value").isin("0", "1", "-1")).alias("n_not_label"),
    )
    filled = F.col("n_rows") - F.col("n_missing")
    few = (F.col("n_distinct") <= 20) & (F.col("n_distinct") < 0.05 * filled)
    number = F.col("n_int") + F.col("n_float")
    judged = (
        F.when(filled == 0, "unknown")
        .when((F.col("n_not_label") == 0) & (F.col("n_distinct") == 2), "label")
        .when(F.col("n_complex") >= 0.9 * filled, "complex")
        .when(few & (F.col("n_int") == filled), "category_int")
        .when(few & (number < 0.9 * filled), "category_str")
        .when(F.col("n_int") == filled, "numeric_int")
        .when(number >= 0.9 * filled, "numeric_float")
        .otherwise("string")
    )
    return facts.withColumn("judged", judged).drop("n_not_label")


def samples(df: DataFrame, columns: list[str], order_by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows' cells."""
    return df.orderBy(*order_by).limit(n).select(*columns)


# Time


def intervals(df: DataFrame, time: str, partition_by: list[str] | None = None) -> DataFrame:
    """``seconds`` from each row to the next."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(time)
    return df.select(*(partition_by or []), (F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w)).alias("micros")).filter("micros is not null").withColumn("seconds", F.col("micros") / 1_000_000)


def mode_interval(df: DataFrame, time: str, partition_by: list[str] | None = None) -> DataFrame:
    """The most frequent step, the smallest of ties; 1 second where there is none."""
    steps = intervals(df, time, partition_by).groupBy(*(partition_by or []), "micros").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), -F.col("micros")))
    return steps.groupBy(*(partition_by or [])).agg((F.coalesce(-best["col2"], F.lit(1_000_000)) / 1_000_000).alias("mode_seconds"))


def grid(df: DataFrame, time: str, seconds: int, partition_by: list[str] | None = None) -> DataFrame:
    """``t``: first to last time by a step of ``seconds``, inclusive."""
    if seconds <= 0:
        raise ValueError("a grid needs a positive interval")
    ends = df.groupBy(*(partition_by or [])).agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    return ends.select(*(partition_by or []), F.explode(F.sequence("t0", "t1", F.expr(f"interval {int(seconds)} seconds"))).alias("t"))


def grid_choice(df: DataFrame, time: str, columns: list[str], candidates: list[int]) -> DataFrame:
    """For each candidate interval, how many cells it adds to and deletes from the columns; the best has fewest, then is longest."""
    cells = df.select(F.col(time).alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("has")) for c in columns])).alias("x")).filter("x.has").select("t", F.col("x.column").alias("column")).distinct()
    ends = df.agg(F.unix_micros(F.min(time).cast("timestamp")).alias("t0"), F.unix_micros(F.max(time).cast("timestamp")).alias("t1")).first()
    micros = F.unix_micros(F.col("t").cast("timestamp")) - F.lit(ends["t0"])
    on = cells.groupBy("column").agg(F.count("*").alias("n"), *[F.count_if(micros % (s * 1_000_000) == 0).alias(f"on_{s}") for s in candidates])
    options = on.select("column", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("seconds"), F.col(f"on_{s}").alias("aligned"), F.lit((ends["t1"] - ends["t0"]) // (s * 1_000_000) + 1).alias("points")) for s in candidates])).alias("o"))
    return options.groupBy(F.col("o.seconds").alias("seconds")).agg(F.sum(F.col("o.points") - F.col("o.aligned")).cast("long").alias("added"), F.sum(F.col("n") - F.col("o.aligned")).cast("long").alias("deleted")).withColumn("changed", F.col("added") + F.col("deleted"))


def _back_and_ahead(partition_by: list[str], order_by: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """Frames from the start to a row, and from the end back to it.

    The second is a running frame of the reversed order: a frame to the end would be gone
    through anew for every row.
    """
    part = Window.partitionBy(*partition_by)
    return tuple(part.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order_by, [F.col(c).desc() for c in order_by]))


def as_of(points: DataFrame, data: DataFrame, time: str, columns: list[str], partition_by: list[str], how: str = "backward") -> DataFrame:
    """Each point ``t`` with the columns' values at the last row not after it (the first row before that), or at the nearest one
    (the earlier of ties), nulls passed over.

    One sort by time of points and data together; nothing is joined.
    """
    both = data.select(*partition_by, F.col(time).alias("t"), *columns, F.lit(0).alias("_p")).unionByName(points.select(*partition_by, "t", F.lit(1).alias("_p")), allowMissingColumns=True)
    back, ahead = _back_and_ahead(partition_by, ["t", "_p"])
    out = {}
    for c in columns:
        if how == "backward":
            out[c] = F.coalesce(F.last(c, True).over(back), F.last(c, True).over(ahead))
        else:
            at = F.when(F.col(c).isNotNull(), F.struct(F.col("t").alias("t"), F.col(c).alias("v")))
            # Equal times come as one row of data before the point, so a later row is strictly later.
            b, a = F.last(at, True).over(back), F.last(at, True).over(ahead)
            micros = lambda x: F.unix_micros(x.cast("timestamp"))
            nearer = micros(F.col("t")) - micros(b["t"]) <= micros(a["t"]) - micros(F.col("t"))
            out[c] = F.when(a.isNull() | nearer, b["v"]).otherwise(a["v"])
    return both.select(*partition_by, "t", "_p", *[v.alias(c) for c, v in out.items()]).filter("_p = 1").drop("_p")


def gaps(df: DataFrame, value: str, order_by: list[str], partition_by: list[str], k: int) -> DataFrame:
    """Runs of missing cells: first position, length, and whether it is long (``k`` or more)."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    rows = df.select(*partition_by, F.row_number().over(w).alias("rn"), F.col(value).isNull().alias("none"))
    island = F.col("rn") - F.row_number().over(Window.partitionBy(*partition_by, "none").orderBy("rn"))
    return rows.withColumn("island", island).filter("none").groupBy(*partition_by, "island").agg(F.min("rn").alias("first_row"), F.count("*").alias("length")).select(*partition_by, "first_row", "length", (F.col("length") >= k).cast("int").alias("is_long"))


def fill(df: DataFrame, value: str, order_by: list[str], partition_by: list[str], k: int, how: str = "forward") -> DataFrame:
    """Fill missing cells within stretches between long gaps (``k`` cells or more, which stay empty).

    forward: the last value, the first one at a head; nearest: the nearer by rows, the earlier of ties.
    """
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    rows = df.withColumn("_rn", F.row_number().over(w)).withColumn("_none", F.col(value).isNull())
    rows = rows.withColumn("_island", F.col("_rn") - F.row_number().over(Window.partitionBy(*partition_by, "_none").orderBy("_rn")))
    rows = rows.withColumn("_long", F.col("_none") & (F.count(F.lit(1)).over(Window.partitionBy(*partition_by, "_none", "_island")) >= k))
    rows = rows.withColumn("_part", F.sum(F.col("_long").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back, ahead = _back_and_ahead([*partition_by, "_part"], ["_rn"])
    if how == "forward":
        filled = F.coalesce(F.last(value, True).over(back), F.last(value, True).over(ahead))
    else:
        at = F.when(F.col(value).isNotNull(), F.struct(F.col("_rn").alias("i"), F.col(value).alias("v")))
        b, a = F.last(at, True).over(back), F.last(at, True).over(ahead)
        filled = F.when(b.isNull(), a["v"]).when(a.isNull() | (F.col("_rn") - b["i"] <= a["i"] - F.col("_rn")), b["v"]).otherwise(a["v"])
    return rows.withColumn("filled", F.when(F.col("_long"), None).otherwise(filled)).drop("_rn", "_none", "_island", "_long", "_part")


def recover_precision(df: DataFrame, time: str, order_by: list[str], partition_by: list[str] | None = None, uneven: str = "error") -> DataFrame:
    """Rows that share a minute's stamp, spread evenly over the minute in their order (``recovered``).

    A count that does not divide a minute into whole microseconds is an error, or with ``uneven``
    "null" leaves its rows without a recovered time, so that a report can name them.
    """
    if uneven not in ("error", "null"):
        raise ValueError("uneven counts are an 'error' or 'null'")
    by = [*(partition_by or []), time]
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by)) - 1
    refused = F.raise_error(F.lit("a minute does not divide evenly")).cast("long") if uneven == "error" else F.lit(None).cast("long")
    step = F.when(F.lit(60_000_000) % n != 0, refused).otherwise((F.lit(60_000_000) / n).cast("long"))
    return df.withColumn("recovered", (F.unix_micros(F.col(time).cast("timestamp")) + i * step).cast("long"))


def needs_recovery(df: DataFrame, time: str) -> bool:
    """Whether over half of the distinct stamps repeat the most frequent number of times, and that is more than once."""
    runs = df.groupBy(time).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("stamps"))
    row = runs.agg(F.max(F.struct("stamps", "n")).alias("m"), F.sum("stamps").alias("all")).first()
    return bool(row["m"] and row["m"]["n"] > 1 and row["m"]["stamps"] > 0.5 * row["all"])


def segments(df: DataFrame, columns: list[str], order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Rows without those whose columns are all missing, numbered by the stretch (``segment``, from 1) between them."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(*order_by)
    cut = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()
    rows = df.withColumn("_cut", cut)
    opens = (~F.col("_cut") & F.coalesce(F.lag("_cut").over(w), F.lit(True))).cast("int")
    return rows.withColumn("segment", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("_cut")).drop("_cut")


# Merge


def merge_rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _keys(time: str | list[str]) -> list[str]:
    return [time] if isinstance(time, str) else list(time)


def conflicts(a: DataFrame, b: DataFrame, time: str | list[str]) -> DataFrame:
    """Cells of common columns that differ as text at equal times (and keys, if ``time`` lists some)."""
    keys = _keys(time)
    common = [c for c in a.columns if c in b.columns and c not in keys]
    pairs = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in common]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in common]), keys)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"a_{c}").cast("string")).alias("a"), F.trim(F.col(f"b_{c}").cast("string")).alias("b")) for c in common]))
    return pairs.select(*keys, cells.alias("x")).select(*keys, "x.*").filter("a <> b")


def merge_columns(parts: list[DataFrame], time: str | list[str]) -> DataFrame:
    """All times of all parts with all columns; a column of several parts takes the first value that is not null."""
    keys, out = _keys(time), parts[0]
    for p in parts[1:]:
        common = [c for c in p.columns if c in out.columns and c not in keys]
        renamed = p.withColumnsRenamed({c: f"_{c}" for c in common})
        out = out.join(renamed, keys, "full_outer").withColumns({c: F.coalesce(c, f"_{c}") for c in common}).drop(*[f"_{c}" for c in common])
    return out


def merge_aligned(parts: list[DataFrame], time: str | list[str]) -> DataFrame:
    """Parts of equal columns are appended, the results joined by time."""
    groups: dict[tuple, list[DataFrame]] = {}
    for p in parts:
        groups.setdefault(tuple(sorted(p.columns)), []).append(p)
    return merge_columns([merge_rows(g) for g in groups.values()], time)


def merge_checked(parts: list[DataFrame], time: str | list[str]) -> DataFrame:
    """merge_columns, after no two parts contradict each other."""
    keys = set(_keys(time))
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            if set(a.columns) & set(b.columns) - keys and not conflicts(a, b, time).isEmpty():
                raise ValueError("parts contradict each other at equal times")
    return merge_columns(parts, time)


def overlap_share(a: DataFrame, b: DataFrame, time: str) -> DataFrame:
    """Common part of two time ranges over the shorter one."""
    ends = lambda d, n: d.agg(F.unix_micros(F.min(time).cast("timestamp")).alias(f"{n}0"), F.unix_micros(F.max(time).cast("timestamp")).alias(f"{n}1"))
    both = ends(a, "a").join(ends(b, "b"))
    common = F.greatest(F.lit(0), F.least("a1", "b1") - F.greatest("a0", "b0"))
    return both.select(F.coalesce(F.try_divide(common.cast("double"), F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")).cast("double")), F.lit(0.0)).alias("overlap"))


def quality(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """One row: rows, columns, missing cells of each column, distinct steps."""
    steps = intervals(df, time).agg(F.count_distinct("micros").alias("n_intervals"))
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]).join(steps)


def reorder(df: DataFrame, time: str, labels: list[str], listed: list[str]) -> DataFrame:
    first = [c for c in [time, *labels, *listed] if c in df.columns]
    return df.select(*dict.fromkeys([*first, *df.columns]))


def parse_time(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyyMMddHHmmss", "yyyyMMdd")) -> Column:
    """A time without zone from text: the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


@dataclass(frozen=True)
class PrepSpec:
    """The whole chain: what the columns are and what should become of them."""

    time: str
    columns: list[str]
    labels: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    units: dict[str, tuple[str, str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    sentinels: dict[str, list[float]] = field(default_factory=dict)
    seconds: int | None = None
    k: int = 15
    mode: str = "gap_aware"
    partition_by: list[str] = field(default_factory=list)
    maps: dict[str, dict[str, int]] = field(default_factory=dict)


def clean(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """NA, types, units, categories, labels, outliers, in this order."""
    plain = [c for c in spec.columns if c not in spec.labels and c not in spec.categories]
    out = normalise_na(df, [*spec.columns, *spec.labels])
    out = convert_types(out, target_types(type_counts(out, plain))) if plain else out
    out = out.withColumns({c: convert_unit(F.col(c).cast("double"), *u) for c, u in spec.units.items()}) if spec.units else out
    for c in spec.categories:
        out = encode_category(out, c, first_seen_codes(out, c, [spec.time], spec.maps.get(c)))
    for c in spec.labels:
        out = encode_label(out, c)
    return drop_outliers(out, spec.ranges, spec.sentinels) if spec.ranges or spec.sentinels else out


def resample(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """Cells on an even grid: columns by the last value, labels by the nearest. ``gap_aware`` empties what lies in a gap of k steps.

    Series have grids of their own, by one step: the given one, or the commonest of all series together.
    """
    by = spec.partition_by
    if spec.seconds:
        seconds = spec.seconds
    else:
        steps = intervals(df, spec.time, by).groupBy("micros").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", -F.col("micros"))).alias("m")).first()["m"]
        seconds = max(1, int(-steps[1] // 1_000_000)) if steps else 1
    points = grid(df, spec.time, seconds, by)
    plain = [c for c in spec.columns if c not in spec.labels]
    out = as_of(points, df, spec.time, plain, by)
    if spec.mode == "gap_aware":
        stamped = df.withColumns({f"_t_{c}": F.when(F.col(c).isNotNull(), F.col(spec.time)) for c in plain})
        stamps = as_of(points, stamped, spec.time, [f"_t_{c}" for c in plain], by)
        limit = spec.k * seconds * 1_000_000
        joined = out.join(stamps, [*by, "t"])
        age = lambda c: F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col(f"_t_{c}").cast("timestamp"))
        out = joined.select(*by, "t", *[F.when(F.abs(age(c)) < limit, F.col(c)).alias(c) for c in plain])
    if spec.labels:
        out = out.join(as_of(points, df, spec.time, spec.labels, by, "nearest"), [*by, "t"])
    return out.withColumnRenamed("t", spec.time)


def run_chain(parts: list[DataFrame], spec: PrepSpec) -> DataFrame:
    """Merge, clean, resample, segment: one lazy plan between the decisions that need data.

    With ``partition_by`` every series is resampled and segmented by itself, in parallel.
    """
    keys = [*spec.partition_by, spec.time]
    merged = merge_checked(parts, keys) if len(parts) > 1 else parts[0]
    even = resample(clean(merged, spec), spec)
    cut = segments(even, spec.columns, [spec.time], spec.partition_by)
    return reorder(cut, spec.time, spec.labels, spec.columns)
