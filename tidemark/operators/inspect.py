"""What a raw table is: numbers and times in text cells, unit rows, the time column, the zone.

Facts are aggregates over all rows; only their results, one row a column, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prep import is_na
from tidemark.runtime import shuffle_partitions

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"

#: How times are written, the usual ways first. Brackets enclose what may be left out.
TIME_PATTERNS = ("yyyy-M-d[ H:m[:s[.SSSSSS]]]", "yyyy-M-d'T'H:m[:s[.SSSSSS]]", "yyyy/M/d[ H:m[:s]]", "yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMdd", "H:m[:s[.SSSSSS]]")
#: What text of each pattern begins or consists of. A parser that fails costs a Java exception, so it gets no other text.
_LOOKS = (r"^[+-]?\d+-\d+-\d+", r"^[+-]?\d+-\d+-\d+[Tt]", r"^[+-]?\d+/\d+/\d+", r"^[+-]?\d{14,}$", r"^[+-]?\d{12,}$", r"^[+-]?\d{8,}$", r"^[+-]?\d+:\d+")
_ANY_LOOK = r"^[+-]?\d+[-/:]|^[+-]?\d{8,}$"
#: Names that a first column of counts has when it tells the time.
TIME_NAMES = ("time", "date", "timestamp", "datetime", "index", "no", "sequence_no", "seq", "seq_no", "ts", "tick", "step")
_ZONE = r"([+-]\d{2}:?\d{2}|Z)$"


def _text(c: str | Column) -> Column:
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))


def number(c: str | Column) -> Column:
    """A finite number from text, thousands commas passed over; null for anything else."""
    t = F.replace(_text(c), F.lit(","), F.lit(""))
    value = t.try_cast("double")
    return F.when(~is_na(c) & t.rlike(rf"^{_NUMBER}$") & (F.abs(value) < float("inf")), value)


def integer(c: str | Column) -> Column:
    """A whole number from text, "3.0" included; null for anything else, and beyond 64 bits."""
    t = _text(c)
    value = t.try_cast("double")
    whole = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")).when(t.rlike(rf"^{_NUMBER}$") & (value == F.floor(value)) & (F.abs(value) < 2.0**63), value.try_cast("long"))
    return F.when(~is_na(c), whole)


def complex_number(c: str | Column) -> Column:
    """(re, im) from text that ends in i or j; a bare unit is 1; null for anything else."""
    t = F.lower(_text(c))
    real = F.regexp_extract(t, rf"^({_NUMBER.replace('eE', 'e')})(?=[+-].*[ij]$)", 1)
    imaginary = F.regexp_extract(t, r"([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)?)[ij]$", 1)
    whole = t.rlike(r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?(?=[+-]))?[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)?[ij]$")
    im = F.when(imaginary.isin("", "+"), 1.0).when(imaginary == "-", -1.0).otherwise(imaginary.try_cast("double"))
    return F.when(whole, F.struct(F.coalesce(real.try_cast("double"), F.lit(0.0)).alias("re"), im.alias("im")))


def clock_time(c: str | Column) -> Column:
    """A time without zone from text: the first pattern that fits. A zone is dropped and the clock kept, see ``zone``."""
    t = F.regexp_replace(_text(c), r"(?<=\d:\d{2}|\.\d{1,6})\s*([+-]\d{2}:?\d{2}|Z)$", "")
    return F.when(t.rlike(_ANY_LOOK) & ~is_na(c), F.coalesce(*[F.when(t.rlike(look), F.try_to_timestamp(t, F.lit(p))) for p, look in zip(TIME_PATTERNS, _LOOKS, strict=True)])).cast("timestamp_ntz")


def zone(c: str | Column) -> Column:
    """The zone behind a clock time, as +hh:mm; null where none is written."""
    t = _text(c)
    z = F.when(t.rlike(r"\d:\d{2}(?::\d{2})?(?:\.\d+)?\s*" + _ZONE), F.regexp_extract(t, _ZONE, 1))
    return F.when(z == "Z", "+00:00").when(F.length(z) == 5, F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))).otherwise(z)


def choose_zone(zones: Iterable[str | None], asked: str | None = None) -> str:
    """One zone for several sources: the asked one, else +08:00 where a source has it or names none, else the commonest (the first of ties)."""
    if asked:
        return asked
    found = list(zones)
    if not found or any(z is None or z == "+08:00" for z in found):
        return "+08:00"
    return max(dict.fromkeys(found), key=found.count)


def to_zone(c: Column, source: str, target: str) -> Column:
    """A clock time of one zone as that of another; the reports only name the zone, this converts."""
    return F.convert_timezone(F.lit(source), F.lit(target), c.cast("timestamp_ntz"))


def size_text(c: Column) -> Column:
    """Bytes as B, KB, MB (one decimal) or GB (two), halves to the even digit."""
    b = c.cast("double")

    def part(power: int, digits: int, unit: str) -> Column:
        return F.concat(F.format_string(f"%.{digits}f", F.bround(b / 1024**power, digits)), F.lit(unit))

    return F.when(b < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).when(b < 1024**2, part(1, 1, " KB")).when(b < 1024**3, part(2, 1, " MB")).otherwise(part(3, 2, " GB"))


def unit_row(df: DataFrame, columns: list[str], order_by: list[str]) -> dict[str, str] | None:
    """Units by column where one of the first three rows is words in 70 % of its cells or more; None without such a row."""
    words = sum([(~is_na(c) & number(c).isNull()).cast("int") for c in columns], F.lit(0))
    head = df.orderBy(*order_by).limit(3).select(words.alias("_words"), *columns).collect()
    if len(head) < 3:
        return None
    for row in head:
        if row["_words"] >= 0.7 * len(columns):
            return {c: str(row[c]).strip() for c in columns if row[c] is not None and str(row[c]).strip()}
    return None


def drop_unit_row(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """The rows behind the unit row; all where there is none. One row is looked up, the rest is a filter on the order."""
    units = unit_row(df, columns, order_by)
    if units is None:
        return df
    same = F.lit(True)
    for c in columns:
        same = same & F.trim(F.col(c).cast("string")).eqNullSafe(F.lit(units.get(c)))
    head = df.orderBy(*order_by).limit(3).filter(same).agg(F.max(F.struct(*order_by)).alias("o")).first()["o"]
    return df.filter(F.struct(*order_by) > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_by, head, strict=True)]))


def _split_points(df: DataFrame, order: str, parts: int = 64) -> list:
    row = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000)).first()
    return sorted(set(row[0] or []))


def monotone(df: DataFrame, value: Column, order: str) -> DataFrame:
    """One row, ``monotone``: whether a value never falls by the order (a unique number).

    Rows are compared within ranges of the order, in parallel; the ranges' ends, 64 rows at most, at last.
    """
    cuts = _split_points(df, order)
    part = sum([(F.col(order) > F.lit(x)).cast("int") for x in cuts], F.lit(0))
    rows = df.select(F.col(order).alias("_o"), value.alias("_v"), part.alias("_r")).filter("_v is not null")
    falls = rows.withColumn("_fall", F.coalesce(F.lag("_v").over(Window.partitionBy("_r").orderBy("_o")) > F.col("_v"), F.lit(False)))
    ends = falls.groupBy("_r").agg(F.max("_fall").alias("fall"), F.min_by("_v", "_o").alias("first"), F.max_by("_v", "_o").alias("last"))
    broken = F.col("fall") | F.coalesce(F.lag("last").over(Window.orderBy("_r")) > F.col("first"), F.lit(False))
    return ends.select(broken.alias("b")).agg((~F.coalesce(F.max("b"), F.lit(False))).alias("monotone"))


def time_column(df: DataFrame, columns: list[str], order: str) -> tuple[str, str] | None:
    """(column, timestamp or sequence): the first column whose filled cells are times in 90 % or more, else the first
    of whole numbers that never fall and are distinct in over 80 %, else a first column of whole numbers with a
    name of ``TIME_NAMES``. Every row counts, and a column of bare numbers is no timestamp."""
    cells = [(F.count_if(~is_na(c)), F.count_if(clock_time(c).isNotNull() & number(c).isNull()), F.count_if(integer(c).isNotNull()), F.approx_count_distinct(integer(c), 0.02)) for c in columns]
    # Judging a row costs more than moving it, and a table of one file is one task.
    row = df.select(*columns).repartition(shuffle_partitions(df.sparkSession)).agg(*[x.alias(f"f{i}_{k}") for i, group in enumerate(cells) for k, x in enumerate(group)]).first()
    facts = {c: tuple(row[f"f{i}_{k}"] for k in range(4)) for i, c in enumerate(columns)}
    for c, (filled, times, _, _) in facts.items():
        if filled and times >= 0.9 * filled:
            return c, "timestamp"
    for i, (c, (filled, _, whole, distinct)) in enumerate(facts.items()):
        if not filled or whole != filled:
            continue
        if distinct > 0.8 * filled and monotone(df, integer(c), order).first()["monotone"]:
            return c, "sequence"
        if i == 0 and c.lower() in TIME_NAMES:
            return c, "sequence"
    return None
