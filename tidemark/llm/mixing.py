"""Mixing sources to target weights, with DataFrame functions only.

Method: every document gets a hash-random key; keys cut each source into ranges, so even
a source that holds a third of all rows is spread over thousands of (source, range)
groups; per-range totals become offsets by a prefix sum over the small table of ranges,
and a running sum inside each range completes the distributed prefix sum. Each source is
then cut at its exact budget: whole epochs first, then the head of its random order, and
a part of the one document that crosses the cut.

Defined cases: a null source is a source of its own, last in order; a null or blank text
has size 0 and is never taken; repeated rows are separate rows; ties in the key go by
doc_id and size, which leaves only rows that are equal in every output column; an empty
table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    trimmed = F.regexp_replace(text, f"^{_GAP}|{_GAP}$", "")
    n = F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, _GAP)))
    return F.coalesce(n, F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size and the word target under the weights.

    Sources in code point order (null last) take the weights in turn. ``share`` of all
    words is dealt out by weight; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. That settles at a level L with
    target = min(most * size, L * weight): order the sources by most * size / weight; L is
    the first value that leaves the next source below its stop.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    every = W.orderBy("stop", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy()
    ranked = (
        totals.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
        .withColumn("stop", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("capped", F.sum("source_size").over(every) - F.col("source_size"))
        .withColumn("left", F.sum("weight").over(whole) - F.sum("weight").over(every) + F.col("weight"))
        .withColumn("goal", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("goal") - F.lit(most) * F.col("capped")) / F.col("left"))
    )
    found = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "place", "level"))).over(whole)
    return ranked.select(
        "source",
        "source_size",
        F.least(F.lit(most) * F.col("source_size"), F.coalesce(found["level"] * F.col("weight"), F.lit(most) * F.col("source_size"))).alias("target"),
    )


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: list[float] | None = None,
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    digits: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, with repeats).

    ``digits`` hexadecimal digits of the key name a range: 16**digits ranges a source, by default so many that
    a range has some 10^5 rows at most.
    """
    with Scratch(spark, "mix") as scratch:
        return scratch.result(_mix(docs, scratch, weights or [3.0, 1.0, 2.0], share, most, seed, digits, []))


def _mix(docs: DataFrame, scratch: Scratch, weights: list[float], share: float, most: float, seed: str, digits: int | None, keep: list[Column]) -> DataFrame:
    """The rows of ``mix``; ``keep``: a column ``row`` to carry along."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # The source as a key that is never null, so that one exchange serves the window and the join.
    skey = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    sized = scratch.table(docs.select("doc_id", "source", skey.alias("skey"), word_count(F.col("text")).alias("size"), key.alias("key"), *keep))
    digits = digits or max(3, math.ceil(math.log(max(1, sized.count() / 1e5), 16)))
    sized = sized.withColumn("range", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))
    targets = source_targets(sized.select("source", "size"), weights, share, most).withColumn("t_key", skey)
    before = W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = sized.groupBy("skey", "range").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    plan = (
        ranges.join(targets, F.col("skey") == F.col("t_key"))
        .select("skey", "range", "offset", "source_size", "target")
        .withColumn("budget", F.floor(F.col("target")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    inside = W.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = sized.withColumn("upto", F.sum("size").over(inside))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("offset") + F.col("upto") - F.col("size"))))
    return run.join(plan, ["skey", "range"]).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), *[c for c in sized.columns if c == "row"]
    )


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    The document that crosses its source's cut is in if half of it or more is taken.
    """
    with Scratch(spark, "mixed") as scratch:
        taken = _mix(docs, scratch, [3.0, 1.0, 2.0], 1.5, 2.0, "mix", None, [F.struct(*[docs[c] for c in docs.columns]).alias("row")])
        copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
        return scratch.result(taken.filter("taken > 0").select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("_")).select("row.*"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM placed),
stops AS (SELECT *, 2.0::DOUBLE * source_size / weight AS stop FROM weighed),
run AS (
  SELECT *, (sum(source_size) OVER u - source_size)::BIGINT AS capped,
         sum(weight) OVER () - sum(weight) OVER u + weight AS w_left,
         1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS goal
  FROM stops WINDOW u AS (ORDER BY stop, place ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, (goal - 2.0::DOUBLE * capped) / w_left AS level FROM run),
found AS (SELECT min_by(level, row_number) AS level FROM (SELECT level, row_number() OVER (ORDER BY stop, place) AS row_number FROM levels WHERE level <= stop)),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(found.level * weight, 2.0::DOUBLE * source_size)) AS target
  FROM levels, found),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM targets),
prefix AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM sized)
SELECT p.doc_id, p.size, b.source_size, b.target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM prefix p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""
