"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Method: the terms of a text are its words (A-Z lower-cased), weighted by their counts.
For each sample i a term k draws, from hashes of (k, i) alone, r and c ~ Gamma(2, 1) and
b ~ U(0, 1); with t = floor(ln(weight) / r + b) its value is
ln a = ln c - r * (t - b + 1), and the sample is the pair (k, t) of least a. Two texts
agree in a sample with the probability sum(min(weights)) / sum(max(weights)), their
generalised Jaccard similarity. A fingerprint is ``SAMPLES`` such pairs, 32 bits each.

The next document is found without sorting all rows in one place: ids are cut into
ranges at sampled ids, one shuffle by range serves the order, the texts and the term
counts, and only the first row of each range travels on to the range before it.

Defined cases: a null text is empty; a text without words has the fingerprint '' and
likeness 1 to another such text, 0 to any other; a null doc_id sorts last (descending);
repeated ids follow one another by text; a single row is its own next document; an empty
table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.runtime import Scratch, shuffle_partitions

SAMPLES = 32
_LOWEST = -(2**63)


def _bucket(cuts: list[int]) -> Column:
    """Number of ``cuts`` (descending) that are >= ``id``, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("id") > F.lit(cuts[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def _uniform(h: Column, shift: int) -> Column:
    """32 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) * F.lit(2.0**-32)


def _sample(i: int) -> Column:
    """Least (ln a, term and t) of a text's terms, in one long: the value above, 32 bits of the pair below."""
    h1, h2, h3 = (F.xxhash64(F.col("term"), F.lit(3 * i + j)) for j in range(3))
    r = -F.ln(_uniform(h1, 0) * _uniform(h1, 32))
    lnc = F.ln(-F.ln(_uniform(h2, 0) * _uniform(h2, 32)))
    b = _uniform(h3, 0)
    t = F.floor(F.col("lnw") / r + b)
    value = F.greatest(F.lit(-60.0), lnc - r * (t - b + 1.0))
    order = F.floor((value + 64.0) * F.lit(2.0**23)).cast("long")
    pair = F.xxhash64(F.col("term"), t).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.min(F.shiftleft(order, 32).bitwiseOR(pair))


def word_hashes(text: Column) -> Column:
    """Sorted hashes of a text's words."""
    low = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.sort_array(F.transform(F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x)))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``sig`` (array of ``samples`` 32-bit numbers, empty for no words) of the rows' ``text``.

    ``keys`` must name a row, and ``texts`` be dealt by some of them: then nothing is shuffled.
    """
    words = texts.select(*keys, word_hashes(F.col("text")).alias("words"))
    # Runs of equal hashes in the sorted array: a term ends where the next element differs.
    ends = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i == F.size("words")) | (F.get("words", i - 1) != F.get("words", i)))
    runs = words.withColumn("ends", F.when(F.size("words") > 0, ends).otherwise(F.array().cast("array<int>")))
    terms = runs.select(
        *keys,
        F.posexplode_outer(F.transform("ends", lambda e, j: F.struct(F.get("words", e - 1).alias("term"), (e - F.when(j == 0, 0).otherwise(F.get("ends", j - 1))).alias("w")))).alias("_", "x"),
    ).select(*keys, "x.term", F.ln(F.col("x.w").cast("double")).alias("lnw"))
    packed = terms.groupBy(*keys).agg(F.count("term").alias("n"), *[_sample(i).alias(f"s{i}") for i in range(samples)])
    return packed.select(*keys, F.when(F.col("n") == 0, F.array().cast("array<bigint>")).otherwise(F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(samples)])).alias("sig"))


def to_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    both = F.greatest(F.size(a), F.size(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(same / both).cast("double")


def fingerprint_edits(spark: SparkSession, docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = 4 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()["cuts"] or []
    ranged = rows.withColumn("g", _bucket(sorted(set(cuts), reverse=True)))
    order = W.partitionBy("g").orderBy(F.col("id").desc(), "text")
    placed = ranged.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    # The first row of each range that has rows follows the last row of the range before it.
    firsts = placed.filter("rn = 1").select("g", "text")
    follows = _following(ranged.select("g").distinct())
    heads = firsts.join(follows, firsts["g"] == follows["after"]).select(follows["before"].alias("g1"), firsts["text"].alias("first_text"))
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    joined = placed.join(heads, (F.col("g") == F.col("g1")) & F.col("next").isNull(), "left").select(
        "g", "rn", "doc_id", "text", F.coalesce("next", "first_text").alias("next")
    )
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("next", F.lit(1), half))
    both = joined.select(
        "g", "rn", "doc_id", n_chars.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), F.posexplode(F.array("text", edited)).alias("kind", "text")
    )
    keys = ["g", "rn", "doc_id", "n_chars", "edited_sha256", "kind"]
    sigs = signatures(both, keys, samples)
    with Scratch(spark, "fingerprints") as scratch:
        rows = scratch.result(
            sigs.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("kind") == 0, F.col("sig"))).alias("sig"), F.max(F.when(F.col("kind") == 1, F.col("sig"))).alias("edited"))
        )
    again = W.partitionBy("g").orderBy("rn")
    lead = rows.withColumn("next", F.lead("sig").over(again))
    first = rows.filter("rn = 1").select("g", "sig")
    follows = _following(first.select("g"))
    heads = first.join(follows, first["g"] == follows["after"]).select(follows["before"].alias("g1"), first["sig"].alias("first_sig"))
    return lead.join(heads, (F.col("g") == F.col("g1")) & F.col("next").isNull(), "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        to_text(F.col("sig")).alias("fingerprint"),
        to_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited")).alias("near_edited"),
        likeness(F.col("sig"), F.coalesce("next", "first_sig")).alias("near_next"),
    )


def _following(ranges: DataFrame) -> DataFrame:
    """before, after: each range that has rows and the next such one; the first follows the last. One row a range."""
    w = W.orderBy("g")
    return ranges.select(F.col("g").alias("before"), F.coalesce(F.lead("g").over(w), F.min("g").over(W.partitionBy())).alias("after"))
