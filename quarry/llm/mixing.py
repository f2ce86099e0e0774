"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Tokens are summed by source and hash bucket; a window over the at most 4,096 buckets of a source finds the bucket in which the
budget runs out, and only that bucket is split further. Documents are then filtered by comparing hashes: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, table, word_count

BITS = 12
LEVELS = 4  # 48 bits: a bucket of the last level holds one document, or equal ones


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights 1, 2, 3 repeating over sources by code point, null last.

    The targets share all sizes by weight, none above cap times its source's size. Sources are capped in the order of size/weight,
    so the capped ones are a prefix of that order; the share of a unit of weight follows from what the prefix leaves.
    One row a source passes through one task; the sums themselves are made before.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.col("source_size")
    left = F.sum(size).over(everything) - F.coalesce(F.sum(cap * size).over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    ranked = (
        sizes.select("source", size)
        .withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1)
        .select("source", size, "w", (left / weight).alias("share"))
        .withColumn("free", F.when(F.col("share") * F.col("w") <= cap * size, F.struct(F.row_number().over(by_ratio).alias("at"), "share")))
    )
    # the share that holds is the one at the first source which it doesn't push above its cap
    return ranked.select("source", size, F.least(cap * size, F.coalesce(F.min("free").over(everything)["share"], F.lit(0.0)) * F.col("w")).cast("double").alias("target"))


def _bits(level: int):
    return F.shiftrightunsigned("key", 64 - BITS * level)


def _measured(docs: DataFrame) -> DataFrame:
    """docs with size, key (64-bit hash of doc_id and text) and source_key (which holds null sources too)."""
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    return docs.withColumns({"size": word_count(F.col("text")), "key": F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))), "source_key": source})


def thresholds(slim: DataFrame, scratch: Scratch, cap: float = 3.0) -> DataFrame:
    """One row per source_key: source_size, target, rounds (whole takings of all its documents), budget left, limit and with_last.

    slim has source, size, key and source_key. A document is taken once more if the first bits of its key are below limit.
    """
    goals = scratch.keep(
        targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("budget", F.greatest(F.col("target") - F.col("rounds") * F.col("source_size"), F.lit(0.0)))
        .withColumn("source_key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))),
        "goals",
    )
    # nested thresholds: (source, prefix of the key so far, budget left for it)
    at = goals.select("source_key", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(1, LEVELS + 1):
        within = slim.where("size > 0")
        if level > 1:
            within = within.withColumn("prefix", _bits(level - 1)).join(at, ["source_key", "prefix"])
        else:
            within = within.withColumn("prefix", F.lit(0).cast("long")).join(at.drop("prefix"), "source_key")
        sums = within.groupBy("source_key", _bits(level).alias("bucket"), "left").agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # the first bucket with which the running sum passes the budget
        crossing = sums.withColumn("sum", F.sum("n").over(run)).where("sum > left")
        found = crossing.groupBy("source_key").agg(F.min_by(F.struct("bucket", "n", "sum", "left"), "bucket").alias("x"))
        at = scratch.keep(
            found.select("source_key", F.col("x.bucket").alias("prefix"), (F.col("x.left") - F.col("x.sum") + F.col("x.n")).alias("left"), F.col("x.n").alias("n")), f"level-{level}"
        )
        edges = at if level == LEVELS else None
        at = at.drop("n") if level < LEVELS else at
    # the last bucket goes in if that comes nearer
    limit = edges.select("source_key", F.col("prefix").alias("limit"), (F.col("left") * 2 >= F.col("n")).alias("with_last"))
    return scratch.keep(goals.join(limit, "source_key", "left").select("source_key", "source_size", "target", "rounds", "budget", "limit", "with_last"), "limits")


def with_copies(docs: DataFrame, limits: DataFrame, cap: float = 3.0) -> DataFrame:
    """Measured documents with copies, how often the mix takes each."""
    order = _bits(LEVELS)
    extra = F.when(F.col("limit").isNull(), F.col("budget") > 0).otherwise((order < F.col("limit")) | (F.col("with_last") & (order == F.col("limit"))))
    return docs.join(limits, "source_key").withColumn("copies", F.least(F.col("rounds") + extra.cast("int"), F.lit(int(cap))))


def mix(spark: SparkSession, docs: DataFrame, cap: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, size (words), source, source_size, target, taken (words the mix takes, repeats counted) and copies.

    Each document of a source is taken floor(target / size of the source) times, and once more if its 64-bit hash of doc_id and
    text is below the source's threshold; the threshold fills what the whole rounds leave, to within half a document.
    Reruns agree. Null text counts 0 words; null source is a source of its own, after the others; rows that are wholly equal
    have equal hashes and are taken alike; an empty table gives no rows. Other columns of docs play no part.
    """
    scratch = scratch or Scratch(spark, "mix")
    slim = scratch.keep(_measured(docs.select("doc_id", "source", "text")).drop("text"), "slim")
    taken = with_copies(slim, thresholds(slim, scratch, cap), cap)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def repeat_to_targets(spark: SparkSession, docs: DataFrame, cap: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns."""
    scratch = scratch or Scratch(spark, "mix")
    slim = scratch.keep(_measured(docs.select("doc_id", "source", "text")).drop("text"), "slim")
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    taken = with_copies(_measured(whole).drop("text"), thresholds(slim, scratch, cap), cap)
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))
