"""Exact quantiles without sorting a group in one task: ranges are narrowed by histograms until few values are left to be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import cut

BINS = 1024


def order_statistics(rows: DataFrame, group: list[str], value: str, ranks, rounds: int = 2) -> DataFrame:
    """(group, n, n_distinct, at): how many values, other than null, each group has, how many differ, and at, a map from each rank in ranks(n) (an array of longs from 0) to the value there.

    Equal values are counted first, map side. A histogram of even bins over a group's range tells which bin holds each rank; only
    those bins' values stay, with the count of all below them, and are split again. What the rounds leave, about one value in
    BINS ** rounds where values spread evenly, is ordered by a window that can spill.
    """
    same = F.struct(*group, F.lit(0)).alias("_g")  # a struct, so that null groups meet themselves
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(same, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))
    n = cut(counts.groupBy("_g").agg(F.sum("_c").alias("n"), F.count("*").alias("n_distinct")))
    wanted = n.select("_g", F.array_distinct(ranks(F.col("n"))).alias("_ranks"), F.lit(0).cast("long").alias("_before"))
    left, keys = counts.join(wanted, "_g"), ["_g"]
    before = lambda order: F.col("_before") + F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for i in range(rounds):
        span = left.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        bin_ = F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS)).cast("int")
        left = left.join(span, keys).withColumn(f"_b{i}", bin_).drop("_lo", "_hi")
        bins = left.groupBy(*keys, f"_b{i}").agg(F.sum("_c").alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
        bins = bins.withColumn("_before", before(f"_b{i}")).withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))
        keys = [*keys, f"_b{i}"]
        left = cut(left.drop("_before", "_ranks").join(bins.where(F.size("_ranks") > 0).drop("_c"), keys))
    placed = left.withColumn("_before", before("_v"))
    hit = placed.select("_g", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))).alias("_r"))
    at = hit.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("at"))  # as many as ranks
    return n.join(at, "_g").select(*[F.col(f"_g.{g}").alias(g) for g in group], "n", "n_distinct", "at")


def quantiles(rows: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """(group, n, n_distinct, q): exact quantiles, interpolated between the two values beside (n - 1) q (type 7)."""
    place = lambda q, n: (n - 1) * F.lit(q)
    sides = lambda n: F.array(*[f(place(q, n)).cast("long") for q in qs for f in (F.floor, F.ceil)])
    out = order_statistics(rows, group, value, sides)

    def between(q):
        p = place(q, F.col("n"))
        low, high = F.element_at("at", F.floor(p).cast("long")), F.element_at("at", F.ceil(p).cast("long"))
        return low + (high - low) * (p - F.floor(p))

    return out.select(*group, "n", "n_distinct", F.array(*[between(q) for q in qs]).alias("q"))
