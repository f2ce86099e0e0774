"""Writes as new tables: insert-ignore, upserts, raise-only updates, cascading deletes and invariants.

Parquet has no row updates, so each write is the query for the table's next version; the caller overwrites or swaps it.
Compare-and-set stands beside the reads by id (access.py); locks have no counterpart here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, table


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and the rows of new whose keys it does not have; of new rows with one key the first by all columns."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*new.columns))).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def raise_only(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of either side with the highest score a key; old ones win ties."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct(score, -F.col("_new"))).alias("x"))
    return best.select("x.*")


def upsert_changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's values where any differs (null-safe); how says what happened to each row."""
    rest = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full")
    there_old, there_new = F.col(f"o.{rest[0]}").isNotNull(), F.col(f"n.{rest[0]}").isNotNull()
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    how = F.when(~there_new, "kept").when(~there_old, "inserted").when(same, "same").otherwise("updated")
    return both.select(key, *[F.when(there_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest], how.alias("how"))


@query("insert_ignore", "K01 S25", "WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0), n AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS l_quantity FROM lineitem) ORDER BY l_orderkey, l_linenumber, l_quantity) SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber)")
def insert_ignore_lines(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return insert_ignore(lines.where("l_orderkey % 2 = 0"), lines.withColumn("l_quantity", F.col("l_quantity") + 1), ["l_orderkey", "l_linenumber"])


@query("raise_only_upsert", "K03", "WITH r AS (SELECT l_partkey, l_extendedprice AS score, l_orderkey, l_linenumber FROM lineitem) SELECT l_partkey, max(score) AS score FROM r GROUP BY 1")
def raise_only_upsert(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("score"), "l_orderkey")
    return raise_only(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), "l_partkey", "score").select("l_partkey", "score")


@query("upsert_changed", "K02 F08", "WITH o AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, CASE WHEN n.c_custkey IS NULL THEN 'kept' WHEN o.c_custkey IS NULL THEN 'inserted' WHEN o.c_acctbal IS NOT DISTINCT FROM n.c_acctbal THEN 'same' ELSE 'updated' END AS how FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def upsert_changed_customers(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = rows.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).otherwise(F.col("c_acctbal") + 1))
    return upsert_changed(rows.where("c_custkey % 3 <> 0"), new, "c_custkey")


@query("cascading_delete", "K07 J10", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0)")
def cascading_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(orders, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("one_active", "K06 W04", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS active, count(*) FILTER (o_orderstatus = 'P') <= 1 AS holds FROM orders GROUP BY 1")
def one_active(spark, d):
    n = F.count_if(F.col("o_orderstatus") == "P")
    return table(spark, d, "orders").groupBy("o_custkey").agg(n.alias("active"), (n <= 1).alias("holds"))


def append_only(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The next version of an immutable table, with how: changes (op, seq and old's columns) that insert a key that is not there, the first of several by seq, are appended; updates, deletes and inserts over a row are refused and counted, a row a key that they were asked for."""
    names = old.columns
    first = F.min_by(F.struct(*names), F.when(F.col("op") == "insert", F.col("seq")))
    asked = changes.groupBy(key).agg(first.alias("new"), F.count_if(F.col("op") == "insert").alias("inserts"), F.count("*").alias("asked"))
    met = old.select(key, F.struct(*names).alias("old")).join(asked, key, "full")
    took = F.col("old").isNull() & (F.col("inserts") > 0)
    out = met.select(key, F.coalesce("old", F.when(took, F.col("new"))).alias("x"), (F.coalesce("asked", F.lit(0)) - F.coalesce(took, F.lit(False)).cast("int")).cast("long").alias("refused"))
    return out.select(key, *[F.col(f"x.{c}").alias(c) for c in names if c != key], F.col("x").isNotNull().alias("present"), "refused")


@query(
    "append_only_log",
    "ST05",
    """WITH o AS (SELECT event_id, event_type, value FROM events WHERE event_id % 4 <> 0), c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'delete' END AS op, event_id AS seq, event_type, value + 1 AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'insert', event_id + 1, event_type, value + 2 FROM events WHERE event_id % 8 = 0),
n AS (SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS r FROM c WHERE op = 'insert') WHERE r = 1), k AS (SELECT event_id, count(*) AS asked FROM c GROUP BY 1), i AS (SELECT event_id FROM o UNION SELECT event_id FROM k)
SELECT i.event_id, coalesce(o.event_type, n.event_type) AS event_type, coalesce(o.value, n.value) AS value, o.event_id IS NOT NULL OR n.event_id IS NOT NULL AS present, coalesce(asked, 0) - CASE WHEN o.event_id IS NULL AND n.event_id IS NOT NULL THEN 1 ELSE 0 END AS refused
FROM i LEFT JOIN o USING (event_id) LEFT JOIN n ON n.event_id = i.event_id LEFT JOIN k ON k.event_id = i.event_id""",
)
def append_only_log(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    op = F.when(F.col("event_id") % 3 == 0, "insert").when(F.col("event_id") % 3 == 1, "update").otherwise("delete")
    first = e.where("event_id % 2 = 0").select("event_id", op.alias("op"), F.col("event_id").alias("seq"), "event_type", (F.col("value") + 1).alias("value"))
    late = e.where("event_id % 8 = 0").select("event_id", F.lit("insert").alias("op"), (F.col("event_id") + 1).alias("seq"), "event_type", (F.col("value") + 2).alias("value"))
    return append_only(e.where("event_id % 4 <> 0"), first.unionByName(late), "event_id")


def admit(work: DataFrame, key: str, order: list, cost: str, budget: float) -> DataFrame:
    """work with left, what a key's budget has before each piece, and admitted: pieces in order while their estimated costs fit; after the first that does not fit none is, as its deadline has passed. A key's work is ordered by one task."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = work.withColumn("left", F.round(budget - F.coalesce(F.sum(cost).over(before), F.lit(0.0)), 6))
    return rows.withColumn("admitted", F.col(cost) <= F.col("left"))


@query("budget_admission", "ST11", "WITH r AS (SELECT user_id, event_id, abs(value) AS cost, round(500 - coalesce(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS \"left\" FROM events) SELECT user_id, event_id, \"left\", cost <= \"left\" AS admitted FROM r")
def budget_admission(spark, d):
    work = table(spark, d, "events").select("user_id", "event_id", "ts", F.abs("value").alias("cost"))
    return admit(work, "user_id", ["ts", "event_id"], "cost", 500.0).select("user_id", "event_id", "left", "admitted")
