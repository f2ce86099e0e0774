"""The relational surface of an evidence store on star-schema tables: joins, windows, top-k, filters and set operations.

Top-k per key is a row_number filter (Spark keeps k rows per key before the shuffle), existence tests are semi and anti joins, and
every order ends in a unique key, so results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, run_sql, table


def both(name: str, operators: str, *tables: str):
    """Register a query whose Spark SQL is the decorated function's text with {table} names, held against the same text in DuckDB."""

    def add(f):
        text = f.__doc__
        plain = text
        for t in tables:
            plain = plain.replace("{" + t + "}", t)
        return query(name, operators, plain)(lambda spark, d: run_sql(spark, d, text, *tables))

    return add


def top_per_key(df: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


@query(
    "lateral_topk_orders",
    "J06 W05 L01",
    "SELECT c_custkey, o_orderkey, o_totalprice, r FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS r FROM customer JOIN orders ON c_custkey = o_custkey) WHERE r <= 3",
)
def lateral_topk_orders(spark, d):
    rows = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    w = Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_custkey", "o_orderkey", "o_totalprice", "r")


@query(
    "latest_version_rank",
    "W02 J17",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC NULLS LAST) AS r FROM orders) WHERE r = 1",
)
def latest_version_rank(spark, d):
    w = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus").orderBy(F.desc_nulls_last("o_orderdate"))
    return table(spark, d, "orders").withColumn("r", F.dense_rank().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query(
    "running_budget",
    "W03 G26 L05",
    "SELECT o_custkey, o_orderkey, spent FROM (SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS spent, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE spent <= 500000 OR r = 1",
)
def running_budget(spark, d):
    return within_budget(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice"), 500000).select("o_custkey", "o_orderkey", "spent")


def within_budget(df: DataFrame, key: list[str], order: list[str], cost: Column, budget: float) -> DataFrame:
    """Rows of each key in order while their costs sum to at most budget; the first always."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.round(F.sum(cost).over(w), 2)).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where((F.col("spent") <= budget) | (F.col("_r") == 1)).drop("_r")


@query("referenced_any", "J04 U01", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09) OR EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def referenced_any(spark, d):
    lines = table(spark, d, "lineitem")
    keys = [lines.where("l_discount > 0.09").select("l_suppkey"), lines.where("l_returnflag = 'R' AND l_quantity > 49").select("l_suppkey")]
    union = reduce(DataFrame.unionByName, keys).distinct()
    return table(spark, d, "supplier").join(union, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("unreferenced", "J05 U06", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unreferenced(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


#: Order of export classes, least restricted first.
CLASSES = ["public", "internal", "secret"]


def accessible(df: DataFrame, tenant: str, principal: str, compartments: list[str], highest: str) -> DataFrame:
    """Row-level access: public or own tenant, class not above highest, named principals include me, compartments all mine."""
    own = (F.col("export_class") == "public") | (F.col("tenant") == tenant)
    allowed = F.col("export_class").isin(CLASSES[: CLASSES.index(highest) + 1])
    named = (F.size("principals") == 0) | F.array_contains("principals", principal)
    return df.where(own & allowed & named & (F.size(F.array_except("compartments", F.array(*map(F.lit, compartments)))) == 0))


def labelled_customers(customers: DataFrame) -> DataFrame:
    cls = F.when(F.col("c_nationkey") % 3 == 0, "public").when(F.col("c_nationkey") % 3 == 1, "internal").otherwise("secret")
    none = F.array().cast("array<string>")
    return customers.select(
        "c_custkey", "c_nationkey", cls.alias("export_class"), F.col("c_mktsegment").alias("tenant"), F.when(F.col("c_custkey") % 2 == 0, none).otherwise(F.array(F.lit("ann"))).alias("principals"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("x"), F.lit("z"))).otherwise(F.array(F.lit("x"))).alias("compartments")
    )


_LABELS = "SELECT c_custkey, c_nationkey, CASE c_nationkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'secret' END AS export_class, c_mktsegment AS tenant, CASE WHEN c_custkey % 2 = 0 THEN [] ELSE ['ann'] END AS principals, CASE WHEN c_custkey % 5 = 0 THEN ['x','z'] ELSE ['x'] END AS compartments FROM customer"


@query("access_filtered", "F02 F03 F04", f"SELECT c_custkey FROM ({_LABELS}) WHERE (export_class = 'public' OR tenant = 'BUILDING') AND export_class IN ('public', 'internal') AND (len(principals) = 0 OR list_contains(principals, 'ann')) AND len(list_filter(compartments, lambda x: x NOT IN ('x', 'y'))) = 0")
def access_filtered(spark, d):
    return accessible(labelled_customers(table(spark, d, "customer")), "BUILDING", "ann", ["x", "y"], "internal").select("c_custkey")


@query("label_join", "A28 U04", f"WITH l AS ({_LABELS}) SELECT c_nationkey, CASE max(CASE export_class WHEN 'public' THEN 0 WHEN 'internal' THEN 1 ELSE 2 END) WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'secret' END AS export_class, min(len(principals))::BIGINT AS fewest, (SELECT array_to_string(list_sort(list(DISTINCT c)), ',') FROM (SELECT unnest(compartments) AS c, c_nationkey AS n FROM l) WHERE n = c_nationkey) AS compartments FROM l GROUP BY c_nationkey")
def label_join(spark, d):
    rows = labelled_customers(table(spark, d, "customer"))
    rank = F.element_at(F.create_map(*[x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(i))]), F.col("export_class"))
    spread = rows.select("c_nationkey", rank.alias("rank"), F.size("principals").alias("p"), F.explode("compartments").alias("c"))
    return spread.groupBy("c_nationkey").agg(F.element_at(F.array(*map(F.lit, CLASSES)), F.max("rank") + 1).alias("export_class"), F.min("p").cast("long").alias("fewest"), F.concat_ws(",", F.array_sort(F.collect_set("c"))).alias("compartments"))


def between(df: DataFrame, equal: dict, low: dict, high: dict) -> DataFrame:
    """Only the bounds that are given filter; both are inclusive."""
    for c, v in equal.items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in low.items():
        df = df if v is None else df.where(F.col(c) >= F.lit(v))
    for c, v in high.items():
        df = df if v is None else df.where(F.col(c) <= F.lit(v))
    return df


@query("event_range", "F01 F11 S23", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' AND user_id <= 500 ORDER BY ts DESC, event_id DESC LIMIT 200")
def event_range(spark, d):
    rows = between(table(spark, d, "events"), {"event_type": "purchase", "user_id": None}, {"ts": F.expr("TIMESTAMP_NTZ '2024-01-10'")}, {"user_id": 500, "ts": None})
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


@both("class_membership", "F05 F06 F08 F09", "orders", "customer")
def class_membership():
    """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'promoted' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'other' END AS status
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'P') AND NOT (o_orderpriority LIKE '1%') AND c_mktsegment IS DISTINCT FROM 'BUILDING'"""


@both("status_ranked", "L02 L04", "orders")
def status_ranked():
    """SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 40) AS t ORDER BY o_totalprice, o_orderkey"""


@both("three_way_distinct", "J01", "lineitem", "orders", "customer")
def three_way_distinct():
    """SELECT DISTINCT c_custkey, c_nationkey, l_suppkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey WHERE l_shipdate >= TIMESTAMP '1997-01-01'"""


@both("left_left", "J02 J09", "customer", "orders", "nation")
def left_left():
    """SELECT c_custkey, n_name, o_orderkey FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey AND n_regionkey < 3 LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 250000
    WHERE c_mktsegment = 'MACHINERY'"""


@both("run_summary", "J03 A03 A04 A01 A08", "customer", "orders")
def run_summary():
    """SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS n, round(coalesce(avg(o_totalprice), 0), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high
    FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@query("array_aggregates", "A02", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments, count(*) AS n FROM customer GROUP BY c_nationkey")
def array_aggregates(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.concat_ws(",", F.array_sort(F.coalesce(F.collect_set("c_mktsegment"), F.array().cast("array<string>")))).alias("segments"), F.count("*").alias("n"))


@both("conditional_rollup", "A05", "lineitem")
def conditional_rollup():
    """SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS open_quantity
    FROM {lineitem} GROUP BY l_suppkey"""


@both("union_rank_dedupe", "U02 W01 W04", "lineitem")
def union_rank_dedupe():
    """SELECT l_orderkey, l_linenumber, side FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY side, l_extendedprice DESC, l_linenumber) AS r FROM
    (SELECT l_orderkey, l_linenumber, l_extendedprice, 0 AS side FROM {lineitem} WHERE l_discount >= 0.09 UNION ALL SELECT l_orderkey, l_linenumber, l_extendedprice, 1 AS side FROM {lineitem} WHERE l_tax >= 0.07) AS u) AS x WHERE r = 1"""


@both("distinct_keys", "U03", "orders")
def distinct_keys():
    """SELECT DISTINCT o_orderpriority, o_orderstatus FROM {orders}"""


@both("set_operations", "U07 U06", "orders", "customer")
def set_operations():
    """SELECT c_custkey AS k, 'both' AS how FROM ((SELECT c_custkey FROM {customer}) INTERSECT (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')) AS a UNION ALL SELECT c_custkey, 'one' FROM ((SELECT c_custkey FROM {customer}) EXCEPT (SELECT o_custkey FROM {orders})) AS b"""


@query("ordinality_lookup", "J11 X21 L03", "WITH q AS (SELECT unnest(range(1, 6))::INTEGER AS ord, unnest([7, 3, 99, 12, 1])::BIGINT AS key) SELECT ord, key, count(o_orderkey) AS n FROM q LEFT JOIN orders ON o_custkey = key GROUP BY 1, 2")
def ordinality_lookup(spark, d):
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (7, 3, 99, 12, 1)])).alias("i", "key")).select((F.col("i") + 1).alias("ord"), "key")
    return asked.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("key"), "left").groupBy("ord", "key").agg(F.count("o_orderkey").alias("n"))


@query("incidence_lift", "J24", "WITH h AS (SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber) FILTER (WHERE l_discount > 0.05) AS ports FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, part, coalesce(len(ports), 0)::INTEGER AS arity FROM h LEFT JOIN (SELECT o_orderkey AS k, unnest(ports) AS part FROM h) ON k = o_orderkey")
def incidence_lift(spark, d):
    lines = table(spark, d, "lineitem")
    ports = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_discount") > 0.05, F.struct("l_linenumber", "l_partkey")))).alias("ports"))
    return ports.select("o_orderkey", F.explode_outer("ports").alias("p"), F.size("ports").alias("arity")).select("o_orderkey", F.col("p.l_partkey").alias("part"), "arity")


@both("symbol_cross_reference", "J21", "part", "supplier")
def symbol_cross_reference():
    """SELECT p_partkey, s_suppkey FROM {part} JOIN {supplier} ON p_size = s_nationkey WHERE s_acctbal > 0"""


@query("reserved_slot_topk", "L07 L06", "WITH r AS (SELECT p_brand, p_partkey, p_retailprice, p_size >= 49 AS reserved, row_number() OVER (PARTITION BY p_brand, p_size >= 49 ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, p_partkey, reserved FROM r WHERE reserved OR k <= 2")
def reserved_slot_topk(spark, d):
    rows = table(spark, d, "part").withColumn("reserved", F.col("p_size") >= 49)
    open_rows = top_per_key(rows.where(~F.col("reserved")), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 2)
    return rows.where("reserved").unionByName(open_rows).select("p_brand", "p_partkey", "reserved")


@query("hash_split", "L11", "SELECT o_orderkey, CASE WHEN ('0x' || substr(sha256('split:' || o_orderkey), 1, 8))::BIGINT < 858993459 THEN 'held' ELSE 'fit' END AS side FROM orders")
def hash_split(spark, d):
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit("split:"), F.col("o_orderkey").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return table(spark, d, "orders").select("o_orderkey", F.when(draw < 858993459, "held").otherwise("fit").alias("side"))


@both("graph_lane_class", "F14 F15 F16 F12", "part")
def graph_lane_class():
    """SELECT p_partkey, lane, CASE WHEN quality >= 0.7 THEN 'promote' WHEN quality >= 0.4 THEN 'quarantine' ELSE 'reject' END AS decision, round(quality, 6) AS quality FROM
    (SELECT p_partkey, CASE WHEN p_type LIKE 'A%' THEN 'primary' WHEN p_type LIKE 'E%' THEN 'economy' ELSE 'general' END AS lane, 0.5 * (p_size / 50.0) + 0.5 * (CASE WHEN p_retailprice > 1200 THEN 1.0 ELSE 0.0 END) AS quality FROM {part}) AS t"""


@query("mmr_rerank", "L08")
def mmr_rerank(spark, d):
    """Diversity re-rank within each brand: greedy, price less the Jaccard overlap of names with what was picked."""

    def greedy(pdf):
        rows = [(r.p_partkey, r.p_retailprice / 2000, set(r.p_name.split())) for r in pdf.sort_values("p_partkey").itertuples()]
        picked = []
        while rows and len(picked) < 5:
            best = max(rows, key=lambda x: (round(x[1] - 0.5 * max((len(x[2] & y[2]) / max(1, len(x[2] | y[2])) for y in picked), default=0), 9), -x[0]))
            rows.remove(best)
            picked.append(best)
        return pdf.__class__({"p_brand": [pdf["p_brand"].iloc[0]] * len(picked), "p_partkey": [x[0] for x in picked], "rank": range(1, len(picked) + 1)})

    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice")
    few = top_per_key(rows, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 200)
    return few.groupBy("p_brand").applyInPandas(greedy, "p_brand string, p_partkey long, rank int")


@query("set_cover", "L09")
def set_cover(spark, d):
    """Greedy cheapest cover of the part sizes a brand sells by its types: each group is one brand's (type, size) pairs."""

    def cover(pdf):
        left, out = set(pdf["p_size"]), []
        sets = {t: (set(g["p_size"]), len(t)) for t, g in pdf.groupby("p_type")}
        while left:
            best = min(sets, key=lambda t: (sets[t][1] / max(1e-9, len(sets[t][0] & left)) if sets[t][0] & left else float("inf"), t))
            gain = sets[best][0] & left
            left -= gain
            out.append((pdf["p_brand"].iloc[0], best, len(gain)))
        return pdf.__class__(out, columns=["p_brand", "p_type", "covers"])

    pairs = table(spark, d, "part").select("p_brand", "p_type", "p_size").distinct()
    return pairs.groupBy("p_brand").applyInPandas(cover, "p_brand string, p_type string, covers int")
