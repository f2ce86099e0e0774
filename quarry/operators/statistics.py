"""Profiles, entropy, quantiles, evidence mass, bounds, divergences, bootstrap, tests and causal effects as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.quantiles import order_statistics, quantiles
from quarry.operators.relational import both
from quarry.plans.registry import query, table


@query(
    "column_profile",
    "X36 A11 A10",
    """WITH u AS (SELECT unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) AS col, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)
SELECT col, count(*) AS n, count(*) - count(v) AS missing, count(DISTINCT v) AS n_distinct, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean, round(var_pop(v), 1) AS variance,
round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75 FROM u GROUP BY col""",
)
def column_profile(spark, d):
    return profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: counts, distinct values, extremes, mean, population variance and exact quartiles. No group's distinct values are held by one task."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    plain = rows.groupBy("col").agg(F.count("*").alias("n"), (F.count("*") - F.count("v")).alias("missing"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.coalesce(F.var_pop("v"), F.lit(0.0)), 1).alias("variance"))
    q = quantiles(rows, ["col"], "v", [0.25, 0.5, 0.75]).select("col", "n_distinct", "q")
    out = plain.join(q, "col", "left").fillna(0, "n_distinct")
    return out.select("col", "n", "missing", "n_distinct", "low", "high", "mean", "variance", *[F.round(F.col("q")[i], 4).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


@query("top_values", "X36 A06", "SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r <= 4")
def top_values(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("r <= 4").drop("r")


@query("entropy_by_segment", "A09", "WITH n AS (SELECT c_mktsegment, c_nationkey, count(*)::DOUBLE AS n FROM customer GROUP BY 1, 2), p AS (SELECT c_mktsegment, n / sum(n) OVER (PARTITION BY c_mktsegment) AS p FROM n) SELECT c_mktsegment, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY 1")
def entropy_by_segment(spark, d):
    n = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")))
    return p.groupBy("c_mktsegment").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))


@query(
    "evidence_mass",
    "A12 X35",
    """WITH e AS (SELECT lang, source, max(CASE WHEN quality = 1 THEN 0.9 ELSE 0.3 END) AS support, max(CASE WHEN toxic = 1 THEN 0.6 ELSE 0.0 END) AS against FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
s AS (SELECT lang, sum(support)::DOUBLE AS s, sum(against)::DOUBLE AS a FROM e GROUP BY 1) SELECT lang, round(s, 6) AS support, round(a, 6) AS against, round(s / (s + a + 1), 6) AS belief, round((s + 1) / (s + a + 1), 6) AS plausibility, round(2 * least(s, a) / nullif(s + a, 0), 6) AS contradiction FROM s""",
)
def evidence_mass(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    one = rows.groupBy("lang", "source").agg(F.max(F.when(F.col("quality") == 1, 0.9).otherwise(0.3)).alias("support"), F.max(F.when(F.col("toxic") == 1, 0.6).otherwise(0.0)).alias("against"))
    s, a = F.col("s"), F.col("a")
    mass = one.groupBy("lang").agg(F.sum("support").alias("s"), F.sum("against").alias("a"))
    return mass.select("lang", F.round(s, 6).alias("support"), F.round(a, 6).alias("against"), F.round(s / (s + a + 1), 6).alias("belief"), F.round((s + 1) / (s + a + 1), 6).alias("plausibility"), F.round(F.try_divide(2 * F.least(s, a), s + a), 6).alias("contradiction"))


@query("claim_consolidation", "A13 A14", "WITH g AS (SELECT source, substr(sha256(coalesce(text, '')), 1, 1) AS value, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1, 2) SELECT source, value, n, first, last, count(*) OVER (PARTITION BY source) > 1 AS contradictory FROM g")
def claim_consolidation(spark, d):
    g = table(spark, d, "documents").groupBy("source", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1).alias("value")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return g.withColumn("contradictory", F.count("*").over(Window.partitionBy("source")) > 1)


def running_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))


@query("running_mean", "A15", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def running_mean_by_type(spark, d):
    return running_mean(table(spark, d, "events"), "event_type", "value")


@both("counter_fold", "A16 A17", "lineitem")
def counter_fold():
    """SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, CAST(l_discount * 100 AS INTEGER) AS step, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS mass, min(l_quantity) AS low, max(l_quantity) AS high
    FROM {lineitem} GROUP BY 1, 2, 3, 4, 5"""


@both("merge_with_replay_guard", "A18", "lineitem")
def merge_with_replay_guard():
    """SELECT l_partkey, count(*) AS n FROM (SELECT l_partkey, l_orderkey % 4 AS snapshot FROM {lineitem} UNION ALL SELECT l_partkey, 9 AS snapshot FROM {lineitem} WHERE l_orderkey % 4 = 1) AS u
    WHERE snapshot NOT IN (SELECT 9 AS seen) GROUP BY l_partkey"""


@query("feature_share", "A19", "WITH f AS (SELECT p_partkey, p_retailprice AS w, unnest(list_distinct(string_split(p_name, ' '))) AS f FROM part), s AS (SELECT f, sum(w) AS w FROM f GROUP BY 1) SELECT f, round(w, 4) AS mass, round(w / sum(w) OVER (), 6) AS share FROM s ORDER BY mass DESC, f LIMIT 20")
def feature_share(spark, d):
    s = table(spark, d, "part").select("p_retailprice", F.explode(F.array_distinct(F.split("p_name", " "))).alias("f")).groupBy("f").agg(F.sum("p_retailprice").alias("w"))
    total = F.broadcast(s.agg(F.sum("w").alias("total")))
    return s.crossJoin(total).select("f", F.round("w", 4).alias("mass"), F.round(F.col("w") / F.col("total"), 6).alias("share")).orderBy(F.desc("mass"), "f").limit(20)


@both("node_balance", "A20", "orders", "customer", "lineitem", "supplier")
def node_balance():
    """SELECT nation, round(sum(flow), 2) AS balance FROM (SELECT c_nationkey AS nation, -l_extendedprice AS flow FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
    UNION ALL SELECT s_nationkey, l_extendedprice FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey) AS f GROUP BY nation"""


@query("path_combination", "A21 A22", "SELECT l_orderkey, round(1 - exp(sum(ln(1 - l_discount))) + 1e-9, 6) AS noisy_or, round(max((1 - l_discount) * (1 - l_tax)), 4) AS best_product, round(min(l_discount + l_tax), 4) AS least_sum, round(greatest(0.0, sum(1 - l_discount) - (count(*) - 1)), 4) AS lower, round(min(1 - l_discount), 4) AS upper FROM lineitem GROUP BY 1")
def path_combination(spark, d):
    disc, tax = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(1 - F.exp(F.sum(F.log1p(-disc))) + 1e-9, 6).alias("noisy_or"), F.round(F.max((1 - disc) * (1 - tax)), 4).alias("best_product"), F.round(F.min(disc + tax), 4).alias("least_sum"),
        F.round(F.greatest(F.lit(0.0), F.sum(1 - disc) - (F.count("*") - 1)), 4).alias("lower"), F.round(F.min(1 - disc), 4).alias("upper"),
    )


@query("z_outliers", "W12", "WITH z AS (SELECT event_id, event_type, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type)) SELECT event_id, event_type, round(z, 4) AS z FROM z WHERE abs(z) >= 3 AND n > 8")
def z_outliers(spark, d):
    rows = table(spark, d, "events")
    m = rows.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").alias("n")).where("n > 8")
    z = F.try_divide(F.col("value") - F.col("m"), F.col("s"))
    return rows.join(m, "event_type").where(F.abs(z) >= 3).select("event_id", "event_type", F.round(z, 4).alias("z"))


@query(
    "js_divergence_by_lang",
    "X30 X29",
    r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]')) AS c FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT lang, c, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
p AS (SELECT lang, c, n / sum(n) OVER (PARTITION BY lang) AS p FROM n), a AS (SELECT coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM (SELECT * FROM p WHERE lang = 'en') x FULL JOIN (SELECT * FROM p WHERE lang = 'de') y ON x.c = y.c)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS divergence FROM a""",
)
def js_divergence_by_lang(spark, d):
    t = table(spark, d, "documents").where(F.col("lang").isin("en", "de")).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))).alias("c"))
    n = t.groupBy("lang", "c").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    both_ = p.groupBy("c").agg(F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("p"))), F.lit(0.0)).alias("p"), F.coalesce(F.sum(F.when(F.col("lang") == "de", F.col("p"))), F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)) / 2
    return both_.agg(F.round(term("p") + term("q"), 6).alias("divergence"))


@query(
    "relation_strength",
    "X32 X33 G18 X34 X35",
    """WITH f AS (SELECT l_orderkey, l_linenumber, [1 - l_discount, 1 - l_tax, l_quantity / 50, least(l_extendedprice / 50000, 1)] AS f, CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0.0 END AS contra, pow(0.5, date_diff('day', l_shipdate, TIMESTAMP '1998-12-31') / 365.0) AS decay FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, CASE WHEN list_min(f) <= 0 THEN 0 ELSE exp(list_avg(list_transform(f, lambda x: ln(x)))) * (1 - contra) END AS s, decay FROM f),
q AS (SELECT quantile_cont(s, [0.25, 0.5, 0.75, 0.9]) AS q FROM s)
SELECT CASE WHEN s >= q[4] THEN 'fixed' WHEN s >= q[3] THEN 'strong' WHEN s >= q[2] THEN 'usual' WHEN s >= q[1] THEN 'weak' ELSE 'faint' END AS state, count(*) AS n, round(avg(s), 6) AS mean, round(avg(s * decay), 6) AS decayed FROM s, q GROUP BY 1""",
)
def relation_strength(spark, d):
    factors = F.array(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("l_quantity") / 50, F.least(F.col("l_extendedprice") / 50000, F.lit(1.0)))
    contra = F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    mean = F.exp(F.aggregate(F.transform("f", lambda x: F.log(x)), F.lit(0.0), lambda a, x: a + x) / F.size("f"))
    decay = F.pow(F.lit(0.5), F.datediff(F.lit("1998-12-31").cast("date"), F.col("l_shipdate").cast("date")) / 365.0)
    s = table(spark, d, "lineitem").withColumn("f", factors).select(F.when(F.array_min("f") <= 0, 0.0).otherwise(mean * (1 - contra)).alias("s"), decay.alias("decay"))
    q = F.broadcast(quantiles(s, [], "s", [0.25, 0.5, 0.75, 0.9]).select("q"))  # one row
    state = F.when(F.col("s") >= F.col("q")[3], "fixed").when(F.col("s") >= F.col("q")[2], "strong").when(F.col("s") >= F.col("q")[1], "usual").when(F.col("s") >= F.col("q")[0], "weak").otherwise("faint")
    return s.crossJoin(q).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.avg(F.col("s") * F.col("decay")), 6).alias("decayed"))


def draw(*parts: Column) -> Column:
    """A whole number below 2**32 from a hash: the same in every run and engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


@query(
    "bootstrap_lcb",
    "M06 M07",
    """WITH g AS (SELECT source, avg(quality)::DOUBLE AS m, row_number() OVER (ORDER BY source) - 1 AS i FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY source), n AS (SELECT count(*) AS n FROM g),
r AS (SELECT unnest(range(0, 200)) AS rep), s AS (SELECT unnest(range(0, (SELECT n FROM n))) AS slot), p AS (SELECT rep, ('0x' || substr(sha256(rep || ':' || slot), 1, 8))::BIGINT % n AS i FROM r, s, n),
b AS (SELECT rep, avg(m) AS m FROM p JOIN g USING (i) GROUP BY rep) SELECT round((SELECT avg(m) FROM g), 6) AS mean, round(quantile_cont(m, 0.05), 6) AS lower, round(quantile_cont(m, 0.95), 6) AS upper FROM b""",
)
def bootstrap_lcb(spark, d):
    groups = table(spark, d, "documents").where("source IS NOT NULL").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("m"))
    return bootstrap_mean(groups, "source", "m", 200)


def bootstrap_mean(groups: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """Cluster bootstrap of the mean: each replicate draws as many groups as there are, by hash. One row a group and replicate."""
    g = groups.select(F.col(value).alias("m"), (F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias("i"))
    n = F.broadcast(g.agg(F.count("*").alias("n"), F.avg("m").alias("mean")))
    slots = g.sparkSession.range(replicates).withColumnRenamed("id", "rep").crossJoin(n).select("rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    drawn = slots.select("rep", (draw(F.col("rep"), F.col("slot")) % F.col("n")).alias("i"))
    b = drawn.join(g, "i").groupBy("rep").agg(F.avg("m").alias("m"))
    return b.agg(F.percentile("m", [0.05, 0.95]).alias("q")).crossJoin(n).select(F.round("mean", 6).alias("mean"), F.round(F.col("q")[0], 6).alias("lower"), F.round(F.col("q")[1], 6).alias("upper"))


@query(
    "holm_hoeffding",
    "T10 M06",
    """WITH s AS (SELECT event_type, count(*) AS n, avg(least(value / 100, 1)) AS m FROM events GROUP BY 1), p AS (SELECT event_type, m - sqrt(ln(20) / (2 * n)) AS lcb, least(1.0, exp(-2 * n * pow(greatest(m - 0.45, 0), 2))) AS p FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS k, count(*) OVER () AS m FROM p) SELECT event_type, round(lcb, 6) AS lcb, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY k), 6) AS adjusted FROM r""",
)
def holm_hoeffding(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.least(F.col("value") / 100, F.lit(1.0))).alias("m"))
    p = s.select("event_type", (F.col("m") - F.sqrt(F.log(F.lit(20.0)) / (2 * F.col("n")))).alias("lcb"), F.least(F.lit(1.0), F.exp(-2 * F.col("n") * F.pow(F.greatest(F.col("m") - 0.45, F.lit(0.0)), 2))).alias("p"))
    r = p.withColumn("k", F.row_number().over(Window.orderBy("p", "event_type"))).withColumn("m", F.count("*").over(Window.partitionBy()))
    return r.select("event_type", F.round("lcb", 6).alias("lcb"), F.round(F.max(F.least(F.lit(1.0), (F.col("m") - F.col("k") + 1) * F.col("p"))).over(Window.orderBy("k")), 6).alias("adjusted"))


@query(
    "sprt",
    "T10",
    """WITH x AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN ln(0.3 / 0.15) ELSE ln(0.7 / 0.85) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS llr, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
c AS (SELECT *, CASE WHEN llr >= ln(0.9 / 0.1) THEN 'accept' WHEN llr <= ln(0.1 / 0.9) THEN 'reject' END AS verdict FROM x) SELECT user_id, min(step)::INTEGER AS step, min_by(verdict, step) AS verdict FROM c WHERE verdict IS NOT NULL GROUP BY 1""",
)
def sprt(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.when(F.col("event_type") == "purchase", F.log(F.lit(0.3 / 0.15))).otherwise(F.log(F.lit(0.7 / 0.85)))
    x = table(spark, d, "events").select("user_id", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("llr"), F.row_number().over(w).alias("step"))
    verdict = F.when(F.col("llr") >= F.log(F.lit(9.0)), "accept").when(F.col("llr") <= F.log(F.lit(0.1 / 0.9)), "reject")
    return x.withColumn("verdict", verdict).where("verdict IS NOT NULL").groupBy("user_id").agg(F.min("step").alias("step"), F.min_by("verdict", "step").alias("verdict"))


@query(
    "ate_stratified",
    "T11",
    """WITH m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders), r AS (SELECT c_mktsegment AS stratum, (o_orderpriority < '3')::INTEGER AS treated, (o_totalprice > m)::INTEGER AS y FROM orders JOIN customer ON o_custkey = c_custkey, m),
s AS (SELECT stratum, count(*) AS n, count(*) FILTER (treated = 1) AS n1, count(*) FILTER (treated = 0) AS n0, avg(y) FILTER (treated = 1) - avg(y) FILTER (treated = 0) AS effect FROM r GROUP BY 1)
SELECT round(sum(n * effect) / sum(n), 6) AS ate, count(*) AS strata, min(least(n1, n0)) >= 2 AS positive FROM s""",
)
def ate_stratified(spark, d):
    orders = table(spark, d, "orders")
    m = F.broadcast(quantiles(orders, [], "o_totalprice", [0.5]).select(F.col("q")[0].alias("m")))  # one row
    r = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).crossJoin(m).select(F.col("c_mktsegment").alias("stratum"), (F.col("o_orderpriority") < "3").alias("treated"), (F.col("o_totalprice") > F.col("m")).cast("int").alias("y"))
    return stratified_effect(r)


def stratified_effect(rows: DataFrame) -> DataFrame:
    """Back-door adjusted mean effect of treated on y over strata, and whether each stratum has two rows of either arm."""
    t = F.col("treated")
    s = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(t).alias("n1"), F.count_if(~t).alias("n0"), (F.avg(F.when(t, F.col("y"))) - F.avg(F.when(~t, F.col("y")))).alias("effect"))
    return s.agg(F.round(F.sum(F.col("n") * F.col("effect")) / F.sum("n"), 6).alias("ate"), F.count("*").alias("strata"), (F.min(F.least("n1", "n0")) >= 2).alias("positive"))


@query(
    "conformal_interval",
    "T12",
    """WITH r AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events), k AS (SELECT event_type, m, abs(value - m) AS res, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - m)) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, round(m - res, 6) AS low, round(m + res, 6) AS high FROM k WHERE k = least(n, ceil((n + 1) * 0.9))""",
)
def conformal_interval(spark, d):
    return conformal(table(spark, d, "events"), "event_type", "value", 0.9)


def conformal(rows: DataFrame, group: str, value: str, level: float) -> DataFrame:
    """(group, low, high): the mean, less and plus the residual whose rank among the group's covers level; nulls take no part."""
    m = rows.groupBy(group).agg(F.avg(value).alias("m"))
    res = rows.join(m, group).withColumn("res", F.abs(F.col(value) - F.col("m")))
    rank = lambda n: F.array((F.least(n, F.ceil((n + 1) * F.lit(level))) - 1).cast("long"))
    at = order_statistics(res, [group], "res", rank).select(group, F.map_values("at")[0].alias("res"))
    return m.join(at, group).select(group, F.round(F.col("m") - F.col("res"), 6).alias("low"), F.round(F.col("m") + F.col("res"), 6).alias("high"))


@both("scalar_equations", "X29 X17 X31", "part")
def scalar_equations():
    """SELECT p_partkey, round(p * 0.8 / (p * 0.8 + (1 - p) * 0.3), 6) AS posterior, round(p * 0.5 * 0.9, 6) AS conductance, round(least(greatest((p - 0.5) * 3, 0), 1), 6) AS clamped, round(p + 0.4 * (0.7 - p), 6) AS kalman, round(p * 1.2 / (p * 1.2 + (1 - p) * 0.9), 6) AS replicator
    FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 51 AS p FROM {part}) AS t"""


def chernoff(p: list[float], q: list[float], steps: int = 60) -> float:
    """Chernoff information of two distributions: the largest -log sum p^s q^(1-s), by golden-section search."""
    import math

    f = lambda s: math.log(sum(a**s * b ** (1 - s) for a, b in zip(p, q, strict=True) if a > 0 and b > 0) or 1e-300)
    lo, hi, g = 0.0, 1.0, (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if f(a) < f(b) else (a, hi)
    return -f((lo + hi) / 2)


@query("chernoff_by_lang", "X31")
def chernoff_by_lang(spark, d):
    """Chernoff information between the letter distributions of each pair of languages: 26 numbers a language are all that is gathered."""
    import pandas as pd

    t = table(spark, d, "documents").where("lang IS NOT NULL").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))).alias("c"))
    n = t.groupBy("lang", "c").agg(F.count("*").alias("n"))
    p = n.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))
    pairs = p.toDF("a", "ma").join(p.toDF("b", "mb"), F.col("a") < F.col("b"))

    def score(batches):
        for pdf in batches:
            out = []
            for x, y in zip(pdf["ma"], pdf["mb"], strict=True):
                x, y = dict(x), dict(y)
                keys = sorted(set(x) | set(y))
                out.append(chernoff([x.get(k, 0) / sum(x.values()) for k in keys], [y.get(k, 0) / sum(y.values()) for k in keys]))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "information": out})

    return pairs.mapInPandas(score, "a string, b string, information double")
