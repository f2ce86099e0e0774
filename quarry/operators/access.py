"""Reads by id, prefetch, series, order in bytes, heavy hitters, and writes that hold only at the revision they expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, table


@query("batch_get", "S23", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def batch_get(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return get_all(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ids, "o_orderkey")


def get_all(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids, once each however often an id is asked for."""
    return rows.join(ids, key, "left_semi")


@query("prefetch_topn", "L05", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r) AS k FROM t WHERE r <= 6 AND o_orderstatus = 'F') SELECT o_custkey, o_orderkey, o_totalprice FROM f WHERE k <= 3")
def prefetch_topn(spark, d):
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return prefetched(table(spark, d, "orders"), "o_custkey", order, F.col("o_orderstatus") == "F", 3).select("o_custkey", "o_orderkey", "o_totalprice")


def prefetched(rows: DataFrame, key: str, order: list, keep, n: int) -> DataFrame:
    """A key's first 2 n rows, of those the ones to keep, of those the first n: fewer than n where the filter leaves fewer."""
    own = Window.partitionBy(key).orderBy(*order)
    first = rows.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= 2 * n).where(keep)
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_r"))).where(F.col("_k") <= n).drop("_r", "_k")


@query("series_range", "T09", "SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2 ORDER BY day DESC, event_type LIMIT 40")
def series_range(spark, d):
    day = F.col("ts").cast("date")
    rows = table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    return rows.groupBy("event_type", day.alias("day")).agg(F.round(F.sum("value"), 4).alias("total")).orderBy(F.desc("day"), "event_type").limit(40)


@query("adjacent_spans", "J18", "WITH s AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS n, coalesce(text, '') AS t FROM conversations), p AS (SELECT conv_id, turn, n, sum(n) OVER w - n AS byte_start, lead(turn) OVER w AS next_turn FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn, t)) SELECT conv_id, turn, next_turn, byte_start::BIGINT AS byte_start, (byte_start + n)::BIGINT AS byte_end FROM p WHERE next_turn IS NOT NULL")
def adjacent_spans(spark, d):
    """Each turn with the one after it and its place in its conversation's bytes."""
    w = Window.partitionBy("conv_id").orderBy("turn", "t")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), (upto - F.col("n")).alias("byte_start"), upto.alias("byte_end"))
    return placed.where("next_turn IS NOT NULL")


@query("heavy_hitters", "A07", r"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS item FROM documents) SELECT item, count(*) AS n FROM t GROUP BY 1 HAVING count(*) * 200 > (SELECT count(*) FROM t)")
def heavy_hitters(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return frequent(table(spark, d, "documents").select(F.explode(words).alias("item")), 200)


def frequent(items: DataFrame, k: int) -> DataFrame:
    """Items that make up more than one in k of all, with their exact counts.

    Each task keeps a summary of 2 k counters (Misra and Gries; Space-Saving holds the same ones), so at most 2 k items a task are
    shuffled, never the vocabulary; an item of more than one in k of all rows is such in some task's rows and cannot leave its
    summary. The candidates are then
    counted exactly.
    """

    def summary(batches):
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            counts = batch.column("item").value_counts()
            for item, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist(), strict=True):
                held[item] = held.get(item, 0) + n
            if len(held) > 2 * k:
                # what the next item below the kept ones has is taken from all: no item loses more than a 2 k-th of the rows so far
                cut = sorted(held.values(), reverse=True)[2 * k]
                held = {x: n - cut for x, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], names=["item"])

    total = F.broadcast(items.agg(F.count("*").alias("total")))  # one row
    likely = items.where("item IS NOT NULL").mapInArrow(summary, "item string").distinct()
    counted = items.join(likely, "item", "left_semi").groupBy("item").agg(F.count("*").alias("n"))
    return counted.crossJoin(total).where(F.col("n") * k > F.col("total")).select("item", "n")


@query(
    "compare_and_set",
    "K04",
    """WITH s AS (SELECT p_partkey AS id, 0 AS revision, p_size AS value FROM part), c AS (SELECT l_partkey AS id, l_linenumber - 1 AS expected, l_quantity::INTEGER AS value, l_orderkey * 10 + l_linenumber AS op FROM lineitem WHERE l_linenumber <= 2),
w AS (SELECT s.id, c.value, row_number() OVER (PARTITION BY s.id ORDER BY c.op) AS r FROM s JOIN c ON s.id = c.id AND c.expected = s.revision), n AS (SELECT id, count(*) AS refused FROM c GROUP BY 1)
SELECT s.id, CASE WHEN w.id IS NULL THEN s.revision ELSE s.revision + 1 END AS revision, coalesce(w.value, s.value) AS value, coalesce(refused, 0) - CASE WHEN w.id IS NULL THEN 0 ELSE 1 END AS refused FROM s LEFT JOIN w ON s.id = w.id AND w.r = 1 LEFT JOIN n ON s.id = n.id""",
)
def compare_and_set(spark, d):
    state = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("revision"), F.col("p_size").alias("value"))
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2")
    asked = lines.select(F.col("l_partkey").alias("id"), (F.col("l_linenumber") - 1).cast("int").alias("expected"), F.col("l_quantity").cast("int").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op"))
    return swap(state, asked)


def swap(state: DataFrame, asked: DataFrame) -> DataFrame:
    """The next version of state (id, revision, value): of the requests (id, expected, value, op) that expect a row's revision the first by op is taken and raises it; refused counts the others, those for the same revision included."""
    now = state.select("id", "revision")
    met = asked.join(now, "id")
    mine = met.groupBy("id").agg(F.min_by("value", F.when(F.col("expected") == F.col("revision"), F.col("op"))).alias("new"), F.count_if(F.col("expected") == F.col("revision")).alias("fit"), F.count("*").alias("all"))
    took = F.coalesce(F.col("fit") > 0, F.lit(False))
    return state.join(mine, "id", "left").select("id", (F.col("revision") + took.cast("int")).alias("revision"), F.when(took, F.col("new")).otherwise(F.col("value")).alias("value"), (F.coalesce("all", F.lit(0)) - took.cast("int")).cast("long").alias("refused"))


@query("temporal_validity", "F13", "WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'atemporal' WHEN event_id % 5 = 1 THEN 'unknown' ELSE 'known' END AS kind, ts AS since, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 10 DAY END AS upto, value / 100 AS uncertainty FROM events), v AS (SELECT *, since <= TIMESTAMP '2024-01-15' AND (upto IS NULL OR TIMESTAMP '2024-01-15' <= upto) AS holds FROM s) SELECT event_id, CASE WHEN kind = 'atemporal' THEN 'atemporal' WHEN kind = 'unknown' THEN 'uncertain' WHEN holds THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN kind = 'atemporal' THEN 1.0 WHEN kind = 'unknown' THEN round(greatest(0, least(1, 1 - uncertainty)), 6) WHEN holds THEN 1.0 ELSE 0.0 END::DOUBLE AS fit FROM v")
def temporal_validity(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "atemporal").when(F.col("event_id") % 5 == 1, "unknown").otherwise("known")
    upto = F.when(F.col("event_id") % 3 != 0, F.expr("ts + INTERVAL 10 DAY"))
    scopes = e.select("event_id", kind.alias("kind"), F.col("ts").alias("since"), upto.alias("upto"), (F.col("value") / 100).alias("uncertainty"))
    return valid_at(scopes, F.expr("TIMESTAMP_NTZ '2024-01-15'")).select("event_id", "status", "fit")


def valid_at(scopes: DataFrame, t) -> DataFrame:
    """scopes (kind, since, upto, uncertainty) with status and fit at t: known ones hold in a closed interval, open where upto is null; unknown ones fit by what is certain; atemporal ones always."""
    holds = (F.col("since") <= t) & (F.col("upto").isNull() | (F.col("upto") >= t))
    status = F.when(F.col("kind") == "atemporal", "atemporal").when(F.col("kind") == "unknown", "uncertain").when(holds, "valid").otherwise("invalid")
    unsure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("uncertainty"))), 6)
    fit = F.when(F.col("kind") == "atemporal", 1.0).when(F.col("kind") == "unknown", unsure).when(holds, 1.0).otherwise(0.0)
    return scopes.withColumns({"status": status, "fit": fit})


@query("media_sniff", "S03 S05", r"WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN '{\"a\":' WHEN 2 THEN repeat(chr(1), 400) ELSE '' END || CASE WHEN page_id % 6 = 3 THEN '' ELSE coalesce(html, '') END AS body, CASE page_id % 6 WHEN 1 THEN 'x.json' WHEN 4 THEN 'x.html' ELSE 'x.bin' END AS path FROM pages) SELECT page_id, CASE WHEN body = '' THEN 'inode/x-empty' WHEN body LIKE '\%PDF-%' ESCAPE '\' THEN 'application/pdf' WHEN path = 'x.json' THEN 'application/json' WHEN path = 'x.html' THEN 'text/html' WHEN page_id % 6 = 2 THEN 'application/octet-stream' ELSE 'text/plain' END AS media_type FROM f")
def media_sniff(spark, d):
    """Media types of files made of pages, some with a known start, a known ending, control bytes or nothing in them."""
    from quarry.sources.readers import media_type

    k = F.col("page_id") % 6
    start = F.when(k == 0, "%PDF-1.7 ").when(k == 1, '{"a":').when(k == 2, F.repeat(F.lit("\x01"), 400)).otherwise("")
    body = F.concat(start, F.when(k == 3, "").otherwise(F.coalesce("html", F.lit(""))))
    path = F.when(k == 1, "x.json").when(k == 4, "x.html").otherwise("x.bin")
    return table(spark, d, "pages").select("page_id", media_type(path, F.encode(body, "UTF-8")).alias("media_type"))


@query("jsonl_round_trip", "S26", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, d):
    """Rows written as JSON lines in the shared folder and read again by their schema; nulls stay nulls."""
    from quarry.streaming.folds import shared_folder

    rows, at = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), shared_folder(spark)
    rows.write.option("ignoreNullFields", False).json(f"{at}/lines")
    return spark.read.schema(rows.schema).json(f"{at}/lines")


@query(
    "relation_policies",
    "P02",
    """WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2, 3)
SELECT src, dst, relation, w FROM e UNION ALL SELECT dst, src, relation, round(w * 0.5, 6) FROM e WHERE relation = 'R' UNION ALL SELECT dst, src, 'A-inverse', w FROM e WHERE relation = 'A'""",
)
def relation_policies(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation")).agg(F.sum("l_quantity").cast("double").alias("w"))
    policies = spark.createDataFrame([("N", "directed", None, None), ("R", "reversible", 0.5, None), ("A", "learned_inverse", None, "A-inverse")], "relation string, direction string, scale double, inverse string")
    return by_policy(e, policies)


def by_policy(edges: DataFrame, policies: DataFrame) -> DataFrame:
    """edges (src, dst, relation, w) with the ways back that policies (relation, direction, scale, inverse) give them: none where directed or without a policy, the same relation scaled where reversible, the inverse relation where one was learned."""
    back = edges.join(policies.where("direction IN ('reversible', 'learned_inverse')"), "relation")
    reversible = F.col("direction") == "reversible"
    weight = F.when(reversible, F.round(F.col("w") * F.coalesce("scale", F.lit(1.0)), 6)).otherwise(F.col("w"))
    back = back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(reversible, F.col("relation")).otherwise(F.col("inverse")).alias("relation"), weight.alias("w"))
    return edges.unionByName(back)


@query(
    "topological_order",
    "L12",
    """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 2),
r AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey <= 1 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.node), m AS (SELECT node, max(level) AS level FROM r GROUP BY 1)
SELECT node, level, row_number() OVER (PARTITION BY level ORDER BY node)::INTEGER AS place FROM m""",
)
def topological_order(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("dst"))
    edges = part.where("dst > 1").select(F.expr("dst div 2").alias("src"), "dst").unionByName(part.where("dst > 2").select(F.expr("dst div 3").alias("src"), "dst")).distinct()
    order = topological(part.select(F.col("dst").alias("node")), edges).where("level IS NOT NULL")
    return order.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy("node")))


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of every node: the longest way to it from one without needs; null for nodes on a cycle or behind one.

    Each round takes the nodes whose needs have all been taken, so there are as many rounds as levels; nodes of a level have no
    order among themselves but their own.
    """
    from quarry.operators.graph import cut

    e = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    needs = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))
    left = cut(nodes.distinct().join(needs, "node", "left").select("node", F.coalesce("open", F.lit(0)).cast("long").alias("open")))
    taken, level = None, 0
    while True:
        ready = left.where("open = 0").select("node")
        if ready.isEmpty():
            rest = left.select("node", F.lit(None).cast("int").alias("level"))
            return rest if taken is None else taken.unionByName(rest)
        now = cut(ready.select("node", F.lit(level).alias("level")))
        taken = now if taken is None else taken.unionByName(now)
        met = now.select(F.col("node").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met"))
        left = cut(left.where("open > 0").join(met, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))
        level += 1


@query(
    "ledger_verify",
    "ST04",
    """WITH s AS (SELECT user_id, event_id, ts, sha256(event_id || ':' || event_type) AS hash, lag(sha256(event_id || ':' || event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
f AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS altered, CASE WHEN parent IS NOT NULL AND event_id % 89 = 0 THEN 1 ELSE 0 END AS unlinked FROM s)
SELECT user_id, count(*) AS events, sum(altered)::BIGINT AS altered, sum(unlinked)::BIGINT AS unlinked, sum(altered) + sum(unlinked) = 0 AS holds FROM f GROUP BY 1""",
)
def ledger_verify(spark, d):
    """A stored chain per user in which each 97th event was altered after it was hashed and each 89th one's link was lost."""
    own = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), F.col("event_type")), 256)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stored = table(spark, d, "events").withColumn("hash", own).withColumn("parent", F.lag("hash").over(w))
    kind = F.when(F.col("event_id") % 97 == 0, F.concat("event_type", F.lit("?"))).otherwise(F.col("event_type"))
    lost = F.when(F.col("parent").isNotNull() & (F.col("event_id") % 89 == 0), F.lit("0")).otherwise(F.col("parent"))
    return verified(stored.withColumns({"event_type": kind, "parent": lost}), "user_id", own, ["ts", "event_id"])


def verified(stored: DataFrame, key: str, own, order: list[str]) -> DataFrame:
    """(key, events, altered, unlinked, holds): rows whose hash is not that of what they hold, and those whose parent is not the hash of the row before them in their key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    marks = stored.select(key, (F.col("hash") != own).alias("a"), (~F.col("parent").eqNullSafe(F.lag("hash").over(w))).alias("u"))
    counts = marks.groupBy(key).agg(F.count("*").alias("events"), F.count_if("a").alias("altered"), F.count_if("u").alias("unlinked"))
    return counts.withColumn("holds", (F.col("altered") + F.col("unlinked")) == 0)
