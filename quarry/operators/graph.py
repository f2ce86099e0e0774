"""Graphs as edge tables: build, slice, merge, walks, ranks, components, distances, cores, diffusion.

Iterations are fixed-length programs of joins and partial sums; every few rounds the state is written through checkpoint(), which
cuts lineage and survives lost executors. Nothing gathers a graph on the driver but the kernels that say so, on bounded slices.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.plans.registry import query, table


def shared_folder(spark) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_pairs(lines: DataFrame) -> DataFrame:
    """(a, b), a < b: each two parts of an order, once an order. An order has few lines, so its pairs are made inside its own array."""
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p")).where(F.size("p") > 1)
    at = F.sequence(F.lit(0), F.size("p") - 2)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(F.get("p", i).alias("a"), y.alias("b")))))
    return per.select(F.explode(pairs).alias("e")).select("e.a", "e.b")


def copurchase(lines: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, w): parts that share orders."""
    return shared_pairs(lines).groupBy("a", "b").agg(F.count("*").alias("w")).where(F.col("w") >= least)


_CO = "co AS (SELECT a, b, count(*) AS w FROM (SELECT DISTINCT x.l_orderkey, x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey) GROUP BY 1, 2)"


@query("copurchase_graph", "G01", f"WITH {_CO} SELECT a, b, w FROM co")
def copurchase_graph(spark, d):
    return copurchase(table(spark, d, "lineitem"))


@query("degrees", "G09 A08", f"WITH {_CO}, s AS (SELECT a AS node, w FROM co UNION ALL SELECT b, w FROM co) SELECT node, count(*) AS degree, sum(w)::BIGINT AS strength FROM s GROUP BY 1")
def degrees(spark, d):
    e = copurchase(table(spark, d, "lineitem"))
    return ends(e).groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def ends(edges: DataFrame) -> DataFrame:
    """(node, other, w): each edge from both sides."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "w"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "w"))).alias("x")).select("x.*")


@query("triangles", "J19 G13", f"WITH {_CO} SELECT x.a, x.b, y.b AS c FROM co x JOIN co y ON x.b = y.a JOIN co z ON z.a = x.a AND z.b = y.b")
def triangles(spark, d):
    return triangles_of_orders(table(spark, d, "lineitem"))


#: About as many edges as one task of triangles_of() holds; candidates that it tries at once, and marks that it sets for them.
TASK_EDGES, TRIED, MARKS = 6_000_000, 100_000, 4_000_000
_PAIRS, _DEALT, _HELD = "n long, a binary, b binary", "block int, s binary, t binary", "p int, q int, left binary, right binary, s binary, t binary"


def triangles_of_orders(lines: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: parts of which each two share an order."""
    return _triangles(blocks.by_order(lines).mapInArrow(_paired(blocks.order_pairs), _PAIRS))


def triangles_of(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c: nodes that are all joined by edges (a, b), a < b."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a < b")
    return _triangles(edges.mapInArrow(_paired(lambda batches: map(blocks.columns, batches)), _PAIRS))


def _triangles(pairs: DataFrame) -> DataFrame:
    """Triangles of packed edges, which may repeat.

    Nodes are coloured by hash and edges written once, packed, by the colours of their ends. A task reads the edges between three
    colours, which hold all triangles of those colours, so candidates are never shuffled. An edge tries the neighbours of the end
    that has fewer, so a hub's edges are not met with each other.
    """
    spark, pairs = pairs.sparkSession, cut(pairs)
    colours = max(1, math.ceil((6 * (pairs.agg(F.sum("n")).first()[0] or 0) / TASK_EDGES) ** 0.5))
    root = f"{shared_folder(spark)}/quarry-triangles-{uuid.uuid4().hex}"
    dealt = pairs.select("a", "b").mapInArrow(_coloured(colours), _DEALT).repartition(colours * (colours + 1) // 2, "block")
    dealt.groupBy("block").applyInArrow(_held(colours), _HELD).write.option("compression", "uncompressed").partitionBy("p", "q").parquet(root)
    held = spark.read.schema("left binary, right binary, s binary, t binary, p int, q int").parquet(root)
    found = []
    for i, j, k in combinations_with_replacement(range(colours), 3):
        mine = " OR ".join(f"(p = {x} AND q = {y})" for x, y in sorted({(i, j), (i, k), (j, k)}))
        found.append(held.where(mine).select("p", "q", "left", "right", "s", "t").coalesce(1).mapInArrow(_closed(i, j, k), "a long, b long, c long"))
    # A union of plans of one partition each runs them all in one task; beside a plan of two it keeps a task for each.
    none = spark.range(0, 2, 1, 2).where("id < 0").select(*(F.col("id").alias(c) for c in "abc"))
    while len(found) > 1:  # a flat tree: no deep plan
        found = [reduce(DataFrame.unionByName, found[n : n + 8], none) for n in range(0, len(found), 8)]
    return found[0]


def _paired(edges):
    """Batches, read by edges to arrays a and b and others, to packed rows."""

    def run(batches):
        for a, b, *_ in blocks.gathered(edges(batches)):
            yield from blocks.table_of(_PAIRS, [(len(a), blocks.pack(a), blocks.pack(b))]).to_batches()

    return run


def _coloured(colours: int):
    """Packed rows to packed rows of the blocks they belong to: s of the lesser colour, and less than t where they are of one colour."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                a, b = (blocks.unpack(x.as_py(), np.int64) for x in row)
                ca, cb = blocks.colour(a, colours), blocks.colour(b, colours)
                swap = ca > cb
                yield from blocks.split(_DEALT, np.minimum(ca, cb) * colours + np.maximum(ca, cb), [np.where(swap, b, a), np.where(swap, a, b)])

    return run


def _held(colours: int):
    """A block's edges, each once and by s, as places s and t in its nodes left and right."""

    def run(table):
        import numpy as np

        p, q = divmod(table.column("block")[0].as_py(), colours)
        left, s, right, t = (y for c in "st" for y in np.unique(np.concatenate([blocks.unpack(x.as_py(), np.int64) for x in table.column(c)]), return_inverse=True))
        s, t = np.divmod(np.unique(s * len(right) + t), len(right))
        return blocks.table_of(_HELD, [(p, q, *(blocks.pack(x) for x in (left, right, s.astype(np.int32), t.astype(np.int32))))])

    return run


def _closed(i: int, j: int, k: int):
    """Triangles of nodes u, v, w of colours i <= j <= k among the blocks of those colours."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = {}
        for batch in batches:
            for p, q, left, right, s, t in zip(*batch.columns, strict=True):
                parts[p.as_py(), q.as_py()] = *(blocks.unpack(x.as_py(), np.int64) for x in (left, right)), *(blocks.unpack(x.as_py(), np.int32) for x in (s, t))
        if not {(i, j), (i, k), (j, k)} <= parts.keys():
            return
        names = {c: np.unique(np.concatenate([x[side] for at, x in parts.items() for side in (0, 1) if at[side] == c])) for c in {i, j, k}}
        edges = {(p, q): (np.searchsorted(names[p], left).astype(np.int32)[s], np.searchsorted(names[q], right).astype(np.int32)[t]) for (p, q), (left, right, s, t) in parts.items()}
        parts.clear()
        n = len(names[k])
        near = {x: (edges[x][1], np.searchsorted(edges[x][0], np.arange(len(names[x[0]]) + 1))) for x in {(i, k), (j, k)}}
        (u, v), rows = edges[i, j], max(1, MARKS // n)
        du, dv = (np.diff(near[x][1])[y] for x, y in (((i, k), u), ((j, k), v)))
        mark = np.zeros(rows * n, bool)

        def met(x, y, marked, tried):
            """(edge, w): w among both the neighbours of its x, which are marked, and those of its y, which are tried; edges by x."""
            (to_x, from_x), (to_y, from_y) = marked, tried
            size = np.diff(from_y)[y]
            upto = np.cumsum(size)
            at = before = 0
            while at < len(x):
                to = max(at + 1, int(min(np.searchsorted(upto, before + TRIED, "right"), np.searchsorted(x, x[at] + rows))))
                first, last = x[at], x[to - 1] + 1
                bounds = from_x[first : last + 1]
                places = np.repeat(np.arange(last - first, dtype=np.int64) * n, np.diff(bounds)) + to_x[bounds[0] : bounds[-1]]
                mark[places] = True
                m = size[at:to]
                place = np.repeat(from_y[y[at:to]] - (upto[at:to] - m - before), m)
                place += np.arange(len(place))
                w = to_y[place]
                row = np.repeat((x[at:to] - first).astype(np.int64) * n, m)
                row += w
                hit = np.flatnonzero(mark[row])
                mark[places] = False
                if len(hit):
                    yield at + np.searchsorted(upto[at:to] - before, hit, "right"), w[hit]
                at, before = to, upto[to - 1]

        def all_met():
            for own, (cx, x), (cy, y) in ((du >= dv) & (dv > 0), (i, u), (j, v)), ((du < dv) & (du > 0), (j, v), (i, u)):
                x, y = x[own], y[own]
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                for e, w in met(x, y, near[cx, k], near[cy, k]):
                    yield names[cx][x[e]], names[cy][y[e]], names[k][w]

        for x, y, w in blocks.gathered(all_met(), TRIED):
            low, high = np.minimum(x, y), np.maximum(x, y)
            three = np.minimum(low, w), np.maximum(low, np.minimum(high, w)), np.maximum(high, w)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in three], names=["a", "b", "c"])

    return run


@query("graph_slice", "G02 J06 W01 U02", f"WITH {_CO}, s AS (SELECT a AS node, b AS other, w FROM co WHERE a <= 20 UNION ALL SELECT b, a, w FROM co WHERE b <= 20), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS r FROM s) SELECT node, other, w FROM r WHERE r <= 5")
def graph_slice(spark, d):
    return slice_of(copurchase(table(spark, d, "lineitem")), F.col("node") <= 20, 5)


def slice_of(edges: DataFrame, seeds, k: int) -> DataFrame:
    """The k strongest edges of each seed node."""
    w = Window.partitionBy("node").orderBy(F.desc("w"), "other")
    return ends(edges).where(seeds).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


@query(
    "graph_merge_upsert",
    "G03 K02 U04 X20",
    """WITH u AS (SELECT l_partkey AS id, l_discount AS alpha, [l_returnflag] AS tags, l_shipdate AS seen, l_orderkey * 10 + l_linenumber AS k FROM lineitem) SELECT id, max(alpha) AS alpha, array_to_string(list_sort(list(DISTINCT tags[1])), ',') AS tags, max_by(k, {'s': seen, 'k': k}) AS last FROM u GROUP BY id""",
)
def graph_merge_upsert(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("alpha"), F.array("l_returnflag").alias("tags"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    old, new = lines.where("k % 2 = 0"), lines.where("k % 2 = 1")
    return merge(old.unionByName(new))


def merge(rows: DataFrame) -> DataFrame:
    """Upsert of nodes: largest alpha, union of tags, the payload of the latest row."""
    merged = rows.groupBy("id").agg(F.max("alpha").alias("alpha"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.max_by("k", F.struct("at", "k")).alias("last"))
    return merged.select("id", "alpha", F.concat_ws(",", "tags").alias("tags"), "last")


def walk(edges: DataFrame, restart: DataFrame, rounds: int, keep: float = 0.85, uniform: bool = False) -> DataFrame:
    """Random walk with restart over (src, dst, w) from restart (node, p): mass that finds no edge goes back to the restart, or to all nodes."""
    e = cut(edges.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src"))))
    start = cut(restart)
    nodes = start.count() if uniform else 1
    at = start
    for i in range(rounds):
        moved = at.join(e, at["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("m"))
        total = F.broadcast(moved.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("held")))
        back = (1 - keep) + keep * (1 - F.col("held"))
        if uniform:
            at = start.select("node", F.col("p").alias("r")).join(moved, "node", "left").crossJoin(total).select("node", ((1 - keep) * F.col("r") + keep * (F.coalesce("m", F.lit(0.0)) + (1 - F.col("held")) / nodes)).alias("p"))
        else:
            at = start.select("node", F.col("p").alias("r")).join(moved, "node", "full").crossJoin(total).select("node", (keep * F.coalesce("m", F.lit(0.0)) + back * F.coalesce("r", F.lit(0.0))).alias("p"))
        if i % 3 == 2:
            at = cut(at)
    return at


_CS = "e AS (SELECT 'c' || c_nationkey AS src, 's' || s_nationkey AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 UNION ALL SELECT 's' || s_nationkey, 'c' || ((s_nationkey + 1) % 25), 2.0 FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey < 20)), n AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e)"


def trade(spark, d) -> DataFrame:
    """Nations of customers to nations of suppliers by lines sold, and a few edges back."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = lines.groupBy(F.concat(F.lit("c"), "c_nationkey").alias("src"), F.concat(F.lit("s"), "s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    back = table(spark, d, "supplier").where("s_nationkey < 20").select("s_nationkey").distinct()
    return sold.unionByName(back.select(F.concat(F.lit("s"), "s_nationkey").alias("src"), F.concat(F.lit("c"), (F.col("s_nationkey") + 1) % 25).alias("dst"), F.lit(2.0).alias("w")))


def _rounds(uniform: bool, n: int) -> str:
    out = [f"WITH {_CS}"]
    if uniform:
        out.append("r AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS p FROM (SELECT DISTINCT src AS node FROM e UNION SELECT DISTINCT dst FROM e))")
    else:
        out.append("r AS (SELECT 'c1' AS node, 0.5::DOUBLE AS p UNION ALL SELECT 'c2', 0.5)")
    out.append("p0 AS (SELECT * FROM r)")
    for i in range(1, n + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT dst AS node, sum(p * w) AS m FROM p{i - 1} JOIN n ON node = src GROUP BY 1), h{i} AS (SELECT coalesce(sum(m), 0) AS held FROM m{i})")
        if uniform:
            out.append(f"p{i} AS MATERIALIZED (SELECT node, 0.15 * p + 0.85 * (coalesce(m, 0) + (1 - held) / (SELECT count(*) FROM r)) AS p FROM r LEFT JOIN m{i} USING (node), h{i})")
        else:
            out.append(f"p{i} AS MATERIALIZED (SELECT coalesce(r.node, m{i}.node) AS node, 0.85 * coalesce(m, 0) + (0.15 + 0.85 * (1 - held)) * coalesce(p, 0) AS p FROM r FULL JOIN m{i} ON r.node = m{i}.node, h{i})")
    return ", ".join(out) + f" SELECT node, round(p, 6) AS p FROM p{n}"


@query("random_walk_with_restart", "G04 P01", _rounds(False, 6))
def random_walk_with_restart(spark, d):
    restart = spark.createDataFrame([("c1", 0.5), ("c2", 0.5)], "node string, p double")
    return walk(trade(spark, d), restart, 6).select("node", F.round("p", 6).alias("p"))


@query("pagerank_fixed", "G07", _rounds(True, 6))
def pagerank_fixed(spark, d):
    e = trade(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    return walk(e, nodes.withColumn("p", F.lit(1.0 / n)), 6, uniform=True).select("node", F.round("p", 6).alias("p"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, level): least number of edges (src, dst) from any seed, at most depth if given: a frontier joined once a level until it is empty."""
    seen = cut(seeds.select("node", F.lit(0).alias("level")))
    front = seen
    level = 0
    while depth is None or level < depth:
        level += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(step.select("node", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


@query("bfs_levels", "G11 J20", f"WITH RECURSIVE {_CO}, s AS (SELECT a AS src, b AS dst FROM co WHERE w >= 2 UNION ALL SELECT b, a FROM co WHERE w >= 2), r AS (SELECT 1::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN s ON node = src WHERE level < 4) SELECT node, min(level)::INTEGER AS level FROM r GROUP BY 1")
def bfs_levels(spark, d):
    e = cut(ends(copurchase(table(spark, d, "lineitem"), 2)).select(F.col("node").alias("src"), F.col("other").alias("dst")))
    return reach(e, spark.range(1, 2).toDF("node"), 4)


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, component): smallest node each can reach over (a, b). Labels take the least of their neighbours' and then of their label's own label, so paths halve each round."""
    e = cut(edges.select("a", "b").where("a <> b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "m").alias("m"))
        jump = low.join(labels.toDF("m", "mm"), "m", "left").select("node", F.col("component").alias("was"), F.least("m", F.coalesce("mm", "m")).alias("component"))
        after = cut(jump)
        changed = after.where("was <> component").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


@query(
    "components",
    "G08",
    f"WITH RECURSIVE {_CO}, h AS (SELECT a, b FROM co WHERE w >= 2), s AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h), r AS (SELECT a AS node, a AS reach FROM s UNION SELECT r.node, s.b FROM r JOIN s ON r.reach = s.a) SELECT node, min(reach) AS component FROM r GROUP BY 1",
)
def components_query(spark, d):
    return components(copurchase(table(spark, d, "lineitem"), 2))


def cores(edges: DataFrame) -> DataFrame:
    """(node, core) of every node: each starts at its degree and takes the h-index of its neighbours' values until none changes, which
    ends at the core numbers. Neighbours are counted by value first, so a hub has no more rows than values."""
    e = cut(ends(edges.withColumn("w", F.lit(1))).select("node", "other").where("node <> other").distinct())
    at = cut(e.groupBy("node").agg(F.count("*").alias("core")))
    down = Window.partitionBy("node").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        counts = e.join(at.select(F.col("node").alias("other"), F.col("core").alias("v")), "other").groupBy("node", "v").agg(F.count("*").alias("c"))
        h = counts.withColumn("up", F.sum("c").over(down)).groupBy("node").agg(F.max(F.least("v", "up")).alias("h"))
        after = cut(at.join(h, "node").select("node", F.col("core").alias("was"), F.least("core", "h").alias("core")))
        at = after.select("node", "core")
        if after.where("was <> core").isEmpty():
            return at


@query("core_numbers", "G10")
def core_numbers(spark, d):
    return cores(copurchase(table(spark, d, "lineitem"), 2))


def _heat(n: int) -> str:
    out = [f"WITH {_CO}, s AS (SELECT a AS src, b AS dst, w::DOUBLE AS w FROM co UNION ALL SELECT b, a, w FROM co), g AS (SELECT src AS node, sum(w) AS deg FROM s GROUP BY 1), p0 AS (SELECT node, CASE WHEN node <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS h, deg FROM g)"]
    for i in range(1, n + 1):
        out.append(f"p{i} AS MATERIALIZED (SELECT x.node, x.h + 0.2 * (sum(s.w * y.h) / x.deg - x.h) AS h, x.deg FROM p{i - 1} x JOIN s ON s.src = x.node JOIN p{i - 1} y ON y.node = s.dst GROUP BY x.node, x.h, x.deg)")
    return ", ".join(out) + f" SELECT node, round(h, 6) AS heat FROM p{n}"


@query("heat_diffusion", "G14", _heat(4))
def heat_diffusion(spark, d):
    return heat(copurchase(table(spark, d, "lineitem")))


def heat(e: DataFrame) -> DataFrame:
    """(node, heat) after four steps from the nodes up to 5 over (a, b, w)."""
    s = cut(ends(e).select(F.col("node").alias("src"), F.col("other").alias("dst"), F.col("w").cast("double").alias("w")))
    at = s.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg")).select("node", F.when(F.col("node") <= 5, 1.0).otherwise(0.0).alias("h"), "deg")
    for i in range(4):
        pull = s.join(at.select(F.col("node").alias("dst"), "h"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("h")).alias("pull"))
        at = at.join(pull, "node").select("node", (F.col("h") + 0.2 * (F.col("pull") / F.col("deg") - F.col("h"))).alias("h"), "deg")
        at = cut(at) if i % 2 else at
    return at.select("node", F.round("h", 6).alias("heat"))


def spectrum(weights) -> dict:
    """Laplacian eigenvalues, Fiedler value and spectral entropy of a symmetric weight matrix."""
    import numpy as np

    w = np.asarray(weights, float)
    lap = np.diag(w.sum(1)) - w
    values = np.clip(np.linalg.eigvalsh(lap), 0, None)
    p = values / values.sum() if values.sum() else values
    return {"fiedler": float(values[1]) if len(values) > 1 else 0.0, "largest": float(values[-1]), "entropy": float(-(p[p > 0] * np.log2(p[p > 0])).sum())}


@query("region_spectra", "G12 G13")
def region_spectra(spark, d):
    """Spectrum of each region's trade between its nations: five nations a region are all that a group holds."""
    import numpy as np

    def solve(pdf):
        keys = sorted(set(pdf["x"]) | set(pdf["y"]))
        w = np.zeros((len(keys), len(keys)))
        for r in pdf.itertuples():
            i, j = keys.index(r.x), keys.index(r.y)
            if i != j:
                w[i, j] += r.w
                w[j, i] += r.w
        s = spectrum(w)
        return pdf.__class__({"region": [pdf["region"].iloc[0]], **{k: [round(v, 6)] for k, v in s.items()}})

    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    e = trade(spark, d).where("src LIKE 'c%'").select(F.expr("int(substr(src, 2))").alias("x"), F.expr("int(substr(dst, 2))").alias("y"), "w")
    e = e.join(n.toDF("x", "region"), "x").join(n.toDF("y", "r2"), "y").where("region = r2")
    return e.select("region", "x", "y", "w").groupBy("region").applyInPandas(solve, "region int, fiedler double, largest double, entropy double")


def max_flow(edges: list[tuple], source, sink) -> float:
    """Edmonds-Karp."""
    from collections import defaultdict, deque

    room, near = defaultdict(float), defaultdict(set)
    for a, b, w in edges:
        room[a, b] += w
        near[a].add(b)
        near[b].add(a)
    total = 0.0
    while True:
        came, todo = {source: None}, deque([source])
        while todo and sink not in came:
            x = todo.popleft()
            for y in sorted(near[x]):
                if y not in came and room[x, y] > 1e-12:
                    came[y] = x
                    todo.append(y)
        if sink not in came:
            return total
        path, y = [], sink
        while came[y] is not None:
            path.append((came[y], y))
            y = came[y]
        push = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= push
            room[b, a] += push
        total += push


@query("region_max_flow", "G15")
def region_max_flow(spark, d):
    """Largest flow from each region's first nation of customers to its last nation of suppliers, a group a region."""

    def solve(pdf):
        edges = [(r.src, r.dst, r.w) for r in pdf.itertuples()]
        nodes = sorted({x for e in edges for x in e[:2]})
        return pdf.__class__({"region": [pdf["region"].iloc[0]], "flow": [round(max_flow(edges, nodes[0], nodes[-1]), 6)]})

    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    e = trade(spark, d).withColumn("k", F.expr("int(substr(src, 2))"))
    return e.join(n, e["k"] == n["n_nationkey"]).select("region", "src", "dst", "w").groupBy("region").applyInPandas(solve, "region int, flow double")


@query(
    "hash_walks",
    "",
    f"""WITH RECURSIVE {_CO}, s AS (SELECT a AS src, b AS dst FROM co UNION ALL SELECT b, a FROM co), k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM s),
r AS (SELECT DISTINCT src AS start, src AS node, 0 AS step FROM s UNION ALL SELECT start, dst, step + 1 FROM r JOIN k ON node = src AND i = (('0x' || substr(sha256(start || ':' || step), 1, 8))::BIGINT) % n WHERE step < 3) SELECT start, step, node FROM r""",
)
def hash_walks(spark, d):
    return walks(copurchase(table(spark, d, "lineitem")))


def walks(edges: DataFrame) -> DataFrame:
    """(start, step, node): three steps from every node, each to a neighbour drawn by hash."""
    s = ends(edges)
    near = cut(s.groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("near")))
    at = near.select(F.col("node").alias("start"), F.lit(0).alias("step"), "node")
    out = at
    for step in range(3):
        pick = F.conv(F.substring(F.sha2(F.concat(F.col("start").cast("string"), F.lit(f":{step}")), 256), 1, 8), 16, 10).cast("long")
        at = at.join(near, "node").select("start", F.lit(step + 1).alias("step"), F.get("near", (pick % F.size("near")).cast("int")).alias("node"))
        out = out.unionByName(at)
    return out


def _dual(n: int) -> str:
    """Two walks of n rounds from the same restart, over edges that sell much and over those that come back."""
    out = [f"WITH {_CS}", "r AS (SELECT 'c1' AS node, 0.5::DOUBLE AS p UNION ALL SELECT 'c2', 0.5)"]
    for k, (a, b) in {"f": ("src", "dst"), "b": ("dst", "src")}.items():
        out += [f"n{k} AS (SELECT {a} AS src, {b} AS dst, w / sum(w) OVER (PARTITION BY {a}) AS w FROM e)", f"p{k}0 AS (SELECT * FROM r)"]
        for i in range(1, n + 1):
            out.append(f"m{k}{i} AS MATERIALIZED (SELECT dst AS node, sum(p * w) AS m FROM p{k}{i - 1} JOIN n{k} ON node = src GROUP BY 1), h{k}{i} AS (SELECT coalesce(sum(m), 0) AS held FROM m{k}{i})")
            out.append(f"p{k}{i} AS MATERIALIZED (SELECT coalesce(r.node, m{k}{i}.node) AS node, 0.85 * coalesce(m, 0) + (0.15 + 0.85 * (1 - held)) * coalesce(p, 0) AS p FROM r FULL JOIN m{k}{i} ON r.node = m{k}{i}.node, h{k}{i})")
    return ", ".join(out) + f" SELECT coalesce(x.node, y.node) AS node, round(coalesce(x.p, 0), 6) AS positive, round(coalesce(y.p, 0), 6) AS contradiction FROM pf{n} x FULL JOIN pb{n} y ON x.node = y.node"


@query("dual_channel_activation", "G23", _dual(4))
def dual_channel_activation(spark, d):
    e, restart = trade(spark, d), spark.createDataFrame([("c1", 0.5), ("c2", 0.5)], "node string, p double")
    return dual_channel(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), restart, 4)


def dual_channel(positive: DataFrame, contradiction: DataFrame, restart: DataFrame, rounds: int) -> DataFrame:
    """(node, positive, contradiction): what each of two edge sets' walks with restart gives a node, 0 where it has none."""
    x = walk(positive, restart, rounds).select("node", F.col("p").alias("x"))
    y = walk(contradiction, restart, rounds).select("node", F.col("p").alias("y"))
    return x.join(y, "node", "full").select("node", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("positive"), F.round(F.coalesce("y", F.lit(0.0)), 6).alias("contradiction"))


def _green(n: int) -> str:
    out = [f"WITH {_CO}, s AS (SELECT a AS src, b AS dst, w::DOUBLE AS w FROM co UNION ALL SELECT b, a, w FROM co), g AS (SELECT src AS node, sum(w) AS deg FROM s GROUP BY 1), p0 AS (SELECT node, deg, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM g)"]
    for i in range(1, n + 1):
        out.append(f"p{i} AS MATERIALIZED (SELECT t.node, t.deg, (CASE WHEN t.node % 10 = 0 THEN 1 ELSE 0 END + sum(s.w * o.x)) / (t.deg + 0.08) AS x, (CASE WHEN t.node % 10 = 5 THEN 1 ELSE 0 END + sum(s.w * o.y)) / (t.deg + 0.08) AS y FROM p{i - 1} t JOIN s ON s.src = t.node JOIN p{i - 1} o ON o.node = s.dst GROUP BY t.node, t.deg)")
    return ", ".join(out) + f", m AS (SELECT max(x) AS mx, max(y) AS my FROM p{n}), q AS (SELECT node, x / mx AS x, y / my AS y FROM p{n}, m) SELECT node, round(x, 6) AS support, round(y, 6) AS contradiction, round(1 - greatest(x, y), 6) AS uncertainty, round(greatest(0, least(1, x - 0.72 * y)), 6) AS answerability FROM q"


@query("green_potential", "G17", _green(8))
def green_potential(spark, d):
    lines = table(spark, d, "lineitem")
    colours = blocks.colours_for(2 * lines.count())  # an order has about as many pairs as twice its lines
    return _potentials(blocks.blocks_of_orders(lines, colours), colours, F.col("node") % 10 == 0, F.col("node") % 10 == 5, 8)


def potentials(edges: DataFrame, support, contradiction, rounds: int, damping: float = 0.08) -> DataFrame:
    """(node, support, contradiction, uncertainty, answerability): Jacobi steps of the damped Laplacian from two sets of sources, each potential over its largest value. Edges (a, b, w) may come in several rows."""
    colours = blocks.colours_for(edges.count())
    return _potentials(blocks.blocks_of_edges(edges, colours), colours, support, contradiction, rounds, damping)


def _potentials(held: DataFrame, colours: int, support, contradiction, rounds: int, damping: float = 0.08) -> DataFrame:
    held = cut(held)
    sources = [F.when(c, 1.0).otherwise(0.0).alias(n) for n, c in (("sx", support), ("sy", contradiction))]
    state = cut(blocks.states(blocks.strengths(held).select("node", "deg", *sources), colours))
    for _ in range(rounds):
        state = cut(blocks.jacobi(held, state, colours, damping))
    at = blocks.values(state)
    top = F.broadcast(at.agg(F.max("x").alias("mx"), F.max("y").alias("my")))  # one row
    x, y = (F.coalesce(F.try_divide(F.col(c), F.col(f"m{c}")), F.lit(0.0)) for c in ("x", "y"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x - 0.72 * y))
    return at.crossJoin(top).select("node", F.round(x, 6).alias("support"), F.round(y, 6).alias("contradiction"), F.round(1 - F.greatest(x, y), 6).alias("uncertainty"), F.round(clamped, 6).alias("answerability"))
