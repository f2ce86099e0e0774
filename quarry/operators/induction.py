"""What structure texts and relations show by themselves: promoted relations, boundaries, populations, classes, roles, drift.

Counts over all rows are aggregated by Spark; models are fitted on the aggregates, whose size is that of an alphabet, not of the data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, table, texts

SMOOTH = 0.5
LEAST_SOURCES, LEAST_FIT = 4, 2


def promotions(seen: DataFrame) -> DataFrame:
    """Which relations the sources that were held out pay for: seen (relation, source, signature), a source counted once a signature.

    A quarter of the sources, drawn by hash, is held out. A relation's held-out signatures cost nats under the smoothed code of all
    relations and under its own; its own must win by more than the code's parameters cost. The same is computed for relations
    relabelled to the next one's name, which must not win where it has sources enough. Of the tests that promotion can make this is
    the one of code length and its shuffled control; recovery of the relation from a signature is not scored.
    """
    one = seen.where("relation IS NOT NULL AND source IS NOT NULL AND signature IS NOT NULL").distinct()
    ranks = one.select("source").distinct().withColumn("h", F.sha2(F.concat(F.lit("held:"), "source"), 256))
    held = ranks.select("source", (F.substring("h", 1, 1) < "4").alias("held"))
    counts = one.join(held, "source").groupBy("relation", "signature", "held").agg(F.count("*").alias("n"))
    sources = one.join(held, "source").groupBy("relation").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.when(~F.col("held"), F.col("source"))).alias("fit_sources"))
    names = counts.groupBy().agg(F.array_sort(F.collect_set("relation")).alias("names"), F.count_distinct("signature").alias("width"))  # one row: the relations' alphabet
    at = F.array_position("names", F.col("relation"))
    named = counts.crossJoin(F.broadcast(names))
    fit = named.where("NOT held").groupBy("relation", "signature").agg(F.sum("n").alias("c"))
    other = named.where("NOT held").select(F.get("names", (at % F.size("names")).cast("int")).alias("relation"), "signature", F.col("n").alias("c")).groupBy("relation", "signature").agg(F.sum("c").alias("o"))
    every = fit.groupBy("signature").agg(F.sum("c").alias("all_c"))
    total = F.broadcast(fit.agg(F.sum("c").alias("all_n")))  # one row
    own = fit.groupBy("relation").agg(F.sum("c").alias("own_n"))
    moved = other.groupBy("relation").agg(F.sum("o").alias("moved_n"))
    movers = sources.crossJoin(F.broadcast(names)).select(F.get("names", (at % F.size("names")).cast("int")).alias("relation"), F.col("fit_sources").alias("movers"))
    test = named.where("held").groupBy("relation", "signature", "width").agg(F.sum("n").alias("n"))
    row = test.join(every, "signature", "left").join(fit, ["relation", "signature"], "left").join(other, ["relation", "signature"], "left").join(own, "relation", "left").join(moved, "relation", "left").crossJoin(total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    nats = lambda c, n: F.sum(-F.col("n") * F.log((zero(c) + SMOOTH) / (zero(n) + SMOOTH * F.col("width"))))
    cost = lambda n: F.when(zero(n) > 0, F.log1p(F.col("width")) + 0.5 * (F.col("width") - 1) * F.log(F.greatest(F.lit(2), zero(n)))).otherwise(0.0)
    code = row.groupBy("relation").agg(nats("all_c", "all_n").alias("base"), nats("c", "own_n").alias("own"), nats("o", "moved_n").alias("moved"), F.first(cost("own_n")).alias("model"), F.first(cost("moved_n")).alias("moved_model"))
    gain = F.round(F.col("base") - F.col("own") - F.col("model"), 6)
    control = F.round(F.col("base") - F.col("moved") - F.col("moved_model"), 6)
    rows = sources.join(code, "relation", "left").join(movers, "relation").select("relation", "sources", "fit_sources", "movers", F.round("base", 6).alias("base"), F.round("own", 6).alias("own"), F.round("model", 6).alias("model"), gain.alias("gain"), control.alias("control"))
    kept = (F.col("sources") >= LEAST_SOURCES) & (F.col("fit_sources") >= LEAST_FIT) & F.coalesce(F.col("gain") > 0, F.lit(False)) & ~F.coalesce((F.col("movers") >= LEAST_SOURCES) & (F.col("control") > 0), F.lit(False))
    return rows.withColumn("promoted", kept).drop("movers")


@query(
    "relation_promotion",
    "N19",
    """WITH one AS (SELECT DISTINCT c_nationkey::VARCHAR AS relation, o_custkey::VARCHAR AS source, o_orderpriority AS signature FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT DISTINCT 'priority ' || o_orderpriority, o_custkey::VARCHAR, o_orderpriority FROM orders),
h AS (SELECT *, substr(sha256('held:' || source), 1, 1) < '4' AS held FROM one), k AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT relation FROM one)),
nx AS (SELECT a.relation, b.relation AS next FROM k a JOIN k b ON b.i = (a.i + 1) % a.n), w AS (SELECT count(DISTINCT signature) AS width FROM one), f AS (SELECT relation, signature, count(*) AS c FROM h WHERE NOT held GROUP BY 1, 2),
g AS (SELECT next AS relation, signature, sum(c) AS c FROM f JOIN nx USING (relation) GROUP BY 1, 2), a AS (SELECT signature, sum(c) AS c FROM f GROUP BY 1), fn AS (SELECT relation, sum(c) AS n FROM f GROUP BY 1), gn AS (SELECT relation, sum(c) AS n FROM g GROUP BY 1), an AS (SELECT sum(c) AS n FROM f),
t AS (SELECT relation, signature, count(*) AS n FROM h WHERE held GROUP BY 1, 2),
c AS (SELECT t.relation, sum(-t.n * ln((coalesce(a.c, 0) + 0.5) / (an.n + 0.5 * width))) AS base, sum(-t.n * ln((coalesce(f.c, 0) + 0.5) / (coalesce(fn.n, 0) + 0.5 * width))) AS own, sum(-t.n * ln((coalesce(g.c, 0) + 0.5) / (coalesce(gn.n, 0) + 0.5 * width))) AS moved,
max(CASE WHEN fn.n > 0 THEN ln(1 + width) + 0.5 * (width - 1) * ln(greatest(2, fn.n)) ELSE 0 END) AS model, max(CASE WHEN gn.n > 0 THEN ln(1 + width) + 0.5 * (width - 1) * ln(greatest(2, gn.n)) ELSE 0 END) AS moved_model
FROM t LEFT JOIN a USING (signature) LEFT JOIN f ON f.relation = t.relation AND f.signature = t.signature LEFT JOIN g ON g.relation = t.relation AND g.signature = t.signature LEFT JOIN fn ON fn.relation = t.relation LEFT JOIN gn ON gn.relation = t.relation, an, w GROUP BY 1),
s AS (SELECT relation, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (NOT held) AS fit_sources FROM h GROUP BY 1), m AS (SELECT next AS relation, fit_sources AS movers FROM s JOIN nx USING (relation))
SELECT s.*, round(base, 6) AS base, round(own, 6) AS own, round(model, 6) AS model, round(base - own - model, 6) AS gain, round(base - moved - moved_model, 6) AS control, sources >= 4 AND fit_sources >= 2 AND coalesce(base - own - model > 0, false) AND NOT coalesce(m.movers >= 4 AND base - moved - moved_model > 0, false) AS promoted FROM s LEFT JOIN c USING (relation) LEFT JOIN m USING (relation)""",
)
def relation_promotion(spark, d):
    """Relations from nations, which say nothing of an order's priority, and from the priorities themselves, which say all."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    source = F.col("o_custkey").cast("string").alias("source")
    nation = o.select(F.col("c_nationkey").cast("string").alias("relation"), source, F.col("o_orderpriority").alias("signature"))
    own = table(spark, d, "orders").select(F.concat(F.lit("priority "), "o_orderpriority").alias("relation"), source, F.col("o_orderpriority").alias("signature"))
    return promotions(nation.unionByName(own))


#: features of a gap between words: the word before ends a sentence's length of letters, the next one's first character
BOUNDARY = ["short", "long", "upper", "digit"]


def gaps(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, boundary, short, long, upper, digit, n): gaps between words by what stands around them, counted; a gap is a boundary where the word before ends in . ! or ?"""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.where("text IS NOT NULL").select(*keep, words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))
    g = rows.where("size(w) > 1").select(*keep, F.explode(pairs).alias("g")).select(*keep, F.regexp_replace("g.a", r"[.!?]+$", "").alias("a"), F.col("g.a").rlike(r"[.!?]$").alias("boundary"), F.substring("g.b", 1, 1).alias("b"))
    cells = [(F.length("a") <= 3).alias("short"), (F.length("a") >= 8).alias("long"), F.col("b").rlike(r"\p{Lu}").alias("upper"), F.col("b").rlike(r"[0-9]").alias("digit")]
    return g.select(*keep, "boundary", *cells).groupBy(*keep, "boundary", *BOUNDARY).agg(F.count("*").alias("n"))


def fit_boundary(x, positive, negative, l2: float = 0.02, rounds: int = 50):
    """(intercept, weights) of the logistic boundary model on counted rows, by Newton's steps: least mean log loss plus l2 / 2 of the weights' squares."""
    x = np.column_stack([np.ones(len(x)), np.asarray(x, float)])
    positive, mass = np.asarray(positive, float), np.asarray(positive, float) + np.asarray(negative, float)
    total, b = max(mass.sum(), 1.0), np.zeros(x.shape[1])
    ridge = np.r_[0.0, np.full(x.shape[1] - 1, l2)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p * mass - positive) / total + ridge * b
        step = np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x / total + np.diag(ridge + 1e-9), gradient)
        b -= step
        if np.abs(step).max() < 1e-12:
            break
    return b[0], b[1:]


def boundary_loss(model, x, positive, negative) -> float:
    """Mean nats a gap."""
    p = np.clip(1 / (1 + np.exp(-(model[0] + np.asarray(x, float) @ model[1]))), 1e-12, 1 - 1e-12)
    mass = np.sum(positive) + np.sum(negative)
    return float(-(np.asarray(positive) @ np.log(p) + np.asarray(negative) @ np.log(1 - p)) / max(mass, 1))


def _cells(rows) -> tuple:
    x = [[float(r[c]) for c in BOUNDARY] for r in rows]
    return x, [r["pos"] for r in rows], [r["neg"] for r in rows]


def _counted(g: DataFrame, *keep: str) -> DataFrame:
    side = lambda b: F.sum(F.when(F.col("boundary") == b, F.col("n")).otherwise(0))
    return g.groupBy(*keep, *BOUNDARY).agg(side(True).alias("pos"), side(False).alias("neg"))


@query("boundary_estimator", "N13 A17")
def boundary_estimator(spark, d):
    """Sentence boundaries: fitted on documents outside a fifth drawn by hash, scored on that fifth, a row a language. The driver holds 16 cells a language and side."""
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held")
    docs = texts(spark, d).select("lang", "text", held)
    rows = _counted(gaps(docs.where("lang IS NOT NULL AND held IS NOT NULL"), "lang", "held"), "lang", "held").orderBy("lang", "held", *BOUNDARY).collect()  # the alphabet's cells
    out = []
    for lang in sorted({r["lang"] for r in rows}):
        fit, test = (_cells([r for r in rows if r["lang"] == lang and r["held"] == side]) for side in (False, True))
        model = fit_boundary(*fit)
        out.append((lang, *[round(float(v), 4) for v in (model[0], *model[1])], round(boundary_loss(model, *fit), 5), round(boundary_loss(model, *test), 5) if test[0] else None))
    return spark.createDataFrame(out, "lang string, intercept double, " + ", ".join(f"{c} double" for c in BOUNDARY) + ", fit_loss double, held_loss double")


def populations(x, positive, negative, held, most: int = 4, rounds: int = 40):
    """(k, assignment, {k: nats}): how many boundary models units (rows of arrays: unit, cell) follow. For each k, units are dealt by log odds and then moved to the model that codes them best; k is the one whose held-out nats plus the code of its parameters is least."""
    cost, best = {}, None
    pos, neg, held = np.asarray(positive, float), np.asarray(negative, float), np.asarray(held, bool)
    odds = np.log((pos.sum(1) + 0.5) / (neg.sum(1) + 0.5))
    for k in range(1, min(most, int((~held).sum())) + 1):
        order = np.argsort(odds, kind="stable")
        at = np.empty(len(odds), int)
        at[order] = np.arange(len(odds)) * k // len(odds)
        for _ in range(rounds):
            models = [fit_boundary(x, pos[(at == j) & ~held].sum(0), neg[(at == j) & ~held].sum(0)) for j in range(k)]
            nats = np.array([[boundary_loss(m, x, p, n) * (p.sum() + n.sum()) for m in models] for p, n in zip(pos, neg, strict=True)])
            after = nats.argmin(1)
            if (after == at).all():
                break
            at = after
        mass = pos[~held].sum() + neg[~held].sum()
        cost[k] = float(nats.min(1)[held].sum() + 0.5 * k * (len(x[0]) + 1) * math.log(max(2.0, mass)) + len(at) * math.log(k))
        if best is None or cost[k] < cost[best[0]] - 1e-9:
            best = (k, at)
    return best[0], best[1], cost


@query("boundary_populations", "N14")
def boundary_populations(spark, d):
    """Units are a language's sources, every fourth in order held out; the driver holds 16 cells a unit."""
    g = _counted(gaps(texts(spark, d).where("lang IS NOT NULL AND source IS NOT NULL"), "lang", "source"), "lang", "source").orderBy("lang", "source", *BOUNDARY).collect()  # units times cells
    units = sorted({(r["lang"], r["source"]) for r in g})
    cells = sorted({tuple(float(r[c]) for c in BOUNDARY) for r in g})
    pos, neg = np.zeros((len(units), len(cells))), np.zeros((len(units), len(cells)))
    for r in g:
        i, j = units.index((r["lang"], r["source"])), cells.index(tuple(float(r[c]) for c in BOUNDARY))
        pos[i, j], neg[i, j] = r["pos"], r["neg"]
    k, at, cost = populations([list(c) for c in cells], pos, neg, [i % 4 == 3 for i in range(len(units))])
    return spark.createDataFrame([(*u, int(a), k, round(cost[k], 3)) for u, a in zip(units, at, strict=True)], "lang string, source string, population int, populations int, nats double")


def complete_link(sets: list[set], least: float) -> list[list[int]]:
    """Clusters of sets: the two whose least similar members are most alike (Jaccard) are merged until that falls below least; ties go to the first pair. Clusters keep a matrix of their least similarities, so a merge costs one row."""
    n = len(sets)
    like = np.full((n, n), -1.0)
    for i in range(n):
        for j in range(i + 1, n):
            union = len(sets[i] | sets[j])
            like[i, j] = like[j, i] = len(sets[i] & sets[j]) / union if union else 0.0
    members = {i: [i] for i in range(n)}
    while len(members) > 1:
        i, j = divmod(int(like.argmax()), n)
        if like[i, j] < least or like[i, j] < 0:
            break
        i, j = min(i, j), max(i, j)
        members[i] += members.pop(j)
        both = np.minimum(like[i], like[j])
        like[i], like[:, i] = both, both
        like[j], like[:, j], like[i, i] = -1.0, -1.0, -1.0
    return [sorted(m) for _, m in sorted(members.items())]


def grouped_link(rows: DataFrame, least: float) -> DataFrame:
    """(grp, member, cluster, size) of rows (grp, member, features): complete-link clusters within each group, named by their least member. A group's members are an alphabet and are held by one task."""

    def solve(pdf):
        pdf = pdf.sort_values("member").reset_index(drop=True)
        out = []
        for m in complete_link([set(x) for x in pdf["features"]], least):
            out += [(pdf["grp"][0], pdf["member"][i], pdf["member"][m[0]], len(m)) for i in m]
        return pdf.__class__(out, columns=["grp", "member", "cluster", "size"])

    return rows.groupBy("grp").applyInPandas(solve, "grp string, member string, cluster string, size int")


@query("form_class_clusters", "N16")
def form_class_clusters(spark, d):
    """Words of part names, a part type at a time, by the words that stand beside them."""
    w = table(spark, d, "part").select(F.col("p_type").alias("grp"), F.split("p_name", " ").alias("w"))
    rows = w.select("grp", F.explode("w").alias("member"), "w").select("grp", "member", F.explode("w").alias("f")).where("f <> member")
    return grouped_link(rows.groupBy("grp", "member").agg(F.array_sort(F.collect_set("f")).alias("features")), 0.5)


def medoid_roles(features, most: int, held):
    """(k, roles, {k: nats}) of rows of 0 and 1: k medoids by Hamming distance, seeded farthest first; k is that whose held-out Bernoulli code plus the code of its parameters is least."""
    x, held = np.asarray(features, float), np.asarray(held, bool)
    fit = x[~held]
    if not len(fit):
        return 1, np.zeros(len(x), int), {1: 0.0}
    apart = np.abs(fit[:, None] - fit[None]).sum(2)
    cost, best = {}, None
    for k in range(1, min(most, len(np.unique(fit, axis=0))) + 1):
        heads = [int(apart.sum(1).argmin())]
        while len(heads) < k:
            heads.append(int(apart[:, heads].min(1).argmax()))
        for _ in range(30):
            at = apart[:, heads].argmin(1)
            after = [int(np.flatnonzero(at == j)[apart[np.ix_(at == j, at == j)].sum(1).argmin()]) for j in range(k)]
            if after == heads:
                break
            heads = after
        at = apart[:, heads].argmin(1)
        p = np.array([(fit[at == j].sum(0) + 0.5) / ((at == j).sum() + 1) for j in range(k)])
        prior = np.array([(at == j).sum() for j in range(k)]) / len(fit)
        score = x @ np.log(p).T + (1 - x) @ np.log(1 - p).T + np.log(prior)
        top = score.max(1)
        nats = -(top + np.log(np.exp(score - top[:, None]).sum(1)))
        cost[k] = float(nats[held].sum() + 0.5 * k * x.shape[1] * math.log(max(2, len(fit))))
        if best is None or cost[k] < cost[best[0]] - 1e-9:
            best = (k, score.argmax(1))
    return best[0], best[1], cost


@query("opaque_roles", "N17")
def opaque_roles(spark, d):
    """Roles of part names' words, a part type at a time, from the brands they occur with: a group's words and brands are alphabets. A quarter of the words, drawn by hash, is held out."""

    def solve(pdf):
        from zlib import crc32

        words, brands = sorted(set(pdf["word"])), sorted(set(pdf["brand"]))
        usual = pdf.groupby("brand")["n"].sum() / pdf["n"].sum()
        x = np.zeros((len(words), len(brands)))
        for word, rows in pdf.groupby("word"):
            share = rows["n"].sum()
            for r in rows.itertuples():
                x[words.index(word), brands.index(r.brand)] = r.n > share * usual[r.brand]
        k, roles, cost = medoid_roles(x, 6, [crc32(w.encode()) % 4 == 0 for w in words])
        return pdf.__class__([(pdf["grp"].iloc[0], w, int(r), k, round(cost[k], 6)) for w, r in zip(words, roles, strict=True)], columns=["grp", "word", "role", "roles", "nats"])

    w = table(spark, d, "part").select(F.col("p_type").alias("grp"), F.col("p_brand").alias("brand"), F.explode(F.split("p_name", " ")).alias("word"))
    return w.groupBy("grp", "brand", "word").agg(F.count("*").alias("n")).groupBy("grp").applyInPandas(solve, "grp string, word string, role int, roles int, nats double")


def drift(rows: DataFrame, key: str, at: str, least_drift: float = 0.02, floor: float = 0.92, margin: float = 0.15) -> DataFrame:
    """rows (key, at, mass: array) with drift, entropy, margin and state against the key's row before it: masses are normalised (even where they sum to 0); entropy is over its largest value; a drift within bounds is a plateau where the entropy is near its largest, else converged."""
    total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    even = F.transform("mass", lambda x: F.lit(1.0) / F.size("mass"))
    share = rows.withColumn("q", F.when(total > 0, F.transform("mass", lambda x: x / total)).otherwise(even))
    share = share.withColumn("p", F.lag("q").over(Window.partitionBy(key).orderBy(at))).where("p IS NOT NULL")
    l1 = F.aggregate(F.zip_with("p", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate("q", F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    out = share.select(key, at, F.round(l1, 6).alias("drift"), F.round(bits / F.log2(F.greatest(F.lit(2), F.size("q"))), 6).alias("entropy")).withColumn("margin", F.round(margin - F.col("drift"), 6))
    low = F.col("drift") <= least_drift
    state = F.when(low & (F.col("entropy") >= floor), "plateau").when(low & (F.col("margin") >= 0), "converged").otherwise("moving")
    return out.withColumn("state", state)


_KINDS = ["click", "error", "purchase", "signup", "view"]
_MASS = ", ".join(f"count(*) FILTER (event_type = '{k}')::DOUBLE" for k in _KINDS)


@query(
    "subspace_drift",
    "T14",
    f"""WITH m AS (SELECT user_id, day, CASE WHEN list_sum(mass) > 0 THEN list_transform(mass, lambda x: x / list_sum(mass)) ELSE [0.2, 0.2, 0.2, 0.2, 0.2] END AS q FROM (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS day, [{_MASS}] AS mass FROM events GROUP BY 1, 2)), l AS (SELECT *, lag(q) OVER (PARTITION BY user_id ORDER BY day) AS p FROM m),
v AS (SELECT user_id, day, round(list_sum(list_transform(range(1, 6), lambda i: abs(p[i] - q[i]))), 6) AS drift, round(-list_sum(list_transform(q, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0.0 END)) / log2(5), 6) AS entropy FROM l WHERE p IS NOT NULL)
SELECT user_id, day, drift, entropy, round(0.15 - drift, 6) AS margin, CASE WHEN drift <= 0.02 AND entropy >= 0.92 THEN 'plateau' WHEN drift <= 0.02 THEN 'converged' ELSE 'moving' END AS state FROM v""",
)
def subspace_drift(spark, d):
    mass = F.array(*[F.count_if(F.col("event_type") == k).cast("double") for k in _KINDS])
    weeks = table(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("day")).agg(mass.alias("mass"))
    return drift(weeks, "user_id", "day")


@query(
    "stable_support",
    "T14",
    """WITH s AS (SELECT event_type, user_id % 20 AS cohort, count(*) AS n, avg(least(1, greatest(0, value / 100))) AS mean, stddev_pop(value) / nullif(stddev_pop(value) + abs(avg(value)), 0) AS sin FROM events GROUP BY 1, 2),
b AS (SELECT *, greatest(0, least(1, mean - sqrt(ln(1 / 0.05) / (2 * n)))) AS lcb, greatest(0, least(1, coalesce(sin, 0))) AS penalty FROM s)
SELECT event_type, cohort, round(lcb, 6) AS lcb, round(penalty, 6) AS penalty, round(greatest(0, mean - 0.1 * penalty), 6) AS adjusted, lcb >= 0.35 AND greatest(0, mean - 0.1 * penalty) >= 0.08 AS accepted FROM b""",
)
def stable_support(spark, d):
    """Support that holds at its Hoeffding bound and after a penalty for how far its samples turn."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    s = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 20).alias("cohort")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.try_divide(F.stddev_pop("value"), F.stddev_pop("value") + F.abs(F.avg("value"))).alias("sin"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    b = s.select("event_type", "cohort", "mean", unit(F.col("mean") - F.sqrt(F.log(F.lit(1 / 0.05)) / (2 * F.col("n")))).alias("lcb"), unit(F.coalesce("sin", F.lit(0.0))).alias("penalty"))
    adjusted = F.greatest(F.lit(0.0), F.col("mean") - 0.1 * F.col("penalty"))
    return b.select("event_type", "cohort", F.round("lcb", 6).alias("lcb"), F.round("penalty", 6).alias("penalty"), F.round(adjusted, 6).alias("adjusted"), ((F.col("lcb") >= 0.35) & (adjusted >= 0.08)).alias("accepted"))
