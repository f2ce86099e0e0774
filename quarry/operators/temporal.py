"""Intervals, as-of beliefs, event ledgers, sequences and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, table

_IV = "iv AS (SELECT * FROM (SELECT event_id AS id, user_id, event_type, ts AS s, lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events) WHERE e > s)"


def intervals(events: DataFrame) -> DataFrame:
    """(id, user_id, event_type, s, e): from each event to the second one after it, so that neighbours overlap; empty ones go."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("s"), F.lead("ts", 2).over(w).alias("e")).where("e > s")


def overlapping(rows: DataFrame, key: str, bin_seconds: int) -> DataFrame:
    """Pairs of intervals of a key that share time. Each is put in every bin it touches; a pair is made in the bin where the later one starts, so no key is compared as a whole."""
    number = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bin_seconds)
    binned = rows.withColumn("bin", F.explode(F.sequence(number("s"), number("e"))))
    a = binned.select(key, "bin", F.col("id").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = binned.select(key, "bin", F.col("id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return a.join(b, [key, "bin"]).where((F.col("a") < F.col("b")) & (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")) & (F.col("bin") == F.greatest(number("s1"), number("s2")))).drop("bin")


@query("interval_conflicts", "J14", f"WITH {_IV} SELECT x.user_id, x.id AS a, y.id AS b FROM iv x JOIN iv y ON x.user_id = y.user_id AND x.id < y.id AND x.s < y.e AND y.s < x.e WHERE x.event_type <> y.event_type")
def interval_conflicts(spark, d):
    rows = intervals(table(spark, d, "events"))
    kinds = rows.select("id", "event_type")
    pairs = overlapping(rows, "user_id", 6 * 3600).select("user_id", "a", "b")
    return pairs.join(kinds.toDF("a", "ka"), "a").join(kinds.toDF("b", "kb"), "b").where("ka <> kb").select("user_id", "a", "b")


#: Allen's relations of [s1, e1] to [s2, e2], in the order in which they are tested.
ALLEN = [("equals", "s1 = s2 AND e1 = e2"), ("before", "e1 < s2"), ("meets", "e1 = s2"), ("after", "s1 > e2"), ("met_by", "s1 = e2"), ("starts", "s1 = s2 AND e1 < e2"), ("started_by", "s1 = s2 AND e1 > e2"), ("finishes", "e1 = e2 AND s1 > s2"), ("finished_by", "e1 = e2 AND s1 < s2"), ("during", "s1 > s2 AND e1 < e2"), ("contains", "s1 < s2 AND e1 > e2"), ("overlaps", "s1 < s2 AND e1 < e2"), ("overlapped_by", "s1 > s2 AND e1 > e2")]
_ALLEN = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in ALLEN) + " END"


@query("allen_matrix", "J15", f"WITH {_IV}, p AS (SELECT x.s AS s1, x.e AS e1, y.s AS s2, y.e AS e2 FROM iv x JOIN iv y ON x.user_id = y.user_id AND x.id <> y.id) SELECT {_ALLEN} AS relation, count(*) AS n FROM p GROUP BY 1")
def allen_matrix(spark, d):
    return allen(intervals(table(spark, d, "events")), 6 * 3600)


def allen(iv: DataFrame, bin_seconds: int) -> DataFrame:
    """(relation, n) over the ordered pairs of a user's intervals. Pairs apart are counted by running sums over starts and ends; only those that touch are joined, in the bin where the later one starts."""
    marks = iv.select("user_id", F.col("e").alias("t"), F.lit(1).alias("ends")).unionByName(iv.select("user_id", F.col("s").alias("t"), F.lit(0).alias("ends")))
    # starts come first among equal times: an end at a start meets it and is not before it
    ended = F.sum("ends").over(Window.partitionBy("user_id").orderBy("t", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    apart = marks.withColumn("n", ended).where("ends = 0").agg(F.sum("n").alias("n"))
    apart = apart.select(F.explode(F.array(F.lit("before"), F.lit("after"))).alias("relation"), "n").where("n > 0")
    number = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bin_seconds)
    binned = iv.withColumn("bin", F.explode(F.sequence(number("s"), number("e"))))
    side = lambda i, k: binned.select("user_id", "bin", F.col("id").alias(i), F.col("s").alias(f"s{k}"), F.col("e").alias(f"e{k}"))
    touch = side("a", 1).join(side("b", 2), ["user_id", "bin"]).where((F.col("a") != F.col("b")) & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")) & (F.col("bin") == F.greatest(number("s1"), number("s2"))))
    return touch.groupBy(F.expr(_ALLEN).alias("relation")).agg(F.count("*").alias("n")).unionByName(apart)


@query("beliefs_as_of", "J16 F13", "WITH v AS (SELECT user_id, event_id, event_type, ts AS recorded, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded FROM events) SELECT user_id, event_type, event_id FROM v WHERE recorded <= TIMESTAMP '2024-01-15' AND (superseded IS NULL OR superseded > TIMESTAMP '2024-01-15')")
def beliefs_as_of(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    v = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("recorded"), F.lead("ts").over(w).alias("superseded"))
    return as_of(v, F.expr("TIMESTAMP_NTZ '2024-01-15'")).select("user_id", "event_type", "event_id")


def as_of(versions: DataFrame, t: Column) -> DataFrame:
    """What was recorded by t and not superseded by then."""
    return versions.where((F.col("recorded") <= t) & (F.col("superseded").isNull() | (F.col("superseded") > t)))


@query("asof_join", "J16 J17", "SELECT o.o_orderkey, e.event_id FROM orders o ASOF LEFT JOIN (SELECT user_id, (ts - INTERVAL 9855 DAY) AS t, max(event_id) AS event_id FROM events GROUP BY 1, 2) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.t")
def asof_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderkey"), F.lit(None).cast("long").alias("event_id"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.expr("ts - INTERVAL 9855 DAY").alias("t")).agg(F.max("event_id").alias("event_id")).select("k", "t", F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    return latest_before(orders, events, "k", "t", "o_orderkey", "event_id")


def latest_before(left: DataFrame, right: DataFrame, key: str, time: str, name: str, value: str) -> DataFrame:
    """As-of join in one sort: both sides are put in order of time within their key and the last value is carried forward."""
    w = Window.partitionBy(key).orderBy(time, F.col(name).isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return left.unionByName(right).withColumn("_v", F.last(value, ignorenulls=True).over(w)).where(F.col(name).isNotNull()).select(name, F.col("_v").alias(value))


@query("event_replay", "ST06 A14", "SELECT user_id, event_type, max_by(value, {'ts': ts, 'id': event_id}) AS value, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def event_replay(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("last_ts"))


def ledger(events: DataFrame, key: str) -> DataFrame:
    """(key, n, head): hash chain of a key's events in order of (ts, id): each link hashes the one before and the event. A chain is as long as its key's history."""
    own = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", own.alias("h")))).alias("e"))
    head = F.aggregate("e", F.lit("genesis"), lambda prev, x: F.sha2(F.concat(prev, x["h"]), 256))
    return rows.select(key, F.size("e").cast("long").alias("n"), head.alias("head"))


@query(
    "ledger_chain",
    "ST03",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, sha256(event_id || '|' || event_type) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT user_id, i, n, sha256('genesis' || h) AS head FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.n, sha256(c.head || o.h) FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1) SELECT user_id, n, head FROM c WHERE i = n""",
)
def ledger_chain(spark, d):
    return ledger(table(spark, d, "events"), "user_id")


@query("resume_offsets", "ST02 ST01", "WITH b AS (SELECT user_id, event_id, event_type <> 'refund' AND value < 400 AS stored, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, coalesce(min(i) FILTER (NOT stored), max(i) + 1) AS stop FROM b GROUP BY 1) SELECT user_id, (stop - 1)::INTEGER AS resume_after FROM f")
def resume_offsets(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stored = (F.col("event_type") != "refund") & (F.col("value") < 400)
    b = table(spark, d, "events").select("user_id", stored.alias("stored"), F.row_number().over(w).alias("i"))
    return b.groupBy("user_id").agg((F.coalesce(F.min(F.when(~F.col("stored"), F.col("i"))), F.max("i") + 1) - 1).alias("resume_after"))


@query("live_entries", "ST10 ST07", "SELECT user_id, event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-20'")
def live_entries(spark, d):
    return table(spark, d, "events").where("ts > TIMESTAMP_NTZ '2024-01-20' - INTERVAL 2 DAY AND ts <= TIMESTAMP_NTZ '2024-01-20'").select("user_id", "event_id")


def action_runs(events: DataFrame, n: int) -> DataFrame:
    """(user_id, pattern): distinct runs of n event types in a user's order."""
    rows = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e")).select("user_id", F.transform("e", lambda x: x["event_type"]).alias("w"))
    at = F.sequence(F.lit(1), F.size("w") - n + 1)
    return rows.where(F.size("w") >= n).select("user_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.concat_ws(">", F.slice("w", i, F.lit(n)))))).alias("pattern"))


_RUNS = "o AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS w FROM events GROUP BY 1), r AS (SELECT DISTINCT user_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i+2], '>'))) AS pattern FROM o WHERE len(w) >= 3)"


@query("sequence_patterns", "A25", f"WITH {_RUNS} SELECT pattern, count(*) AS support, (count(*) - 1) * 2 AS saved FROM r GROUP BY 1 HAVING count(*) >= 3")
def sequence_patterns(spark, d):
    return action_runs(table(spark, d, "events"), 3).groupBy("pattern").agg(F.count("*").alias("support"), ((F.count("*") - 1) * 2).alias("saved")).where("support >= 3")


@query("pattern_lift", "A26", f"WITH {_RUNS}, s AS (SELECT user_id, max((event_type = 'purchase' AND value > 50)::INTEGER) AS won FROM events GROUP BY 1), t AS (SELECT sum(won) AS w, count(*) AS n FROM s), p AS (SELECT pattern, count(*) AS n1, sum(won) AS w1 FROM r JOIN s USING (user_id) GROUP BY 1) SELECT pattern, n1, round(w1 / n1::DOUBLE - coalesce((w - w1) / nullif(n - n1, 0)::DOUBLE, 0), 6) AS lift FROM p, t")
def pattern_lift(spark, d):
    events = table(spark, d, "events")
    s = events.groupBy("user_id").agg(F.max(((F.col("event_type") == "purchase") & (F.col("value") > 50)).cast("int")).alias("won"))
    t = F.broadcast(s.agg(F.sum("won").alias("w"), F.count("*").alias("n")))
    p = action_runs(events, 3).join(s, "user_id").groupBy("pattern").agg(F.count("*").alias("n1"), F.sum("won").alias("w1")).crossJoin(t)
    return p.select("pattern", "n1", F.round(F.col("w1") / F.col("n1") - F.coalesce(F.try_divide(F.col("w") - F.col("w1"), F.col("n") - F.col("n1")), F.lit(0.0)), 6).alias("lift"))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


_DAILY = "dd AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2)"


@query("lag_features", "W06", f"WITH {_DAILY} SELECT event_type, day, round(v - lag(v) OVER w, 4) AS d1, round(v - lag(v, 2) OVER w, 4) AS d2 FROM dd WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def lag_features(spark, d):
    w = Window.partitionBy("event_type").orderBy("day")
    return daily(table(spark, d, "events")).select("event_type", "day", *[F.round(F.col("v") - F.lag("v", k).over(w), 4).alias(f"d{k}") for k in (1, 2)])


@query("autocorrelation", "W07", f"WITH {_DAILY}, c AS (SELECT event_type, v - avg(v) OVER (PARTITION BY event_type) AS x, day FROM dd), l AS (SELECT event_type, x, lag(x) OVER (PARTITION BY event_type ORDER BY day) AS p FROM c) SELECT event_type, round(sum(x * p) / sum(x * x), 6) AS r1, round(avg(abs(x - p)), 4) AS drift FROM l GROUP BY 1")
def autocorrelation(spark, d):
    c = daily(table(spark, d, "events")).withColumn("x", F.col("v") - F.avg("v").over(Window.partitionBy("event_type")))
    l = c.withColumn("p", F.lag("x").over(Window.partitionBy("event_type").orderBy("day")))
    return l.groupBy("event_type").agg(F.round(F.sum(F.col("x") * F.col("p")) / F.sum(F.col("x") * F.col("x")), 6).alias("r1"), F.round(F.avg(F.abs(F.col("x") - F.col("p"))), 4).alias("drift"))


@query("rank_bins", "W08 T04", f"WITH {_DAILY}, r AS (SELECT event_type, day, count(*) OVER (PARTITION BY event_type ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM dd) SELECT event_type, day, least(floor(r / n::DOUBLE * 4), 3)::INTEGER AS bin FROM r")
def rank_bins(spark, d):
    return binned(daily(table(spark, d, "events")), 4)


def binned(series: DataFrame, n: int) -> DataFrame:
    """Bins by upper rank: ties share a bin."""
    up = F.count("*").over(Window.partitionBy("event_type").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return series.select("event_type", "day", F.least(F.floor(up / F.count("*").over(Window.partitionBy("event_type")) * n), F.lit(n - 1)).cast("int").alias("bin"))


@query(
    "transfer_entropy",
    "T04 T06",
    f"""WITH {_DAILY}, r AS (SELECT event_type, day, count(*) OVER (PARTITION BY event_type ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM dd), b AS (SELECT event_type, day, least(floor(r / n::DOUBLE * 4), 3)::INTEGER AS bin FROM r),
s AS (SELECT event_type, bin, lead(bin) OVER (PARTITION BY event_type ORDER BY day) AS nxt, day FROM b), t AS (SELECT x.event_type AS cause, y.event_type AS effect, x.bin AS x, y.bin AS y, y.nxt AS z FROM s x JOIN s y ON x.day = y.day AND x.event_type <> y.event_type WHERE y.nxt IS NOT NULL),
c AS (SELECT cause, effect, x, y, z, count(*)::DOUBLE AS n FROM t GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY cause, effect) AS tt, sum(n) OVER (PARTITION BY cause, effect, x, y) AS xy, sum(n) OVER (PARTITION BY cause, effect, y, z) AS yz, sum(n) OVER (PARTITION BY cause, effect, y) AS yy FROM c)
SELECT cause, effect, round(sum(n / tt * log2(n * yy / (xy * yz))), 6) AS bits FROM w GROUP BY 1, 2""",
)
def transfer_entropy(spark, d):
    b = binned(daily(table(spark, d, "events")), 4)
    s = b.withColumn("nxt", F.lead("bin").over(Window.partitionBy("event_type").orderBy("day")))
    x, y = s.select("day", F.col("event_type").alias("cause"), F.col("bin").alias("x")), s.where("nxt IS NOT NULL").select("day", F.col("event_type").alias("effect"), F.col("bin").alias("y"), F.col("nxt").alias("z"))
    c = x.join(y, "day").where("cause <> effect").groupBy("cause", "effect", "x", "y", "z").agg(F.count("*").cast("double").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("cause", "effect", *k))
    w = c.select("cause", "effect", "n", over().alias("t"), over("x", "y").alias("xy"), over("y", "z").alias("yz"), over("y").alias("yy"))
    return w.groupBy("cause", "effect").agg(F.round(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("yy") / (F.col("xy") * F.col("yz")))), 6).alias("bits"))


def f_survival(f: float, d1: int, d2: int) -> float:
    """P(F > f) by the continued fraction of the incomplete beta function."""
    import math

    if f <= 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)

    def fraction(a, b, x):
        c, d, h = 1.0, 1 - (a + b) * x / (a + 1), 1.0
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def granger(cause, effect, lag: int) -> tuple[float, float]:
    """F and its p-value for whether the cause's past helps to predict the effect."""
    import numpy as np

    x, y = np.asarray(cause, float), np.asarray(effect, float)
    n = len(y) - lag
    if n <= 2 * lag + 1:
        return 0.0, 1.0
    past = lambda s: np.stack([s[lag - k : len(s) - k] for k in range(1, lag + 1)], 1)
    small = np.column_stack([np.ones(n), past(y)])
    full = np.column_stack([small, past(x)])
    rss = [float(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum()) for m in (small, full)]
    d2 = n - full.shape[1]
    if rss[1] <= 1e-12 or d2 <= 0:
        return 0.0, 1.0
    f = (rss[0] - rss[1]) / lag / (rss[1] / d2)
    return f, f_survival(f, lag, d2)


def difference(series, most: int = 2, least: float = 0.55):
    """The series differenced until its lag-1 autocorrelation is small, at most so often."""
    import numpy as np

    s, order = np.asarray(series, float), 0
    while order < most and len(s) > 3:
        c = s - s.mean()
        r = abs(float((c[1:] * c[:-1]).sum() / (c @ c))) if c @ c else 0.0
        if 1 - r >= least:
            break
        s, order = np.diff(s), order + 1
    return s, order


@query("granger_bh", "T01 T02 T03 T05 T07")
def granger_bh(spark, d):
    """Granger tests between all pairs of event types' daily series, lag chosen by the smaller AIC, with Benjamini-Hochberg flags; a group is one pair of series."""
    import numpy as np

    series = daily(table(spark, d, "events")).groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s")).select("event_type", F.transform("s", lambda x: x["v"]).alias("v"))
    pairs = series.toDF("cause", "x").join(series.toDF("effect", "y"), F.col("cause") != F.col("effect"))

    def test(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                (x, ox), (y, oy) = difference(r.x), difference(r.y)
                n = min(len(x), len(y))
                x, y = x[-n:], y[-n:]

                def aic(k):
                    m = np.column_stack([np.ones(n - k), *[y[k - j : n - j] for j in range(1, k + 1)]])
                    rss = float(((y[k:] - m @ np.linalg.lstsq(m, y[k:], rcond=None)[0]) ** 2).sum())
                    return (n - k) * np.log(max(rss, 1e-12) / (n - k)) + 2 * (k + 1)

                lag = min((1, 2, 3), key=aic) if n > 10 else 1
                f, p = granger(x, y, lag)
                out.append((r.cause, r.effect, lag, max(ox, oy), round(f, 6), round(p, 6)))
            yield pdf.__class__(out, columns=["cause", "effect", "lag", "differenced", "f", "p"])

    tested = pairs.mapInPandas(test, "cause string, effect string, lag int, differenced int, f double, p double")
    return bh(tested, "p", 0.1)


def bh(rows: DataFrame, p: str, q: float) -> DataFrame:
    """rows with discovery: p is at most the largest p_(k) <= k q / m. One row a test passes through one task."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.orderBy(p))).withColumn("_m", F.count("*").over(Window.partitionBy()))
    line = F.max(F.when(F.col(p) <= F.col("_k") / F.col("_m") * q, F.col(p))).over(Window.partitionBy())
    return ranked.withColumn("discovery", F.coalesce(F.col(p) <= line, F.lit(False))).drop("_k", "_m")


@query("var_forecast", "T08 T13")
def var_forecast(spark, d):
    """One-lag vector autoregression of the event types' daily series and a three-day forecast: a matrix of types by days is all that a group holds."""
    import numpy as np

    def fit(pdf):
        wide = pdf.pivot_table(index="day", columns="event_type", values="v", fill_value=0.0).sort_index()
        y = wide.to_numpy(float)
        m = np.column_stack([np.ones(len(y) - 1), y[:-1]])
        beta = np.linalg.lstsq(m, y[1:], rcond=None)[0]
        at, out = y[-1], []
        for step in range(1, 4):
            at = np.concatenate([[1.0], at]) @ beta
            out += [(k, step, round(float(v), 4)) for k, v in zip(wide.columns, at, strict=True)]
        return pdf.__class__(out, columns=["event_type", "step", "forecast"])

    rows = daily(table(spark, d, "events")).withColumn("all", F.lit(1)).select("all", "event_type", F.col("day").cast("string").alias("day"), "v")
    return rows.groupBy("all").applyInPandas(fit, "event_type string, step int, forecast double")


@query("tree_levels", "", "WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1), r AS (SELECT 1::BIGINT AS node, 0 AS level UNION ALL SELECT e.node, level + 1 FROM r JOIN e ON e.needs = r.node) SELECT node, level FROM r")
def tree_levels(spark, d):
    """Least depth of every part below the first, each hanging below the one of half its number."""
    from quarry.operators.graph import reach

    e = table(spark, d, "part").where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    return reach(e, spark.range(1, 2).toDF("node"))
