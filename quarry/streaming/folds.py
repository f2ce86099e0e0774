"""Structured Streaming: the same transformations over a stream of files as over a table, with watermarks, windows and state.

replay() drives a file stream to its end (availableNow) and returns what its sink holds, so a stream can be held against the batch.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, table


def shared_folder(spark: SparkSession) -> str:
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="quarry-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream over one table; the schema is the table's own, with zone-less times as times of the session's zone, as watermarks need."""
    schema = table(spark, sf_dir, name).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(os.path.join(sf_dir, f"{name}.parquet*"))
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def replay(df: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run the stream to the end of what is there. Append mode goes to a Parquet sink with exactly-once commits; complete mode keeps the last batch."""
    spark = df.sparkSession
    at = shared_folder(spark)
    out = transform(df)
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    else:
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def windowed_counts(events: DataFrame) -> DataFrame:
    """Counts and sums by hour and type. In append mode a window comes out once no row for it can follow, rows more than two days late are dropped and state ends with its window; complete mode keeps every window."""
    w = events.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("stream_window_counts", "ST12 ST08 ST01", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    return replay(stream(spark, d, "events"), windowed_counts, "complete")


@query(
    "stream_closed_windows",
    "ST12 ST01",
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
)
def stream_closed_windows(spark, d):
    return replay(stream(spark, d, "events"), windowed_counts, "append")


@query(
    "session_windows",
    "ST12",
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s",
)
def session_windows(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


@query("stream_running_mean", "A15 A16 ST08", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def stream_running_mean(spark, d):
    return replay(stream(spark, d, "events"), lambda e: e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")), "complete")


@query("stream_dedupe", "K01 ST03", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def stream_dedupe(spark, d):
    """Insert-ignore in a stream: each event id once within the watermark."""
    return replay(stream(spark, d, "events"), lambda e: e.where("event_type = 'purchase'").withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"))


def ftrl(rows, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.1, l2: float = 1.0) -> dict:
    """FTRL-Proximal logistic weights after (features, label) rows in order."""
    import math

    z, n = {}, {}

    def weight(f):
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for features, label in rows:
        p = 1 / (1 + math.exp(-max(-30, min(30, sum(weight(f) * x for f, x in features)))))
        for f, x in features:
            g = (p - label) * x
            s = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
            z[f] = z.get(f, 0.0) + g - s * weight(f)
            n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z}


@query("ftrl_ranker", "R12 R13 ST07")
def ftrl_ranker(spark, d):
    """One learner a group of users (user_id mod 8), fed events in order: does the next event follow from type and hour? State is a few weights a learner."""

    def learn(pdf):
        pdf = pdf.sort_values(["ts", "event_id"])
        rows = (([("type=" + r.event_type, 1.0), (f"hour={r.ts.hour // 6}", 1.0), ("bias", 1.0)], float(r.value > 50)) for r in pdf.itertuples())
        w = ftrl(rows)
        return pdf.__class__([(pdf["learner"].iloc[0], f, round(v, 6)) for f, v in sorted(w.items())], columns=["learner", "feature", "weight"])

    rows = table(spark, d, "events").select((F.col("user_id") % 8).alias("learner"), "ts", "event_id", "event_type", "value")
    return rows.groupBy("learner").applyInPandas(learn, "learner long, feature string, weight double")


@query("task_frames", "ST07", "SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq FROM events) WHERE seq > 50")
def task_frames(spark, d):
    """Frames after the fiftieth of each task, in sequence."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", seq.alias("seq")).where("seq > 50")
