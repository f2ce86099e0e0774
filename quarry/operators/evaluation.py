"""Calibration, scoring and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.quantiles import quantiles
from quarry.plans.registry import query, table

_PRED = r"""WITH p AS (SELECT doc_id, source, quality AS y, least(greatest(length(regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g')) / greatest(length(coalesce(text, '')), 1)::DOUBLE, 0), 1) AS p FROM documents JOIN labels USING (doc_id))"""


def predictions(spark, d) -> DataFrame:
    """(doc_id, source, y, p): quality against the share of lower-case letters and spaces."""
    text = F.coalesce("text", F.lit(""))
    p = F.length(F.regexp_replace(text, "[^a-z ]", "")) / F.greatest(F.length(text), F.lit(1))
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("quality").alias("y"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))


def bins(p: Column, n: int) -> Column:
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")


@query("calibration_bins", "M01 P07", _PRED + " SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS actual FROM p GROUP BY 1")
def calibration_bins(spark, d):
    return predictions(spark, d).groupBy(bins(F.col("p"), 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("actual"))


@query(
    "brier_nll_ece",
    "M02",
    _PRED + ", b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM p GROUP BY 1) SELECT (SELECT round(avg(pow(p - y, 2)), 6) FROM p) AS brier, (SELECT round(avg(-ln(CASE WHEN y = 1 THEN greatest(p, 1e-12) ELSE greatest(1 - p, 1e-12) END)), 6) FROM p) AS nll, (SELECT round(sum(n * gap) / sum(n), 6) FROM b) AS ece",
)
def brier_nll_ece(spark, d):
    return scores(predictions(spark, d))


def scores(rows: DataFrame, n: int = 10) -> DataFrame:
    """Brier score, mean negative log likelihood and expected calibration error of (y, p), from one pass of sums by bin."""
    p, y = F.col("p"), F.col("y")
    nll = -F.log(F.when(y == 1, F.greatest(p, F.lit(1e-12))).otherwise(F.greatest(1 - p, F.lit(1e-12))))
    b = rows.groupBy(bins(p, n).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.pow(p - y, 2)).alias("b"), F.sum(nll).alias("l"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    total = F.sum("n")
    return b.agg(F.round(F.sum("b") / total, 6).alias("brier"), F.round(F.sum("l") / total, 6).alias("nll"), F.round(F.sum(F.col("n") * F.col("gap")) / total, 6).alias("ece"))


@query(
    "group_disjoint_holdout",
    "M03 L11 M01",
    _PRED
    + """, s AS (SELECT *, ('0x' || substr(sha256(source), 1, 8))::BIGINT < 1288490188 AS held FROM p WHERE source IS NOT NULL), m AS (SELECT least(floor(p * 5), 4) AS bin, avg(y) AS c FROM s WHERE NOT held GROUP BY 1)
SELECT held, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS before, round(avg(pow(coalesce(c, p) - y, 2)), 6) AS after FROM s LEFT JOIN m ON least(floor(p * 5), 4) = bin GROUP BY held""",
)
def group_disjoint_holdout(spark, d):
    draw = F.conv(F.substring(F.sha2("source", 256), 1, 8), 16, 10).cast("long")
    rows = predictions(spark, d).where("source IS NOT NULL").withColumn("held", draw < 1288490188).withColumn("bin", bins(F.col("p"), 5))
    model = rows.where("NOT held").groupBy("bin").agg(F.avg("y").alias("c"))
    fixed = rows.join(F.broadcast(model), "bin", "left")  # five rows
    return fixed.groupBy("held").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("before"), F.round(F.avg(F.pow(F.coalesce("c", "p") - F.col("y"), 2)), 6).alias("after"))


@query(
    "objective_scores",
    "M08 M09 A27",
    """WITH a AS (SELECT c.conv_id, c.role, coalesce(c.text, '') AS text, c.turn FROM conversations c), s AS (SELECT role, lower(text) LIKE '%the%' AS required, text NOT LIKE '%|%' AS clean, length(trim(text)) = 0 AS abstained FROM a)
SELECT role, count(*) AS n, round(avg(required::INTEGER), 6) AS required, round(avg(clean::INTEGER), 6) AS clean, round(avg((required AND clean AND NOT abstained)::INTEGER), 6) AS passed FROM s GROUP BY role""",
)
def objective_scores(spark, d):
    text = F.coalesce("text", F.lit(""))
    s = table(spark, d, "conversations").select("role", F.lower(text).contains("the").alias("required"), (~text.contains("|")).alias("clean"), (F.length(F.trim(text)) == 0).alias("abstained"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return s.groupBy("role").agg(F.count("*").alias("n"), share(F.col("required")).alias("required"), share(F.col("clean")).alias("clean"), share(F.col("required") & F.col("clean") & ~F.col("abstained")).alias("passed"))


@query(
    "cloze_questions",
    "M10",
    r"""WITH s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[.!?\n]+'), lambda x: len(regexp_extract_all(x, '[A-Z][a-z]{4,}')) > 0)) AS sentence FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, sentence, regexp_extract(sentence, '[A-Z][a-z]{4,}') AS answer FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(doc_id || ':' || sentence), sentence) AS r FROM q)
SELECT doc_id, answer, md5(replace(sentence, answer, '____')) AS question, strpos(sentence, answer)::INTEGER AS place FROM k WHERE r = 1""",
)
def cloze_questions(spark, d):
    named = r"[A-Z][a-z]{4,}"
    s = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence")).where(F.col("sentence").rlike(named))
    s = s.withColumn("answer", F.regexp_extract("sentence", named, 0))
    first = F.min_by(F.struct("sentence", "answer"), F.struct(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("sentence")), 256), F.col("sentence")))
    q = s.groupBy("doc_id").agg(first.alias("q"))
    return q.select("doc_id", "q.answer", F.md5(F.replace(F.col("q.sentence"), F.col("q.answer"), F.lit("____"))).alias("question"), F.position(F.col("q.answer"), F.col("q.sentence")).alias("place"))


@query("release_gate", "M11 K06", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, count(*) >= 50 AND avg(value) BETWEEN 5 AND 500 AS released FROM events GROUP BY 1")
def release_gate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), ((F.count("*") >= 50) & F.avg("value").between(5, 500)).alias("released"))


@query("pairwise_summary", "M12", "WITH p AS (SELECT l_suppkey, CASE WHEN l_discount > l_tax THEN 'left' WHEN l_discount < l_tax THEN 'right' ELSE 'tie' END AS verdict FROM lineitem) SELECT l_suppkey, count(*) FILTER (verdict = 'left') AS wins, count(*) FILTER (verdict = 'right') AS losses, count(*) FILTER (verdict = 'tie') AS ties, round((count(*) FILTER (verdict = 'left') + 0.5 * count(*) FILTER (verdict = 'tie')) / count(*)::DOUBLE, 6) AS rate FROM p GROUP BY 1")
def pairwise_summary(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(a > b).alias("wins"), F.count_if(a < b).alias("losses"), F.count_if(a == b).alias("ties"), F.round((F.count_if(a > b) + 0.5 * F.count_if(a == b)) / F.count("*"), 6).alias("rate"))


@query("latency_percentiles", "M14 S27", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    q = quantiles(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])
    return q.select("event_type", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


@query(
    "ranking_metrics",
    "R13",
    """WITH r AS (SELECT source, quality AS rel, row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id) AS k, sum(quality) OVER (PARTITION BY source) AS total FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL)
SELECT source, round(sum(CASE WHEN k <= 10 THEN rel ELSE 0 END) / nullif(max(total), 0)::DOUBLE, 6) AS recall_10, round(sum(CASE WHEN k <= 10 THEN rel / log2(k + 1) ELSE 0 END), 6) AS dcg_10 FROM r GROUP BY source""",
)
def ranking_metrics(spark, d):
    rows = table(spark, d, "documents").where("source IS NOT NULL").join(table(spark, d, "labels"), "doc_id")
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "doc_id"))
    top = rows.select("source", F.col("quality").alias("rel"), k.alias("k"))
    return top.groupBy("source").agg(F.round(F.try_divide(F.sum(F.when(F.col("k") <= 10, F.col("rel")).otherwise(0)), F.sum("rel")), 6).alias("recall_10"), F.round(F.sum(F.when(F.col("k") <= 10, F.col("rel") / F.log2(F.col("k") + 1)).otherwise(0.0)), 6).alias("dcg_10"))


@query("relation_potential_fit", "M04 M05")
def relation_potential_fit(spark, d):
    """Logistic fit of quality on text rates with weights kept at or above zero, by MLlib; one row a weight."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices, Vectors

    n = F.greatest(F.length("text"), F.lit(1))
    rows = table(spark, d, "documents").where("text IS NOT NULL").join(table(spark, d, "labels"), "doc_id")
    rows = rows.select(F.col("quality").cast("double").alias("label"), (F.regexp_count("text", F.lit("[a-z]")) / n).alias("lower"), (F.regexp_count("text", F.lit("[.,]")) / n).alias("marks"))
    ready = VectorAssembler(inputCols=["lower", "marks"], outputCol="features").transform(rows)
    fit = LogisticRegression(maxIter=30, regParam=0.01, lowerBoundsOnCoefficients=Matrices.dense(1, 2, [0.0, 0.0]), lowerBoundsOnIntercepts=Vectors.dense([-100.0])).fit(ready)
    return spark.createDataFrame([("intercept", float(fit.intercept)), ("lower", float(fit.coefficients[0])), ("marks", float(fit.coefficients[1]))], "feature string, weight double")
