"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Word, symbol, line and repetition figures are made for each document; approx_percentile's mergeable summaries give each language
and source the quartiles of its own documents, and a document is rejected by a figure that lies far outside its group's fence.
A sketch of all documents stands in where a group has too few documents, or no spread of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_CHARS, Scratch, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
RATES = ["symbol_rate", "dup_line_rate", "word_length"]
#: A group with fewer documents is judged by the sketch of all: its own quartiles would be those of a handful.
LEAST = 30
#: So many symbols or repeated lines of a document are never counted: one or two are no rate, and most groups' fences are at 0.
SLACK = 2
FENCE = 3.0


def base_figures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    with_words = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_l", lines)
    n = F.size("_w")
    # the hash of the words i..i+4, with its place
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.struct(F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")),
        ),
    )
    by_hash = with_words.withColumn("_s", F.array_sort(windows))
    last = F.size("_s") - 1
    twice = F.filter(
        F.col("_s"),
        lambda x, k: ((k > 0) & (x["h"] == F.get("_s", k - 1)["h"])) | ((k < last) & (x["h"] == F.get("_s", k + 1)["h"])),
    )
    starts = by_hash.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # each repeated window covers its words up to the next repeated window
    covered = F.aggregate(
        F.transform(F.col("_p"), lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return starts.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def limit(c: str, fence: float) -> Column:
    """The fence of figure c, from a group's quartiles c_q and those of all documents, c_all; null where word lengths show no spread."""
    own, pooled, few = F.col(f"{c}_q"), F.col(f"{c}_all"), F.col("n") < LEAST
    upper = F.when(few, pooled[1]).otherwise(own[1])
    spread = F.when(few | (own[1] <= own[0]), pooled[1] - pooled[0]).otherwise(own[1] - own[0])
    return F.when((spread > 0) | F.lit(c != "word_length"), upper + fence * spread)


def judge(spark: SparkSession, docs: DataFrame, fence: float = FENCE, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false where base_failed is, and where a rate lies above its group's upper quartile by more than fence times the
    quartiles' distance, SLACK symbols and SLACK repeated lines set aside. A group's sketch holds those of its documents that
    pass the base rules. The quartiles are those of all groups together for a group of fewer than LEAST documents, the distance
    also where the group's own is 0; word lengths are not judged where that is 0 too. Null languages and sources form groups of their own. Null and empty texts have no words and fail the base rules.
    Equal rows get equal verdicts; an empty table gives no rows; other columns of docs play no part.
    """
    scratch = scratch or Scratch(spark, "rules")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    figures = base_figures(docs.select("doc_id", "lang", "source", "text")).drop("text").withColumn("base_failed", failed)
    figures = (
        figures.withColumn("symbol_rate", F.col("n_symbols") / F.greatest("word_chars", F.lit(1)))
        .withColumn("dup_line_rate", F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))
        .withColumn("word_length", F.col("word_chars") / F.greatest("n_words", F.lit(1)))
    )
    figures = scratch.keep(figures, "figures")
    group = F.struct(F.col("lang").isNull().alias("no_lang"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"))
    figures = figures.withColumn("grp", group)
    passed = figures.where("NOT base_failed")
    sketch = [F.percentile_approx(c, [0.25, 0.75], 1000).alias(f"{c}_q") for c in RATES]
    pooled = passed.agg(*sketch)
    quartiles = passed.groupBy("grp").agg(F.count("*").alias("n"), *sketch).crossJoin(F.broadcast(pooled.toDF(*[f"{c}_all" for c in RATES])))
    limits = scratch.keep(quartiles.select("grp", *[limit(c, fence).alias(f"{c}_limit") for c in RATES]), "limits")
    above = [
        (F.col("n_symbols") - SLACK) / F.greatest("word_chars", F.lit(1)) > F.col("symbol_rate_limit"),
        (F.col("n_dup_lines") - SLACK) / F.greatest("n_lines", F.lit(1)) > F.col("dup_line_rate_limit"),
        F.col("word_length") > F.col("word_length_limit"),
    ]
    odd = F.greatest(*[F.coalesce(x, F.lit(False)).cast("int") for x in above]) > 0
    return figures.join(limits, "grp", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "lang", "source"
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"))
