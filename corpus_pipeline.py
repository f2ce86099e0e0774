"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame; run() writes it as
Parquet and reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, mixing, packing, quality_classifier, substring_dedup
from quarry.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled ones among them, does not reject."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model).where("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that links of five-word shingles at 0.8 or more connect, and of rows that repeat a doc_id the one with the least text; rows without doc_id stay."""
    scratch = Scratch(spark, "stage-join")
    groups = jaccard_join.join(spark, docs, k=5, percent=80, scratch=scratch).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    groups = scratch.keep(groups, "kept")
    scratch.only("kept")
    kept = docs.where("doc_id IS NOT NULL").join(groups, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    return kept.withColumn("_first", first).where("_first = 1").drop("_first").unionByName(docs.where("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated 35-word windows cover, n_chars to match; documents that lose all their words go."""
    scratch = Scratch(spark, "stage-substring")
    left = substring_dedup.remove_repeats(spark, docs, scratch=scratch).where("n_removed < n_words OR n_words = 0")
    left = left.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("text").alias("_text")).dropDuplicates(["_id", "_h"])
    rest = docs.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text")
    joined = rest.join(left, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_h")))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes their documents."""
    return mixing.repeat_to_targets(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2,048 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: The stages fit a model, follow links to their ends and pack by differencing: SQL can't express their rows. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{i}")
    return docs
