"""Shared pieces: tables, words, shared scratch storage, hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: The six white-space characters that part words, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive lost executors. drop() removes what no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/quarry-{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        self.names.add(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def only(self, *names: str) -> None:
        """Remove all tables but these."""
        self.drop(*(self.names - set(names)))

    def drop(self, *names: str) -> None:
        self.names -= set(names)
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished steps, which it does once their plans are collected."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Array of the words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of all runs of k consecutive words in three passes, whatever k is: a polynomial in an odd base modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))

        def grow(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.down = grow(self.base), grow(self.inverse)

    def __call__(self, h: np.ndarray, k: int) -> np.ndarray:
        n = len(h)
        if n < k:
            return np.empty(0, np.uint64)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.up[:n], out=sums[1:])
        return mix64((sums[k:] - sums[:-k]) * self.down[: n - k + 1])


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b).

    Large-star and small-star rounds: each node hands its neighbours to the smallest one, so hubs never gather
    in a task (only minima are aggregated, map side first) and paths shorten by a factor each round. Stops when nothing changes.
    """
    spark = scratch.spark
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    for i in range(1, rounds + 1):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that the join deals out both sides itself and can split a hub's rows
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")), f"{name}-least")
        # large star: neighbours above a node join its minimum
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node join the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        after = scratch.keep(small, f"{name}-{i}")
        same = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect() == after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()
        scratch.drop(f"{name}-{i - 1}", f"{name}-least")
        now = after
        if same:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
