"""Approximate nearest neighbours by cross-polytope hashing.

Fast pseudo-rotations (random signs, then a Hadamard transform, three times) turn a unit vector; its hash is the axis, with sign,
that lies nearest, or such an axis from each of several rotations where one would leave the buckets too full. Every row is indexed
in all tables; a query probes the few nearest axes of each table, and what those buckets hold is ranked by the exact inner product.
How many are probed is fitted, by one rule at every size: a bounded sample of the queries is answered by brute force, and the
fewest probes are taken that find the wanted share of its neighbours. Buckets are read in blocks of bounded size, so no bucket is
ever gathered in one task and no pair of rows is written out: a block gives each query its best k only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, table

TABLES = 8
#: The share of the sampled queries' neighbours that the probes must find.
RECALL = 0.95
#: Queries that are answered by brute force to fit the probes.
SAMPLE = 128
#: Rotations are added to a hash until its buckets hold no more rows than this on average, two at most.
ROWS_PER_BUCKET = 1 << 14
BLOCK = 512
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix, in n log n additions each; n a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """tables hash functions of so many polytopes each for vectors of dim components; deterministic in seed."""

    def __init__(self, dim: int, tables: int = TABLES, polytopes: int = 1, seed: int = SEED):
        self.dim, self.polytopes, self.width = dim, polytopes, 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, polytopes, 3, self.width))
        self.buckets = (2 * self.width) ** polytopes

    def axes(self, x: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each table, and in it for each polytope, the closeness of each row to each of the 2 * width signed axes."""
        wide = np.zeros((len(x), self.width), np.float32)
        wide[:, : self.dim] = x
        for table in self.signs:
            near = []
            for signs in table:
                turned = wide
                for s in signs:
                    turned = hadamard(turned * s)
                near.append(np.concatenate([turned, -turned], axis=1))
            yield near

    def bucket(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for near in self.axes(x):
            code = np.zeros(len(x), np.int64)
            for a in near:
                code = code * (2 * self.width) + a.argmax(axis=1)
            out.append(code)
        return out

    def closeness(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the closeness of each row to each bucket: the sum over its axes."""
        for near in self.axes(x):
            total = near[0]
            for a in near[1:]:
                total = (total[:, :, None] + a[:, None, :]).reshape(len(x), -1)
            yield total

    def probes(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        n = min(n, self.buckets)
        return [np.argpartition(-a, n - 1, axis=1)[:, :n] for a in self.closeness(x)]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) without vectors that are null, empty, zero, or hold null or non-finite components; single precision stays as it is."""
    single = "float" in vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def _hashed(hashes: CrossPolytope, probes: int | None):
    """Rows to (vec_id, v, tab, bucket): every table, one bucket for index rows and probes buckets for queries."""

    def run(batches):
        import pyarrow as pa

        step = max(1, (1 << 20) // (hashes.buckets if probes else 1 << 10))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column("v"), hashes.dim).astype(np.float32)
                found = [b[:, None] for b in hashes.bucket(x)] if probes is None else hashes.probes(x, probes)
                for k, buckets in enumerate(found):
                    rows = pa.array(np.repeat(np.arange(len(x)), buckets.shape[1]))
                    taken = part.select(["vec_id", "v"]).take(rows)
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(np.full(len(rows), k), pa.int32()), pa.array(buckets.ravel(), pa.int64())], names=["vec_id", "v", "tab", "bucket"])

    return run


def _nearest(names: np.ndarray, sample: np.ndarray, k: int):
    """A task's k nearest rows of each sampled query: (query, vec_id, score, v)."""

    def run(batches):
        import pyarrow as pa

        held = [(np.empty(0), np.empty(0, np.int64), np.empty((0, sample.shape[1])))] * len(sample)
        kind = None
        for batch in batches:
            kind = batch.schema.field("v").type
            x, ids = _matrix(batch.column("v"), sample.shape[1]), np.array(batch.column("vec_id"))
            score = sample @ x.T
            score[names[:, None] == ids[None, :]] = -np.inf
            for q, own in enumerate(score):
                near = np.argpartition(-own, min(k, len(own)) - 1)[:k]
                near = near[own[near] > -np.inf]
                s, i, v = (np.concatenate([a, b]) for a, b in zip(held[q], (own[near], ids[near], x[near]), strict=True))
                top = np.argsort(-s, kind="stable")[:k]
                held[q] = s[top], i[top], v[top]
        if kind is not None:
            for q, (s, i, v) in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q)), pa.array(i), pa.array(s), pa.array(v.tolist(), kind)], names=["query", "vec_id", "score", "v"])

    return run


def fitted_probes(rows: DataFrame, asked: DataFrame, hashes: CrossPolytope, k: int, recall: float = RECALL, size: int = SAMPLE) -> int:
    """The fewest probes a table that find the share recall of the k nearest rows of about size queries, drawn by hash and answered by brute force."""
    n = asked.count()
    drawn = asked if n <= size else asked.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * size / n))
    drawn = drawn.collect()  # about size rows
    if not drawn:
        return 1
    names, sample = np.array([r["vec_id"] for r in drawn]), np.array([r["v"] for r in drawn], np.float64)
    kind = rows.schema["v"].dataType.simpleString()
    near = rows.mapInArrow(_nearest(names, sample, k), f"query long, vec_id long, score double, v {kind}")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "v").collect()  # k rows a sampled query
    if not near:
        return 1
    own, x = np.array([r["query"] for r in near]), np.array([r["v"] for r in near], np.float32)
    needed = np.full(len(own), hashes.buckets)
    for q in np.unique(own):
        at = np.flatnonzero(own == q)
        for closeness, buckets in zip(hashes.closeness(sample[q : q + 1].astype(np.float32)), hashes.bucket(x[at]), strict=True):
            better = (closeness[0][None, :] > closeness[0][buckets][:, None]).sum(axis=1) + 1
            needed[at] = np.minimum(needed[at], better)
    return int(np.quantile(needed, recall, method="higher"))


def _best(k: int):
    """The k best rows of a block for each query of a block, exact in double precision."""

    def run(rows, queries):
        import pandas as pd

        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(rows) or not len(queries):
            return none
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        ids, x = rows["vec_id"].to_numpy()[order], np.stack(rows["v"].to_numpy()).astype(np.float64)[order]
        names, out = queries["vec_id"].to_numpy(), []
        vectors = np.stack(queries["v"].to_numpy()).astype(np.float64)
        for at in range(0, len(names), 256):
            own, score = names[at : at + 256], exact(vectors[at : at + 256], x)
            score[own[:, None] == ids[None, :]] = -np.inf
            # rows lie by id, so a stable order settles ties by the smaller id
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(score, best, axis=1)
            out.append(pd.DataFrame({"query_id": np.repeat(own, best.shape[1]), "vec_id": ids[best].ravel(), "score": value.ravel()}))
        found = pd.concat(out)
        return found[found["score"] > -np.inf]

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component so that a pair's score never depends on its block."""
    out = np.zeros((len(q), len(x)))
    for i in range(q.shape[1]):
        out += np.multiply.outer(q[:, i], x[:, i])
    return out


def search(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, probes: int | None = None, polytopes: int | None = None, recall: float = RECALL, block: int = BLOCK, seed: int = SEED, scratch: Scratch | None = None
) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score; nearest first, ties to the smaller vec_id.

    probes, buckets probed a table, are fitted to recall where not given; polytopes, rotations a hash, follow from the number of
    rows. Vectors that usable() leaves out take no part, nor do those whose length is not the most common one among the rows (the
    shorter of two equally common); rows that repeat a vec_id with other components count as one row, by its best score; a table
    without usable vectors gives no rows.
    """
    scratch = scratch or Scratch(spark, "ann")
    rows = scratch.keep(usable(vectors), "rows")
    first = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    alike = F.size("v") == first["dim"]
    rows, asked = rows.where(alike), scratch.keep(usable(queries).where(alike), "asked")
    schema = f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, tab int, bucket long"
    axes = CrossPolytope(first["dim"], 1).buckets
    polytopes = polytopes or (1 if first["n"] <= axes * ROWS_PER_BUCKET else 2)
    hashes = CrossPolytope(first["dim"], tables, polytopes, seed)
    # with no more candidates than are asked for, all are wanted
    probes = probes or (hashes.buckets if first["n"] <= k + 1 else fitted_probes(rows, asked, hashes, k, recall))
    index = rows.mapInArrow(_hashed(hashes, None), schema)
    sizes = index.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = scratch.keep(sizes, "sizes")
    if tables * hashes.buckets <= 1 << 18:
        # no more rows than buckets, whatever the input
        sizes = F.broadcast(sizes)
    index = index.join(sizes, ["tab", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int"))
    asked = asked.mapInArrow(_hashed(hashes, probes), schema).join(sizes, ["tab", "bucket"])
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # queries of a bucket come in parts too; the part is a key of both sides
    parts = asked.groupBy("tab", "bucket", "block").agg(F.ceil(F.count("*") / (8 * block)).cast("int").alias("parts")).select("tab", "bucket", "block", "parts")
    parts = scratch.keep(parts, "parts")
    keys = ["tab", "bucket", "block"]
    index = index.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int"))
    keys = [*keys, "part"]
    found = index.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(spark, rows, rows.where("vec_id % 20 = 0"))
