"""Substring dedup with a log-structured fingerprint index.

Batches of documents come one after the other. A batch's fingerprints are merge-joined with the sorted immutable runs of all
earlier ones, then written as a run of their own; runs are merged when several of one size have gathered. The index holds anchors,
the smallest hash of a short run of words within each window, which equal windows share. Hits are verified on the words: each window
whose anchor has come before is held by a 128-bit digest of its words against all others of that kind, through a second index.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD, Rolling, Scratch, table, word_hashes

WINDOW = 35
GRAM = 12
BATCHES = 3
FAN_IN = 2
BASE = 0xD1342543DE82EF95


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in a folder; again tells whether a fingerprint had come before its run or comes twice in it.

    A run is a table bucketed and sorted by its keys, so that merge joins with it move only the new batch. The folder is all there
    is to it: an index opened on one that has runs goes on from them, with their number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fan_in: int = FAN_IN):
        self.spark, self.path, self.keys, self.fan_in = spark, path, keys, fan_in
        self.made, self.levels, self.buckets = 0, {}, int(spark.conf.get("spark.sql.shuffle.partitions"))
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        self.files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.files.exists(folder):
            for found in sorted(x.getPath().getName() for x in self.files.listStatus(folder)):
                _, level, made, buckets = found.split("-")
                self.levels[found], self.made, self.buckets = int(level), max(self.made, int(made) + 1), int(buckets)
        for name in self.levels:
            columns = ", ".join(f"{k} BIGINT" for k in keys)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({columns}, again BOOLEAN) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{path}/{name}'")

    def _table(self, name: str) -> str:
        return "quarry_run_" + hashlib.md5(f"{self.path}/{name}".encode()).hexdigest()

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"run-{level}-{self.made:06d}-{self.buckets}"
        self.made += 1
        dealt = rows.select(*self.keys, "again").write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        dealt.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self._table(name))
        self.levels[name] = level

    def run(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def known(self, batch: DataFrame) -> DataFrame:
        """batch, one row a key, with known: whether an earlier batch has it, by a merge join with each run."""
        seen = F.lit(False)
        for i, name in enumerate(self.levels):
            batch = batch.join(self.run(name).select(*self.keys, F.lit(True).alias(f"_r{i}")).hint("merge"), self.keys, "left")
            seen = seen | F.col(f"_r{i}").isNotNull()
        return batch.withColumn("known", seen).drop(*[f"_r{i}" for i in range(len(self.levels))])

    def add(self, batch: DataFrame) -> None:
        """A batch's fingerprints (keys, n), however often each comes, are held against all runs and become a run; where fan_in runs of one level have gathered, they are merged first."""
        self.compact()
        counted = batch.groupBy(*self.keys).agg(F.sum("n").alias("n"))
        self._write(self.known(counted).withColumn("again", F.col("known") | (F.col("n") > 1)), 0)

    def compact(self) -> None:
        """Levels of fan_in runs or more become one run of the next level, bucket by bucket: a merge of sorted runs, without a shuffle."""
        for level in sorted(set(self.levels.values())):
            names = [x for x, y in self.levels.items() if y == level]
            if len(names) < self.fan_in:
                continue
            merged = self.run(names[0])
            for name in names[1:]:
                more = self.run(name).select(*self.keys, F.col("again").alias("_again")).hint("merge")
                merged = merged.join(more, self.keys, "full").select(*self.keys, (F.coalesce("again", F.lit(False)) | F.coalesce("_again", F.lit(False))).alias("again"))
            self._write(merged, level + 1)
            for name in names:
                del self.levels[name]
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
                self.files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def repeated(self) -> DataFrame:
        """Fingerprints that occur twice or more, over all runs; one may come more than once."""
        out = None
        for name in self.levels:
            found = self.run(name).where("again").select(*self.keys)
            out = found if out is None else out.unionByName(found)
        return out


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of each run of width items, in log(width) passes."""
    step, out = 1, x
    while 2 * step <= width:
        out = best(out[:-step], out[step:])
        step *= 2
    return best(out[: len(x) - width + 1], out[width - step : width - step + len(x) - width + 1]) if step < width else out


def window_anchors(words: list[bytes], rolling: Rolling, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hashes at all places that are some window's anchor, equal ones included."""
    grams = rolling(word_hashes(words), gram)
    width = window - gram + 1
    if len(grams) < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    least = _sliding(grams, width, np.minimum)
    # a place is an anchor if the largest of the minima that could be its own is its hash
    wide = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return least, grams[_sliding(wide, width, np.maximum) == grams]


def _batches(names: list[str], kinds: list, rows: Iterator, limit: int = 1 << 16):
    import pyarrow as pa

    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _anchors(window: int, gram: int):
    def run(batches: Iterator):
        import pyarrow as pa

        rolling = Rolling(BASE)
        for batch in batches:
            docs, h, keys, counts, size = [], [], [], [], 0
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("text"), strict=True)
            for doc, own, text in rows:
                words = (text.as_py() or "").encode().split()
                if len(words) < window:
                    continue
                key, n = np.unique(window_anchors(words, rolling, window, gram)[1], return_counts=True)
                docs += [doc] * len(key)
                h.append(np.full(len(key), own, np.int64))
                keys.append(key.view(np.int64))
                counts.append(np.minimum(n, 2).astype(np.int32))
                size += len(key)
                if size > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(np.concatenate(x)) for x in (h, keys, counts))], names=["doc_id", "h", "anchor", "n"])
                    docs, h, keys, counts, size = [], [], [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(np.concatenate(x)) for x in (h, keys, counts))], names=["doc_id", "h", "anchor", "n"])

    return run


STATE = "kind int, new boolean, doc_id long, h long, place int, k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, text string"


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _windows(window: int, gram: int, with_text: bool):
    """Rows (doc_id, h, text, found anchors, copy, first) to finished documents (0), windows to settle (1) and open documents (2)."""

    def rows(batches: Iterator):
        rolling, pair = Rolling(BASE), struct.Struct("<qq")
        for batch in batches:
            for doc, h, text, new, found, copy, first in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "new", "found", "copy", "first")), strict=True):
                doc, h, text, new, copy, first = doc.as_py(), h.as_py(), text.as_py(), new.as_py(), copy.as_py(), first.as_py()
                words = (text or "").encode().split()
                n = len(words)
                spots: list[int] = []
                if n >= window and found.is_valid and (first or not copy):
                    known = np.array(found.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    least = window_anchors(words, rolling, window, gram)[0]
                    spots = np.flatnonzero(np.isin(least, known)).tolist()
                if copy:
                    # a text that occurs twice has all its windows twice
                    removed = n if n >= window else 0
                    yield (0, new, doc, h, None, None, None, n, removed, _sha(words[removed:]), ("" if removed else text) if with_text else None), 1 + len(text or "") * with_text // 64
                elif not spots:
                    yield (0, new, doc, h, None, None, None, n, 0, _sha(words), text if with_text else None), 1 + len(text or "") * with_text // 64
                else:
                    yield (2, new, doc, h, None, None, None, n, None, None, text), 1 + len(text) // 64
                if spots:
                    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
                    joined = b" ".join(words)
                    for i in spots:
                        key = hashlib.blake2b(joined[ends[i - 1] if i else 0 : ends[i + window - 1] - 1], digest_size=16)
                        yield (1, new, doc, h, i, *pair.unpack(key.digest()), None, None, None, None), 1

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield from _batches([x.split()[0] for x in STATE.split(", ")], kinds, rows(batches))

    return run


def cover(n: int, spots: np.ndarray, window: int) -> np.ndarray:
    """Which of n words a window starting at one of spots covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, spots, 1)
    np.add.at(step, spots + window, -1)
    return np.cumsum(step[:n]) > 0


def _settle(window: int, with_text: bool):
    """Rows (doc_id, h, text, spots) to (doc_id, n_words, n_removed, kept_sha256, text without the removed words)."""
    import re

    word = re.compile(WORD.encode())

    def rows(batches: Iterator):
        for batch in batches:
            for doc, h, text, spots in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "spots")), strict=True):
                data = text.as_py().encode()
                words = data.split()
                gone = np.zeros(len(words), bool)
                if spots.is_valid:
                    gone = cover(len(words), np.array(spots.values.to_numpy(zero_copy_only=False), np.int64), window)
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                left = None
                if with_text:
                    # a removed run goes from its first word to the next kept one
                    starts, parts, at = [m.start() for m in word.finditer(data)] + [len(data)], [], 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    for a, b in edges.reshape(-1, 2).tolist():
                        parts.append(data[at : starts[a]])
                        at = starts[b]
                    left = b"".join([*parts, data[at:]]).decode() if gone.any() else text.as_py()
                yield (doc.as_py(), h.as_py(), len(words), int(gone.sum()), _sha(kept), left), 1 + len(data) * with_text // 64

    def run(batches):
        import pyarrow as pa

        yield from _batches(["doc_id", "h", "n_words", "n_removed", "kept_sha256", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], rows(batches))

    return run


RESULT = "doc_id long, h long, n_words long, n_removed long, kept_sha256 string, text string"


def remove_repeats(
    spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, with_text: bool = True, scratch: Scratch | None = None, index: str | None = None
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and with with_text the text without the removed words; h is the row's text hash.

    A word goes if a window of so many words covers it whose word sequence also starts anywhere else in docs, same document
    included, judged on docs as they are. Null texts have no words; rows that repeat a text lose all of it if it has a window;
    rows that repeat doc_id and text count as texts that repeat, and each is returned; an empty table gives no rows; other
    columns play no part.

    docs pass through the index in so many batches, dealt by their texts' hash. index names a folder that outlives the call: docs
    are then judged against all that earlier calls on it have brought as well, and are kept there, with their anchors, for later
    ones. Only rows of docs are returned.
    """
    scratch = scratch or Scratch(spark, "substring")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.lit(True).alias("new"))
    # whole texts that occur twice or more in docs: only the first of them speaks for its windows
    texts = scratch.keep(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.unhex(F.md5("text")).alias("m")), "texts")
    twice = scratch.keep(texts.groupBy("m").agg(F.min_by(F.struct("doc_id", "h"), F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("f"), F.count("*").alias("c")).where("c > 1"), "twice")
    copies = scratch.keep(texts.join(twice, "m").select("doc_id", "h", F.col("doc_id").eqNullSafe(F.col("f.doc_id")).alias("first")).distinct(), "copies")

    anchors = scratch.keep(rows.mapInArrow(_anchors(window, gram), "doc_id long, h long, anchor long, n int"), "anchors")
    runs = FingerprintIndex(spark, f"{index or scratch.path('index')}/anchors", ["anchor"])
    before = bool(runs.levels)
    for i in range(batches):
        # each batch meets all that came before it, in this call or earlier ones
        runs.add(anchors.where(F.pmod("h", F.lit(batches)) == i).select("anchor", "n"))
    found = anchors.withColumn("new", F.lit(True))
    if before:
        # earlier documents whose anchors are among those of the new ones: their windows count as well
        again = scratch.keep(anchors.join(runs.repeated().distinct(), "anchor", "left_semi").select("anchor").distinct(), "again")
        old = spark.read.schema("doc_id long, h long, anchor long").parquet(f"{index}/held").join(again, "anchor", "left_semi")
        found = scratch.keep(found.select("doc_id", "h", "anchor", "new").unionByName(old.withColumn("new", F.lit(False))), "all-anchors")
    found = found.join(runs.repeated(), "anchor", "left_semi").groupBy("doc_id", "h", "new").agg(F.collect_set("anchor").alias("found"))
    found = scratch.keep(found, "found")
    if index:
        if before:
            earlier = spark.read.schema("doc_id long, text string, h long").parquet(f"{index}/texts")
            old = found.where("NOT new").select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"))
            earlier = earlier.join(old, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("d2")), "left_semi")
            rows = scratch.keep(rows.unionByName(earlier.withColumn("new", F.lit(False))), "all-rows")
        rows.where("new").select("doc_id", "text", "h").write.mode("append").parquet(f"{index}/texts")
        anchors.select("doc_id", "h", "anchor").write.mode("append").parquet(f"{index}/held")
    scratch.release()
    scratch.drop("anchors", "texts", "twice", *(["all-anchors", "again"] if before else []))

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("id", F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "h", "new"))

    noted = named(found).select("id", "found")
    marked = named(copies.withColumn("new", F.lit(True))).select("id", F.lit(True).alias("copy"), "first")
    todo = scratch.keep(noted.join(marked, "id", "full"), "todo")
    state = named(rows).join(todo.hint("merge"), "id", "left").select("doc_id", "h", "text", "new", "found", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("first", F.lit(False)).alias("first"))
    state = scratch.keep(state.mapInArrow(_windows(window, gram, with_text), STATE), "state", ["kind"])
    scratch.release()

    windows = state.where("kind = 1")
    settled = FingerprintIndex(spark, scratch.path("windows"), ["k1", "k2"])
    for i in range(batches):
        settled.add(windows.where(F.pmod("h", F.lit(batches)) == i).select("k1", "k2", F.lit(1).alias("n")))
        scratch.release()
    spots = windows.where("new").select("doc_id", "h", "place", "k1", "k2").join(settled.repeated(), ["k1", "k2"], "left_semi").groupBy("doc_id", "h").agg(F.collect_set("place").alias("spots"))
    spots = scratch.keep(spots, "spots")
    scratch.release()
    waiting = state.where("kind = 2 AND new").select("doc_id", "h", "text")
    ours = spots.withColumnRenamed("doc_id", "d2").withColumnRenamed("h", "h2")
    late = waiting.join(ours, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").select("doc_id", "h", "text", "spots").mapInArrow(_settle(window, with_text), RESULT)
    done = state.where("kind = 0 AND new").select("doc_id", "h", "n_words", "n_removed", "kept_sha256", "text")
    return done.unionByName(late)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
