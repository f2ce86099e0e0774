"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows and pieces of at most PIECE tokens. The pieces are dealt into bounded groups; in each, partial
partitions are merged largest difference first with opposing imbalances, which gives near-equal windows. The number of windows
starts at the least that the group's tokens need and rises as long as a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, table

CAPACITY = 2048
PIECE = 512
GROUP_TOKENS = 1 << 18
END = 1
TOKENIZER = "byte_bpe_50k"
#: Fixed values of the vocabulary: its special token and that token's id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Words whose ids a worker remembers; what this bounds is memory, not the texts.
REMEMBER = 300_000


@lru_cache(maxsize=2)
def encoder(name: str = TOKENIZER):
    """A function from text to its ids as little-endian uint32 bytes, equal to tokenizers' encoding of the same vocabulary.

    Text is split at single spaces and line ends, where the vocabulary's pattern always parts too, and words' ids are remembered;
    text with other white space, or with two such characters together, is encoded whole. The special token's string is its one id
    wherever it stands, and parts the text, as in that library's default.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile(r"\s\s|\s\Z|[^\S \n]")
    newline = np.array(whole.encode_ordinary("\n"), "<u4").tobytes()

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = out = np.array(whole.encode_ordinary(word), "<u4").tobytes()
            return out

    known = Words()

    special = np.array([SPECIAL_ID], "<u4").tobytes()

    def encode(text: str) -> bytes:
        if SPECIAL in text:
            return special.join(map(plain, text.split(SPECIAL)))
        return plain(text)

    def plain(text: str) -> bytes:
        if odd.search(text):
            return np.array(whole.encode_ordinary(text), "<u4").tobytes()
        return newline.join(b"".join(map(known.__getitem__, _spaced(line))) for line in text.split("\n"))

    return encode


def _spaced(line: str) -> list[str]:
    if not line:
        return []
    words = line.replace(" ", "\0 ").split("\0") if "\0" not in line else [line]
    return words


def differencing(sizes: list[int], bins: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of sizes in each of bins sets with near-equal sums."""
    heap = []
    for i, n in enumerate(sizes):
        # a partial partition: its largest sum less its smallest, and its non-zero sums with their members, smallest first
        heap.append((-n, i, [(n, [i])]))
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # a's smallest sums meet b's largest; sets that a leaves empty are its smallest
        free = bins - len(a)
        merged = list(a)
        rest = b[::-1]
        merged += rest[:free]
        for (n, own), at in zip(rest[free:], range(len(a)), strict=False):
            merged[at] = (merged[at][0] + n, merged[at][1] + own)
        merged.sort(key=lambda x: x[0])
        if len(merged) == bins and merged[0][0] > 0:
            low = merged[0][0]
            spread = merged[-1][0] - low
        else:
            spread = merged[-1][0]
        heapq.heappush(heap, (-spread, ticket, merged))
        ticket += 1
    return [own for _, own in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sets of indices with sums of at most capacity; the number of sets rises until differencing exceeds none."""
    if not sizes:
        return []
    bins = -(-sum(sizes) // capacity)
    while True:
        sets = differencing(sizes, bins)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            return sets
        bins += max(1, bins // 100)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """The pieces of each document's ids (text, then END): whole windows first, then pieces of at most piece ids."""

    def run(batches: Iterator):
        import pyarrow as pa

        encode, end = encoder(), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                total, at = len(ids) // 4, 0
                while at < total:
                    n = capacity if total - at >= capacity else min(piece, total - at)
                    rows.append((doc, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), total))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def place(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, scratch: Scratch | None = None) -> DataFrame:
    """pieces with sequence_id and offset. Whole windows are sequences of their own; the others are dealt by hash into groups of about group_tokens."""
    scratch = scratch or Scratch(spark, "pack")
    pieces = scratch.keep(pieces, "pieces")
    total = pieces.where(F.col("length") < capacity).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // group_tokens))
    # equal rows are spread too: each carries its own place in its partition of a written table
    key = F.xxhash64("doc_id", "start", "length", "ids_crc32")
    small = pieces.where(F.col("length") < capacity).withColumn("grp", F.pmod(key, F.lit(groups)))

    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable", na_position="first").reset_index(drop=True)
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        sizes = pdf["length"].tolist()
        for k, own in enumerate(windows(sizes, capacity)):
            at = 0
            for i in sorted(own):
                sequence[i], offset[i] = k, at
                at += sizes[i]
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * (1 << 24) + sequence, offset=offset).drop(columns="grp")

    fields = f"{PIECES}, sequence_id long, offset long"
    packed = small.groupBy("grp").applyInPandas(run, fields)
    # whole windows: ids below zero, from the row's place in the written table, which does not change between runs
    alone = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty (the END id alone); repeated rows are documents of their own; an empty table gives no rows; other
    columns play no part. A document's pieces cover its ids once, in order of start.
    """
    return place(spark, cut(docs, capacity), capacity, scratch=scratch)


def materialize(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """(sequence_id, ids) with padded windows: each piece's ids are cut again from its text and put at their offsets."""

    def pieces(batches):
        import pyarrow as pa

        encode, end = encoder(), np.array([END], "<u4").tobytes()
        for batch in batches:
            ids = [(encode(t.as_py() or "") + end)[4 * a : 4 * (a + n)] for t, a, n in zip(batch.column("text"), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("offset"), pa.array(ids, pa.binary())], names=["sequence_id", "offset", "ids"])

    def fill(pdf):
        import pandas as pd

        ids = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), "<u4").astype(np.int64)
        full = len(ids) if len(ids) & (len(ids) - 1) == 0 else capacity
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [np.concatenate([ids, np.full(full - len(ids), pad)])]})

    rows = placed.join(docs.select("doc_id", "text"), "doc_id").select("sequence_id", "offset", "start", "length", "text")
    return rows.mapInArrow(pieces, "sequence_id long, offset long, ids binary").groupBy("sequence_id").applyInPandas(fill, "sequence_id long, ids array<long>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
