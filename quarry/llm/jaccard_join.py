"""N-gram Jaccard join by a token-group matrix.

Equal shingle sets are one node. Two sets as similar as asked for share a token among the first n - ceil(t n) + 1 of each, in any
one order of all tokens; the order puts tokens that no other set has first and frequent ones last. Of the tokens that two sets
share, the first leaves each only so many tokens after it, which must hold the whole overlap.

Each set is partitioned to the leader of its own size class that it meets most often; a leader's sets form a group, cut into parts
of about BLOCK. What is similar within a part is linked there. A part's rows of the matrix say, per token, which sizes and
remainders its members have; parts meet parts, never single sets, in rows that sizes, remainders and links found so far allow. The
parts' token unions bound the overlap of those that are left, and a qualifying part is opened against the others of its row in
jobs of bounded size, where each set is held against the union of the other side before pairs are compared. Links are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Rolling, Scratch, components, table, word_hashes

BLOCK = 256
#: Tokens in more documents than this need no finer order among themselves.
FREQUENT = 1 << 20
BASE = 0x9E3779B97F4A7C15


def shingles(text: str | None, k: int, rolling: Rolling) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text; of the whole sequence where it has fewer words."""
    h = word_hashes((text or "").encode().lower().split())
    if not len(h):
        return h
    return np.unique(rolling(h, min(k, len(h))))


def prefix_length(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _region(percent: int) -> int:
    """Tokens with hashes below this have their frequencies counted: one and a half prefixes of an average set."""
    return int(1.5 * (100 - percent) / 100 * 2**64)


def _heads(k: int, percent: int):
    """Rows to (doc_id, n, digest, inside, head): set size, digest of the set, how many tokens lie in the region, and these; where they are fewer than the prefix, the next ones by hash too."""

    def run(batches: Iterator):
        import pyarrow as pa

        rolling, border = Rolling(BASE), np.uint64(_region(percent))
        names = ["doc_id", "n", "digest", "inside", "head"]

        def made(rows: list[tuple], heads: list[np.ndarray]):
            ends = np.cumsum([0] + [len(x) for x in heads]).astype(np.int32)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads).view(np.int64)))], names=names)

        for batch in batches:
            rows, heads, size = [], [], 0
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingles(x.as_py(), k, rolling)
                inside = int(np.searchsorted(s, border))
                rows.append((doc, len(s), _digest(s) if len(s) else None, inside))
                heads.append(s[: max(inside, prefix_length(len(s), percent))] if len(s) else s)
                size += len(heads[-1])
                if size > 1 << 20:
                    yield made(rows, heads)
                    rows, heads, size = [], [], 0
            if rows:
                yield made(rows, heads)

    return run


def _packed(k: int):
    """Rows (doc_id, node, digest, unit, job, own, text) to (node, unit, job, own, tokens), the whole set, where the text is the one that the node stands for."""

    def run(batches: Iterator):
        import pyarrow as pa

        rolling, last, seen = Rolling(BASE), None, set()

        def made(rows: list[tuple]):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "unit", "job", "own", "tokens"])

        for batch in batches:
            rows, size = [], 0
            for doc, node, digest, unit, job, own, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "node", "digest", "unit", "job", "own")), batch.column("text"), strict=True):
                # rows come by doc_id: repeated ones follow one another and count once
                if doc != last:
                    last, seen = doc, set()
                if (node, unit) in seen:
                    continue
                s = shingles(x.as_py(), k, rolling)
                if _digest(s) != digest:
                    continue
                seen.add((node, unit))
                rows.append((node, unit, job, own, s.tobytes()))
                size += len(s)
                if size > 1 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def similar(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of token matrices over a slice of the tokens at a time."""
    left, right = np.concatenate(sets), np.concatenate(others)
    common = np.intersect1d(left, right)
    out = np.zeros((len(sets), len(others)), np.float64)
    rows, columns = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.repeat(np.arange(len(others)), [len(s) for s in others])
    width = 4096
    at_left, at_right = np.searchsorted(common, left), np.searchsorted(common, right)
    keep_left = (at_left < len(common)) & (common[np.minimum(at_left, len(common) - 1)] == left) if len(common) else np.zeros(len(left), bool)
    keep_right = (at_right < len(common)) & (common[np.minimum(at_right, len(common) - 1)] == right) if len(common) else np.zeros(len(right), bool)
    rows, at_left, columns, at_right = rows[keep_left], at_left[keep_left], columns[keep_right], at_right[keep_right]
    by_left, by_right = np.argsort(at_left, kind="stable"), np.argsort(at_right, kind="stable")
    rows, at_left, columns, at_right = rows[by_left], at_left[by_left], columns[by_right], at_right[by_right]
    for start in range(0, len(common), width):
        a, b = np.searchsorted(at_left, [start, start + width])
        c, d = np.searchsorted(at_right, [start, start + width])
        x, y = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        x[rows[a:b], at_left[a:b] - start] = 1
        y[columns[c:d], at_right[c:d] - start] = 1
        out += x @ y.T
    return out


def block_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different components, between the documents of side 1 and side 2 (side 0: all with all), as a spanning forest."""
    first, second = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    if not len(first) or not len(second):
        return []
    sizes = np.array([len(s) for s in sets])
    if (side == 0).all():
        # the union of what at least two members hold stands for what the others could share with one
        token, count = np.unique(np.concatenate(sets), return_counts=True)
        union = token[count > 1]
        unions = (union, union)
    else:
        unions = (np.unique(np.concatenate([sets[i] for i in second])), np.unique(np.concatenate([sets[i] for i in first])))

    def opened(rows: np.ndarray, union: np.ndarray) -> np.ndarray:
        bound = np.array([np.isin(sets[i], union, assume_unique=True).sum() for i in rows])
        return rows[100 * bound >= percent * sizes[rows]]

    first, second = opened(first, unions[0]), opened(second, unions[1])
    if not len(first) or not len(second):
        return []
    overlap = _overlaps([sets[i] for i in first], [sets[i] for i in second])
    linked = similar(overlap, sizes[first][:, None], sizes[second][None, :], percent) & (ids[first][:, None] != ids[second][None, :])
    parent = {c: c for c in comps.tolist()}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = first[i], second[j]
        x, y = root(int(comps[a])), root(int(comps[b]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))
    return out


def _job_links(percent: int):
    """A job's rows (unit, node, comp, side, tokens) to its links: unit by unit, within it or between its two sides."""

    def run(pdf):
        import pandas as pd

        found = []
        for _, part in pdf.groupby("unit", sort=False):
            part = part.drop_duplicates(["node", "side"])
            if len(part) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in part["tokens"]]
                found += block_links(part["node"].to_numpy(), part["comp"].to_numpy(), sets, part["side"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _ceil(part, whole):
    return F.ceil(part / whole)


def join(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id that links reach, its own included.

    Words are lower-cased in A-Z only. Rows without words are linked with nothing; a null doc_id has no component; rows that repeat
    a doc_id are one document, linked with what any of its texts is linked with; an empty table gives no rows; other columns play
    no part. Two sets link when 100 * |A n B| >= percent * |A u B|; no link between different sets is lost, and equal sets are
    linked through their digest.
    """
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slim = docs.mapInArrow(_heads(k, percent), "doc_id long, n long, digest binary, inside long, head array<long>")
    heads = scratch.keep(slim.withColumn("row", F.monotonically_increasing_id()), "heads")
    slim = scratch.keep(heads.select("row", "doc_id", "n", "digest"), "slim")
    real = slim.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # a node for each different set, named by one of its rows
    nodes = scratch.keep(real.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep")), "nodes")
    own = scratch.keep(heads.select(F.col("row").alias("node"), "n", "inside", "head").join(nodes.select("node").hint("merge"), "node", "left_semi"), "own")
    scratch.drop("heads")
    scratch.release()

    # how many sets have each token; only tokens of two or more can be shared
    tokens = own.select("node", F.explode("head").alias("token"))
    counts = scratch.keep(tokens.groupBy("token").agg(F.least(F.count("*"), F.lit(FREQUENT)).cast("int").alias("df")).where("df > 1"), "counts")
    scratch.release()
    shared = scratch.keep(tokens.join(counts, "token").select("token", "node", "df"), "shared")
    scratch.drop("counts")
    scratch.release()

    # the prefix in the order (region first, frequency, hash); tokens of one set alone come first and match nothing
    border = _region(percent)
    in_region = (F.col("token") >= 0) & (F.col("token") < border) if border < 1 << 63 else (F.col("token") >= 0) | (F.col("token") < border - (1 << 64))
    held = shared.groupBy("node").agg(
        F.array_sort(F.collect_set(F.when(in_region, F.struct("df", "token")))).alias("ranked"), F.collect_set(F.when(~in_region, F.col("token"))).alias("beyond")
    )
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    alone = F.col("inside") - F.size("ranked")
    taken = F.slice("ranked", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int"))
    # rest: the tokens from this one on, at most; those beyond the region come after all within it
    prefix = F.concat(
        F.transform(taken, lambda x, i: F.struct(x["token"].alias("token"), (F.col("n") - alone - i).alias("rest"))),
        F.transform("beyond", lambda x: F.struct(x.alias("token"), (F.col("n") - F.col("inside")).alias("rest"))),
    )
    both = own.select("node", "n", "inside").join(held, "node").select("node", "n", "inside", F.transform("ranked", lambda x: x["token"]).alias("region"), prefix.alias("prefix"))
    both = scratch.keep(both, "both")
    scratch.drop("shared", "own")
    # sizes of one class are as near as a link needs
    cls = F.floor(F.log(F.col("n")) / math.log(100 / percent)) if percent < 100 else F.col("n")
    posts = both.select("node", "n", cls.cast("long").alias("cls"), F.inline("prefix"))
    crowds = scratch.keep(posts.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "crowds")
    posts = scratch.keep(posts.join(crowds, "token"), "posts")
    scratch.release()

    # the first partition: each set with the leader of its class that it meets most often
    leaders = scratch.keep(posts.groupBy("token", "cls").agg(F.min("node").alias("leader")), "leaders")
    met = posts.join(leaders, ["token", "cls"]).where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    led = scratch.keep(met.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader")), "led")
    size = scratch.keep(led.groupBy("leader").agg(F.count("*").alias("c")), "led-sizes")
    part = F.pmod(F.xxhash64("node"), _ceil(F.col("c"), BLOCK))
    led = scratch.keep(led.join(size, "leader").select("node", F.col("leader").alias("g"), part.alias("gp"), "c"), "parts-1")
    # small groups share a job, unit by unit; a leader visits each part of its own
    buckets = max(1, led.count() // BLOCK)
    job = F.when(F.col("c") >= BLOCK // 2, F.xxhash64("g", "gp")).otherwise(F.pmod(F.xxhash64("g"), F.lit(buckets)))
    at = led.select("node", "g", F.xxhash64("g", "gp").alias("unit"), job.alias("job"))
    guests = at.select(F.col("g").alias("node"), "unit", "job").distinct().withColumn("own", F.lit(False))
    meeting = posts.select("node").distinct().join(at.drop("g"), "node", "left").withColumn("own", F.lit(True))
    at = scratch.keep(meeting.unionByName(guests), "jobs-1")
    # the whole sets of those that meet any other, each with its jobs; merge joins at every size: what is broadcast on small tables says nothing of large ones
    wanted = nodes.join(at, "node").select("node", "digest", "unit", "job", "own", F.col("rep").alias("doc_id"))
    sets = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "node", "digest", "unit", "job", "own", "text").mapInArrow(_packed(k), "node long, unit long, job long, own boolean, tokens binary")
    sets = scratch.keep(sets, "sets")
    scratch.drop("leaders", "led", "led-sizes", "jobs-1", "crowds")
    scratch.release()
    rows = sets.where("job IS NOT NULL").select("job", "unit", "node", F.col("node").alias("comp"), F.lit(0).alias("side"), "tokens")
    first = scratch.keep(rows.groupBy("job").applyInPandas(_job_links(percent), "a long, b long"), "links-1")
    scratch.release()
    edges = first.unionByName(_across(scratch, both, posts, sets, led, first, percent)).unionByName(_same_id(scratch, real, nodes))
    joined = scratch.keep(components(scratch, edges, "link"), "joined")
    scratch.drop("sets", "both", "posts", "member")
    named = nodes.select("digest", "node", "rep").join(joined, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("c"))
    named = scratch.keep(named, "named")
    least = scratch.keep(named.groupBy("c").agg(F.min("rep").alias("component")), "least")
    by_set = scratch.keep(named.join(least, "c").select("digest", "component"), "by-set")
    # copies of one text may be a third of all rows: both sides are written tables, which lets Spark split the copies
    answer = slim.select("doc_id", "n", "digest").join(by_set, "digest", "left")
    answer = answer.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    answer = scratch.keep(answer, "answer")
    scratch.only("answer")
    return answer


def _same_id(scratch: Scratch, real: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the different sets of rows that repeat a doc_id."""
    mark = F.xxhash64("digest")
    several = scratch.keep(real.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    rows = scratch.keep(real.select("doc_id", "digest").join(several, "doc_id").distinct().join(nodes.select("digest", "node"), "digest").select("doc_id", "node"), "several-nodes")
    return rows.join(rows.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def _across(scratch: Scratch, both: DataFrame, posts: DataFrame, sets: DataFrame, led: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between parts: those parts that tokens, sizes, remainders and unions let qualify, unless links already join them all."""
    linked = scratch.keep(components(scratch, found, "first"), "first")
    member = both.select("node", "n", "inside").join(linked, "node", "left").join(led.drop("c"), "node", "left")
    member = member.select("node", "n", "inside", F.coalesce("component", "node").alias("comp"), F.coalesce("g", "node").alias("g"), F.coalesce("gp", F.lit(-1)).alias("gp"))
    member = scratch.keep(member, "member")
    # the matrix: a part's sizes, longest remainder and components by token
    spans = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"), F.min("comp").alias("low"), F.max("comp").alias("high")]
    cells = posts.select("token", "node", "n", "rest").join(member.select("node", "comp", "g", "gp"), "node").groupBy("token", "g", "gp").agg(*spans)
    matrix = scratch.keep(cells, "matrix")
    x = matrix.select("token", *[F.col(c).alias(f"{c}_x") for c in matrix.columns[1:]])
    y = matrix.select("token", *[F.col(c).alias(f"{c}_y") for c in matrix.columns[1:]])
    later = F.struct(F.col("g_x").alias("g"), F.col("gp_x").alias("gp")) < F.struct(F.col("g_y").alias("g"), F.col("gp_y").alias("gp"))
    reach = (100 * F.col("hi_y") >= percent * F.col("lo_x")) & (100 * F.col("hi_x") >= percent * F.col("lo_y"))
    least_x, least_y = F.greatest("lo_x", _ceil(percent * F.col("lo_y"), 100)), F.greatest("lo_y", _ceil(percent * F.col("lo_x"), 100))
    left = F.least("rest_x", "rest_y") >= _ceil(percent * (least_x + least_y), 100 + percent)
    apart = (F.least("low_x", "low_y") != F.greatest("high_x", "high_y"))
    pairs = x.join(y, (x["token"] == y["token"]) & later & reach & left & apart).select("g_x", "gp_x", "g_y", "gp_y").distinct()
    pairs = scratch.keep(pairs, "pairs")
    scratch.drop("matrix")
    # a part's union of shared tokens in the region; a link needs so many of each side's tokens there
    named = pairs.select(F.col("g_x").alias("g"), F.col("gp_x").alias("gp")).unionByName(pairs.select(F.col("g_y").alias("g"), F.col("gp_y").alias("gp"))).distinct()
    members = scratch.keep(member.join(named, ["g", "gp"]), "members")
    need = F.min(F.col("inside") - F.floor((100 - percent) * F.col("n") / 100)).alias("need")
    unions = members.join(both.select("node", "region"), "node").groupBy("g", "gp").agg(F.array_distinct(F.flatten(F.collect_list("region"))).alias("union"), need, F.count("*").alias("c"))
    unions = scratch.keep(unions, "unions")
    bound = pairs
    for side in ("x", "y"):
        own = unions.select(*[F.col(c).alias(f"{c}_{side}") for c in unions.columns])
        bound = bound.join(own, [f"g_{side}", f"gp_{side}"])
    bound = bound.where(F.size(F.array_intersect("union_x", "union_y")) >= F.greatest("need_x", "need_y"))
    opened = scratch.keep(bound.select("g_x", "gp_x", "g_y", "gp_y", "c_y"), "opened")
    scratch.drop("pairs", "unions")
    scratch.release()
    # a row of the matrix: a part against all those that it opens, in chunks
    row = scratch.keep(opened.groupBy("g_x", "gp_x").agg(F.sum("c_y").alias("total")), "opened-rows")
    buckets = max(1, row.count() // 16)
    chunk = F.pmod(F.xxhash64("g_y", "gp_y"), _ceil(F.col("total"), 2 * BLOCK))
    unit = F.xxhash64("g_x", "gp_x", "chunk")
    job = F.when(F.col("total") >= BLOCK // 2, unit).otherwise(F.pmod(F.xxhash64("g_x", "gp_x"), F.lit(buckets)))
    jobs = scratch.keep(opened.join(row, ["g_x", "gp_x"]).withColumn("chunk", chunk).select("g_x", "gp_x", "g_y", "gp_y", unit.alias("unit"), job.alias("job")), "jobs-2")
    sides = [
        jobs.select(F.col(f"g_{c}").alias("g"), F.col(f"gp_{c}").alias("gp"), "unit", "job").distinct().join(members.select("g", "gp", "node", "comp"), ["g", "gp"]).select("job", "unit", "node", "comp", F.lit(i).alias("side"))
        for i, c in ((1, "x"), (2, "y"))
    ]
    dealt = scratch.keep(sides[0].unionByName(sides[1]), "dealt")
    rows = sets.where("own").join(dealt.hint("merge"), "node").select(dealt["job"], dealt["unit"], "node", "comp", "side", "tokens")
    return scratch.keep(rows.groupBy("job").applyInPandas(_job_links(percent), "a long, b long"), "links-2")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, table(spark, sf_dir, "documents"), k=3, percent=90)
