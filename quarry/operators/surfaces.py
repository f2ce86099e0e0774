"""What the surface of texts gives away: anchors, hidden spans with their offsets, spacing by script, suffixes, ways to cut a word."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import SECRETS
from quarry.plans.registry import query, table, texts

#: kinds of anchors, in the order in which they claim a place
ANCHORS = [("url", r"https?://[^\s<>]+"), ("date", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), ("code", r"`[^`\n]+`"), ("number", r"\b[0-9]+(?:[.,][0-9]+)?\b")]


def anchors_of(text: Column) -> Column:
    """An array of (kind, anchor): each kind is sought in what the kinds before it left."""
    out, rest = [], text
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("anchor"))
    for kind, pattern in ANCHORS:
        out.append(F.transform(F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1)), named(kind)))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.flatten(F.array(*out))


def _anchors() -> str:
    out, rest = [], "text"
    for kind, pattern in ANCHORS:
        out.append(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all({rest}, '{pattern}')) AS anchor FROM documents")
        rest = f"regexp_replace({rest}, '{pattern}', ' ', 'g')"
    return "WITH a AS (" + " UNION ALL ".join(out) + ") SELECT doc_id, kind, anchor, count(*) AS n FROM a GROUP BY 1, 2, 3"


@query("anchors", "X14", _anchors())
def anchors(spark, d):
    rows = texts(spark, d).select("doc_id", F.explode(anchors_of(F.col("text"))).alias("x"))
    return rows.groupBy("doc_id", "x.kind", "x.anchor").agg(F.count("*").alias("n"))


def hide(text: str) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The text with its secrets hidden, and the spans hidden as (start, end, start in the result, kind): spans of all patterns that touch or overlap are one, of the kind that comes first in the text, then in the patterns."""
    spans = sorted((m.start(), i, m.end(), kind) for i, (pattern, kind) in enumerate(SECRETS) for m in re.finditer(pattern, text, re.ASCII) if m.end() > m.start())
    merged: list[list] = []
    for start, _, end, kind in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at, size, places = [], 0, 0, []
    for start, end, kind in merged:
        out += [text[at:start], kind]
        size += start - at
        places.append((start, end, size, kind))
        size, at = size + len(kind), end
    return "".join([*out, text[at:]]), places


def original_offset(places: list[tuple[int, int, int, str]], offset: int) -> int:
    """Where a place in the result lies in the text; inside a hidden span, its start."""
    shift = 0
    for start, end, there, kind in places:
        if offset < there:
            break
        if offset < there + len(kind):
            return start
        shift = end - there - len(kind)
    return offset + shift


@query("hidden_spans", "X11")
def hidden_spans(spark, d):
    """(doc_id, start, stop, at, kind): what redaction hides in whole texts, with the place in the result; Arrow batches, a text at a time."""

    def find(batches):
        for pdf in batches:
            rows = [(i, *p) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for p in hide(t)[1]]
            yield pdf.__class__(rows, columns=["doc_id", "start", "stop", "at", "kind"])

    return texts(spark, d).where("text IS NOT NULL").select("doc_id", "text").mapInPandas(find, "doc_id long, start long, stop long, at long, kind string")


#: scripts told apart, by their Unicode names
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Han", "Thai", "Arabic"]


@query(
    "script_spacing",
    "X02",
    "WITH s AS ("
    + " UNION ALL ".join(
        f"SELECT '{s}' AS script, lang, sum(len(regexp_extract_all(text, '\\p{{{s}}}')))::BIGINT AS letters, sum(len(regexp_extract_all(text, '\\p{{{s}}}+')))::BIGINT AS runs, sum(len(regexp_extract_all(regexp_replace(text, '\\p{{{s}}}+', 'x', 'g'), 'x ')))::BIGINT AS spaced FROM documents GROUP BY 2"
        for s in SCRIPTS
    )
    + ") SELECT script, lang, letters, runs, round(spaced / runs, 6) AS space_share, round(letters / runs, 6) AS mean_run FROM s WHERE runs > 0",
)
def script_spacing(spark, d):
    return spacing(texts(spark, d), "lang")


def spacing(docs: DataFrame, by: str) -> DataFrame:
    """(script, by, letters, runs, space_share, mean_run): how a script spaces its words, learned from texts: letters a run, and the share of runs that a space follows. A run stands as one mark, which Latin text shares with its own x."""
    cells = []
    for s in SCRIPTS:
        p = rf"\p{{Is{s}}}"
        marked = F.regexp_replace("text", p + "+", "x")
        cells.append(F.struct(F.lit(s).alias("script"), F.regexp_count("text", F.lit(p)).alias("letters"), F.regexp_count("text", F.lit(p + "+")).alias("runs"), F.regexp_count(marked, F.lit("x ")).alias("spaced")))
    rows = docs.select(by, F.explode(F.array(*cells)).alias("x")).groupBy("x.script", by).agg(F.sum("x.letters").alias("letters"), F.sum("x.runs").alias("runs"), F.sum("x.spaced").alias("spaced"))
    return rows.where("runs > 0").select("script", by, "letters", "runs", F.round(F.col("spaced") / F.col("runs"), 6).alias("space_share"), F.round(F.col("letters") / F.col("runs"), 6).alias("mean_run"))


@query(
    "suffix_morphology",
    "N11",
    """WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM documents WHERE lang IS NOT NULL), s AS (SELECT lang, right(w, k) AS suffix, left(w, length(w) - k) AS stem FROM w, (SELECT unnest([2, 3]) AS k)),
m AS (SELECT lang, stem, count(*) AS forms FROM s GROUP BY 1, 2), c AS (SELECT lang, suffix, count(*) AS stems, count(*) FILTER (forms > 1) AS shared FROM s JOIN m USING (lang, stem) GROUP BY 1, 2),
t AS (SELECT suffix, sum(stems) AS every FROM c GROUP BY 1), l AS (SELECT lang, sum(stems) AS n FROM c GROUP BY 1), g AS (SELECT sum(stems) AS total FROM c)
SELECT lang, suffix, stems, shared, round(ln(stems * total / (every * n)), 6) AS pmi FROM c JOIN t USING (suffix) JOIN l USING (lang), g WHERE stems >= 5 AND shared >= 2""",
)
def suffix_morphology(spark, d):
    words = texts(spark, d).where("lang IS NOT NULL").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("w")).distinct()
    return suffixes(words, 5, 2)


def suffixes(words: DataFrame, least: int, shared: int) -> DataFrame:
    """(lang, suffix, stems, shared, pmi): endings of two and three letters of distinct words (lang, w), with the stems they follow, those that take another ending too, and how much a language prefers the ending. Seeds of classes: constructions and translations are not induced."""
    cut_at = lambda k: F.struct(F.substr("w", F.length("w") - k + 1, F.lit(k)).alias("suffix"), F.substr("w", F.lit(1), F.length("w") - k).alias("stem"))
    s = words.select("lang", F.explode(F.array(cut_at(2), cut_at(3))).alias("x")).select("lang", "x.suffix", "x.stem")
    forms = s.groupBy("lang", "stem").agg(F.count("*").alias("forms"))
    c = s.join(forms, ["lang", "stem"]).groupBy("lang", "suffix").agg(F.count("*").alias("stems"), F.count_if(F.col("forms") > 1).alias("shared"))
    every, n = c.groupBy("suffix").agg(F.sum("stems").alias("every")), c.groupBy("lang").agg(F.sum("stems").alias("n"))
    total = F.broadcast(c.agg(F.sum("stems").alias("total")))  # one row
    pmi = F.round(F.log(F.col("stems") * F.col("total") / (F.col("every") * F.col("n"))), 6)
    return c.join(every, "suffix").join(n, "lang").crossJoin(total).where((F.col("stems") >= least) & (F.col("shared") >= shared)).select("lang", "suffix", "stems", "shared", pmi.alias("pmi"))


def best_cuts(word: str, cost, k: int, longest: int = 4) -> list[tuple[float, tuple[str, ...]]]:
    """The k least sums of cost(piece) over ways to cut a word, least first, ties by pieces."""
    best: list[list] = [[(0.0, ())]] + [[] for _ in word]
    for j in range(1, len(word) + 1):
        ways = [(c + cost(word[i:j]), (*p, word[i:j])) for i in range(max(0, j - longest), j) for c, p in best[i]]
        best[j] = sorted(ways)[:k]
    return best[-1]


def cut_marginals(word: str, cost, longest: int = 4) -> list[float]:
    """The chance of a cut before each inner letter, ways weighing 2 to the minus their cost, by sums forward and backward."""
    n = len(word)
    weight = {(i, j): 2.0 ** -cost(word[i:j]) for j in range(1, n + 1) for i in range(max(0, j - longest), j)}
    ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        ahead[j] = sum(ahead[i] * weight[i, j] for i in range(max(0, j - longest), j))
    for i in range(n - 1, -1, -1):
        back[i] = sum(weight[i, j] * back[j] for j in range(i + 1, min(n, i + longest) + 1))
    return [ahead[i] * back[i] / ahead[n] for i in range(1, n)] if n and ahead[n] else []


@query("segment_kbest", "L10 N12")
def segment_kbest(spark, d):
    """The three best cuts of each distinct word of part names and the chance of each inner boundary, pieces priced by their letters' counts: the model is an alphabet's size."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    letters = words.select(F.explode(F.split("w", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()  # an alphabet
    total = sum(r["n"] for r in letters)
    bits = {r["c"]: -math.log2(r["n"] / total) for r in letters}

    def cut_all(batches):
        cost = lambda piece: 6.0 + 0.8 * sum(bits[c] for c in piece)
        for pdf in batches:
            rows = []
            for w in pdf["w"]:
                chances = "|".join(f"{x:.4f}" for x in cut_marginals(w, cost))
                rows += [(w, r, "+".join(p), round(c, 6), chances) for r, (c, p) in enumerate(best_cuts(w, cost, 3), 1)]
            yield pdf.__class__(rows, columns=["w", "rank", "pieces", "bits", "chances"])

    return words.where("w <> ''").distinct().mapInPandas(cut_all, "w string, rank int, pieces string, bits double, chances string")
