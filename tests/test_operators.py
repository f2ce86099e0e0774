"""Hand-made cases and independent references for what SQL does not cover."""

import bz2
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import canonical_json, fnv1a, named_pairs, nfc
from quarry.operators import access, blocks, graph, induction, postings, retrieval, surfaces, temporal, walkers, walks, writes
from quarry.operators.quantiles import quantiles
from quarry.operators.statistics import chernoff
from quarry.plans.catalogue import QUERIES, SQL
from quarry.sources import readers
from quarry.streaming.folds import ftrl
from tests.compare import compare, duck


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_dense_walk(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("d", "a", 1.0)]
    got = dict(rows(graph.walk(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame([("a", 1.0)], "node string, p double"), 40)))
    names = "abcd"
    m = np.zeros((4, 4))
    for s, t, w in edges:
        m[names.index(s), names.index(t)] = w
    sums = m.sum(1, keepdims=True)
    m = np.divide(m, sums, out=np.zeros_like(m), where=sums > 0)
    p = start = np.array([1.0, 0, 0, 0])
    for _ in range(40):
        moved = p @ m
        p = 0.85 * moved + (0.15 + 0.85 * (1 - moved.sum())) * start
    assert all(abs(got.get(n, 0) - p[i]) < 1e-9 for i, n in enumerate(names))


def test_potentials_over_many_blocks_equal_dense_steps(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 60)
    rng = np.random.default_rng(4)
    edges = [(int(a) * 7 - 90, int(b) * 7 - 90, float(w)) for a, b, w in zip(rng.integers(0, 40, 400), rng.integers(0, 40, 400), rng.integers(1, 4, 400), strict=True) if a != b]
    names = sorted({x for e in edges for x in e[:2]})
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:  # several rows of a pair add up
        i, j = names.index(a), names.index(b)
        m[i, j] += w
        m[j, i] += w
    z = np.zeros((len(names), 2))
    source = np.array([[n % 10 == 0, n % 10 == 5] for n in names], float)
    for _ in range(3):
        z = (source + m @ z) / (m.sum(1, keepdims=True) + 0.08)
    z /= z.max(0)
    assert blocks.colours_for(len(edges)) > 2
    got = rows(graph.potentials(spark.createDataFrame(edges, "a long, b long, w double"), F.pmod("node", F.lit(10)) == 0, F.pmod("node", F.lit(10)) == 5, 3))
    assert sorted(r[:3] for r in got) == [(n, pytest.approx(x, abs=2e-6), pytest.approx(y, abs=2e-6)) for n, (x, y) in zip(names, z.tolist(), strict=True)]


def test_potentials_leave_lines_without_order_apart(spark, tmp_path):
    lines = [(o, p) for o in range(12) for p in (o, o + 1, o + 1, 3 * o % 7)] + [(None, 2), (None, 90), (5, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    bad, n, _, _ = compare(spark, duck(str(tmp_path)), str(tmp_path), "green_potential", QUERIES["green_potential"], SQL["green_potential"])
    assert not bad and n == 13


def test_pairs_of_orders_that_span_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blocks, "LINES", 5)
    lines = sorted((int(o), int(p), int(h), int(d)) for o, p, h, d in np.random.default_rng(1).integers([0, 0, 0, 0], [9, 12, 2, 50], (80, 4)))
    lines = [(o, p * h, h, d) for o, p, h, d in lines]
    lines.sort()
    names = ["o", "p", "has", "day"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines[i : i + 3], strict=True)], names=names) for i in range(0, len(lines), 3)]
    got = sorted(x for a, b, day in blocks.order_pairs(iter(batches)) for x in zip(a.tolist(), b.tolist(), day.tolist(), strict=True))
    want = []
    for o in {x[0] for x in lines}:
        parts, last = sorted({p for q, p, h, _ in lines if q == o and h}), max(d for q, _, _, d in lines if q == o)
        want += [(a, b, last) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    assert got == sorted(want)


def test_second_order_walks_draw_by_weight(spark):
    # from 0 to 1, then back to 0 (p), to 2, which 0 also has (1), or to 3, which it has not (q)
    e = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0), (3, 1, 1.0), (0, 2, 1e-9), (2, 0, 1e-9)]
    edges = spark.createDataFrame([(a, b, m, 0, 4.0, 0.5, 0.0) for a, b, m in e], "src long, dst long, mass double, age int, p double, q double, decay double")
    at = walks.second_order(edges, 4000, 2)[-1].where("start = 0 AND prev = 1").groupBy("node").count()
    got = dict(rows(at))
    n = sum(got.values())
    for node, share in {0: 0.25 / 3.25, 2: 1 / 3.25, 3: 2 / 3.25}.items():
        assert abs(got[node] / n - share) < 0.04


def test_walkers_over_many_blocks_and_odd_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walkers, "BLOCK_EDGES", 60)
    rng = np.random.default_rng(6)
    lines = [(int(o), int(p), int(o) * 3 % 11) for o, p in rng.integers([0, 0], [40, 25], (160, 2))]
    lines += [(None, 3, 1), (None, 77, 1), (5, None, 400), (6, 90, 2), (7, 91, 500)]  # 90 has no type, 91 no row
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, day int").selectExpr("l_orderkey", "l_partkey", "timestamp(date_add(date'2000-01-01', day)) AS l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(p, "abc"[p % 3]) for p in range(25)] + [(77, "a"), (90, None)]
    spark.createDataFrame(parts, "p_partkey long, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    bad, n, _, _ = compare(spark, duck(str(tmp_path)), str(tmp_path), "typed_temporal_walks", QUERIES["typed_temporal_walks"], SQL["typed_temporal_walks"])
    assert not bad and n == 26 * 2 * 4


def test_blocks_get_a_partition_each(spark):
    labels = walkers.labels_for(spark, 13)
    at = spark.createDataFrame([(x,) for x in labels], "block int").repartition(13, "block").groupBy(F.spark_partition_id()).count()
    assert [r[1] for r in rows(at)] == [1] * 13


def test_least_costs_and_unreachable(spark):
    e = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (3, 2, 1), (2, 4, 0), (8, 9, 1)], "src long, dst long, cost long")
    assert sorted(rows(walks.least_costs(e, spark.createDataFrame([(1,)], "node long")))) == [(1, 0, None), (2, 2, 3), (3, 1, 1), (4, 2, 2)]


def test_settle_has_no_better_flip():
    rng = np.random.default_rng(2)
    edges = [(a, b, float(rng.random()), bool(rng.random() < 0.5)) for a in range(8) for b in range(a)]
    at, _, pressure = walks.settle(edges)
    energy = lambda s: sum((c if s[a] == s[b] else -c) * (1 if o else -1) for a, b, c, o in edges)
    assert all(energy({**at, x: 1 - at[x]}) >= energy(at) - 1e-12 for x in at)
    assert pressure == sum(at[a] == at[b] for a, b, _, o in edges if o) / sum(o for *_, o in edges)


def test_components_and_cores(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (8, 9, 1)], "a long, b long, w long")
    assert dict(rows(graph.components(e))) == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert dict(rows(graph.cores(e))) == {1: 2, 2: 2, 3: 2, 4: 1, 8: 1, 9: 1}


def test_flow_and_spectrum():
    assert graph.max_flow([("s", "a", 3), ("s", "b", 2), ("a", "t", 2), ("b", "t", 3), ("a", "b", 1)], "s", "t") == 5
    s = graph.spectrum([[0, 1, 0], [1, 0, 1], [0, 1, 0]])
    assert abs(s["fiedler"] - 1) < 1e-9 and abs(s["largest"] - 3) < 1e-9


def test_boundary_fit_has_no_gradient():
    rng = np.random.default_rng(5)
    x, pos, neg = rng.random((16, 4)) < 0.5, rng.integers(0, 50, 16), rng.integers(0, 200, 16)
    b, w = induction.fit_boundary(x, pos, neg)
    p = 1 / (1 + np.exp(-(b + x @ w)))
    residual = p * (pos + neg) - pos
    assert abs(residual.sum()) < 1e-5
    assert np.abs(x.T @ residual / (pos + neg).sum() + 0.02 * w).max() < 1e-6


def test_populations_are_told_apart():
    x = [[0.0], [1.0]]
    pos = [[5, 90]] * 6 + [[90, 5]] * 6
    neg = [[95, 10]] * 6 + [[10, 95]] * 6
    k, at, cost = induction.populations(x, pos, neg, [i % 3 == 2 for i in range(12)])
    assert k == 2 and len(set(at[:6])) == len(set(at[6:])) == 1 and at[0] != at[6]
    assert cost[2] < cost[1]
    assert induction.populations(x, [[50, 50]] * 8, [[50, 50]] * 8, [i % 4 == 3 for i in range(8)])[0] == 1


def test_complete_link_against_plain_search():
    rng = np.random.default_rng(7)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for least in (0.2, 0.5):
        sets = [set(rng.integers(0, 9, 5).tolist()) for _ in range(14)] + [set(), set()]
        clusters = [[i] for i in range(len(sets))]
        while True:
            pairs = [(min(jaccard(sets[x], sets[y]) for x in a for y in b), -i, -j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j]
            score, i, j = max(pairs)
            if score < least:
                break
            clusters[-i] = clusters[-i] + clusters.pop(-j)
        assert induction.complete_link(sets, least) == [sorted(c) for c in sorted(clusters, key=lambda c: c[0])]
    assert induction.complete_link([], 0.5) == [] and induction.complete_link([{1}], 0.5) == [[0]]


def test_roles_of_two_kinds():
    x = [[1, 1, 1, 0, 0, 0, 1, 0]] * 12 + [[0, 0, 0, 1, 1, 1, 0, 1]] * 12
    k, roles, cost = induction.medoid_roles(x, 5, [i % 4 == 0 for i in range(24)])
    assert k == 2 and len(set(roles[:12])) == 1 and roles[0] != roles[12] and cost[2] < cost[1]


def test_promotion_needs_sources_and_gain(spark):
    seen = [("says", f"s{i}", "x") for i in range(60)] + [("noise", f"s{i}", "xyz"[i % 3]) for i in range(60)] + [("rare", "s1", "x")] + [("other", f"s{i}", "y") for i in range(60)] + [(None, "s1", "x")]
    got = {r["relation"]: r["promoted"] for r in induction.promotions(spark.createDataFrame(seen, "relation string, source string, signature string")).collect()}
    assert got == {"says": True, "noise": False, "rare": False, "other": True}


def test_quantiles_of_ties_nulls_and_skew(spark):
    rng = np.random.default_rng(11)
    groups = {"even": rng.random(5000), "steep": np.exp(rng.normal(0, 12, 5000)), "tied": np.repeat([1.0, 2.0, 1e9], [4000, 1, 2]), "one": np.array([-3.5]), None: np.arange(10.0)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None)]
    qs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(data, "g string, v double").repartition(7), ["g"], "v", qs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g]["q"], np.quantile(vs, qs), rtol=1e-12)
        assert (got[g]["n"], got[g]["n_distinct"]) == (len(vs), len(set(vs.tolist())))
    assert quantiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).count() == 0


def test_triangles_of_a_hub(spark):
    e = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59, 2)]
    got = sorted(rows(graph.triangles_of(spark.createDataFrame(e + e[:3], "a long, b long"))))
    assert got == [(0, i, i + 1) for i in range(1, 59, 2)]


def test_batches_across_runs(spark):
    data = [(s, k, (k * 7) % 13) for s in ("x", None) for k in range(300)]
    got = rows(readers.batches_by_bytes(spark.createDataFrame(data, "source string, k long, n long"), "k", F.col("n"), 50, width=16))
    for s in ("x", None):
        sizes = [n for a, _, n in data if a == s]
        assert sorted((k, b) for a, k, b in got if a == s) == [(k, sum(sizes[:k]) // 50) for k in range(300)]


def test_index_reopened_and_half_written(spark, tmp_path):
    path = str(tmp_path / "index")
    first, second = [(1, "red bolt bolt"), (2, "blue ring"), (3, None), (4, "")], [(5, "red ring red"), (6, "green")]
    docs = lambda data: spark.createDataFrame(data, "doc_id long, text string")
    postings.Postings(spark, path).add(docs(first))
    index = postings.Postings(spark, path)
    assert [r["doc_id"] for r in index.search(["bolt"], 5).collect()] == [1]
    index.add(docs(second))
    whole = dict(rows(index.search(["red", "ring"], 9)))
    plain = retrieval.bm25_parts(docs(first + second), retrieval.query_terms(spark, ["red", "ring"])).groupBy("doc_id").agg(F.round(F.sum("part") / 2, 6))
    assert whole == dict(rows(plain)) and set(whole) == {1, 2, 5}
    # postings without totals are those of a batch that died
    spark.createDataFrame([(9, 1, "red", 1, "dead", 0)], "key long, len long, term string, tf long, batch string, bucket int").withColumn("bucket", postings.bucket_of("term")).write.mode("append").partitionBy("batch", "bucket").parquet(f"{path}/postings")
    assert dict(rows(index.search(["red", "ring"], 9))) == whole
    assert index.search(["absent"], 3).count() == 0 and index.search([], 3).count() == 0


def test_hidden_spans_map_back():
    text = "mail a.b@c.org token=x@y.zz, 12-34-56! é password: p"
    hidden, places = surfaces.hide(text)
    assert hidden == "mail [EMAIL] [SECRET] [NUMBER]! é [SECRET]"
    assert [(text[a:b], hidden[t : t + len(k)]) for a, b, t, k in places] == [("a.b@c.org", "[EMAIL]"), ("token=x@y.zz,", "[SECRET]"), ("12-34-56", "[NUMBER]"), ("password: p", "[SECRET]")]
    for i, c in enumerate(hidden):
        if not any(t <= i < t + len(k) for _, _, t, k in places):
            assert text[surfaces.original_offset(places, i)] == c
    assert surfaces.original_offset(places, 7) == 5 and surfaces.hide("") == ("", [])


def test_cuts_against_all_ways():
    def ways(w):
        return [()] if not w else [(w[:n], *rest) for n in range(1, min(4, len(w)) + 1) for rest in ways(w[n:])]

    rng = np.random.default_rng(4)
    price: dict = {}
    cost = lambda piece: price.setdefault(piece, float(rng.integers(1, 9)) + len(piece) / 8)
    word = "abacabadab"
    every = sorted((sum(cost(p) for p in way), way) for way in ways(word))
    assert [p for _, p in surfaces.best_cuts(word, cost, 5)] == [p for _, p in every[:5]]
    mass = sum(2**-c for c, _ in every)
    for i, chance in enumerate(surfaces.cut_marginals(word, cost), 1):
        assert abs(chance - sum(2**-c for c, way in every if i in np.cumsum([len(p) for p in way])) / mass) < 1e-12
    assert surfaces.cut_marginals("", cost) == [] and surfaces.best_cuts("", cost, 3) == [(0.0, ())]


def test_tree_decomposition_and_labels():
    from itertools import product

    rng = np.random.default_rng(9)
    for _ in range(6):
        pairs = {(a, b): float(rng.normal()) for a in range(8) for b in range(a) if rng.random() < 0.4}
        bags = walks.tree_decomposition(list(pairs))
        assert all(any(a in nodes and b in nodes for _, nodes, _ in bags) for a, b in pairs)
        for x in {n for e in pairs for n in e}:
            held = [i for i, nodes, _ in bags if x in nodes]
            assert sum(bags[i][2] not in held for i in held) == 1  # one connected subtree
        energy, labels = walks.least_labels(pairs, 2)
        value = lambda s: sum(w if s[a] != s[b] else -w for (a, b), w in pairs.items())
        nodes = sorted(labels)
        least = min(value(dict(zip(nodes, states, strict=True))) for states in product((0, 1), repeat=len(nodes)))
        assert abs(energy - least) < 1e-9 and abs(value(labels) - least) < 1e-9


def test_f_survival():
    # F(1, n) is the square of Student's t: P(F > 1) with one and one degrees is one half
    assert abs(temporal.f_survival(1.0, 1, 1) - 0.5) < 1e-9
    assert abs(temporal.f_survival(4.0, 2, 2) - 0.2) < 1e-9
    assert temporal.f_survival(0.0, 3, 5) == 1.0


def test_granger_finds_the_cause():
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.1 * rng.normal(size=300)
    assert temporal.granger(x, y, 1)[1] < 1e-6 < temporal.granger(y, x, 1)[1]


def test_chernoff():
    assert abs(chernoff([0.5, 0.5], [0.5, 0.5])) < 1e-9
    assert chernoff([0.9, 0.1], [0.1, 0.9]) == pytest.approx(-math.log(2 * math.sqrt(0.09)), abs=1e-6)


def test_cosine_and_jaccard_of_nothing(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows(df.select(retrieval.cosine(F.col("a"), F.col("b"))))] == [0.0, 1.0]
    empty = spark.range(1).select(retrieval.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert rows(empty) == [(1.0,)]


def test_text_functions(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [0.0, {"d": 2, "c": "é"}]}', "é\r\nx")], "j string, t string")
    assert rows(df.select(canonical_json(F.col("j")), nfc(F.col("t")))) == [('{"a":[0,{"c":"é","d":2}],"b":1}', "é\nx")]
    assert rows(spark.createDataFrame([("a",), ("",)], "s string").select(fnv1a(F.col("s")))) == [(0xE40C292C,), (0x811C9DC5,)]


def test_writes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "e"), (3, "d")], "k long, v string")
    assert sorted(rows(writes.insert_ignore(old, new, ["k"]))) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(rows(writes.upsert_changed(old, new.where("v <> 'd'"), "k"))) == [(1, "a", "kept"), (2, "c", "updated"), (3, "e", "inserted")]


def test_asof(spark):
    left = spark.createDataFrame([("k", 5, 1, None), ("k", 1, 2, None)], "k string, t long, id long, v long")
    right = spark.createDataFrame([("k", 2, None, 20), ("k", 5, None, 50), ("j", 1, None, 9)], "k string, t long, id long, v long")
    assert sorted(rows(temporal.latest_before(left, right, "k", "t", "id", "v"))) == [(1, 50), (2, None)]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.9)], "n string, p double")
    assert {r[0]: r[2] for r in rows(temporal.bh(df, "p", 0.1))} == {"a": True, "b": True, "c": False}


def test_ftrl_learns():
    w = ftrl([([("x", 1.0)], 1.0), ([("y", 1.0)], 0.0)] * 200)
    assert w["x"] > 0.5 and w["y"] < -0.5


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("| x | y |\n|---|---|\n| 1 | 2 |\n")
    (tmp_path / "d" / "b.bin").write_bytes(bytes(range(32)) * 20)
    (tmp_path / "d" / "c.pdf").write_bytes(b"%PDF-1.7 ...")
    kinds = {r["path"][-5:]: r["media_type"] for r in readers.walk_files(spark, str(tmp_path / "d"), 10_000).collect()}
    assert kinds == {"/a.md": "text/markdown", "b.bin": "application/octet-stream", "c.pdf": "application/pdf"}
    assert readers.walk_files(spark, str(tmp_path / "d"), 20).count() == 1
    md = spark.createDataFrame([(1, (tmp_path / "d" / "a.md").read_text())], "doc_id long, text string")
    assert [r[2] for r in rows(readers.markdown_rows(md))] == [["x", "y"], ["1", "2"]]
    (tmp_path / "s.csv").write_text('a;b\n"x;y";2\n')
    assert rows(readers.read_delimited(spark, str(tmp_path / "s.csv"))) == [("x;y", "2")]
    text = spark.createDataFrame([(b"\xff\xfeh\x00i\x00",), ("﻿a\r\nb\0".encode(),)], "c binary").select(readers.decode_text(F.col("c")))
    assert rows(text) == [("hi",), ("a\nb ",)]


def test_wiki_dump(spark, tmp_path):
    pages = "<page><title>A</title><ns>0</ns><id>1</id><revision><text xml:space='preserve'>Body of A</text></revision></page>"
    pages += "<page><title>B</title><ns>0</ns><id>2</id><redirect title='A'/><revision><text xml:space='preserve'>#R</text></revision></page>"
    pages += "<page><title>T</title><ns>1</ns><id>3</id><revision><text xml:space='preserve'>talk</text></revision></page>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(f"<mediawiki>{pages}</mediawiki>".encode()))
    assert rows(readers.read_wiki_dump(spark, str(tmp_path / "dump.xml.bz2"))) == [(1, "A", "Body of A")]


def test_gutenberg_comments_logs_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny", "a = 1  # one\n/* two */ b // three")], "t string, c string")
    assert rows(df.select(readers.strip_boilerplate(F.col("t")), readers.comments_of(F.col("c")))) == [("body", ["one", "two", "three"])]
    log = readers.parse_logs(spark.createDataFrame([("2024-01-01T00:00:00Z [WARN] db.pool: slow id=7 ms=12",), ("noise",)], "value string"))
    assert rows(log) == [("2024-01-01T00:00:00Z", "WARN", "db.pool", "slow id=7 ms=12", {"id": "7", "ms": "12"})]
    readers.write_jsonl(spark.createDataFrame([(1, "a")], "k long, v string"), str(tmp_path / "j"))
    assert rows(readers.read_jsonl(spark, str(tmp_path / "j"), "k long, v string")) == [(1, "a")]


def pairs_of(spark, sf_dir, least):
    return [(r["a"], r["b"]) for r in graph.copurchase(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), least).collect()]


def test_core_numbers_whole(spark, sf_dir):
    near = {}
    for a, b in pairs_of(spark, sf_dir, 2):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, k = {}, 0
    while near:
        x = min(near, key=lambda n: len(near[n]))
        k = max(k, len(near[x]))
        want[x] = k
        for y in near.pop(x):
            near[y].discard(x)
    assert max(want.values()) > 12
    assert dict(rows(graph.core_numbers(spark, sf_dir))) == want


def test_components_whole(spark, sf_dir):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs_of(spark, sf_dir, 2):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert dict(rows(graph.components_query(spark, sf_dir))) == {x: find(x) for x in list(root)}


def test_heavy_hitters_many_tasks(spark):
    """Items at the border, in tasks of unlike contents, against a plain count."""
    import collections
    import random

    rng = random.Random(2)
    data = [f"i{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(30_000)]
    df = spark.createDataFrame([(x,) for x in sorted(data)], "item string").repartition(9)
    want = {x: n for x, n in collections.Counter(data).items() if n * 40 > len(data)}
    assert want and dict(rows(access.frequent(df, 40))) == want
    assert access.frequent(df.limit(0), 40).count() == 0


def test_compare_and_set(spark):
    state = spark.createDataFrame([(1, 0, 5), (2, 3, 6), (3, 0, 7)], "id long, revision int, value int")
    asked = spark.createDataFrame([(1, 0, 50, 2), (1, 0, 51, 1), (2, 2, 60, 3), (9, 0, 1, 4)], "id long, expected int, value int, op long")
    assert sorted(map(tuple, access.swap(state, asked).collect())) == [(1, 1, 51, 1), (2, 3, 6, 1), (3, 0, 7, 0)]


def test_topological_reports_cycles(spark):
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 9), (1, 9), (5, 6), (6, 7), (7, 5), (7, 8)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    got = dict(rows(access.topological(nodes, spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {1: 0, 10: 0, 2: 1, 3: 1, 4: 2, 9: 3, 5: None, 6: None, 7: None, 8: None}


def test_pairs_of_names_measure_each_name_pair_once(spark, tmp_path):
    """Pairs of parts of many keys, repeated keys and no name, as the SQL gives them; names are measured once a pair of names, not of parts."""
    parts = [(i, "hot bolt" if i % 3 else "old ring", "B1", 1) for i in range(700)] + [(5, "cold bolt", "B1", 1), (5, "hot bolt", "B1", 1), (900, None, "B1", 1), (901, None, "B1", 1), (902, "x", "B1", None), (None, "x", "B1", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duck(str(tmp_path))
    for name in ("bounded_edit_distance", "edit_programs"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT count(*), sum(a * 7 + b * 13), sum((a * 7 + b * 13) * coalesce({got.columns[2]}, 99)) FROM ({SQL[name]})").fetchone()
        assert tuple(got.selectExpr("count(*)", "sum(a * 7 + b * 13)", f"sum((a * 7 + b * 13) * coalesce({got.columns[2]}, 99))").first()) == tuple(map(int, want))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x, y):
        calls.add(1)
        return 0

    named_pairs(spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int"), counted("x", "y").alias("m")).agg(F.sum("m")).collect()
    assert 0 < calls.value <= 20


def test_cosine_cells_on_odd_vectors(spark, tmp_path, monkeypatch):
    """Searches by blocks of both sides and slices: copies tie by id, vectors of zeros, missing ones and missing components score 0."""
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(size=4)] for _ in range(60)]
    data = [(i, vectors[i % 50], i % 3) for i in range(100)] + [(100, [0.0] * 4, 0), (101, None, 0), (120, [1.0, None, 2.0, 3.0], 0), (140, None, 1)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, size in (("CELL_ROWS", 30), ("CELL_ASKED", 3), ("SLICE", 2)):
        monkeypatch.setattr(retrieval, name, size)
    calls = []
    monkeypatch.setattr(retrieval, "in_blocks", lambda *a, **b: calls.append(a))
    got = rows(QUERIES["vector_topk"](spark, str(tmp_path)))
    f32 = lambda v: None if v is None or None in v else np.asarray(v, np.float32).astype(float)

    def cos(a, b):
        a, b = f32(a), f32(b)
        n = 0 if a is None or b is None else np.sqrt(a @ a) * np.sqrt(b @ b)
        return round(float(a @ b / n), 6) + 0.0 if n else 0.0

    want = [(q, i, s) for q, v, _ in data if q % 20 == 0 for s, i in sorted(((cos(v, w), i) for i, w, _ in data if i != q), key=lambda x: (-x[0], x[1]))[:10]]
    assert sorted(got) == sorted(want)
    least = {}
    for q, v, _ in data:
        for i, w, _ in data:
            c = cos(v, w)
            if q % 20 == 0 and i % 20 and c >= 0.2:
                least[i] = max(least.get(i, (0.0,)), (round(c / (1 + q % 7) * 0.5, 6), -q, c))
    best = sorted(((-w, -c, i, -a) for i, (w, a, c) in least.items() if w > 0))[:24]
    assert rows(QUERIES["seed_expansion"](spark, str(tmp_path)).select("vec_id", "anchor", "cosine")) == [(i, a, -c) for _, c, i, a in best]
    assert not calls


def test_triangles_by_colours_shuffle_no_candidates(spark, monkeypatch):
    """Many colours and small steps give all triangles once, and the plan that finds them has no exchange."""
    rng = np.random.default_rng(7)
    e = sorted({(int(min(x)), int(max(x))) for x in rng.integers(0, 60, (500, 2)) if x[0] != x[1]} | {(0, i) for i in range(1, 60)})
    near = {x: {b for a, b in e if a == x} for x in range(60)}
    want = sorted((a, b, c) for a, b in e for c in near[a] & near[b])
    monkeypatch.setattr(graph, "TASK_EDGES", 100)
    df = graph.triangles_of(spark.createDataFrame(e + e[:9], "a long, b long"))
    assert sorted(rows(df)) == want
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_triangles_run_in_a_task_for_each_three_colours(spark, monkeypatch):
    """A union of plans of one partition must not become one task."""
    e = [(a, b) for a in range(30) for b in range(a + 1, 30)]
    monkeypatch.setattr(graph, "TASK_EDGES", 100)
    df = graph.triangles_of(spark.createDataFrame(e, "a long, b long"))
    colours = int(np.ceil((6 * len(e) / 100) ** 0.5))
    assert df.rdd.getNumPartitions() >= colours * (colours + 1) * (colours + 2) // 6
    assert df.count() == 30 * 29 * 28 // 6


def test_triangles_of_odd_lines(spark, monkeypatch):
    """Missing keys, parts twice in an order, orders twice over, keys at the ends of long."""
    far = 2**63 - 1
    orders = {1: [5, 5, -7, far, None], 2: [5, -7], None: [1, 2, 3], 3: [-7, -far, 9], 4: [9, 5], 5: [4], 6: [None, None]}
    data = [(o, p) for o, ps in orders.items() for p in ps]
    e = {(a, b) for o, ps in orders.items() if o is not None for a in ps for b in ps if None not in (a, b) and a < b}
    want = sorted((a, b, c) for a, b in e for x, c in e if x == b and (a, c) in e)
    lines = spark.createDataFrame(data, "l_orderkey long, l_partkey long")
    for edges in (100, 2):
        monkeypatch.setattr(graph, "TASK_EDGES", edges)
        assert sorted(rows(graph.triangles_of_orders(lines))) == want
    assert graph.triangles_of_orders(lines.where("false")).count() == 0


def test_triangles_met_in_small_steps(monkeypatch):
    """Steps smaller than an edge's candidates, and marks for one node at a time, lose and repeat none."""
    rng = np.random.default_rng(3)
    e = sorted({(int(min(x)), int(max(x))) for x in rng.integers(0, 80, (700, 2)) if x[0] != x[1]} | {(40, i) for i in range(41, 80)})
    near = {x: {b for a, b in e if a == x} for x in range(80)}
    want = sorted((a, b, c) for a, b in e for c in near[a] & near[b])
    a, b = (np.array(x) for x in zip(*e, strict=True))
    for colours, tried, marks in ((1, 1, 1), (2, 7, 100), (3, 100_000, 4_000_000)):
        monkeypatch.setattr(graph, "TRIED", tried)
        monkeypatch.setattr(graph, "MARKS", marks)
        pairs = blocks.table_of("a binary, b binary", [(blocks.pack(a), blocks.pack(b))] * 2)
        dealt = pa.Table.from_batches(graph._coloured(colours)(pairs.to_batches()))
        held = [graph._held(colours)(dealt.filter(pc.equal(dealt["block"], x))) for x in dealt["block"].unique()]
        got = []
        for i in range(colours):
            for j in range(i, colours):
                for k in range(j, colours):
                    mine = [x for x in held if (x["p"][0].as_py(), x["q"][0].as_py()) in {(i, j), (i, k), (j, k)}]
                    for batch in graph._closed(i, j, k)(y for x in mine for y in x.to_batches()):
                        got += [tuple(r.values()) for r in batch.to_pylist()]
        assert sorted(got) == want
