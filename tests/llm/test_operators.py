"""The ten operators against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import html as html_mod
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, html_tree, jaccard_join, mixing, neighbours, packing, quality_classifier, quality_rules, substring_dedup, warc
from quarry.llm.common import Scratch, components
from tests.compare import compare, duck
from tests.llm import helpers

DOC = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdefghijkl", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed=0):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def swap(text, at):
    w = text.split()
    w[at % len(w)] = "changedword"
    return " ".join(w)


LONG = prose(30_000, 77)
BASE = prose(300, 1)
PASSAGE = prose(60, 2)
ODD = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, swap(BASE, 100), "en", None, 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n ", "en", "b", 3),
    (7, "one two", "en", "b", 7), (8, "One TWO", "de", "b", 7), (9, prose(80, 3) + " " + PASSAGE + "\n" + prose(80, 4), "en", "b", 9), (10, prose(90, 6) + "\t" + PASSAGE + " " + prose(20, 7), "fr", "c", 9),
    (11, LONG, "en", "c", 9), (12, LONG + " tail", "en", "c", 9), (13, "x " * 200, "en", "a", 9), (14, "é | ### é\né | ### é\n", "es", "é", 9), (15, swap(swap(BASE, 10), 200), "en", "a", 1),
    (16, "<|im_end|> <\\|x|> \\n", "en", "a", 1), (17, "a b\x0bc\x0cd\re f", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def clashing(df):
    """Extra columns with names that the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("score", "size", "key", "n", "h", "token", "kind", "copies", "_w", "id", "rep", "component", "payload", "v")})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (9, 1), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = components(Scratch(spark, "t"), spark.createDataFrame(e, "a long, b long"), "c").collect()
    assert {r[0]: r[1] for r in got} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert len(got) == 11


def test_neighbours_recall_and_order(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {}
    for r in neighbours.op1(spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = rows.orderBy("vec_id").toPandas()
    ids, m = x["vec_id"].to_numpy(), np.stack(x["embedding"]).astype(float)
    recall = []
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(score - s[ids == v][0]) < 1e-9 for _, v, score in own)
        assert [(-round(c, 12), v) for _, v, c in own] == sorted((-round(c, 12), v) for _, v, c in own)
        recall.append(len(best & {v for _, v, _ in own}) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_odd(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [0.0, 0.0, 0.0], 1), (3, None, 1), (4, [1.0, None, 0.0], 1), (5, [float("nan"), 1.0, 0.0], 1), (6, [0.5, 0.5, 0.0], None), (7, [1.0, 0.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1)]
    df = clashing(spark.createDataFrame(rows, kind)).drop("v")
    got = neighbours.search(spark, df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (7, 1.0), (6, 0.5)]
    assert neighbours.search(spark, df.limit(0), df.limit(0)).count() == 0


def test_neighbours_hash_recall(spark):
    """Clustered vectors, more than 20,000: recall at a probe count that reads few rows, with one rotation a hash and with two."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(600, 32))
    x = (np.repeat(centres, 40, axis=0) + 0.25 * rng.normal(size=(24_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(8)
    asked = df.where("vec_id % 400 = 0")
    for polytopes, most in ((1, 0.2), (2, 0.03)):
        hashes = neighbours.CrossPolytope(32, neighbours.TABLES, polytopes)
        probes = neighbours.fitted_probes(neighbours.usable(df), neighbours.usable(asked), hashes, 20)
        codes, queries = np.stack(hashes.bucket(x)), x[::400]
        read = np.zeros((len(queries), len(x)), bool)
        for own, code in zip(hashes.probes(queries, probes), codes, strict=True):
            for q, buckets in enumerate(own):
                read[q] |= np.isin(code, buckets)
        assert probes < hashes.buckets // 8 and read.mean() < most
        got = {}
        for r in neighbours.search(spark, df, asked, polytopes=polytopes).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        m, recall = x.astype(float), []
        for q in range(0, len(x), 400):
            score = m @ m[q]
            score[q] = -np.inf
            recall.append(len(set(np.argsort(-score)[:20].tolist()) & got[q]) / 20)
        assert np.mean(recall) >= 0.9


def test_neighbours_mixed_lengths(spark):
    rows = [(i, [1.0, float(i)]) for i in range(6)] + [(10, [2.0]), (11, [1.0, 2.0, 3.0]), (12, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(spark, df, df).collect()
    assert {r["query_id"] for r in got} | {r["vec_id"] for r in got} == set(range(6)) and len(got) == 30
    single = neighbours.search(spark, df.where("vec_id = 10 OR vec_id = 12"), df).collect()
    assert single == []


def test_neighbours_blocks(spark):
    """A bucket in many blocks, and queries in many parts, give what one block gives."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    a = neighbours.search(spark, df, df.where("vec_id % 20 = 0"), k=5, block=8).collect()
    b = neighbours.search(spark, df, df.where("vec_id % 20 = 0"), k=5, block=100_000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def check_repeats(spark, df):
    rows = texts(df)
    want = sorted((str(i), *x) for (i, _), x in zip(rows, helpers.repeats([t for _, t in rows]), strict=True))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark, df).collect())
    assert got == want


def test_substring_dedup(spark, docs):
    check_repeats(spark, docs)


def test_substring_dedup_odd(spark, odd, none):
    check_repeats(spark, clashing(odd))
    check_repeats(spark, odd.unionByName(odd.where("doc_id IN (4, 9, 11)")).unionByName(spark.createDataFrame([(None, PASSAGE, "en", "a", 1)], DOC)))
    assert substring_dedup.remove_repeats(spark, none).count() == 0


def test_substring_text(spark):
    df = spark.createDataFrame([(1, "keep  this\n" + PASSAGE + "\n and\tthat", "en", "a", 1), (2, PASSAGE, "en", "a", 1)], DOC)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark, df).collect()}
    assert got == {1: "keep  this\nand\tthat", 2: ""}


def test_fingerprint_index(spark, tmp_path):
    path, kind = f"file://{tmp_path}/i", "k long, n int"
    index = substring_dedup.FingerprintIndex(spark, path, ["k"], fan_in=2)
    index.add(spark.createDataFrame([(1, 1), (2, 1), (2, 1)], kind))
    assert {r["k"]: r["known"] for r in index.known(spark.createDataFrame([(2, 1), (5, 1)], kind)).collect()} == {2: True, 5: False}
    index.add(spark.createDataFrame([(1, 1), (7, 1)], kind))
    assert {r[0] for r in index.repeated().collect()} == {1, 2} and sorted(index.levels.values()) == [0, 0]
    index.add(spark.createDataFrame([(7, 1), (8, 1)], kind))
    assert sorted(index.levels.values()) == [0, 1] and len(list((tmp_path / "i").iterdir())) == 2
    again = substring_dedup.FingerprintIndex(spark, path, ["k"], fan_in=2)
    assert again.levels == index.levels and {r[0] for r in again.repeated().collect()} == {1, 2, 7}
    plan = again.known(spark.createDataFrame([(8, 1)], kind))._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan


def test_substring_days(spark, docs, odd, tmp_path):
    """A day judged against an index of the days before gets what one run over all of them gives its rows."""
    every = docs.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text"))
    day = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    whole = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark, every, with_text=False).collect()}
    path, upto = f"file://{tmp_path}/days", []
    for i in range(3):
        upto.append(i)
        want = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark, every.where(day.isin(upto)), with_text=False).collect()}
        got = substring_dedup.remove_repeats(spark, every.where(day == i), index=path).collect()
        assert len(got) == every.where(day == i).count()
        assert all(want[r["doc_id"]] == (r["n_removed"], r["kept_sha256"]) for r in got)
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} <= whole


def test_chat_against_sql(spark, sf_dir):
    bad, n, _, _ = compare(spark, duck(sf_dir), sf_dir, "op3", chat.op3, chat.SQL)
    assert not bad and n > 1


def test_chat_markers_in_roles_and_texts():
    for role in ("us\ufdd0er", "\ufdd0", "\ufdd1\ufdd0", "user"):
        turns = [(role, "hello \ufdd0"), ("assistant", "\ufdd0\ufdd1"), (role, ""), ("assistant", role)]
        x = chat.format_conversation(turns)
        assert x["turns"] == turns and x["loss_text"] == turns[1][1] + turns[3][1]


def test_chat_odd(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "<", "|", "", "a\nb", "<|im_end|>\n<|im_start|>assistant\n"]
    for x in nasty:
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)
        assert chat.unescape_role(chat.escape_role(x)) == x and "\n" not in chat.escape_role(x)
    rows = [(1, 1, "assistant", nasty[7]), (1, 0, "user", None), (1, None, None, "first"), (None, 0, "assistant", "x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (3, 0, "rôle\n", "y" * 200_000)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    turns = {1: [("", "first"), ("user", ""), ("assistant", nasty[7])], None: [("assistant", "x")], 2: [("assistant", "same")] * 2, 3: [("rôle\n", "y" * 200_000)]}
    for c, t in turns.items():
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        loss = "".join(b for a, b in t if a == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_detects_rewriting():
    def hides_old(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))

    with pytest.raises(chat.RewritesHistory):
        chat.spans(hides_old, [("user", "hello"), ("assistant", "there")])


@pytest.mark.parametrize("k,percent,block", [(3, 90, 256), (5, 80, 256), (3, 90, 3)])
def test_jaccard_join(spark, docs, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark, docs, k, percent).collect()}
    assert got == helpers.groups(texts(docs), k, percent)


def test_jaccard_join_chains(spark):
    """Copies that drift a word at a time: links are found though most pairs are far apart."""
    text, rows = prose(120, 9), []
    for i in range(30):
        rows.append((100 - i, text, "en", "a", 1))
        text = swap(text, 7 * i + 3)
    df = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark, df, 3, 90).collect()}
    assert got == helpers.groups([(r[0], r[1]) for r in rows], 3, 90)


def test_jaccard_join_many_near_copies(spark, monkeypatch):
    """Hundreds of near copies around the limit, in parts that meet many others, and frequent passages in texts of all sizes."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng, text, rows = random.Random(3), prose(150, 21), []
    for i in range(260):
        words = text.split()
        for at in rng.sample(range(len(words)), rng.randint(1, 6)):
            words[at] = f"w{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(words), "en", "a", 1))
    rows += [(2000 + i, prose(5 + i % 40, i) + " " + PASSAGE, "en", "a", 1) for i in range(80)]
    df = spark.createDataFrame(rows, DOC).repartition(7)
    for k, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark, df, k, percent).collect()}
        assert got == helpers.groups([(r[0], r[1]) for r in rows], k, percent)


def test_jaccard_join_clashing_ids(spark):
    """A doc_id with two texts joins what each of them is linked with."""
    a, b = prose(60, 31), prose(60, 32)
    rows = [(1, a), (2, a + " z"), (2, b), (3, b + " y"), (4, b + " q"), (5, prose(60, 33))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in order], DOC)
        got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.join(spark, df, 3, 90).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_jaccard_join_odd(spark, odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark, clashing(odd), 3, 90).collect()}
    assert got == helpers.groups(texts(odd), 3, 90)
    again = jaccard_join.join(spark, odd.unionByName(odd).unionByName(spark.createDataFrame([(None, BASE, "en", "a", 1)], DOC)), 3, 90).collect()
    assert len(again) == 2 * len(ODD) + 1 and {r["doc_id"]: r["component_id"] for r in again if r["doc_id"]} == {i: c for i, (_, c) in got.items()}
    assert jaccard_join.join(spark, none).count() == 0


@pytest.fixture(scope="module")
def html_model():
    return html_tree.train(html_tree.training_pages())


FIRST, SECOND = "First paragraph of the story, long enough to count as text of the article.", "Second paragraph that goes on for a while, as texts do."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p title=don't>{}</p><p>{}</p></article><footer>&copy; x</footer></body></html>",
        "<html><head><title>t</title><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>{}</p><p>{}</p></article><footer>&copy; x</footer>",
        "<title>t</title><article><h1>Title here</h1><p>{}<p>{}</article>",
        "<body><article><h1>Title here</h1><a name=x><p>{}</p><p>{}</p></article></body>",
        "<body><article><h1>Title here</h1><svg/><p>{}</p><canvas><p>{}</p></article></body>",
        "<body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>{}</p><button><p>{}</p></article></body>",
        "<body><article><h1 data-x='a>b' class = \"q\" id=a=b>Title here</h1></ ><p>{}</p><!-- > --><p>{}</p></article><footer>Copyright x</footer></body>",
        "<html><body><header><ul><li><a href=/>Home</a></li></ul></header><main><h1>Title here</h1><p>{}</p><div class=ad>Buy now</div><p>{}</p><form><p>Search</p></form></main></body>",
    ],
)
def test_html_of_hand(html_model, page):
    """Pages that no generator of the module makes: odd attributes, tags left out, elements never closed."""
    assert html_model.text(page.format(FIRST, SECOND)) == f"Title here\n{FIRST}\n{SECOND}"


def test_html_unclosed_tags_in_linear_time():
    import time

    def page(n):
        return "<article>" + "<b>" * n + "<p>x</p>" + "</i>" * n + "<h2>" * n + "<i><div>" + "<b>" * n + "</i>" * n + "<button>" * n

    took = []
    for n in (4000, 16_000):
        t = time.perf_counter()
        html_tree.tree(page(n))
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0]


def test_html_test_pages(html_model):
    """The text of each test page is that of its article element, without what the article holds of other kinds."""
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        text, html = html_model.text(r["html"] or ""), r["html"] or ""
        for kind in ("nav", "footer", "aside"):
            for found in re.findall(rf"<{kind}>(?:<[^>]*>)*([^<]{{12,}})<", html):
                assert html_mod.unescape(" ".join(found.split())) not in text.split("\n")


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/\r\nx y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (10, "u", ""), (11, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (12, "u", "z" * 300_000), (3, None, "<p>é</p>"), (None, "n", "<p>é</p>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("payload")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.deduplicate(spark, df, f"file://{tmp_path}/a").collect())
    first = {"<p>é</p>": 3, "": 9, rows[4][2]: 11, rows[5][2]: 12}
    want = []
    for i, _, h in rows:
        body, f = (h or "").encode(), first[h or ""]
        want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    assert got == sorted(want)
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, f"file://{tmp_path}/a").where("type = 'response'").collect()}
    assert back == {3: "<p>é</p>".encode(), 9: b"", 11: rows[4][2].encode(), 12: rows[5][2].encode()}
    assert warc.deduplicate(spark, df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_warc_inflates_as_a_stream():
    import gzip

    bodies = [b"", b"x" * 200_000, b"WARC/1.1\r\n\r\n", bytes(range(256)) * 999]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n" % (len(b) + 19, b) for b in bodies]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [body for _, body in warc.parse(packed)] == bodies
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse(gzip.compress(records[1][:-9])))


def test_warc_least_size(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.deduplicate(spark, df, f"file://{tmp_path}/c", least=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_rules(spark, request, which):
    df = request.getfixturevalue(which)
    have = dict(texts(df))
    got = quality_rules.judge(spark, clashing(df)).collect()
    assert len(got) == len(have)
    for r in got:
        want = helpers.base_figures(have[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_verdicts(spark):
    """Every verdict against quartiles of plain sorted lists, and fences that move with their group."""
    rng, rows = random.Random(8), []
    for i in range(400):
        group = i % 3
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 4 + 5 * group))) for _ in range(rng.randint(12, 60))]
        words += ["#"] * rng.choice([0, 0, 0, 1, 3, 9]) + ["*&%"] * rng.choice([0, 0, 2 * group])
        lines = [" ".join(words[k : k + 6]) for k in range(0, len(words), 6)]
        lines += lines[:1] * rng.choice([0, 0, 1, 4])
        if rng.random() < 0.03:
            lines = ["x" * 90] * 1 + [" ".join("".join(rng.choices("abcdefgh", k=40)) for _ in range(15))]
        rows.append((i, "\n".join(lines), ["en", "de", None][group], "ab"[group % 2] if i > 20 else "rare", 1))
    got = {r["doc_id"]: r for r in quality_rules.judge(spark, spark.createDataFrame(rows, DOC)).collect()}
    figures, groups = {}, {}
    for i, text, lang, source, _ in rows:
        n, chars, symbols, dup, repeat = helpers.base_figures(text)
        lines = max(1, sum(bool(helpers.words(x)) for x in text.split("\n")))
        figures[i] = ((symbols / max(chars, 1), dup / lines, chars / max(n, 1)), ((symbols - 2) / max(chars, 1), (dup - 2) / lines, chars / max(n, 1)), n < 10 or 100 * repeat > 20 * n)
        if not figures[i][2]:
            groups.setdefault((lang, source), []).append(i)
    quartile = lambda ids, c, p: sorted(figures[i][0][c] for i in ids)[max(0, -(-len(ids) * p // 4) - 1)]
    every = [i for ids in groups.values() for i in ids]
    limits = {}
    for key, ids in groups.items():
        for c in range(3):
            own, pooled, few = (quartile(ids, c, 1), quartile(ids, c, 3)), (quartile(every, c, 1), quartile(every, c, 3)), len(ids) < quality_rules.LEAST
            spread = pooled[1] - pooled[0] if few or own[1] <= own[0] else own[1] - own[0]
            limits[key, c] = (pooled if few else own)[1] + 3 * spread if spread > 0 or c < 2 else float("inf")
    rejected = 0
    for i, _, lang, source, _ in rows:
        want = not figures[i][2] and all(figures[i][1][c] <= limits.get(((lang, source), c), float("inf")) for c in range(3))
        assert got[i]["kept"] == want, i
        rejected += not want and not figures[i][2]
    assert rejected > 3 and len({round(v, 6) for (_, c), v in limits.items() if c == 2}) >= 3


def test_classifier_holds_features_once():
    """Fitting takes less memory than the features' values as doubles would, and the driver's lists are views of what arrived."""
    rng, held = np.random.default_rng(1), 2000
    rows = [np.unique(rng.integers(1, quality_classifier.WIDTH, 6000)).astype(np.uint32) for _ in range(held)]
    y = np.arange(held) % 2
    tracemalloc.start()
    try:
        quality_classifier.dual_coordinate_descent(rows, y, quality_classifier.log_count_ratios(rows, y), epochs=1)
        assert tracemalloc.get_traced_memory()[1] < sum(x.nbytes for x in rows) / 2
    finally:
        tracemalloc.stop()


def test_quality_rules_keep_good(spark, sf_dir, docs, none):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality_rules.judge(spark, docs).collect()}
    good = [kept[i] for i, q in labels.items() if q == 1 and not kept[i][1]]
    assert sum(k for k, _ in good) >= 0.98 * len(good)
    assert quality_rules.judge(spark, none).count() == 0


def test_classifier_training_bound(spark, sf_dir, docs, monkeypatch):
    """Repeated rows change nothing, and the bound on feature bytes holds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one, two = quality_classifier.train(docs, labels), quality_classifier.train(docs.unionByName(docs), labels)
    assert np.array_equal(one.weights, two.weights)
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda rows, y: seen.append(sum(x.nbytes for x in rows)))
    quality_classifier.train(docs, labels)
    monkeypatch.setattr(quality_classifier, "TRAIN_BYTES", seen[0] // 4)
    quality_classifier.train(docs, labels)
    assert 0 < seen[1] < seen[0] / 2


def test_quality_rules_reject_bad(spark):
    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in quality_rules.judge(spark, spark.read.parquet(f"{at}/documents.parquet")).collect() if r["doc_id"] in labels and not r["base_failed"]]
    share = lambda q: np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == q])
    assert share(1) >= 0.98 and share(0) <= 0.05


def test_quality_rules_fences_follow_groups(spark):
    """One rate is odd in a plain source and usual in a source of code; a longer word mean is odd only where words are alike."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    text = lambda n, symbols, size: " ".join([word(size) for _ in range(n)] + ["#" * symbols])
    plain = [(i, text(100, 0, 5) + word(i % 7), "en", "plain", 1) for i in range(100)]
    code = [(100 + i, text(100, 20 + i % 20, 5 + i % 5), "en", "code", 1) for i in range(100)]
    asked = [(200, text(100, 30, 5), "en", "plain", 1), (201, text(100, 30, 5), "en", "code", 1), (202, text(100, 0, 8), "en", "plain", 1), (203, text(100, 20, 8), "en", "code", 1), (204, text(100, 2, 5), "en", "plain", 1)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark, spark.createDataFrame(plain + code + asked, DOC)).collect()}
    assert all(kept[i] for i in range(200))
    assert [kept[i] for i in range(200, 205)] == [False, True, False, True, True]


def test_classifier_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality_classifier.op7(spark, "/root/testdata/sf0.01").collect()}
    held = [(got[i]["predicted"], q) for i, q in labels.items() if got[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 18)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(clashing(odd).unionByName(clashing(odd)), labels).collect()
    scores = {}
    for r in rows:
        scores.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(rows) == 34 and all(len(s) == 1 for s in scores.values()) and scores[4] == scores[5]
    assert quality_classifier.classify(odd, labels.limit(0)).count() == 17
    assert quality_classifier.classify(none, labels).count() == 0
    kept = quality_classifier.scored(clashing(odd), quality_classifier.fit([], np.array([])))
    assert set(clashing(odd).columns) <= set(kept.columns)


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 1, 3], np.uint32), np.array([0, 1, 4], np.uint32), np.array([0, 2, 3], np.uint32), np.array([0, 2, 4], np.uint32)] * 5
    y = np.array([1, 1, 0, 0] * 5)
    w = quality_classifier.dual_coordinate_descent(rows, y, quality_classifier.log_count_ratios(rows, y), cost=10)
    assert all((w[r].sum() > 0) == (v > 0) for r, v in zip(rows, y, strict=True))


def check_packing(spark, df, want):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in want}
    rows = packing.pack(spark, df).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for own in by_doc.values():
        at = sorted((r["start"], r["length"]) for r in own)
        assert [s for s, _ in at] == list(np.cumsum([0, *[n for _, n in at]])[:-1])
    for own in by_seq.values():
        at = sorted((r["offset"], r["length"]) for r in own)
        assert [s for s, _ in at] == list(np.cumsum([0, *[n for _, n in at]])[:-1]) and sum(n for _, n in at) <= 2048
    assert set(by_doc) == set(ids)
    return sum(len(x) for x in ids.values()) / (2048 * len(by_seq))


def test_packing(spark, docs):
    assert check_packing(spark, docs, texts(docs)) > 0.95


def test_packing_special_token(spark):
    texts = ["<|endoftext|>", "a <|endoftext|>b", "  <|endoftext|>\n\n<|endoftext|> x", "<|endoftext", "<|endoftext|><|endoftext|>", "<|EndOfText|>", " <|endoftext|> ", "a\x00b <|endoftext|>\tc"]
    check_packing(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), list(enumerate(texts)))


def test_packing_odd(spark, odd, none):
    check_packing(spark, clashing(odd), texts(odd))
    assert packing.pack(spark, none).count() == 0
    twice = packing.pack(spark, odd.unionByName(odd)).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n <> 2 * doc_tokens")
    assert twice.count() == 0


def test_differencing():
    sets = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in sets) == [14, 16]  # the differencing answer of the textbook case
    sizes = [RNG.randint(1, 512) for _ in range(700)]
    sets = packing.windows(sizes)
    assert sorted(i for s in sets for i in s) == list(range(700)) and max(sum(sizes[i] for i in s) for s in sets) <= 2048


def test_materialize(spark, odd):
    got = packing.materialize(odd, packing.pack(spark, odd)).collect()
    assert all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in got)


def test_targets(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 5, None: 300}, {"x": 7}, {"a": 0, "b": 9}, {f"s{i}": (i * 37) % 101 for i in range(23)}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = helpers.targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(spark, request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix(spark, clashing(df).drop("copies")).collect()
    have = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == len(have)
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        n = len(helpers.words(have[r["doc_id"]]["text"]))
        assert r["size"] == n and r["source"] == have[r["doc_id"]]["source"] and (r["taken"] % n == 0 and r["taken"] <= 3 * n if n else r["taken"] == 0)
        s = r["source"]
        sizes[s], taken[s], largest[s] = sizes.get(s, 0) + n, taken.get(s, 0) + r["taken"], max(largest.get(s, 0), n)
    want = helpers.targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(spark, df.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mixing_rows(spark, odd, none):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark, odd).collect()}
    out = mixing.repeat_to_targets(spark, clashing(odd))
    assert out.columns == clashing(odd).columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {i: c for i, c in copies.items() if c}
    assert mixing.mix(spark, none).count() == 0


def test_html_on_labelled_pages():
    model = html_tree.train(html_tree.training_pages(150))
    exact = 0
    pages = html_tree.training_pages(80, seed=1234)
    for p in pages:
        want = "\n".join(x.text.replace(html_tree.MARK, "") for x in html_tree.tree(p) if x.tag == "#text" and html_tree.MARK in x.text)
        exact += model.text(p.replace(html_tree.MARK, "")) == want
    assert exact >= 0.9 * len(pages)


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings."""
    import itertools
    import math

    nodes = html_tree.tree("<div class=ad>a<p>b c.</p></div><p>d</p>")
    model = html_tree.Model({"bias": 0.3, "tag=p": -0.7, "tag=#text": 0.9, "name=ad": -2.0}, [[0.8, -0.4], [-0.2, 0.5]])
    score = [sum(model.unary.get(f, 0.0) for f in html_tree.features(x, nodes)) for x in nodes]
    total, on = 0.0, [0.0] * len(nodes)
    for label in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(s * y for s, y in zip(score, label, strict=True)) + sum(model.pair[label[x.parent]][y] for x, y in zip(nodes, label, strict=True) if x.parent >= 0))
        total += w
        on = [a + w * y for a, y in zip(on, label, strict=True)]
    assert np.allclose(model.marginals(nodes), [a / total for a in on])


def test_html_odd(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain < text &amp; more &eacute;"), (4, "u", "<article><h1>T</h1><p>a  b<br>c&nbsp;d</p><script>var x='</p>';</script><p>" + "w " * 100_000), (5, "u", "<p>cut off &am"), (5, "u", "<p>cut off &am"), (6, "u", "</div></p><<>><p"), (7, "u", "<div>" * 3000 + "deep")]
    got = html_tree.extract(clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert by[1] == by[2] == "" and by[4].startswith("T\na b c d\nw w") and by[4].count("w") == 100_000
    assert html_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
