"""The pipeline, stage by stage, against brute force on a small corpus."""

import corpus_pipeline
from quarry.llm.common import Scratch
from quarry.llm.queries import QUERIES
from tests.llm import helpers


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    scratch = Scratch(spark, "t")
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outs = [first]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        outs.append(scratch.keep(stage(spark, outs[-1], sf_dir), str(i)))
    names = first.columns
    assert all(x.columns == names for x in outs[1:-1])
    rows = [x.collect() for x in outs]
    kept = {r["doc_id"] for r in rows[1]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    groups = helpers.groups([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80)
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(i for i, (_, c) in groups.items() if i == c)
    want = {r["doc_id"]: x for r, x in zip(rows[2], helpers.repeats([r["text"] for r in rows[2]]), strict=True)}
    for r in rows[3]:
        n, removed, _ = want[r["doc_id"]]
        assert len(helpers.words(r["text"])) == n - removed and r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in rows[3]} == {i for i, (n, removed, _) in want.items() if removed < n or n == 0}
    assert {r["doc_id"] for r in rows[4]} <= {r["doc_id"] for r in rows[3]}
    assert {r["doc_id"] for r in rows[5]} == {r["doc_id"] for r in rows[4]}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
