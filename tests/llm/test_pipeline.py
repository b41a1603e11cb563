"""The pipeline keeps clean documents, and one of each kind of copy."""

import numpy as np
import pytest

import corpus_pipeline
from riskbook.llm import simhash
from riskbook.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, spans int, fp string, _spans int, score double"


def odd_rows():
    """Nulls, empty texts, copies, repeated rows, one doc_id with two texts, a long text, and a passage that two share."""
    rng = np.random.default_rng(6)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(n))
    shared, long = words(70), words(30_000)
    texts = [(1, None), (2, ""), (3, ""), (4, "copy of a text"), (5, "copy of a text"), (6, "one"), (6, "two"), (6, "two"), (None, "no id"), (None, None), (7, words(20) + " " + shared), (8, shared + " " + words(30)), (9, long), (10, " \n\t ")]
    return [(d, t, None, "s", len(t or ""), "k", k, "f", k, 0.5) for k, (d, t) in enumerate(texts)]


@pytest.mark.parametrize("rows", [odd_rows(), []])
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001").collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows} and sum(r["length"] for r in got) >= len(rows)
        return
    kept = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in got)
    assert all(r.asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")} for r in got)
    if not rows:
        assert not got
    elif name == "exact dedup":  # of the empty texts the largest doc_id, of the two rows of 6 that are equal one
        assert [d for d, _ in kept] == [-1, 3, 5, 6, 6, 7, 8, 9, 10]
    elif name == "SimHash near-dedup":  # texts without words are one group
        assert {d for d, _ in kept} == {-1, 1, 4, 6, 7, 8, 9} and len(kept) == 8
    elif name == "substring dedup":
        before = {k: r for k, r in enumerate(rows)}
        assert len(got) == len(rows) and all(r["text"] == before[r["spans"]][1] for r in got if r["doc_id"] != 8)
        assert next(len(r["text"].split()) for r in got if r["doc_id"] == 8) == 30
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert docs.select("text").distinct().count() == docs.count()


def test_near_dedup_broadcasts_no_replicas(spark, monkeypatch):
    """Its replicas of fingerprints are far more than Spark takes them for; the driver's memory held them."""
    plans, components = [], simhash.connected_components

    def seen(edges, a, b):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges, a, b)

    monkeypatch.setattr(simhash, "connected_components", seen)
    docs = spark.createDataFrame([(k, f"a text of some words {k // 2}") for k in range(8)], "doc_id long, text string")
    assert corpus_pipeline.near(spark, docs, "/root/testdata/sf0.001").count() <= 4
    assert len(plans) == 1 and "Broadcast" not in plans[0]
