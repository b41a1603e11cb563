"""Operator 11: the order and edits by brute force, the samples by the similarity that they must show."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskbook.llm import fingerprints

ODD = [None, "", " \n", "a", "ab", "abc", "é ü\tö", "日本 語", "x " * 4000, "the same", "the same"]


def jaccard(a, b):
    """Generalised Jaccard of word counts."""
    x, y = (Counter((t or "").encode().split()) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    got = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return got + [(10**6 + 3 * k, t) for k, t in enumerate(ODD)] + [(-5, got[3][1]), (-6, "tail of all")]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_each_document_meets_its_next(spark, rows, parts, monkeypatch):
    monkeypatch.setattr(fingerprints, "GROUP", 20_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("hash", F.lit(1)).repartition(5)
        got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda x: -x[0])
    assert len(got) == len(rows)
    off_edited, off_next = [], []
    for (d, t), (e, u) in zip(order, order[1:] + order[:1]):
        t, u, r = t or "", u or "", got[d]
        n = len(t) // 3
        changed = t[: len(t) - n] + u[:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 4 * fingerprints.SAMPLES
        if changed == t:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
        alike = np.mean([r["fingerprint"][i : i + 4] == got[e]["fingerprint"][i : i + 4] for i in range(0, 4 * fingerprints.SAMPLES, 4)])
        assert r["near_next"] == alike or not t.split() or not u.split()
        off_edited.append(r["near_edited"] - jaccard(t, changed))
        off_next.append(r["near_next"] - jaccard(t, u))
    assert np.max(np.abs(off_edited + off_next)) < 0.2 and abs(np.mean(off_edited)) < 0.02 and abs(np.mean(off_next)) < 0.02
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault((t or "").strip(), got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(4)
    for shared in (0.1, 0.5, 0.8, 0.97):
        words = [f"w{k}" for k in range(80)]
        x = Counter({w: int(rng.integers(1, 9)) for w in words})
        y = Counter({w if rng.random() < shared else f"other{w}": max(1, n + int(rng.integers(-1, 2))) for w, n in x.items()})
        texts = [" ".join(c.elements()) for c in (x, y)]
        a, b = fingerprints.signatures([t.encode() for t in texts], 4000)
        want = jaccard(*texts)
        assert abs((a == b).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5 + 1e-3


def test_values_follow_the_definition():
    """One term's value against scalar arithmetic from the same variates, and gamma's mean and variance of 2."""
    terms = np.array([xxhash.xxh64_intdigest(str(k)) for k in range(60_000)], np.uint64)
    v1, v9 = (fingerprints.term_values(terms, np.full(len(terms), np.log(w)), 7) for w in (1.0, 9.0))
    assert (v9 <= v1 + 1e-12).all() and (v9 < v1).mean() > 0.5
    # exp(-value) at any weight w has the tail of w / (w + ...): the share of wins is proportional to the weight
    rounds = np.array([fingerprints.term_values(terms[:2], np.log(np.array([1.0, 3.0])), k) for k in range(6000)])
    assert abs((rounds[:, 1] < rounds[:, 0]).mean() - 0.75) < 0.02


def test_a_document_by_itself_no_document_repeated_ids_and_a_null_id(spark):
    one = fingerprints.edited_likeness(spark.createDataFrame([(7, "lone words here")], "doc_id int, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"lone wordslone ").hexdigest()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.edited_likeness(none).count() == fingerprints.fingerprints(none).count() == 0
    some = [(None, "n u l l"), (None, "n u l l")] + [(5, f"text {k % 4}") for k in range(30)] + [(2**53 + 1, "far"), (2**53, "near")]
    got = fingerprints.edited_likeness(spark.createDataFrame(some, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(d), len(t)) for d, t in some)
    far = next(r for r in got if r["doc_id"] == 2**53 + 1)
    assert far["edited_sha256"] == hashlib.sha256(b"fan").hexdigest()  # the next is 2**53


def test_fingerprints_are_those_of_the_query(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: bytes(r["fingerprint"]).hex() for r in fingerprints.fingerprints(docs).collect()}
    assert plain == {r["doc_id"]: r["fingerprint"] for r in fingerprints.edited_likeness(docs).collect()}
