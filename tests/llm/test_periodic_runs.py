"""Operator 12 against a scan of all lags of all words."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskbook.llm import periodic_runs


def brute(words, least=12):
    """All runs, from every lag: a stretch keeps its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=80), max_size=6), st.integers(2, 14))
def test_runs_of_few_words(texts, least):
    texts = [[w.encode() for w in x] for x in texts]
    assert periodic_runs.runs_of(texts, least) == [brute(x, least) for x in texts]


def test_runs_of_odd_sequences():
    rng = np.random.default_rng(2)
    ruler = [str((i & -i).bit_length()) for i in range(1, 400)]
    chained = sum([[f"u{k}", *[f"{x}" for x in range(6)], f"v{k}", *[f"{x}" for x in range(6)], f"u{k - 1}"] for k in range(30)], [])
    phrase = [f"p{k}" for k in range(150)]
    texts = [["a"] * 11, ["a"] * 12, ["a"] * 400, ["a", "b"] * 90 + ["c"] + ["a", "b"] * 90, fibonacci(500), ruler, chained, [str(bin(k).count("1") % 2) for k in range(256)], phrase * 2, phrase * 3 + phrase[:7], phrase + phrase[:149], ["z"] + phrase[:6] * 2 + ["y"], []]
    texts += [[str(x) for x in rng.integers(0, k, 300)] for k in (1, 2, 3, 9)] + [(["x", *map(str, rng.integers(0, 40, 60))]) * 3]
    texts = [[w.encode() for w in x] for x in texts]
    assert periodic_runs.runs_of(texts) == [brute(x) for x in texts]


def contract(doc_id, text):
    """The query's row by the statement of the contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return str(doc_id), len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(kept)


def test_digests_follow_the_contract(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP", 30_000)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < 6000]
    rows += [(10**6 + k, t) for k, t in enumerate([None, "", " \n", "a", "a " * 12, "x y " * 20, "é ü\tö\x0b" * 9, "x\x1cy " * 13, "w " * 5000])] + [rows[0], (None, "b " * 30), (-7, "c d " * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("words", F.lit(1)).repartition(3)
    got = sorted((str(r[0]), *r[1:]) for r in periodic_runs.run_digests(docs).collect())
    assert got == sorted((contract(*x) for x in rows), key=lambda x: tuple(map(str, x))) or sorted(map(str, got)) == sorted(str(contract(*x)) for x in rows)
    assert sum(x[1] > 0 for x in got) > 15


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go " + "la di da " * 5 + "end"), (2, None), (None, "no\nrun")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert (got[1]["starts"], got[1]["lengths"], got[1]["periods"], got[1]["collapsed"]) == ([1], [15], [3], "go la di da end")
    assert (got[2]["starts"], got[2]["collapsed"], got[None]["collapsed"]) == ([], "", "no run")
    assert periodic_runs.run_digests(docs.limit(0)).count() == periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_many_words_of_one_document_stay_near_linear():
    words = [str(x).encode() for x in np.minimum(np.random.default_rng(3).zipf(1.3, 60_000), 400)]
    planted = words[:30_000] + words[30_000:37_000] * 3
    assert (30_000, 21_000, 7_000) in periodic_runs.runs_of([planted])[0] or any(q == 7_000 and n >= 21_000 for _, n, q in periodic_runs.runs_of([planted])[0])


@pytest.mark.parametrize("words", [[], ["a"]])
def test_planting_nothing(words):
    assert periodic_runs.planted(None, words) == words
