"""Operator 1: windows of long words, recall against all pairs where a passage has many edited copies, dealing, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskbook.llm import substring_dedup


def word(rng, size, letters="abcdefghijklmnopqrst"):
    return "".join(rng.choice(list(letters), size))


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrst", "абвгдежзиклмнопрстуф"])
def test_windows_are_of_words_not_bytes(spark, letters):
    """54 words of which, after ten, one in four is replaced: found whatever the words' length."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for k, size in enumerate((3, 6, 9, 11, 22, 60, 300)):
        passage = [word(rng, size, letters) for _ in range(54)]
        edited = [x if i < 10 or i % 4 else word(rng, size, letters) for i, x in enumerate(passage)]
        around = lambda n: [word(rng, size, letters) for _ in range(n)]  # noqa: E731, B023
        rows += [(2 * k + 1, " ".join(around(70) + passage + around(70))), (2 * k + 2, " ".join(around(90) + edited + around(30)))]
        want[2 * k + 2] = 2 * k + 1
    got = substring_dedup.duplicate_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ref_doc_id"] for r in got} == want and all(r["n_words"] >= 50 for r in got)


@pytest.fixture(scope="module")
def copies():
    """Six passages with 30 edited copies each, some of them cut short or broken by inserted words, between other text."""
    rng = np.random.default_rng(11)
    vocabulary = [word(rng, int(rng.integers(2, 9))) for _ in range(3000)]
    pick = lambda n: rng.choice(vocabulary, n).tolist()
    rows, places = [], {}
    for p in range(6):
        passage = pick(int(rng.integers(60, 99)))
        for _ in range(30):
            mine = list(passage)
            for i in rng.choice(len(mine), int(rng.integers(0, max(1, len(mine) // 14))), replace=False):
                mine[i] = pick(1)[0]
            kind = rng.random()
            if kind < 0.15:  # a part of it only
                mine = mine[: int(rng.integers(20, 45))]
            elif kind < 0.3:  # broken in its middle
                at = len(mine) // 2
                mine = mine[:at] + pick(int(rng.integers(3, 8))) + mine[at:]
            before = pick(int(rng.integers(5, 120)))
            doc = len(rows) + 1
            places[doc] = (len(before), len(before) + len(mine))
            rows.append((doc, before + mine + pick(int(rng.integers(5, 120)))))
    order = rng.permutation(len(rows))
    ids = {int(o) + 1: k + 1 for k, o in enumerate(order)}
    return [(ids[d], w) for d, w in rows], {ids[d]: v for d, v in places.items()}


def covered(spans, rows):
    """Of each document, which words are in its spans (given in bytes)."""
    out = {}
    for doc, words in rows:
        ends = np.cumsum([len(w) + 1 for w in words])
        mark = np.zeros(len(words), bool)
        for s, e in spans.get(doc, []):
            mark |= (ends - 1 <= e) & (ends - np.array([len(w) + 1 for w in words]) >= s)
        out[doc] = mark
    return out


def all_pairs(rows):
    """The spans of each document by aligning it with every earlier one along the chains of all shared seeds."""
    spans = {}
    for doc, a in rows:
        for other, b in rows:
            if other >= doc:
                continue
            seeds = {}
            for j in range(len(b) - 3):
                seeds.setdefault(tuple(b[j : j + 4]), []).append(j)
            anchors = [(i, j) for i in range(len(a) - 3) for j in seeds.get(tuple(a[i : i + 4]), [])]
            if not anchors:
                continue
            x, y = np.array(anchors).T
            ends = np.cumsum([len(w) + 1 for w in a])
            for one in substring_dedup.chain(x * 6, y * 6):
                for i, j, *_ in substring_dedup.align(a, b, [anchors[k] for k in one], 50, 0.8):
                    spans.setdefault(doc, []).append((int(ends[i] - len(a[i]) - 1), int(ends[j - 1])))
    return spans


def test_recall_against_all_pairs_and_dealing(spark, copies):
    rows, places = copies
    want = covered(all_pairs(rows), rows)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    shares = []
    for parts in (1, 5):
        spans = {}
        for r in substring_dedup.duplicate_spans(docs.repartition(parts)).collect():
            assert r["ref_doc_id"] < r["doc_id"]
            spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        got = covered(spans, rows)
        shares.append(sum((got[d] & want[d]).sum() for d in want) / sum(w.sum() for w in want.values()))
        found = [d for d in want if want[d].any()]
        assert sum(got[d].any() for d in found) >= 0.98 * len(found)
        for d, mark in got.items():  # nothing far outside of the passage
            s, e = places[d]
            assert not mark[: max(0, s - 12)].any() and not mark[e + 12 :].any()
    assert min(shares) >= 0.98, shares


def test_clashing_columns_repeated_rows_and_nulls_together(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(word(rng, 6) for _ in range(60))
    rows = [(1, passage), (1, passage), (2, "before it " + passage), (None, passage), (3, None), (4, ""), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("x"), "doc": F.lit(1), "spans": F.lit(2), "part": F.lit(3)})
    got = substring_dedup.duplicate_spans(docs).collect()
    assert [(r["doc_id"], r["ref_doc_id"], r["n_words"]) for r in got] == [(2, 1, 60)]
    left = substring_dedup.cut_passages(docs)
    assert left.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == sorted(str((d, "before it" if d == 2 else t)) for d, t in rows)
