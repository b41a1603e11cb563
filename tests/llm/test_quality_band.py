"""Operator 5's band decides: held against labels, and on planted junk in each language."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskbook.llm import quality_rules


@pytest.fixture(scope="module")
def judged(spark):
    """The documents of the middle size with planted ones: words of random letters of the language, and good words with a
    sign behind each."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    rng, planted = np.random.default_rng(7), []
    for lang, some in docs.toPandas().groupby("lang"):
        clean = [t for t in some["text"] if 800 < len(t) < 4000 and not set(t) & set(quality_rules.SYMBOLS)]
        letters = sorted({c for t in clean for c in t.lower() if c.isalpha()})
        for k in range(5):
            planted.append((10**6 + len(planted), " ".join("".join(rng.choice(letters, int(rng.integers(2, 10)))) for _ in range(250)), lang, "gibberish"))
            planted.append((10**6 + len(planted), "".join(f"{w}{'%' if i % 2 else '$'} " for i, w in enumerate(clean[k].split())), lang, "signs"))
            planted.append((10**6 + len(planted), "".join(sorted(clean[k])), lang, "sorted letters"))
    more = spark.createDataFrame(planted, "doc_id long, text string, lang string, kind string")
    got = quality_rules.quality_verdicts(docs.unionByName(more.drop("kind")))
    return got.join(more.select("doc_id", "kind"), "doc_id", "left").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").toPandas()


def test_planted_junk_is_rejected_in_each_language(judged):
    planted = judged[judged["kind"].notna() & ~judged["base_failed"]]
    assert planted.groupby(["lang", "kind"]).size().min() >= 3
    assert not planted["kept"].any()


def test_bad_documents_go_and_good_ones_stay(judged):
    open_ = judged[~judged["base_failed"]]
    bad, good = open_[open_["quality"] == 0], open_[open_["quality"] == 1]
    assert len(bad) > 20 and bad["kept"].mean() <= 0.1
    assert len(good) > 300 and good["kept"].mean() >= 0.97
    assert good.groupby("lang")["kept"].mean().min() >= 0.95


def test_without_a_reference_only_the_base_rules_judge(spark):
    rows = [(k, " ".join(f"w{k}x{j}%" for j in range(30)), "en") for k in range(20)] + [(50, "few words", None)]
    got = quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got) and sum(r["kept"] for r in got) == 20
    empty = quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string").where(F.lit(False)))
    assert empty.count() == 0
