"""Bundles of one class, saved models, names that clash, null clients, fairness fallbacks."""

import pytest
from pyspark.sql import functions as F

from riskbook.operators import cleaning, features, portfolio, sequences, training
from riskbook.operators import run_book as book_runs


def test_one_class_is_scored_and_saved(spark, tmp_path):
    df = spark.createDataFrame([(k, 0, float(k)) for k in range(60)], "id long, y int, x double")
    bundle, folded = training.fit(df, "y", "id", ["x"], [])
    bundle.save(str(tmp_path / "b"))
    for b in (bundle, training.Bundle.load(str(tmp_path / "b"))):
        got = b.score(folded).toPandas()
        assert (got[[f"p_{m}" for m in training.MEMBERS]] == 0).all().all() and (got["p_raw"] == 0).all() and (got["p"] == training.LOW).all()
    metrics = training.metrics_by_variant(bundle.score(folded.where("evaluated")), "y", ["p_gbt", "p"]).toPandas()
    assert (metrics["auc"] == 0.5).all()


def test_names_that_clean_to_one_are_numbered(spark):
    df = spark.createDataFrame([(k, float(k), float(-k), "A&B" if k % 2 else "A-B") for k in range(40)], "id long, `a b` double, a_b double, s string")
    state = features.fit_features(df, {"loan_id": "id"}, "id")
    assert len(state.names) == len({n.lower() for n in state.names}) == 5
    got = features.FeatureState.from_json(state.to_json()).transform(df).where("id = 3").first().asDict()
    assert sorted(v for k, v in got.items() if k != "id") == sorted([3.0, -3.0, 1.0, 0.0, 0.0])
    hot = cleaning.one_hot(df, "s", ["A&B", "A-B"]).where("id = 3").first()
    assert (hot["s_A_B"], hot["s_A_B_2"]) == (1, 0)


def test_a_null_client_is_a_client(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "c string, v double")
    got = sorted((str(r["c"]), round(r["z"], 4)) for r in sequences.standardise(df, "c", "v", "z").collect())
    assert got == [("None", -0.7071), ("None", 0.7071), ("a", 0.0)]


def test_without_negatives_the_gap_of_true_positive_rates_stands(spark):
    rows = [(k, 1, 0.9 if k % 2 or k < 25 else 0.1, "a" if k < 50 else "b", "a" if k < 96 else "b") for k in range(100)]
    audit = portfolio.fairness_audit(spark.createDataFrame(rows, "loan_id long, y int, p double, g string, h string"), ["g", "h"]).toPandas()
    assert audit["attribute"].tolist() == ["g"]  # h has one group of twenty
    chosen = {g: [r[2] >= 0.5 for r in rows if r[3] == g] for g in "ab"}
    assert abs(audit["eo_diff"][0] - abs(sum(chosen["a"]) / 50 - sum(chosen["b"]) / 50)) < 1e-9 and audit["note"].str.len().gt(0).all()


@pytest.fixture(scope="module")
def book(spark):
    rows = [(k, float(1000 + 37 * k % 900), float(12 + k % 5 * 12), float(300 + 41 * k % 600), "x" if k % 3 else "y", int((41 * k % 600) < 150 + k % 7 * 20) if k % 10 else None) for k in range(900)]
    return spark.createDataFrame(rows, "id long, amount double, term_months double, score double, grp string, bad int")


def test_a_saved_model_scores_alike_and_unlabelled_loans_too(spark, book, tmp_path):
    mapping = {"loan_id": "id", "loan_amount": "amount", "term_months": "term_months", "credit_score": "score", "region": "grp", "target": "bad"}
    model, folded = book_runs.fit_book(book, mapping, "id", "bad", trees=5)
    assert folded.count() == book.where("bad IS NOT NULL").count() and "grp" not in " ".join(model.state.names)
    model.save(str(tmp_path / "m"))
    a, b = (x.score(book, ["term_months"]).orderBy("id").toPandas() for x in (model, book_runs.BookModel.load(str(tmp_path / "m"))))
    assert len(a) == 900 and a.equals(b) and a["p"].between(0, 1).all()


def test_a_book_of_one_outcome_runs(spark, book):
    mapping = {"loan_id": "id", "loan_amount": "amount", "term_months": "term_months", "credit_score": "score", "target": "bad"}
    one = book.withColumn("bad", F.lit(0)).withColumns({"interest_rate": F.lit(9.0), "collateral_value": F.lit(None).cast("double"), "income_or_turnover": F.lit(5.0)})
    run = book_runs.run_book(one, mapping, "id", "bad", ["grp"], trees=3)
    got = run.records.toPandas()
    assert len(got) == 900 and (got["p"] == training.LOW).all() and any("one outcome" in w for w in run.model.warnings)
    assert len(book_runs.report(run, mapping, "id", "bad", ["grp"]).toPandas()) == 1
