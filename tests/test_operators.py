"""Properties and edge cases of operators."""

import pytest
from pyspark.sql import functions as F

from riskbook.functions import calibration_bin, clean_numeric, onset_month, weibull_curve
from riskbook.operators import attribution, cleaning, evaluation, features, hazards, json_recovery, prior, running, splits, training
from riskbook.sources import tables


def test_clean_numeric_of_odd_text(spark):
    got = spark.createDataFrame([("$1,234.50",), ("13.5 %",), ("n/a",), ("",), (None,)], "x string").select(clean_numeric(F.col("x")).alias("v"))
    assert [r["v"] for r in got.collect()] == [1234.5, 13.5, None, None, None]


@pytest.mark.parametrize("p, bin_", [(0.0, 0), (0.1, 1), (0.3, 2), (0.6, 5), (0.7, 6), (1.0, 9)])
def test_calibration_bins_at_edges(spark, p, bin_):
    assert spark.range(1).select(calibration_bin(F.lit(p)).alias("b")).first()["b"] == bin_


def test_curve_ends_at_p_and_never_falls(spark):
    curve = spark.range(1).select(weibull_curve(F.lit(0.4), F.lit(24)).alias("c")).first()["c"]
    assert abs(curve[-1] - 0.4) < 1e-9 and all(a <= b for a, b in zip(curve, curve[1:]))
    assert spark.range(1).select(onset_month(F.array(*[F.lit(x) for x in curve])).alias("m")).first()["m"] == next(i + 1 for i, x in enumerate(curve) if x >= 0.2)


def test_outcome_map_by_words_numbers_and_rarity(spark):
    def of(values):
        return {r["value"]: r["label"] for r in cleaning.outcome_map(spark.createDataFrame([(v,) for v in values], "x string"), "x").collect()}

    assert of(["CHGOFF", "P I F", "Fully Paid", None]) == {"CHGOFF": 1, "P I F": 0, "Fully Paid": 0}
    assert of(["1", "2", "1"]) == {"1": 0, "2": 1}
    assert of(["a", "b", "a"]) == {"a": 0, "b": 1}
    assert of(["a", "a"]) == {"a": 0}
    assert of([]) == {}


def test_protected_columns_are_never_features():
    mapping = {"loan_id": "id", "region": "state", "gender": "sex", "target": "bad", "loan_amount": "amount"}
    columns = ["id", "state", "sex", "bad", "amount", "x", "y"]
    assert cleaning.select_features(columns, mapping) == ["amount", "x", "y"]


def test_folds_are_stratified_and_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    rows = splits.three_way_split(df, "y", "k").groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]): r["count"] for r in rows} == {(1, "fit"): 120, (1, "cal"): 30, (1, "test"): 50, (0, "fit"): 480, (0, "cal"): 120, (0, "test"): 200}


def test_auc_of_ties_and_single_classes(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.9), ("b", 1, 0.8), ("c", 1, 0.9), ("c", 0, 0.1)], "g string, y int, p double")
    assert {r["g"]: r["auc"] for r in evaluation.auc(df, ["g"]).collect()} == {"a": 0.5, "b": 0.5, "c": 1.0}


def test_cox_finds_the_sign_of_an_effect(spark):
    df = spark.range(2000).select(((F.col("id") % 2) * 2 - 1).cast("double").alias("z"), (1 + (F.col("id") * 7919 % 30) / (1 + F.col("id") % 2)).alias("t"), F.lit(1).alias("e"))
    assert hazards.cox_fit(df, "t", "e", ["z"])[0] > 0.1


@pytest.mark.parametrize("text, layer", [('{"a": 1}', 2), ('```json\n{"a": 1}\n```', 3), ('so: {"a": {"b": 2}} ok', 3), ("{'a': 1,}", 4), ('{"a": [1, 2', 4), ("none", None), (None, None), ("{'a': 'it\\'s'}", 4), ('{"a":[{"b":1', 4), ("{'a': \"it's\"}", 4), ('{"a": "x', 4)])
def test_json_layers(spark, text, layer):
    df = spark.createDataFrame([(text,)], "x string")
    assert json_recovery.recover_json(df, "x").first()["layer"] == layer


def test_hint_scores_and_mapping(spark):
    columns = spark.createDataFrame([("t", "LoanID", 0, False), ("t", "DisbursedAmount", 1, False), ("t", "Defaulted", 2, True), ("t", "State", 3, False)], "table_name string, name string, position int, is_binary boolean")
    found = {r["field"]: r["name"] for r in tables.heuristic_map(columns).collect()}
    assert found["loan_id"] == "LoanID" and found["loan_amount"] == "DisbursedAmount" and found["region"] == "State"
    assert tables.pick_target(columns).first()["name"] == "Defaulted"


def test_profile_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, x string")
    row = tables.profile_columns(df, "k", ["x"]).first()
    assert row["null_pct"] == 100.0 and row["n_unique"] == 0 and row["sample"] is None
    assert tables.profile_columns(df.limit(0), "k", ["x"]).count() == 0


def test_tree_attributions_add_up(spark, sf_dir):
    from riskbook.plans.q_more import shap_tree

    rows = shap_tree(spark, sf_dir).select("left_over", "feature", "contribution").collect()
    assert all(abs(r["left_over"]) < 1e-4 for r in rows) and any(abs(r["contribution"]) > 0.01 for r in rows)


def test_trained_models_find_signal_and_are_calibrated(spark, sf_dir):
    from riskbook.plans.q_models import numbers
    from riskbook.operators import training

    x = numbers(spark, sf_dir)
    bundle, folded = training.fit(x, "label", "loan_id", ["credit_score", "prior_delinquencies"], [], ("gbt", "logistic"), trees=5)
    got = bundle.score(folded).where("fold = 'test'")
    assert evaluation.auc(got.withColumn("y", F.col("label"))).first()["auc"] > 0.6
    pairs = sorted((r["p_raw"], r["p"]) for r in got.select("p_raw", "p").collect())
    assert all(1e-4 <= p <= 1 - 1e-4 for _, p in pairs) and all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("text, want", [("{'a': 'it\\'s'}", {"a": "it's"}), ('{"a":[{"b":1', {"a": [{"b": 1}]}), ("{'a': \"it's\"}", {"a": "it's"}), ("{'a': 'say \"hi\"', 'b': [1, {'c': 2}]", {"a": 'say "hi"', "b": [1, {"c": 2}]}), ('{"a": [1}', {"a": [1]}), ('{"a": "} ]", "b": 1,}', {"a": "} ]", "b": 1}), ("[1", None)])
def test_repair_keeps_values(text, want):
    import json

    got = json_recovery.repair(text)
    assert (json.loads(got) if got else None) == want


def test_running_sums_and_fills_over_ranges(spark):
    import random

    rng = random.Random(3)
    rows = [(g, k, rng.choice([None, 1, 2, 3]), rng.randint(0, 9)) for g in ("a", None) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, k int, v int, n int").repartition(5)
    want_sum, want_fill = {}, {}
    for g in ("a", None):
        mine, total, last = sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 0, None
        for i, r in enumerate(mine):
            want_sum[g, r[1]] = total
            total += r[3]
            last = r[2] if r[2] is not None else last
            want_fill[g, r[1]] = last if last is not None else next(x[2] for x in mine[i:] if x[2] is not None)
    assert {(r["g"], r["k"]): r["s"] for r in running.with_sums_before(df, ["g"], "k", {"s": "n"}).collect()} == want_sum
    down = {(r["g"], r["k"]): r["s"] for r in running.with_sums_before(df, ["g"], "k", {"s": "n"}, falling=True).collect()}
    total = {g: sum(r[3] for r in rows if r[0] == g) for g in ("a", None)}
    assert all(down[r[0], r[1]] == total[r[0]] - want_sum[r[0], r[1]] - r[3] for r in rows)
    assert {(r["g"], r["k"]): r["v"] for r in running.filled(df, "v", "k", ["g"]).collect()} == want_fill


def test_null_segments_and_labels_stay(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), (None, 1, 0.4), (None, 0, 0.6)], "g string, y int, p double")
    assert {r["g"]: r["auc"] for r in evaluation.evaluate(df, ["g"]).collect()} == {"a": 1.0, None: 0.0}
    split = splits.three_way_split(spark.createDataFrame([(1, 0), (2, None), (3, 1)], "k int, y int"), "y", "k")
    assert split.count() == 3


def test_small_tables_are_evaluated_on_the_calibration_fold(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 8).cast("double").alias("x"))
    bundle, folded = training.fit(df, "y", "k", ["x"], [], ("logistic",))
    assert {(r["fold"], r["evaluated"]): r["count"] for r in folded.groupBy("fold", "evaluated").count().collect()} == {("fit", False): 149, ("cal", True): 51}
    assert training.metrics_by_variant(bundle.score(folded.where("evaluated")), "y", ["p"]).first()["n"] == 51
    assert training.leave_one_out(df.withColumn("c", F.lit("one")).where("y = 0"), "c", "y", "k", ["x"]).count() == 0
    assert training.degenerate_metrics(0.25) == {"auc": 0.5, "gini": 0.0, "pr_auc": 0.25, "brier": 0.1875, "ece": 0.0}


def test_tree_attribution_equals_all_subsets():
    from itertools import combinations
    from math import factorial

    import numpy as np

    # features 0, 1, 0 again, 2; unequal covers
    tree = {"left": np.array([1, 3, 5, -1, -1, -1, 7, -1, -1]), "right": np.array([2, 4, 6, -1, -1, -1, 8, -1, -1]), "feature": np.array([0, 1, 0, -1, -1, -1, 2, -1, -1]), "cut": np.array([0.5, 0.3, 0.8, 0, 0, 0, 0.1, 0, 0]), "value": np.array([0, 0, 0, 1.0, -2.0, 5.0, 0, 0.5, 3.0]), "cover": np.array([100, 40, 60, 10, 30, 25, 35, 5, 30.0])}

    def expected(x, known, node=0):
        left, right = tree["left"][node], tree["right"][node]
        if left < 0:
            return tree["value"][node]
        f = tree["feature"][node]
        if f in known:
            return expected(x, known, left if x[f] <= tree["cut"][node] else right)
        a, b = tree["cover"][left], tree["cover"][right]
        return (a * expected(x, known, left) + b * expected(x, known, right)) / (a + b)

    x = np.random.default_rng(2).random((50, 4))
    got, base = attribution.shap_rows([tree, tree], x)
    for row, values in zip(x, got):
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(factorial(k) * factorial(3 - k) / factorial(4) * (expected(row, {*s, f}) - expected(row, set(s))) for k in range(4) for s in combinations(rest, k))
            assert values[f] == pytest.approx(2 * want)
        assert base + values.sum() == pytest.approx(2 * expected(row, {0, 1, 2, 3}))


def test_a_prior_needs_enough_of_the_vocabulary(spark):
    df = spark.createDataFrame([(1, 5.0, "900"), (2, None, "450")], "k int, a double, s string")
    assert prior.coverage(df, {"loan_amount": "a", "credit_score": "s", "sector": "nowhere"}).first()["coverage"] == pytest.approx(2 / 15)
    assert [r["can_credit_score_n"] for r in prior.to_canonical(df, {"credit_score": "s"}).orderBy("k").collect()] == [1.0, 0.5]
    assert prior.stack_prior(df, None, {})[1] == "no prior"


def test_feature_state_goes_through_json_and_meets_new_levels(spark):
    df = spark.createDataFrame([(k, float(k), "ab"[k % 2], "x") for k in range(30)], "loan_id int, amount double, sector string, region string")
    state = features.fit_features(df, {"loan_id": "loan_id", "loan_amount": "amount", "sector": "sector", "region": "region"}, "loan_id")
    new = spark.createDataFrame([(1, None, "z", "x"), (2, float("nan"), None, "y")], df.schema)
    rows = features.FeatureState.from_json(state.to_json()).transform(new).orderBy("loan_id").collect()
    assert "region" not in " ".join(state.names) and rows[0]["amount"] == 14.5 and rows[0]["sector___OTHER__"] == 1.0 and rows[1]["amount"] == 0.0


def test_shape_between_months_and_at_flat_ends(spark):
    hazard = spark.createDataFrame([(2, 0.1), (10, 0.5)], "month int, hazard double")
    shape = hazards.hazard_shape(hazard).first()["shape"]
    import math

    p = lambda h: 1 - math.exp(-h)
    assert shape[0] == pytest.approx(p(0.1) / p(0.5)) and shape[5] == pytest.approx(p(0.3) / p(0.5)) and shape[11] == 1.0
