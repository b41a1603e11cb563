"""What reviews found, in small."""

import pytest
from pyspark.sql import functions as F

from riskbook.functions import clean_numeric, format_value, number_of, onset_month, rounded, weibull_curve
from riskbook import catalog as C
from riskbook.operators import attribution, cleaning, evaluation, features, hazards, records, sequences, splits, training
from riskbook.operators.staging import staged
from riskbook.plans import q_models, q_more, q_sequences
from riskbook.sources import tables


def test_large_values_keep_two_places_where_asked(spark):
    df = spark.createDataFrame([(1102267.64,), (2000000.0,), (12.5,), (None,)], "x double")
    plain, short = (df.select(format_value(F.col("x"), at).alias("t")).collect() for at in (None, 1e6))
    assert [r["t"] for r in plain] == ["1,102,267.64", "2,000,000", "12.50", "missing"]
    assert [r["t"] for r in short] == ["1,102,268", "2,000,000", "12.50", "missing"]


def test_distinct_counts_are_exact_beyond_the_sketch(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 90_001).alias("a"), F.concat(F.lit("x" * 70), F.col("id") % 70_003).alias("b"), (F.col("id") % 7).alias("c"), F.when(F.col("id") < 0, "").alias("d"))
    got = {r["name"]: r["n_unique"] for r in tables.profile_columns(df, "id", ["a", "b", "c", "d"]).collect()}
    assert got == {"a": 90_001, "b": 70_003, "c": 7, "d": 0}
    kinds = {r["feature"]: (r["n_distinct"], r["numeric"]) for r in cleaning.kind_decision(df, ["a", "b", "c"]).collect()}
    assert kinds == {"a": (90_001, True), "b": (0, False), "c": (7, False)}


def test_rounding_is_that_of_sql(spark):
    import random

    import duckdb

    rng = random.Random(5)
    values = [16522.01 / 32, 132254.52 / 128, 1.005, None, 1e15 + 0.3, -2.5, *[rng.randrange(10**7) / 6400 for _ in range(3000)], *[rng.randrange(10**7) / rng.choice([128, 320, 640, 12800]) for _ in range(3000)]]
    df = spark.createDataFrame([(k, v, k) for k, v in enumerate(values)], "k int, x double, n int")
    for places in (2, 4, 6):
        got = [r["x"] for r in evaluation.round_all(df, ["x", "n"], places).orderBy("k").collect()]
        con = duckdb.connect()
        con.execute("CREATE TABLE t (k INT, x DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values[:400])))
        assert got[:400] == [r[0] for r in con.execute(f"SELECT round(x, {places}) FROM t ORDER BY k").fetchall()]
    owed = spark.createDataFrame([(16522.01, 32.0), (1033.2384375 * 128, 128.0), (46811.32, 640.0)], "a double, b double").select((F.col("a") / F.col("b")).alias("x"))
    assert [r["r"] for r in owed.select(rounded("x", 6).alias("r")).collect()] == [516.312812, 1033.238437, 73.142688]
    assert owed.select(rounded(F.col("x") * 100, 4).alias("r")).collect()[2]["r"] == 7314.2688


def by_sql(name, folder, *tables):
    """The rows of a query's SQL over the tables of a folder, on one thread."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con.execute(q_sequences.SQL[name]).fetchall()


def test_panels_of_accounts_without_balance_or_nation(spark, tmp_path):
    """A balance of zero has no ratio, and the SQL's bounds make zero of it; an owner of no known nation counts."""
    rows = [(1, 7, "F", 500.0), (2, 8, "O", 320000.0), (3, 9, "P", 64000.0), (4, 10, "F", 0.0), (5, 11, "O", None), (6, 99, "F", 1.0), (7, 7, "O", 16522.01)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    owners = [(7, 3, 32.0), (8, 3, 0.0), (9, None, -640.0), (10, 77, 0.01), (11, 3, None)]
    spark.createDataFrame(owners, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(3, "CANADA")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    got = sorted(tuple(r) for r in q_sequences.panel_row_stats(spark, str(tmp_path)).collect())
    assert got == sorted(by_sql("panel_row_stats", tmp_path, "orders", "customer")) and len(got) == 6


def test_rollups_add_up_in_order(spark, tmp_path):
    """Means of 64 amounts are ties at six places, which the last bit of a sum decides: it must not depend on how rows are dealt."""
    import random

    rng = random.Random(3)
    rows = [(k, k % 300, rng.choice(["view", "error"]), round(rng.expovariate(0.02), 2)) for k in range(300 * 64)]
    rows += [(20_000 + k, 300, "view", 50 + x) for k, x in enumerate([0.1, 0.2, -0.3, 0.7, -0.7])]  # balances that add up to zero but for noise
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    for parts in (1, 7):
        d = tmp_path / str(parts)
        dealt = events.repartition(parts, "event_id") if parts > 1 else events.coalesce(1)
        dealt.write.parquet(str(d / "events.parquet"))
        got = q_sequences.txn_rollup(spark, str(d))
        assert sorted(tuple(r) for r in got.collect()) == sorted(by_sql("txn_rollup", tmp_path / "1", "events"))


def test_a_report_makes_no_recourse_and_no_drivers(spark, sf_dir, monkeypatch):
    from riskbook.operators import run_book as book_runs
    from riskbook.plans import q_more

    def never(*_):
        raise AssertionError("the report doesn't show these")

    monkeypatch.setattr(book_runs, "book_recourse", never)
    monkeypatch.setattr(book_runs, "book_drivers", never)
    assert q_more.portfolio_result(spark, sf_dir).count() == 1


def test_onset_computes_the_curve_once(spark):
    """A curve that is an expression stands in the plan once, outside what runs for each month (F21)."""
    rows = spark.createDataFrame([(0.9, 12), (0.21, 84), (0.2, 60), (0.1, 36), (0.0, 12), (None, 12)], "p double, term int")
    curve = weibull_curve(F.col("p"), F.col("term"))
    got = rows.select("p", curve.alias("curve"), onset_month(curve).alias("onset"), onset_month(F.lit(None).cast("array<double>")).alias("none"))
    assert dict(got.dtypes)["onset"] == "int"
    for r in got.collect():
        assert r["onset"] == next((k for k, x in enumerate(r["curve"], 1) if x >= 0.2), None) and r["none"] is None
    plan = rows.select(onset_month(curve))._jdf.queryExecution().optimizedPlan().toString()
    lambdas = plan[plan.index("filter(") :] if "filter(" in plan else ""
    assert "transform(" not in lambdas


@pytest.mark.parametrize("n", [3000, 300])
def test_folds_without_a_corpus_are_those_of_the_table_without_it(spark, n):
    """One sort serves all corpora that are held out (F9, F11); also for a small table and rows of no corpus."""
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("c"))
    names = ["c0", "c1", "c2"]
    got = splits.splits_without(df, "y", "k", "c", names, "folds").collect()
    assert len(got) == n
    for i, name in enumerate(names):
        others = splits.split_for(df.where(~F.col("c").eqNullSafe(F.lit(name))), "y", "k", "folds")
        assert {r["k"]: r[f"_fold_{i}"] for r in got if r[f"_fold_{i}"]} == {r["k"]: r["fold"] for r in others.collect()}


def test_ranks_of_few_values_are_broadcast(spark):
    """They are those that values get which go to their ranks (F9)."""
    x = F.when(F.col("id") % 11 > 0, F.col("id") % 9).cast("double")
    df = spark.range(2000).select("id", F.when(F.col("id") % 13 > 0, F.col("id") % 3).alias("g"), x.alias("a"), F.when(F.col("id") % 17 == 0, float("nan")).otherwise(-0.0).alias("b"), (F.col("id") * 7 % 1999).alias("c"))
    to = {c: f"{c}_r" for c in "abc"}
    some = [sorted(map(tuple, evaluation.rank_columns(df, list("abc"), "g", to, few).select("id", *to.values()).collect())) for few in (0, 1500, 100_000)]
    assert len(some[0]) == 2000 and some[0] == some[1] == some[2]


def test_numbers_are_not_read_from_text(spark):
    """A column that is a number already is not written as text, cleaned and read (F10, F12, F14)."""
    df = spark.createDataFrame([(1.5, 2, "1,5%"), (float("nan"), None, "x"), (float("inf"), -3, None), (-0.0, 2**60 + 1, "$ 7"), (1e-300, 0, "")], "a double, b long, t string")
    got = df.select(*[f.alias(f"{c}{k}") for c in df.columns for k, f in enumerate((number_of(df, c), clean_numeric(F.col(c))))]).collect()
    assert all(str(r[f"{c}0"]) == str(r[f"{c}1"]) for r in got for c in df.columns)
    state = features.FeatureState("b", numeric={"a": 0.0})
    assert "regexp" not in state.transform(df)._jdf.queryExecution().optimizedPlan().toString()


def test_a_hazard_fit_reads_a_written_table(spark, sf_dir):
    """Each of its steps ran the joins of the book anew (F13)."""
    x, z = hazards.cox_columns(q_models.durations(spark, sf_dir), "months", q_models.NUMERIC)
    assert len(z) == 7 and "Join" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_attributions_are_computed_once(spark, sf_dir):
    """They were computed for their sums and again for the rows (F18)."""
    got = q_more.shap_tree(spark, sf_dir)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    rows = got.collect()
    assert len(rows) == 3 * 1500 and all(r["left_over"] == 0 for r in rows)


def test_a_loan_record_moves_each_loan_before_it_is_exploded(spark, sf_dir):
    """Drivers and fairness rows were shuffled after the explode (F17)."""
    got = q_models.loan_result(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(loan_id") == plan.count("REPARTITION_BY_COL")
    assert got.count() == 1500


@pytest.mark.parametrize("name", ["union_tokens", "category_codes", "tokenise"])
def test_rows_are_not_dealt_by_their_kind(spark, sf_dir, name):
    """Two kinds were two tasks for all rows, where the tables are too large to be broadcast unasked (F22)."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = getattr(q_sequences, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "hashpartitioning(type" not in plan and "hashpartitioning(channel" not in plan


def test_codes_of_many_values_are_those_of_few(spark):
    """Frequent values are broadcast, only rows of the others go to their codes; none is lost (F22)."""
    value = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 2 == 0, F.lit("v0")).when(F.col("id") % 3 == 0, "v1").otherwise(F.concat(F.lit("v"), (F.col("id") % 401).cast("string")))
    df = staged(spark.range(5000).select("id", value.alias("value")))
    rows = [(r["id"], r["value"]) for r in df.collect()]
    counts = {v: sum(v == x for _, x in rows) for v in {x for _, x in rows} - {None}}
    place = {v: k for k, v in enumerate(sorted(counts, key=lambda v: (-counts[v], v)))} | {None: -1}
    codes = sequences.code_book(df, "value")
    for few in (0, 5, 100, 10_000):
        got = sequences.with_codes(df, "value", codes, "code", few)
        assert sorted((r["id"], r["value"], r["code"]) for r in got.collect()) == [(k, v, place[v]) for k, v in sorted(rows)]
    none = sequences.with_codes(df.where("value IS NULL"), "value", sequences.code_book(df.where("value IS NULL"), "value"), "code")
    assert {r["code"] for r in none.collect()} == {-1}


def test_scores_by_arrays_are_those_of_the_ensemble(spark, tmp_path):
    """Recourse scores its trials by arrays; a row's largest contributions are picked where they are computed (F5)."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((900, 3)), 2)
    rows = [(k, int(a + b * c + rng.standard_normal() > 0.5), float(a), float(b), float(c)) for k, (a, b, c) in enumerate(x)]
    names = ["b", "c", "a"]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double, c double")
    bundle, folded = training.fit(df, "y", "k", names, [], trees=4)
    arrays = bundle.arrays(str(tmp_path / "arrays"))
    want = bundle.score(df).select("k", "p", *names).toPandas()
    assert np.abs(training.scores_of(arrays, want[names].to_numpy()) - want["p"]).max() < 1e-9 and want["p"].nunique() > 5
    got = df.select("k", training.scorer(arrays)(F.struct(*names)).alias("p")).toPandas().set_index("k")["p"]
    assert np.abs(got[want["k"]].to_numpy() - want["p"]).max() < 1e-9
    assert training.scores_of({"constant": 0.0}, np.zeros((2, 3))).tolist() == [training.LOW] * 2

    ready = bundle.model.stages[0].transform(df)
    all_, two = (attribution.shap_tree(ready, "k", "features", arrays["gbt"], names, most).toPandas() for most in (None, 2))
    assert len(all_) == 2700 and len(two) == 1800
    all_["size"] = -all_["contribution"].abs()
    best = all_.sort_values(["k", "size", "feature"]).groupby("k").head(2)
    assert set(zip(best["k"], best["feature"])) == set(zip(two["k"], two["feature"]))


def test_rows_of_one_kind_are_taken_once():
    import numpy as np

    for n in (0, 1, 8, 64, 65, 130):
        ways = np.random.default_rng(n).random((60, n))[np.arange(240) % 60] < 0.5
        first, kind = attribution.kinds(ways)
        assert (ways[first][kind] == ways).all() and len(first) == len({tuple(r) for r in ways.tolist()})


def test_reasons_take_one_test_a_field(spark):
    """The field was looked for once in each reason's test (F5)."""
    features = [*C.FIELDS, *[f"{f}_x" for f in C.FIELDS], "none", "x_loan_amount", "text_distress", None]
    df = spark.createDataFrame([(f,) for f in features], "f string").select("f", records.reason_of(F.col("f")).alias("r"), records.feature_base(F.col("f")).alias("b"))
    for f, r, b in df.collect():
        assert r == ("TEXT_DISTRESS_SIGNAL" if f and "distress" in f else C.REASONS.get(b, "OTHER"))
    plan = records.reason_of(F.col("f"))._jc.toString() if hasattr(F.col("f"), "_jc") else df._jdf.queryExecution().analyzed().toString()
    assert len(C.FIELDS) <= plan.lower().count("startswith") <= 2 * len(C.FIELDS) + 2
