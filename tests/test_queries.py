"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from riskbook import queries as book



def cells(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = ["" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else str(v) for v in df[c].astype(object).where(df[c].notna(), None).tolist()]
    return sorted(map(tuple, df.values.tolist()))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(book.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours, theirs = book.queries()[name](spark, sf_dir).toPandas(), duck.execute(book.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


def probability(df, *columns):
    return all(df[c].between(0, 1).all() and df[c].notna().all() for c in columns)


def better_than_chance(df):
    return probability(df, "auc") and (df["auc"] > 0.55).all()


def rising(df):
    """The calibrated value never falls as the raw one rises, and has the labels' mean on the calibration fold."""
    cal = df[df["fold"] == "cal"]
    return df.sort_values(["p_raw", "p"])["p"].is_monotonic_increasing and abs(cal["p"].mean() - cal["label"].mean()) < 0.01 and probability(df, "p", "p_raw")


MEMBERS = ["p_gbt", "p_forest", "p_logistic"]
#: What holds of the results that SQL can't express.
HOLDS = {
    "fit_booster": lambda x: len(x) == 1 and better_than_chance(x) and probability(x, "pr_auc", "brier", "ece"),
    "train_and_score": lambda x: len(x) == x["loan_id"].nunique() and probability(x, *MEMBERS, "p_raw", "p") and set(x["fold"]) == {"fit", "cal", "test"} and (x[MEMBERS].mean(axis=1) - x["p_raw"]).abs().max() < 1e-9 and (x["evaluated"] == (x["fold"] == "test")).all(),
    "train_and_score_metrics": lambda x: set(x["variant"]) == {"p_raw", "p"} and better_than_chance(x),
    "calibration_compare": lambda x: set(x["variant"]) == {*MEMBERS, "p_raw", "p"} and better_than_chance(x) and (x["n"] == x["n_test"]).all() and x.set_index("variant")["ece"]["p"] < x.set_index("variant")["ece"]["p_raw"],
    "leave_one_out": lambda x: len(x) == 5 and better_than_chance(x),
    "linear_probe": lambda x: len(x) == 1 and probability(x, "auc"),
    "embed_sequences": lambda x: x["client_id"].is_unique and all(abs(sum(v * v for v in e) - 1) < 1e-6 for e in x["embedding"]),
    "ablation": lambda x: set(x["variant"]) == {"tabular", "sequence", "both"} and probability(x, "auc", "pr_auc") and x.set_index("variant")["lift"]["tabular"] == 0 and x["n"].nunique() == 1,
    "cox_baseline": lambda x: len(x) == 36 and x.sort_values("month")["hazard"].is_monotonic_increasing and (x["hazard"] >= 0).all(),
    "loan_result": lambda x: x["loan_id"].is_unique and probability(x, "pd") and all(len(c) == 12 and abs(c[-1] - p) < 2e-4 for c, p in zip(x["curve"], x["pd"])) and all(1 <= len(v) <= 6 for v in x["drivers"]),
    "ensemble_mean": lambda x: (x[MEMBERS].mean(axis=1) - x["p_raw"]).abs().max() < 1e-9 and probability(x, *MEMBERS),
    "isotonic_calibrate": rising,
    "score_prior": lambda x: x["loan_id"].is_unique and probability(x, "p") and all((b == "high") == (p >= 0.5) for p, b in zip(x["p"], x["band"])) and x["p"].nunique() > 3,
    "stack_prior": lambda x: len(x) == 2 and better_than_chance(x) and x.set_index("mapping")["done"]["one field"].startswith("prior left out"),
    "pool_normalised_vs_raw": lambda x: set(x["variant"]) == {"raw", "ranks"} and (x["mean_auc"] > 0.55).all(),
    "shap_tree": lambda x: (x["left_over"].abs() < 1e-5).all() and x.groupby("loan_id").size().eq(3).all(),
    "run_book": lambda x: x["loan_id"].is_unique and probability(x, "p") and all((b == "high") == (p >= 0.5) for p, b in zip(x["p"], x["band"])) and all(abs(c[-1] - p) < 2e-4 for c, p in zip(x["curve"], x["p"])) and (x["new_p"] <= x["p"] + 1e-9).all() and x["drivers"].notna().mean() > 0.99 and (x["lever"] != "monitor").any() and x["explanation"].str.startswith("Risk is ").all() and x["p"].nunique() > 20,
    "score_stream_bundle": lambda x: x["loan_id"].is_unique and x["p"].notna().all() and (x["p"] == x["p_batch"]).all() and (x["n_bad_files"] == 2).all(),
    "portfolio_result": lambda x: len(x) == 1 and sum(x["distribution"][0].values()) == x["n"][0] and len(x["top"][0]) == 50 and len(x["fairness"][0]) == 3 and x["model"][0] != "fixed formula" and x["auc"][0] > 0.7 and len(x["warnings"][0]) == len(set(x["warnings"][0])) > 0,
}


def test_each_query_is_compared_or_checked():
    assert set(book.queries()) == set(book.oracle_sql()) | set(HOLDS)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_what_holds_of_other_results(spark, sf_dir, name):
    got = book.queries()[name](spark, sf_dir).toPandas()
    assert len(got) and HOLDS[name](got)
