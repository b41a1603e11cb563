"""Ranges, ranks of many columns, order statistics, one-pass metrics, profiles: against plain Python and DuckDB."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riskbook.operators import cleaning, evaluation, hazards, loaders, running
from riskbook.operators.order_stats import medians, quantiles
from riskbook.sources import tables


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


ORDERS = {
    "date": [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(60)], "timestamp": [dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * k) for k in range(60)], "string": [f"L{k:03d}" for k in range(60)],
    "long": [2**53 + k for k in range(60)], "decimal(20,2)": [k for k in range(60)], "struct<a:int,b:string>": [(k // 7, f"x{k:02d}") for k in range(60)], "array<int>": [[k // 10, k] for k in range(60)],
}


@pytest.mark.parametrize("kind", ORDERS)
def test_sums_and_fills_over_any_order(spark, kind, monkeypatch):
    monkeypatch.setattr(running, "RANGES", 8)
    values, rng = ORDERS[kind], random.Random(1)
    rows = [(v, "g" if i % 3 else None, rng.choice([None, i]), i) for i, v in enumerate(values)]
    shuffled = rng.sample(rows, len(rows))
    if kind.startswith("decimal"):
        from decimal import Decimal

        shuffled = [(Decimal(a), b, c, d) for a, b, c, d in shuffled]
    df = spark.createDataFrame(shuffled, f"o {kind}, g string, v int, i int")
    got = {r["i"]: r["before"] for r in running.with_sums_before(df, ["g"], "o", {"before": "i"}).collect()}
    want, sums = {}, {}
    for _, g, _, i in rows:
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + i
    assert got == want
    filled = {r["i"]: r["v"] for r in hazards.term_fill(df, "v", "o", "g").collect()}
    for g in ("g", None):
        mine = [r for r in rows if r[1] == g]
        for k, r in enumerate(mine):
            back = next((x[2] for x in reversed(mine[: k + 1]) if x[2] is not None), None)
            assert filled[r[3]] == (back if back is not None else next((x[2] for x in mine[k:] if x[2] is not None), None))


def test_ranks_of_many_columns_read_the_input_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None, "few"] if k < 9 else ["a", "b", None]), *[rng.choice([None, float(rng.randint(0, 9)), rng.random()]) for _ in range(5)]) for k in range(300)]
    columns = [f"c{k}" for k in range(5)]
    spark.createDataFrame(rows, "id long, g string, " + ", ".join(f"{c} double" for c in columns)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    some, all_ = (evaluation.rank_columns(df, c, "g", {x: f"{x}_r" for x in c}) for c in (columns[:1], columns))
    assert scans(some) == scans(all_) <= 6
    con = duckdb.connect()
    con.execute(f"CREATE VIEW t AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    parts = ", ".join(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY g) >= 10 THEN (rank() OVER (PARTITION BY g, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY g, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY g) END AS {c}_r" for c in columns)
    want = con.execute(f"SELECT id, {parts} FROM t ORDER BY id").fetchall()
    got = [tuple(r) for r in all_.select("id", *[f"{c}_r" for c in columns]).orderBy("id").collect()]
    assert [tuple(None if v is None else round(v, 12) for v in r) for r in got] == [tuple(None if v is None else round(v, 12) for v in r) for r in want]
    own = evaluation.rank_columns(df, columns[:2], "g", {c: c for c in columns[:2]})
    assert sorted(own.columns) == sorted(df.columns) and [r["c0"] for r in own.orderBy("id").collect()] == [r[1] for r in got]


@pytest.mark.parametrize("few", [10**6, 40, 1])
def test_quantiles_are_those_of_duckdb(spark, few):
    rng = random.Random(3)
    rows = [(rng.choice([1.0, 1.0, 2.5, None]), rng.gauss(0, 1e6), 7.0, None, float(k), rng.expovariate(1) ** 9) for k in range(1500)]
    df = spark.createDataFrame(rows, "ties double, normal double, one double, none double, k double, tail double").repartition(3)
    con, frame = duckdb.connect(), df.toPandas()
    con.register("t", frame)
    shares = [0.5, 0.995, 0.0, 1.0, 0.25]
    got = quantiles(df, {c: F.col(c) for c in df.columns}, shares, few)
    for c in df.columns:
        want = con.execute(f"SELECT quantile_cont(CASE WHEN isnan({c}) THEN NULL ELSE {c} END::DOUBLE, {shares}) FROM t").fetchall()[0][0]
        assert got[c] == (list(want) if want is not None else [None] * 5)
    assert medians(df, {"x": F.col("ties")}, few)["x"] == got["ties"][0] and quantiles(df, {}, shares) == {}
    filled = cleaning.median_impute(df.select("ties", "none"), ["ties", "none"]).toPandas()
    assert filled["none"].eq(0).all() and filled["ties"].notna().all()


def test_metrics_in_five_scans_and_days_add_up(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), int(rng.random() < 0.3), round(rng.random(), 2), k % 2) for k in range(800)] + [("w", 1, 0.4, 0)] * 5
    spark.createDataFrame(rows, "seg string, y int, p double, day int").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    whole = evaluation.evaluate(df, ["seg"])
    assert scans(whole) <= 5
    days = evaluation.merged_scores([evaluation.score_table(df.where(f"day = {d}"), ["seg"]) for d in (0, 1)], ["seg"])
    shown = lambda x: sorted((r["seg"], *[round(r[c], 12) for c in ("n", "base_rate", "auc", "gini", "pr_auc", "brier", "ece")]) for r in x.collect())
    assert shown(whole) == shown(evaluation.evaluate_scores(days, ["seg"]))
    for seg, n, rate, auc, _, ap, brier, ece in shown(whole):
        mine = [(y, p) for s, y, p, _ in rows if s == seg]
        pos, neg = [p for y, p in mine if y], [p for y, p in mine if not y]
        assert n == len(mine) and math.isclose(rate, len(pos) / n)
        assert math.isclose(auc, sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if neg else 0.5, abs_tol=1e-9)
        assert math.isclose(brier, sum((p - y) ** 2 for y, p in mine) / n, abs_tol=1e-9)
        assert math.isclose(ap, sum(sum(y for y, q in mine if q >= p) / sum(q >= p for _, q in mine) for p in pos) / len(pos), abs_tol=1e-9)
        bins = {}
        for y, p in mine:
            bins.setdefault(min(9, sum(p >= e / 10 for e in range(1, 10))), []).append((y, p))
        assert abs(ece - sum(abs(sum(y for y, _ in b) - sum(p for _, p in b)) for b in bins.values()) / n) < 0.02


def test_profiles_shuffle_states_not_texts(spark, tmp_path):
    rows = [(k, f"text {k % 11}" if k % 4 else None, "" if k % 2 else "x", 40 + k % 3) for k in range(400)]
    spark.createDataFrame(rows, "id long, t string, e string, b int").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    got = {r["name"]: r for r in tables.profile_columns(df, "id", ["t", "e", "b"]).collect()}
    assert {n: r["n_unique"] for n, r in got.items()} == {"t": 11, "e": 2, "b": 3} and got["t"]["null_pct"] == 25.0
    assert got["t"]["sample"] == ["text 1", "text 2", "text 3", "text 5", "text 6"]
    catalog = tables.column_catalog({"p": df})
    assert {r["name"]: (r["n_unique"], r["is_binary"]) for r in catalog.collect()} == {"id": (400, False), "t": (11, False), "e": (2, True), "b": (3, False)}
    plan = catalog._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(array(struct(name" not in plan and "hashpartitioning" not in plan


def test_dates_of_mixed_forms_and_two_digit_years(spark):
    forms = {
        "28-Feb-97": "1997-02-28", "1-Jan-70": "1970-01-01", "1-Jan-69": "1969-01-01", "1-Jan-68": "2068-01-01", "7-dec-05": "2005-12-07", "07-DEC-2005": "2005-12-07", "3/4/99": "1999-03-04", "3/4/2001": "2001-03-04", "12/31/07": "2007-12-31", "2003-5-6": "2003-05-06",
        "2003-05-06 10:11:12": "2003-05-06", "2003-05-06T10:11:12": "2003-05-06", "Mar-2015": "2015-03-01", "Mar-15": "2015-03-01", "20110203": "2011-02-03", "5 Jun 1998": "1998-06-05", "Jun 5, 1998": "1998-06-05", " 2003-05-06 ": "2003-05-06", "n/a": None, "31/31/2001": None, "": None, None: None,
    }
    df = spark.createDataFrame([(x,) for x in forms], "x string").select("x", loaders.mixed_date("x").cast("string").alias("d"))
    assert {r["x"]: r["d"] for r in df.collect()} == forms
    late = spark.createDataFrame([("1-Jan-68",)], "x string").select(loaders.mixed_date("x", 50).cast("string").alias("d"))
    assert late.first()["d"] == "1968-01-01"
