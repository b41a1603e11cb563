"""Queries of training, explanation records and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskbook import catalog as C
from riskbook.functions import rounded
from riskbook.operators import evaluation, features, hazards, json_recovery, sequences, training
from riskbook.plans.fixtures import LOAN_BOOK, fixed_score, loan_book, table
from riskbook.plans.q_book import SQL as BOOK_SQL
from riskbook.plans.q_sequences import tokens
from riskbook.plans.q_tables import scratch
from riskbook.streaming.score import decide, score_stream as run_stream

QUERIES: dict = {}
SQL: dict = {}
BOOK = "WITH " + LOAN_BOOK + "\n"
FEATURE_MAP = {"loan_id": "loan_id", "loan_amount": "loan_amount", "credit_score": "credit_score", "collateral_value": "collateral_value", "sector": "sector", "region": "region", "community": "community", "target": "label"}
NUMERIC = ["loan_amount", "term_months", "interest_rate", "income_or_turnover", "credit_score", "prior_delinquencies", "collateral_value"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def numbers(spark, d):
    return loan_book(spark, d).select("loan_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC], "sector", "label")


@query()
def fit_booster(spark, d):
    """Metrics of a boosted model on rows that it was not fitted on."""
    bundle, folded = training.fit(numbers(spark, d), "label", "loan_id", NUMERIC, ["sector"], ("gbt",), trees=10)
    return training.metrics_by_variant(bundle.score(folded.where("evaluated")), "label", ["p"])


@query()
def train_and_score(spark, d):
    """Every loan scored by a calibrated ensemble of boosted trees, a forest and a logistic model."""
    bundle, folded = training.fit(numbers(spark, d), "label", "loan_id", NUMERIC, ["sector"], trees=10)
    return bundle.score(folded).select("loan_id", "fold", "evaluated", "label", *[f"p_{m}" for m in training.MEMBERS], "p_raw", "p")


@query()
def train_and_score_metrics(spark, d):
    """The metrics of train_and_score, on the evaluated rows."""
    return training.metrics_by_variant(train_and_score(spark, d).where("evaluated"), "label", ["p_raw", "p"])


@query()
def calibration_compare(spark, d):
    """Metrics of each member, of their mean, and of the calibrated mean, with the sizes of the folds."""
    bundle, folded = training.fit(numbers(spark, d), "label", "loan_id", NUMERIC, ["sector"], trees=10)
    sizes = folded.agg(*[F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in ("fit", "cal", "test")])
    return training.metrics_by_variant(bundle.score(folded.where("evaluated")), "label", [*[f"p_{m}" for m in training.MEMBERS], "p_raw", "p"]).crossJoin(F.broadcast(sizes))


@query()
def leave_one_out(spark, d):
    return training.leave_one_out(numbers(spark, d), "sector", "label", "loan_id", NUMERIC, members=("gbt",), trees=5)


@query()
def linear_probe(spark, d):
    vectors = table(spark, d, "embeddings").withColumn("bad", (F.col("label") >= 5).cast("int"))
    return training.linear_probe(vectors, "embedding", "bad", "vec_id")


@query()
def embed_sequences(spark, d):
    return training.embed_sequences(sequences.sequence_store(tokens(spark, d), "client_id", ["day", "event_id"], least=1), "client_id")


@query()
def ablation(spark, d):
    """Loans of customers with a history: does it add to the loan's own columns? All numbers of the vectors take part."""
    vectors = embed_sequences(spark, d)
    names = [f"seq_{i}" for i in range(32)]
    vectors = vectors.select(F.substring("client_id", 2, 20).cast("bigint").alias("c_custkey"), *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("c_custkey"))
    book = numbers(spark, d).join(owner, "loan_id").join(vectors, "c_custkey")
    return training.ablation(book, "label", "loan_id", NUMERIC, names)


_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(BOOK + ", m AS (SELECT median(collateral_value) AS c FROM loan_book WHERE loan_id % 2 = 1) SELECT loan_id, loan_amount, CAST(credit_score AS DOUBLE) AS credit_score, coalesce(collateral_value, c) AS collateral_value, " + ", ".join(f"CAST(sector = '{v}' AS DOUBLE) AS sector_{v}" for v in _LEVELS) + ", 0.0::DOUBLE AS sector___OTHER__ FROM loan_book, m WHERE loan_id % 2 = 0")
def build_features(spark, d):
    """The feature matrix of loans of even id, by what was learned on those of odd id."""
    book = loan_book(spark, d).drop("p", "u")
    state = features.fit_features(book.where("loan_id % 2 = 1"), FEATURE_MAP, "loan_id")
    return features.FeatureState.from_json(state.to_json()).transform(book.where("loan_id % 2 = 0"))


def durations(spark, d):
    return loan_book(spark, d).select("loan_id", F.col("label").alias("event"), (1 + F.col("loan_id") % 36).cast("double").alias("months"), *NUMERIC)


@query(BOOK + """, x AS (SELECT 1 + loan_id % 36 AS month, sum(label) AS d, count(*) AS w FROM loan_book GROUP BY 1), r AS (SELECT *, sum(w) OVER (ORDER BY month DESC) AS risk FROM x)
SELECT month, round(sum(d / risk) OVER (ORDER BY month), 6) AS hazard FROM r""")
def cumulative_hazard(spark, d):
    return hazards.cumulative_hazard(durations(spark, d), "months", "event").select("month", rounded("hazard", 6).alias("hazard"))


@query()
def cox_baseline(spark, d):
    """The baseline of a Cox fit on the columns of highest variance, standardised."""
    x, z = hazards.cox_columns(durations(spark, d), "months", NUMERIC)
    beta = hazards.cox_fit(x, "months", "event", z)
    score = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, z)), F.lit(0.0))
    return hazards.cumulative_hazard(x.withColumn("score", score), "months", "event", "score")


_SPARSE = BOOK + """, x AS (SELECT 2 + 3 * (loan_id % 9) AS month, sum(label) AS d, count(*) AS w FROM loan_book GROUP BY 1), r AS (SELECT *, sum(w) OVER (ORDER BY month DESC) AS risk FROM x), h AS (SELECT month, sum(d / risk) OVER (ORDER BY month) AS hazard FROM r),
n AS (SELECT m, max_by(month, month) FILTER (WHERE month <= m) AS a, min_by(month, month) FILTER (WHERE month >= m) AS b FROM h, range(1, 13) t(m) GROUP BY m),
i AS (SELECT m, CASE WHEN a IS NULL THEN y.hazard WHEN a = b THEN x.hazard ELSE x.hazard + (m - a) / (b - a) * (y.hazard - x.hazard) END AS hz FROM n LEFT JOIN h x ON x.month = a LEFT JOIN h y ON y.month = b),
s AS (SELECT m AS month, 1 - exp(-hz) AS p FROM i)
"""


def sparse_shape(spark, d):
    """A shape from durations of every third month only."""
    x = loan_book(spark, d).select(F.col("label").alias("event"), (2 + 3 * (F.col("loan_id") % 9)).cast("double").alias("months"))
    return hazards.hazard_shape(hazards.cumulative_hazard(x, "months", "event"))


@query(_SPARSE + "SELECT month, round(p / (SELECT p FROM s WHERE month = 12), 6) AS share FROM s")
def hazard_shape(spark, d):
    return sparse_shape(spark, d).select(F.posexplode("shape").alias("i", "share")).select((F.col("i") + 1).cast("bigint").alias("month"), rounded("share", 6).alias("share"))


@query(BOOK + """, f AS (SELECT loan_id, sector, CASE WHEN loan_id % 5 < 2 THEN NULL ELSE term_months END AS t FROM loan_book)
SELECT loan_id, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY sector ORDER BY loan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(t IGNORE NULLS) OVER (PARTITION BY sector ORDER BY loan_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM f""")
def term_fill(spark, d):
    x = loan_book(spark, d).select("loan_id", "sector", F.when(F.col("loan_id") % 5 < 2, None).otherwise(F.col("term_months")).alias("t"))
    return hazards.term_fill(x, "t", "loan_id", "sector").select("loan_id", "t")


def json_lines(spark, d):
    p = F.col("props")
    kinds = F.when(F.col("event_id") % 5 == 0, p).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("Here: "), p, F.lit(" as asked"))).when(F.col("event_id") % 5 == 3, F.regexp_replace(p, '"', "'"))
    return table(spark, d, "events").select("event_id", kinds.otherwise(F.expr("substring(props, 1, length(props) - 1)")).alias("line"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 4 END AS layer, CASE WHEN event_id % 5 >= 3 THEN 'repaired' ELSE 'ok' END AS status, props AS object FROM events")
def recover_json(spark, d):
    return json_recovery.recover_json(json_lines(spark, d), "line").select("event_id", "layer", "status", "object")


@query("""WITH e AS (SELECT event_id, value, value / 10 <= 1 AND value >= 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS valid FROM events)
SELECT event_id, valid, CASE WHEN valid THEN 'ok' ELSE 'degraded' END AS status, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS pd, CASE WHEN valid AND event_id % 2 = 0 THEN 0.25 END::DOUBLE AS pd_after, CASE WHEN valid THEN CASE WHEN event_id % 3 = 0 THEN 'SECTOR_RISK' ELSE 'OTHER' END || ',LIQUIDITY_STRESS' ELSE '' END AS codes FROM e""")
def validate_record(spark, d):
    k = F.col("event_id")
    one = F.struct(F.lit("sector").alias("feature"), (F.col("value") / 10).alias("weight"), F.when(k % 11 == 0, "sideways").otherwise("increases_risk").alias("direction"), F.when(k % 3 == 0, "sector_risk").otherwise("unheard_of").alias("code"))
    two = F.struct(F.lit("dscr").alias("feature"), F.lit(1.0).alias("weight"), F.lit("decreases_risk").alias("direction"), F.lit("Liquidity_Stress").alias("code"))
    text = F.to_json(F.struct(F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("pd"), F.when(k % 2 == 0, 0.25).alias("pd_after"), F.array(one, two).alias("drivers")))
    rows = json_recovery.validate_records(table(spark, d, "events").select("event_id", text.alias("record")), "record", [*dict.fromkeys(C.REASONS.values()), "OTHER"])
    return rows.select("event_id", "valid", "status", "pd", "pd_after", F.concat_ws(",", F.transform("drivers", lambda x: x["code"])).alias("codes"))


@query("SELECT r.corpus, coalesce(e.n, 0) AS n, e.base_rate, e.auc, e.pr_auc, e.ece, CASE WHEN e.n IS NULL THEN 'failed' ELSE 'ok' END AS status FROM (SELECT DISTINCT c_mktsegment AS corpus FROM customer UNION ALL SELECT 'NONE') r LEFT JOIN (" + BOOK_SQL["evaluate"] + ") e ON r.corpus = e.sector")
def metrics_report(spark, d):
    x = loan_book(spark, d).select(F.col("sector").alias("corpus"), F.col("label").alias("y"), "p")
    expected = table(spark, d, "customer").select(F.col("c_mktsegment").alias("corpus")).distinct().unionByName(spark.createDataFrame([("NONE",)], "corpus string"))
    return evaluation.round_all(evaluation.metrics_report(x, expected), ["base_rate", "auc", "pr_auc", "ece"], 5)


@query(BOOK + "SELECT loan_id, CASE WHEN p >= 0.5 THEN 'high' WHEN p >= 0.2 THEN 'medium' ELSE 'low' END AS band, round(p, 6) AS pd FROM loan_book")
def score_stream(spark, d):
    """The loan book written as files, scored as a stream by the fixed formula."""
    path = scratch(spark)
    book = loan_book(spark, d).select("loan_id", "loan_amount", "term_months", "credit_score", "prior_delinquencies")
    book.write.parquet(f"{path}/in")
    score = lambda df: df.withColumn("p", fixed_score(F.col("prior_delinquencies"), F.col("credit_score"), F.col("loan_amount")))
    return run_stream(spark, f"{path}/in", book.schema, score, f"{path}/out", f"{path}/checkpoint").select("loan_id", "band", rounded("p", 6).alias("pd"))


@query()
def loan_result(spark, d):
    """A nested record for each loan: score, curve, alert, drivers, fairness."""
    from riskbook.operators import portfolio, records
    from riskbook.operators.staging import staged
    from riskbook.plans.q_book import ATTRIBUTES

    book = staged(loan_book(spark, d).drop("u", "loan_date", "status")).repartition("loan_id")  # so a loan's rows stay where they are
    facts = decide(book).select("loan_id", F.round("p", 4).alias("pd"), "band", F.transform("curve", lambda x: F.round(x, 4)).alias("curve"), "onset")
    mine = records.top_drivers(records.shap_linear(book)).groupBy("loan_id").agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "contribution", "weight", "direction", "code"))).alias("drivers"))  # six at most
    fair = portfolio.loan_fairness(book.withColumn("y", F.col("label")), ATTRIBUTES).select("loan_id", F.struct("review", "attributes").alias("fairness"))
    return facts.join(mine, "loan_id", "left").join(fair, "loan_id", "left")
