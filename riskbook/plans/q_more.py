"""Queries of verdicts, priors, attribution, and reports."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskbook import catalog as C
from riskbook.functions import risk_band, rounded, weibull_curve
from riskbook.operators import attribution, evaluation, portfolio, prior, records, training, verdicts
from riskbook.operators import run_book as book_runs
from riskbook.operators.staging import staged
from riskbook.plans.fixtures import LOAN_BOOK, loan_book, table
from riskbook.plans.q_book import _SHAP, _TRIALS, ATTRIBUTES, claims, drivers, recourse_score
from riskbook.plans.q_book import SQL as BOOK_SQL
from riskbook.plans.q_models import _SPARSE, NUMERIC, numbers, sparse_shape
from riskbook.plans.q_tables import scratch
from riskbook.streaming.score import score_files as run_files

QUERIES: dict = {}
SQL: dict = {}
BOOK = "WITH " + LOAN_BOOK + "\n"
WEIBULL_SQL = BOOK_SQL["weibull_curves"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_SHAP + """, s0 AS (SELECT loan_id, loan_id % 7 <> 0 AND loan_id % 11 <> 0 AS faithful, CASE WHEN loan_id % 7 = 0 AND loan_id % 11 <> 0 THEN string_agg(feature, ',' ORDER BY feature) END AS f FROM d WHERE rank <= 2 GROUP BY loan_id)
SELECT loan_id, CASE WHEN loan_id % 4 = 0 THEN faithful ELSE faithful AND (loan_id % 3 = 0 OR loan_id % 5 <> 0) END AS faithful, concat_ws(',', f, CASE WHEN loan_id % 4 <> 0 THEN 'x' END) AS flips, CASE WHEN loan_id % 4 <> 0 AND loan_id % 5 = 0 THEN 'a claim' ELSE '' END AS claims FROM s0""")
def combine_verdict(spark, d):
    structure = records.structural_faithfulness(claims(spark, d), drivers(spark, d)).select("loan_id", "faithful", "flips")
    judged = structure.where("loan_id % 4 <> 0").select("loan_id", (F.col("loan_id") % 3 == 0).alias("judged"), F.when(F.col("loan_id") % 5 == 0, F.array(F.lit("a claim"), F.lit(" "))).otherwise(F.array(F.lit(" "))).alias("claims"), F.array(F.lit("x")).alias("judged_flips"))
    return verdicts.combine_verdict(structure, judged).select("loan_id", "faithful", *[F.concat_ws(",", F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in ("flips", "claims")])


@query("SELECT o_orderkey AS loan_id, CASE WHEN o_orderkey % 6 = 0 THEN 1 WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 < o_orderkey % 5 THEN 2 ELSE 1 END AS attempt FROM orders")
def choose_retry(spark, d):
    k = F.col("o_orderkey")
    both = table(spark, d, "orders").select(k.alias("loan_id"), F.explode(F.when(k % 6 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("attempt"))
    attempts = both.select("loan_id", "attempt", ((F.col("attempt") == 2) & (F.col("loan_id") % 3 == 0)).alias("faithful"), F.when(F.col("attempt") == 1, F.col("loan_id") % 5).otherwise(F.col("loan_id") % 4).alias("issues"))
    return verdicts.choose_retry(attempts)


@query("SELECT o_orderkey AS loan_id, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE CASE o_orderkey % 4 WHEN 1 THEN 'B' WHEN 2 THEN 'AB' ELSE 'A' END END AS text FROM orders")
def consensus_choice(spark, d):
    k = F.col("o_orderkey") % 4
    choice = F.when(k == 0, "a").when(k == 1, "b").otherwise("merged")
    text = verdicts.consensus(choice, F.lit("A"), F.lit("B"), F.when(k == 2, "AB").otherwise(" "), F.col("o_orderkey") % 3 != 0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("loan_id"), text.alias("text"))


_BEST = _TRIALS + """, h AS (SELECT *, CASE WHEN new_p <= CASE WHEN p > 0.2 THEN least(0.2, 0.6 * p) ELSE greatest(0.02, 0.5 * p) END AND new_p < p THEN 1 ELSE 0 END AS hit FROM n),
o AS (SELECT *, coalesce(max(hit) OVER (PARTITION BY loan_id, lever ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY new_p, lever, step_no) AS k FROM o WHERE done = 0),
r AS (SELECT loan_id, p, CASE WHEN p - new_p >= 0.004 THEN new_p ELSE p END AS new_p FROM b WHERE k = 1)
"""


@query(_BEST + "SELECT l.loan_id, round(coalesce(r.new_p, greatest(0.02, 0.6 * l.p)), 6) AS pd_after FROM loan_book l LEFT JOIN r ON l.loan_id = r.loan_id AND l.loan_id % 2 = 0")
def ground_action(spark, d):
    book = loan_book(spark, d)
    found = portfolio.find_recourse(book, recourse_score()).where("loan_id % 2 = 0")
    proposed = book.select("loan_id", F.greatest(F.lit(0.02), 0.6 * F.col("p")).alias("pd_after"))
    return verdicts.ground_action(proposed, found).select("loan_id", rounded("pd_after", 6).alias("pd_after"))


_FILLED = " ".join(f"WHEN '{name}' THEN replace(replace(replace('{words}', '{{step}}', CASE WHEN lever <> 'interest_rate' AND step = floor(step) THEN CAST(CAST(step AS INT) AS VARCHAR) ELSE CAST(step AS VARCHAR) END), '{{value}}', CAST(CAST(trunc(changed) AS INT) AS VARCHAR)), '{{percent}}', CAST(CAST(round(step * 100) AS INT) AS VARCHAR))" for name, words in C.ACTIONS.items())


@query(_TRIALS + f"SELECT loan_id, lever, CAST(step_no AS INT) AS step_no, CASE lever {_FILLED} END AS action FROM t")
def action_text(spark, d):
    return portfolio.trials(loan_book(spark, d)).select("loan_id", "lever", "step_no", verdicts.action_text(F.col("lever"), F.col("step"), F.col("changed")).alias("action"))


@query(BOOK + ", r AS (SELECT loan_id, row_number() OVER (ORDER BY p DESC, loan_id) AS k FROM loan_book) SELECT loan_id FROM r WHERE k <= 12")
def eager_set(spark, d):
    return portfolio.top_risk(loan_book(spark, d), 12).select("loan_id")


@query("SELECT o_custkey, string_agg(w, '|' ORDER BY k) AS warnings FROM (SELECT o_custkey, 'status ' || o_orderstatus AS w, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY 1")
def dedupe_warnings(spark, d):
    said = F.struct("o_orderkey", F.concat(F.lit("status "), "o_orderstatus").alias("w"))
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min(said).alias("s"))  # three a customer
    lists = per.groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("x"))
    return lists.select("o_custkey", F.concat_ws("|", F.array_distinct(F.transform("x", lambda s: s["w"]))).alias("warnings"))


@query("SELECT o_orderkey AS loan_id, 0.0001::DOUBLE AS p FROM orders")
def degenerate_prior(spark, d):
    """With one class only, every loan gets the base rate."""
    x = numbers(spark, d).withColumn("label", F.lit(0))
    bundle, folded = training.fit(x, "label", "loan_id", NUMERIC, [])
    return bundle.score(folded).select("loan_id", "p")


@query()
def ensemble_mean(spark, d):
    """The members' probabilities and their plain mean on the evaluated rows."""
    bundle, folded = training.fit(numbers(spark, d), "label", "loan_id", NUMERIC, [], trees=5)
    return bundle.score(folded.where("evaluated")).select("loan_id", *[f"p_{m}" for m in training.MEMBERS], "p_raw")


@query()
def isotonic_calibrate(spark, d):
    """Calibrated against raw probabilities: monotone and bounded."""
    bundle, folded = training.fit(numbers(spark, d), "label", "loan_id", NUMERIC, [], ("logistic",))
    return bundle.score(folded).select("loan_id", "fold", "label", "p_raw", "p")


MAPPING = {"loan_amount": "loan_amount", "term_months": "term_months", "interest_rate": "interest_rate", "income_or_turnover": "income_or_turnover", "credit_score": "credit_score", "sector": "sector", "prior_delinquencies": "prior_delinquencies", "employment_length": None}
RANKED = ["can_loan_amount", "can_income", "can_credit_score_n"]


def sector_prior(spark, d):
    """A prior of all sectors but one, trained on ranks within each sector."""
    x = staged(prior.to_canonical(numbers(spark, d).where("sector <> 'BUILDING'"), MAPPING))
    x = evaluation.rank_columns(x, RANKED, "sector", {c: c for c in RANKED})
    use = ["can_loan_amount", "can_term_months", "can_interest_rate", "can_income", "can_credit_score_n", "can_delinq_count", "can_installment"]
    return training.fit(x.select("loan_id", "label", *use), "label", "loan_id", use, [], ("gbt", "logistic"), trees=5)[0]


@query()
def score_prior(spark, d):
    """A prior trained on all but one sector scores that sector's loans, with no outcome given."""
    mine = loan_book(spark, d).where("sector = 'BUILDING'").drop("label", "p", "u")
    scored = prior.score_prior(sector_prior(spark, d), mine, MAPPING, RANKED)
    return scored.select("loan_id", F.col("prior_pd").alias("p"), risk_band(F.col("prior_pd")).alias("band"))


@query()
def stack_prior(spark, d):
    """The prior's probability as one more column of a book's own model; left out where too little is mapped."""
    mine, model = staged(numbers(spark, d).where("sector = 'BUILDING'")), sector_prior(spark, d)
    parts = []
    for name, mapping in (("all fields", MAPPING), ("one field", {"loan_amount": "loan_amount"})):
        stacked, done = prior.stack_prior(mine, model, mapping, RANKED)
        columns = ["prior_delinquencies", "credit_score"] + [c for c in ("prior_pd",) if c in stacked.columns]
        bundle, folded = training.fit(stacked, "label", "loan_id", columns, [], ("logistic",))
        parts.append(training.metrics_by_variant(bundle.score(folded.where("evaluated")), "label", ["p"]).select(F.lit(name).alias("mapping"), F.lit(done).alias("done"), "n", "auc", "brier"))
    return parts[0].unionByName(parts[1])


@query()
def pool_normalised_vs_raw(spark, d):
    """Mean transfer AUC over held-out sectors, with raw and with rank-normalised columns."""
    x, parts = staged(evaluation.rank_columns(numbers(spark, d), NUMERIC, "sector", {c: f"{c}_rank" for c in NUMERIC})), []
    for name, columns in (("raw", NUMERIC), ("ranks", [f"{c}_rank" for c in NUMERIC])):
        parts.append(training.leave_one_out(x, "sector", "label", "loan_id", columns, members=("logistic",)).withColumn("variant", F.lit(name)))
    return parts[0].unionByName(parts[1]).groupBy("variant").agg(F.round(F.avg("auc"), 5).alias("mean_auc"))


@query(_SPARSE + """SELECT loan_id, month, round(loan_book.p * s.p / (SELECT p FROM s WHERE month = 12), 6) AS pd, false AS estimated FROM loan_book, s WHERE loan_id % 2 = 0
UNION ALL SELECT loan_id, month, pd, true FROM (""" + WEIBULL_SQL + """) WHERE loan_id % 2 = 1""")
def build_curves(spark, d):
    """Each loan's probability spread over the population's shape, or, for those outside it, over the parametric one."""
    book = loan_book(spark, d).select("loan_id", "p", "term_months", (F.col("loan_id") % 2 == 0).alias("observed"))
    shape = sparse_shape(spark, d)
    curve = F.when(F.col("shape").isNotNull() & F.col("observed"), F.transform("shape", lambda s: F.least(F.lit(1.0), F.col("p") * s))).otherwise(weibull_curve(F.col("p"), F.col("term_months")))
    rows = book.crossJoin(F.broadcast(shape)).select("loan_id", (~F.col("observed") | F.col("shape").isNull()).alias("estimated"), F.posexplode(curve).alias("i", "pd"))  # one row
    return rows.select("loan_id", (F.col("i") + 1).cast("bigint").alias("month"), rounded("pd", 6).alias("pd"), "estimated")


@query()
def shap_tree(spark, d):
    """Attributions of a small boosted model's margin, with what is left unexplained (zero)."""
    names = ["credit_score", "prior_delinquencies", "loan_amount"]
    x = VectorAssembler(inputCols=names, outputCol="features").transform(staged(numbers(spark, d).select("loan_id", "label", *names)))
    model = training.GBTClassifier(labelCol="label", maxIter=5, maxDepth=3, seed=7).fit(x)
    parts = attribution.shap_tree(x, "loan_id", "features", attribution.tree_arrays(model, scratch(spark)), names)
    margin = model.transform(x).select("loan_id", (vector_to_array("rawPrediction")[1] / 1).alias("margin"))
    sums = parts.groupBy("loan_id").agg(F.sum("contribution").alias("explained"), F.first("base").alias("base"), F.collect_list(F.struct("feature", "contribution")).alias("own"))  # three
    rows = sums.join(margin, "loan_id").select("loan_id", F.round(F.col("margin") - F.col("explained") - F.col("base"), 6).alias("left_over"), F.explode("own").alias("x"))
    return rows.select("loan_id", "x.feature", "x.contribution", "left_over")


#: What the book's columns are, for a whole run.
RUN_MAP = {"loan_id": "loan_id", "loan_amount": "loan_amount", "term_months": "term_months", "interest_rate": "interest_rate", "income_or_turnover": "income_or_turnover", "credit_score": "credit_score", "prior_delinquencies": "prior_delinquencies", "collateral_value": "collateral_value", "sector": "sector", "region": "region", "community": "community", "target": "label"}


def book_run(spark, d):
    """The loan book of the given tables, of which every fiftieth loan has no outcome yet."""
    book = loan_book(spark, d).drop("p", "u").withColumn("label", F.when(F.col("loan_id") % 50 != 0, F.col("label")))
    return book_runs.run_book(book, RUN_MAP, "loan_id", "label", ATTRIBUTES)


@query()
def run_book(spark, d):
    """A record for each loan of a whole run with a fitted ensemble."""
    x = book_run(spark, d).records
    return x.select("loan_id", "pd", "p", "band", "curve", "onset", "drivers", "explanation", "pd_after", F.col("recourse.lever").alias("lever"), F.col("recourse.new_p").alias("new_p"), F.col("fairness.review").alias("review"))


@query()
def portfolio_result(spark, d):
    """One row: model, metrics, distribution, top loans, fairness, mapping and warnings of a whole run."""
    return book_runs.report(book_run(spark, d), RUN_MAP, "loan_id", "label", ATTRIBUTES)


@query()
def score_stream_bundle(spark, d):
    """Loans that arrive in files (two more are of another make) scored by a saved model, in several batches and after a
    restart, beside the same model's batch scores."""
    book = staged(loan_book(spark, d).drop("p", "u"))  # fitting reads it a few times for each column
    model, _ = book_runs.fit_book(book, RUN_MAP, "loan_id", "label", trees=5)
    path = scratch(spark)
    model.save(f"{path}/model")
    loaded = book_runs.BookModel.load(f"{path}/model")
    files = book.drop("label")
    files.repartition(4, "loan_id").write.parquet(f"{path}/in/a")
    files.limit(5).withColumn("loan_amount", F.col("loan_amount").cast("string")).coalesce(1).write.parquet(f"{path}/in/b")
    score = lambda df: loaded.score(df, ["term_months"])
    parts = (f"{path}/in", files.schema, score, f"{path}/out", f"{path}/quarantine", f"{path}/checkpoint", 2)
    run_files(spark, *parts)
    files.limit(5).drop("sector").coalesce(1).write.parquet(f"{path}/in/c")
    run_files(spark, *parts)  # goes on where it ended
    n_bad = spark.read.parquet(f"{path}/quarantine").count()
    batch = model.score(book, ["term_months"]).select("loan_id", F.round("p", 6).alias("p_batch"))
    return spark.read.parquet(f"{path}/out").select("loan_id", "band", F.round("p", 6).alias("p")).join(batch, "loan_id", "full").withColumn("n_bad_files", F.lit(n_bad))
