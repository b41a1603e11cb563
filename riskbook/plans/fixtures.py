"""Views over the given tables that stand in for loan books, transactions and corpora, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "20260502"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) drawn from md5(key|seed); the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fixed_score(delinquencies: Column, score: Column, amount: Column) -> Column:
    """A fixed logistic formula that serves as a model where a query must not depend on training."""
    return logistic(-1.6 + 0.9 * (delinquencies - 1.3) - 0.006 * (score - 600) + 0.000004 * (amount - 250000))


def loan_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan for each order, with a fixed score p and a label drawn from it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("late"), F.round(F.sum("l_extendedprice"), 2).alias("collateral_value"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    book = orders.select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_totalprice").alias("loan_amount"), (12 * (1 + F.col("o_orderkey") % 7)).alias("term_months"), (8 + (F.col("o_custkey") % 33) * 0.5).cast("double").alias("interest_rate"),
        F.col("c_acctbal").alias("income_or_turnover"), (300 + (F.col("c_custkey") * 37) % 600).alias("credit_score"), F.coalesce("late", F.lit(0)).alias("prior_delinquencies"), "collateral_value",
        F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("region"), F.col("o_orderpriority").alias("community"), F.col("o_orderdate").cast("date").alias("loan_date"), F.col("o_orderstatus").alias("status"),
    )
    book = book.withColumn("u", uniform(F.col("loan_id"))).withColumn("p", fixed_score(F.col("prior_delinquencies"), F.col("credit_score"), F.col("loan_amount")))
    return book.withColumn("label", (F.col("u") < F.col("p")).cast("int"))


LOAN_BOOK = """
lines AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS late, round(sum(l_extendedprice), 2) AS collateral_value FROM lineitem GROUP BY 1),
raw_book AS (SELECT o_orderkey AS loan_id, o_totalprice AS loan_amount, 12 * (1 + o_orderkey % 7) AS term_months, CAST(8 + (o_custkey % 33) * 0.5 AS DOUBLE) AS interest_rate,
  c_acctbal AS income_or_turnover, 300 + (c_custkey * 37) % 600 AS credit_score, coalesce(late, 0) AS prior_delinquencies, collateral_value,
  c_mktsegment AS sector, n_name AS region, o_orderpriority AS community, CAST(o_orderdate AS DATE) AS loan_date, o_orderstatus AS status,
  CAST(('0x' || substr(md5(o_orderkey || '|20260502'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lines ON o_orderkey = l_orderkey),
scored_book AS (SELECT *, 1 / (1 + exp(-(-1.6::DOUBLE + 0.9::DOUBLE * (prior_delinquencies - 1.3::DOUBLE) - 0.006::DOUBLE * (credit_score - 600) + 0.000004::DOUBLE * (loan_amount - 250000)))) AS p FROM raw_book),
loan_book AS (SELECT *, CAST(u < p AS INT) AS label FROM scored_book)"""


def dirty_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan book as a messy file would have it: currency text, per cent text, statuses, ids that repeat."""
    book = loan_book(spark, sf_dir)
    return book.select(
        F.when(F.col("loan_id") % 50 == 0, (F.col("loan_id") - 1).cast("string")).otherwise(F.col("loan_id").cast("string")).alias("Loan ID"), F.col("loan_id").alias("row"),
        F.concat(F.lit("$"), F.format_number("loan_amount", 2)).alias("Amount"), F.when(F.col("loan_id") % 11 == 0, F.lit("n/a")).otherwise(F.concat(F.col("interest_rate").cast("string"), F.lit(" %"))).alias("Rate"),
        F.when(F.col("loan_id") % 13 == 0, None).when(F.col("label") == 1, " CHGOFF").otherwise("P I F").alias("Status"),
    )


DIRTY_BOOK = LOAN_BOOK + """,
dirty_book AS (SELECT CASE WHEN loan_id % 50 = 0 THEN CAST(loan_id - 1 AS VARCHAR) ELSE CAST(loan_id AS VARCHAR) END AS "Loan ID", loan_id AS row,
  '$' || format('{:,.2f}', loan_amount) AS "Amount", CASE WHEN loan_id % 11 = 0 THEN 'n/a' ELSE CAST(interest_rate AS VARCHAR) || ' %' END AS "Rate",
  CASE WHEN loan_id % 13 = 0 THEN NULL WHEN label = 1 THEN ' CHGOFF' ELSE 'P I F' END AS "Status" FROM loan_book)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bank transactions."""
    kind = F.when(F.col("event_type").isin("purchase", "error"), "V").otherwise("P")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client_id"), "event_id", F.col("ts").cast("date").alias("day"), F.col("value").alias("amount"), kind.alias("type"), F.col("event_type").alias("channel"))


TRANSACTIONS = """
txn AS (SELECT 'u' || user_id AS client_id, event_id, CAST(ts AS DATE) AS day, value AS amount, CASE WHEN event_type IN ('purchase', 'error') THEN 'V' ELSE 'P' END AS type, event_type AS channel FROM events)"""
