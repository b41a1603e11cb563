"""Corpus preparation: point-in-time filters, rollups of child tables, panels, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import rank_columns
from .splits import hash_rank


def label_filter(df: DataFrame, column: str, good: list[str], bad: list[str]) -> DataFrame:
    """Rows of a known outcome, with label 1 for a bad one."""
    return df.where(F.col(column).isin(good + bad)).withColumn("label", F.col(column).isin(bad).cast("int"))


def pit_filter(events: DataFrame, decisions: DataFrame, key: str, event_date: str, decision_date: str) -> DataFrame:
    """Events strictly before their decision: nothing from the future can be a feature."""
    return events.join(decisions, key).where(F.col(event_date) < F.col(decision_date))


def leakage_share(events: DataFrame, decisions: DataFrame, key: str, event_date: str, decision_date: str) -> DataFrame:
    """The share of events on or after the decision."""
    return events.join(decisions, key).agg(F.avg((F.col(event_date) >= F.col(decision_date)).cast("double")).alias("leakage_share"))


def txn_rollup(df: DataFrame, client: str, amount: str, kind: str, balance: str, order: list[str] = ()) -> DataFrame:
    """One row for each account: count, moments of amounts and balances, debits, credits and their ratio, and the share of
    rows with a negative balance, in one grouping. With an order, an account's doubles are added up in it, so that the last bit
    (which decides ties when they are rounded) doesn't depend on how rows are dealt; its rows then meet in one task, one by one."""
    a, b, debit = F.col(amount), F.col(balance), F.col(kind).startswith("V")
    if order:
        df = df.select(client, *order, amount, kind, balance).repartition(client).sortWithinPartitions(client, *order)
    sums = df.groupBy(client).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_amount"), F.stddev_samp(a).alias("std_amount"), F.max(a).alias("max_amount"), F.avg(b).alias("mean_balance"), F.min(b).alias("min_balance"), F.stddev_samp(b).alias("std_balance"),
        F.sum(F.when(debit, a)).alias("debits"), F.sum(F.when(F.col(kind).startswith("P"), a)).alias("credits"), F.avg((b < 0).cast("double")).alias("negative_share"),
    )
    return sums.withColumn("credit_ratio", F.try_divide("credits", "debits"))


def payment_to_balance(payment: Column, mean_balance: Column) -> Column:
    return F.try_divide(payment, F.when(mean_balance != 0, mean_balance))


def multi_left_join(base: DataFrame, sides: list[tuple[DataFrame, str]]) -> DataFrame:
    """Tables joined to a base one after another, each on the base's column that its tuple names (the side's own key has
    the same name); a column that is there already gets the side's number as a suffix."""
    for k, (side, key) in enumerate(sides, 1):
        taken = {c.lower() for c in base.columns}
        renamed = side.select(F.col(key).alias("_key"), *[F.col(c).alias(f"{c}_{k}" if c.lower() in taken else c) for c in side.columns if c != key])
        base = base.join(renamed, F.col(key) == F.col("_key"), "left").drop("_key")
    return base


def bureau_rollup(parents: DataFrame, children: DataFrame, key: str, amount: str, overdue: str, active: Column) -> DataFrame:
    """Child records summed up for each parent and joined to it; parents without any have nulls and a count of 0."""
    sums = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_records"), F.avg(amount).alias("mean_amount"), F.max(overdue).alias("max_overdue"), F.sum(amount).alias("sum_amount"), F.sum(overdue).alias("sum_overdue"), F.count_if(active).alias("n_active"))
    return parents.join(sums, key, "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))


def panel_aggregate(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of every column: mean, sample deviation, smallest, largest and last non-null value, and the number of rows, in one grouping.
    Of rows that tie in the order, the larger value is the last."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(f"{c}_last")]
    return df.groupBy(key).agg(*aggs)


def static_join(base: DataFrame, side: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A side table's first row for each key joined to the base, its numeric columns only."""
    numeric = [c for c, t in side.dtypes if c != key and t in ("int", "bigint", "double", "float")]
    first = side.groupBy(key).agg(F.min_by(F.struct(*numeric), F.struct(*order)).alias("_first"))
    return base.join(first, key, "left").select(*base.columns, *[F.col(f"_first.{c}").alias(c) for c in numeric])


def mean_of(columns: list[Column]) -> Column:
    """The mean of those columns of a row that aren't null."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))


def build_pool(df: DataFrame, corpus: str, key: str, columns: list[str], cap: int) -> DataFrame:
    """Corpora in one table: each capped in a repeatable random order, its columns rank-normalised within it."""
    ranked = hash_rank(df, corpus, key).where(F.col("_rank") <= cap).drop("_rank", "_size")
    return rank_columns(ranked, columns, corpus, {c: f"{c}_rank" for c in columns})


def corpus_summary(df: DataFrame, corpus: str, label: str) -> DataFrame:
    """Rows, width and default rate of each corpus."""
    width = len([c for c in df.columns if c not in (corpus, label)])
    return df.groupBy(corpus).agg(F.count(F.lit(1)).alias("n"), F.lit(width).alias("width"), F.avg(label).alias("default_rate"))
