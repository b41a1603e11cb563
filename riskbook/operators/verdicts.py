"""Verdicts on explanation records, given as tables, and how they change the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook import catalog as C


def combine_verdict(structural: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Structural findings and a judge's: faithful if both say so; blank claims don't count; without a verdict the structure
    decides. structural: loan_id, faithful, flips (array); verdicts: loan_id, judged, claims, judged_flips (arrays)."""
    cited = F.filter("claims", lambda c: F.length(F.trim(c)) > 0)
    both = structural.join(verdicts.withColumn("_there", F.lit(True)), "loan_id", "left")
    judged = F.coalesce(F.col("judged"), F.lit(False)) | (F.size(cited) == 0)
    flips = F.array_sort(F.array_union("flips", F.coalesce("judged_flips", F.array().cast("array<string>"))))
    return both.select("loan_id", F.when(F.col("_there"), F.col("faithful") & judged).otherwise(F.col("faithful")).alias("faithful"), F.when(F.col("_there"), cited).otherwise(F.array().cast("array<string>")).alias("claims"), flips.alias("flips"))


def choose_retry(attempts: DataFrame) -> DataFrame:
    """Of two attempts (loan_id, attempt, faithful, issues) the second, if it is faithful or has fewer issues."""
    sides = attempts.groupBy("loan_id").agg(*[F.max(F.when(F.col("attempt") == k, F.struct("faithful", "issues"))).alias(f"a{k}") for k in (1, 2)])
    better = F.coalesce(F.col("a2.faithful") | (F.col("a2.issues") < F.col("a1.issues")), F.lit(False))
    return sides.select("loan_id", F.when(better, 2).otherwise(1).alias("attempt"))


def consensus(choice: Column, a: Column, b: Column, merged: Column, high: Column) -> Column:
    """For a loan of the high band, the text that a verdict chose; a where it chose nothing known, and in other bands."""
    chosen = F.when(choice == "b", b).when((choice == "merged") & (F.length(F.trim(merged)) > 0), merged).otherwise(a)
    return F.when(high & b.isNotNull(), chosen).otherwise(a)


def ground_action(records: DataFrame, recourse: DataFrame) -> DataFrame:
    """A search's probability after acting takes the place of a proposed one."""
    found = recourse.select("loan_id", F.col("new_p").alias("_p"))
    return records.join(found, "loan_id", "left").withColumn("pd_after", F.coalesce("_p", "pd_after")).drop("_p")


def action_text(lever: Column, step: Column, changed: Column) -> Column:
    """What a lever's step asks for, in the catalog's words."""
    whole = F.when(step == F.floor(step), step.cast("int").cast("string")).otherwise(step.cast("string"))
    text = F.lit("Monitor")
    for name, words in C.ACTIONS.items():
        step_text = step.cast("string") if name == "interest_rate" else whole
        filled = F.replace(F.replace(F.replace(F.lit(words), F.lit("{step}"), step_text), F.lit("{value}"), changed.cast("int").cast("string")), F.lit("{percent}"), F.round(step * 100).cast("int").cast("string"))
        text = F.when(lever == name, filled).otherwise(text)
    return text


def action_rationale(before: Column, after: Column) -> Column:
    """How far an action brings the probability of default down, in words."""
    return F.format_string("Brings the probability of default from %.0f%% to %.0f%%", before * 100, after * 100)
