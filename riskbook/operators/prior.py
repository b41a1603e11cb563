"""The pooled vocabulary of a book, and a prior trained on other corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook import catalog as C
from riskbook.functions import number_of

from . import evaluation, training

NUMBERS = [c for c in C.POOLED if c != "can_sector"]


def to_canonical(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """df with the 15 pooled columns: mapped fields cleaned, others null; a credit score over 1.5 anywhere is taken as out
    of 900; loan to income and instalment are derived where their parts are mapped."""
    source = {f: m for f, m in mapping.items() if m and m in df.columns}
    out = {c: F.lit(None).cast("string" if c == "can_sector" else "double") for c in C.POOLED}
    for field, pooled in C.TO_POOLED.items():
        if field in source:
            out[pooled] = F.col(f"`{source[field]}`").cast("string") if pooled == "can_sector" else number_of(df, source[field])
    if "credit_score" in source:
        big = df.agg(F.coalesce(F.max(out["can_credit_score_n"]) > 1.5, F.lit(False)).alias("_big"))
        df = df.crossJoin(F.broadcast(big))  # one row
        score = F.when(F.col("_big"), out["can_credit_score_n"] / 900).otherwise(out["can_credit_score_n"])
        out["can_credit_score_n"] = F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    for name, below in (("can_loan_to_income", "can_income"), ("can_installment", "can_term_months")):
        out[name] = F.try_divide(out["can_loan_amount"], F.when(out[below] != 0, out[below]))
    return df.withColumns(out).drop("_big")


def coverage(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """One row, coverage: the share of the 15 pooled columns with any value."""
    there = [F.coalesce(F.max(F.col(c).isNotNull().cast("int")), F.lit(0)) for c in C.POOLED]
    return to_canonical(df, mapping).agg((sum(there[1:], there[0]) / len(there)).alias("coverage"))


def score_prior(prior: training.Bundle, df: DataFrame, mapping: dict[str, str | None], normalised: list[str] = ()) -> DataFrame:
    """df with prior_pd. A prior that was trained on ranks gets ranks: of the columns in `normalised`, within the book."""
    out = to_canonical(df, mapping).withColumn("_book", F.lit("book"))
    if normalised:
        out = evaluation.rank_columns(out, list(normalised), "_book", {c: c for c in normalised})
    return prior.score(out).withColumnRenamed("p", "prior_pd").select(*df.columns, "prior_pd")


def stack_prior(df: DataFrame, prior: training.Bundle | None, mapping: dict[str, str | None], normalised: list[str] = (), least: float = 0.25) -> tuple[DataFrame, str]:
    """df with prior_pd as one more feature if there is a prior and enough of the vocabulary is mapped; else as it is. Also
    what was done."""
    if prior is None:
        return df, "no prior"
    if coverage(df, mapping).first()["coverage"] < least:
        return df, "prior left out: too few fields are mapped"
    return score_prior(prior, df, mapping, normalised), "prior used as a feature"
