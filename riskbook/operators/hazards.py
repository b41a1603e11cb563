"""Time to default: a penalised Cox fit from per-duration sums, and the population's shape."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import medians
from .running import filled
from .staging import staged


def term_fill(df: DataFrame, column: str, order: str, group: str) -> DataFrame:
    """Missing values taken from the row before, else from the row after, in an explicit order within a group. Groups go over
    ranges of the order, so that none meets in one task."""
    return filled(df, column, order, [group])


def cox_columns(df: DataFrame, duration: str, columns: list[str], most: int = 10) -> tuple[DataFrame, list[str]]:
    """df prepared for cox_fit: the duration with nulls as its median and 0.1 at least, and the `most` columns of highest
    sample variance, nulls as their medians, standardised as z_<column>. A column without variance becomes 0. The table is written once, as each step of a fit reads it."""
    df = staged(df)
    facts = df.agg(F.lit(0).alias("_"), *[F.var_samp(c).alias(f"variance_{c}") for c in columns]).first()
    middle = medians(df, {c: F.col(c) for c in dict.fromkeys([duration, *columns])})
    chosen = sorted((c for c in columns if facts[f"variance_{c}"] is not None), key=lambda c: (-facts[f"variance_{c}"], c))[:most]
    full = df.withColumns({duration: F.greatest(F.lit(0.1), F.coalesce(F.col(duration).cast("double"), F.lit(middle[duration] or 0.0))), **{f"z_{c}": F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in chosen}})
    if not chosen:
        return full, []
    stats = full.agg(*[f(f"z_{c}").alias(f"{name}_{c}") for c in chosen for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]).first()
    z = {f"z_{c}": (F.col(f"z_{c}") - stats[f"mean_{c}"]) / (stats[f"sd_{c}"] or 1.0) for c in chosen}
    return full.withColumns(z), list(z)


def cox_fit(df: DataFrame, duration: str, event: str, columns: list[str], ridge: float = 0.5, steps: int = 8) -> np.ndarray:
    """Coefficients by Newton steps. A step is one grouping by duration (whole months: a few hundred rows at most reach
    the driver), of sums over who is at risk; the covariates must be standardised."""
    k, beta = len(columns), np.zeros(len(columns))
    x = [F.col(c) for c in columns]
    for _ in range(steps):
        w = F.exp(sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0)))
        aggs = [F.sum(event).alias("d"), F.sum(w).alias("s0")]
        aggs += [F.sum(F.col(event) * c).alias(f"e{i}") for i, c in enumerate(x)]
        aggs += [F.sum(w * c).alias(f"s{i + 1}") for i, c in enumerate(x)]
        aggs += [F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        rows = df.groupBy(F.ceil(duration).alias("t")).agg(*aggs).orderBy(F.desc("t")).collect()
        s0, s1, s2 = 0.0, np.zeros(k), np.zeros((k, k))
        gradient, hessian = -ridge * beta, ridge * np.eye(k)
        for r in rows:
            s0 += r["s0"]
            s1 += [r[f"s{i + 1}"] for i in range(k)]
            for i in range(k):
                for j in range(i, k):
                    s2[i, j] += r[f"h{i}_{j}"]
                    s2[j, i] = s2[i, j]
            if r["d"]:
                mean = s1 / s0
                gradient += np.array([r[f"e{i}"] for i in range(k)]) - r["d"] * mean
                hessian += r["d"] * (s2 / s0 - np.outer(mean, mean))
        move = np.linalg.solve(hessian, gradient)
        beta = beta + move
        if np.abs(move).max() < 1e-6:
            break
    return beta


def cumulative_hazard(df: DataFrame, duration: str, event: str, score: str | None = None) -> DataFrame:
    """(month, hazard): events over those at risk, summed up; weighted by exp(score) it is Breslow's baseline."""
    weight = F.exp(F.col(score)) if score else F.lit(1.0)
    sums = df.groupBy(F.ceil(duration).alias("month")).agg(F.sum(event).alias("d"), F.sum(weight).alias("w"))
    risk = F.sum("w").over(Window.orderBy(F.desc("month")))  # over distinct months
    return sums.withColumn("risk", risk).select("month", F.sum(F.col("d") / F.col("risk")).over(Window.orderBy("month")).alias("hazard"))


def hazard_shape(hazard: DataFrame) -> DataFrame:
    """One row, shape: of months 1 to 12 the share of the year's default probability that has come; null where that is none.

    Between two months of the table the hazard is interpolated; before the first and after the last it is theirs.
    """
    months = hazard.sparkSession.range(1, 13).withColumnRenamed("id", "m")
    below, above = F.when(F.col("month") <= F.col("m"), F.struct("month", "hazard")), F.when(F.col("month") >= F.col("m"), F.struct("month", "hazard"))
    near = months.crossJoin(F.broadcast(hazard)).groupBy("m").agg(F.max(below).alias("a"), F.min(above).alias("b"))  # 12 by months
    share = F.try_divide(F.col("m") - F.col("a.month"), F.col("b.month") - F.col("a.month"))
    h = F.when(F.col("a").isNull(), F.col("b.hazard")).when(F.col("b").isNull(), F.col("a.hazard")).otherwise(F.col("a.hazard") + F.coalesce(share, F.lit(0.0)) * (F.col("b.hazard") - F.col("a.hazard")))
    p = near.select("m", (1 - F.exp(-h)).alias("p"))
    array = p.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "p"))), lambda x: x["p"]).alias("a"))
    running = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.array_max(F.slice("a", F.lit(1), k)))
    return array.select(F.when(F.element_at("a", 12) > 1e-9, F.transform(running, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.element_at("a", 12))))).alias("shape"))
