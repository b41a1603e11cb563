"""Evaluation of scores against labels, by segment. All frames carry columns y (0/1) and p.

Metrics come from a score table: positives and rows of each distinct score. Tables of several days add up (`merged_scores`), and
all metrics of all segments take one running sum over one written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions import calibration_bin, rounded

from .running import same, with_sums_before
from .staging import staged


def score_table(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, p, pos, n, known): positives, rows and labelled rows of each distinct score."""
    return df.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"), F.count("y").alias("known"))


def merged_scores(tables: list[DataFrame], keys: list[str] = ()) -> DataFrame:
    """The score table of all rows of several, from theirs alone."""
    return reduce(DataFrame.unionByName, tables).groupBy(*keys, "p").agg(*[F.sum(c).alias(c) for c in ("pos", "n", "known")])


def _bins(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of each segment's calibration bins, from a score table with one running sum."""
    pos, n, p, known = F.col("pos"), F.col("n"), F.col("p"), F.col("known")
    ranked = with_sums_before(scores, keys, "p", {"_pos": "pos", "_n": "n"}, overall=True)
    precision = (F.col("_pos_all") - F.col("_pos")) / (F.col("_n_all") - F.col("_n"))  # of all at this score or above
    return ranked.groupBy(*keys, calibration_bin(p).alias("_bin")).agg(
        F.sum(pos * (F.col("_n") + (n + 1) / 2)).alias("ranks"), F.sum(pos * precision).alias("gained"), F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum("known").alias("known"),
        F.sum(pos * F.pow(p - 1, 2) + (known - pos) * F.pow(p, 2)).alias("squares"), F.sum(F.when(p.isNotNull(), known)).alias("squared"), F.sum(n * p).alias("scores"), F.sum(F.when(p.isNotNull(), n)).alias("scored"),
    )


def _area(ranks: str = "ranks") -> Column:
    area = F.try_divide(F.col(ranks) - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos")))
    return F.coalesce(area, F.lit(0.5)).alias("auc")


def evaluate_scores(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """All metrics of each segment of a score table."""
    keys = list(keys)
    gap = F.col("n") * F.abs(F.col("pos") / F.col("known") - F.col("scores") / F.col("scored"))
    sums = _bins(scores, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("ranks", "gained", "pos", "n", "known", "squares", "squared")], F.sum(gap).alias("gaps"))
    sums = sums.withColumn("n", F.coalesce("n", F.lit(0)))
    return sums.select(
        *keys, "n", F.try_divide("pos", "known").alias("base_rate"), _area(), (2 * _area() - 1).alias("gini"), F.coalesce(F.try_divide("gained", "pos"), F.lit(0.0)).alias("pr_auc"),
        F.try_divide("squares", "squared").alias("brier"), F.try_divide("gaps", "n").alias("ece"),
    )


def evaluate(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """All metrics of each segment; null is a segment too. The input is read once, into a written score table."""
    return evaluate_scores(staged(score_table(df, list(keys))), keys)


def auc(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """auc and gini; ties count a half; 0.5 where a class is missing."""
    return evaluate(df, keys).select(*keys, "auc", "gini")


def average_precision(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The sum over falling thresholds of the recall gained times the precision; the base rate where there is no positive."""
    return evaluate(df, keys).select(*keys, "pr_auc")


def brier(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def reliability(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows, mean outcome and mean score of each calibration bin."""
    return df.groupBy(*keys, calibration_bin(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("observed"), F.avg("p").alias("predicted"))


def ece(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The bins' mean gap between outcome and score, weighted by rows."""
    gap = F.abs(F.col("observed") - F.col("predicted"))
    return reliability(df, keys).groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def metrics_report(df: DataFrame, expected: DataFrame) -> DataFrame:
    """A row for each corpus that was expected: n, base rate, AUC, average precision and ECE, or status `failed` where it has
    no scores. df: corpus, y, p; expected: corpus."""
    got = evaluate(df, ["corpus"])
    rows = expected.join(got, "corpus", "left")
    return rows.select("corpus", F.coalesce("n", F.lit(0)).alias("n"), "base_rate", "auc", "pr_auc", "ece", F.when(F.col("n").isNull(), "failed").otherwise("ok").alias("status"))


def rank_columns(df: DataFrame, columns: list[str], group: str, names: dict[str, str], few: int = 100_000) -> DataFrame:
    """df with, for each column, its average-tie rank among the group's values by their number under the name that `names` gives;
    null for groups of under ten values. A column may take its own name.

    All columns go together: one count of distinct (group, column, value), one deal over ranges, one join back; the input is
    read once, whatever the number of columns. Ranks of a column with at most `few` distinct values are broadcast to the rows;
    the other columns' values go to their ranks.
    """
    rows = staged(df.withColumn("_row", F.monotonically_increasing_id()))
    cells = F.array(*[F.struct(F.lit(k).alias("_c"), F.col(f"`{c}`").cast("double").alias("_v")) for k, c in enumerate(columns)])
    long = rows.select("_row", F.col(f"`{group}`").alias("_g"), F.explode(cells).alias("_x")).select("_row", "_g", "_x.*").where("_v IS NOT NULL")
    counts = staged(long.groupBy("_g", "_c", "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranks = with_sums_before(counts, ["_g", "_c"], "_v", {"_before": "_n"}, overall=True)
    ranks = staged(ranks.select("_g", "_c", "_v", F.when(F.col("_before_all") >= 10, (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_before_all")).alias("_r")))
    sizes = {r["_c"]: r["count"] for r in counts.groupBy("_c").count().collect()}  # a row a column
    many = [k for k in range(len(columns)) if sizes.get(k, 0) > few]
    if many:
        long = long.where(F.col("_c").isin(many))
        found = long.join(ranks, same(long, ranks, ["_g", "_c", "_v"])).select("_row", long["_c"], "_r")
        wide = found.groupBy("_row").agg(*[F.max(F.when(F.col("_c") == k, F.col("_r"))).alias(f"_r{k}") for k in many])
        rows = rows.join(wide, "_row", "left")
    for k in (k for k in range(len(columns)) if k not in many):
        mine = ranks.where(F.col("_c") == k).select(F.col("_g").alias(f"_g{k}"), F.col("_v").alias(f"_v{k}"), F.col("_r").alias(f"_r{k}"))
        rows = rows.join(F.broadcast(mine), F.col(f"`{group}`").eqNullSafe(F.col(f"_g{k}")) & (F.col(f"`{columns[k]}`").cast("double") == F.col(f"_v{k}")), "left")
    kept = [c for c in df.columns if c not in names.values()]
    return rows.select(*[f"`{c}`" for c in kept], *[F.col(f"_r{k}").alias(names[c]) for k, c in enumerate(columns)])


def rank_normalise(df: DataFrame, column: str, group: str, to: str) -> DataFrame:
    """A value's average-tie rank among the group's values by their number; null for groups of under ten values."""
    counts = staged(df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("_n")))
    ranks = with_sums_before(counts, [group], column, {"_before": "_n"}, overall=True)
    ranks = ranks.select(F.col(group).alias("_g"), F.col(column).alias("_v"), F.when(F.col("_before_all") >= 10, (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_before_all")).alias(to))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & (F.col(column) == F.col("_v")), "left").drop("_g", "_v")


def round_all(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: rounded(c, places) if kinds[c] in ("double", "float") else F.round(F.col(c), places) for c in columns})


def hash_order(key: str, seed: str = "20260502") -> Column:
    """A repeatable random order."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
