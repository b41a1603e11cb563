"""Repeatable stratified splits and samples. Ranks run within (label, range of hashes), so no class meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import hash_order

SEED = "20260502"


def hash_rank(df: DataFrame, by: str, key: str, seed: str = SEED) -> DataFrame:
    """df with _rank, the row's place (from 1) in its class in the order of a hash, and _size, the size of the class.

    The hash's leading digits deal a class over 256 ranges; ranks within a range follow the sizes of the ranges before. Null
    is a class too.
    """
    h = hash_order(key, seed)
    df = df.withColumns({"_h": F.unhex(h), "_part": F.conv(F.substring(h, 1, 2), 16, 10).cast("int")})  # as bytes: the same order in half the room
    sizes = df.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_size": F.sum("_n").over(Window.partitionBy(by))}).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_h", key))
    sizes = sizes.withColumnsRenamed({by: "_by", "_part": "_p"})
    ranked = df.withColumn("_r", inside).join(F.broadcast(sizes), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))  # 256 rows a class
    return ranked.withColumn("_rank", F.col("_before") + F.col("_r")).drop("_h", "_part", "_r", "_before", "_by", "_p")


def three_way_split(df: DataFrame, label: str, key: str, cuts: tuple[float, float] = (0.60, 0.75)) -> DataFrame:
    """df with fold: fit, cal and test shares of each class."""
    share = F.col("_rank") / F.col("_size")
    return hash_rank(df, label, key).withColumn("fold", F.when(share <= cuts[0], "fit").when(share <= cuts[1], "cal").otherwise("test")).drop("_rank", "_size")


def split_for(df: DataFrame, label: str, key: str, seed: str = SEED) -> DataFrame:
    """The three-way split; for tables of under 400 rows or 40 positives, 75/25 with the calibration fold as test too.

    Column `evaluated` marks the rows that metrics are taken on.
    """
    small = df.agg(((F.count(F.lit(1)) < 400) | (F.coalesce(F.sum(label), F.lit(0)) < 40)).alias("_small"))
    share = F.col("_rank") / F.col("_size")
    ranked = hash_rank(df, label, key, seed).crossJoin(F.broadcast(small))
    fold = F.when(F.col("_small"), F.when(share <= 0.75, "fit").otherwise("cal")).when(share <= 0.60, "fit").when(share <= 0.75, "cal").otherwise("test")
    evaluated = F.col("fold") == F.when(F.col("_small"), "cal").otherwise("test")
    return ranked.withColumn("fold", fold).withColumn("evaluated", evaluated).drop("_rank", "_size", "_small")


def splits_without(df: DataFrame, label: str, key: str, corpus: str, names: list[str], seed: str = SEED) -> DataFrame:
    """df with _fold_<k> for the k-th name: the fold that split_for gives a row in the table without that corpus; null for the
    corpus's own rows. One sort by hash serves all names."""
    h, others = hash_order(key, seed), [~F.col(corpus).eqNullSafe(F.lit(name)) for name in names]
    df = df.withColumns({"_h": F.unhex(h), "_part": F.conv(F.substring(h, 1, 2), 16, 10).cast("int")})
    sizes = df.groupBy(F.col(label).alias("_by"), F.col("_part").alias("_p")).agg(*[F.count_if(x).alias(f"_n{k}") for k, x in enumerate(others)])
    ahead, whole = Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_by")
    sizes = sizes.select("_by", "_p", *[c for k in range(len(names)) for c in (F.coalesce(F.sum(f"_n{k}").over(ahead), F.lit(0)).alias(f"_before{k}"), F.sum(f"_n{k}").over(whole).alias(f"_size{k}"))])
    small = df.agg(*[((F.count_if(x) < 400) | (F.coalesce(F.sum(F.when(x, F.col(label))), F.lit(0)) < 40)).alias(f"_small{k}") for k, x in enumerate(others)])
    upto = Window.partitionBy(label, "_part").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumns({f"_r{k}": F.sum(x.cast("long")).over(upto) for k, x in enumerate(others)})
    ranked = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))).crossJoin(F.broadcast(small))  # 256 rows a class, one row
    folds = []
    for k, x in enumerate(others):
        share = (F.col(f"_before{k}") + F.col(f"_r{k}")) / F.col(f"_size{k}")
        fold = F.when(F.col(f"_small{k}"), F.when(share <= 0.75, "fit").otherwise("cal")).when(share <= 0.60, "fit").when(share <= 0.75, "cal").otherwise("test")
        folds.append(F.when(x, fold).alias(f"_fold_{k}"))
    kept = [c for c in df.columns if c not in ("_h", "_part")]
    return ranked.select(*kept, *folds)


def stratified_sample(df: DataFrame, label: str, key: str, cap: int) -> DataFrame:
    """At most cap rows, positives in proportion (one at least), without replacement."""
    facts = df.agg(F.count(F.lit(1)).alias("_all"), F.sum(label).alias("_pos"))
    quota = F.greatest(F.lit(1), F.floor(F.col("_pos") * cap / F.col("_all")))
    quota = F.when(F.col("_all") <= cap, F.col("_all")).when(F.col(label) == 1, quota).otherwise(cap - quota)
    return hash_rank(df, label, key).crossJoin(F.broadcast(facts)).where(F.col("_rank") <= quota).drop("_rank", "_size", "_all", "_pos")
