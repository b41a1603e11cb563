"""Running sums and fills over whole tables without one task for all rows.

Rows are dealt over ranges of the order column, on its own type (numbers, dates and times are cut at their approximate
quantiles; text, structs and the like at the quantiles of a bounded sample), summed up or filled inside each range, and the ranges'
totals, a bounded number, are added on top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 1024


def range_of(value: Column, cuts: Column) -> Column:
    """How many of RANGES - 1 rising cuts are at most `value`, by halving."""
    steps = F.array(*[F.lit(RANGES >> k) for k in range(1, RANGES.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def cuts_of(df: DataFrame, order: str) -> DataFrame:
    """One row, _cuts: RANGES - 1 rising values of the order column. Cuts decide how evenly rows are dealt, never a result."""
    if isinstance(df.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df.agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
    mixed = F.xxhash64(*[f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()])
    some = df.where(F.col(order).isNotNull()).select(F.col(order).alias("_v"), mixed.alias("_h")).orderBy("_h", "_v").limit(16 * RANGES)
    values = some.agg(F.array_sort(F.collect_list("_v")).alias("_all"))  # the bounded sample
    return values.select(F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda k: F.get("_all", (k * F.size("_all") / RANGES).cast("int"))).alias("_cuts"))


def dealt(df: DataFrame, order: str) -> DataFrame:
    """df with _range, the number of the range of the order column; null is in the first."""
    cuts = cuts_of(df, order)
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", range_of(F.col(order), F.col("_cuts"))).drop("_cuts")  # one row


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equal in these columns, null with null."""
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def with_sums_before(df: DataFrame, keys: list[str], order: str, columns: dict[str, str], falling: bool = False, overall: bool = False) -> DataFrame:
    """df with, for each new name in columns, the sum of the old one over the rows of the same keys before a row; `order`
    must tell these rows apart. With `overall`, also the sum over all rows of the same keys, as <new>_all."""
    ranged = dealt(df, order)
    direction = F.desc if falling else F.asc
    before = Window.partitionBy(*keys).orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a key
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(old).alias(f"_t_{new}") for new, old in columns.items()])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in columns], *[F.sum(f"_t_{new}").over(Window.partitionBy(*keys)).alias(f"{new}_all") for new in columns if overall])
    extra = [f"{new}_all" for new in columns if overall]
    inside = Window.partitionBy(*keys, "_range").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({new: F.coalesce(F.sum(old).over(inside), F.lit(0)) for new, old in columns.items()})
    joined = rows.join(totals, same(rows, totals, [*keys, "_range"])).select(rows["*"], *[totals[f"_b_{new}"] for new in columns], *[totals[x] for x in extra])
    return joined.withColumns({new: F.col(new) + F.col(f"_b_{new}") for new in columns}).select(*df.columns, *columns, *extra)


def filled(df: DataFrame, column: str, order: str, keys: list[str]) -> DataFrame:
    """Missing values taken from the nearest row before that has one, else from the nearest one after."""
    ranged = dealt(df, order)
    at = F.when(F.col(column).isNotNull(), F.col(order))
    ends = ranged.groupBy(*keys, "_range").agg(F.max_by(column, at).alias("_last"), F.min_by(column, at).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_range")  # RANGES rows a key
    ends = ends.select(*keys, "_range", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_back"), F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    rows = ranged.withColumns({"_b": F.last(column, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_a": F.first(column, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))})
    joined = rows.join(ends, same(rows, ends, [*keys, "_range"])).select(rows["*"], "_back", "_ahead")
    return joined.withColumn(column, F.coalesce("_b", "_back", "_a", "_ahead")).select(*df.columns)
