"""Cleaning and feature construction over loan tables of any size.

Nothing is collected beyond column lists and a few numbers per column; learned state (medians, levels) is a small frame
that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbook import catalog as C
from riskbook.functions import classify_outcome, number_of

from .order_stats import medians
from .running import with_sums_before
from .staging import staged

OTHER, MISSING = "__OTHER__", "__NA__"


def outcome_map(df: DataFrame, column: str) -> DataFrame:
    """(value, label): how each distinct value of an outcome column reads, by the first rule that applies to all of them.

    Words of an outcome; two numbers (0/1 as they are, 1/2 with 2 bad, else the larger bad); the rarest value is bad; 0.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumns({"word": classify_outcome(F.col("value")), "number": F.col("value").try_cast("double")})
    facts = values.agg(
        F.bool_and(F.col("word").isNotNull()).alias("worded"), F.count_distinct("word").alias("words"), F.count_distinct("number").alias("numbers"), F.min("number").alias("low"),
        F.max("number").alias("high"), F.count(F.lit(1)).alias("values"), F.min_by("value", F.struct("n", "value")).alias("rarest"),
    )
    label = (
        F.when(F.col("worded") & (F.col("words") == 2), F.col("word"))
        .when(F.col("numbers") == 2, (F.col("number") == F.col("high")).cast("int"))
        .when(F.col("values") >= 2, (F.col("value") == F.col("rarest")).cast("int"))
        .otherwise(0)
    )
    return values.crossJoin(F.broadcast(facts)).select("value", label.alias("label"))  # facts is one row


def binarize_target(df: DataFrame, column: str, to: str = "label") -> DataFrame:
    """df with the outcome as 0/1 (1: default); null outcomes stay null."""
    known = outcome_map(df, column).select(F.col("value").alias("_value"), F.col("label").alias("_label"))
    joined = df.withColumn("_text", F.col(column).cast("string")).join(known, F.col("_text") == F.col("_value"), "left")
    return joined.withColumn(to, F.col("_label")).drop("_text", "_value", "_label")


def loan_ids(df: DataFrame, column: str | None, order: str, to: str = "loan_id") -> DataFrame:
    """Ids as text; if any repeats, every id gets the number of its row. Without an id column: L000001 and so on, in the order
    of `order`, which must tell rows apart."""
    if column is None:
        rows = with_sums_before(df.withColumn("_one", F.lit(1)), [], order, {"_row": "_one"})
        return rows.withColumn(to, F.format_string("L%06d", F.col("_row") + 1)).drop("_one", "_row")
    repeated = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("_repeated"))
    text = F.col(column).cast("string")
    return df.crossJoin(F.broadcast(repeated)).withColumn(to, F.when(F.col("_repeated"), F.concat(text, F.lit("__"), F.col(order).cast("string"))).otherwise(text)).drop("_repeated")


def kind_decision(df: DataFrame, columns: list[str], known_numeric: list[str] = (), exact: bool = True) -> DataFrame:
    """(feature, share, n_distinct, numeric): which columns are numbers. The numbers are written once where counts are to be exact;
    without, n_distinct is an estimate beyond 65,536, in one pass over the table with bounded states."""
    numbers = {c: number_of(df, c) for c in columns}
    if exact:
        df = staged(df.select(*[v.alias(f"_v{i}") for i, v in enumerate(numbers.values())]))
        numbers = {c: F.col(f"_v{i}") for i, c in enumerate(columns)}
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(v.isNotNull().cast("double")).alias("share"), n_distinct((v + 0.0).cast("string")).alias("n_distinct")) for c, v in numbers.items()]  # -0.0 is 0.0
    rows = df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    if exact:
        rows = with_exact_counts(rows, df, "feature", "n_distinct", {c: (v + 0.0).cast("string") for c, v in numbers.items()})
    known = F.col("feature").isin(list(known_numeric)) if known_numeric else F.lit(False)
    return rows.withColumn("numeric", F.coalesce(((F.col("share") > 0.6) & (F.col("n_distinct") > 10)) | (known & (F.col("share") > 0.3)), F.lit(False)))


def n_distinct(text: Column) -> Column:
    """How many distinct texts a column has, as an aggregate of bounded, mergeable state: exact up to 65,536, beyond that an
    estimate (standard error 0.4 %). The mark in front keeps the empty text, which the sketch would leave out."""
    return F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(F.concat(F.lit("="), text), 16)), F.lit(0)).cast("long")


def with_exact_counts(states: DataFrame, df: DataFrame, name: str, to: str, texts: dict[str, Column], sure: int = 60_000) -> DataFrame:
    """states (a row a column) with the n_distinct in `to` made exact: columns whose estimate is beyond `sure` are counted by one
    grouping of df's (column, text), longer texts by their SHA-256. What a task holds is Spark's to spill."""
    states = staged(states)
    many = [r[name] for r in states.where(F.col(to) > sure).select(name).collect()]  # a row a column
    if not many:
        return states
    short = lambda t: F.when(F.length(t) > 64, F.concat(F.lit("#"), F.sha2(t, 256))).otherwise(t)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), short(texts[c]).alias("t")) for c in many])).alias("x")).select("x.*")
    counts = cells.where("t IS NOT NULL").distinct().groupBy("_name").agg(F.count(F.lit(1)).alias("_exact"))
    joined = states.join(F.broadcast(counts), F.col(name) == F.col("_name"), "left")  # a row a column
    return joined.withColumn(to, F.coalesce("_exact", to)).drop("_name", "_exact")


def median_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the exact median of the column (0 if it has no value). The table is written once, as selection reads it again."""
    df = staged(df)
    found = medians(df, {c: F.col(f"`{c}`") for c in columns})
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(found[c] or 0.0)) for c in columns})


def top_levels(df: DataFrame, column: str, n: int = 25) -> DataFrame:
    """(level, n, rank) of the most frequent levels; missing is a level; ties by value."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "level").limit(n)  # a top-k per task, merged
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "level")))  # over n rows


def keep_levels(df: DataFrame, column: str, n: int = 25) -> DataFrame:
    """The column's levels, with all but the most frequent as one."""
    top = top_levels(df, column, n).select("level")
    value = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    return df.join(F.broadcast(top), value == F.col("level"), "left").withColumn(column, F.coalesce("level", F.lit(OTHER))).drop("level")


def distinct_names(names: list[str]) -> list[str]:
    """The names in letters, digits and underscores; those that clean to one name (in any case) are numbered."""
    out, taken = [], set()
    for name in names:
        clean = "".join(x if x.isalnum() else "_" for x in name)
        k, free = 2, clean
        while free.lower() in taken:
            free, k = f"{clean}_{k}", k + 1
        taken.add(free.lower())
        out.append(free)
    return out


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level, named after it."""
    names = distinct_names([f"{column}_{v}" for v in levels])
    return df.withColumns({n: (F.col(column) == v).cast("int") for n, v in zip(names, levels)})


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, variance) of numeric columns, in one pass."""
    one = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "variance")


def variance_cap(df: DataFrame, columns: list[str], most: int = 400) -> DataFrame:
    """The columns of highest sample variance."""
    return variances(df, columns).orderBy(F.desc("variance"), "feature").limit(most)


def sanitise(c: Column) -> Column:
    """Null, not-a-number and infinite become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def exclude_protected(columns: list[str], mapping: dict[str, str]) -> list[str]:
    """The columns that may be features; ids, the target and protected fields never are."""
    banned = {mapping[f] for f, role in C.FIELDS.items() if role in ("id", "protected", "target") and mapping.get(f)}
    return [c for c in columns if c not in banned]


def select_features(columns: list[str], mapping: dict[str, str]) -> list[str]:
    """The mapped feature, text and time columns; with fewer than two, all that may be features."""
    allowed = exclude_protected(columns, mapping)
    mapped = [mapping[f] for f, role in C.FIELDS.items() if role in ("feature", "text", "time") and mapping.get(f) in allowed]
    return mapped if len(mapped) >= 2 else mapped + [c for c in allowed if c not in mapped]
