"""Reading and profiling tables, and mapping their columns onto the vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskbook import catalog as C
from riskbook.functions import clean_numeric, norm_name, sample_cell
from riskbook.operators.cleaning import n_distinct, with_exact_counts
from riskbook.operators.corpora import multi_left_join


def read_table(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ",", columns: list[str] | None = None, order: str | None = None, most: int | None = None, drop_bad: bool = False, label: str | None = None) -> DataFrame:
    """A table from CSV, parquet, ORC or JSON: names trimmed, nameless columns dropped, bad values null (or bad lines
    dropped), optionally some columns, only rows with a `label`, and the first `most` rows by a key."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=True, sep=sep, mode="DROPMALFORMED" if drop_bad else "PERMISSIVE")
    df = reader.load(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    df = df.select(*[f"`{c}`" for c in (columns or [c for c in df.columns if not c.startswith(("Unnamed", "_c"))])])
    df = df.where(F.col(f"`{label}`").isNotNull()) if label else df
    return row_cap(df, order, most) if most else df


def row_cap(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows by an explicit key: never by the order of a scan."""
    return df.orderBy(order).limit(most)


def scan_filtered(big: DataFrame, keep: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The wanted columns of the wanted customers."""
    return big.select(key, *columns).join(keep.select(key), key, "left_semi")


def numeric_columns(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The key and the numeric columns, one row for each key: the first in an explicit order."""
    numbers = [c for c, t in df.dtypes if c != key and t in ("int", "bigint", "double", "float")]
    first = df.groupBy(key).agg(F.min_by(F.struct(*numbers), F.struct(*order)).alias("_first"))
    return first.select(key, *[F.col(f"_first.{c}").alias(c) for c in numbers])


def scan_glob(base: DataFrame, parts: list[DataFrame], key: str, orders: list[list[str]]) -> DataFrame:
    """Part tables' numeric columns joined to a base, one row a key; a column that is there already gets the part's number."""
    return multi_left_join(base, [(numeric_columns(df, key, order), key) for df, order in zip(parts, orders)])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Writes a table and reads it again."""
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def column_states(df: DataFrame, states: dict[str, dict[str, Column]]) -> DataFrame:
    """(name, and each state's value): aggregates of bounded, mergeable state for each column, in one grouping of the table as it
    is: no cell becomes a row, and what is shuffled is one row of states a task."""
    cells = [F.struct(F.lit(c).alias("name"), *[x.alias(n) for n, x in aggs.items()]) for c, aggs in states.items()]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def profile_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(name, dtype, sample, null_pct, n_unique, castable_pct) of each column, from one grouping with bounded states, and one
    of the values of columns with more than 60,000 (n_unique is exact). The sample is of the first five values by key, each column's top rows a task."""
    kinds = dict(df.dtypes)
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    states, firsts, texts = {}, [], {}
    for c in columns:
        text = texts[c] = F.col(f"`{c}`").cast("string")
        states[c] = {"n": F.count(F.lit(1)), "nulls": F.count_if(text.isNull()), "castable": F.avg(clean_numeric(text).isNotNull().cast("double")), "n_unique": n_distinct(text)}
        shown = F.round(text.try_cast("double"), 4).cast("string") if kinds[c] in ("double", "float") else sample_cell(text)
        top = df.where(text.isNotNull()).select(F.lit(c).alias("name"), F.col(f"`{key}`").alias("_k"), shown.alias("value")).orderBy("_k", "value").limit(5)
        firsts.append(top.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda x: x["value"]).alias("sample")))
    counted = with_exact_counts(column_states(df, states).where("n > 0"), df, "name", "n_unique", texts)
    out = counted.join(reduce(DataFrame.unionByName, firsts), "name", "left")
    return out.select("name", types[F.col("name")].alias("dtype"), "sample", F.round(F.coalesce(F.try_divide(100 * F.col("nulls"), "n"), F.lit(0.0)), 1).alias("null_pct"), "n_unique", "n", "castable")


def profile_file(profile: DataFrame, filename: str) -> DataFrame:
    """One row for a table: filename, n_rows, columns (their profiles, in order of name)."""
    columns = F.array_sort(F.collect_list(F.struct("name", "dtype", "sample", "null_pct", "n_unique")))  # a row a column
    return profile.agg(F.lit(filename).alias("filename"), F.max("n").alias("n_rows"), columns.alias("columns"))


def friendly_dtype(profile: DataFrame) -> DataFrame:
    """What a column is for people: boolean, integer, float, datetime, categorical, numeric_text or text."""
    t = F.col("dtype")
    text = F.when(F.col("n_unique") <= F.greatest(F.lit(20), F.floor(0.05 * F.col("n"))), "categorical").when(F.col("castable") > 0.8, "numeric_text").otherwise("text")
    kind = F.when(t == "boolean", "boolean").when(t.isin("int", "bigint", "smallint", "tinyint"), "integer").when(t.isin("double", "float") | t.startswith("decimal"), "float").when(t.startswith("timestamp") | (t == "date"), "datetime").otherwise(text)
    return profile.withColumn("kind", kind)


def column_catalog(tables: dict[str, DataFrame], words: list[str] = C.BINARY_WORDS) -> DataFrame:
    """(table_name, name, position, n_unique, is_binary) of the columns of many tables: binary are those with one or two
    distinct values, or with six or fewer of which one is a word of an outcome."""
    parts = []
    for table_name, df in tables.items():
        states = {}
        for i, c in enumerate(df.columns):
            text = F.col(f"`{c}`").cast("string")
            states[c] = {"n": F.count(F.lit(1)), "position": F.lit(i), "n_unique": n_distinct(text), "worded": F.coalesce(F.bool_or(F.lower(F.trim(text)).isin(words)), F.lit(False))}
        parts.append(column_states(df, states).where("n > 0").withColumn("table_name", F.lit(table_name)))
    seen = reduce(DataFrame.unionByName, parts)
    return seen.select("table_name", "name", "position", "n_unique", looks_binary(F.col("n_unique"), F.col("worded")).alias("is_binary"))


def looks_binary(n_unique: Column, worded: Column) -> Column:
    return n_unique.between(1, 2) | ((n_unique <= 6) & worded)


def hint_scores(columns: DataFrame) -> DataFrame:
    """(table_name, field, name, score): how well each column's name fits each field. columns: table_name, name, position.

    The hints are a fixed list, carried as literals: no join, and a shuffle of (table, column, field) rows only.
    """
    name = F.col("_n")

    def score(words: list[str]):
        fits = []
        for w in words:
            k = "".join(x for x in w.lower() if x.isalnum())
            part = F.when(name.startswith(k) | name.endswith(k), 0.85).when(name.contains(k), 0.7) if len(k) >= 3 else None
            fits.append(F.when(name == k, 1.0).otherwise(part if part is not None else 0.0))
        return reduce(lambda a, b: F.greatest(a, F.coalesce(b, F.lit(0.0))), fits, F.lit(0.0))

    cells = F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(f).alias("field"), score(words).alias("score")) for i, (f, words) in enumerate(C.HINTS.items())])
    normed = columns.select("table_name", "name", "position", F.explode(F.array(norm_name(F.col("name")))).alias("_n"))  # made once
    return normed.select("table_name", "name", "position", F.explode(cells).alias("c")).select("table_name", "name", "position", "c.*")


def heuristic_map(columns: DataFrame) -> DataFrame:
    """(table_name, field, name, confidence): fields in order each take the best free column that scores 0.7 or more.

    The greedy walk is over one table's columns at a time: hundreds of rows.
    """
    import pandas as pd

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, mine in rows.sort_values(["field_no", "position"]).groupby("field_no", sort=True):
            free = mine[~mine["name"].isin(used)]
            if len(free) and free["score"].max() >= 0.7:
                best = free.loc[free["score"].idxmax()]
                used.add(best["name"])
                out.append((best["table_name"], best["field"], best["name"], round(float(best["score"]), 2)))
        return pd.DataFrame(out, columns=["table_name", "field", "name", "confidence"])

    scores = hint_scores(columns).where("field <> 'target' AND score >= 0.7")
    return scores.groupBy("table_name").applyInPandas(walk, "table_name string, field string, name string, confidence double")


def pick_target(columns: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The target of each table: of its binary columns that aren't mapped that of the best (score, position); where there is
    none, the column of the best score, if that is 0.7 or more."""
    scores = hint_scores(columns).where("field = 'target'").join(columns.select("table_name", "name", "is_binary"), ["table_name", "name"])
    used = (mapping if mapping is not None else columns.limit(0)).select("table_name", "name", F.lit(True).alias("used"))
    able = scores.join(used, ["table_name", "name"], "left").withColumn("able", F.col("is_binary") & F.col("used").isNull())
    place = F.when(F.col("able"), F.col("position")).otherwise(-F.col("position"))
    w = Window.partitionBy("table_name").orderBy(F.desc("able"), F.desc("score"), place.desc())
    best = able.withColumn("r", F.row_number().over(w)).where("r = 1 AND (able OR score >= 0.7)")
    return best.select("table_name", "name", F.round(F.greatest(F.lit(0.6), "score"), 2).alias("confidence"))


def detect_protected(mapping: DataFrame) -> DataFrame:
    """The mapped columns of protected fields."""
    return mapping.where(F.col("field").isin([f for f, role in C.FIELDS.items() if role == "protected"])).select("table_name", "field", "name")


def merge_mapping(seed: DataFrame, override: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, field, name, confidence): an override takes a field where it names a real column, or null; else the seed
    stays. Its confidence, where it gives one, takes the seed's place."""
    o = override.join(columns.select("table_name", F.col("name").alias("override_name"), F.lit(True).alias("real")), ["table_name", "override_name"], "left")
    o = o.withColumnRenamed("confidence", "override_confidence").withColumn("given", F.lit(True))
    both = seed.join(o, ["table_name", "field"], "full")
    takes = F.col("given").isNotNull() & (F.col("override_name").isNull() | F.coalesce("real", F.lit(False)))
    return both.select("table_name", "field", F.when(takes, F.col("override_name")).otherwise(F.col("name")).alias("name"), F.coalesce("override_confidence", "confidence").alias("confidence"))


def sanitise_mapping(mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """Every field of every table, with null where it isn't mapped to one of the table's columns."""
    fields = F.explode(F.array(*[F.lit(f) for f in C.FIELDS])).alias("field")
    every = columns.select("table_name").distinct().select("table_name", fields)
    real = mapping.join(columns.select("table_name", "name"), ["table_name", "name"], "left_semi")
    return every.join(real, ["table_name", "field"], "left").select("table_name", "field", "name")


def project_canonical(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns under their fields' names."""
    return df.select(*[F.col(f"`{source}`").alias(field) for field, source in mapping.items() if source])
