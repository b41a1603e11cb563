"""Transaction histories as token sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskbook.functions import clean_numeric, gap_bucket

from .order_stats import quantiles
from .running import with_sums_before
from .staging import staged


def signed_amount(kind: Column, amount: Column) -> Column:
    """Withdrawals (V...) negative, all else positive."""
    return F.when(kind.startswith("V"), -F.abs(amount)).otherwise(F.abs(amount))


def amount_bucket(df: DataFrame, column: str, to: str = "amt_bucket") -> DataFrame:
    """Signed buckets 0..31 of log amounts, scaled by the table's 99.5th percentile (1 if that is 0)."""
    hi = quantiles(df, {"hi": F.log1p(F.abs(F.col(column)))}, [0.995])["hi"][0] or 1.0
    size = F.greatest(F.lit(0.0), F.least(F.lit(15.0), F.log1p(F.abs(F.col(column))) / hi * 15))
    return df.withColumn(to, (F.signum(F.col(column)) * size).cast("int") + 16)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n): the values of a column but null, and their rows. Counts are summed before the shuffle."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def with_codes(df: DataFrame, column: str, codes: DataFrame, to: str, few: int = 10_000) -> DataFrame:
    """df with the code of each value of a column, from a written table (value, n, code); null is -1.

    Rows are not dealt by values that many of them share. Codes of at most `few` values are broadcast; of more, those of values
    with over one row in `few`, which are fewer than that, and only the rows of the other values go to their codes.
    """
    size, rows = codes.agg(F.count(F.lit(1)), F.sum("n")).first()
    codes = codes.select(F.col("value").alias("_value"), F.col("code").cast("int").alias(to), "n")
    often = (F.col("n") * few > rows) if size > few else F.lit(True)
    coded = df.join(F.broadcast(codes.where(often).drop("n")), F.col(column) == F.col("_value"), "left").drop("_value")
    if size > few:
        coded = staged(coded)
        other = F.col(column).isNotNull() & F.col(to).isNull()
        seldom = coded.where(other).drop(to).join(codes.where(~often).drop("n"), F.col(column) == F.col("_value"), "left").drop("_value")
        coded = coded.where(~other).unionByName(seldom)
    return coded.withColumn(to, F.coalesce(to, F.lit(-1)))


def category_codes(df: DataFrame, column: str, to: str) -> DataFrame:
    """Dense codes from 0 in the order of the values; null is -1."""
    codes = value_counts(df, column).withColumn("code", F.dense_rank().over(Window.orderBy("value")) - 1)  # over distinct values
    return with_codes(df, column, staged(codes), to)


def tail_events(df: DataFrame, client: str, order: list[str], most: int = 128) -> DataFrame:
    """The last events of each client."""
    w = Window.partitionBy(client).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")  # a top-k per group, cut before the shuffle


def window_chunks(df: DataFrame, client: str, order: list[str], size: int = 128, least: int = 16) -> DataFrame:
    """Consecutive windows of events as clients of their own; windows of fewer than `least` events go."""
    chunk = F.floor((F.row_number().over(Window.partitionBy(client).orderBy(*order)) - 1) / size).cast("long")
    named = df.withColumn("_w", chunk).withColumn("chunk_id", F.concat(F.col(client), F.lit("_w"), F.col("_w").cast("string")))
    return named.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(client, "_w"))).where(F.col("_n") >= least).drop("_n", "_w")


def event_gap(df: DataFrame, client: str, day: str, order: list[str]) -> DataFrame:
    """Days since the client's event before (0 for the first), and their bucket."""
    before = F.lag(day).over(Window.partitionBy(client).orderBy(*order))
    df = df.withColumn("gap_days", F.coalesce(F.datediff(F.col(day), before), F.lit(0)))
    return df.withColumn("dt_bucket", gap_bucket(F.col("gap_days")))


def standardise(df: DataFrame, client: str, column: str, to: str) -> DataFrame:
    """z-scores by client; without spread the deviation itself."""
    stats = df.groupBy(client).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"))
    std = F.when(F.coalesce("_std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_std"))
    stats = stats.withColumnRenamed(client, "_client")  # null is a client too
    return df.join(stats, F.col(client).eqNullSafe(F.col("_client"))).drop("_client").withColumn(to, (F.col(column) - F.col("_mean")) / std).drop("_mean", "_std")


def equal_width_bins(df: DataFrame, column: str, bins: int, to: str) -> DataFrame:
    """Right-closed bins of equal width from the smallest to the largest value, from 0; nulls count as 0."""
    value = F.coalesce(F.col(column), F.lit(0.0))
    ends = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    code = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((value - F.col("_low")) / F.when(width == 0, 1.0).otherwise(width)) - 1)).cast("int")
    return df.crossJoin(F.broadcast(ends)).withColumn(to, code).drop("_low", "_high")


def first_clients(df: DataFrame, client: str, order: str, n: int) -> DataFrame:
    """The events of the first n clients to appear."""
    first = df.groupBy(client).agg(F.min(order).alias("_first")).orderBy("_first", client).limit(n).select(client)
    return df.join(first, client, "left_semi")


def tokenise(df: DataFrame, client: str, day: str, order: list[str], most: int = 128) -> DataFrame:
    """Token events: client_id, amt_bucket, kind and channel codes, dt_bucket, of each client's last events."""
    df = tail_events(df.withColumn("amount", signed_amount(F.col("type"), F.col("amount"))), client, order, most)
    df = staged(event_gap(df, client, day, order).select(client, *order, "type", "channel", "amount", "dt_bucket"))
    df = amount_bucket(df, "amount")
    df = category_codes(category_codes(df, "type", "kind_code"), "channel", "channel_code")
    return df.select(client, *order, "amt_bucket", "kind_code", "channel_code", "dt_bucket")


def code_book(events: DataFrame, column: str) -> DataFrame:
    """(value, n, code): the values of a column of all corpora, from 0 by falling count, then value. Places come from ranges of
    (count, value), so no task numbers all values."""
    counts = staged(value_counts(events, column))
    return staged(numbered(counts.withColumn("_order", F.struct((-F.col("n")).alias("n"), "value")), "_order", "code").drop("_order"))


def union_tokens(corpora: dict[str, DataFrame], client: str, day: str, order: list[str], most: int = 128) -> DataFrame:
    """Token events of several corpora as one table: client keys carry the corpus's name, so they never meet; amounts are scaled
    within a corpus, as currencies differ; kinds and channels have one code book."""
    parts = []
    for name, df in corpora.items():
        own = df.withColumns({client: F.concat(F.lit(f"{name}_"), F.col(client).cast("string")), "amount": signed_amount(F.col("type"), F.col("amount"))})
        own = staged(tail_events(own, client, order, most).select(client, day, *[c for c in order if c != day], "type", "channel", "amount"))
        parts.append(amount_bucket(event_gap(own, client, day, order), "amount"))
    events = staged(reduce(DataFrame.unionByName, parts))
    books = [(column, to, code_book(events, column)) for column, to in (("type", "kind_code"), ("channel", "channel_code"))]
    for column, to, codes in books:
        events = with_codes(events, column, codes, to)
    return events.select(client, *order, "amt_bucket", "kind_code", "channel_code", "dt_bucket")


def sequence_store(tokens: DataFrame, client: str, order: list[str], least: int = 8) -> DataFrame:
    """A client's events as one ordered array; clients of fewer than `least` events go. Tails bound the arrays."""
    event = F.struct(*order, F.greatest(F.lit(0), F.least(F.lit(31), "amt_bucket")).alias("amt"), F.pmod("channel_code", F.lit(512)).alias("channel"), "dt_bucket")
    return tokens.groupBy(client).agg(F.array_sort(F.collect_list(event)).alias("events")).where(F.size("events") >= least)


def view_pairs(store: DataFrame, client: str) -> DataFrame:
    """Two views of a history for contrast: the end of its first half, and the end of its second, of repeatable lengths."""
    n, half = F.size("events"), F.floor(F.size("events") / 2).cast("int")
    draw = lambda salt, hi: 4 + F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", client, F.lit(salt))), 1, 7), 16, 10).cast("int"), hi - 4)
    lo = F.least(half, draw("lo", F.greatest(F.lit(5), half + 1)))
    hi = F.least(n - half, draw("hi", F.greatest(F.lit(5), n - half + 1)))
    return store.select(client, F.slice("events", half - lo + 1, lo).alias("view1"), F.slice("events", n - hi + 1, hi).alias("view2"))


def pad_mask(codes: Column, length: int = 128) -> tuple[Column, Column]:
    """Codes cut to the most recent `length` and padded with 0, and the mask of what is there."""
    kept = F.slice(codes, F.greatest(F.lit(1), F.size(codes) - length + 1), length)
    pad = F.array_repeat(F.lit(0), length - F.size(kept))
    return F.concat(kept, pad), F.concat(F.transform(kept, lambda _: F.lit(1)), pad)


def contrastive_loss(pairs: DataFrame, batch: str, side: str, pair: str, vector: str, temperature: float = 0.1) -> DataFrame:
    """Per batch: the mean over its vectors, brought to unit length, of -log softmax of the matching view's similarity,
    itself left out.

    Batches are of fixed small size, so the join within a batch is bounded by that size.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    doubles = F.col(vector).cast("array<double>")
    norm = F.greatest(F.sqrt(dot(doubles, doubles)), F.lit(1e-12))
    units = pairs.select(F.col(batch).alias("b"), F.col(pair).alias("i"), F.col(side).alias("s"), doubles.alias("d"), norm.alias("n"))
    units = units.select("b", "i", "s", F.transform("d", lambda x: x / F.col("n")).alias("u"))
    other = units.select("b", F.col("i").alias("j"), F.col("s").alias("t"), F.col("u").alias("v"))
    both = units.join(other, "b").where((F.col("i") != F.col("j")) | (F.col("s") != F.col("t")))
    both = both.withColumn("sim", dot(F.col("u"), F.col("v")) / temperature)
    rows = both.groupBy("b", "i", "s").agg(F.log(F.sum(F.exp("sim"))).alias("all"), F.max(F.when(F.col("i") == F.col("j"), F.col("sim"))).alias("own"))
    return rows.groupBy(F.col("b").alias("batch")).agg(F.avg(F.col("all") - F.col("own")).alias("loss"))


def numbered(df: DataFrame, key: str, to: str) -> DataFrame:
    """df with the place (from 0) of each row in the order of a key that tells rows apart, without one task for all."""
    return with_sums_before(df.withColumn("_one", F.lit(1)), [], key, {to: "_one"}).drop("_one")


def event_dates(df: DataFrame, year: str, month: str, day: str, amount: str, origin: str = "1970-01-01") -> DataFrame:
    """df with day_no, the days from a fixed date on, and the amount as a number (from currency text); rows without an amount
    go, a date that isn't one is null."""
    made = F.try_make_timestamp(F.col(year), F.col(month), F.col(day), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    out = df.withColumns({"day_no": F.datediff(made, F.lit(origin).cast("date")), amount: clean_numeric(F.col(amount))})
    return out.where(F.col(amount).isNotNull())


def client_key(prefix: str, column: Column, length: int = 16) -> Column:
    """A corpus's key for a client: its prefix and the first characters of the client's name."""
    return F.concat(F.lit(prefix), F.substring(column.cast("string"), 1, length))


def attach_embeddings(loans: DataFrame, vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """The loans that have a vector, with it (of several, the smallest), and one row of how many matched."""
    one = vectors.groupBy(key).agg(F.min(vector).alias(vector))
    joined = loans.join(one, key, "left").withColumn("_matched", F.col(vector).isNotNull())
    report = joined.agg(F.count(F.lit(1)).alias("n_loans"), F.count_if("_matched").alias("n_matched"))
    return joined.where("_matched").drop("_matched"), report
