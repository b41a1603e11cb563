"""Column functions: expressions that stay inside whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook import catalog as C


def clean_numeric(c: Column) -> Column:
    """Text with currency signs, commas and per cent signs as a number; what isn't one becomes null."""
    return F.regexp_replace(c.cast("string"), r"[,$%\s]", "").try_cast("double")


def number_of(df: DataFrame, column: str) -> Column:
    """A column of df as clean_numeric gives it; one that is a number already is not written as text and read again."""
    c = F.col(f"`{column}`")
    return c.cast("double") if df.schema[column].dataType.typeName() in ("double", "long", "integer", "short", "byte") else clean_numeric(c)


def rounded(x: Column | str, places: int) -> Column:
    """A double rounded as SQL engines do: scaled, rounded half away from zero, scaled back. Spark's own round goes by the decimal
    digits, so that ties fall on the other side (516.3128125 to six places)."""
    scale = F.lit(float(10**places))
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * scale, 0) / scale


def norm_name(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z]", "")


def risk_band(p: Column) -> Column:
    return F.when(p >= C.BAND_HIGH, "high").when(p >= C.BAND_MEDIUM, "medium").otherwise("low")


def text_distress(text: Column) -> Column:
    """How many of the listed terms a text contains."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [lowered.contains(t).cast("int") for t in C.DISTRESS_TERMS])


def classify_outcome(value: Column) -> Column:
    """1 for a bad outcome, 0 for a good one, null for neither: whole words, then parts, bad before good."""
    t = F.lower(F.trim(value))
    part = lambda words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return F.when(t.isin(C.BAD_WORDS), 1).when(t.isin(C.GOOD_WORDS), 0).when(part(C.BAD_PARTS), 1).when(part(C.GOOD_PARTS), 0)


def weibull_curve(p: Column, term: Column) -> Column:
    """Twelve cumulative default probabilities that end at p; the shape steepens with the term."""
    months = F.when(term > 0, term).otherwise(12).cast("double")
    k = F.greatest(F.lit(1.3), F.least(F.lit(2.6), 1.3 + months / 60))
    raw = lambda t: 1 - F.exp(-F.pow(t / F.lit(7.5), k))
    return F.transform(F.sequence(F.lit(1), F.lit(12)), lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p * raw(t.cast("double")) / raw(F.lit(12.0)))))


def onset_month(curve: Column, at: float = C.ALERT_AT) -> Column:
    """The first month (from 1) whose cumulative probability reaches the alert level; null if none does. The curve is computed once."""
    return F.nullif(F.array_position(F.transform(F.slice(curve, 1, 12), lambda x: x >= at), True), F.lit(0)).cast("int")


def gap_bucket(days: Column) -> Column:
    """How many gap edges are at most `days`; null gives 0."""
    return F.coalesce(reduce(lambda a, b: a + b, [(days >= e).cast("int") for e in C.GAP_EDGES]), F.lit(0))


def calibration_bin(p: Column) -> Column:
    """The bin from 0 to 9 of a probability, by literal edges, closed on the left."""
    return F.least(F.lit(9), reduce(lambda a, b: a + b, [(p >= e).cast("int") for e in C.BIN_EDGES[1:]]))


def format_value(x: Column, whole_from: float | None = 1e6) -> Column:
    """A number for reading: whole ones with thousands' commas, others with two places (none from `whole_from` on)."""
    whole = x == F.floor(x)
    whole = whole if whole_from is None else whole | (F.abs(x) >= whole_from)
    return F.when(x.isNull(), "missing").when(whole, F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def format_text(x: Column) -> Column:
    """A text for reading: beyond 60 characters, 57 and dots."""
    return F.when(x.isNull(), "missing").when(F.length(x) > 60, F.concat(F.substring(x, 1, 57), F.lit("..."))).otherwise(x)


def sample_cell(text: Column) -> Column:
    """A sample for a profile: longer texts are cut to 77 characters and dots."""
    return F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)
