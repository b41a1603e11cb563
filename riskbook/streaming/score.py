"""Scoring of loan files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskbook.functions import onset_month, risk_band, weibull_curve


def decide(scored: DataFrame) -> DataFrame:
    """Band, curve and alert of scored loans; every row by itself, so batch and stream agree."""
    curve = weibull_curve(F.col("p"), F.col("term_months"))
    return scored.withColumns({"band": risk_band(F.col("p")), "curve": curve}).withColumn("onset", onset_month(F.col("curve")))


def score_stream(spark: SparkSession, source: str, schema, score, sink: str, checkpoint: str) -> DataFrame:
    """All loan files in a folder scored, as a stream that ends when there are no more; gives what the sink holds.

    score: a function of a frame, streaming or not, that adds p.
    """
    loans = spark.readStream.schema(schema).parquet(source)
    query = decide(score(loans)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.parquet(sink)


def misfit(found: StructType, wanted: StructType) -> str | None:
    """Why a file's columns don't serve; None if they do: each wanted column must be there, of the wanted type."""
    kinds = {f.name: f.dataType.simpleString() for f in found}
    wrong = [f"{f.name}: {kinds.get(f.name, 'absent')}, not {f.dataType.simpleString()}" for f in wanted if kinds.get(f.name) != f.dataType.simpleString()]
    return "; ".join(wrong) or None


def score_files(spark: SparkSession, source: str, schema: StructType, score: Callable[[DataFrame], DataFrame], sink: str, quarantine: str, checkpoint: str, files_a_batch: int = 100) -> None:
    """New loan files in a folder scored by what a saved model's `score` does, until there are no more.

    The stream is one of file names; a batch looks at its files' schemas (a bounded number of footers), sets those that don't
    fit aside with the reason, and scores the rest with one job. A batch writes a folder named after its number, so a batch
    that is run again after a failure replaces what it wrote, and no loan comes out twice.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(source).select("path")

    def one(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())  # files_a_batch at most
        wrong = {p: w for p in paths if (w := _why_not(spark, p, schema))}
        good = [p for p in paths if p not in wrong]
        if wrong:
            spark.createDataFrame(list(wrong.items()), "path string, reason string").coalesce(1).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        if good:
            loans = spark.read.schema(schema).parquet(*good)
            decide(score(loans)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = names.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()


def _why_not(spark: SparkSession, path: str, schema: StructType) -> str | None:
    from pyspark.errors import PySparkException

    try:
        return misfit(spark.read.parquet(path).schema, schema)
    except PySparkException as e:  # no Parquet at all
        return f"unreadable: {type(e).__name__}"
