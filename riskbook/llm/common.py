"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="riskbook-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again.

    This cuts the lineage: what follows survives the loss of any executor without running the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what this worker has freed to the machine: workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def forget_encoders() -> None:
    """Drops the encoders and their tables that an earlier stage has left in this worker, for a stage that needs the memory."""
    if units := sys.modules.get("riskbook.llm.units"):
        units.encoder.__defaults__[-1].clear()
        give_back()


def in_task(spark: SparkSession, f: Callable):
    """The result of f(), computed in one task: bounded numeric work that would weigh on the driver."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f())], pa.binary())], names=["x"])

    return pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(once, "x binary").first()[0])


def text_or_empty(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def utf8_rows(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null gives b""."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_offsets(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each begins and ends in that."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.empty_like(ends)
    begins[:1] = 0
    begins[1:] = ends[:-1] + 1
    return b" ".join(words), begins, ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
