"""Token-id output as bit-plane-shuffled blocks.

A file set is a Parquet table of blocks in the order of doc_id. A block has a fixed number of ids (the last of a shard
has fewer). Its ids are transposed into byte planes (plane j has byte j of every id) or bit planes, and each plane is
compressed with zstandard; upper planes of small ids take next to nothing. Beside the planes stands the chunk index of the
block: the shard, the number of ids before it in the shard, and which documents' ids it holds from where to where. So
every block can be read alone, and a document's ids are found without reading others.

Defined results. Null or empty text: the end id alone. Repeated rows of a doc_id: each is written, side by side. Empty
table: no block. Very long texts go over many blocks. Strings of special tokens in a text are plain text (the library
would by default take them for the tokens). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .units import encoder

BLOCK = 1 << 16
BLOCK_SCHEMA = "shard int, block_no int, first_id long, n_ids int, kind string, planes array<binary>, doc_no array<long>, doc_id array<long>, doc_from array<long>"
POLYNOMIAL = 0xEDB88320


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The compressed planes of a block of uint32 ids."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(rows.T)
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(x.tobytes()) for x in rows]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids of a block from its planes."""
    rows = np.stack([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        a = (a >> 1) ^ (POLYNOMIAL if a & 1 else 0)
        b = (b << 1) & 0xFFFFFFFF
    return out


def crc_of_both(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings put together, from theirs and the length of the second."""
    power, step, n = 0x80000000, 0x00800000, second_bytes  # 1, x**8
    while n:
        if n & 1:
            power = _times(power, step)
        step, n = _times(step, step), n >> 1
    return _times(first, power) ^ second


def write_ids(docs: DataFrame, path: str, tokenizer: str, units: Callable[[str], list[str]], end_id: int, shards: int | None = None, kind: str = "byte") -> None:
    """Writes the ids of docs, with end_id after each document, in ascending order of doc_id, into a folder of block files."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer, units), TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        docs_here: list[tuple[int, int, int]] = []  # number, doc_id, where in the block its ids begin
        held, block_no, doc_no = 0, 0, 0

        def block() -> pa.RecordBatch:
            nonlocal waiting, docs_here, held, block_no
            ids = np.concatenate(waiting)
            numbers, names, begins = zip(*docs_here)
            row = {"shard": shard, "block_no": block_no, "first_id": block_no * BLOCK, "n_ids": held, "kind": kind, "planes": to_planes(ids, kind), "doc_no": numbers, "doc_id": names, "doc_from": begins}
            waiting, docs_here, held, block_no = [], [], 0, block_no + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode.batch(some.column(1).to_pylist(), end_id)):
                    begin = 0
                    while begin < len(ids):
                        part = ids[begin : begin + BLOCK - held]
                        docs_here.append((doc_no, doc_id, held))
                        waiting.append(part)
                        held, begin = held + len(part), begin + len(part)
                        if held == BLOCK:
                            yield block()
                    doc_no += 1
        if held:
            yield block()

    schema = pa.schema([("shard", pa.int32()), ("block_no", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("doc_no", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("doc_from", pa.list_(pa.int64()))])
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("t"))
    dealt = texts.repartitionByRange(shards, "doc_id") if shards else texts.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id").mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def read_ids(blocks: DataFrame) -> DataFrame:
    """(shard, doc_no, doc_id, block_no, at, part): the ids of each document in each block; `at` counts from the shard's first id."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = from_planes(x["planes"], x["n_ids"], x["kind"])
                begins = np.array(x["doc_from"], np.int64)
                n = len(begins)
                cut = [ids[i:j].tobytes() for i, j in zip(begins, [*begins[1:], len(ids)])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x["shard"], np.int32)), pa.array(x["doc_no"], pa.int64()), pa.array(x["doc_id"], pa.int64()), pa.array(np.full(n, x["block_no"], np.int32)), pa.array(begins + x["first_id"]), pa.array(cut, pa.binary())], names=["shard", "doc_no", "doc_id", "block_no", "at", "part"])

    return blocks.mapInArrow(parts, "shard int, doc_no long, doc_id long, block_no int, at long, part binary")


def document_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of a folder."""

    def crc_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                crc = parts[0]["crc"]
                for x in parts[1:]:
                    crc = crc_of_both(crc, x["crc"], 4 * x["n"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(out, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    pieces = read_ids(blocks).select("shard", "doc_no", "doc_id", "at", F.struct("block_no", (F.length("part") / 4).cast("long").alias("n"), F.crc32("part").alias("crc")).alias("p"))
    docs = pieces.groupBy("shard", "doc_no", "doc_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.min("at").alias("at"), F.sum("p.n").alias("n_tokens"))
    docs = docs.select("doc_id", "ps", "shard", "at", "n_tokens").mapInArrow(crc_all, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    # a row for each shard: as many as there were tasks that wrote
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
