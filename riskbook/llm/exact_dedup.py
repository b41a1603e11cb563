"""Exact dedup by composable polynomial fingerprints.

The bytes of a text are cut into chunks. Each chunk has a polynomial hash, H(b) = sum b[i] * B**i mod p, in two
lanes (two primes, two bases); hashes of neighbouring chunks combine by length-shifted arithmetic,
H(x + y) = H(x) + B**len(x) * H(y). So a text of more than one chunk becomes rows of chunks, which any tasks hash, each shifted by
what lies before it; a text's hash is the sum of its chunks' by a grouping. Texts of equal fingerprint and
length are then compared with the group's representative chunk by chunk, as rows of a join; what differs (a
collision) goes into another round with a representative of its own, so the groups are exact.

A row is told apart by its doc_id and the SHA-256 of its text, so rows of one doc_id with different texts are different
documents. Only rows whose fingerprint occurs twice or more have their text compared. What is joined is written first, so that
Spark can split the partitions of a large group.

Defined results. Null text: an empty text. Empty texts: equal to each other. Repeated rows of a doc_id with equal text all
count in group_size; kept is true for the rows with the largest doc_id. A null doc_id: a row as any other, smaller than all
numbers. Empty table: no row. Columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, text_or_empty, written

#: Primes and bases of the two lanes; products stay below 2**62.
LANES = ((2147483647, 1103515245), (2147483629, 1664525))
CHUNK = 1 << 16


def chunk_hash(data: np.ndarray, lane: int, _powers: dict = {}) -> int:
    """The polynomial hash of one chunk of bytes, of CHUNK bytes at most."""
    p, base = LANES[lane]
    if lane not in _powers:
        pw = np.empty(CHUNK, np.uint64)
        x = 1
        for i in range(CHUNK):
            pw[i] = x
            x = x * base % p
        _powers[lane] = pw
    return int(np.dot(data.astype(np.uint64), _powers[lane][: len(data)])) % p


def combine(left: int, left_length: int, right: int, lane: int) -> int:
    """The hash of two byte strings put together, from their hashes and the length of the first."""
    p, base = LANES[lane]
    return (left + pow(base, left_length, p) * right) % p


def shifted(data: bytes, at: int) -> list[int]:
    """What a chunk that begins at byte `at` adds to its text's hash, in each lane."""
    return [combine(0, at, chunk_hash(np.frombuffer(data, np.uint8), lane), lane) for lane in range(len(LANES))]


def fingerprint(data: bytes) -> int:
    """Both lanes of a text in one 62-bit number."""
    parts = [shifted(data[at : at + CHUNK], at) for at in range(0, max(1, len(data)), CHUNK)]
    left, right = (sum(x) % p for x, (p, _) in zip(zip(*parts), LANES))
    return left << 31 | right


def _prints(texts: DataFrame) -> DataFrame:
    """(key, doc_id, text_sha256, n_bytes, fp) of each row; fp is the hash of _t's bytes."""
    hash_one = fingerprint
    long = F.octet_length("_t") > CHUNK

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(3).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(len, found), pa.int64()), pa.array(map(hash_one, found), pa.int64())], names=["key", "doc_id", "text_sha256", "n_bytes", "fp"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, chunks = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            left, right = zip(*(shifted(x, k * CHUNK) for k, x in zip(places, chunks))) if places else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["key", "doc_id", "text_sha256", "n_bytes", "chunk_no", "left", "right"])

    texts = texts.select("key", "doc_id", F.substring_index("key", ":", -1).alias("text_sha256"), "_t")
    short = texts.where(~long).mapInArrow(whole, "key string, doc_id long, text_sha256 string, n_bytes long, fp long")
    rows = _chunks(texts.where(long).withColumn("n_bytes", F.octet_length("_t").cast("long"))).select("key", "doc_id", "text_sha256", "n_bytes", "chunk_no", "chunk")
    hashed = rows.repartition("key", "chunk_no").mapInArrow(parts, "key string, doc_id long, text_sha256 string, n_bytes long, chunk_no int, left long, right long")
    # repeated rows have equal chunks: each is taken once, with how often it occurs
    once = hashed.groupBy("key", "doc_id", "text_sha256", "n_bytes", "chunk_no").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.count(F.lit(1)).alias("m"))
    lanes = [F.sum(x) % F.lit(p) for x, (p, _) in zip(("left", "right"), LANES)]
    sums = once.groupBy("key", "doc_id", "text_sha256", "n_bytes").agg(F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]).alias("fp"), F.max("m").alias("m"))
    many = sums.select("key", "doc_id", "text_sha256", "n_bytes", "fp", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("_")).drop("_")
    return short.unionByName(many)


def _chunks(texts: DataFrame) -> DataFrame:
    """texts with a row for each chunk (chunk_no, chunk) of column _t; an empty text has one empty chunk."""
    body = texts.withColumn("_b", F.col("_t").cast("binary")).drop("_t")
    at = F.expr(f"sequence(0, greatest(int(ceil(length(_b) / {CHUNK}D)), 1) - 1)")
    rows = body.select("*", F.explode(at).alias("chunk_no"))
    return rows.withColumn("chunk", F.expr(f"substring(_b, chunk_no * {CHUNK} + 1, {CHUNK})")).drop("_b")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells a row of documents apart: its doc_id and the SHA-256 of its text."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), F.sha2(text_or_empty(text), 256))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows (key, doc_id, text_sha256, n_bytes, fp), and for each row whose text equals another's with
    a larger doc_id, that of the largest: key, rep_id, rep_key."""
    texts = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_t"))
    prints = written(_prints(texts), "prints")
    # A row of `left` is not yet settled; round after round its fingerprint's largest doc_id is the representative.
    left, settled, round_no = prints, None, 0
    while True:
        groups = left.groupBy("n_bytes", "fp").agg(F.max(F.struct("doc_id", "key")).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
        groups = written(groups.select("n_bytes", "fp", F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key")), f"groups{round_no}")
        members = written(left.join(groups, ["n_bytes", "fp"]).select("key", "rep_id", "rep_key").distinct(), f"members{round_no}")
        both = written(texts.select("key", "_t").join(members, "key"), f"compared{round_no}")
        chunks = _chunks(both.where("key <> rep_key"))
        reps = _chunks(both.where("key = rep_key")).select("rep_key", "chunk_no", F.col("chunk").alias("rep_chunk"))
        reps = written(reps.dropDuplicates(["rep_key", "chunk_no"]), f"reps{round_no}")
        rest = chunks.join(reps, ["rep_key", "chunk_no"], "left")
        agreed = F.bool_and(F.coalesce(F.col("chunk") == F.col("rep_chunk"), F.lit(False)))
        same = written(rest.groupBy("key", "rep_id", "rep_key").agg(agreed.alias("same")), f"same{round_no}")
        done = same.where("same").drop("same")
        settled = done if settled is None else settled.unionByName(done)
        failed = same.where("not same").select("key")
        if failed.isEmpty():
            return prints, settled
        left, round_no = left.join(failed, "key", "left_semi"), round_no + 1


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    prints, settled = _classes(docs)
    placed = prints.join(settled, "key", "left")
    placed = written(placed.select("doc_id", "text_sha256", F.when(F.col("rep_key").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")).alias("keep_id"), F.coalesce("rep_key", "key").alias("keep_key")), "placed")
    # sizes are summed before they are shuffled
    sizes = written(placed.groupBy("keep_key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "sizes")
    out = placed.join(sizes, "keep_key", "left")
    return out.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text equals that of a row with a larger doc_id; of repeated rows, one stays.

    Defined results: those of exact_groups; rows of one doc_id with different texts stay, a null doc_id goes only if its text
    occurs elsewhere. All columns of docs come out, whatever their names, and no other.
    """
    _, settled = _classes(docs)
    name = fresh(docs, "row_key")
    return docs.withColumn(name, row_key()).join(settled.select(F.col("key").alias(name)), name, "left_anti").dropDuplicates([name]).select(*map(quoted, docs.columns))
