"""Byte-level BPE encoding and decoding, with overlapping chunks for long texts.

A text of up to `chunk` characters is one chunk. A longer one is cut into chunks that overlap their successor. The
chunks are rows of their own: each is pre-tokenised in parallel, and reports the boundaries that it finds in its first
and its last `overlap` characters. Where the pre-token boundaries of neighbours coincide, they have resynchronised; the
first such place is the seam. The pieces between seams are then encoded in parallel, and a document's ids are put
together in order. If two neighbours have no common boundary in the overlap (a run of thousands of letters, say), they
are one piece. Decoding concatenates the raw bytes of the ids.

Defined results. Null: an empty text, no ids. Repeated rows of a doc_id: each gets a row. A null doc_id: a row as any other.
Empty table: no row. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written


def bpe_encoding(path: str, pattern: str, _made: dict = {}):
    """The worker's tiktoken encoding of a file of ranks."""
    if (path, pattern) not in _made:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _made[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _made[path, pattern]


def boundaries(text: str, pattern: str, start: int = 0) -> list[int]:
    """Where pre-tokens begin in a text, counted from `start`."""
    return [start + m.start() for m in regex.compile(pattern).finditer(text)]


def seam(tail: list[int], head: list[int], after: int) -> int | None:
    """The first boundary beyond `after` that both neighbours have found."""
    common = set(head)
    return next((x for x in tail if x in common and x > after), None)


def _rows(batch: pa.RecordBatch, ids: list[list[int]], encoding) -> list[pa.Array]:
    arrays = [np.asarray(x, "<u4") for x in ids]
    return [pa.array(map(len, arrays), pa.int64()), pa.array((x.tobytes() for x in arrays), pa.binary())]


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """(row, doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit numbers; `row` tells repeated rows apart."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = bpe_encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([some.column(0), *_rows(some, [encoding.encode_ordinary(x) for x in some.column(1).to_pylist()], encoding)], names=["doc_id", "n_tokens", "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                for k, at in enumerate(starts):
                    part = text[at:] if k + 1 == len(starts) else text[at : at + chunk + overlap]
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "row": row, "k": k, "at": at, "part": part}], schema=chunk_schema)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                found = np.array(boundaries(x["part"], pattern, x["at"]), np.int64)
                # what lies within a few characters of the end may change with the text that follows
                x["head"] = found[found < x["at"] + overlap].tolist()
                x["tail"] = found[(found >= x["at"] + chunk)].tolist()
                yield pa.RecordBatch.from_pylist([x], schema=found_schema)

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = bpe_encoding(path, pattern)
        for batch in batches:
            ids = [np.asarray(encoding.encode_ordinary(x or ""), "<u4").tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "row", "k", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each chunk and the head that its successor found: the piece from its own start to the seam, both relative."""
        for batch in batches:
            for x in batch.to_pylist():
                x["seam"] = None if x["next_head"] is None else seam(x["tail"][:-2], x["next_head"], x["at"] + chunk)
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in seam_schema.names}], schema=seam_schema)

    chunk_schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("k", pa.int32()), ("at", pa.int64()), ("part", pa.string())])
    found_schema = pa.schema([*chunk_schema, ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
    seam_schema = pa.schema([*chunk_schema, ("last", pa.bool_()), ("seam", pa.int64())])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    limit = chunk + overlap
    short = texts.where(F.length("t") <= limit).mapInArrow(whole, "doc_id long, n_tokens long, ids binary").withColumn("row", F.lit(0).cast("long"))
    long = texts.where(F.length("t") > limit).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "t")
    parts = written(long.mapInArrow(chunks, "doc_id long, row long, k int, at long, part string"), "chunks")
    # spread by chunk, so one huge document is pre-tokenised by many tasks
    found = written(parts.repartition("doc_id", "row", "k").mapInArrow(pretokenise, "doc_id long, row long, k int, at long, part string, head array<long>, tail array<long>"), "boundaries")
    heads = found.select("row", (F.col("k") - 1).alias("k"), F.col("head").alias("next_head"))
    seams = found.join(heads, ["row", "k"], "left").withColumn("last", F.col("next_head").isNull())
    seams = written(seams.select("doc_id", "row", "k", "at", "part", "tail", "next_head", "last").mapInArrow(stitch, "doc_id long, row long, k int, at long, part string, last boolean, seam long"), "seams")
    # A chunk whose seam before it is missing goes on with its predecessor's piece: it is cut where its successor starts.
    ends = seams.select("row", (F.col("k") + 1).alias("k"), F.col("seam").alias("from"), F.lit(True).alias("after"))
    cut = seams.join(ends, ["row", "k"], "left")
    own = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.coalesce("from", "at")) - F.col("at")
    until = F.when(F.col("last"), F.lit(2**31 - 1)).otherwise(F.coalesce("seam", F.col("at") + chunk) - F.col("at"))
    pieces = cut.withColumn("piece", F.substring("part", own.cast("int") + 1, (until - own).cast("int")))
    pieces = pieces.withColumn("joins", (F.col("k") > 0) & F.col("from").isNull())
    clean = pieces.groupBy("row").agg(F.bool_or("joins").alias("joined"))
    whole_docs = clean.where("joined").select("row")
    good = pieces.join(clean.where("not joined").select("row"), "row", "left_semi").select("doc_id", "row", "k", "piece")
    # without a seam somewhere, the document's runs of chunks between seams are put together before they are encoded
    runs = pieces.join(whole_docs, "row", "left_semi").select("doc_id", "row", "k", "piece", F.coalesce(F.when(~F.col("joins"), F.col("k")), F.lit(None)).alias("first"))
    from pyspark.sql import Window

    w = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("run", F.last("first", ignorenulls=True).over(w)).groupBy("doc_id", "row", "run").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
    runs = runs.select("doc_id", "row", F.col("run").alias("k"), F.concat_ws("", F.col("p.piece")).alias("piece"))
    encoded = good.unionByName(runs).repartition("doc_id", "row", "k").mapInArrow(encode_pieces, "doc_id long, row long, k int, ids binary")
    gathered = encoded.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    gathered = gathered.select("doc_id", "row", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    return short.select("row", "doc_id", "n_tokens", "ids").unionByName(gathered.select("row", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, bytes): the raw bytes of the ids, put together."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = bpe_encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                raw = [encoding.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(raw, pa.binary())], names=["doc_id", "n_tokens", "ids", "bytes"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(bytes_of, "doc_id long, n_tokens long, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs."""
    got = decode(encode(docs, path, pattern, chunk, overlap), path, pattern)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
