"""SimHash near-dedup by anchor-point covering.

Fingerprints have 64 bits. The anchors are the words of a covering code: two binary Golay codes of length 23 (perfect,
covering radius 3 each) over the first 46 bits, and for the other 18 bits the code of the zero word alone (radius 18).
Every fingerprint lies within the covering radius of its home anchor, block by block. If y differs from x in at most t
bits, y exceeds the radius at x's home by t bits at most, summed over the blocks. So each fingerprint is replicated to
every anchor within covering radius plus t, and per anchor the fingerprints at home there are compared with all that
were replicated to it. No linked pair is lost: the home of the smaller one finds it. Replicas are dealt by anchor, never broadcast.

Defined results. Null or wordless text: fingerprint zero, linked as any other. Equal fingerprints are one node, so copies
are not expanded into pairs. Repeated rows: each gets its row. Empty table: no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, quoted, text_or_empty, utf8_rows, word_offsets, written
from .components import connected_components
from .exact_dedup import row_key

GOLAY, LENGTH, RADIUS = 0xAE3, 23, 3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the code
BLOCK_OF_SHINGLES = 1 << 15


def simhash(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values; A-Z count as a-z, repeats count."""
    words = text.lower().split()
    if not words:
        return 0
    joined, begins, ends = word_offsets(words)
    k = min(words_per_shingle, len(words))
    n, ones, h = len(words) - k + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    begins, ends = begins[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, BLOCK_OF_SHINGLES):
        hashes = np.array([h(joined[i:j], seed) for i, j in zip(begins[at : at + BLOCK_OF_SHINGLES], ends[at : at + BLOCK_OF_SHINGLES])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for some in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += bits[some : some + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def remainders(x: np.ndarray) -> np.ndarray:
    """Of 23-bit words as polynomials over GF(2), the remainders of division by the generator."""
    x = x.copy()
    for bit in range(LENGTH - 1, 10, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
    return x


def coset_words(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of up to RADIUS + threshold bits, sorted by remainder: the words, their weights, and where each remainder begins."""
    words = [np.zeros(1, np.int64)]
    for _ in range(RADIUS + threshold):
        more = words[-1][:, None] | (1 << np.arange(LENGTH, dtype=np.int64))[None, :]
        words.append(np.unique(more[more != words[-1][:, None]]))
    weights = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate(words)
    rest = remainders(flat)
    order = np.lexsort((weights, rest))
    return flat[order], weights[order], np.searchsorted(rest[order], np.arange((1 << 11) + 1))


def anchors(prints: np.ndarray, threshold: int, _tables: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of prints go to which anchors: (row, anchor), for all anchors within covering radius plus threshold."""
    if threshold not in _tables:
        _tables[threshold] = coset_words(threshold)
    words, weights, begins = _tables[threshold]
    rows, anchor, excess = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
    for block in range(2):
        part = (prints[rows] >> np.uint64(LENGTH * block) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        rest = remainders(part)
        counts = begins[rest + 1] - begins[rest]
        each = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[rest][each]
        over = excess[each] + np.maximum(0, weights[at] - RADIUS)
        fits = over <= threshold
        each, at = each[fits], at[fits]
        rows, excess = rows[each], over[fits]
        anchor = anchor[each] | (part[each] ^ words[at]) << LENGTH * block
    return rows, anchor


def homes(prints: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint."""
    return anchors(prints, 0)[1]


def linked_pairs(distinct: DataFrame, threshold: int) -> DataFrame:
    """(x, y), x < y as signed numbers: the pairs of distinct fingerprints (column fp) that differ in at most threshold bits."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(prints), 2000):
                rows, anchor = anchors(prints[at : at + 2000], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(prints[at : at + 2000][rows].view(np.int64))], names=["anchor", "y"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(homes(prints.view(np.uint64))), pa.array(prints)], names=["anchor", "x"])

    visitors = distinct.select("fp").mapInArrow(replicate, "anchor long, y long")
    home = distinct.select("fp").mapInArrow(at_home, "anchor long, x long")
    near = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold)
    # Spark takes visitors for as small as the fingerprints that they are made from, and would broadcast them
    return home.join(visitors.hint("merge"), "anchor").where(near).select("x", "y").distinct()


def _grouped(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, component, component_id) of each fingerprint in prints (doc_id, fp)."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = connected_components(linked_pairs(nodes, threshold), "x", "y").withColumnRenamed("node", "fp")
    classed = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    return written(classed.join(least, "component").select("fp", "component", "component_id"), "components")


def _prints_of(words_per_shingle: int):
    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(x, words_per_shingle) for x in utf8_rows(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[batch.schema.names[0], "fp"])
            give_back()

    return prints_of


def near_groups(docs: DataFrame, threshold: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id that can be reached): a row for each row of docs."""
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).mapInArrow(_prints_of(words_per_shingle), "doc_id long, fp long"), "simhashes")
    named = _grouped(prints, threshold)
    return prints.join(named.drop("component"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, threshold: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id, of several such rows the one of smallest SHA-256.

    Defined results: those of near_groups. Rows are told apart by doc_id and text, so that of rows of one doc_id with different
    texts each counts; a null doc_id counts as larger than all numbers, so such a row stays only if its group has no other. All
    columns of docs come out, whatever their names, and no other.
    """
    keys = docs.select(row_key().alias("key"), text_or_empty().alias("t")).mapInArrow(_prints_of(words_per_shingle), "key string, fp long")
    prints = written(keys.withColumn("doc_id", F.substring_index("key", ":", 1).try_cast("long")), "simhashes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = prints.join(_grouped(prints, threshold), "fp").groupBy("component").agg(F.min(rank).alias("r"))
    name = fresh(docs, "row_key")
    kept = written(first.select(F.col("r.key").alias(name)), "kept")
    return docs.withColumn(name, row_key()).join(kept, name, "left_semi").dropDuplicates([name]).select(*map(quoted, docs.columns))
