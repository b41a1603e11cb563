"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often it has them. For each sample, a term's hash gives two gamma variates
and one uniform; from these and the weight follows a value (Ioffe's), and the least of all terms is the document's sample. Two
documents have the same sample with the probability of their generalised Jaccard similarity, the sum of the smaller weights
over the sum of the larger. A sample is kept as 16 bits of a hash, so others coincide once in 65,536 times.

`edited_likeness` holds each document against an edited copy, whose tail is the next document's head. Documents are dealt out
over ranges of (doc_id, hash of the text), descending; the first of a range goes to the range before it too, and the
first of all to the last. So every document meets its next in one task, texts are shuffled once, and no task holds more than
its range; equal ids are dealt over several ranges if need be.

Defined results. Null counts as empty. No words: a fingerprint of zeros, like any other without words (1) and unlike the rest
(0). Repeated rows: a row each, next to each other in the order of the texts' hashes; a null id comes last, and both a sole
document's next and an empty table's result are plain: itself, and no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64, text_or_empty, utf8_rows

GROUP = 1 << 22  # bytes of texts that are sampled together
SAMPLES = 128
LEAST_ID = -(2**63)  # stands for a null id in the order
UNIT = 2.0**-32


def term_values(terms: np.ndarray, log_weights: np.ndarray, sample: int) -> np.ndarray:
    """For one sample, the value of each term (a 64-bit hash) at its weight; the least wins."""
    first = mix64(terms ^ mix64(np.full(1, sample + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    second = mix64(first + np.uint64(0x9E3779B97F4A7C15))
    third = mix64(second + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64(0xFFFFFFFF)
    both = [(((x >> np.uint64(32)) + 0.5) * UNIT) * (((x & low) + 0.5) * UNIT) for x in (first, second)]
    r, c = -np.log(both[0]), -np.log(both[1])  # each the sum of two exponential variates: gamma of shape 2
    beta = (third >> np.uint64(11)) * 2.0**-53
    t = np.floor(log_weights / r + beta)
    return np.log(c) - r * (t - beta) - r


def signatures(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each text in UTF-8; a text without words has zeros."""
    numbers: dict[bytes, int] = {}
    add = numbers.setdefault
    lists = [x.split() for x in texts]  # at \x20 and \x09-\x0d
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    codes = np.fromiter((add(w, len(numbers)) for words in lists for w in words), np.int64, int(counts.sum()))
    del lists
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(codes):
        return out
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    own, weights = np.unique(np.repeat(np.arange(len(texts)), counts) * len(numbers) + codes, return_counts=True)
    text, code = own // len(numbers), own % len(numbers)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    # a term's values at one weight are made once for all texts
    place, distinct = pd.factorize(code * (int(weights.max()) + 1) + weights)
    terms, logs = hashes[distinct // (int(weights.max()) + 1)], np.log(distinct % (int(weights.max()) + 1))
    for k in range(samples):
        least = np.minimum.reduceat(term_values(terms, logs, k)[place], starts)
        out[text[starts], k] = mix64(least.view(np.uint64)) >> np.uint64(48)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples in which rows agree; a row of zeros is like zeros alone."""
    none_a, none_b = ~a.any(axis=1), ~b.any(axis=1)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), (a == b).mean(axis=1))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint), the samples as little-endian unsigned 16-bit numbers; without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.astype("<u2").tobytes() for x in signatures(texts, samples)], pa.binary())], names=["doc_id", "fingerprint"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= GROUP:
                    yield made()
                    ids, texts, size = [], [], 0
                    give_back()
        if ids:
            yield made()

    return _texts(docs).mapInArrow(rows, "doc_id long, fingerprint binary")


def edited(text: str, after: str) -> str:
    """The text with its last third's code points replaced by the first as many of the text after it."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(id, hash) as 16 bytes that sort alike."""
    flip = np.uint64(1 << 63)
    both = np.stack([ids.astype(np.int64).view(np.uint64) ^ flip, hashes.astype(np.int64).view(np.uint64) ^ flip], axis=1)
    return both.astype(">u8").view("V16").reshape(-1)


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, id, hash, part, guest): rows in descending order by part, and at each part's end, as a guest, the row that
    comes next. Cuts are keys of a bounded sample of rows; any cuts give the same result."""
    rows = _texts(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"), F.xxhash64("text").alias("hash"))
    n = docs.count()
    top = rows.agg(F.max("id")).first()[0]
    if top is None:
        return rows.select("*", F.lit(0).alias("part"), F.lit(False).alias("guest"))
    top = (top, rows.where(F.col("id") == top).agg(F.max("hash")).first()[0])
    some = rows.select("id", "hash").sample(min(1.0, 40 * parts / n), 11).collect() if parts > 1 else []
    keys = sorted({(r[0], r[1]) for r in some}, reverse=True)
    cuts = [top, *dict.fromkeys(keys[i] for i in range(len(keys) // parts, len(keys), max(1, math.ceil(len(keys) / parts))) if keys[i] != top)]
    # ascending, so that a search finds the part whose first row (its cut) is the least that is not less than a row
    found = _keys(*(np.array(x, np.int64) for x in zip(*cuts[::-1]))).tobytes()
    last = len(cuts) - 1

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ends, mine = (np.array([x.tobytes() for x in k], object) for k in (np.frombuffer(found, "V16"), _keys(ids.to_numpy(np.int64), hashes.to_numpy(np.int64))))
        at = np.searchsorted(ends, mine, side="left")
        first = ends[at] == mine
        return pd.Series([[last - k] + ([last - k - 1 if k < last else -1] if f else []) for k, f in zip(at.tolist(), first.tolist())])

    spread = rows.select("*", F.posexplode(places("id", "hash")).alias("guest", "part"))
    return spread.select("doc_id", "text", "id", "hash", F.when(F.col("part") < 0, last).otherwise(F.col("part")).alias("part"), (F.col("guest") > 0).alias("guest"))


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of docs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        """The results of all rows that are followed by their next; rows are (doc_id, text, part, guest)."""
        goes_on = [a[2] == b[2] and not a[3] for a, b in zip(rows, rows[1:])]
        texts = [x[1] for x in rows]
        changed = [edited(a, b) if ok else "" for a, b, ok in zip(texts, texts[1:], goes_on)]
        raw = [x.encode() for x in changed]
        prints = signatures([x.encode() for x in texts] + raw, samples)
        own, other = prints[: len(rows)], prints[len(rows) :]
        keep = [k for k, ok in enumerate(goes_on) if ok]
        shown = lambda x: [bytes(y).hex() for y in x[keep].astype("<u2")]
        near_next = likeness(own[:-1], own[1:])
        columns = [[rows[k][0] for k in keep], [len(texts[k]) for k in keep], [hashlib.sha256(raw[k]).hexdigest() for k in keep], shown(own), shown(other), likeness(own[:-1], other)[keep], near_next[keep]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, text, part, guest in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rows.append((doc_id, text.decode("utf-8", "replace"), part, guest))
                size += len(text)
                if size >= GROUP and len(rows) > 1:
                    yield made(rows)
                    rows, size = rows[-1:], len(text)
                    give_back()
        if len(rows) > 1:
            yield made(rows)

    # the part's number is the task's; a task's rows are in descending order
    spread = dealt(docs, parts).repartitionById(parts, "part").sortWithinPartitions("part", "guest", F.desc("id"), F.desc("hash"))
    return spread.select("doc_id", "text", "part", "guest").mapInArrow(found, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
