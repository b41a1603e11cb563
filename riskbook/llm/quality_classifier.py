"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words (lower case, without closing marks) and the shapes of neighbouring words (runs of letters and
digits as one sign, other signs as they are), both hashed into a fixed number of terms, and terms for how long and how
repetitive it is. Weights are square roots of counts by length, times the logarithm of inverse document frequency. On a
bounded sample of labelled texts (`most`, by default 3,000, the rows of smallest hash of doc_id) the terms are weighted and a
truncated singular value decomposition gives the latent space, in one task of that bounded input. The sample's unit vectors
(at most `most` x `rank` numbers) and their labels are broadcast; every document's cosines with all of them come from blocked
matrix products, and the `neighbours` nearest vote with their labels, weighted by powers of similarity: the score is the
weighted mean label.

Defined results. Null or empty text: scored as a text without terms, by the length terms alone. No usable label: the score
is 1. doc_ids repeated in labels: their mean. doc_ids repeated in documents: each gets its row; of a labelled one, the
smallest text is learned. A null doc_id: scored as any other, not held out. Empty table: no row. Labels, lang, source and
doc_id are no inputs of a score. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_encoders, give_back, mix64, text_or_empty
from .quality_rules import base_counts

WORDS, SHAPES, BINS = 1 << 12, 1 << 11, 12
TERMS = WORDS + SHAPES + 5 * BINS
BLOCK = 256
#: What a shape makes of runs of small letters, of capitals, and of digits.
SHAPE_OF = ((r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+", "x"), (r"[A-Z\x{c0}-\x{d6}\x{d8}-\x{de}]+", "X"), (r"[0-9]+", "0"))


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, names.to_pylist()), np.uint64, len(names))


def terms(texts: list[str]) -> np.ndarray:
    """The terms of some texts, a row for each, before they are weighted."""
    out = np.zeros((len(texts), TERMS), np.float32)
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    words = parts.flatten()
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    doc, coded = doc[there], words.filter(pa.array(there)).dictionary_encode()
    at, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if len(doc):
        plain = _hashes(pc.utf8_lower(pc.utf8_trim(names, ".,;:!?"))) % np.uint64(WORDS)
        shaped = names
        for pattern, sign in SHAPE_OF:
            shaped = pc.replace_substring_regex(shaped, pattern, sign)
        shaped = shaped.dictionary_encode()
        shapes = _hashes(shaped.dictionary)[shaped.indices.to_numpy(zero_copy_only=False)][at]
        pairs = mix64(shapes[:-1] * np.uint64(31) + shapes[1:]) % np.uint64(SHAPES)
        same = doc[1:] == doc[:-1]
        keys = np.concatenate([doc * TERMS + plain[at].astype(np.int64), doc[1:][same] * TERMS + WORDS + pairs[same].astype(np.int64)])
        counts = np.bincount(keys, minlength=out.size).reshape(out.shape)
        length = np.maximum(1, np.bincount(doc, minlength=len(texts)))
        out[:] = np.sqrt(counts / length[:, None])
    for row, text in zip(out, texts):
        n, chars, symbols, lines, repeated = base_counts(text)
        n_lines = text.count("\n") + 1
        for k, x in enumerate((np.log2(1 + n) / 16, repeated / max(1, n), symbols / max(1, chars), lines / n_lines, chars / max(1, n) / 24)):
            # two neighbouring bins share the value, so near values have near vectors
            place = min(max(float(x), 0.0), 1.0) * (BINS - 1)
            low = min(int(place), BINS - 2)
            first = WORDS + SHAPES + k * BINS + low
            row[first], row[first + 1] = 1 - (place - low), place - low
    return out


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = 48, seed: int = 7) -> dict:
    """The latent space of labelled rows of terms, and their vectors in it."""
    weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32)
    weight[-5 * BINS :] = 1.0
    mean = rows.mean(axis=0)
    centred = (rows - mean) * weight
    rank = min(rank, *centred.shape)
    # randomised range finder with two power steps (Halko et al., 2011)
    q = np.linalg.qr(centred @ np.random.default_rng(seed).standard_normal((TERMS, rank + 8)).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(centred @ np.linalg.qr(centred.T @ q)[0])[0]
    _, _, right = np.linalg.svd(q.T @ centred, full_matrices=False)
    space = np.ascontiguousarray((right[:rank] * weight).T, dtype=np.float32)
    model = {"space": space, "origin": (mean @ space).astype(np.float32), "labels": labels.astype(np.float32)}
    model["vectors"] = latent(model, rows)
    return model


def latent(model: dict, rows: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of terms in the latent space."""
    v = rows @ model["space"] - model["origin"]
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def vote(model: dict, vectors: np.ndarray, neighbours: int = 11, sharpness: float = 8.0) -> np.ndarray:
    """The similarity-weighted mean label of each vector's nearest labelled vectors."""
    cosines = vectors @ model["vectors"].T
    k = min(neighbours, cosines.shape[1])
    at = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weights = np.maximum(np.take_along_axis(cosines, at, axis=1), 1e-3) ** sharpness
    return np.clip((weights * model["labels"][at]).sum(axis=1) / weights.sum(axis=1), 0, 1)


def scores_of(model: dict | None, texts: list[str], neighbours: int = 11) -> np.ndarray:
    """The score of each text, block by block; 1 without a model."""
    if model is None or not texts:
        return np.ones(len(texts))
    out = np.concatenate([vote(model, latent(model, terms(texts[at : at + BLOCK])), neighbours) for at in range(0, len(texts), BLOCK)]).astype(np.float64)
    give_back()
    return out


def held_out(doc_id: Column) -> Column:
    """True for the rows that labels are not learned from: a remainder of zero of crc32(doc_id as text) by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_on(docs: DataFrame, labels: DataFrame, most: int = 3000, rank: int = 48) -> dict | None:
    """The model from at most `most` labelled documents that aren't held out; None if there are none."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        rows = [(t, y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if rows:
            rows.sort()  # the order that rows arrive in doesn't matter
            texts, known = [t for t, _ in rows], np.array([y for _, y in rows])
            matrix = np.concatenate([terms(texts[at : at + BLOCK]) for at in range(0, len(texts), BLOCK)])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(matrix, known, rank))], pa.binary())], names=["model"])

    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("label"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_or_empty().alias("t"))
    known = texts.select("doc_id").distinct().join(usable, "doc_id")
    chosen = known.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.first("label").alias("label"))
    got = sample.select("t", "label").repartition(1).mapInArrow(learn, "model binary").collect()  # of at most `most` texts
    return pickle.loads(got[0]["model"]) if got else None


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 3000, neighbours: int = 11) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, most))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(model.value, batch.column(1).to_pylist(), neighbours), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 3000) -> DataFrame:
    """docs without those that the classifier rejects; columns stay as they are, and no shuffle is needed.

    Defined results: those of quality_scores; null and empty texts are judged as such, repeated rows alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, most))

    scorer = F.pandas_udf(scorer_of(model), "double")
    return docs.where(scorer(text_or_empty()) >= threshold)


def scorer_of(model) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """The scores of a column of texts by a broadcast model, in batches."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget_encoders()
        for some in batches:
            yield pd.Series(scores_of(model.value if model else None, some.tolist()))

    return score
