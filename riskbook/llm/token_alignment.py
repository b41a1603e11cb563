"""Cross-tokenizer alignment: groups of one tokenizer's tokens and another's that cover the same bytes, and what links them.

Two tokenizers cut the same bytes (a space and the text). Where a token of either ends at the same byte, a group ends. The
ends of both are compared at the current shift between the indexes: exponential probing, by blocks that double, jumps over a
stretch in which every token faces one of the same end; the lowest bit in which the last block differs says where it stops. What follows is an irregular group; the ends
are merged there until they meet, which updates the shift. A link is a pair of tokens whose bytes overlap.

Counts of linked pairs are corpus-wide. A slice of documents is tokenised and aligned once and written as one row: its distinct
pairs with their counts, and each document's own pairs as numbers of these. Spark adds the counts up by pair, finds each B
id's highest, and returns each slice the counts of the pairs that it has asked for; no task holds the pairs of all.

Defined results. Null, empty and texts whose tokens don't give back their bytes (U+2581 in a text, which B writes as a space):
no tokens, zeros and the empty string. Strings of special tokens are plain text. Repeated rows and null ids: a row each.
Empty table: no row. Other columns are ignored, whatever their names. A long text is tokenised slice by slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, utf8_rows, written
from .units import SAFE_CUT, SLICE, WHITE, _Table, encoder, slices, spaced_units

GROUP = 1 << 21  # bytes of texts that are tokenised and aligned together
MOST = 120_000  # stretches of text that a worker remembers the ids of
PAIR = 32  # bits of the B id in a pair's number
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def probe(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group, the index of its last A and of its last B token; both end arrays rise strictly and end alike."""
    ends_a, ends_b = (np.ascontiguousarray(x, np.uint32) for x in (ends_a, ends_b))
    raw_a, raw_b, list_a, list_b = ends_a.tobytes(), ends_b.tobytes(), ends_a.tolist(), ends_b.tolist()
    n, m, i, shift = len(list_a), len(list_b), 0, 0
    number, odd = int.from_bytes, []  # for each irregular group: its first and last A index, and the shift that it leaves
    while i < n:
        at, block = i, 16
        while at < n:  # how far the ends face each other at this shift
            j = at + shift
            differ = number(raw_a[4 * at : 4 * (at + block)], "little") ^ number(raw_b[4 * j : 4 * (j + block)], "little")
            if differ:
                at += ((differ & -differ).bit_length() - 1) >> 5
                break
            at += block
            block *= 2
        if at >= n:  # a block that goes beyond both arrays' ends
            break
        i, j = at, at + shift
        if j >= m:
            break
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        i += 1
        shift = j + 1 - i
        odd.append((at, i - 1, shift))
    first, last, after = np.array(odd, np.int64).reshape(-1, 3).T
    inside = np.zeros(n + 1, np.int64)  # an A token ends a group unless it is in an irregular one and not its last
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    group_a = np.flatnonzero(np.cumsum(inside[:n]) == 0)
    shifts = np.concatenate([[0], after])[np.searchsorted(last, group_a, side="right")]
    return group_a, group_a + shifts


def links(ends_a: np.ndarray, ends_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A and B index of each link, in no order: one for a pair of single tokens, and in an irregular group one for each
    stretch of bytes between two ends of either."""
    first_a, first_b = np.concatenate([[0], group_a[:-1] + 1]), np.concatenate([[0], group_b[:-1] + 1])
    single = (first_a == group_a) & (first_b == group_b)
    count_a, count_b = (group_a - first_a + 1)[~single], (group_b - first_b + 1)[~single]
    of_a, of_b = spread(first_a[~single], count_a), spread(first_b[~single], count_b)
    cuts = np.sort(np.concatenate([ends_a[of_a], ends_b[of_b]]), kind="stable")  # two runs, which are merged
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    odd_a, odd_b = of_a[np.searchsorted(ends_a[of_a], cuts)], of_b[np.searchsorted(ends_b[of_b], cuts)]
    return np.concatenate([group_a[single], odd_a]), np.concatenate([group_b[single], odd_b])


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Tokens:
    """A worker's two tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.table_b = _Table()
        self.a, self.b = encoder(path_a, spaced_units), sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_a = {letter: byte for byte, letter in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * self.a.tokenizer.get_vocab_size()
        for token, number in vocabulary.items():
            self.bytes_a[number] = bytes(bytes_a[c] for c in token) if all(c in bytes_a for c in token) else token.encode()
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        names_a = [f"{k}{end}" for k in range(len(self.bytes_a)) for end in ",|"]
        names_b = [f"{k}{end}" for k in range(len(self.bytes_b)) for end in (",", ";", "")]
        self.names, self.base = pa.array(names_a + names_b, pa.string()), len(names_a)
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = pa.array(self.bytes_a, pa.binary()), pa.array(self.bytes_b, pa.binary())

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of A and of B for a space and each text, one text after another, and how many each text has of both. Both
        cut before a single space between two other characters, so each distinct stretch between such is encoded once."""
        parts = [part if at == 0 else part[1:] for text in texts for at, part in enumerate(slices(text))]
        per_text = [sum(1 for _ in slices(text)) if len(text) > SLICE else 1 for text in texts]
        numbers, counts, names = led_units(pa.array(parts, pa.string()))
        if len(self.a.table.index) > MOST:
            self.a.table = _Table()
        if len(self.a.parts.index) > 2 * MOST:
            self.a.parts = _Table()
        if len(self.table_b.index) > MOST:
            self.table_b = _Table()
        out = []
        ends = np.cumsum(counts)[np.cumsum(per_text) - 1]
        for table, learn in ((self.a.table, self.a._learn), (self.table_b, self._learn_b)):
            known, new = table.numbers(names)
            if new:
                learn(new)
            ids, sizes = table.gather(known[numbers])
            out += [ids.astype(np.int64), np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends], prepend=0)]
        return out[0], out[2], out[1], out[3]

    def _learn_b(self, new: list[str]) -> None:
        lists = self.b.encode([x[1:] for x in new], num_threads=1)  # B puts the space before by itself
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.table_b.add(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes)


def led_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As spaced_units, with a space before every text."""
    odd = pc.match_substring_regex(texts, f"^{WHITE}|{WHITE}$|{WHITE}{{2}}").to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts, " ")
    if odd.any():
        lists = pa.array([SAFE_CUT.split(x) if o else None for x, o in zip(texts.to_pylist(), odd)], pa.list_(pa.string()))
        parts = pc.if_else(pa.array(odd), lists, parts)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, [f" {x}" for x in coded.dictionary.to_pylist()]


def tokens(path_a: str, path_b: str, _made: dict = {}) -> Tokens:
    """The worker's tokenizers for two files."""
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Tokens(path_a, path_b)
    return _made[path_a, path_b]


@dataclass
class Aligned:
    """The alignment of some texts: ids of both tokenizers over all of them, how many each text has, each group's last A and B
    index, how many groups and links each text has, and each link's A and B index and text."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_links: np.ndarray
    link_text: np.ndarray


def align(texts: list[bytes], both: Tokens) -> Aligned:
    """The alignment of texts in UTF-8; a text whose tokens don't give its bytes back has none."""
    strings = [x.decode("utf-8", "replace") for x in texts]
    a, b, n_a, n_b = both.encode(strings)
    good = np.fromiter(map(bool, texts), bool, len(texts))
    for ids, counts, flat, sizes in ((a, n_a, both.flat_a, both.sizes_a), (b, n_b, both.flat_b, both.sizes_b)):
        joined = memoryview(flat.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(np.concatenate([[0], counts]))].tolist()
        for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
            good[k] &= j - i == len(texts[k]) + 1 and joined[i] == 32 and joined[i + 1 : j] == texts[k]
    if not good.all():
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
    ends_a, ends_b = np.cumsum(both.sizes_a[a]), np.cumsum(both.sizes_b[b])
    group_a, group_b = probe(ends_a, ends_b)
    link_a, link_b = links(ends_a, ends_b, group_a, group_b)
    text_of_a = np.repeat(np.arange(len(texts)), n_a)  # the last tokens of a text end together, so no group reaches beyond it
    n_groups, n_links = (np.bincount(text_of_a[x], minlength=len(texts)) for x in (group_a, link_a))
    return Aligned(a, b, n_a, n_b, group_a, group_b, n_groups, link_a, link_b, n_links, text_of_a[link_a])


def written_groups(got: Aligned, both: Tokens) -> Iterator[memoryview]:
    """For each text, its groups as `a1,a2|b1;a3|b2,b3`."""
    kind_a, kind_b = np.zeros(len(got.a), np.int64), np.zeros(len(got.b), np.int64)
    kind_a[got.group_a] = 1
    kind_b[got.group_b] = 1
    group_of_a, group_of_b = np.cumsum(kind_a) - kind_a, np.cumsum(kind_b) - kind_b
    before_b = np.concatenate([[0], got.group_b + 1])
    place_a, place_b = np.arange(len(got.a)) + before_b[group_of_a], np.arange(len(got.b)) + got.group_a[group_of_b] + 1
    kind_b[np.cumsum(got.n_b)[got.n_b > 0] - 1] = 2
    names = np.empty(len(got.a) + len(got.b), np.int32)
    names[place_a] = 2 * got.a + kind_a
    names[place_b] = both.base + 3 * got.b + kind_b
    shown = both.names.take(pa.array(names))
    offsets = np.frombuffer(shown.buffers()[1], np.int32, len(names) + 1) if len(names) else np.zeros(1, np.int32)
    at = offsets[np.cumsum(np.concatenate([[0], got.n_a + got.n_b]))].tolist()
    data = memoryview(shown.buffers()[2] or b"")
    for i, j in zip(at[:-1], at[1:]):
        yield data[i:j]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """The ids and texts of about GROUP bytes at a time."""
    ids, texts, size = [], [], 0
    for some in (batch.slice(at, 200) for batch in batches for at in range(0, batch.num_rows, 200)):
        for doc_id, text in zip(some.column(0).to_pylist(), utf8_rows(some.column(1))):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= GROUP or len(ids) >= 20_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_last, b_last): the ids of both, and for each group the index of its last A and B token."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens(path_a, path_b)
        for ids, texts in _slices(batches):
            got = align(texts, both)
            of = [np.cumsum(np.concatenate([[0], x])) for x in (got.n_a, got.n_b, got.n_groups)]
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x, pa.int32())) for o, x in ((of[0], got.a), (of[1], got.b), (of[2], got.group_a - np.repeat(of[0][:-1], got.n_groups)), (of[2], got.group_b - np.repeat(of[1][:-1], got.n_groups)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["doc_id", "a_ids", "b_ids", "a_last", "b_last"])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


def _aligned_slices(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One written row for each slice of documents: (slice, doc_id.., pairs, times, n_own, own, own_times), where own are a document's
    pairs as places in `pairs`."""
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_own"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens(path_a, path_b)
        for ids, texts in _slices(batches):
            got = align(texts, both)
            shas = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(written_groups(got, both), got.n_a)]
            place, pairs = pd.factorize(got.a[got.link_a] << PAIR | got.b[got.link_b])
            key, own_times = np.unique(got.link_text * max(1, len(pairs)) + place, return_counts=True)
            own, n_own = key % max(1, len(pairs)), np.bincount(key // max(1, len(pairs)), minlength=len(ids))
            steps = np.diff(own, prepend=0).astype("<i4")  # places rise within a document
            columns = [pa.array([x], pa.list_(pa.int64())) for x in (ids, got.n_a, got.n_b, got.n_groups, got.n_links, n_own, pairs, np.bincount(place, minlength=len(pairs)))]
            columns += [pa.array([shas], pa.list_(pa.string())), pa.array([steps.tobytes()], pa.binary()), pa.array([own_times.astype("<u4").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*numbers, "pairs", "times", "shas", "own", "own_times"])
            give_back()

    lists = ", ".join(f"{x} array<long>" for x in [*numbers, "pairs", "times"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(rows, f"{lists}, shas array<string>, own binary, own_times binary").withColumn("slice", F.monotonically_increasing_id()), "alignment")


def _asked(slices: DataFrame) -> DataFrame:
    """(slice, at, pair, times): each slice's distinct pairs."""
    return slices.select("slice", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select("slice", "at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def _counted(asked: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold a pair, and whether that is its B id's highest."""
    counts = asked.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << PAIR) - 1))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # a B id has at most as many pairs as A has ids
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a_id, b_id, count, best): a dictionary between the vocabularies, from all links of the corpus."""
    got = _counted(_asked(_aligned_slices(docs, path_a, path_b)))
    return got.select(F.shiftright("pair", PAIR).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << PAIR) - 1).cast("int").alias("b_id"), "count", "best")


def alignment_digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs."""
    slices = _aligned_slices(docs, path_a, path_b)
    asked = _asked(slices)
    answers = asked.join(_counted(asked), "pair").select(F.col("slice").alias("asker"), "at", "count", "best")

    def digests(row: pa.Table, answer: pa.Table) -> pa.Table:
        names = ["n_a", "n_b", "n_groups", "n_links"]
        if not row.num_rows:
            return pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in DIGESTS.split(", ")})
        at = answer.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = answer.column("count").to_numpy(), answer.column("best").to_numpy(zero_copy_only=False)
        lists = {c: row.column(c).combine_chunks().flatten() for c in ["doc_id", *names, "n_own", "shas"]}
        own_times = np.frombuffer(row.column("own_times")[0].as_py(), "<u4").astype(np.int64)
        own = np.cumsum(np.frombuffer(row.column("own")[0].as_py(), "<i4").astype(np.int64))
        ends = np.cumsum(np.concatenate([[0], lists["n_own"].to_numpy()]))
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        return pa.table({c: lists[c] for c in ["doc_id", *names]} | {"n_best": total(own_times * best[own]), "count_sum": total(own_times * count[own]), "groups_sha256": lists["shas"]})

    return slices.drop("pairs", "times").groupBy("slice").cogroup(answers.groupBy("asker")).applyInArrow(digests, DIGESTS)
