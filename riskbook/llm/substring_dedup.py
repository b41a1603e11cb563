"""Substring dedup: passages that later documents share with earlier ones, found by collinear chaining.

1. Seeds. Each four words in a row of a text are a seed. A passage of 50 words with 10 edits (similarity 0.8) has seven
   seeds unchanged at least, wherever the edits are. All words of all texts take part.
2. Links. Each occurrence of a seed is linked to its first one (by doc_id and place) and to the one in the document before
   its own, first within a batch and then over all: a seed costs an entry for each batch that has it, however often it
   occurs, and links grow with the occurrences only. Seeds and links are dealt out as packed columns.
3. Chains. In each later document, links that are in no 50 words with seven linked seeds, to whichever earlier documents,
   are put aside, and of the others those of an earlier document that has less than three in each 50 words. For each earlier
   document the rest are chained: ordered matches in both texts, weighted by length
   less a linear gap cost, by a Fenwick tree of prefix maxima. A chain goes if too few seeds in the 50 words around it can be in its
   earlier document at all, which lies outside of their first and last ones. The chains of a document are aligned longest first; one is
   left out only where spans that were reported already cover all links of the stretch around it.
4. Alignment. The stretches of both texts around a chain are cut out of the texts (with min_words words on both
   sides, however long these are) and aligned word by word along the chain: what lies between two anchors is aligned whole, and beyond the first
   and the last it goes on over small edits. Of the alignment, spans of min_words words or more, of which at least
   `similarity` match, are reported, longest first.

A seed's first occurrence may stand in a document that shares only a part; alignment extends to the whole of what the
two share, and the spans found against several documents add up.

Defined results. Null, empty and short texts: no row. Words are parted by ASCII white space and compared without A-Z
case. Copies inside one document are left alone. Repeated rows of a doc_id: one document. A null doc_id: the row is left out.
Empty table: no row. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_encoders, fresh, give_back, mix64, quoted, text_or_empty, utf8_rows, written

K, APART = 4, 30
LOW = (1 << 32) - 1  # a place is the number of the word, shifted by 32, and the byte where it begins
KEY_SHIFT = 16  # of a seed's 64 bits the high 48 are kept
LAST = (1 << 63) - 1
WIDTH = 6  # bytes of a usual word and its space
STEP = 16  # of a run of matches in a row, every so many words one becomes an anchor
NOT_FIRST, NOT_LAST = 1, 2  # a seed may also be in documents before the first, after the last that it is linked to
PACKED = "part long, kind int, n long, data binary"  # kind 0: seeds, 1: links
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], np.uint64)


def seeds_of(texts: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of texts, one for each K words: hash, the text's number, and place."""
    words, of, places = [], [], []
    for number, text in zip(numbers.tolist(), texts):
        mine = text.lower().split()
        if len(mine) < K:
            continue
        words += mine
        of.append(np.full(len(mine), number))
        places.append(np.arange(len(mine)) << 32 | word_begins(text))
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, place = np.concatenate(of), np.concatenate(places)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - K + 1
    seeds = np.zeros(n, np.uint64)
    for k in range(K):
        seeds += hashes[k : k + n] * MULTIPLIERS[k]
    inside = doc[:n] == doc[K - 1 :]
    return mix64(seeds)[inside], doc[:n][inside], place[:n][inside]


def word_begins(text: bytes) -> np.ndarray:
    """At which bytes the words of a text begin."""
    flat = np.frombuffer(text, np.uint8)
    white = (flat == 32) | (flat >= 9) & (flat <= 13)
    before = np.concatenate([[True], white[:-1]])
    return np.flatnonzero(~white & before)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as bytes: of each, its least value and then the differences to it, byte by byte, as many
    bytes as are needed, and these compressed. Columns of equal high bytes cost nothing. A rising column goes as steps from
    number to number."""
    out = []
    for x in columns:
        x = x.astype(np.int64)
        least, rising = (x.min(), bool((x[1:] >= x[:-1]).all())) if len(x) else (np.int64(0), False)
        rest = np.diff(x, prepend=x[:1]) if rising else x - least
        rest = rest.view(np.uint8).reshape(-1, 8)
        size = max((k + 1 for k in range(8) if rest[:, k].any()), default=0)
        out += [least.tobytes(), bytes([size | rising << 4]), rest[:, :size].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    out, at, data = [], 0, zstandard.ZstdDecompressor().decompress(data)
    for _ in range(columns):
        least, size, rising = np.frombuffer(data, np.int64, 1, at), data[at + 8] & 15, data[at + 8] >> 4
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :size] = np.frombuffer(data, np.uint8, n * size, at + 9).reshape(size, n).T
        numbers = rest.reshape(-1).view(np.int64)
        out.append((np.cumsum(numbers) if rising else numbers) + least)
        at += 9 + n * size
    return out


def offset(place: np.ndarray) -> np.ndarray:
    """A place's byte, less WIDTH for each word before: small numbers."""
    return (place & LOW) - WIDTH * (place >> 32)


def _dealt(part: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of PACKED: the columns, which are in order of part, a row for each part."""
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
    for i, j in zip(bounds[:-1], bounds[1:]):
        yield int(part[i]), kind, j - i, pack(*(x[i:j] for x in columns))


def _batches_of(rows: Iterator[tuple], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += len(row[3])
        if n > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "kind", "n", "data"])
            some, n = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "kind", "n", "data"])


def _linked(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of key and doc: which are the first of their key, and links (row, earlier row) of the others, to
    the first row and to the last one of an earlier document."""
    at = np.arange(len(key))
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    first = np.maximum.accumulate(np.where(new, at, 0))
    other = new | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(key)]
    begin = np.maximum.accumulate(np.where(other, at, 0))  # of the rows of this key and document
    before = np.maximum(begin - 1, 0)
    link = np.flatnonzero(begin > first)
    more = link[doc[before[link]] != doc[first[link]]]
    return new, np.concatenate([link, more]), np.concatenate([first[link], before[more]])


def _spread(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc.view(np.uint64)) % np.uint64(parts)).view(np.int64)


def _links_out(doc: np.ndarray, pos: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple]:
    part = _spread(doc, parts)
    order = np.lexsort((pos, doc, part))
    yield from _dealt(part[order], 1, *(x[order] for x in (doc, pos >> 32, offset(pos), ref, ref_pos & LOW, n)))


def _local_links(parts: int, batch_bytes: int):
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first occurrence in the batch of each seed, and the links of the others."""
        forget_encoders()
        for batch in batches:
            # so many rows at once that working memory stays small
            ids, sizes = batch.column(0).to_numpy(zero_copy_only=False), pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // batch_bytes)) + 1):
                yield from _batches_of(rows(ids[some], utf8_rows(batch.column(1).take(pa.array(some)))))
                give_back()

    def rows(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
        got, some, size = [], [], 0
        for k in range(len(ids)):
            if k and ids[k] == ids[k - 1] and texts[k] == texts[k - 1]:
                continue
            some.append(k)
            size += len(texts[k])
            if size > 1 << 20:
                got.append(seeds_of([texts[i] for i in some], ids[some]))
                some, size = [], 0
        if some:
            got.append(seeds_of([texts[i] for i in some], ids[some]))
        if not got:
            return
        seed, doc, pos = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.argsort(seed, kind="stable")  # doc and pos are in order already
        seed, doc, pos = seed[order], doc[order], pos[order]
        # a seed that a text repeats within APART words (periodic text) counts for all of them; alignment goes over the rest
        once = np.ones(len(seed), bool)
        once[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]) | ((pos[1:] >> 32) // APART != (pos[:-1] >> 32) // APART)
        times = np.diff(np.append(np.flatnonzero(once), len(seed)))
        seed, doc, pos = seed[once], doc[once], pos[once]
        new, a, b = _linked(seed, doc)
        more = np.zeros(len(seed), np.int64)
        more[b] = NOT_LAST
        # a seed's number of times, and what is known of its other documents
        seed_part = ((seed >> np.uint64(32)).astype(np.int64) * parts) >> 32
        yield from _dealt(seed_part[new], 0, *((x[new]) for x in ((seed >> np.uint64(KEY_SHIFT)).view(np.int64), doc, pos >> 32, offset(pos), times * 4 + more)))
        yield from _links_out(doc[a], pos[a], doc[b], pos[b], times[a] * 4 + NOT_FIRST + NOT_LAST, parts)

    return local


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The rows of each part, from rows sorted by part."""
    last, rows = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if part != last and rows:
                yield last, rows
                rows = []
            last = part
            rows.append(tuple(row))
    if rows:
        yield last, rows


def _joined(rows: list[tuple[int, int, bytes]], columns: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(data, n, columns) for _, n, data in rows))] if rows else [np.zeros(0, np.int64)] * columns


def _global_links(parts: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches_of(rows(batches))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """From the batches' first occurrences: the links between them."""
        held, size = [], 0
        for part, some in _grouped(batches):
            key, doc, word, byte, n = _joined(some, 5)
            byte += WIDTH * word
            order = np.lexsort((word, doc, key))
            key, doc, pos, n = key[order], doc[order], word[order] << 32 | byte[order], n[order]
            new, a, b = _linked(key, doc)
            if len(key):
                repeated = np.maximum.reduceat(n & NOT_LAST, np.flatnonzero(new))[np.cumsum(new) - 1]
                n |= repeated
            held.append([doc[a], pos[a], doc[b], pos[b], n[a]])
            size += len(a)
            if size > 1 << 19:
                yield from _links_out(*(np.concatenate(x) for x in zip(*held)), parts)
                held, size = [], 0
        if held:
            yield from _links_out(*(np.concatenate(x) for x in zip(*held)), parts)

    return links


def chain(places: np.ndarray, others: np.ndarray, weight: float = 30.0, gap: float = 0.05) -> list[list[int]]:
    """Collinear chains of matches, best first; each match is in one chain. Places and gaps are in bytes; `gap` is the cost of a
    byte in a text of usual words, and less where words are longer.

    The best chain that ends in match i comes after a match j with smaller places in both texts:
    score(i) = weight + max(0, max over j of score(j) - gap * (distance in one text + distance in the other)).
    """
    n = len(places)
    order = np.lexsort((others, places)).tolist()
    rank = (np.unique(others, return_inverse=True)[1] + 1).tolist()
    p, o = places.tolist(), others.tolist()
    size = max(rank) if rank else 0
    tree = [(-1e300, -1)] * (size + 1)  # prefix maxima of score + gap * (place + other place)
    score, before = [0.0] * n, [-1] * n
    at = 0
    while at < n:
        until = at
        while until < n and p[order[until]] == p[order[at]]:  # matches at one place don't follow each other
            until += 1
        for i in order[at:until]:
            best, k = (-1e300, -1), rank[i] - 1
            while k > 0:
                if tree[k] > best:
                    best = tree[k]
                k -= k & -k
            value = best[0] - gap * (p[i] + o[i])
            score[i] = weight
            if value > 0:
                score[i], before[i] = weight + value, best[1]
        for i in order[at:until]:
            entry, k = (score[i] + gap * (p[i] + o[i]), i), rank[i]
            while k <= size:
                if entry > tree[k]:
                    tree[k] = entry
                k += k & -k
        at = until
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], p[i], o[i])):
        one = []
        while i >= 0 and not used[i]:
            used[i] = True
            one.append(i)
            i = before[i]
        if one:
            chains.append(one[::-1])
    return chains


def _chains(min_words: int, similarity: float):
    schema = pa.schema([("doc", pa.int64()), ("rank", pa.int64()), ("ref", pa.int64()), ("d", pa.list_(pa.int64())), ("r", pa.list_(pa.int64())), ("begin", pa.int64()), ("end", pa.int64())])
    # A passage of min_words words with as few edits as similarity asks for has so many runs of K words in common.
    least = max(1, min_words - K + 1 - K * int(min_words * (1 - similarity) + 1e-9))
    own = min(least, K - 1)  # of these, so many must be linked to the earlier document itself: one that is hidden behind
    # another with a break in the passage has the seeds across the break to itself

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From packed links sorted by part: the chains of each document with each earlier one, best first, each with the
        bytes from the first to the last link around it."""
        for _, rows in _grouped(batches):
            out = list(of(*_joined(rows, 6)))
            for at in range(0, len(out), 5000):
                yield pa.RecordBatch.from_pylist(out[at : at + 5000], schema=schema)

    def of(doc, word, byte, ref, ref_byte, n) -> Iterator[dict]:
        byte, order = byte + WIDTH * word, np.lexsort((word, doc))
        doc, word, byte, ref, ref_byte, n = (x[order] for x in (doc, word, byte, ref, ref_byte, n))
        if not len(doc):
            return
        number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        at = number << 33 | word

        def counts(places: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """How many seeds the min_words words from each place on have, and where these end in places."""
            total, until = np.concatenate([[0], np.cumsum(times)]), np.searchsorted(places, places + min_words - K + 1)
            return total[until] - total[: len(places)], until

        # places in min_words words that have enough seeds, with whichever documents; a place counts once
        place = np.concatenate([[True], np.diff(at) > 0])
        count, until = counts(at[place], n[place] >> 2)
        enough = np.flatnonzero(count >= least)
        change = np.zeros(len(count) + 1, np.int64)
        np.add.at(change, enough, 1)
        np.add.at(change, until[enough], -1)
        use = np.flatnonzero((np.cumsum(change)[:-1] > 0)[np.cumsum(place) - 1])
        if not len(use):
            return
        number, at, doc, word, byte, ref, ref_byte, n = (x[use] for x in (number, at, doc, word, byte, ref, ref_byte, n))
        # stretches of these without gaps of over min_words
        new = np.concatenate([[True], np.diff(at) > min_words])
        begins, stretch = np.flatnonzero(new), np.cumsum(new) - 1
        first, last = byte[begins], byte[np.append(begins[1:], len(at)) - 1]
        # the documents that a place's seed may be in too
        heads = np.flatnonzero(np.concatenate([[True], np.diff(at) > 0]))
        low, high = np.minimum.reduceat(np.where(n & NOT_FIRST, -1 << 63, ref), heads), np.maximum.reduceat(np.where(n & NOT_LAST, LAST, ref), heads)
        times, head_at = n[heads] >> 2, at[heads]
        order = np.lexsort((ref_byte, byte, ref, number))
        doc, byte, ref, ref_byte, stretch, at, number, n = (x[order] for x in (doc, byte, ref, ref_byte, stretch, at, number, n))
        # min_words words of a pair have so many links of its own at least
        pair = np.cumsum(np.concatenate([[0], (np.diff(number) != 0) | (np.diff(ref) != 0)]))
        place = pair << 33 | at & (1 << 33) - 1
        fresh = np.concatenate([[True], np.diff(place) > 0])  # a place counts once
        count, until = counts(place[fresh], n[fresh] >> 2)
        change = np.zeros(len(count) + 1, np.int64)
        enough = np.flatnonzero(count >= own)
        np.add.at(change, enough, 1)
        np.add.at(change, until[enough], -1)
        use = (np.cumsum(change)[:-1] > 0)[np.cumsum(fresh) - 1]
        doc, byte, ref, ref_byte, stretch, at, n = (x[use] for x in (doc, byte, ref, ref_byte, stretch, at, n))
        if not len(doc):
            return
        # Of matches in a row along one diagonal, some are enough: the first, the last, and one every STEP words or so.
        same = (np.diff(doc) == 0) & (np.diff(ref) == 0) & (np.diff(byte) == np.diff(ref_byte)) & (np.diff(at) <= K)
        inner = np.concatenate([[False], same]) & np.concatenate([same, [False]])
        inner[1:] &= byte[1:] // (STEP * 7) == byte[:-1] // (STEP * 7)
        heavy = np.add.reduceat(n >> 2, np.flatnonzero(~inner))  # how many links each anchor stands for
        doc, byte, ref, ref_byte, stretch, at = (x[~inner] for x in (doc, byte, ref, ref_byte, stretch, at))

        def possible(begin: int, end: int, other: int) -> bool:
            """Whether the min_words words around a chain can have the seeds of a passage with the other document."""
            i, j = np.searchsorted(head_at, (begin - min_words, end + min_words))
            fits = np.flatnonzero((low[i:j] <= other) & (other <= high[i:j])) + i
            return times[fits].sum() >= least and counts(head_at[fits], times[fits])[0].max() >= least

        cut = np.flatnonzero(np.diff(doc)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)]):
            split = np.flatnonzero(np.diff(ref[i:j])) + 1 + i
            found = []
            # bytes of a word in these stretches of the document
            steps = at[i + 1 : j] - at[i : j - 1]
            near = (steps > 0) & (steps <= min_words)
            width = (byte[i + 1 : j] - byte[i : j - 1])[near].sum() / max(1, steps[near].sum())
            gap = 0.05 * WIDTH / max(WIDTH, width)
            for k, m in zip([i, *split.tolist()], [*split.tolist(), j]):
                found += [[k + x for x in one] for one in (chain(byte[k:m], ref_byte[k:m], gap=gap) if m - k > 1 else [[0]])]
            found = [one for one in found if heavy[one].sum() >= own]
            found.sort(key=lambda one: (-len(one), one[0]))
            found = [one for one in found if possible(int(at[one[0]]), int(at[one[-1]]), int(ref[one[0]]))]
            for rank, one in enumerate(found):
                yield {"doc": int(doc[i]), "rank": rank, "ref": int(ref[one[0]]), "d": byte[one].tolist(), "r": ref_byte[one].tolist(), "begin": int(first[stretch[one[0]]]), "end": int(last[stretch[one[-1]]])}

    return chains


def hop(a: list, b: list, i: int, j: int, step: int) -> tuple[int, int] | None:
    """From a mismatch at a[i], b[j], going by step: the nearest places, up to eight on, from which three words match; or
    up to three on, two words; or one on, one word."""

    def grams(words: list, at: int, size: int, reach: int) -> list:
        most = min(reach, (len(words) - size - at) if step > 0 else at - size + 1)
        return [tuple(words[k + step * m] for m in range(size)) for k in range(at, at + step * (most + 1), step)] if most >= 0 else []

    for size, reach in ((3, 8), (2, 3), (1, 1)):
        first: dict = {}
        for y, gram in enumerate(grams(b, j, size, reach)):
            first.setdefault(gram, y)
        found = [(x + first[gram], abs(x - first[gram]), x) for x, gram in enumerate(grams(a, i, size, reach)) if gram in first]
        if found:
            total, _, x = min(found)
            return i + step * x, j + step * (total - x)
    return None


def extend(a: list, b: list, i: int, j: int, step: int, similarity: float) -> list[tuple[int, int, int]]:
    """Aligns from a[i], b[j] on by step: the runs of words that match (first in a, first in b, number), in page order."""
    p, q, matches, runs = i, j, 0, []
    while True:
        n = 0
        while 0 <= p < len(a) and 0 <= q < len(b) and a[p] == b[q]:
            p, q, n = p + step, q + step, n + 1
        matches += n
        if n:
            runs.append((p - n, q - n, n) if step > 0 else (p + 1, q + 1, n))
        to = hop(a, b, p, q, step) if matches >= (similarity - 0.1) * max(abs(p - i), abs(q - j)) - 4 else None
        if not to:
            return runs[::step]
        p, q = to


def common(a: list, b: list, i: int, j: int) -> list[tuple[int, int, int]]:
    """Runs of words that match in order, of two short lists that begin at i and j: a longest common subsequence where
    the table is small, else the longest common stretch first, then to both sides of it."""
    if not a or not b:
        return []
    if len(a) * len(b) > 2500:
        return [(i + x.a, j + x.b, x.size) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    if not set(a) & set(b):
        return []
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for x in range(len(a) - 1, -1, -1):
        for y in range(len(b) - 1, -1, -1):
            best[x][y] = best[x + 1][y + 1] + 1 if a[x] == b[y] else max(best[x + 1][y], best[x][y + 1])
    x = y = 0
    out = []
    while x < len(a) and y < len(b):
        if a[x] == b[y]:
            out.append((i + x, j + y, 1))
            x, y = x + 1, y + 1
        elif best[x + 1][y] >= best[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def aligned(a: list, b: list, anchors: list[tuple[int, int]], similarity: float) -> list[tuple[int, int, int]]:
    """The runs of words that match (first in a, first in b, number) of the alignment along a chain of anchors."""
    runs: list[tuple[int, int, int]] = []
    for i, j in anchors:
        p, q = (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]) if runs else (0, 0)
        late = max(p - i, q - j, 0)
        i, j, n = i + late, j + late, 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if n == 0 or n + late < K and not late:
            continue  # inside the run before, or no match of K words
        if runs:
            x, y = i - p, j - q
            if x * y <= 1 << 18:
                runs += common(a[p:i], b[q:j], p, q)
            else:  # too much to compare whole: from both sides, which must not cross
                right = extend(a[:i], b[:j], p, q, 1, similarity)
                p, q = (right[-1][0] + right[-1][2], right[-1][1] + right[-1][2]) if right else (p, q)
                left = extend(a[p:i], b[q:j], x - 1 - (p - i + x), y - 1 - (q - j + y), -1, similarity)
                runs += right + [(p + k, q + m, size) for k, m, size in left]
        runs.append((i, j, n))
    if not runs:
        return []
    i, j, _ = runs[0]
    p, q = runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]
    return extend(a, b, i - 1, j - 1, -1, similarity) + runs + extend(a, b, p, q, 1, similarity)


def spans_of(runs: list[tuple[int, int, int]], min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """The longest span of the alignment that has min_words words or more and `similarity`, then those on both sides."""
    out, parts = [], [np.array(runs, np.int64).reshape(-1, 3)]
    while parts:
        r = parts.pop()
        if not len(r) or r[-1, 0] + r[-1, 2] - r[0, 0] < min_words:
            continue
        until, upto, matches = r[:, 0] + r[:, 2], r[:, 1] + r[:, 2], np.cumsum(r[:, 2])
        best = (0, 0, 0)
        for k in range(len(r)):  # a longest span begins and ends with whole runs
            if until[-1] - r[k, 0] <= max(best[0], min_words - 1):
                break
            fits = np.flatnonzero(matches[k:] - matches[k] + r[k, 2] >= similarity * np.maximum(until[k:] - r[k, 0], upto[k:] - r[k, 1]) - 1e-9)
            if len(fits) and until[k + fits[-1]] - r[k, 0] > best[0]:
                best = (int(until[k + fits[-1]] - r[k, 0]), k, k + int(fits[-1]))
        size, k, m = best
        if size < min_words:
            continue
        out.append((int(r[k, 0]), int(until[m]), int(r[k, 1]), int(upto[m]), int(matches[m] - matches[k] + r[k, 2])))
        parts += [r[:k], r[m + 1 :]]
    return sorted(out)


def align(a: list, b: list, anchors: list[tuple[int, int]], min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Spans (begin and end in a, begin and end in b, matches) of two word lists along a chain of anchors, where K words
    match. Length and similarity are those of a whole span, so a gap of any size inside a chain may be bridged."""
    return spans_of(aligned(a, b, anchors, similarity), min_words, similarity)


def inside(begin: int, end: int, spans: list[tuple[int, int]]) -> bool:
    """Whether all from begin to end is in the spans together."""
    for i, j in sorted(spans):
        if i > begin:
            return False
        begin = max(begin, j + 1)  # spans that touch have white space between them
        if begin > end:
            return True
    return False


def _passing(step):
    """step over the rows of kind 0; the others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def seeds() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mine = np.equal(batch.column(1).to_numpy(), 0)
                passed.append(batch.filter(pa.array(~mine)))
                yield batch.filter(pa.array(mine))

        for out in step(seeds()):
            yield out
            yield from passed
            passed.clear()
        yield from passed

    return run


#: Bytes a word that a window is tried with, one after another; beyond the last the window goes to the end of the text.
ROOMS = (8, 12, 24, 48, 192)


def _has_words(first: str, size: str, n: int) -> str:
    """Whether a stretch of t parts more than n words: by its single spaces, or where there are others, by all white space."""
    part = f"cast(substring(t, int({first}) + 1, int({size})) as string)"
    spaces = f"(instr({part}, '  ') = 0 AND length({part}) - length(replace({part}, ' ', '')) > {n})"
    return rf"({spaces} OR regexp_count({part}, '[ \\t\\n\\x0b\\f\\r]+') > {n})"


def window_begin(min_words: int) -> Column:
    """The byte from which on a window has min_words words or more before column `low` in t, or 0."""
    tries = "0"
    for room in reversed([x * min_words for x in ROOMS]):
        tries = f"CASE WHEN low <= {room} THEN 0 WHEN {_has_words(f'low - {room}', str(room), min_words)} THEN low - {room} ELSE {tries} END"
    return F.expr(f"bigint({tries})")


def window_end(min_words: int) -> Column:
    """The byte up to which a window has K + min_words words or more from column `high` in t on, or the end."""
    tries = "length(t)"
    for room in reversed([x * (min_words + K) for x in ROOMS]):
        tries = f"CASE WHEN high + {room} >= length(t) THEN length(t) WHEN {_has_words('high', str(room), min_words + K)} THEN high + {room} ELSE {tries} END"
    return F.expr(f"bigint({tries})")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def duplicate_spans(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, batch_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, ref_doc_id, start, end (bytes of the UTF-8 text), ref_start, ref_end, n_words, similarity: the spans of
    documents that an earlier document (smaller doc_id) has too."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("t"))
    deal = docs.rdd.getNumPartitions()
    parts = min(1 << 14, 16 * deal)
    dealt = texts.mapInArrow(_local_links(parts, batch_bytes), PACKED).repartition(2 * deal, "part").sortWithinPartitions("part")
    # the local links pass by the step that links the batches' first occurrences
    links = dealt.mapInArrow(_passing(_global_links(parts)), PACKED).repartition(2 * deal, "part").sortWithinPartitions("part")
    with shuffles_removed(docs.sparkSession):  # seeds and links are off the disks before texts are dealt out
        chains = written(links.mapInArrow(_chains(min_words, similarity), "doc long, rank long, ref long, d array<long>, r array<long>, begin long, end long"), "chains")

    def side(name: str, id_: str, places: str):
        return F.struct(F.lit(name).alias("side"), F.col(id_).alias("id"), F.col(places).alias("places"), F.array_min(places).alias("low"), F.array_max(places).alias("high"))

    # each text is dealt out once, to all windows that are cut from it
    wanted = chains.select("doc", "rank", "ref", "begin", "end", F.explode(F.array(side("d", "doc", "d"), side("r", "ref", "r"))).alias("w")).select("doc", "rank", "ref", "begin", "end", "w.*")
    cut = F.expr("substring(t, int(`from`) + 1, int(`to` - `from`))")
    both = wanted.join(texts, F.col("id") == F.col("doc_id")).withColumns({"from": window_begin(min_words), "to": window_end(min_words)})
    both = both.select("doc", "rank", "side", "ref", "begin", "end", "places", "from", cut.alias("words"), (F.length("t") > F.col("to")).alias("more"))
    both = both.repartition("doc").sortWithinPartitions("doc", "rank", "side")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The windows of both sides of each chain; of rows that are repeated, one."""
        mine = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for x in batch.slice(at, 500).to_pylist():
                    if x["side"] == "d":
                        mine = x
                    elif mine and (mine["doc"], mine["rank"]) == (x["doc"], x["rank"]):
                        yield {"doc": x["doc"], "ref": x["ref"], "begin": x["begin"], "end": x["end"], "d": mine["places"], "r": x["places"], "d_from": mine["from"], "r_from": x["from"], "dw": mine["words"], "rw": x["words"], "d_more": mine["more"], "r_more": x["more"]}
                        mine = None

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        last, reported, of_pair, out = None, [], {}, []
        for x in pairs(batches):
            if x["doc"] != last:
                last, reported, of_pair = x["doc"], [], {}
            mine = of_pair.setdefault(x["ref"], [])
            # nothing that any document shares here is outside the spans reported already
            if inside(x["begin"], x["end"], reported):
                continue
            # so many words must match at least
            d_words, r_words = x["dw"].lower().split(), x["rw"].lower().split()
            if sum(map(set(r_words).__contains__, d_words)) < similarity * min_words:
                continue
            sides = []
            for text, words, first, more in ((x["dw"], d_words, x["d_from"], x["d_more"]), (x["rw"], r_words, x["r_from"], x["r_more"])):
                begins = word_begins(text)
                # words that the window cuts are left out
                skip = 1 if first and len(words) and begins[0] == 0 else 0
                stop = len(words) - (1 if more and len(words) and not text[-1:].isspace() else 0)
                sides.append((words[skip:stop], begins[skip:stop] + first, np.fromiter(map(len, words[skip:stop]), np.int64, max(0, stop - skip))))
            (a, a_at, a_len), (b, b_at, b_len) = sides
            where = [{p: k for k, p in enumerate(y.tolist())} for y in (a_at, b_at)]
            anchors = [(where[0][p], where[1][q]) for p, q in zip(x["d"], x["r"]) if p in where[0] and q in where[1]]
            for i, j, k, n, matches in align(a, b, anchors, min_words, similarity):
                span = int(a_at[i]), int(a_at[j - 1] + a_len[j - 1])
                if inside(*span, mine):  # periodic texts align in many ways; what the pair's spans cover says nothing new
                    continue
                reported.append(span)
                mine.append(span)
                out.append((x["doc"], x["ref"], *span, int(b_at[k]), int(b_at[n - 1] + b_len[n - 1]), j - i, round(matches / max(j - i, n - k), 4)))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    names = ["doc_id", "ref_doc_id", "start", "end", "ref_start", "ref_end", "n_words", "similarity"]
    return both.mapInArrow(spans, "doc_id long, ref_doc_id long, start long, end long, ref_start long, ref_end long, n_words long, similarity double").distinct()


def cut_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, batch_bytes: int = 1 << 23) -> DataFrame:
    """docs with the spans that an earlier document has too cut out of their texts; a document of which nothing is left
    goes. n_chars, where docs has it, is counted anew. Every passage stays where it stands first.

    Defined results: those of duplicate_spans. Rows of one doc_id are one document only if their texts are equal; of rows with
    different texts, and of rows with a null doc_id, none is changed. Null and empty texts stay as they are. All columns of
    docs come out, whatever their names, and no other.
    """
    name = fresh(docs, "spans")
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct(F.sha2(text_or_empty(), 256)).alias("texts"))
    several = written(ids.where("texts > 1").select(F.col("doc_id").cast("long").alias("doc_id")), "several")
    spans = written(duplicate_spans(docs.join(several, "doc_id", "left_anti"), min_words, similarity, batch_bytes), "spans")
    by_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(name))  # no more than the text has words

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            if cuts is not None:
                flat, kept, at = text.encode("utf-8"), [], 0
                for x in cuts:
                    if x["start"] > at:
                        kept.append(flat[at : x["start"]])
                    at = max(at, x["end"])
                kept.append(flat[at:])
                text = b"".join(kept).decode("utf-8").strip()
            out.append(text)
        return pd.Series(out)

    joined = docs.join(by_doc, "doc_id", "left").select(*map(quoted, docs.columns), name)
    out = joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(without("text", name))).where(F.col(name).isNull() | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")).cast(docs.schema["n_chars"].dataType))
    return out.select(*map(quoted, docs.columns))
