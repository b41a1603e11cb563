"""Periodic runs of words, found by recursive frequency splitting and a scan of what survives.

A run is a stretch of consecutive words of smallest period q that is at least max(least, 2q) long and that no neighbour
extends. Each of its words stands in it twice or more. So a word that stands only once in its segment is in no run: it
splits the segment. This goes on in the parts until nothing splits; parts shorter than `least` are dropped. A word's
neighbours of the same spelling tell whether it is alone, and after a split only the smaller parts and their words'
neighbours are looked at again, so the work is n log n for any text. The segments that are left are scanned lag by lag:
words q apart are compared at places so dense that no run of period q can lie between them, and what agrees is followed to
both ends. A stretch with the extent of a run of smaller period is that run.

Defined results. Null, empty and blank texts: no words, no run. Repeated rows and null ids: a row each. Empty table: no row.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, utf8_rows

GROUP = 1 << 22  # bytes of texts that are split together
LEAST = 12


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, one text after another, and how many each text has."""
    numbers: dict[bytes, int] = {}
    add = numbers.setdefault
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.fromiter((add(w, len(numbers)) for words in texts for w in words), np.int64, int(counts.sum())), counts


def neighbours(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the word of the same spelling before and behind each, in its text: -1 and len(codes) if none."""
    n = len(codes)
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(text * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    same = (codes[order[1:]] == codes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    before, behind = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    behind[order[:-1][same]] = order[1:][same]
    return before, behind


def surviving(codes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The segments (from, to) in which each word stands twice or more, in order; texts are `counts` words long."""
    before, behind = neighbours(codes, counts)
    ends = np.cumsum(counts)
    low, high = ends - counts, ends.copy()  # of each segment, by its number
    high[counts < least] = low[counts < least]
    of = np.repeat(np.arange(len(counts)), counts)  # the segment of each word; parts that are dropped have -1
    of[np.repeat(counts < least, counts)] = -1
    look = np.flatnonzero(of >= 0)
    while len(look):
        mine = of[look]
        cuts = np.sort(look[(before[look] < low[mine]) & (behind[look] >= high[mine])])
        if not len(cuts):
            break
        whose = of[cuts]
        first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))  # a segment's cuts stand together
        segments = whose[first]
        # the parts of each segment lie between its low end, its cuts and its high end
        begins = np.insert(cuts + 1, first, low[segments])
        lasts = np.insert(cuts, np.append(first[1:], len(cuts)), high[segments])
        parent = np.insert(whose, first, segments)
        sizes = lasts - begins
        order = np.lexsort((-sizes, parent))
        largest = order[np.concatenate([[True], parent[order][1:] != parent[order][:-1]])]  # keeps the segment's number
        keeps = sizes[largest] >= least
        low[parent[largest]], high[parent[largest]] = begins[largest], np.where(keeps, lasts[largest], begins[largest])
        small = np.ones(len(sizes), bool)
        small[largest] = False
        fresh = small & (sizes >= least)
        new = len(low) + np.cumsum(fresh) - 1
        low, high = np.concatenate([low, begins[fresh]]), np.concatenate([high, lasts[fresh]])
        places = _spread(begins[small], sizes[small])
        of[cuts] = -1
        of[places] = np.repeat(np.where(fresh, new, -1)[small], sizes[small])
        gone = np.concatenate([places, cuts])
        near = np.concatenate([places, before[gone], behind[gone]])
        near = near[(near >= 0) & (near < len(of))]
        near = near[of[near] >= 0]
        # a segment whose largest part is dropped has no words left, and its words no segment
        near = near[(near >= low[of[near]]) & (near < high[of[near]])]
        look = np.unique(near)
    whole = high - low >= least
    return sorted(zip(low[whole].tolist(), high[whole].tolist()))


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _agree(codes: np.ndarray, x: int, y: int, most: int, step: int) -> int:
    """How many words from x and from y on agree, at most `most`; step -1 goes to the left."""
    done, block = 0, 32
    while done < most:
        some = min(block, most - done)
        a, b = (codes[z + done : z + done + some] if step > 0 else codes[z - done - some + 1 : z - done + 1][::-1] for z in (x, y))
        differ = np.flatnonzero(a != b)
        if len(differ):
            return done + int(differ[0])
        done += some
        block *= 2
    return done


def scan(codes: np.ndarray, segments: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of the segments, ordered by start, then period."""
    if not segments:
        return []
    begins, lasts = (np.array(x, np.int64) for x in zip(*segments))
    sizes = lasts - begins
    order = np.argsort(-sizes, kind="stable")  # long segments first: those that have room for a lag are the first ones
    begins, lasts, sizes = begins[order], lasts[order], sizes[order]
    # words are compared four at a time where runs leave room for that: equal numbers are equal stretches of four
    some, four = (4, codes.copy()) if least >= 7 else (1, codes)
    for width in (1, 2) if some == 4 else ():
        pairs = four[: len(four) - width] * (int(four.max()) + 1) + four[width:]
        four = np.unique(pairs, return_inverse=True)[1].reshape(-1)
    runs, known = [], set()
    until, period = np.zeros(len(codes), np.int64), np.ones(len(codes), np.int64)  # of the run of a place that reaches farthest
    room = len(sizes)
    for q in range(1, int(sizes[0]) // 2 + 1):
        while room and sizes[room - 1] < max(least, 2 * q):
            room -= 1
        if not room:
            break
        # a run's words agree with those q behind over max(q, least - q) places, and so over all but three of these by fours
        stride = max(1, max(q, least - q) - some + 1)
        last = lasts[:room] - q - some + 1
        tries = np.maximum(0, -((begins[:room] - last) // stride))
        at = np.repeat(begins[:room], tries) + (np.arange(int(tries.sum())) - np.repeat(np.cumsum(tries) - tries, tries)) * stride
        at = at[four[at] == four[at + q]]
        if not len(at):
            continue
        at = at[~((at + q < until[at]) & (q % period[at] == 0))]  # inside a run of a period that q is a multiple of
        done = -1
        for x in np.sort(at).tolist():
            if x < done:
                continue
            k = int(np.flatnonzero((begins[:room] <= x) & (x < lasts[:room]))[0])
            left = _agree(codes, x - 1, x - 1 + q, x - int(begins[k]), -1)
            right = _agree(codes, x, x + q, int(lasts[k]) - q - x, 1)
            done = x + right
            start, end = x - left, x + right + q
            if end - start >= max(least, 2 * q) and (start, end) not in known:
                known.add((start, end))
                runs.append((start, end - start, q))
                mine = slice(start, end)
                farther = until[mine] < end
                until[mine] = np.where(farther, end, until[mine])
                period[mine] = np.where(farther, q, period[mine])
    return sorted(runs, key=lambda x: (x[0], x[2]))


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text, given as words, its runs (start, length, period)."""
    codes, counts = coded(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum(counts)
    segments = surviving(codes, counts, least) if len(codes) else []
    texts_of = np.searchsorted(ends, [x for x, _ in segments], side="right").tolist()
    by_text: dict[int, list[tuple[int, int]]] = {}
    for k, segment in zip(texts_of, segments):
        by_text.setdefault(k, []).append(segment)
    for k, mine in by_text.items():
        low = int(ends[k] - counts[k])
        local = np.unique(codes[low : ends[k]], return_inverse=True)[1].reshape(-1)
        out[k] = scan(local, [(a - low, b - low) for a, b in mine], least)
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run has after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, for one document id in ten (by its checksum) with a periodic tail from a place on that the checksum says."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    tail = words[at : at + period]
    return words[:at] + (tail * ((n - at) // period + 1))[: n - at]


def _found(docs: DataFrame, schema: str, row: Callable, change: Callable | None, least: int) -> DataFrame:
    """row(words, runs) of each document, by mapInArrow over groups of documents."""
    names = [x.split()[0] for x in schema.split(", ")][1:]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    kinds = [kinds[x.split()[1]] for x in schema.split(", ")][1:]

    def result(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = [row(words, runs) for words, runs in zip(texts, runs_of(texts, least))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1))):
                words = text.split()  # of bytes: at \x20 and \x09-\x0d
                ids.append(doc_id)
                texts.append(change(doc_id, words) if change else words)
                size += len(text)
                if size >= GROUP:
                    yield result(ids, texts)
                    ids, texts, size = [], [], 0
                    give_back()
        if ids:
            yield result(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(found, schema)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, starts, lengths, periods (of all runs, by start, then period) and collapsed, the text without repetitions."""

    def row(words, runs):
        return *([x[k] for x in runs] for k in range(3)), b" ".join(collapsed(words, runs)).decode("utf-8", "replace")

    return _found(docs, "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed string", row, None, least)


def run_digests(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = planted, least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256."""

    def row(words, runs):
        start, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        return len(runs), start, length, q, 1000 * length // q if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    return _found(docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", row, change, least)
