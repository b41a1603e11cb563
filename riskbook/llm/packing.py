"""Packing of documents into sequences by cutting-stock column generation.

Every document is tokenised once and cut into pieces: full sequences, and one rest. The rests are the stock to be cut:
only their length histogram (as many numbers as a sequence has tokens) goes to the driver. There a linear program picks
how often to use each pattern, a multiset of lengths that fits a sequence; a knapsack by dynamic programming prices new
columns until none improves it. The solution is rounded down. Pieces are ranked within their length, and the rank alone
tells a piece's pattern, copy and place by arithmetic, in parallel.

A sequence whose length is a power of two needs no padding, so patterns may end there. Rests that no full pattern takes
(what rounding leaves, and patterns that would need padding) are cut at powers of two; laid out by falling size these
parts fill sequences without a gap, again by arithmetic on ranks.

Defined results. Null or empty text: the end id alone. Repeated rows of a doc_id: each is packed; their pieces have the
same start. A null doc_id: packed as any other. Empty table: no row. Very long texts: many full sequences and a rest.
Strings of special tokens in a text are plain text (the library would by default take them for the tokens). Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_task, text_or_empty, written
from .units import encoder, spaced_units

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, local_rank long, part_crcs array<long>"


def padded(length: int, capacity: int) -> int:
    """The tokens that a sequence of some length takes."""
    return length if length & (length - 1) == 0 else capacity


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each exact total, the best sum of values, and the item that comes last in it (-1: none)."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0.0
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        if n:
            got = values[:n] + best[c - lengths[:n]]
            k = int(got.argmax())
            if got[k] > -np.inf:
                best[c], last[c] = got[k], k
    return best, last


def first_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: patterns of one to three different lengths that fill a sequence, each used until one of its lengths is gone."""
    m, rest = len(lengths), demand.astype(float).copy()
    at = np.full(capacity + 1, -1)
    at[lengths] = np.arange(m)
    alive = rest > 0
    columns, used = np.zeros((m, m)), np.zeros(m)
    for j in range(m):
        k = int(np.flatnonzero(alive)[-1])
        most = capacity // int(lengths[k])
        items = [k] * most
        for copies in range(min(most, 8), 0, -1):
            room = capacity - copies * int(lengths[k])
            if room == 0 or at[room] >= 0 and alive[at[room]]:
                items = [k] * copies + [int(at[room])] * (room > 0)
                break
            a = np.flatnonzero(alive & (lengths < room))
            b = at[room - lengths[a]]
            fits = (b >= 0) & alive[b]
            if fits.any():
                a, b = a[fits], b[fits]
                best = int(np.minimum(rest[a], rest[b]).argmax())
                items = [k] * copies + [int(a[best]), int(b[best])]
                break
        column = np.bincount(items, minlength=m).astype(float)
        inside = np.flatnonzero(column)
        times = (rest[inside] / column[inside]).min()
        gone = int(inside[(rest[inside] / column[inside]).argmin()])
        columns[:, j], used[j] = column, times
        rest = np.maximum(0, rest - times * column)
        rest[gone], alive[gone] = 0, False
    return columns, used


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 60) -> list[tuple[np.ndarray, float]]:
    """The patterns (counts by length) of the linear program's basis, and how often each is used.

    Column generation ends when no pattern improves the program, when at most one token in 10,000 is padding, or after
    `rounds` pricings.
    """
    m, tokens = len(lengths), float(lengths @ demand)
    counts, used = first_patterns(lengths, demand, capacity)
    costs = np.array([padded(int(counts[:, j] @ lengths), capacity) for j in range(m)], float)
    inverse = np.linalg.inv(counts)
    cost_of = np.array([padded(c, capacity) if c else 0 for c in range(capacity + 1)], float)
    for _ in range(rounds):
        if costs @ used <= tokens * 1.0001:
            break
        duals = costs @ inverse
        best, last = price(duals, lengths, capacity)
        gains = best - cost_of
        tries = [(int(c), None) for c in np.argsort(-gains)[:8] if gains[c] > 1e-6]  # the best pattern of a total
        tries += [(capacity, int(k)) for k in np.argsort(-(duals + best[capacity - lengths]))[:24]]  # and with a length in it
        entered = 0
        for total, first in tries:
            column = np.zeros(m)
            if first is not None:
                column[first], total = 1, total - int(lengths[first])
            while total > 0 and last[total] >= 0:
                column[last[total]] += 1
                total -= int(lengths[last[total]])
            cost, step = padded(int(column @ lengths), capacity), inverse @ column
            able = step > 1e-9
            if costs @ step - cost <= 1e-6 or not able.any():
                continue
            ratios = np.where(able, used / np.where(able, step, 1), np.inf)
            out = int(ratios.argmin())
            used, often = np.maximum(0, used - ratios[out] * step), ratios[out]
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out], counts[:, out], costs[out], used[out] = row, column, cost, often
            entered += 1
        if not entered:
            break
    return [(counts[:, j], float(used[j])) for j in range(m)]


def powers_of(n: int) -> list[int]:
    """The powers of two that add up to n, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def plan(histogram: dict[int, int], capacity: int) -> dict:
    """From how many pieces there are of each length: where each rank of each length goes.

    slots[length] has a row for each pattern: first rank, pieces in a sequence, first sequence, offset in the sequence.
    placed[length] is how many ranks the slots take. The others are cut at powers of two; part_from[length, power] is
    where the first of these parts begins in a run of tokens, and bounds are the sequences' first tokens in that run.
    """
    slots: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    placed = dict.fromkeys(histogram, 0)
    sequences = 0
    if capacity in histogram:
        slots[capacity].append((0, 1, 0, 0))
        sequences = placed[capacity] = histogram[capacity]
    rests = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    patterns = solve_patterns(rests, np.array([histogram[int(n)] for n in rests], float), capacity) if len(rests) else []
    for counts, used in patterns:
        inside = [(int(n), int(round(k))) for n, k in zip(rests, counts) if k > 0.5]
        length = sum(n * k for n, k in inside)
        times = min([int(used + 1e-6), *((histogram[n] - placed[n]) // k for n, k in inside)])
        if times <= 0 or padded(length, capacity) > length:
            continue
        offset = 0
        for n, k in inside:
            slots[n].append((placed[n], k, sequences, offset))
            placed[n] += times * k
            offset += n * k
        sequences += times
    part_from, tokens, power = {}, 0, capacity
    while power:
        for n in sorted(histogram):
            if n & power:
                part_from[n, power] = tokens
                tokens += (histogram[n] - placed[n]) * power
        power //= 2
    bounds = [*range(0, tokens - tokens % capacity + 1, capacity)]
    for power in powers_of(tokens % capacity):
        bounds.append(bounds[-1] + power)
    return {"slots": {n: np.array(x, np.int64).reshape(-1, 4) for n, x in slots.items()}, "placed": placed, "part_from": part_from, "tail": bounds[-1 - len(powers_of(tokens % capacity)) :], "sequences": sequences}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, most: int = 1_000_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece. capacity: a power of two; most:
    the entries of a worker's encoding tables."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                out = []
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder(tokenizer, spaced_units, most).batch(some.column(1).to_pylist(), end_id)):
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        crcs, of = [], 0
                        for n in powers_of(len(part)) if len(part) < capacity else []:
                            crcs.append(zlib.crc32(part[of : of + n].tobytes()))
                            of += n
                        out.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), task, int(seen[len(part)]), crcs))
                        seen[len(part)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.list_(pa.int64())])], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "local_rank", "part_crcs"]
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("t"))
    pieces = written(texts.mapInArrow(cut, PIECES), "pieces")
    # Ranks within a length: the rank in the task that cut the piece, after the pieces of that length in earlier tasks.
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = written(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    to = in_task(docs.sparkSession, lambda: plan(histogram, capacity))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array(to["tail"], np.int64)
        for batch in batches:
            start, length, crc, tokens, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            row = np.arange(batch.num_rows)  # ids may be null, so rows stand for them
            sequence, offset = np.full(len(length), -1), np.zeros(len(length), np.int64)
            parts = []
            for n in np.unique(length).tolist():
                mine, slots, placed = np.flatnonzero(length == n), to["slots"][n], to["placed"][n]
                over, mine = mine[rank[mine] >= placed], mine[rank[mine] < placed]
                if len(mine):
                    first, k, seq, off = slots[np.searchsorted(slots[:, 0], rank[mine], "right") - 1].T
                    sequence[mine], offset[mine] = seq + (rank[mine] - first) // k, off + (rank[mine] - first) % k * n
                if len(over):
                    crcs, of = np.array(batch.column(6).take(pa.array(over)).to_pylist(), np.int64).reshape(len(over), -1), 0
                    for j, power in enumerate(powers_of(n)):
                        run = to["part_from"][n, power] + (rank[over] - placed) * power
                        full, inside = run // capacity, run % capacity
                        last = run >= tail[0]  # the last tokens: sequences of falling powers of two
                        k = np.searchsorted(tail, run, "right") - 1
                        full = np.where(last, tail[0] // capacity + k, full)
                        inside = np.where(last, run - tail[np.maximum(k, 0)], inside)
                        parts.append((row[over], start[over] + of, np.full(len(over), power), crcs[:, j], tokens[over], to["sequences"] + full, inside))
                        of += power
            whole = sequence >= 0
            rows = [(row[whole], start[whole], length[whole], crc[whole], tokens[whole], sequence[whole], offset[whole]), *parts]
            which, *rest = (np.concatenate(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *map(pa.array, rest)], names=columns)

    ranked = pieces.join(by_task.select("length", "task", "before"), ["length", "task"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local_rank")).alias("rank"), "part_crcs")
    return ranked.mapInArrow(place, ", ".join(f"{c} long" for c in columns))
