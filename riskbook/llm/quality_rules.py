"""Quality rules: counts per document and an n-gram perplexity band.

The language model is a modified Kneser-Ney model over code points, of order `order` (five). Spark counts every n-gram of
every text, and whether two different texts have it; a task adds up what it sees before the shuffle. The lower orders' counts
(in how many left contexts an n-gram occurs), the totals of contexts, and the probabilities are groupings and joins of these
tables, so the model grows with the corpus and is made at any size. N-grams of two and more letters that one text alone has
(or its copies) don't get into the model; their share goes to the lower order, so that a text is not judged by itself. The model is kept as arrays sorted by a 64-bit hash of the n-gram: log probability,
and log back-off weight for the context that the n-gram is.

Scoring takes the distinct n-grams of a batch of documents and looks these up. Up to `most_bytes` of arrays, they are
broadcast. Beyond, documents are dealt over batches, and the model over ranges of hashes; the distinct n-grams of a batch go
to the ranges, what these have on them comes back, and each batch is scored with that.

The model learns from all texts that may be a reference: those with at most `REFERENCE_SYMBOLS` symbols in a hundred characters,
since junk that teaches the model looks likely to it. All texts are scored.

A document's perplexity is that per character. The band of a language is drawn from its own reference documents that pass the
base rules: beyond the quartiles of the log perplexity by more than `spread` times their distance (and `least` at least),
documents are rejected; to that comes the mean's standard error, `error` over the root of the text's length, so that short
texts aren't rejected by chance.

Defined results. Null or empty text: no words, zero counts, base_failed. A language without a reference
document has no band: only the base rules judge it. Texts without characters have no perplexity. A
null language is a language of its own. Repeated rows: each gets its row; their n-grams count, but as those of one text. Empty table: no row.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64, text_or_empty, written

ORDER = 5
BEGIN = 2  # the code point that stands before a text
SYMBOLS = "#*$%&|<>"
REFERENCE_SYMBOLS = 1.0  # of a hundred characters, at most, in a text that the language model learns from
GROUP = 1 << 22  # characters that are worked on at once
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
POWERS = [pow(int(STEP), k, 1 << 64) for k in range(32)]


def points_of(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, each with order - 1 BEGINs before it, and how many characters each text has."""
    lead = chr(BEGIN) * (order - 1)
    flat = np.frombuffer((lead + lead.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(flat == 0, 0xFFFF, flat).astype(np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def ends_of(lengths: np.ndarray, order: int) -> np.ndarray:
    """Where in points_of the texts' own characters are."""
    return np.arange(int(lengths.sum())) + np.repeat(np.arange(1, len(lengths) + 1) * (order - 1), lengths)


def letters(points: np.ndarray, _table: list = []) -> np.ndarray:
    """A 64-bit number for each code point."""
    mixed = lambda x: mix64(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not _table:
        _table.append(mixed(np.arange(1 << 16)))
    return _table[0][points] if not len(points) or points.max() < 1 << 16 else mixed(points)


def hash_of(values: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the k letters that end at some places: a polynomial in STEP, the last letter first."""
    out = np.zeros(len(ends), np.uint64)
    for j in range(k):
        out += values[ends - j] * np.uint64(POWERS[j])
    return out


def hashes_of(values: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """As hash_of, for places all over the values: in one sweep over these."""
    out = values[k - 1 :].copy()
    for j in range(1, k):
        out += values[k - 1 - j : len(values) - j] * np.uint64(POWERS[j])
    return out[ends - (k - 1)]


def groups_of(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts in lists of about GROUP characters; a longer one is a list of its own."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > GROUP:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def parts_of(text: str, order: int, size: int = GROUP) -> Iterator[tuple[str, int]]:
    """A long text in parts with the characters before, and how many of these there are."""
    for at in range(0, max(len(text), 1), size):
        before = text[max(0, at - order + 1) : at]
        yield before + text[at : at + size], len(before)


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, least, most): how often each n-gram of code points occurs in column t of all rows, and the least and the
    greatest CRC-32 of the texts that have it."""

    def unique(some: list[str]) -> tuple[np.ndarray, ...]:
        """Hash, count, least and greatest text, and code points of the n-grams of some documents."""
        got = []
        marks = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in some], np.int64)
        for text, lead in parts_of(some[0], order) if len(some) == 1 else [(None, 0)]:
            points, lengths = points_of(some if text is None else [text], order)
            ends = ends_of(lengths, order)[lead:]
            if not len(ends):
                continue
            hashes = hashes_of(letters(points), ends, order)
            by = np.argsort(hashes)
            sorted_, mark = hashes[by], np.repeat(marks, lengths)[lead:][by]
            begins = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            chars = np.stack([points[ends[by[begins]] - order + 1 + j] for j in range(order)], axis=1)
            got.append((sorted_[begins], np.diff(np.append(begins, len(by))), np.minimum.reduceat(mark, begins), np.maximum.reduceat(mark, begins), chars))
        return merged(got)

    def merged(got: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        if len(got) < 2:
            return got[0] if got else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros((0, order), np.uint32))
        hashes, n, least, most, chars = map(np.concatenate, zip(*got))
        by = np.argsort(hashes)
        begins = np.flatnonzero(np.concatenate([[True], np.diff(hashes[by]) > 0]))[: len(by)]
        return hashes[by[begins]], np.add.reduceat(n[by], begins), np.minimum.reduceat(least[by], begins), np.maximum.reduceat(most[by], begins), chars[by[begins]]

    def rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        _, n, least, most, chars = merged(held)
        for at in range(0, len(n), 1 << 18):
            some = slice(at, at + (1 << 18))
            names = np.ascontiguousarray(chars[some]).view(f"<U{order}").reshape(-1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(x[some]) for x in (n, least, most))], names=["gram", "n", "least", "most"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for some in groups_of(x for batch in batches for x in batch.column(0).to_pylist()):
            held.append(unique(some))
            if len(held) > 3:
                held = [merged(held)]
                give_back()
                if len(held[0][0]) > 1 << 21:  # enough for one table
                    yield from rows(held)
                    held = []
        yield from rows(held)

    got = texts.select("t").mapInArrow(counts, "gram string, n long, least long, most long")
    return got.groupBy("gram").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def discounts(rows: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts from the counts of counts of column n: four numbers."""
    n1, n2, n3, n4 = (max(1, x) for x in rows.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(x, low), high) for x, low, high in zip(raw, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85))]


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(k, gram, log_p, log_back): the model of all orders from count_grams. log_back is for what follows gram as a context;
    an unknown character has log_p of gram '' at k 0."""
    keep = F.col("least") < F.col("most")
    counts = {order: written(grams.withColumn("keep", keep), "grams")}
    for k in range(order - 1, 0, -1):  # in how many different left contexts an n-gram occurs
        shorter = counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        counts[k] = written(shorter.withColumn("keep", keep | F.lit(k == 1)), "grams")
    alphabet = counts[1].count() + 1
    lower, out = None, None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(counts[k])
        n = F.col("n")
        part = F.when(F.col("keep"), n - F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)).otherwise(0.0)
        rows = counts[k].select("gram", F.substring("gram", 1, k - 1).alias("context"), "keep", "n", F.greatest(part, F.lit(0.0)).alias("part"))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("part").alias("kept"))
        totals = written(totals.select("context", "total", (1 - F.col("kept") / F.col("total")).alias("back")), "contexts")
        kept = rows.where("keep").join(totals, "context")
        if lower is None:
            kept = kept.withColumn("below", F.lit(1.0 / alphabet))
        else:  # of an n-gram whose shorter one isn't in the model, that has its own lower order's share
            kept = below(kept, counts, backs, lower, k, alphabet)
        now = written(kept.select("gram", (F.col("part") / F.col("total") + F.col("back") * F.col("below")).alias("p")), "probabilities")
        rest = totals.select(F.col("context").alias("gram"), "back")
        if k == 1:
            zero = rest.select(F.lit(0).alias("k"), F.lit("").alias("gram"), F.lit(float(np.log(1.0 / alphabet))).alias("log_p"), F.log("back").alias("log_back"))
            out, backs = zero, {0: rest}
        else:
            mine = lower.join(rest, "gram", "full").select(F.lit(k - 1).alias("k"), "gram", F.log("p").alias("log_p"), F.log(F.greatest("back", F.lit(1e-12))).alias("log_back"))
            out, backs[k - 1] = out.unionByName(mine), rest
        lower = now
        backs["p", k] = now
    last = lower.select(F.lit(order).alias("k"), "gram", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_back"))
    return written(out.unionByName(last), "model")


def below(rows: DataFrame, counts: dict, backs: dict, lower: DataFrame, k: int, alphabet: int) -> DataFrame:
    """rows of order k with the probability `below` of each one's shorter n-gram, by backing off where that was left out."""
    rows = rows.withColumn("short", F.substring("gram", 2, k - 1))
    out = rows.join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short", "left").withColumn("weight", F.lit(1.0))
    for j in range(k - 2, 0, -1):
        context = backs[j].select(F.col("gram").alias("c"), F.col("back").alias("b"))
        out = out.withColumn("c", F.substring("short", k - 1 - j, j)).join(context, "c", "left").withColumn("weight", F.when(F.col("below").isNull(), F.col("weight") * F.coalesce("b", F.lit(1.0))).otherwise(F.col("weight"))).drop("c", "b")
        shorter = backs["p", j].select(F.col("gram").alias("s"), F.col("p").alias("q"))
        out = out.withColumn("s", F.substring("short", k - j, j)).join(shorter, "s", "left").withColumn("below", F.coalesce("below", F.col("weight") * F.col("q"))).drop("s", "q")
    return out.withColumn("below", F.coalesce("below", F.lit(1.0 / alphabet)))


def sorted_arrays(model: DataFrame, ranges: int = 64) -> DataFrame:
    """(range, keys, log_p, log_back): the model in ranges of hashes, each with its arrays in order of hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_pylist()
            keys = np.zeros(len(grams), np.uint64)
            sizes = np.array(batch.column(0).to_pylist(), np.int64)
            for k in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == k)
                points = np.array([list(map(ord, grams[i])) for i in mine], np.uint32).reshape(len(mine), k)
                values = letters(points.reshape(-1)).reshape(len(mine), k)
                out = np.zeros(len(mine), np.uint64)
                for j in range(k):
                    out += values[:, k - 1 - j] * np.uint64(POWERS[j])
                keys[mine] = mix64(out + np.uint64(k))
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int64) * ranges >> 32), pa.array(keys.view(np.int64)), *batch.columns[2:]], names=["range", "key", "log_p", "log_back"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("range", pa.int64()), ("key", pa.int64()), ("log_p", pa.float64()), ("log_back", pa.float64())]))
        of, keys = table["range"].to_numpy(), table["key"].to_numpy().view(np.uint64)
        p, back = (table[c].to_numpy() for c in ("log_p", "log_back"))
        for r in np.unique(of):
            mine = np.flatnonzero(of == r)
            mine = mine[np.argsort(keys[mine])]
            yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([keys[mine].tobytes()]), pa.array([p[mine].astype(np.float32).tobytes()]), pa.array([back[mine].astype(np.float32).tobytes()])], names=["range", "keys", "log_p", "log_back"])

    rows = model.select("k", "gram", "log_p", "log_back").mapInArrow(hashed, "range long, key long, log_p double, log_back double")
    return written(rows.repartition("range").mapInArrow(arrays, "range long, keys binary, log_p binary, log_back binary"), "arrays")


def loaded(rows: list) -> dict[str, np.ndarray]:
    """The arrays of some ranges as one."""
    rows = sorted(rows, key=lambda r: r["range"])
    return {c: np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("keys", np.uint64), ("log_p", np.float32), ("log_back", np.float32))}


def look_up(arrays: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log_p and log_back of keys; not a number where there is none."""
    if not len(arrays["keys"]):
        return np.full(len(keys), np.nan, np.float32), np.full(len(keys), np.nan, np.float32)
    at = np.minimum(np.searchsorted(arrays["keys"], keys), len(arrays["keys"]) - 1)
    there = arrays["keys"][at] == keys
    return np.where(there, arrays["log_p"][at], np.nan), np.where(there, arrays["log_back"][at], np.nan)


class Grams:
    """The distinct n-grams of some texts, and the keys under which a model has what it knows about them."""

    def __init__(self, texts: list[str], order: int, lead: int = 0):
        points, self.lengths = points_of(texts, order)
        ends, values = ends_of(self.lengths, order)[lead:], letters(points)
        self.lengths = self.lengths - lead if lead else self.lengths
        hashes = hashes_of(values, ends, order) if len(ends) else np.zeros(0, np.uint64)
        by = np.argsort(hashes)
        new = np.concatenate([[True], np.diff(hashes[by]) > 0])[: len(by)]
        self.which = np.empty(len(by), np.int32)
        self.which[by] = np.cumsum(new) - 1
        at = ends[by[new]]
        self.grams = [mix64(hash_of(values, at, k) + np.uint64(k)) for k in range(order, -1, -1)]
        self.contexts = [mix64(hash_of(values, at - 1, k) + np.uint64(k)) for k in range(order - 1, -1, -1)]

    def log_probabilities(self, arrays: dict[str, np.ndarray]) -> np.ndarray:
        """The log probability of the last letter of each distinct n-gram after those before it."""
        out, open_, added = np.zeros(len(self.grams[0])), np.arange(len(self.grams[0])), np.zeros(len(self.grams[0]))
        for k, gram in enumerate(self.grams):
            p, _ = look_up(arrays, gram[open_])
            found = ~np.isnan(p)
            out[open_[found]] = added[open_[found]] + p[found]
            open_ = open_[~found]
            if not len(open_) or k == len(self.contexts):
                break
            back = look_up(arrays, self.contexts[k][open_])[1]
            added[open_] += np.where(np.isnan(back), 0, back)
        return out

    def sums(self, logs: np.ndarray) -> np.ndarray:
        """The log probability of each text."""
        total = np.concatenate([[0.0], np.cumsum(logs[self.which], dtype=np.float64)])
        ends = np.cumsum(self.lengths)
        return total[ends] - total[ends - self.lengths]


def repeated_window_words(words: list, size: int = 5) -> int:
    """How many words lie in a window of `size` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code, width = ids, 1
    while width < size:  # numbers of longer and longer windows, renumbered so that they never overflow
        if len(number) * (int(code.max()) + 1) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code[: len(ids) - width] * len(number) + ids[width:]
        width += 1
    _, which, n = np.unique(code, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(n[which] > 1)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return int((np.cumsum(marks) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; words are parted by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\v\f\r"):
            seen.add(line)
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeated_window_words(words)


def scores_of(texts: list[str], arrays: dict[str, np.ndarray], order: int) -> list[float | None]:
    """The log perplexity per character of each text."""
    out: list[float | None] = []
    for some in groups_of(texts):
        if len(some) == 1:
            total = sum(float((g := Grams([x], order, lead)).sums(g.log_probabilities(arrays))[0]) for x, lead in parts_of(some[0], order)) if some[0] else 0.0
            sums = [total]
        else:
            grams = Grams(some, order)
            sums = grams.sums(grams.log_probabilities(arrays)).tolist()
        out += [-x / len(text) if text else None for x, text in zip(sums, some)]
    return out


def is_reference(text: Column, per_hundred: float = REFERENCE_SYMBOLS) -> Column:
    """Whether a text may teach the language model: at most so many symbols in a hundred characters."""
    return 100 * (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) <= per_hundred * F.length(text)


def document_measures(docs: DataFrame, order: int = ORDER, most_bytes: int = 1 << 27) -> DataFrame:
    """doc_id, lang, the counts, base_failed and log_perplexity (null where there are no characters) of each row."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_or_empty().alias("t"))
    arrays = sorted_arrays(kneser_ney(count_grams(texts.where(is_reference(F.col("t"))), order), order))
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]
    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"

    def measured(batch: pa.RecordBatch | pa.Table, model: dict[str, np.ndarray]) -> pa.RecordBatch:
        some = batch.column(2).to_pylist()
        counts = [pa.array(x, pa.int64()) for x in zip(*map(base_counts, some))]
        columns = [batch.column(0), batch.column(1)] if isinstance(batch, pa.RecordBatch) else [batch.column(0).combine_chunks(), batch.column(1).combine_chunks()]
        return pa.RecordBatch.from_arrays([*columns, *counts, pa.array(scores_of(some, model, order), pa.float64())], names=names)

    size = arrays.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0)).alias("n")).first()["n"] * 2  # a key has as many bytes as its two values
    if size <= most_bytes:
        shared = docs.sparkSession.sparkContext.broadcast(loaded(arrays.collect()))  # no more than most_bytes

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    yield measured(batch.slice(at, 2000), shared.value)
                    give_back()

        out = texts.mapInArrow(measure, schema)
    else:
        out = _dealt_measures(texts, arrays, measured, schema, order)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _dealt_measures(texts: DataFrame, arrays: DataFrame, measured, schema: str, order: int) -> DataFrame:
    """The measures of all texts where the model is too large to broadcast: see above."""
    total = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    ranges = arrays.count()
    batch_of = F.pmod(F.xxhash64("doc_id", "t"), F.lit(max(1, int(total) // GROUP)))
    dealt = texts.withColumn("batch", batch_of)

    def wanted(table: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.uint64)]
        for some in groups_of(table["t"].to_pylist()):
            for text, lead in parts_of(some[0], order) if len(some) == 1 else [(None, 0)]:
                grams = Grams(some if text is None else [text], order, lead)
                keys.append(np.unique(np.concatenate(grams.grams + grams.contexts)))
        keys = np.unique(np.concatenate(keys))
        of = (keys >> np.uint64(32)).astype(np.int64) * 64 >> 32
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(keys)] if len(keys) else []
        return pa.table({"batch": pa.array([table["batch"][0].as_py()] * max(0, len(cuts) - 1), pa.int64()), "range": pa.array([int(of[i]) for i in cuts[:-1]], pa.int64()), "wanted": pa.array([keys[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                mine, keys = loaded([x]), np.frombuffer(x["wanted"], np.uint64)
                there = np.isin(keys, mine["keys"])
                at = np.searchsorted(mine["keys"], keys[there])
                yield pa.RecordBatch.from_pylist([{"batch": x["batch"], "range": x["range"], "keys": keys[there].tobytes(), "log_p": mine["log_p"][at].tobytes(), "log_back": mine["log_back"][at].tobytes()}])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([], result)
        return pa.Table.from_batches([measured(table.select(["doc_id", "lang", "t"]), loaded(answers.to_pylist()))])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    result = to_arrow_schema(_parse_datatype_string(schema))
    asked = dealt.groupBy("batch").applyInArrow(wanted, "batch long, range long, wanted binary")
    found = asked.join(arrays, "range").repartition(max(1, ranges), "batch", "range").mapInArrow(answer, "batch long, range long, keys binary, log_p binary, log_back binary")
    return dealt.groupBy("batch").cogroup(written(found, "answers").groupBy("batch")).applyInArrow(score, schema)


def quality_verdicts(docs: DataFrame, spread: float = 3.0, least: float = 0.1, error: float = 2.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and with them lang, log_perplexity and the band's ends."""
    rows = written(document_measures(docs), "measures")
    quartile = lambda p: F.percentile_approx("log_perplexity", p, 10_000)
    bands = rows.where(~F.col("base_failed") & (100 * F.col("n_symbols") <= REFERENCE_SYMBOLS * F.col("word_chars"))).groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    room = F.greatest(F.lit(spread) * (F.col("q3") - F.col("q1")), F.lit(least))
    bands = bands.select(F.col("lang").alias("_lang"), (F.col("q1") - room).alias("lower"), (F.col("q3") + room).alias("upper"))
    judged = rows.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    short = F.lit(error) / F.sqrt(F.greatest("word_chars", F.lit(1)))
    judged = judged.withColumn("lower", F.col("lower") - short).withColumn("upper", F.col("upper") + short)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "lower", "upper")
