"""Ids of texts by the tokenizers library, with each distinct stretch of text encoded once per worker and batch of memory.

A unit is a stretch of text whose ids don't depend on what stands around it; a piece is a part of a unit of which the same
holds (a word without the full stop behind it). Arrow splits texts into units and numbers the distinct ones of a group of
texts; these are looked up in a table of bounded size, and ids are gathered by numpy. The library encodes each new piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

#: Where a text may be cut for either vocabulary: before a single space between two characters that are no white space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
SLICE = 1 << 18
GROUP = 1 << 22  # characters of texts whose units are numbered together
#: White space of any alphabet, in the syntax of Arrow's regular expressions.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CLOSING = ".,;:!?"
LATIN_END = "\u0250"  # below it no letter is changed by normalisation


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of about `size` characters, cut where SAFE_CUT allows; a text without such a place stays whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def spaced_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Units for byte-level BPE with the space before a word: a word keeps its space, longer white space stays inside a unit.

    Returned are the units' numbers, text after text, how many each text has, and the distinct units.
    """
    odd = pc.match_substring_regex(texts, f"^{WHITE}|{WHITE}$|{WHITE}{{2}}").to_numpy(zero_copy_only=False)
    if odd.any():  # of these, each text is split by itself
        lists = pa.array([SAFE_CUT.split(x) if o else [] for x, o in zip(texts.to_pylist(), odd)], pa.list_(pa.string()))
        plain = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        parts = pc.if_else(pa.array(odd), lists, plain)
    else:
        parts = pc.split_pattern(texts, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    numbers, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    # all but a text's first unit have a space before them; a slice that begins with a space has it in its first unit
    first = (np.cumsum(counts) - counts)[counts > 0]
    firsts, which = np.unique(numbers[first], return_inverse=True)
    numbers[first] = len(names) + which
    return numbers, counts, [f" {x}" for x in names] + [names[k] for k in firsts]


def bare_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Units for a vocabulary that drops white space and case: stretches without ASCII white space. As spaced_units()."""
    # without combining marks, lower-casing A-Z before or after the library's normalisation is the same
    marked = pc.any(pc.match_substring_regex(texts, r"[\x{300}-\x{36f}]")).as_py()
    parts = pc.ascii_split_whitespace(texts if marked else pc.ascii_lower(texts))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, coded.dictionary.to_pylist()


def pieces_of(unit: str) -> list[str]:
    """Parts of a unit whose ids don't depend on each other: around single newlines inside, and before closing marks that
    follow a letter. Both vocabularies' rules end a token there, and none looks back."""
    if "\n" in unit:
        lines = unit.split("\n")
        if all(x and not x[-1].isspace() for x in lines) and not any(x[0].isspace() for x in lines[1:]):
            out = []
            for k, x in enumerate(lines):
                out += ["\n", *pieces_of(x)] if k else pieces_of(x)
            return out
        return [unit]
    core = unit.rstrip(CLOSING)
    return [core, unit[len(core) :]] if len(core) < len(unit) and core[-1:].lower().isalpha() else [unit]


class _Table:
    """Names, and the ids of each."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.begins, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def numbers(self, names: list[str]) -> tuple[np.ndarray, list[str]]:
        """The numbers of names, and those that are new, whose ids are to be added next."""
        before = len(self.index)
        add = self.index.setdefault
        got = np.fromiter((add(x, len(self.index)) for x in names), np.int64, len(names))
        return got, list(islice(self.index, before, None)) if len(self.index) > before else []

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.index) - len(sizes)
        while at + len(sizes) > len(self.begins):
            self.begins, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begins[at : at + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(sizes)] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some names, one after another, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begins[numbers] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class UnitEncoder:
    """Encodes by a tokenizer file; `units` splits texts into their units."""

    def __init__(self, path: str, units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[str]]], most: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.units, self.most = units, most
        # Many new pieces go to the library as one text, with a byte between them that no merge of the vocabulary contains.
        self.between = " \0 " if units is bare_units else "\0"
        mark = self.tokenizer.encode(self.between.strip(" "), add_special_tokens=False)
        named = mark.tokens[0].removesuffix("</w>")
        alone = len(mark.ids) == 1 and sum(named in x for x in self.tokenizer.get_vocab()) <= 2
        self.mark = mark.ids[0] if alone else None
        self.table, self.parts = _Table(), _Table()
        self.model = self.tokenizer.model
        self.words = self._words_only()

    def _words_only(self) -> bool:
        """Whether the model by itself gives a word's ids: the rules around it leave a single word as it is, but for writing
        each byte as a letter."""
        written = sorted(pre_tokenizers.ByteLevel.alphabet())
        shown = [c for c in range(256) if chr(c) in written]
        hidden = (chr(256 + k) for k in range(256))
        self.letters = {c: chr(c) if c in shown else next(hidden) for c in range(256)}
        tries = ["the", "unlikely", "\u00e9t\u00e9", "gr\u00f6\u00dfer", "zzqx", "ca\u00f1ones"]
        tries = tries if self.units is bare_units else [f" {x}" for x in tries] + tries + ["Upper", " \u00c9t\u00e9"]
        return all(self._model_ids(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in tries)

    def _model_ids(self, word: str) -> list[int]:
        """The ids of one word by the library's model."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        elif word[0] == " ":
            word = self.letters[32] + word[1:]
        return [x.id for x in self.model.tokenize(word)]

    def _word(self, piece: str) -> bool:
        """Whether a piece is one word of Latin letters, and lower case where the vocabulary is."""
        if self.units is bare_units:
            return piece.isalpha() and max(piece) < LATIN_END and piece == piece.lower()
        core = piece[1:] if piece[:1] == " " else piece
        return core.isalpha() and max(core) < LATIN_END

    def _learn(self, new: list[str]) -> None:
        """The ids of new units, put together from those of their pieces."""
        lists = [pieces_of(x) if x[-1:] in CLOSING or "\n" in x else (x,) for x in new]
        names = list(dict.fromkeys(x for some in lists for x in some))
        numbers, unknown = self.parts.numbers(names)
        if unknown:
            got = [self._encode(unknown[at : at + 20_000]) for at in range(0, len(unknown), 20_000)]
            self.parts.add(*map(np.concatenate, zip(*got)))
        number_of = dict(zip(names, numbers.tolist()))
        flat, sizes = self.parts.gather(np.array([number_of[x] for some in lists for x in some], np.int64))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.table.add(flat, np.add.reduceat(sizes, np.cumsum(counts) - counts))

    def _plain(self, piece: str) -> bool:
        """Whether the library cuts a piece as it would alone when the mark stands before and behind it: not so for white
        space at its end, more than one space at its beginning, and a contraction."""
        return piece[0] != "'" and not piece[-1].isspace() and not (piece[1].isspace() if piece[0] == " " else piece[0].isspace())

    def _encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has."""
        bare = self.units is bare_units  # kind 0: by itself, 1: between marks, 2: word
        kinds = np.array([2 if self.words and self._word(x) else 1 if self.mark is not None and x and "\0" not in x and (bare or self._plain(x)) else 0 for x in some], np.int8)
        sizes, flats = np.zeros(len(some), np.int64), {}
        for kind in (2, 1, 0):
            mine = np.flatnonzero(kinds == kind)
            if not len(mine):
                continue
            names = [some[k] for k in mine]
            got = self._flat(list(map(self._model_ids, names))) if kind == 2 else self._joined(names) if kind == 1 else None
            flats[kind], sizes[mine] = got or self._flat([x.ids for x in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)])
        if len(flats) == 1:
            return next(iter(flats.values())), sizes
        out, of = np.zeros(int(sizes.sum()), np.uint32), np.repeat(kinds, sizes)
        for kind, flat in flats.items():
            out[of == kind] = flat
        return out, sizes

    def _joined(self, some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As _encode, by texts of many pieces with the mark between them; None if the marks don't come out."""
        parts = [self.between.join(some[i : i + 500]) + self.between for i in range(0, len(some), 500)]
        flat = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark)
        return (flat[flat != self.mark], np.diff(ends, prepend=-1) - 1) if len(ends) == len(some) else None

    @staticmethod
    def _flat(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text, as uint32."""
        return self.batch([text])[0]

    def batch(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with end_id behind it. Long texts go slice by slice, so working memory doesn't grow with them."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        some: list[str] = []
        owners: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            for part in slices(text):
                some.append(part)
                owners.append(k)
                size += len(part)
                if size >= GROUP:
                    self._group(some, owners, out, end_id)
                    some, owners, size = [], [], 0
        self._group(some, owners, out, end_id)
        for x in out:
            if len(x) > 1:  # only the last slice keeps the end id
                x[:-1] = [y[:-1] for y in x[:-1]] if end_id is not None else x[:-1]
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _group(self, some: list[str], owners: list[int], out: list[list[np.ndarray]], end_id: int | None) -> None:
        if not some:
            return
        if len(self.table.index) > self.most:
            self.table = _Table()
        if len(self.parts.index) > self.most:
            self.parts = _Table()
        numbers, counts, names = self.units(pa.array(some, pa.string()))
        known, new = self.table.numbers(names)
        if new:
            self._learn(new)
        ids, sizes = self.table.gather(known[numbers])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        if end_id is not None:
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends = ends + np.arange(1, len(ends) + 1)
        for k, i, j in zip(owners, [0, *ends[:-1].tolist()], ends.tolist()):
            out[k].append(ids[i:j])
        del numbers, names, new
        give_back()


def encoder(path: str, units: Callable, most: int = 500_000, _made: dict = {}) -> UnitEncoder:
    """The worker's encoder for a file, with tables of about `most` entries."""
    if (path, most) not in _made:
        _made[path, most] = UnitEncoder(path, units, most)
    return _made[path, most]
