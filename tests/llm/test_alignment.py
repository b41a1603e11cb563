"""Operator 13 against all pairs of tokens, on small tables with odd rows."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from riskbook.llm import token_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "x▁y", "▁", "A<|endoftext|>b <s> </s> <0x41> <unk>", "日本語 é ü  \t x", "\0 a\0b", "  two", "tail  ", "it's 's\n\n", "a" * 3000, "word " * 300, "1234567 " * 40]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    got = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return [(d, t if len(t or "") < 1500 else t[:1500]) for d, t in got[:150]] + [(10**6 + k, t) for k, t in enumerate(ODD)] + [(got[0][0], got[0][1][:900]), (None, "no id")]


@pytest.fixture(scope="module")
def plain(rows):
    """(doc_id, tokens and ends of both) by the libraries alone."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {}
    for k in range(256):  # the letter of each byte, read off the library's own writing of it
        letters |= {c: k for c in [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(k))[0][0]] if k < 128}
    spare = sorted(set(pre_tokenizers.ByteLevel.alphabet()) - set(letters))
    letters |= {c: ord(c) for c in spare if ord(c) < 256}
    letters |= dict(zip((c for c in spare if ord(c) >= 256), (k for k in range(128, 256) if k not in letters.values())))
    out = []
    for d, t in rows:
        want, x, y = f" {t or ''}".encode(), [], []
        if t:
            x = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(f" {t}", add_special_tokens=False).ids]
            y = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(t)]
            if b"".join(s for _, s in x) != want or b"".join(s for _, s in y) != want:
                x = y = []
        out.append((d, *(([k for k, _ in z], np.cumsum([len(s) for _, s in z]).tolist()) for z in (x, y))))
    return out


def brute(plain):
    found, counts = [], Counter()
    for d, (a, ends_a), (b, ends_b) in plain:
        spans_a, spans_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))
        links = [(x, y) for x, (s, e) in zip(a, spans_a) for y, (u, v) in zip(b, spans_b) if max(s, u) < min(e, v)]
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(x) for x, (_, e) in zip(z, s) if low < e <= cut) for z, s in ((a, spans_a), (b, spans_b))))
            low = cut
        counts.update(links)
        found.append((d, len(a), len(b), groups, links))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return counts, highest, sorted((str(d), a, b, len(g), len(x), sum(counts[y] == highest[y[1]] for y in x), sum(counts[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, x in found)


def test_digests_are_those_of_all_pairs(spark, rows, plain, monkeypatch):
    monkeypatch.setattr(token_alignment, "GROUP", 20_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).withColumn("slice", F.lit(1)).repartition(3)
    counts, highest, want = brute(plain)
    got = token_alignment.alignment_digests(docs, A, B)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert sum(x[1] == 0 for x in want) >= 4
    pairs = token_alignment.pair_counts(docs, A, B).collect()
    assert {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in pairs} == {k: (n, n == highest[k[1]]) for k, n in counts.items()}


def test_groups_of_each_text(spark, rows, plain):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_alignment.aligned_groups(docs, A, B).collect()}
    for k, (_, (a, ends_a), (b, ends_b)) in enumerate(plain):
        both = sorted(set(ends_a) & set(ends_b))
        assert (got[k]["a_ids"], got[k]["b_ids"]) == (a, b)
        assert got[k]["a_last"] == [ends_a.index(x) for x in both] and got[k]["b_last"] == [ends_b.index(x) for x in both]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, a int")
    for f in (token_alignment.alignment_digests, token_alignment.pair_counts, token_alignment.aligned_groups):
        assert f(none, A, B).count() == 0


def test_probing_meets_every_common_end():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.5, 0.98):
        for n in (1, 2, 17, 400):
            a, b = (np.unique(np.append(np.flatnonzero(rng.random(n) < share) + 1, n)) for _ in "ab")
            if share == 0.98:  # long stretches at a shift, with irregular places between
                a, b = np.delete(np.arange(1, n + 1), rng.integers(0, n, n // 90)), np.arange(1, n + 1)
                a = np.unique(np.append(a, n))
            x, y = token_alignment.probe(a, b)
            assert a[x].tolist() == b[y].tolist() == np.intersect1d(a, b).tolist()
