"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskbook.llm import bpe, exact_dedup, html_text, license_scan, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_files
from riskbook.llm.units import UnitEncoder, bare_units, spaced_units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "a", "a  b", "Ünïcode   nbsp 日本", "x " * 50, "A<|endoftext|>b"]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    got = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in got]
    base = max(x[0] for x in out) + 1
    out += [(base + i, t, None, None) for i, t in enumerate(ODD)]
    out += [(base + 50, out[3][1], "en", "s"), (base + 51, out[3][1], "en", "s"), (base + 52, "word " * 30_000 + "end", "en", "s")]
    return [(*x, len(x[1] or "")) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash")).withColumn("t", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, none, rows):
    by = defaultdict(list)
    for d, t, *_ in rows:
        by[t or ""].append(d)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for d, t, *_ in rows if d == r["doc_id"])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(by[text]), len(by[text]), r["doc_id"] == max(by[text]))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == len(by)


def test_rows_of_one_doc_id_are_told_apart(spark):
    some = [(7, "a", 1), (7, "b", 2), (9, "a", 3), (None, "zzz", 4), (None, "b", 5), (9, "a", 3)]
    docs = spark.createDataFrame(some, "doc_id long, text string, `row.key` int")
    got = sorted((r["doc_id"] or -1, r["text_sha256"] == hashlib.sha256(b"a").hexdigest(), r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(-1, False, -1, 1, True), (-1, False, 7, 2, False), (7, False, 7, 2, True), (7, True, 9, 3, False), (9, True, 9, 3, True), (9, True, 9, 3, True)]
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in left.collect()) == [(-1, "zzz"), (7, "b"), (9, "a")]
    near = simhash.drop_near_copies(docs)
    assert near.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"]) for r in near.collect()) == [(-1, "zzz"), (7, "a"), (7, "b")]
    assert substring_dedup.cut_passages(docs).count() == 6


def test_fingerprints_collide_and_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: 5)
    texts = ["aa", "ab", "aa", "ac", "ab", "aa", "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs).collect()} == {k: max(i for i, t in enumerate(texts) if t == x) for k, x in enumerate(texts)}


def test_fingerprints_compose_and_collisions_are_told_apart(spark, monkeypatch):
    data = bytes(range(256)) * 1000
    h = [0, 0]
    for lane in (0, 1):
        for at in range(0, len(data), 777):
            part = np.frombuffer(data[at : at + 777], np.uint8)
            h[lane] = exact_dedup.combine(h[lane], at, exact_dedup.chunk_hash(part, lane), lane)
    assert exact_dedup.fingerprint(data) == h[0] << 31 | h[1]


def test_chunks_of_huge_texts_are_hashed_apart(spark):
    """Against the polynomial itself; texts of several chunks, repeated rows, and two that differ in one byte of the last."""
    size = exact_dedup.CHUNK
    body = "".join(chr(97 + k * k % 26) for k in range(3 * size + 77))
    rows = [(1, body), (2, body), (2, body), (3, body[:-1] + "~"), (None, body), (5, "short"), (6, "é" * (size // 2)), (7, "é" * (size // 2) + "x"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(exact_dedup.row_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["fp"]) for r in exact_dedup._prints(texts).collect())

    def plain(data):
        out = []
        for p, base in exact_dedup.LANES:
            h, power = 0, 1
            for c in data:
                h, power = (h + c * power) % p, power * base % p
            out.append(h)
        return out[0] << 31 | out[1]

    assert got == sorted((str(d), len((t or "").encode()), plain((t or "").encode())) for d, t in rows)
    groups = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {(1, 2, 4), (2, 2, 4), (None, 2, 4), (3, 3, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1), (8, 9, 2), (9, 9, 2)}


def bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, none, rows):
    prints = {d: bits(t) for d, t, *_ in rows}
    ids, root = sorted(prints), {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = simhash.near_groups(docs).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(d, f"{prints[d]:016x}", find(d)) for d in ids}
    assert simhash.near_groups(none).count() == 0


def test_anchors_reach_all_neighbours():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    home = simhash.homes(x)
    for k in range(300):
        y = x[k]
        for b in rng.choice(64, 2, replace=False):
            y ^= np.uint64(1 << int(b))
        assert home[k] in simhash.anchors(np.array([y]), 2)[1]


def passages(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))


def test_shared_passages_are_found_and_clean_documents_are_not(spark, none):
    rng = np.random.default_rng(5)
    shared = passages(rng, 60)
    edited = shared.split()
    edited[30] = "changed"
    texts = {1: passages(rng, 80) + " " + shared + " " + passages(rng, 40), 2: passages(rng, 200), 3: passages(rng, 30) + "\n" + " ".join(edited) + " " + passages(rng, 90), 4: shared, 5: passages(rng, 55), 6: passages(rng, 20) + " " + " ".join(shared.split()[:30]), 7: None, 8: ""}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], SCHEMA)
    got = substring_dedup.duplicate_spans(docs).collect()
    # a link goes to the first occurrence in a batch, so document 4 may be held against 3, which has all that 1 has
    assert {(3, 1)} <= {(r["doc_id"], r["ref_doc_id"]) for r in got} <= {(3, 1), (4, 1), (4, 3)}
    assert any((r["doc_id"], r["start"], r["end"]) == (4, 0, len(shared)) for r in got)
    for r in got:
        assert r["n_words"] >= 59 and r["similarity"] >= 0.9
        assert texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode().split()[0] in shared
    left = {r["doc_id"]: r["text"] for r in substring_dedup.cut_passages(docs).collect()}
    assert 4 not in left and left[1] == texts[1] and left[2] == texts[2] and len(left[3].split()) in range(119, 122) and left[6] == texts[6]
    assert substring_dedup.duplicate_spans(none).count() == 0


def test_chaining_takes_ordered_matches_apart():
    places, others = np.array([0, 30, 60, 5000, 30]), np.array([100, 130, 160, 170, 9000])
    chains = substring_dedup.chain(places, others)
    assert chains[0] == [0, 1, 2] and sorted(map(tuple, chains[1:])) == [(3,), (4,)]


@pytest.mark.parametrize("inserted, replaced", [(12, 0), (0, 12), (15, 5), (18, 18)])
def test_a_gap_inside_a_chain_is_bridged(inserted, replaced):
    rng = np.random.default_rng(9)
    a = passages(rng, 90).split()
    b = a[:45] + passages(rng, inserted).split() + a[45 + replaced :]
    left, right = passages(rng, 30).split(), passages(rng, 30).split()
    matches = 90 - replaced
    got = substring_dedup.align(left + a + right, right + b + left, [(30, 30), (35, 35), (100, 100 + inserted - replaced)], 50, 0.8)
    assert got == [(30, 120, 30, 120 + inserted - replaced, matches)]
    # below the similarity, the two halves are too short
    assert substring_dedup.align(a, a[:45] + passages(rng, 30).split() + a[45:], [(0, 0), (60, 90)], 50, 0.8) == []


def changed(rng, words, at):
    out = list(words)
    for k in at:
        out[k] = passages(rng, 1)
    return " ".join(out)


def test_seeds_find_passages_with_edits_anywhere(spark):
    rng = np.random.default_rng(11)
    texts, want = {}, []
    for k, (n, edits) in enumerate([(50, 2), (50, 4), (50, 10), (60, 5), (75, 6), (100, 10), (100, 20)] * 3):
        shared = passages(rng, n).split()
        even = [int((m + 0.5) * n / edits) for m in range(edits)]
        at = even if k < 14 else sorted(rng.choice(np.arange(3, n - 3), edits, replace=False).tolist())
        texts[2 * k] = passages(rng, 30) + " " + " ".join(shared) + " " + passages(rng, 30)
        texts[2 * k + 1] = passages(rng, 40) + " " + changed(rng, shared, at) + " " + passages(rng, 40)
        want.append((2 * k + 1, 2 * k, n))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], SCHEMA).repartition(3)
    got = {(r["doc_id"], r["ref_doc_id"]): r["n_words"] for r in substring_dedup.duplicate_spans(docs).collect()}
    assert got == {(d, r): n for d, r, n in want}


@pytest.mark.parametrize("inserted", [9, 25])
def test_a_partner_that_gives_no_span_hides_no_other(spark, inserted):
    rng = np.random.default_rng(13)
    for partitions in (1, 3):
        shared = passages(rng, 70).split()
        z = " ".join(shared[:35]) + " " + passages(rng, inserted) + " " + " ".join(shared[35:])
        # 1 has the passage broken, 2 has it plain, 3 has two parts of it, 4 is a copy of 2's
        rows = [passages(rng, 20) + " " + z, passages(rng, 10) + " " + " ".join(shared), " ".join(shared[:40]) + passages(rng, 60) + " ".join(shared[35:]), passages(rng, 30) + " " + " ".join(shared) + " " + passages(rng, 5)]
        docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(rows, 1)], SCHEMA).repartition(partitions, "doc_id")
        got = [(r["start"], r["end"]) for r in substring_dedup.duplicate_spans(docs).where("doc_id = 4").collect()]
        assert (min(got)[0], max(x[1] for x in got)) == (rows[3].index(shared[0]), rows[3].index(shared[-1]) + 6)


def test_license_scan_equals_sql(spark, docs, rows):
    import duckdb
    import pandas as pd

    mit = license_scan.TEMPLATES["MIT-permission"]
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n", mit)
    extra = [(10**6 + 2, f"/*\n{wrapped}\n\nother words\n*/", "en", "s", 0), (10**6 + 3, "Released under the MIT License.", "en", "s", 0), (10**6 + 3, "Released under the MIT License.", "en", "s", 0), (10**6 + 4, "One.\nReleased under\nthe MIT License. Two\n \nthree", "en", "s", 0)]
    extra += [(10**6, "Some words.\nReleased under the MIT License. Enjoy it", "en", "s", 0), (10**6 + 1, "the mit license was released under", "en", "s", 0)]
    documents = pd.DataFrame([(d, t) for d, t, *_ in rows] + [(x[0], x[1]) for x in extra], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    want = {tuple(x) for x in con.execute(license_scan.oracle()).fetchall()}
    got = license_scan.license_matches(spark.createDataFrame(rows + extra, SCHEMA)).select("doc_id", "licence", "dice", "n_passages", "passage").collect()
    assert {tuple(r) for r in got} == want and any(r["doc_id"] == 10**6 for r in got)
    by = {(r["doc_id"], r["licence"]): (r["dice"], r["n_passages"]) for r in got}
    assert by[10**6 + 2, "MIT-permission"][0] > 0.95 and by[10**6 + 3, "MIT"] == (1.0, 2) and by[10**6 + 4, "MIT"] == (1.0, 2)  # its paragraph too
    assert license_scan.license_matches(docs.limit(0)).count() == 0


def test_packing_covers_every_id_once(docs, none, rows):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t, *_ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, P.path("byte_bpe_50k.json")).collect():
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, ids in want.items():
        assert sorted(pieces[d])[0][0] == 0 and sum(n for _, n in pieces[d]) == len(ids)
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(pieces[d]), sorted(pieces[d])[1:]))
    padding = 0
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
        length = sum(n for _, n in parts)
        assert length <= 1024
        padding += packing.padded(length, 1024) - length
    assert padding == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_units_at_the_ends_of_texts_get_their_own_ids():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = ["word\n\n", "a word\n\n", "some !\n\n", "first one", "'s fine", "'ll do  ", "x\n\n\n y", "\n\nz", " \t", "tail \n", "9 lives\u3000\u3000", "more\u00a0\n\n", "'re", " 's", "a 's b\n\n"]
    got = UnitEncoder(P.path("byte_bpe_50k.json"), spaced_units).batch(texts)
    assert [x.tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name, units", [("byte_bpe_50k.json", spaced_units), ("word_bpe_49k.json", bare_units)])
def test_any_mix_of_signs_gets_the_librarys_ids(name, units):
    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(3)
    signs = ["a", "B", "\u00e9", ".", " ", "\n", ",", "'", "s", "ll", "3", "\u00b2", "\u0301", "\u00df", "\u65e5", " the", "\t", "!", "\x1c", "\x85", "J\u030c", "\0", "\u0130"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(3000)]
    got = UnitEncoder(P.path(name), units, most=500).batch(texts, end_id=2)
    assert [x.tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    long = " ".join(texts) * 30  # over several slices
    assert UnitEncoder(P.path(name), units).ids(long).tolist() == tokenizer.encode(long, add_special_tokens=False).ids


def test_base_counts():
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        marked = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
        lines = text.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)

    rng = np.random.default_rng(1)
    texts = ["", "a b c d e a b c d e", "x\nx\n\n\nx y\x1cz ***", *[" ".join(rng.choice(list("abc#"), 40)) + "\nline\nline" for _ in range(50)]]
    assert [quality_rules.base_counts(t) for t in texts] == [brute(t) for t in texts]


def brute_kneser_ney(texts, order):
    """log p(c | the order - 1 characters before) by plain dictionaries."""
    counts, docs = defaultdict(int), defaultdict(set)
    for t in texts:
        k = t
        t = chr(2) * (order - 1) + t
        for i in range(order - 1, len(t)):
            counts[t[i - order + 1 : i + 1]] += 1
            for j in range(1, order + 1):
                docs[t[i - j + 1 : i + 1]].add(k)
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = defaultdict(int)
        for g in levels[k + 1]:
            levels[k][g[1:]] += 1
    cut, totals, kept = {}, {}, {}
    for k, grams in levels.items():
        n1, n2, n3, n4 = (max(1, sum(v == j for v in grams.values())) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        cut[k] = [0, *(min(max(x, a), b) for x, a, b in zip(raw, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85)))]
        totals[k], kept[k] = defaultdict(int), defaultdict(float)
        for g, n in grams.items():
            totals[k][g[:-1]] += n
            if len(docs[g]) > 1 or k == 1:
                kept[k][g] = max(n - cut[k][min(n, 3)], 0.0)

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        total = totals[len(g)].get(g[:-1])
        if not total:
            return p(g[1:])
        back = 1 - sum(v for h, v in kept[len(g)].items() if h[:-1] == g[:-1]) / total
        return kept[len(g)].get(g, 0.0) / total + back * p(g[1:])

    return p


@pytest.mark.parametrize("most_bytes", [1 << 27, 0])
def test_perplexity_equals_brute_force(spark, most_bytes):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab c\u00e9"), rng.integers(1, 40))) for _ in range(40)] + ["", "abab", "zz\U0001f600a b", "\0a"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    p = brute_kneser_ney([t.replace("\0", "\uffff") for t in texts], 5)
    got = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.document_measures(docs, most_bytes=most_bytes).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        padded = chr(2) * 4 + t.replace("\0", "\uffff")
        want = -sum(np.log(p(padded[i : i + 5])) for i in range(len(t))) / len(t) if t else None
        assert got[k] == pytest.approx(want, abs=1e-4)
    letters = {c for t in texts for c in t.replace("\0", "\uffff")} | {"?"}
    for context in ("abab", "zz\U0001f600a", "????", chr(2) * 4):
        assert sum(p(context + c) for c in letters) == pytest.approx(1)


def test_long_texts_are_scored_in_parts(monkeypatch):
    text = "some words, then others. " * 50
    texts = [text, "a b", text[:300], ""]
    none = {"keys": np.zeros(0, np.uint64), "log_p": np.zeros(0, np.float32), "log_back": np.zeros(0, np.float32)}
    grams = quality_rules.Grams(texts, 5)
    keys = np.unique(np.concatenate(grams.grams))
    model = none | {"keys": keys, "log_p": -(keys % np.uint64(7)).astype(np.float32) - 1, "log_back": np.zeros(len(keys), np.float32)}
    whole = quality_rules.scores_of(texts, model, 5)
    monkeypatch.setattr(quality_rules, "GROUP", 100)
    monkeypatch.setattr(quality_rules.parts_of, "__defaults__", (100,))
    assert quality_rules.scores_of(texts, model, 5) == pytest.approx(whole)


def test_junk_is_rejected(spark, docs, none, rows):
    junk = spark.createDataFrame([(10**6, " ".join(f"Q{i}Z%7&X{i * 37 % 101}J" for i in range(200)), "en", "s", 0)], SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(junk)).collect()}
    assert not kept[10**6] and len(kept) == len(rows) + 1
    assert quality_rules.quality_verdicts(none).count() == 0


PAGE = """<html><head><title>T</title><script>x("</p>")</script></head><body><nav><ul><li><a href=a>Home</a></li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First  para<br><p>Second&nbsp;one.</p><div class="share">tweet</div></article><aside><p>Side</p></aside><footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(10**6, "u", PAGE), (10**6 + 1, None, None), (10**6 + 2, "u", "plain words")], pages.schema)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages.unionByName(extra)).collect()}
    assert got[10**6] == "Head & more\nFirst para\nSecond one." and got[10**6 + 1] == "" and got[10**6 + 2] == "plain words"
    for r in pages.limit(20).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        import html

        assert got[r["page_id"]] == "\n".join(html.unescape(x) for x in blocks if x)
    assert html_text.extract(pages.limit(0)).count() == 0
    twice = pages.limit(30).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    assert html_text.extract(twice.unionByName(twice)).count() == 60


def test_text_directly_in_the_body_stays(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    line = "The anchor of the thing was that other matter, and so it went on for a while."
    bare = f"<html><head><title>T</title></head><body>{line}<br>More of it. <b>{line}</b><p>{line}</p><div class=footer>foot</div><nav><a href=x>Home</a></nav>{line}</body></html>"
    extra = spark.createDataFrame([(10**6, "u", bare)], pages.schema)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages.unionByName(extra)).where("page_id = 1000000").collect()}
    assert got[10**6] == f"{line} More of it. {line}\n{line}\n{line}"


@pytest.mark.parametrize("mark", ["<a ", '<a "', "<!-- ", '<p class="x', "<", "<svg>", "</", "<div>", "<div></ul>", "<p>x", "<a b='", '<a =" >', "<select>", "&amp", "<li>"])
def test_pages_are_read_in_linear_time(mark):
    import time

    began = time.process_time()
    html_text.Page(mark * (1_000_000 // len(mark)))
    assert time.process_time() - began < 8


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 1 << 10), (200, 50)])
def test_bpe_round_trip(docs, none, rows, chunk, overlap):
    encoding = bpe.bpe_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk, overlap).collect()}
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    nameless = docs.sparkSession.createDataFrame([(None, "a b " * 200, 1), (None, None, 1)], "doc_id long, text string, row int")
    got = [(r["doc_id"], r["n_tokens"]) for r in bpe.round_trip(nameless, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk, overlap).collect()]
    assert sorted(n for _, n in got) == [0, len(encoding.encode_ordinary("a b " * 200))] and {d for d, _ in got} == {None}


def test_bpe_without_a_seam(spark):
    text = "a" * 500 + " " + "b" * 700 + "   \n" * 80
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)
    encoding = bpe.bpe_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 100, 20).first()
    assert got["ids_sha256"] == hashlib.sha256(np.array(encoding.encode_ordinary(text), "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(spark, docs, none, rows, kind, tmp_path):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    token_files.write_ids(docs, f"{tmp_path}/x", P.path("word_bpe_49k.json"), bare_units, 2, shards=3, kind=kind)
    got, start = {r["doc_id"]: r for r in token_files.document_digests(spark, f"{tmp_path}/x").collect()}, 0
    for d, t, *_ in sorted(rows):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write_ids(none, f"{tmp_path}/y", P.path("word_bpe_49k.json"), bare_units, 2)
    assert token_files.document_digests(spark, f"{tmp_path}/y").count() == 0


def test_votes_equal_brute_force():
    rng = np.random.default_rng(4)
    texts = [passages(rng, int(rng.integers(1, 60))) for _ in range(60)]
    model = quality_classifier.fit(quality_classifier.terms(texts[:40]), rng.integers(0, 2, 40).astype(float))
    vectors = quality_classifier.latent(model, quality_classifier.terms(texts[40:]))
    for v, got in zip(vectors, quality_classifier.vote(model, vectors, 5)):
        near = sorted(range(40), key=lambda k: -float(v @ model["vectors"][k]))[:5]
        w = [max(float(v @ model["vectors"][k]), 1e-3) ** 8 for k in near]
        assert got == pytest.approx(sum(a * model["labels"][k] for a, k in zip(w, near)) / sum(w), abs=1e-4)
    one = np.concatenate([quality_classifier.terms([t]) for t in texts])
    assert np.allclose(one, quality_classifier.terms(texts))


def test_classifier_on_held_out_labels(spark, none):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    assert quality_classifier.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality_classifier.quality_scores(docs.limit(5), labels.limit(0)).collect()} == {1.0}
    odd = spark.createDataFrame([(1, None, 1), (None, "", 1), (3, "x " * 200_000, 1), (3, "y", 1)], "doc_id long, text string, score int")
    assert quality_classifier.quality_scores(odd, labels).count() == 4
    assert quality_classifier.keep_quality(odd, labels).columns == odd.columns
