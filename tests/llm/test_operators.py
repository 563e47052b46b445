"""The ten operators beside brute force, on small tables with the odd cases: nulls, empty and long texts, ties, repeats."""

import collections
import hashlib
import math
import re
import textwrap
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nlimorph.llm import bpe, digests, langid, licenses, packing, quality_model, quality_rules, simhash, substrings, token_counts
from nlimorph.llm._shared import fold_of, materialize, scratch_dir
from nlimorph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, score double, chunk string"  # score and chunk clash with names used inside
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
draw = np.random.default_rng(5)
VOCABULARY = [w + x for w in ("ta", "ke", "no", "ri", "su", "lem", "por") for x in ("n", "sh", "", "vi", "qu", "or", "é", "ax")]


def prose(n):
    return " ".join(draw.choice(VOCABULARY, n))


PASSAGE = prose(60)
BASE = prose(400)
EDITED = BASE.split()
EDITED[200] = "changed"
TEXTS = [
    None, "", "   \n\t ", "!!! ... 123", "one", "One one ONE one", "日本語 text 🙂🙂", "<|endoftext|> inside <|startoftext|>", "a\x0bb\x85c\x1cd é ﬁ İ ß Σς", "don't WE'VE I'll 's 12 3.14",
    prose(50), prose(300) + "\n" + PASSAGE + "\n" + prose(40), prose(20) + " " + PASSAGE, BASE, BASE, " ".join(EDITED), prose(12_000), "x" * 5000, "und " * 80, "\n".join([prose(6)] * 5), "՘x a՘ 𿰻",
]
ROWS = [(k, t, "aa" if k % 2 else None, None, "c") for k, t in enumerate(TEXTS)] + [(None, BASE, None, 1.0, None), (13, BASE, "aa", None, "c"), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(ROWS, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return materialize(spark.createDataFrame([], SCHEMA), "docs")


def counted(rows):
    return collections.Counter(rows)


def test_token_counts(docs, empty, monkeypatch):
    tok = Tokenizer.from_file(WORD)
    want = counted((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)
    for size, met, tasks in ((1, 1 << 20, 256), (4096, 1 << 20, 256), (4096, 50, 1), (4096, 50, 0)):
        monkeypatch.setattr(token_counts, "SAMPLED_BYTES", met)
        monkeypatch.setattr(token_counts, "SAMPLED_TASKS", tasks)
        assert counted(tuple(r) for r in token_counts.token_counts(docs, WORD, frequent=size).collect()) == want
    assert token_counts.token_counts(empty, WORD).count() == 0
    words, lengths = token_counts._frequent_table(docs, WORD, "text", 20)
    assert [len(tok.encode(w, add_special_tokens=False).ids) for w in words.split(" ")] == list(lengths) or tasks == 0
    assert "Exchange" not in token_counts.token_counts(docs, WORD)._jdf.queryExecution().executedPlan().toString()


def test_token_counts_on_every_latin_character():
    tok, enc = Tokenizer.from_file(WORD), token_counts.RunEncoder(WORD)
    assert enc.latin
    for c in map(chr, range(256)):
        text = f"a{c}B1{c}{c}'s{c} {c}"
        assert np.frombuffer(enc.text(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(c)


def test_bpe_round_trip(docs, empty):
    tok = Tokenizer.from_file(BYTE)
    got = collections.defaultdict(set)
    for r in bpe.encode_decode(docs, BYTE).collect():
        got[r.doc_id].add((tuple(r.ids), r.decoded))
    want = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i].add((tuple(ids), tok.decode(ids, skip_special_tokens=False)))
    assert got == want
    row = bpe.encode_decode(docs.where("doc_id = 4"), BYTE, digests=True).first()
    assert row.decoded_sha256 == hashlib.sha256(b"one").hexdigest()
    assert bpe.encode_decode(empty, BYTE).count() == 0


def test_merges_on_repeated_letters_and_long_words():
    pairs, tok = bpe.BytePairs(BYTE), Tokenizer.from_file(BYTE)
    words = ["a" * n for n in range(1, 40)] + ["ab" * 20, "aab" * 9, "zzzzy", "x" * 3001, "aab" * 500, "".join(draw.choice(list("etaoinshr"), 2000)), "語" * 300 + "日本" * 200]
    want = [tok.encode(w, add_special_tokens=False).ids for w in words]
    raw = [w.encode() for w in words]
    for way in (pairs.merge_rounds, pairs.merge_by_rank):
        assert [np.frombuffer(x, "<u4").tolist() for x in way(raw)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in pairs.ids_of(words)] == want


def test_a_word_of_a_million_letters():
    pairs, tok = bpe.BytePairs(BYTE), Tokenizer.from_file(BYTE)
    word = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    began = time.perf_counter()
    got = pairs.ids_of([word])[0]
    assert time.perf_counter() - began < 30
    assert np.frombuffer(got, "<u4").tolist() == tok.encode(word, add_special_tokens=False).ids


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_of(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(docs, empty):
    prints = {plain_fingerprint(t, 3) for _, t, *_ in ROWS}
    group = least_of([(a, b) for a in prints for b in prints if bin(a ^ b).count("1") <= 3], prints)
    least = {}
    for i, t, *_ in ROWS:
        if i is not None:
            g = group[plain_fingerprint(t, 3)]
            least[g] = min(i, least.get(g, i))
    want = counted((i, f"{plain_fingerprint(t, 3):016x}", least.get(group[plain_fingerprint(t, 3)])) for i, t, *_ in ROWS)
    assert counted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [2048, 7])
def test_links_in_small_and_cut_groups(spark, monkeypatch, group):
    """Fingerprints close together, far apart and in chains; the same components if large anchors are cut."""
    monkeypatch.setattr(simhash, "GROUP", group)
    centre = [int(x) for x in draw.integers(0, 1 << 63, 12)]
    prints = set(centre)
    for c in centre:
        for n in range(25):
            prints.add(c ^ sum(1 << int(b) for b in set(draw.integers(0, 63, 1 + n % 5))))
    nodes = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = materialize(spark.createDataFrame([(n, n) for n in nodes], "node long, lo long"), "prints")
    edges = simhash.links(df, ["lo"], most=3)
    want = least_of([(a, b) for a in nodes for b in nodes if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3], nodes)
    got = {n: n for n in nodes} | {r.u: r.v for r in components(edges, "t").collect()}
    assert got == want


def test_covering_codes():
    for kind, within, most in (("hamming31", 1, 16), ("hamming31", 0, 1)):
        code = simhash.CoveringCode(kind, within)
        assert code.counts.max() == most
        blocks = draw.integers(0, 1 << code.n, 200).astype(np.uint64)
        row, anchor, home = code.anchors(blocks)
        far = np.bitwise_count(blocks[row] ^ anchor)
        assert (far <= code.radius + within).all() and (far[home] <= code.radius).all() and home.sum() == 200
        assert all(code._syndrome(int(a)) == 0 for a in anchor[:50])
        near = blocks ^ np.uint64(within)
        r2, a2, _ = code.anchors(near)
        met = set(zip(r2.tolist(), a2.tolist(), strict=True))
        assert all((r, a) in met for r, a in zip(row[home].tolist(), anchor[home].tolist(), strict=True))


def test_one_of_each(spark, docs, empty):
    base = prose(300).split()
    family = []
    for k in range(12):  # one word changed each: about five of three hundred shingles differ
        words = list(base)
        words[20 * k + 3] = f"new{k}"
        family.append(" ".join(words))
    apart = " ".join(base[:150]) + " " + prose(150)
    rows = [(100 + k, t) for k, t in enumerate([*family, family[3], apart, prose(300)])]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100, 113, 114}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(13) == 1 and 14 not in ids and 15 not in ids
    assert len([i for i in ids if i in (0, 1, 2)]) == 1
    assert simhash.one_of_each(empty).count() == 0


def near_groups(texts, shingle=5, similarity=0.8):
    """Groups of linked texts, every pair compared."""
    sets = [{" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (t.lower().split() for t in texts)]
    return least_of([(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])], range(len(sets)))


def edits_of(words, others, k, share):
    """Words replaced or deleted here and there, a block appended, put in front, cut off, replaced or moved."""
    n = len(words)
    few, block = max(1, int(n * share / 9)), int(n * share)
    at = sorted(draw.choice(n, few, replace=False).tolist())
    return [
        [others[i % len(others)] if i in at else w for i, w in enumerate(words)],
        [w for i, w in enumerate(words) if i not in at],
        words + others[:block],
        others[:block] + words,
        words[: n - block],
        words[: n // 2] + others[: block // 2] + words[n // 2 + block // 2 :],
        words[n // 3 :] + words[: n // 3],
    ][k]


def test_one_of_each_finds_every_kind_of_edit(spark):
    """Recall by kind of edit and band of similarity, of pairs at 0.8 or more."""
    rows, bands = [], {}
    while len(rows) < 1400:
        words, others = ([f"w{n}" for n in draw.integers(0, 1 << 30, size)] for size in (300, 100))
        kind = len(rows) // 2 % 7
        changed = edits_of(words, others, kind, float(draw.uniform(0.03, 0.22)))
        a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, changed))
        alike = len(a & b) / len(a | b)
        if alike >= 0.8 or kind == 6:
            bands[len(rows)] = (kind, int(alike * 20))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed))]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(bands) <= got
    found = collections.defaultdict(list)
    for k, band in bands.items():
        found[band].append(k + 1 not in got)
    assert all(np.mean(x) >= 0.9 for x in found.values()), dict(found)
    assert np.mean([x for xs in found.values() for x in xs]) > 0.995


@pytest.mark.parametrize(("least", "most"), [(20, 60), (2000, 4000)])
def test_one_of_each_finds_edits_of_short_and_long_texts(spark, least, most):
    """The same for short texts, where an edit takes a larger part of the shingles, and for long ones."""
    rows, bands = [], {}
    while len(rows) < 600:
        size = int(draw.integers(least, most))
        words, others = ([f"w{n}" for n in draw.integers(0, 1 << 30, n)] for n in (size, size // 3))
        changed = edits_of(words, others, int(draw.integers(7)), float(draw.uniform(0.01, 0.22)))
        a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words, changed))
        alike = len(a & b) / len(a | b)
        if 0.8 <= alike < 1:
            bands[len(rows)] = int(alike * 20)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed))]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = collections.defaultdict(list)
    for k, band in bands.items():
        found[band].append(k + 1 not in got)
    print({band: (len(x), round(float(np.mean(x)), 3)) for band, x in sorted(found.items())})
    assert set(bands) <= got and all(np.mean(x) >= 0.9 for x in found.values())
    assert np.mean([x for xs in found.values() for x in xs]) > 0.98


@pytest.mark.parametrize("group", [512, 8])
def test_one_of_each_equals_brute_force_on_families(spark, monkeypatch, group):
    """Large and small families, chains and strangers; the same if groups are cut into many parts."""
    monkeypatch.setattr(simhash, "VERIFY_GROUP", group)
    texts = []
    for size in (60, 25, 3, 1, 1):
        base = [f"w{n}" for n in draw.integers(0, 1 << 30, 200)]
        for k in range(size):
            words = list(base)
            for at in draw.integers(0, 200, k % 7):
                words[at] = f"new{draw.integers(1 << 30)}"
            texts.append(" ".join(words))
            if k % 5 == 4:  # each link of this chain is close to the one before
                base = [*base[12:], *(f"w{n}" for n in draw.integers(0, 1 << 30, 12))]
    want = near_groups(texts)
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == set(want.values())


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.u: r.v for r in components(df, "t").collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_digests(spark, docs, empty):
    at = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select("text", F.xxhash64("text").alias("h")).collect()}
    ids = sorted(((i is None, -(i or 0), at[t or ""], t or "", i) for i, t, *_ in ROWS))
    texts = [t for _, _, _, t, _ in ids]
    want = []
    for k, (_, _, _, t, i) in enumerate(ids):
        cut = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + texts[(k + 1) % len(ids)][:cut]).encode()).hexdigest()))
    got = digests.fingerprints(docs).collect()
    assert counted(tuple(r)[:3] for r in got) == counted(want)
    same = collections.defaultdict(set)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same[r.doc_id].add(r.fingerprint)
    assert same[13] == same[14] and same[1] == same[0] == {""}
    assert next(r for r in got if r.doc_id == 16).near_edited > 0.5
    assert next(r for r in got if r.doc_id == 16).near_next < 0.3
    assert digests.fingerprints(empty).count() == 0


def test_an_id_of_many_rows_is_dealt_to_many_ranges(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, id, if(id % 3 = 1, 5, null)) as doc_id", "concat('some text ', id) as text")
    got = digests.fingerprints(df)
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = [(r.doc_id, hashlib.sha256(digests.edited(r.text, rows[(k + 1) % len(rows)].text).encode()).hexdigest()) for k, r in enumerate(rows)]
    assert counted((r.doc_id, r.edited_sha256) for r in got.collect()) == counted(want)


def test_likeness_in_slices(monkeypatch):
    ranks = draw.permutation(digests.CLASSES)
    a, b = (digests.Digest.of(digests.windows_of(t.encode()), ranks) for t in (prose(30_000), prose(20_000)))
    whole = a.likeness(b)
    monkeypatch.setattr(digests, "SLICE", 3)
    assert len(a.counts) > 3 and a.likeness(b) == pytest.approx(whole, abs=1e-6)


def test_digest_ranks_and_edits():
    ranks = np.arange(digests.CLASSES)
    for t in filter(None, TEXTS):
        own = digests.windows_of(t.encode())
        changed = digests.edited(t, BASE).encode()
        kept = len(t[: len(t) - len(t) // 3].encode())
        a, b = digests.windows_after_edit(own, kept, changed), digests.windows_of(changed)
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
        assert digests.Digest.of(own, ranks).likeness(digests.Digest.of(own, ranks)) == 1.0


def test_digests_see_every_part_of_a_text():
    ranks, letters = draw.permutation(digests.CLASSES), np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    for n in [48, 60, 80, 100, 150, 250, 400, 1000, 5000] * 5:
        text, other = ("".join(draw.choice(letters, n)) for _ in range(2))
        own, cut = (digests.Digest.of(digests.windows_of(t.encode()), ranks) for t in (text, digests.edited(text, other)))
        assert str(own) != str(cut)
        assert own.likeness(cut) < 1 and (n < 80 or own.likeness(cut) > 0.45)
        front, back = (digests.Digest.of(digests.windows_of(t.encode()), ranks) for t in (other[:96] + text[96:], text[:-96] + other[-96:]))
        assert str(front) != str(own) != str(back)
    same_start = [digests.Digest.of(digests.windows_of(t.encode()), ranks) for t in ("x" * 5000, "x" * 40 + " yyyyyy" * 3, "x" * 71, "x" * 32 + "y" * 39)]
    assert len({str(d) for d in same_start}) == 3  # only the runs of one letter have equal windows


def plain_digest(text, ranks):
    """The digest of a text, window by window and span by span."""
    size = digests.WINDOW
    data = text.encode().ljust(size, b"\0")
    windows = [data[k : k + size] for k in range(len(data) - size + 1)]
    keys = []
    for w in windows:
        polynomial = 0
        for b in w:
            polynomial = (polynomial * 0x9E3779B97F4A7C15 + int(digests._BYTES[b])) % (1 << 64)
        entropy = int(digests._WHOLE) - sum(int(digests._GAIN[c]) for c in collections.Counter(w).values())
        kind = min(entropy * digests.CLASSES // int(digests._WHOLE), digests.CLASSES - 1)
        keys.append(int(ranks[kind]) << 57 | int(digests.mix64(np.array([polynomial], np.uint64))[0]) >> 7)
    span = min(digests.SPAN, max(1, len(keys) // digests.LEAST))
    chosen = list(dict.fromkeys(min(keys[k : k + span]) for k in range(len(keys) - span + 1)))
    chain = []
    for at in range(0, len(chosen), digests.PER_FILTER):
        bits = [0] * (digests.FILTER_BYTES * 8)
        for feature in digests.mix64(np.array(chosen[at : at + digests.PER_FILTER], np.uint64)).tolist():
            for k in range(digests.PROBES):
                bits[(feature >> 11 * k) % len(bits)] = 1
        chain.append((len(chosen[at : at + digests.PER_FILTER]), bits))
    return chain


def plain_likeness(a, b):
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if a == b:
        return 1.0
    total = 0.0
    for n, x in a:
        best = 0.0
        for _, y in b:
            chance, most = sum(x) * sum(y) / len(x), min(sum(x), sum(y))
            best = max(best, (sum(p & q for p, q in zip(x, y, strict=True)) - chance) / max(most - chance, 1e-6))
        total += n * min(best, 1.0)
    return min(1.0, total / sum(n for n, _ in a))


def test_digests_equal_plain_ones():
    ranks = draw.permutation(digests.CLASSES)
    texts = [t for t in TEXTS if t and len(t) < 3000] + ["x", "é" * 9, prose(700)]
    plain = [plain_digest(t, ranks) for t in texts]
    made = [digests.Digest.of(digests.windows_of(t.encode()), ranks) for t in texts]
    for want, got in zip(plain, made, strict=True):
        assert bytes(got) == b"".join(bytes([n]) + np.packbits(np.array(bits, np.uint8)).tobytes() for n, bits in want)
    for i in range(len(texts)):
        for j in range(len(texts)):
            if made[i].filters.shape != made[j].filters.shape or i <= j:
                assert made[i].likeness(made[j]) == pytest.approx(plain_likeness(plain[i], plain[j]), abs=1e-5)


def plain_measures(text):
    words = (text or "").encode().split()
    five = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = set()
    for k in range(len(words) - 4):
        if five[tuple(words[k : k + 5])] > 1:
            repeated |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(w.decode()) for w in words)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(10, 1), (11, 1), (13, 1), (16, 1), (18, 0), (None, 1), (10, None)], "doc_id long, quality int")
    trusted = quality_rules.trusted_ids(labels)
    got = quality_rules.apply_rules(docs, trusted, buckets=512).select("doc.doc_id", "doc.text", "m.*", "llr", "kept").collect()
    assert counted(tuple(r)[:1] + tuple(r)[2:8] for r in got) == counted((i, *plain_measures(t)) for i, t, *_ in ROWS)
    assert {r.doc_id for r in got if r.kept} >= {10, 11, 16} and not any(r.kept for r in got if r.base_failed)
    buckets = {t: buckets_of(spark, quality_words(t), 512) for t in {t for _, t, *_ in ROWS}}
    raw, target = collections.Counter(), collections.Counter()
    for i, t, *_ in ROWS:
        raw.update(buckets[t])
        target.update(buckets[t] if i in (10, 11, 13, 16) else ())
    ratios = [math.log((target[b] + 1) / (target.total() + 512)) - math.log((raw[b] + 1) / (raw.total() + 512)) for b in range(512)]
    assert quality_rules.log_ratios(docs, trusted, "doc_id", "text", 512) == pytest.approx(ratios, abs=1e-5)
    plain = {t: np.mean([ratios[b] for b in bs]) if bs else None for t, bs in buckets.items()}
    own = [plain[t] for i, t, *_ in ROWS if i in (10, 11, 13, 16)]
    limit = np.mean(own) - 4 * np.std(own, ddof=1)
    for r in got:
        assert r.llr == (None if plain[r.text] is None else pytest.approx(plain[r.text], abs=2e-5))
        assert r.kept == (not r.base_failed and plain[r.text] >= limit)
    assert quality_rules.apply_rules(empty, trusted).count() == 0
    assert quality_rules.apply_rules(docs, trusted.limit(0), buckets=64).where("kept").count() > 0


def test_an_id_of_many_labels_is_one_of_the_sample(spark):
    rows = [(7, 1)] * 10_000 + [(k, 1) for k in range(100, 148)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality_rules.trusted_ids(labels, limit=1000).collect()) == [7, *range(100, 148)]
    first = [r.doc_id for r in quality_rules.trusted_ids(labels, limit=10).collect()]
    ordered = labels.distinct().orderBy(F.xxhash64(F.lit("target"), "doc_id")).limit(10).collect()
    assert sorted(first) == sorted(r.doc_id for r in ordered)
    assert quality_rules.trusted_ids(labels.limit(0)).count() == 0


def test_all_trusted_rows_are_counted(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 5 < 3 as int) as quality")
    trusted = quality_rules.trusted_ids(labels)
    assert trusted.count() == 12_000  # before, 10,000
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('w', cast(id as string)) as text")
    ratios = quality_rules.log_ratios(docs, trusted, "doc_id", "text", 1)
    assert ratios == [round(math.log((12_000 + 1) / (12_000 + 1)) - math.log((20_000 + 1) / (20_000 + 1)), 5)]
    assert quality_rules.target_texts(docs, trusted, "doc_id", "text").count() == 12_000


def test_quality_sample_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(7, f"text {k} " + prose(5)) for k in range(10_000)] + [(k, "x " * 10 * k) for k in range(100, 148)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0), (7, 1)] * 500 + [(k, k % 2) for k in range(100, 148)], "doc_id long, quality int")
    cut, taken = quality_model.within_bytes, []
    monkeypatch.setattr(quality_model, "within_bytes", lambda sample, most: taken.append(cut(sample, most)) or taken[-1])
    for rows, size in ((6000, 1 << 28), (6000, 20_000), (20, 1 << 28), (6000, 0)):
        model = quality_model.train(df, labels, F.lit(True), sample_rows=rows, sample_bytes=size)
        assert len(quality_model.score(df.limit(3), model).collect()) == 3
    counts = [t.count() for t in taken]
    assert counts[0] == 49 and 0 < counts[1] < 49 and counts[2:] == [20, 0]
    assert taken[1].agg(F.sum(F.octet_length("_text"))).first()[0] <= 20_000


def quality_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def buckets_of(spark, words, buckets):
    """Buckets of words and neighbouring pairs, hashed one by one."""
    if not words:
        return []
    df = spark.createDataFrame(list(zip(words, [*words[1:], None], strict=True)), "a string, b string")
    one, two = F.xxhash64("a"), F.when(F.col("b").isNotNull(), F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))
    rows = df.select(F.pmod(one, F.lit(buckets)).alias("x"), F.pmod(two, F.lit(buckets)).alias("y")).collect()
    return [r.x for r in rows] + [r.y for r in rows if r.y is not None]


@pytest.mark.parametrize(("chunk", "bucket"), [(2 << 20, 2_000_000), (3000, 100)])
def test_substrings(docs, empty, monkeypatch, chunk, bucket):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "BUCKET_WORDS", bucket)
    split = [(i, (t or "").encode().split()) for i, t, *_ in ROWS]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in split for k in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = substrings.remove_repeats(docs)
    assert counted(tuple(r) for r in got.select("doc.doc_id", "n_words", "n_removed", "kept").collect()) == counted(want)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got.collect())
    assert got.select("doc.*").columns == docs.columns
    assert substrings.remove_repeats(empty).count() == 0


def plain_scan(text, least=0.8):
    """Best coefficient of every template over all runs of pieces and the whole text, without any short cut."""
    split = [w for w in (licenses.words_of(p) for p in re.split(licenses.PIECE_END, text or "")) if w]
    known = [set(licenses.pairs_of(t)) for _, t in sorted(licenses.TEMPLATES)]
    most = max(licenses.bounds(len(p), least)[1] for p in known)
    units = {frozenset(licenses.pairs_of(text or ""))}
    for a in range(len(split)):
        for b in range(a, len(split)):
            words = [w for p in split[a : b + 1] for w in p]
            if len(words) - 1 > most:
                break
            units.add(frozenset(f"{x} {y}" for x, y in zip(words, words[1:], strict=False)))
    best = [max((2 * len(u & p) / (len(u) + len(p)) for u in units), default=0) for p in known]
    names = [name for name, _ in sorted(licenses.TEMPLATES)]
    hits = [(-d, n) for d, n in zip(best, names, strict=True) if d >= least]
    return (len(hits), *((min(hits)[1], -min(hits)[0], ",".join(sorted({n for _, n in hits}))) if hits else (None, None, None)))


def test_licenses_in_long_texts(spark):
    """Runs of many pieces against the plain scan, and texts of some MB whose sentences all hold pairs of templates."""
    notices = [t for _, t in licenses.TEMPLATES]
    mixed = " ".join(f"the {prose(3)} of the software is {notices[k % len(notices)]} {prose(k % 5)}. In the {prose(2)}." for k in range(120))
    rows = [(1, mixed), (2, "MIT License\n" + "A license to the work. " * 200 + prose(40)), (3, "\n".join(notices * 3))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted(tuple(r) for r in got) == counted((i, *plain_scan(t)) for i, t in rows)
    dense = "MIT License\n\n" + f"the {prose(4)} of the software {prose(4)}. " * 2000
    long = "MIT License\n\n" + f"in the {prose(8)} to the {prose(6)}. " * 40_000 + "\nReleased under the BSD 3-Clause License.\n"
    began = time.monotonic()
    got = licenses.scan(spark.createDataFrame([(1, dense), (2, long)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_ids for r in got} == {1: "mit", 2: "bsd-3-clause,mit"}
    assert time.monotonic() - began < 120


def test_licenses(spark, empty):
    full = {name: "\n\n".join(t for n, t in licenses.TEMPLATES if n in (name, name.split("-")[0])) for name in ("mit", "bsd-3-clause", "isc", "apache-2.0", "gpl-3.0")}
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "released UNDER the mit license"), (3, None), (4, ""), (5, "Licensed under the Apache License, Version 2.0."), (5, "nothing here at all, only words of prose"), (None, "This work is licensed under the GNU General Public License, version 3. " + prose(50))]
    rows += [(6, prose(40) + ". Licensed under the Apache License,\nVersion 2.0. " + prose(40)), (7, prose(30) + ". Released under the BSD 3-Clause License. " + prose(30)), (8, "MIT License\n\n" + prose(30)), (9, "the license of the software is subject to a permission " * 30)]
    rows += [(10 + k, prose(80) + "\n\n" + "\n".join(textwrap.wrap(t, 60)) + "\n\n" + prose(60)) for k, t in enumerate(full.values())]
    rows += [(20, "Released under the MIT License.\n" * 300)]
    scanned = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = counted(tuple(r) for r in scanned)
    assert got == counted((i, *plain_scan(t)) for i, t in rows)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert got == counted(con.sql(licenses.scan_sql()).fetchall())
    assert {(r[0], r[2]) for r in got} >= {(1, "mit"), (2, "mit"), (5, "apache-2.0"), (3, None), (5, None), (6, "apache-2.0"), (7, "bsd-3-clause"), (8, "mit"), (9, None)}
    for r in scanned:
        if r.doc_id is not None and 10 <= r.doc_id < 15:
            assert list(full)[r.doc_id - 10] in r.license_ids.split(",")
    assert licenses.scan(empty).count() == 0


def test_language_id(spark, empty):
    words = {"aa": VOCABULARY, "bb": ["schl" + w for w in VOCABULARY], "cc": ["oui" + w[::-1] + "eaux" for w in VOCABULARY]}
    rows = [(k, " ".join(draw.choice(words[lang], 40)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(500, None, "aa"), (501, "12 !", "aa"), (502, "", None), (503, "schl" * 3, None), (None, words["bb"][3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, fold_of("doc_id", 4) != 2)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    held = [(k, lang) for k, _, lang in rows[:180] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and all(got[k][0] == lang for k, lang in held)
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert got[503][0] == "bb"
    none = langid.train(empty, fold_of("doc_id", 4) != 2)
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def plain_grams(text):
    """Four-letter n-grams one by one: letters in lower case, a run of others one space, a space at both ends."""
    letters = re.sub("\0+", " ", "".join(c if c.isalpha() else "\0" for c in f" {(text or '').lower()} "))
    return [letters[k : k + 4] for k in range(len(letters) - 3)] if any(c.isalpha() for c in letters) else []


def plain_shares(rows):
    """By text: share of its n-grams that each language's training texts hold, from sets."""
    known = collections.defaultdict(set)
    for i, t, lang in rows:
        if lang is not None and t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[lang].update(plain_grams(t))
    return {t: {lang: np.mean([g in held for g in plain_grams(t)]) if plain_grams(t) else 0.0 for lang, held in sorted(known.items())} for _, t, _ in rows}


def test_language_scores_are_those_of_plain_sets(spark):
    words = {"aa": VOCABULARY, "bb": ["schl" + w for w in VOCABULARY], "cc": [w + "q" for w in VOCABULARY]}
    rows = [(k, " ".join(draw.choice(words[lang], int(draw.integers(30, 300)))) + " 12, ", lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(300 + k, " ".join([*draw.choice(words["aa"], 60), *draw.choice(words["bb"], 60)]), None) for k in range(20)] + [(400, None, "aa"), (401, "?", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shares = plain_shares(rows)
    got = langid.predict(df, langid.train(df, fold_of("doc_id", 4) != 2), keep=("text",)).collect()
    sure = 0
    for r in got:
        best = sorted(shares[r.text].values())
        assert r.score == pytest.approx(best[-1] if plain_grams(r.text) else 0.0, abs=0.02)
        if best[-1] - best[-2] > 0.04:
            sure += 1
            assert r.lang_pred == max(shares[r.text], key=shares[r.text].get)
    assert sure > 90 and len(got) == len(rows)


def plain_buckets(text, buckets=8192):
    """Buckets of words and neighbouring pairs, hashed one by one in Python."""
    words = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
    pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(words, words[1:], strict=False)]
    return [(h - (1 << 64) if h >> 63 else h) % buckets for h in words + pairs]


def test_language_and_quality_stages(spark):
    """The first two stages of the pipeline keep what plain versions keep."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    shares = plain_shares(rows)
    best = {t: max(s.values()) for t, s in shares.items()}
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf).collect()}
    assert {r.doc_id for r in rows if best[r.text] > 0.53} <= kept <= {r.doc_id for r in rows if best[r.text] > 0.47}
    held = docs.where(F.col("doc_id").isin(sorted(kept)))
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    rows = [(r.doc_id, r.text) for r in held.collect()]
    grams = {i: plain_buckets(t) for i, t in rows}
    raw = collections.Counter(b for g in grams.values() for b in g)
    target = collections.Counter(b for i, g in grams.items() if i in labelled for b in g)
    ratio = {b: round(math.log((target[b] + 1) / (target.total() + 8192)) - math.log((raw[b] + 1) / (raw.total() + 8192)), 5) for b in raw}
    score = {i: np.mean([ratio[b] for b in g]) if g else None for i, g in grams.items()}
    own = [score[i] for i in score if i in labelled and score[i] is not None]
    limit = np.mean(own) - 4 * np.std(own, ddof=1)
    want = {i for i, t in rows if not plain_measures(t)[-1] and score[i] is not None and score[i] >= limit}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, held, sf).collect()} == want


def test_language_filter_has_no_false_negatives():
    hashes = draw.integers(0, 1 << 63, 3000).astype(np.uint64)
    f = langid.LanguageFilter.build(["a", "b"], {0: hashes[:2000], 1: hashes[1000:]}, 1 << 14, 3)
    found = f.languages_of(hashes)
    assert f.has(found, 0)[:2000].all() and f.has(found, 1)[1000:].all()
    assert np.mean(f.has(f.languages_of(draw.integers(0, 1 << 63, 20_000).astype(np.uint64)), 0)) == pytest.approx(f.expected[0], abs=0.02)


def test_more_than_64_languages(spark):
    names = [f"l{k:02d}" for k in range(70)]
    words = {n: [f"{chr(0x4E00 + 40 * k + j)}{chr(0x4E00 + 40 * k + j + 1)}" * 2 for j in range(30)] for k, n in enumerate(names)}
    rows = [(100 * k + j, " ".join(draw.choice(words[n], 12)), n) for k, n in enumerate(names) for j in range(2 if k == 3 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, fold_of("doc_id", 4) != 2)
    assert model.masks.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert np.mean([got[i] == n for i, _, n in rows if n in model.languages]) > 0.97


@pytest.mark.parametrize("shard", [2_000_000, 3_000])
def test_packing(docs, empty, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    tok = Tokenizer.from_file(WORD)
    want = counted((i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, *_ in ROWS)
    rows = packing.pack(docs, WORD, with_ids=True).collect()
    for r in rows:
        part = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(r.ids) == r.length
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    pieces = counted((i, len(x) // 4) for (i, x), n in want.items() for _ in range(n))
    assert {k: sum(r.length for r in v) for k, v in by_doc.items()} == {k: k[1] * n for k, n in pieces.items()}
    for (i, n), got in by_doc.items():
        if pieces[i, n] == 1:
            data = b"".join(np.array(r.ids, "<u4").tobytes() for r in sorted(got, key=lambda r: r.start))
            assert (i, data) in want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("sizes", [np.ones(200_000, np.int64), np.r_[np.ones(5000, np.int64), 3000, 2, 2, np.full(30_000, 2), 700, 1]])
def test_shards_of_very_short_texts(sizes):
    began = time.monotonic()
    whole, bare = np.flatnonzero(sizes > 1), np.flatnonzero(sizes == 1)
    own = sizes[whole]
    flat = np.concatenate([draw.integers(2, 50, own.sum() - len(own)), np.ones(len(own), np.int64)]).astype("<u4") if len(own) else np.empty(0, "<u4")
    windows = packing.fill(own, packing.Index(flat, own, np.full(60, 9), len(sizes), 2.0), 2048) if len(own) else []
    windows = packing.with_bare(windows, whole, bare, 2048)
    assert time.monotonic() - began < 20
    seen = collections.defaultdict(list)
    for w in windows:
        assert sum(p[2] for p in w) <= 2048
        for d, start, n in w:
            seen[d].append((start, n))
    assert all(sum(p[2] for p in w) == 2048 for w in windows[:-1])
    assert len(seen) == len(sizes)
    for d, pieces in seen.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == sizes[d]


def test_neighbours_are_given_by_falling_score():
    scores, unused = draw.integers(0, 9, 9000).astype(float), np.ones(9000, dtype=bool)
    unused[::7] = False
    given = []
    for part in packing.neighbours(scores, unused):
        unused[part] = False
        given += part
    assert len(given) == len(set(given)) == 9000 - len(range(0, 9000, 7))
    assert (np.diff(scores[given]) <= 0).all()


def test_neighbours_come_from_the_index():
    texts = [np.r_[np.full(100, t), np.arange(500 + 40 * k, 540 + 40 * k)] for k, t in enumerate([3, 4, 3, 4, 3, 4])]
    sizes = np.array([len(t) for t in texts])
    index = packing.Index(np.concatenate(texts), sizes, np.bincount(np.concatenate([np.unique(t) for t in texts])), 6, sizes.mean())
    windows = packing.fill(sizes, index, 420)
    assert {d for d, _, _ in windows[0]} == {0, 2, 4} and {d for d, _, _ in windows[1]} == {1, 3, 5}


def test_scores_are_those_of_plain_bm25():
    texts = [draw.zipf(1.3, 60 + 5 * k) % 300 for k in range(40)]
    sizes = np.array([len(t) for t in texts])
    docs = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=300)
    index = packing.Index(np.concatenate(texts), sizes, docs, 40, sizes.mean())
    assert len(index.frequent) and len(index.length)
    for seed in range(40):
        want = np.zeros(40)
        for d, text in enumerate(texts):
            for term in set(texts[seed].tolist()) & set(text.tolist()):
                tf = (text == term).sum()
                idf = np.log(1 + (40 - docs[term] + 0.5) / (docs[term] + 0.5))
                want[d] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[d] / sizes.mean()))
        assert index.scores(seed) == pytest.approx(want, rel=1e-5)


def test_documents_that_share_a_rare_word_share_a_shard(spark, monkeypatch):
    """Pairs with a word of their own among many shards: a random deal would join one pair in fifty."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 6_000)
    vocabulary = sorted((i, w) for w, i in Tokenizer.from_file(WORD).get_vocab().items() if w.endswith("</w>") and w[:-4].isalpha() and w.isascii() and len(w) > 9)
    own = [w[:-4] for _, w in vocabulary[-100:]]
    common = [w[:-4] for _, w in vocabulary[:50]]
    rows = [(2 * k + j, " ".join([*draw.choice(common, 400), own[k], *draw.choice(common, 50)])) for k in range(100) for j in (0, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORD).collect()
    assert len({r.sequence_id >> 33 for r in got}) > 4
    where = collections.defaultdict(set)
    for r in got:
        where[r.doc_id].add(r.sequence_id)
    assert np.mean([bool(where[2 * k] & where[2 * k + 1]) for k in range(100)]) > 0.4


def test_powers_of_two():
    parts = packing.powers_of_two([(0, 0, 700), (1, 5, 800)], 2048)
    assert [sum(p[2] for p in s) for s in parts] == [1024, 256, 128, 64, 16, 8, 4]
    assert parts[0] == [(0, 0, 700), (1, 5, 324)]


def test_quality_classifier(spark, empty):
    rows = [(k, prose(60) if k % 3 else " ".join(w + "%%%" for w in prose(40).split()), int(k % 3 > 0)) for k in range(400)]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (None, "one")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_model.train(df, labels, fold_of("doc_id", 3) != 1)
    got = {r.doc_id: (r.score, r.predicted) for r in quality_model.score(df, model).collect()}
    held = [(k, q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([got[k][1] == q for k, q in held]) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    assert got[900] == got[901]
    nothing = quality_model.train(df, labels.limit(0), fold_of("doc_id", 3) != 1)
    assert {r.score for r in quality_model.score(df, nothing).collect()} == {0.5}
    assert quality_model.score(empty, model).count() == 0


def test_quality_scores_are_calibrated():
    """Labels that hold only three times in four: scores near their frequency, on texts never seen."""
    texts = [prose(40) if k % 2 else " ".join(w + "##" for w in prose(40).split()) for k in range(3000)]
    y = np.array([int(draw.random() < (0.75 if k % 2 else 0.25)) for k in range(3000)])
    model = quality_model.fit(texts[:1500], y[:1500])
    got = model.scores(texts[1500:], quality_model.Rows())
    bins = np.clip((got * 10).astype(int), 0, 9)
    error = sum(abs(got[bins == b].mean() - y[1500:][bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    assert error < 0.1
    sure = quality_model.temperature_of(np.array([30.0, -30.0] * 50), np.array([1, 0] * 50))
    assert 1 / (1 + np.exp(-30 / sure)) == pytest.approx(51 / 52, abs=0.01)


def test_scratch_folder_is_the_session_s(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_target_texts_shuffle_few_others_at_any_size(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(spark.sql("select cast(null as bigint) as doc_id, 'none' as text")).unionByName(docs.where("doc_id < 10"))
    for n in (3, 7_000):
        trusted = spark.range(n).select((F.col("id") * 2).alias("doc_id")).union(spark.sql("select -5L"))
        texts = quality_rules.target_texts(docs, trusted, "doc_id", "text")
        plan = texts._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan  # few ids or many: what is shuffled grows with the input
        assert sorted(r[0] for r in texts.collect()) == sorted(r.text for r in docs.join(trusted, "doc_id", "left_semi").collect())
        ids = trusted.select(F.col("doc_id").alias("_id"))
        near = quality_rules.near_trusted(docs.select(F.col("doc_id").alias("_id"), "text"), ids)
        assert texts.count() <= near.count() <= texts.count() + 40


def test_used_documents_are_left_out():
    """Postings of used documents are dropped on the way; before, every seed was scored against them too."""
    r = np.random.default_rng(5)
    texts = [r.integers(0, 300, r.integers(5, 60)) for _ in range(200)]
    sizes, docs = np.array([len(t) for t in texts]), np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=300)
    made = [packing.Index(np.concatenate(texts), sizes, docs, 200, sizes.mean()) for _ in range(3)]
    unused = r.random(200) < 0.4
    made[1].leave_out(unused)
    assert len(made[1].doc) < len(made[0].doc) / 2
    for seed in range(200):
        assert (made[1].scores(seed)[unused] == made[0].scores(seed)[unused]).all()
    held = len(made[2].doc)
    windows = packing.fill(sizes, made[2], 256)
    assert len(made[2].doc) < held
    made[0].leave_out = lambda unused: None
    assert windows == packing.fill(sizes, made[0], 256)
    assert packing.distinct(np.array([3, 1, 3, 2], dtype="<u2")).tolist() == [1, 2, 3]
