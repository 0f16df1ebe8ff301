"""The training-data operators against brute force, the tokenizers library, round trips and held-out scores."""

import collections
import hashlib
import math
import os
import random
import re
import struct
import sys
import tracemalloc
import types
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fanframe.llm import bpe, chat, maxent, media, minhash, packing, pii, quality, queries, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "stone", "river", "cold", "alpha", "beta", "winter", "lamp", "sailing"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    base = prose(rng, 200)
    out += [base] * 5 + [base.replace("river1 ", "x ") + " end"] + [base[:900] + prose(rng, 60)]
    out += [None, "", "", " \n\t", "a" * 5000, "word " * 400, "mail bob.smith@example.com or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.300, 10.0.0.30", "é中😀" * 30, "\x00 nul <|endoftext|> </turn>"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(t):
    return (t or "").encode()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_near_duplicates(docs, texts, empty):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := raw(t).split()) else collections.Counter() for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            common, total = sum((a & bags[j]).values()), sum((a | bags[j]).values())
            if raw(texts[i]) == raw(texts[j]) or total and common >= 0.8 * total:
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in range(len(texts))}
    assert minhash.near_duplicates(empty).count() == 0


def test_no_link_of_a_crowded_bucket_is_lost(spark, monkeypatch):
    """All texts share one bucket and no other, so neighbours meet few of the pairs."""
    monkeypatch.setattr(minhash, "BLOCK", 64)  # shingles of many members are dealt
    monkeypatch.setattr(minhash, "bands", lambda texts: [np.array([0, *(zlib.crc32(t) + (k << 32) for k in range(1, minhash.BANDS)), max(1, len(t.split()) - 4)]) for t in texts])
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(300)]
    texts += [t + " end" for t in texts[:40]]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i in range(340)}


def test_one_large_group_of_near_copies(spark):
    """A chain of edits: neighbours are alike, the ends are not; it lies in shared buckets with unlike texts."""
    rng = random.Random(21)
    word, texts = prose(rng, 120).split(), []
    for k in range(400):
        word[k * 7 % 120] = f"new{k}"
        texts.append(" ".join(word))
    texts += [prose(rng, 120) for _ in range(100)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {i: 0 if i < 400 else i for i in range(500)}


def test_near_duplicates_of_odd_rows(spark):
    """Null and repeated ids, one id for two texts, null and repeated texts, and columns with the names used inside."""
    rng = random.Random(22)
    a, b, c = prose(rng, 100), prose(rng, 100), prose(rng, 100)
    rows = [(5, a), (3, a + " end"), (None, a + " fin"), (7, b), (7, c), (7, c), (None, b), (8, None), (9, ""), (None, "only here, twice"), (None, "only here, twice")]
    names = ["first_id", "h1", "h2", "class_id", "f_1", "id", "n", "codes", "Text2"]
    table = spark.createDataFrame([(i, t, *[k] * len(names)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {', '.join(x + ' int' for x in names)}")
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(table).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (7, 7), (7, 7), (None, 7), (8, 8), (9, 8), (None, None), (None, None)], key=str)
    kept = minhash.first_of_classes(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a + " end"), (7, b), (7, c), (8, None), (None, "only here, twice")], key=str)


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(1), []
    for _ in range(150):
        items = rng.integers(0, 2**63, 50).astype(np.uint64)
        a = rng.integers(1, 9, 50)
        b = np.maximum(1, a + rng.integers(-3, 3, 50))
        s = minhash.signatures(np.tile(items, 2), np.concatenate([a, b]), np.repeat([0, 1], 50), 2)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.012


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_personal_data(spark, docs, texts, empty):
    rng = random.Random(2)
    noise = ["".join(rng.choice("aB12 -.@+()é") for _ in range(rng.randrange(90))) for _ in range(400)]
    every = [*texts, *noise, "1 " * 20_000, "a@b." + "c." * 9000 + "d", "9" * 30_000]
    table = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest_spans(table).collect()}
    for i, t in enumerate(every):
        found = [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t or "") if passes(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest(), i
        assert set(found) <= set(got[i].spans.split(",")) if found else True
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all((clean[i] == t) == (not got[i].spans) for i, t in enumerate(texts) if t)
    assert pii.digest_spans(empty).count() == 0


def test_redaction_follows_the_spans(spark):
    """Every span found on the input goes, overlapping ones as one; marks and wide letters around them stay."""
    rng = random.Random(17)
    noise = ["".join(rng.choice(["a@b.c", "aB12", " ", "-", "+4930", "1.2.3.4", "é", "\U0001f600", "4111 1111 1111 1111"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    every = ["+33.6.12.34.56.78", "+4111 1111 1111 1111", "\ufeffbob@example.com\ufeff x", "a@b.c " * 3000, None, "", "nothing", *noise]
    table = spark.createDataFrame([(i, t, i) for i, t in enumerate(every)], "doc_id long, text string, spans int")
    found, clean = {r.doc_id: r.spans for r in pii.digest_spans(table).collect()}, {r.doc_id: r.text for r in pii.redact(table).collect()}
    for i, t in enumerate(every):
        ranges: list[list] = []
        for s, e, k in sorted((int(x.split(":")[1]), -int(x.split(":")[2]), list(pii.KINDS).index(x.split(":")[0])) for x in found[i].split(",") if x):
            if ranges and ranges[-1][1] > s:
                ranges[-1][1] = max(ranges[-1][1], -e)
            else:
                ranges.append([s, -e, pii.KINDS[k].upper()])
        want = t
        for s, e, kind in reversed(ranges):
            want = want[:s] + f"<{kind}>" + want[e:]
        assert clean[i] == want, (i, t)
    assert clean[0] == "<PHONE>" and clean[4] is None


def test_reliabilities_by_brute_force():
    """Expectation-maximisation ranks a labeler that is right above one that guesses, and the posterior is Bayes' rule."""
    rng, table = random.Random(5), collections.Counter()
    for _ in range(4000):
        true = rng.random() < 0.5
        vote = lambda p: 1 if (rng.random() < p) == true else -1
        table[4, (vote(0.95), vote(0.9), vote(0.85), vote(0.6), 0), 0] += 1
    rows = [(k, v, f, n) for (k, v, f), n in table.items()]
    right, post = pii.reliabilities(rows)
    assert all(abs(r - want) < 0.05 for r, want in zip(right, (0.95, 0.9, 0.85, 0.6), strict=False))
    for (k, v), p in post.items():
        odds = math.prod((r / (1 - r)) ** x for r, x in zip(right, v, strict=True))
        assert p == pytest.approx(odds / (1 + odds), abs=0.03)


def test_quality(docs, texts, empty):
    for r in quality.digest_quality(docs).collect():
        t, w = texts[r.doc_id] or "", words(texts[r.doc_id])
        n = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.digest_quality(empty).count() == 0


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 120) if i % 20 else "### " * 30 + prose(rng, 60) + " $$$" * 60, "en", "s", 0) for i in range(200)]
    got = {r.doc_id: r.kept for r in quality.digest_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept == bool(i % 20) for i, kept in got.items())


def test_moderate_outliers_go(spark):
    """Two symbols in five words: far from a group without any."""
    rng = random.Random(14)
    rows = [(i, prose(rng, 120) if i % 20 else " ".join(w + " #" * (k % 5 < 2) for k, w in enumerate(prose(rng, 120).split())), "en", "s", 0) for i in range(200)]
    got = {r.doc_id: r.kept for r in quality.digest_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept == bool(i % 20) for i, kept in got.items())


def test_estimates_by_brute_force(spark):
    """One group with 40 % of two kinds of outliers: the verdicts are those of the best of 300 random starts."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (200, 4)) * (0.3, 0.2, 0.25, 0.3) + (1.5, 1, 1, 0.6)
    x[:, 1] += 0.5 * x[:, 0]
    x[:50] += (1.0, -2.0, 1.5, 0.0)
    x[50:80] = (3.0, 3.0, 0.1, 1.4) + rng.normal(0, 0.02, (30, 4))
    rows = spark.createDataFrame([("en", "s", i % quality.SALTS, *map(float, r)) for i, r in enumerate(x)], "lang string, source string, salt int, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    (est,) = quality.fit(rows).collect()
    factor = np.array([[est[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    far = (np.linalg.solve(factor, (x - [est[f"m{i}"] for i in range(4)]).T) ** 2).sum(0)
    best = None
    for _ in range(300):
        inner = x[rng.choice(200, 6, replace=False)]
        for _ in range(20):
            mean, cov = inner.mean(0), np.cov(inner.T, bias=True) + np.diag(np.square(quality.FLOORS))
            d = (np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T) ** 2).sum(0)
            inner = x[np.argsort(d)[:100]]
        if best is None or np.linalg.det(cov) < best[0]:
            best = np.linalg.det(cov), d / max(1, np.median(d) / quality.CHI_MEDIAN)
    assert ((far > quality.CUTOFF) == (best[1] > quality.CUTOFF)).mean() > 0.98 and (far[:80] > quality.CUTOFF).all()


def test_quality_of_odd_rows(spark):
    """Null ids, groups of one row, groups without a good row, a long text, and columns with the names used inside."""
    rng = random.Random(31)
    good = [prose(rng, 100) for _ in range(30)]
    rows = [(None, good[0], None, None), (None, good[0], None, None), (1, None, "en", "only nulls"), (2, "word " * 50_000, "en", "long"), *((3 + i, t, "en", "s") for i, t in enumerate(good)), (50, "### " * 300 + prose(rng, 60), "en", "one row")]
    names = ["salt", "far", "half", "t", "w", "m0", "start", "kept"]
    table = spark.createDataFrame([(*r, *[0] * len(names)) for r in rows], f"doc_id long, text string, lang string, source string, {', '.join(x + ' int' for x in names)}")
    got = quality.digest_quality(table).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and kept[None] and not kept[1] and not kept[2] and not kept[50] and all(kept[3 + i] for i in range(30))


def test_outliers_of_small_groups_go(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, 120) if i % 20 else "### " * 30 + prose(rng, 60) + " $$$" * 60, "en", f"s{i % 13}", 0) for i in range(200)]
    got = {r.doc_id: r.kept for r in quality.digest_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept == bool(i % 20) for i, kept in got.items())


def test_shards(docs, texts, empty):
    got = sharding.shard_documents(docs).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) == (len(raw(texts[r.doc_id])) + 1, zlib.crc32(raw(texts[r.doc_id])))
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(empty).count() == 0


def test_one_text_for_all(spark):
    got = sharding.shard_documents(spark.createDataFrame([(i, "same", "en", "s", 4) for i in range(100)], SCHEMA)).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16


def test_byte_pairs(docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.load(path), random.Random(1)
    letters = [chr(k) for k in range(0x250)] + list("aabcd  'st\n12.") * 20
    every = [*[t or "" for t in texts], *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)), "ab" * 700]
    for t, e in zip(every, library.encode_batch(every, add_special_tokens=False), strict=True):
        ids = own.encode(t)
        assert ids.tolist() == e.ids and own.decode(ids).decode() == t and own.spelled(ids) == ",".join(map(str, e.ids)).encode()
    assert {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, path), path).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digest_documents(empty, path).count() == 0


def test_media(spark, docs, texts, empty):
    for r in media.digest_media(media.store_documents(docs)).collect():
        payload = media.padded(raw(texts[r.doc_id]))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0 and r.feature.endswith("error=")
    assert media.digest_media(media.store_documents(empty)).count() == 0
    whole = media.store(bytes(range(256)) * 40)
    for cut in range(0, len(whole), 37):
        media.probe(whole[:cut])  # cut short, never raises
    rng = random.Random(3)
    for _ in range(300):
        data = bytearray(whole)
        data[rng.randrange(len(whole))] = rng.randrange(256)
        for t in media.probe(bytes(data))[0]:
            t.handler
    table = spark.createDataFrame([("a", whole), ("b", None)], "k string, data binary")
    got = {r.key: r for r in media.probe_column(table, "k", "data").collect()}
    assert got["a"].tracks[0].n_samples == 160 and len(got["a"].tracks[0].keyframes) == 10 and got["b"].tracks == []


def fragmented(base_is_moof):
    """A movie without samples of its own and two fragments of two runs each, and the expected samples of its track."""
    box = lambda kind, *parts: struct.pack(">I4s", sum(map(len, parts)) + 8, kind) + b"".join(parts)
    full = lambda kind, flags, *numbers: box(kind, struct.pack(f">{len(numbers) + 1}I", flags, *numbers))
    track = box(b"trak", full(b"tkhd", 7, 0, 0, 9, 0, 0), box(b"mdia", full(b"mdhd", 0, 0, 0, 1000, 0, 0), full(b"hdlr", 0, 0, int.from_bytes(b"vide"), 0, 0, 0)))
    data = box(b"ftyp", b"iso6" + bytes(4)) + box(b"moov", box(b"mvex", full(b"trex", 0, 9, 1, 40, 7, 0x10000)), track)
    want = []
    for k in range(2):
        sizes = [11 + k, 5, 3]

        def moof(offset):
            first = full(b"trun", 0x1 | 0x4 | 0x200, 3, offset, 0, *sizes)  # noqa: B023
            second = full(b"trun", 0x100 | 0x400, 2, 33, 0, 34, 0x10000)  # sizes by default, right behind
            return box(b"moof", full(b"mfhd", 0, 1), box(b"traf", full(b"tfhd", 0x20000 * base_is_moof, 9), first, second))

        head = moof(len(moof(0)) + 8)
        at = len(data) + len(head) + 8
        for size, time, key in zip([*sizes, 7, 7], [40, 40, 40, 33, 34], [True, False, False, True, False], strict=True):
            want.append((at, size, time, key))
            at += size
        data += head + box(b"mdat", bytes(sum(sizes) + 14))
    return data, want


@pytest.mark.parametrize("base_is_moof", [0, 1])
def test_media_fragments(base_is_moof):
    data, want = fragmented(base_is_moof)
    (track,), error = media.probe(data)
    assert error == "" and track.handler == "vide" and track.total() == sum(w[2] for w in want)
    assert list(zip(*(x.tolist() for x in track.samples()), strict=True)) == [w[:2] for w in want]
    assert [tuple(k) for k in track.keyframes().tolist()] == [w[:2] for w in want if w[3]]
    for cut in range(len(data)):
        for t in media.probe(data[:cut])[0]:
            t.keyframes()
    rng = random.Random(8)
    for _ in range(2000):
        broken = bytearray(data)
        broken[rng.randrange(len(data))] = rng.randrange(256)
        for t in media.probe(bytes(broken))[0]:
            t.keyframes()


def test_media_states_broken_counts():
    whole = media.store(bytes(640))
    at = whole.index(b"stsz") + 12
    tracks, error = media.probe(whole[:at] + b"\x7f" + whole[at + 1 :])
    assert error == "stsz counts more samples than the file has bytes" and len(tracks[0].samples()[0]) == 0


def test_odd_rows_of_all_others(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows, and columns with the names used inside."""
    texts = [(None, "mail a@b.cd"), (1, None), (1, ""), (1, "c d"), (1, "c d"), (None, "mail a@b.cd"), (2, "long word " * 60_000), (3, "c d")]
    names = ["kind", "start", "end", "spans", "n", "size", "shard", "slot", "law", "ids", "media", "n_bytes", "block", "bucket", "minimum", "k", "b", "linked", "t", "h1", "id"]
    table = spark.createDataFrame([(i, t, *[k] * len(names)) for k, (i, t) in enumerate(texts)], f"doc_id long, text string, {', '.join(x + ' int' for x in names)}")
    ids = sorted(str(i) for i, _ in texts)
    byte_path = public_tokenizers.path("byte_bpe_50k.json")
    found = {
        "pii": pii.digest_spans(table),
        "shards": sharding.shard_documents(table),
        "tokens": bpe.digest_documents(table, byte_path),
        "media": media.digest_media(media.store_documents(table)),
        "substrings": substrings.digest_substrings(table),
    }
    got = {k: v.collect() for k, v in found.items()}
    for name, rows in got.items():
        assert sorted(str(r.doc_id) for r in rows) == ids, name
    sizes = sorted(len(raw(t)) for _, t in texts)
    assert sorted(r.n_bytes for r in got["media"]) == sorted(r.n_bytes for r in got["substrings"]) == sizes == sorted(r.size - 1 for r in got["shards"])
    assert [r.n_email for r in got["pii"] if r.doc_id is None] == [1, 1] and sum(r.n_email for r in got["pii"]) == 2
    library = Tokenizer.from_file(byte_path)
    assert sorted(r.n_tokens for r in got["tokens"]) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts)
    assert len({(r.shard, r.slot) for r in got["shards"]}) == len(texts)
    chats = table.selectExpr("doc_id conv_id", "k turn", "'user' role", "text", *[c for c in names if c != "k"])
    assert sum(r.n_turns for r in chat.read_back(chat.render_turns(chats)).collect()) == len(texts)
    kept = substrings.remove_substrings(table)
    assert kept.columns == table.columns and kept.count() == len(texts)
    assert pii.redact(table).columns == table.columns


def test_chat(spark):
    rng = random.Random(6)
    parts = ["\\", "### ", "</turn>\n", "</turn>", ": ", "assistant", "a", "\n", "é", "\\\\", "#", "<"]
    for _ in range(2000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(2))
        assert [x[:2] for x in chat.parse(chat.render_turn(role, text) * 2)] == [(role, text)] * 2
    rows = [(1, 1, "assistant", "hi\\ </turn>\n"), (1, 0, "user", None), (1, 2, None, "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", "hi\\ </turn>\n")]
    got = {r.conv_id: r for r in chat.read_back(chat.render_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    said = "hi\\ </turn>\n"
    turns = f"user\n\nassistant\n{said}\nassistant\n{said}\n\nx\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_chars == 2 * len(said) and got[1].loss_sha256 == hashlib.sha256((said * 2).encode()).hexdigest()
    assert got[None].loss_chars == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    with duckdb.connect() as con:
        for table in ("conversations", "documents"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(200):
        k = int(rng.choice([1, 2, 3, 20]))
        t = np.append(rng.integers(1, k + 1, int(rng.integers(1, 150))), 0).astype(np.int16)
        assert substrings.suffix_array(t, k + 1).tolist() == sorted(range(len(t)), key=lambda i: t.tolist()[i:])


@pytest.mark.parametrize("block", [500, 1 << 22])
def test_substrings(docs, texts, empty, block, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    first, got = {}, {r.doc_id: r for r in substrings.digest_substrings(docs).collect()}
    left = {r.doc_id: r.text for r in substrings.remove_substrings(docs).collect()}
    for i, t in enumerate(map(raw, texts)):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
        assert left[i] == (None if texts[i] is None else kept.decode("utf-8", "ignore"))
    assert substrings.digest_substrings(empty).count() == 0


def test_runs_of_joined_texts():
    rng = np.random.default_rng(1)
    texts = [rng.choice(np.frombuffer(b"abcd ", np.uint8), n).tobytes() for n in (0, 49, 10, 50, 51, 0, 49, 300, 40_000, 3, 75, 20_000, 20_000, 48)]
    value, text, first, last = substrings.runs(texts)
    for k, t in enumerate(texts):
        m, own = substrings.minima(t), text == k
        opens = [i for i in range(len(m)) if not i or m[i] != m[i - 1]]
        assert first[own].tolist() == opens and last[own].tolist() == [*[i - 1 for i in opens[1:]], *[len(m) - 1] * bool(opens)]
        assert (value[own] == m[opens] * substrings.ODD[0]).all()


def test_pieces_are_handled_in_arrays_and_dealt_evenly():
    rng = np.random.default_rng(2)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)
    text = rng.choice(letters, 60_000).tobytes().decode()
    table = pa.table({"doc_id": [1, 2], "text": [text, text], "block": pa.array([0, 0], pa.int32())})
    shared = substrings._find_shared(substrings._list_minima(8)(table))
    calls, send = collections.Counter(), substrings._send_pieces(8, 8)
    substrings._answer(send(table, shared).slice(0, 1))  # imports
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        sent = send(table, shared)
        substrings._answer(sent.filter(pc.equal(sent.column("shard"), 0)))
    finally:
        sys.setprofile(None)
    pieces = [len(m) // 8 for m in sent.column("minimum").to_pylist()]
    assert sum(pieces) > 3000 and calls.total() < sum(pieces) / 2
    assert len(pieces) == 8 and max(pieces) < 1.5 * min(pieces)


@pytest.mark.parametrize("block", [500, packing.BLOCK_TOKENS])
def test_packing(docs, texts, empty, block, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    library = Tokenizer.from_file(path)
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(docs, path).collect():
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]]).tolist()[:-1] and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for parts in filled.values():
        parts.sort()
        size = sum(n for _, n in parts)
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]]).tolist()[:-1]
        assert size <= 2048 and size & (size - 1) == 0  # no padding at all
    assert packing.pack_documents(empty, path).count() == 0


def test_least_squares_fill_windows():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 4000)
    groups, loose = packing.plan(lengths, 2048)
    assert all(lengths[g].sum() == 2048 for g in groups)
    assert sorted([m for g in groups for m in g] + loose.tolist()) == list(range(4000))
    assert len(groups) > 1000 and len(loose) < len(lengths) / 2  # most documents stay whole


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_most_documents_are_placed_by_the_solution():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    lengths = np.array([len(p) // 4 + 1 for p in packing.encoder(public_tokenizers.path("word_bpe_49k.json")).encode([raw(t) for t in texts])])
    groups, _ = packing.plan(lengths % 2048, 2048)
    assert sum(map(len, groups)) > 0.75 * len(texts)
    pieces = packing.pack(lengths)
    whole = np.bincount(pieces[:, 0]) == np.maximum(1, -(-lengths // 2048))
    assert whole.mean() > 0.98 and pieces[:, 2].sum() == lengths.sum()


def test_combinations_are_all_and_solutions_fit():
    rng = np.random.default_rng(7)
    have = np.bincount(rng.integers(1, 60, 80), minlength=64)
    has = np.flatnonzero(have)
    want = {(a, 0, 64 - a) for a in has if a <= 32 and have[64 - a]} | {(a, b, 64 - a - b) for a in has for b in has if a <= b <= 64 - a - b and have[64 - a - b]}
    columns = packing.combinations(have, 64)
    assert {tuple(c) for c in columns.tolist()} == want and len(columns) == len(want)
    x = packing.solve(columns, have)
    a = np.zeros((64, len(columns)))
    for k in range(3):
        np.add.at(a, (columns[:, k], np.arange(len(columns))), 1)
    a[0] = 0
    want = have * (a.sum(1) > 0)
    best, step = np.zeros(len(columns)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20_000):  # projected gradients, to the end
        best = np.maximum(best - step * (a.T @ (a @ best - want)), 0)
    assert (x >= 0).all() and np.linalg.norm(a @ x - want) < np.linalg.norm(a @ best - want) + 0.05 * np.linalg.norm(want)
    assert abs(packing.rounded(x).sum() - x.sum()) < 1 and packing.rounded(np.array([0.4, 0.4, 0.4])).tolist() == [0, 1, 0]


def test_packing_bounds_and_returns_memory(monkeypatch):
    path, batches, given = public_tokenizers.path("word_bpe_49k.json"), [], []
    own = packing.ChunkEncoder(path)

    class Counting:
        def encode_batch_fast(self, texts, **more):
            batches.append(len(texts))
            return library.encode_batch_fast(texts, **more)

    library, own.tokenizer = own.tokenizer, Counting()
    words = [f"{k}x{k * k}" for k in range(10_000)]
    got = own.encode([" ".join(words).encode()])
    assert got == [np.array(library.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()]
    assert max(batches) <= 4096

    class Table:
        select = lambda self, *names: self
        mapInArrow = lambda self, run, ddl: run

    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    rows = list(packing.pack_documents(Table(), path)(iter([pa.record_batch({"doc_id": [1, 2], "text": ["one", "two"]})])))
    assert sum(b.num_rows for b in rows) >= 2 and given


def test_packing_of_odd_rows(spark):
    """Null and repeated ids, and columns with the names used inside."""
    names = ["start", "length", "sequence_id", "offset"]
    table = spark.createDataFrame([(i, t, *[0] * 4) for i, t in [(None, "a b"), (1, None), (1, "c"), (1, "c"), (2, "word " * 9000)]], f"doc_id long, text string, {', '.join(x + ' int' for x in names)}")
    rows = packing.pack_documents(table, public_tokenizers.path("word_bpe_49k.json")).collect()
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == {None: 3, 1: 1 + 2 + 2, 2: 9001}


def test_chunks_encode_as_the_library():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    own, library = packing.encoder(path), Tokenizer.from_file(path)
    letters = [chr(k) for k in range(0x400)] + list("aabcAB  \n.,.,'st12") * 20 + ["́", "<|endoftext|>", "<|ENDOFTEXT|>", "　", "İ"]
    every = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for got, e in zip(own.encode([t.encode() for t in every]), library.encode_batch(every, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.ids


def test_chunks_with_marks_behind_are_put_together():
    path, rng, asked = public_tokenizers.path("word_bpe_49k.json"), random.Random(3), []
    own, library = packing.ChunkEncoder(path), Tokenizer.from_file(path)

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.extend(x for t in texts for x in t.split())
            return library.encode_batch_fast(texts, **more)

    own.tokenizer = Counted()
    heads = ["".join(rng.choice("abcdeéüß") for _ in range(8)) for _ in range(60)]
    tails = ["", "!!", "***", ",&&&", ".", "'", "_%", "\\", "...'-"]
    odd = ["İ.", "xİ!!", "12.", "²;", "a\u0301.", "が.", "\u0915\u094d,", "<|endoftext|>.", "x<|endoftext|>!!", "<|endoftext|>a..", "it's.", "don'.", "'", ".", "a<|.", "a|>.", "x\u200d.", "Ǆ!"]
    every = [h + t for h in heads for t in tails] + odd
    for texts in ([" ".join(every)], every):
        for got, e in zip(own.encode([t.encode() for t in texts]), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == e.ids
    assert len(asked) < len(heads) + len(tails) + 3 * len(odd)


def test_language_model(spark, empty):
    rng = random.Random(9)
    nouns = [f"noun{k}" for k in range(200)]
    texts = [" ".join(x for _ in range(60) for x in ("the", rng.choice(nouns), "Of")) for _ in range(150)] + [None, ""]
    got = {r.doc_id: r for r in maxent.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    toks = [[*(t or "").lower().split(), "\n"] for t in texts]
    c = collections.Counter(x for i, t in enumerate(toks) if not out[i] for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (out[i], len(t), sum(c[x] > 0 for x in t), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    assert maxent.score_documents(empty).count() == 0


def test_language_model_has_its_former_size():
    assert maxent.CLASSES >= 32
    hashes = np.random.default_rng(1).integers(0, 1 << 32, 1 << 17)
    assert all(len(np.unique(row)) > 16_000 for row in maxent.feature_slots(hashes, np.array([0])))


def test_language_model_reads_tokens_without_an_object_each(texts):
    rng = random.Random(4)
    odd = [*texts, " a", "a ", "\x0b", *("".join(rng.choice("aB é\t\n\r\x0b\x0c\x1c\x00\x85") for _ in range(rng.randrange(30))) for _ in range(500))]
    for kind in (pa.string(), pa.large_string()):
        toks, at, sizes = maxent.tokens(pa.array(odd, kind).slice(3))
        rows = np.split(at, np.cumsum(sizes))
        assert [[toks[k] for k in row] for row in rows[:-1]] == [[*raw(t).lower().split(), maxent.END] for t in odd[3:]]
    table = pa.table({"text": [" ".join(f"w{k * d % 5000}" for k in range(3000)) for d in range(64)]})
    numbers = maxent.Numbers(maxent.Classes([]))
    tracemalloc.start()
    n = sum(len(cells) for _, _, cells in maxent._batches_of_tokens(table, numbers))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 64 * 3001 and peak < 60 * n


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(3)
    model, hashes = maxent.Model(), rng.integers(0, 1 << 32, 500)
    starts, cells = np.array([0, 200]), rng.integers(0, maxent.CLASSES, 500)
    for _ in range(3):
        model.learn(hashes, starts, cells)
    total = sum(10 ** model.log10(hashes, starts, np.where(np.arange(500) < 500, k, 0)) for k in range(maxent.CLASSES))
    assert np.allclose(total, 1, atol=1e-3)
    assert model.log10(hashes, starts, cells).mean() > -math.log10(maxent.CLASSES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_model_beats_the_base_on_held_out_rows(spark):
    rows = maxent.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_language_model_of_odd_rows(spark):
    """Null and repeated ids and texts, a long text, and columns with the names used inside."""
    rows = [(None, "a b"), (1, None), (1, "a b"), (1, "a b"), (2, "long " * 30_000)]
    names = ["block", "token", "n", "held_out", "score"]
    table = spark.createDataFrame([(i, t, *[k] * len(names)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {', '.join(x + ' int' for x in names)}")
    got = sorted((str(r.doc_id), r.n_tokens) for r in maxent.score_documents(table).collect())
    assert got == [("1", 1), ("1", 3), ("1", 3), ("2", 30_001), ("None", 3)]


def test_pipeline(spark, docs, tmp_path):
    rng = random.Random(11)
    more = spark.createDataFrame([(None, prose(rng, 80), "en", None, 0), (7000, prose(rng, 90) + " bob@example.com", "en", "s1", 0)], SCHEMA)
    table = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was = table.columns
        table = stage(spark, table, "").cache()
        assert table.columns == was, name
    left = {r.doc_id: r for r in table.collect()}
    assert None in left and "<EMAIL>" in left[7000].text and left[7000].n_chars == len(left[7000].text)
    assert len([i for i in left if i is not None and 60 <= i <= 65]) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, table, "").count() >= len(left)
