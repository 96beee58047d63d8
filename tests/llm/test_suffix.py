import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 3))
def test_suffix_array(xs, times):
    s = np.array(xs * times + [0])
    assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_starts(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if n[t[i : i + length]] > 1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(1, 8))
def test_repeated_windows(parts, length):
    assert [x.tolist() for x in suffix.repeated_windows(parts, length)] == brute_starts(parts, length)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=4))
def test_segments_cover_windows_and_count_hashes(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = list(zip(*(x.tolist() for x in suffix.segments(data, np.cumsum([len(t) for t in texts]), 12, 4)), strict=True))
    windows = Counter((t, w) for t, _, a, b, _ in got for w in range(a, b + 1))
    assert windows == Counter((t, w) for t, x in enumerate(texts) for w in range(len(x) - 11))
    for t, h, a, b, n in got:
        kmers = suffix._kmer_hashes(np.frombuffer(texts[t], np.uint8)[a : b + 12], 4).view(np.int64).tolist()
        assert n == kmers.count(h)


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), t, starts in zip(rows, texts, brute_starts(texts, length), strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in starts:
            gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, hash int, z string")
    got = suffix.remove_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)


def test_odd_rows(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij é") for _ in range(90))
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 500), (5, passage + "end"), (6, "start " + passage), (None, passage[:60] + "zz" + passage), (7, "abc" * 100), (8, "dup row that is long enough to be a repeat of its own"), (8, "dup row that is long enough to be a repeat of its own")]
    rows += [(100 + i, "".join(rng.choice("ab") for _ in range(300)) + (passage[10:60] if i % 2 else "")) for i in range(10)]
    for options in ({}, {"shard_bytes": 60}):
        assert run(spark, rows, length=40, kmer=8, **options) == brute(rows, 40)
    assert run(spark, [], length=40, kmer=8) == []


def test_crowded_shards_are_cut(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = word(30)  # one hashed string amid texts that differ, some of them after 30, 60 or 90 characters
    tails, heads = [word(100) for _ in range(4)], [word(100) for _ in range(4)]
    rows = [(i, rng.choice(heads)[rng.randrange(100) :] + common + rng.choice(tails)[: rng.randrange(100)] + word(20)) for i in range(400)]
    seen, split = [], suffix._split
    monkeypatch.setattr(suffix, "_split", lambda length, step: seen.append(step) or split(length, step))
    assert run(spark, rows, length=60, kmer=8, shard_bytes=1500) == brute(rows, 60)
    assert seen[0] == suffix.STEPS[0] and len(seen) > 1


def test_a_passage_in_20000_documents_and_a_long_text(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = word(240)
    rows = [(i, word(5) + passage + str(i)) for i in range(20_000)]
    rows.append((20_000, word(1_000_000) + passage[20:] + word(100_000)))
    assert run(spark, rows) == brute(rows, 200)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in suffix.op8_suffix_dedup(spark, sf).collect()), key=str) == brute(rows, 200)
