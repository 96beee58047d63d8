import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    a = np.array(fps, "u8")
    label = list(range(len(a)))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= radius
    seen = set()
    for i in range(len(a)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for k in np.flatnonzero(near[todo.pop()]):
                if int(k) not in group:
                    group.add(int(k))
                    todo.append(int(k))
        seen |= group
        for k in group:
            label[k] = min(group)
    return label


def test_fingerprints():
    for text in ["", None, "One", "one TWO", "A b\tc\x0bd e\xa0f É", "x y z " * 50_000, " \n "]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def clustered(rng, n):
    fps = [rng.getrandbits(64) for _ in range(n)]
    while len(fps) < 2 * n:
        fps.append(rng.choice(fps) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    return sorted(set(fps))


def test_links_with_small_shards_and_more_blocks(spark, monkeypatch):
    rng = random.Random(3)
    fps = clustered(rng, 300)
    base = fps[0]
    fps = sorted({*fps, *(base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20))})
    df = spark.createDataFrame([(int(np.uint64(x).astype("i8")),) for x in fps], "fp long")
    want = brute_components(fps)
    for choices in (4, 6):
        monkeypatch.setattr(simhash, "_keys", lambda n, radius, c=choices: KEYS[c])
        for limit in (17, 2048):
            label = list(range(len(fps)))
            at = {x: i for i, x in enumerate(fps)}
            pairs = [(at[r.a % 2**64], at[r.b % 2**64]) for r in simhash.links(df, shard_limit=limit).collect()]
            arr = np.array(label)
            if pairs:
                simhash._merge(arr, *map(np.array, zip(*pairs, strict=True)))
            assert arr.tolist() == want


KEYS = {c: [] for c in (4, 6)}
KEYS[4] = simhash._keys(1000, 3)
KEYS[6] = simhash._keys(1 << 60, 3)


def test_key_choices():
    assert len(KEYS[4]) == 4 and len(KEYS[6]) == 20
    assert all(sum(w for _, w in k) == 16 for k in KEYS[4])


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(4, text), (3, text.upper()), (3, text.upper()), (None, text), (9, None), (8, ""), (7, " "), (None, "zq"), (11, "something else entirely is written here today")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 3), (3, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (None, None), (11, 11)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_near_groups(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(300)] for _ in range(12)]
    rows, want = [], {}
    for g, words in enumerate(base):
        for k in range(4):
            copy = list(words)
            for _ in range(k):  # each change costs five of about 300 shingles
                copy[rng.randrange(300)] = "changed"
            rows.append((g * 10 + k, " ".join(copy)))
            want[g * 10 + k] = g * 10
        half = words[:150] + [f"v{rng.randint(0, 5000)}" for _ in range(150)]
        rows.append((g * 10 + 9, " ".join(half)))
        want[g * 10 + 9] = g * 10 + 9
    rows += [(900, None), (901, ""), (902, "two words"), (903, "two words")]
    want |= {900: 900, 901: 901, 902: 902, 903: 902}
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    for limit in (3, 2048):
        assert {r.doc_id: r.component_id for r in simhash.near_groups(df, shard_limit=limit).collect()} == want
    assert simhash.near_groups(df.limit(0)).count() == 0


def test_near_groups_hold_to_the_similarity(spark):
    """Pairs at, over and just under 0.8 in five-word shingles, long and short."""
    rows, want = [], {}

    def pair(a, b, near):
        x = len(rows)
        rows.extend([(x, " ".join(a)), (x + 1, " ".join(b))])
        want.update({x: x, x + 1: x if near else x + 1})

    # Appended words: of n and n + k shingles, n are shared.
    for shared, more in ((280, 120), (78, 22), (312, 88), (399, 101), (80, 20), (400, 100), (82, 18), (328, 72), (4, 1), (3, 1), (8, 2), (7, 2), (40, 10), (39, 10), (63, 15), (64, 16), (63, 16)):
        for copy in range(12):
            words = [f"{shared}.{more}.{copy}.{i}" for i in range(shared + more + 4)]
            pair(words[: shared + 4], words, 5 * shared >= 4 * (shared + more))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (2, 2048):
        got = {r.doc_id: r.component_id for r in simhash.near_groups(df, shard_limit=limit).collect()}
        assert {d: c for d, c in got.items() if want[d] != c} == {}


def test_similar_items():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(40, rng.integers(1, 14))).astype(np.int64) for _ in range(120)]
    label = np.arange(len(sets))
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b))]
    simhash._merge(label, *map(np.array, zip(*pairs, strict=True)))
    assert simhash.similar_items(sets, 0.5).tolist() == label.tolist()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    label = brute_components(fps)
    want = {(r.doc_id, f"{f:016x}", rows[k].doc_id) for r, f, k in zip(rows, fps, label, strict=True)}
    assert {tuple(r) for r in simhash.op4_simhash(spark, sf).select("doc_id", "fingerprint", F.col("component_id")).collect()} == want
