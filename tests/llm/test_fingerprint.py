import hashlib
import math
import statistics
import struct

import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprint as fp


def texts_of(spark, rows):
    return {r.k: r.fingerprint for r in fp.fingerprints(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}


def test_order_insertion_and_deletion(spark):
    a, b, c = "first paragraph of four words", "the second one is longer than that", "x"
    got = texts_of(spark, [(1, f"{a}\n{b}\n{c}"), (2, f"{c}\n\n{a}\n{b}"), (3, f"{a}\n{b}"), (4, c), (5, f"{a}\n{b}\n{b}"), (6, None), (7, ""), (8, " \n "), (9, f"{a}  \n{b}")])
    assert got[1] == got[2] and len({got[k] for k in (1, 3, 4, 5, 9)}) == 5
    assert set(got[6]) == {"0"} and got[6] == got[7] == got[8]
    one = spark.createDataFrame([(got[1], got[3], got[4])], "w string, p string, q string")
    r = one.select(fp.combine(F.col("p"), F.col("q")).alias("sum"), fp.combine(F.col("w"), F.col("q"), subtract=True).alias("diff"), fp.likeness(F.col("w"), F.col("w")).alias("same")).first()
    assert r["sum"] == got[1] and r["diff"] == got[3] and r["same"] == 1.0


def test_long_texts_of_one_paragraph(spark):
    line = " ".join(f"word{i}" for i in range(102))
    got = texts_of(spark, [(1, f"{line}\n" * 8000), (2, f"{line}\n" * 4000), (3, "one two three\n" * 40_000), (4, "one two three\n" * 20_000)])
    pairs = spark.createDataFrame([(got[1], got[2]), (got[3], got[4])], "a string, b string")
    assert all(r.x > 0.999 for r in pairs.select(fp.likeness(F.col("a"), F.col("b")).alias("x")).collect())
    half = pairs.select(fp.combine(F.col("a"), F.col("b"), subtract=True).alias("d"), "b").collect()
    assert all(r.d == r.b for r in half)


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash of those before it as seed; nulls are passed over."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, int) and not isinstance(v, Long) else "<q", v), seed)
    return seed


class Long(int):
    pass


def brute_lanes(text):
    dense, n, ones = [0] * fp.DENSE, 0, [0] * fp.BITS
    for p in (text or "").split("\n"):
        if p.strip(" "):
            for i in range(fp.DENSE):
                dense[i] += spark_hash(i // 2, p) >> (32 * (i % 2)) & 0xFFFFFFFF
            w = p.split(" ")
            for i in range(max(len(w) - 2, 1)):
                h = spark_hash(*w[i : i + 3])
                h -= (h >> 63) << 64
                n += 1
                for k in range(fp.BITS // 64):
                    g = h % 2**64 if not k else spark_hash(k, Long(h))
                    for b in range(64):
                        ones[64 * k + b] += g >> b & 1
    return [x % 2**32 for x in dense], n, ones


def brute_fingerprint(text):
    dense, n, ones = brute_lanes(text)
    low = [ones[64 * k + b] for k in range(fp.BITS // 64) for b in range(32)]
    high = [ones[64 * k + b] for k in range(fp.BITS // 64) for b in range(32, 64)]
    return "".join(f"{x:08x}" for x in (*dense, n, *low, *high))


def brute_likeness(a, b):
    if brute_fingerprint(a) == brute_fingerprint(b):
        return 1.0
    u, v = ([2 * x - n for x in ones] for _, n, ones in (brute_lanes(a), brute_lanes(b)))
    norms = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(u, v, strict=True)) / norms)) if norms else 0.0


def test_fingerprints_and_likeness_against_brute_force(spark, tmp_path):
    docs = [(r.doc_id, (r.text or "")[:600]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    docs += [(10_000, ""), (10_001, None), (10_002, "one\n\ntwo three"), (10_003, "one\n\ntwo three")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fp.op7_fingerprint(spark, str(tmp_path)).collect()}
    docs.sort()
    for i, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert r.fingerprint == brute_fingerprint(t) and r.edited_fingerprint == brute_fingerprint(edited)
        assert abs(r.near_edited - brute_likeness(t, edited)) < 1e-9 and abs(r.near_next - brute_likeness(t, nxt)) < 1e-9


def test_standard_error_of_the_likeness(spark):
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(60):  # half of the shingles of each pair are shared
        w = [words[(37 * k + 11 * i * (k + 1)) % 4000] for i in range(202)]
        rows += [(2 * k, " ".join(w[:102]) + "\n" + " ".join(f"a{k}x{i}" for i in range(102))), (2 * k + 1, " ".join(w[:102]) + "\n" + " ".join(f"b{k}x{i}" for i in range(102)))]
    got = texts_of(spark, rows)
    pairs = spark.createDataFrame([(got[2 * k], got[2 * k + 1]) for k in range(60)], "a string, b string")
    found = [r.x for r in pairs.select(fp.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert abs(statistics.mean(found) - 0.5) < 0.04 and statistics.stdev(found) < 0.12


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, tmp_path, rows):
    df = spark.createDataFrame([(d, t, 5, "clash") for d, t in rows], "doc_id long, text string, n int, fingerprint string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = fp.op7_fingerprint(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_odd_rows(spark, tmp_path):
    rows = [(5, "abc d\ne"), (1, None), (2, ""), (2, ""), (None, "é" * 11), (2, "two"), (9, "last one here 😀😀"), (-3, "word " * 40_000)]
    check(spark, tmp_path, rows)


def test_small_tables(spark, tmp_path):
    for i, rows in enumerate(([], [(1, "alone here")])):
        check(spark, tmp_path / str(i), rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = fp.op7_fingerprint(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(docs)
    text = dict(docs)
    by_text = {}
    for r in got:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert statistics.mean(r.near_edited for r in got) > 0.3 > 0.2 > statistics.mean(r.near_next for r in got)
