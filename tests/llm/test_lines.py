import random

import duckdb

from tessera.llm import lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    """Rows with distinct ids, in order of ids."""
    seen, out = [], []
    for d, t in sorted(rows, key=lambda r: r[0]):
        kept, repeated, near = [], 0, 0
        for line in (t or "").split("\n"):
            w = line.split()
            if not w:
                kept.append(line)
            elif w in seen:
                repeated += 1
            else:
                close = len(w) >= 5 and any(len(s) >= 5 and within_one(w, s) for s in seen)
                seen.append(w)
                if close:
                    near += 1
                else:
                    kept.append(line)
        out.append((d, "\n".join(kept), repeated, near))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pos int, words string")
    return sorted(((r.row.doc_id, r.row.text or "", r.repeated, r.near) for r in lines.dedup_lines(df).collect()), key=str)


def test_random_lines(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))] for _ in range(40)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(w))
                rng.choice([lambda w, i: w.pop(i), lambda w, i: w.insert(i, rng.choice("xyz")), lambda w, i: w.__setitem__(i, rng.choice("xyz"))])(w, i)
            text.append(rng.choice([" ", "  "]).join(w))
        rows.append((d, "\n".join(text)))
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    long = "word " * 20_000
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "same line of five words\nsame line of five words\n\nlast"), (5, long + "end"), (6, long + "other"), (7, "É é\t same  line of five"), (8, "four words are exact"), (9, "four words are exac"), (10, "same line of five words!")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    same = [(1, "a b c d e\nx"), (1, "a b c d e\nx"), (None, "a b c d f")]
    assert run(spark, same) == sorted([(1, "x", 0, 1), (1, "x", 0, 1), (None, "a b c d f", 0, 0)], key=str)
    assert run(spark, []) == []


def test_null_ids_come_first_and_names_may_clash(spark):
    df = spark.createDataFrame([(-5, "a b c d e", 1, 2), (None, "a b c d e", 3, 4)], "doc_id long, text string, `__v` int, `gone` int")
    got = sorted((tuple(r.row) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == [(-5, "", 1, 2), (None, "a b c d e", 3, 4)]


def test_edits_at_every_place_of_short_and_long_lines(spark):
    rng = random.Random(9)
    rows = []
    for n in (5, 6, 15, 16, 17, 32, 33, 300):
        for letters in ("ab", "abcdefgh"):
            for edit in (lambda w, i: w.pop(i), lambda w, i: w.insert(i, "x"), lambda w, i: w.__setitem__(i, "x")):
                for i in {0, 1, (n - 1) // 2, n // 2, min(16, n - 1), n - 1}:
                    w = [f"{n}{letters}", *rng.choices(letters, k=n - 1)]
                    pair = [w, list(w)]
                    edit(pair[1], i)
                    rng.shuffle(pair)
                    rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate(pair)]
    want = sorted(brute(rows), key=str)
    assert run(spark, rows) == want
    assert sum(r[3] for r in want) > len(rows) / 3
    assert run(spark, rows + rows) == sorted(want + want, key=str)


def test_variants_only_where_an_edit_can_lie(spark, monkeypatch):
    made, materialize = {}, lines.materialize

    def counting(df, name):
        made[name] = materialize(df, name)
        return made[name]

    monkeypatch.setattr(lines, "materialize", counting)
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:39], "x"])), (3, " ".join(words[:20] + ["y"] * 20)), (4, "a line of its own\nanother one that shares nothing")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    # Three lines of one length share their first 19 words: one variant for each of the 21 other places, none for other lengths.
    assert made["line-variants"].count() == 3 * 21


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in lines.op3_line_dedup(spark, sf).collect())
    assert got == sorted(duckdb.sql(lines.OP3_SQL).fetchall())
    assert sum(r[2] for r in got) > 0 and sum(r[3] for r in got) > 0
