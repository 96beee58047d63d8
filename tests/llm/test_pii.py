import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import pii

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(RE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def check(spark, rows, path):
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, kind string, start int")
    df.write.parquet(f"{path}/documents.parquet")
    got = pii.op9_pii(spark, str(path)).collect()
    want = sorted(((d, hashlib.sha256(brute(t).encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == want
    return got


def test_base_spans(spark, tmp_path):
    rng = random.Random(5)
    bits = ["a.b@c.d", "x@y", "@", ".", "%", "+1 (269) 555-3296", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "é😀", " ", "\n", "+", "12", "-", "4349000490986231", "a@b.c-d.e+f@g.h", "+123456789", "(", ")"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "9" * 30_000), (1003, "a" * 50_000), (1004, "1.2.3.4 " * 300), (None, "me@x.org"), (7, "me@x.org"), (7, "me@x.org"), (1005, "+" + "(" * 20_000)]
    got = check(spark, rows, tmp_path)
    assert all(r.n_email == 1 for r in got if r.doc_id in (None,))


def test_empty(spark, tmp_path):
    assert check(spark, [], tmp_path) == []


def test_contexts_discover_unseen_forms(spark):
    rows = [(i, f"Please write. Mailto: user{i}@host.example.com now and pay.") for i in range(6)]
    rows += [(20, "Some text. mailto: jane@intranet and more"), (21, "Later jane@intranet again."), (22, "the @home page of the 1234567 and user"), (23, "mailto: nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [(s["kind"], s["start"], s["end"], s["base"]) for s in r.spans] for r in pii.find(df).collect()}
    assert spans[20] == [("email", 19, 32, False)] and spans[21] == [("email", 6, 19, False)]
    assert 22 not in spans and 23 not in spans
    texts = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert texts[20] == "Some text. mailto: [EMAIL] and more" and texts[0] == "Please write. Mailto: [EMAIL] now and pay." and texts[22] == rows[8][1]


def test_bootstrapping_goes_on_until_nothing_is_added(spark):
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord"]
    texts = [f"see amber user{i}@host.example.com here" for i in range(6)]
    for before, after in zip(words[:-1], words[1:], strict=True):
        for who in "xyz":
            # Only tokens that the word before leads to make the word after a pattern.
            texts += [f"see {before} {who}{after}@intranet here", *[f"see {after} {who}{after}@intranet here"] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert all(t.split(" ")[2] == "[EMAIL]" for t in got.values()) and len(got) == len(texts)


def test_mask_overlaps_and_nulls(spark):
    df = spark.createDataFrame([(1, "é 10.0.0.1@x.org é", 5), (2, None, 5), (2, "plain", 6)], "doc_id long, text string, h int")
    got = sorted((r.doc_id, r.text or "", r.h) for r in pii.mask(df).collect())
    assert got == [(1, "é [EMAIL] é", 5), (2, "", 5), (2, "plain", 6)]
    assert pii.mask(df).where(F.col("text").isNull()).count() == 1


def brute_bootstrap(rows, settings=pii.Bootstrap()):
    """Added spans by document, in plain Python: patterns as tuples of words and no hashes."""

    def norm(t):
        return re.sub("[0-9]", "0", t.lower())

    docs = [(d, t or "") for d, t in rows]
    known, instances, totals = [], [], {}
    for n, (_, text) in enumerate(docs):
        words = [(m.start(), m.end(), norm(m.group())) for m in re.finditer(r"\S+", text)]

        def context(a, b, words=words):
            left = [w for _, e, w in words if e <= a][::-1]
            right = [w for s, _, w in words if s >= b]
            left = left if all(not (s < a < e) for s, e, _ in words) else left
            return [(side, *ws[:k]) for side, ws in ((-1, left), (1, right)) for k in (1, 2, 3) if len(ws) >= k]

        for a, b, _ in words:
            for c in context(a, b):
                totals[c] = totals.get(c, 0) + 1
        base = [(int(x), int(y), k) for k, x, y in (p.split(":") for p in brute(text).split(",") if p)]
        known += [(c, "at" if k == "email" else "number", k, text[a:b]) for a, b, k in base for c in context(a, b)]
        for a, b, _ in words:
            core = text[a:b].lstrip("".join(set(c for c in text[a:b] if not re.match("[A-Za-z0-9+@]", c))))
            a, core = b - len(core), re.sub("[^A-Za-z0-9]+$", "", core)
            digits = len(re.sub("[^0-9]", "", core))
            form = "at" if "@" in core else "secret" if re.fullmatch("[A-Za-z0-9_+/=.-]+", core) and re.search("[A-Za-z]", core) and digits and len(core) >= settings.min_secret else "number" if digits >= settings.min_digits and 2 * digits >= len(core) else None
            if form and re.search("[0-9@]", text[a:b]) and not any(x < a + len(core) and y > a for x, y, _ in base):
                instances.append((n, a, a + len(core), core, form, context(a, b)))
    seed = re.compile(pii.SECRET_SEED.replace("\\A", "^").replace("\\z", "$"))
    known += [(c, f, "secret", hit) for _, _, _, hit, f, cs in instances if f == "secret" and seed.search(hit) for c in cs]
    names = {}
    while True:
        facts = known + [(c, f, names[hit], hit) for _, _, _, hit, f, cs in instances if hit in names and not (f == "secret" and seed.search(hit)) for c in cs]
        patterns = {}
        for c, f, k, hit in facts:
            patterns.setdefault((c, f), []).append((k, hit))
        good = {p: (len(v) / totals[p[0]], max(Counter(k for k, _ in v).items(), key=lambda x: (x[1], x[0]))[0]) for p, v in patterns.items() if len(set(v)) >= settings.min_support and len(v) / totals[p[0]] >= settings.min_confidence}
        scores = {}
        for _, _, _, hit, f, cs in instances:
            for c in cs:
                if hit not in names and (c, f) in good:
                    scores.setdefault(hit, {})[c, f] = good[c, f]
        fresh = {hit: max(g.values())[1] for hit, g in scores.items() if 1 - math.prod(max(1 - min(1, p), 1e-9) for p, _ in g.values()) >= settings.min_score}
        if not fresh:
            return sorted((docs[n][0], names[hit], a, b) for n, a, b, hit, _, _ in instances if hit in names)
        names |= fresh


def test_added_spans_against_brute_force(spark):
    rng = random.Random(9)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]
    leads = ["api key :", "contact", "call me on", "host", "token ="]
    marks = ["u{}@h.example.com", "u{}@intranet", "{}abcdef12", "+1 (555) 000-{}", "10.0.0.{}", "{}5550001234", "x{}y"]
    rows = []
    for d in range(250):
        words = [rng.choice(filler) for _ in range(rng.randint(3, 8))]
        for _ in range(rng.randint(0, 2)):
            lead = rng.randrange(len(leads))
            mark = f'"{rng.getrandbits(160):040x}"' if lead == 4 and rng.random() < 0.8 else marks[rng.choice([lead, lead, (lead + 2) % 7])].format(rng.randint(100, 250))
            words[rng.randrange(len(words)) : 0] = [leads[lead], mark]
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, s["kind"], s["start"], s["end"]) for r in pii.find(df).collect() for s in r.spans if not s["base"])
    want = brute_bootstrap(rows)
    assert got == want and len(want) > 20 and len({k for _, k, _, _ in want}) > 1


def test_planted_secrets_of_documents_are_added(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = {(d, m.start(1), m.end(1)) for d, t in texts.items() for m in re.finditer(r'\btoken = "([0-9a-f]{40})"', t)}
    added = {(r.doc_id, s["start"], s["end"]) for r in pii.find(spark.read.parquet(f"{sf}/documents.parquet")).collect() for s in r.spans if not s["base"]}
    assert planted and len(planted & added) >= 0.9 * len(planted) and len(planted & added) >= 0.9 * len(added)


def test_checksums_without_a_context_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [(i, f"{word()} {word()} {rng.getrandbits(160):040x} {word()}") for i in range(30)]
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_mask_of_a_long_text_with_many_spans(spark):
    df = spark.createDataFrame([(1, "é mail a@b.org\n" * 40_000)], "doc_id long, text string")
    assert pii.mask(df).first().text == "é mail [EMAIL]\n" * 40_000


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "at 10.0.0.1 now", 5, 6, 7)], "doc_id long, text string, `__key` int, `cuts` int, `row` int")
    assert [tuple(r) for r in pii.mask(df).collect()] == [(1, "at [IP] now", 5, 6, 7)]


def test_query(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op9_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == (want.count(",") + 1 if want else 0)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
