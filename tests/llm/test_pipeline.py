import itertools
import re

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_packing import check as check_packing
from tests.llm.test_pii import brute as brute_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.columns == COLUMNS
            docs = spark.createDataFrame(out.collect(), docs.schema)
            after = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        seen[name] = (before, after if name != "best_fit_packing" else out.collect())
    before, after = seen["language_id"]
    assert len(after) >= 0.98 * len(before)
    before, after = seen["line_dedup"]
    want = {d: t for d, t, *_ in brute_lines([(r.doc_id, r.text) for r in before.values()])}
    assert {d: r.text for d, r in after.items()} == {d: t for d, t in want.items() if t.strip()}
    before, after = seen["simhash_near_dedup"]
    assert 0.8 * len(before) < len(after) <= len(before)
    before, after = seen["pii_masking"]
    assert set(after) == set(before)
    for d, r in before.items():
        assert (brute_pii(r.text) == "" and 'token = "' not in r.text) == (after[d].text == r.text)
    check_packing(seen["best_fit_packing"][1], [(r.doc_id, r.text) for r in after.values()], 2048)


def test_odd_rows(spark):
    """What each stage makes of nulls, repeats, unknown columns' names and empty tables."""
    cat, mail = "the cat and the dog went home", "the cat and the dog went home\nmail me@x.org now"
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` int"
    rows = [(1, None, None, None, None, 7), (2, "", "en", "s", 0, 7), (2, "", "en", "s", 0, 7), (None, cat, "en", "s", 29, 7), (4, mail, "en", "s", 46, 7), (4, mail, "en", "s", 46, 7), (5, "1 2 3", "en", "s", 5, 7)]
    df = spark.createDataFrame(rows, schema)
    short = lambda out: sorted([(r.doc_id, r.text, r.n_chars) for r in out.collect()], key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert short(stages["language_id"](spark, df, "")) == sorted([(None, cat, 29), (4, mail, 46), (4, mail, 46)], key=str)
    assert short(stages["line_dedup"](spark, df, "")) == sorted([(1, None, None), (2, "", 0), (2, "", 0), (None, cat, 29), (4, "mail me@x.org now", 17), (4, "mail me@x.org now", 17), (5, "1 2 3", 5)], key=str)
    assert short(stages["simhash_near_dedup"](spark, df, "")) == sorted([(1, None, None), (2, "", 0), (None, cat, 29), (4, mail, 46), (5, "1 2 3", 5)], key=str)
    assert short(stages["pii_masking"](spark, df, "")) == sorted([(d, t.replace("me@x.org", "[EMAIL]") if t else t, n and len(t.replace("me@x.org", "[EMAIL]"))) for d, t, _, _, n, _ in rows], key=str)
    check_packing(stages["best_fit_packing"](spark, df, "").collect(), [(d, t) for d, t, *_ in rows], 2048)
    for name, stage in stages.items():
        assert stage(spark, df.limit(0), "").count() == 0
        assert name == "best_fit_packing" or stage(spark, df, "").columns == df.columns


def test_near_dedup_against_brute_force(spark):
    """All pairs by shingles of five words: what the stage drops has a mate at 0.8, and none is left with an earlier one."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {}
    for r in df.collect():
        w = re.sub("[A-Z]+", lambda m: m.group().lower(), r.text or "").split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    linked = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    component = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()}
    assert linked and kept == {d for d in sets if component[d] == d}
