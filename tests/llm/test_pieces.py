import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces

SAMPLER = pieces.Sampler(words=30)


def ids_of(texts, keys=None, s=SAMPLER):
    ids, at = s.encode(pa.array(texts, pa.string()), np.array(keys if keys is not None else range(len(texts)), "i8").view("u8"))
    return [ids[a:b].tolist() for a, b in itertools.pairwise(at)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁\nabeé<0x41>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_decoding_is_lossless(texts):
    assert [SAMPLER.decode(x) for x in ids_of(texts)] == texts


def segmentations(word, s):
    text = pieces.SPACE + word
    out = {}

    def go(i, ids, weight):
        if i == len(text):
            out[tuple(ids)] = math.exp(weight)
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in s.pieces:
                piece, w = s.pieces[text[i:j]]
                go(j, [*ids, piece], weight + w)

    go(0, [], 0.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_draws_follow_the_lattice():
    s = pieces.Sampler(theta=0.0003)
    want = segmentations("other", s)
    n = 20_000
    got = Counter(map(tuple, ids_of(["other"] * n, s=s)))
    assert set(got) <= set(want) and len(want) > 5
    assert sum(abs(got[k] / n - p) for k, p in want.items()) < 0.08


def test_reproducible_and_different_between_rows():
    text = "the same words in other batches and other rows"
    alone = ids_of([text], [5])[0]
    assert ids_of(["something else", text, text], [4, 5, 6])[1] == alone
    assert len({tuple(x) for x in ids_of([text] * 50)}) > 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "▁ a  b "), (5, "x" * 5000), (5, "word " * 50_000), (None, "é😀\n"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, n_pieces string")
    encoded = pieces.encode(df)
    back = pieces.decode(encoded.withColumnRenamed("ids", "p"), ["doc_id"], "p").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    sevens = [r.ids for r in encoded.where("doc_id = 7").collect()]
    assert sevens[0] == sevens[1] and len(sevens) == 2
    assert encoded.where("doc_id = 2").first().ids == []
    assert pieces.encode(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op10_sentencepiece(spark, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == want and len(got) == len(want)
