import itertools
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokens


def brute(rows, path=tokens.VOCABULARY):
    t = Tokenizer.from_file(path)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ENCODER = tokens.ChunkEncoder(memo_bytes=10_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r  ab'sé.1<|"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_chunks_give_what_whole_texts_give(texts):
    t = ENCODER.tokenizer
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    ids, at = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == want
    ids, at = ENCODER.encode(pa.array(texts, pa.string()), 0)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [x + [0] for x in want]


def test_round_trip_with_odd_rows(spark, tmp_path):
    rows = [(5, "the  end  "), (1, None), (2, ""), (2, ""), (None, "null id"), (9, "word " * 30_000), (3, "It's a <|endoftext|> test.\n\n Next"), (-4, "naïve été　x")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, part int")
    path = str(tmp_path / "t")
    tokens.write_tokens(df, path)
    read = tokens.read_tokens(spark, path)
    assert sorted(x for (x,) in read.select("n_tokens").collect()) == sorted(n for _, _, n, _ in brute(rows))
    got = tokens.with_crc(read, ["doc_id", "part", "part_start", "n_tokens"]).join(tokens.part_starts(read), "part").collect()
    assert sorted(((r.doc_id, r.base + r.part_start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == brute(rows)


def test_special_strings_are_special_tokens():
    texts = ["a <|endoftext|> b", "a<|endoftext|>", "<|endoftext|> <|endoftext|>\n", "<|endoftext |>", "plain"]
    t = Tokenizer.from_file(tokens.VOCABULARY)
    ids, at = tokens.ChunkEncoder().encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in itertools.pairwise(at)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [50256 in x for x in got] == [True, True, True, False, False]


def test_memo_keeps_to_its_bound():
    e = tokens.ChunkEncoder(memo_bytes=20_000)
    for k in range(20):
        e.encode(pa.array([" ".join(f"w{k}x{i}" for i in range(500))]))
    assert e.memo.room <= 0 and len(e.memo) * tokens.ENTRY_BYTES < 300_000


def test_memo_has_room_for_words_that_recur():
    e = tokens.ChunkEncoder(memo_bytes=200_000)
    for k in range(40):  # words that come once don't fill it
        e.encode(pa.array([" ".join(f"w{k}x{i}" for i in range(100))]))
    late = [f"late{i}" for i in range(200)]
    texts = ["x " + " ".join(late), "x " + ", ".join(late) + ".\nNext\nlate1, late2", "late1.\nlate2 end"]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(3):  # met first, kept, and from the memo
        ids, at = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == want
    assert e.memo.room > 0 and all(x in e.memo for x in late)


def test_files_allow_selective_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(30_000).selectExpr("id AS doc_id", "concat('doc ', id, repeat(' word', 20)) AS text")
    tokens.write_tokens(df, path)
    files = sorted(Path(path).glob("*.parquet"))
    for f in files:
        for g in range((meta := pq.ParquetFile(f).metadata).num_row_groups):
            group = {c.path_in_schema.split(".")[0]: c for c in map(meta.row_group(g).column, range(meta.num_columns))}
            assert list(group) == tokens.TOKEN_SCHEMA.names  # what describes the ids lies before them
            assert all(c.has_column_index and c.has_offset_index for c in group.values())
            assert "RLE_DICTIONARY" in group["ids"].encodings and "DELTA_BINARY_PACKED" in group["part_start"].encodings
            assert group["doc_id"].statistics.max < group["doc_id"].statistics.min + 30_000
    # Ids ascend from file to file and within one, so a range touches few of them.
    spans = [(pq.ParquetFile(f).metadata.row_group(0).column(0).statistics.min, pq.ParquetFile(f).metadata.row_group(0).column(0).statistics.max) for f in files]
    assert sum(a <= 12_345 and b >= 12_340 for a, b in spans) == 1
    some = tokens.read_tokens(spark, path).where("doc_id BETWEEN 12340 AND 12345")
    plan = some.select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,12340)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    t = Tokenizer.from_file(tokens.VOCABULARY)
    assert {r.doc_id: r.ids[:-1] for r in some.collect()} == {i: t.encode(f"doc {i}" + " word" * 20).ids for i in range(12_340, 12_346)}


def test_empty_table(spark, tmp_path):
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert tokens.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_query(spark):
    got = tokens.op1_token_output(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == brute(rows)
