"""Byte-level BPE token ids and their Parquet file format.

Operator 1. ``write_tokens`` encodes whole texts and writes one Parquet row a
document: id, token count, position in the whole token stream, and the ids as a
list column that Parquet dictionary-encodes. Row groups and pages are small
enough for a page index to be worth reading, and metadata columns come before
the ids, so that a reader of counts or of an id range touches little else.
``read_tokens`` reads it back.

Texts are split before single spaces, where this tokenizer always begins a new
word; a memo per worker, bounded in bytes, maps each piece to its ids, and the
tokenizers library encodes what the memo lacks. Texts in which white space meets
white space around a space are encoded whole, since the split is not safe there,
and so are texts that hold the string of a special token, which the library
takes for that token.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_and_text, slices, small_batches
from tessera.session import scratch_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
MEMO_BYTES = 64 << 20  # of each of a worker's two memos
ENTRY_BYTES = 150  # what Python adds to a memo's entry, besides its characters and ids
SLICE_BYTES = 3 << 20

#: Parquet settings: 16 MB row groups and 256 KB pages hold index entries fine enough to skip by; version 2 pages delta-encode the counts.
FILE_OPTIONS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "snappy",
}

TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)

#: White space, a space, and then white space or the end; RE2 needs the white space beyond ASCII spelt out.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"{_SPACE} (?:{_SPACE}|\z)"


class _Memo(dict):
    """Ids by chunk; takes in no more once its bound of bytes is reached.

    A chunk is kept when it comes a second time, since most of them come once.
    ``met`` marks chunks by hash; two that share a mark are only kept sooner.
    """

    def __init__(self, limit: int):
        self.room = limit
        self.met = bytearray(limit // 16 + 1)

    def keep(self, found: dict[str, bytes]) -> None:
        if self.room > 0:
            met, n, again = self.met, len(self.met), []
            for c in found:
                at = hash(c) % n
                if met[at]:
                    again.append(c)
                else:
                    met[at] = 1
            self.room -= sum([len(c) + len(found[c]) for c in again]) + ENTRY_BYTES * len(again)
            self.update([(c, found[c]) for c in again])


class ChunkEncoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str = VOCABULARY, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for piece, i in vocabulary.items() if piece[0] == "Ġ"]] = True
        self.feeds = np.zeros(len(self.starts), bool)
        self.marks = dict(zip("\n,.", self._direct(list("\n,.")), strict=True)) | {"": b""}
        self.feeds[np.frombuffer(self.marks["\n"], "<u4")] = True
        self.memo = _Memo(memo_bytes)
        self.bare = _Memo(memo_bytes)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str], by: str, ends: np.ndarray) -> dict[str, bytes]:
        """The ids of each chunk, many encoded as one text and told apart by where ``ends`` marks an id of the joint."""
        out, odd = {}, []
        runs = [chunks[i : i + 512] for i in range(0, len(chunks), 512)]
        lead = by if by == " " else ""
        for run, got in zip(runs, self._direct([lead + by.join(r) for r in runs]), strict=True):
            at = np.flatnonzero(ends[np.frombuffer(got, "<u4")]) * 4
            if by == " ":  # the joint is part of the chunk that follows
                cuts, skip = [*at.tolist(), len(got)], 0
            else:
                cuts, skip = [-4, *at.tolist(), len(got)], 4
            if len(cuts) != len(run) + 1:
                odd += run
                continue
            out.update(zip(run, (got[a + skip : b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        out.update(zip(odd, self._direct([lead + c for c in odd]), strict=True))
        return out

    def _learn(self, memo: _Memo, wanted: set[str], by: str, ends: np.ndarray) -> dict[str, bytes]:
        """The wanted chunks' ids, from the memo or encoded now; the memo keeps them while it has room."""
        new = self._joined([c for c in wanted if c not in memo], by, ends)
        memo.keep(new)
        return new

    def _missing(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks that follow a space.

        A line feed between two other characters and a comma or full stop after
        a letter are always words of their own, so chunks are resolved by what
        lies between those, which recurs far more often.
        """
        memo, own, marks = self.memo, self.bare, self.marks
        ended, plans, opaque, others = [], [], [], []
        spaced: set[str] = set()
        bare: set[str] = set()
        for c in chunks:
            if c.isalpha():
                spaced.add(c)
            elif c[-1:] in (",", ".") and c[:-1].isalpha():
                spaced.add(c[:-1])
                ended.append(c)
            else:
                others.append(c)
        for c in others:
            lines = c.split("\n")
            if not all([x and not x[0].isspace() and not x[-1].isspace() for x in lines]):
                opaque.append(c)
                continue
            plan = [(x[:-1], x[-1]) if len(x) > 1 and x[-1] in ",." and x[-2].isalpha() else (x, "") for x in lines]
            spaced.add(plan[0][0])
            if len(plan) > 1:
                bare.update([core for core, _ in plan[1:]])
            if plan[0][0] != c:
                plans.append((c, plan))
        fresh = self._learn(memo, spaced, " ", self.starts)
        fresh_bare = self._learn(own, bare, "\n", self.feeds)
        out = {c: (memo.get(c[:-1]) or fresh[c[:-1]]) + marks[c[-1]] for c in ended}
        for c, plan in plans:
            core, tail = plan[0]
            ids = (memo.get(core) or fresh[core]) + marks[tail]
            for core, tail in plan[1:]:
                ids += marks["\n"] + (own.get(core) or fresh_bare[core]) + marks[tail]
            out[c] = ids
        out.update(zip(opaque, self._direct([" " + c for c in opaque]), strict=True))
        if memo.room > 0:
            memo.keep({c: x for c, x in out.items() if "\n" not in c})
        out.update(fresh)
        return out

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end of the last."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        aside = pc.match_substring_regex(texts, _UNSAFE)
        for x in self.special:
            aside = pc.or_(aside, pc.match_substring(texts, x))
        whole = np.flatnonzero(aside.to_numpy(zero_copy_only=False)).tolist()
        aside = texts.take(pa.array(whole, pa.int64()))
        if whole:
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        which, heads = coded.indices.to_numpy().astype(np.int64), offsets[:-1] - offsets[0]
        # A text's first chunk has no space before it; the others are looked up once each.
        first = self._direct([str(x) for x in split.flatten().take(pa.array(heads)).to_pylist()])
        for i, ids in zip(whole, self._direct(aside.to_pylist()), strict=True):
            first[i] = ids
        rest = np.ones(len(which), bool)
        rest[heads] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[which[rest]] = True
        which = (np.cumsum(used) - 1)[which]
        chunks = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memo.get, chunks))
        new = self._missing([c for c, x in zip(chunks, ids, strict=True) if x is None])
        ids = [new[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
        which[heads] = len(ids) + np.arange(len(heads))
        if end_id is not None:
            which = np.insert(which, np.append(heads[1:], len(which)), len(ids) + len(first))
            heads = heads + np.arange(len(heads))
        ids += [*first, b"" if end_id is None else np.array([end_id], "<u4").tobytes()]
        runs = pa.array(ids, pa.large_binary()).take(pa.array(which))
        _, ends, flat = runs.buffers()
        at = np.frombuffer(ends, np.int64, len(which) + 1) // 4
        return np.frombuffer(flat, "<u4", at[-1]), at[np.append(heads, len(which))]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
        gc.set_threshold(200_000, 100, 1000)  # the memo's strings and bytes can't form cycles, yet every collection walks it
    return _ENCODERS[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (doc_id, text) batches, their ids with end ids, and where each row's begin."""
    for batch in batches:
        for part in slices(batch, SLICE_BYTES):
            yield part, *encoder(path).encode(part.column("text").cast(pa.string()), end_id)
        pa.default_memory_pool().release_unused()


def list_bytes(column: pa.ListArray) -> Iterator[memoryview]:
    """Each row's ids, packed."""
    flat = memoryview(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]) * 4
    return (flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode whole texts and write them in ascending id order as one token table.

    Null and empty texts give the end id alone. Null ids come first; rows that
    share an id stay neighbours, in the order of their texts, and each gets a
    row. An empty table gives an empty token table. Other columns are ignored.
    Texts are encoded some megabytes at a time, whatever their number or length.
    """

    small_batches(df.sparkSession)

    def rows(batches):
        part, start = TaskContext.get().partitionId(), 0
        for batch, ids, at in encoded(batches, vocabulary, end_id):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(at) - 1, part, "i4")), pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype("i4")), pa.array(ids.view("<i4")))], names=TOKEN_SCHEMA.names)
            start += int(at[-1])

    docs = id_and_text(df, id_col, text_col)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(rows, TOKEN_SCHEMA).write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, part, part_start, n_tokens, ids; what a caller doesn't select isn't read."""
    return spark.read.schema(TOKEN_SCHEMA).parquet(path)


def part_starts(tokens: DataFrame) -> DataFrame:
    """part, base: the ids before each part. One row for each write task, from the counts alone."""
    before = F.sum("n").over(_by_part())
    return tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def with_crc(df: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ids_crc32, the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    small_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ids_crc32", T.LongType())])

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([zlib.crc32(x) for x in list_bytes(batch.column(ids))], pa.int64())], names=schema.names)

    return df.select(*keep, ids).mapInArrow(rows, schema)


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the token table written for it."""
    path = scratch_path(spark, "op1-tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    tokens = read_tokens(spark, path)
    digests = with_crc(tokens, ["doc_id", "part", "part_start", "n_tokens"])
    # The manifest has one row for each write task, so its size is bounded by the shuffle partitions.
    return digests.join(F.broadcast(part_starts(tokens)), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
