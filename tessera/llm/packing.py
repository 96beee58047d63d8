"""Best-two-fit packing of documents into fixed-length token sequences.

Operator 6. Documents become token ids; only those longer than a sequence are
cut, the first piece taking what whole pieces leave. Pieces of equal length are
interchangeable, so the packing is made for the histogram of lengths, which has
at most as many rows as a sequence has tokens, however large the corpus. A bin
is filled greedily with the longest pieces that fit; then its smallest piece
gives way to the two unpacked pieces that fill the widened gap best. The bin is
repeated as often as the histogram allows. Ranks of the pieces of one length,
counted by part and summed over parts, then say which piece goes where.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_and_text, small_batches
from tessera.llm.tokens import END_ID, FILE_OPTIONS, VOCABULARY, encoded, with_crc
from tessera.session import scratch_path

CAPACITY = 2048

PIECE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_rank", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


@dataclass
class Bin:
    """Lengths that fill a sequence, longest first, and how many sequences are filled so."""

    lengths: list[int]
    times: int


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Iterator[Bin]:
    """Bins that hold every piece of the histogram {length: count} once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] += count
    while (open_lengths := np.flatnonzero(left)).size:
        used: Counter[int] = Counter()
        lengths: list[int] = []

        def fill(gap: int, lengths=lengths, used=used, open_lengths=open_lengths) -> int:
            i = int(np.searchsorted(open_lengths, gap, "right")) - 1
            while i >= 0 and gap:
                x = int(open_lengths[i])
                take = min(gap // x, int(left[x]) - used[x])
                if take > 0:
                    lengths.extend([x] * take)
                    used[x] += take
                    gap -= take * x
                i = min(i - 1, int(np.searchsorted(open_lengths, gap, "right")) - 1)
            return gap

        gap = fill(capacity)
        if gap:
            smallest = min(lengths)
            pair = _best_pair(open_lengths, left, used, smallest + gap)
            if pair and sum(pair) > smallest:
                lengths.remove(smallest)
                used[smallest] -= 1
                for x in pair:
                    lengths.append(x)
                    used[x] += 1
                fill(smallest + gap - sum(pair))
        times = min(int(left[x]) // n for x, n in used.items() if n)
        for x, n in used.items():
            left[x] -= n * times
        yield Bin(sorted(lengths, reverse=True), times)


def _best_pair(open_lengths: np.ndarray, left: np.ndarray, used: Counter, space: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum up to ``space``."""
    free = left[open_lengths] - np.array([used.get(int(x), 0) for x in open_lengths])
    xs = open_lengths[(free > 0) & (open_lengths < space)]
    if not xs.size:
        return None
    partner = np.searchsorted(xs, space - xs, "right") - 1
    # A length with one piece left can't be its own partner.
    single = np.array([left[x] - used.get(int(x), 0) < 2 for x in xs])
    partner = np.where((partner >= 0) & (partner == np.arange(xs.size)) & single, partner - 1, partner)
    sums = np.where(partner >= 0, xs + xs[partner], -1)
    best = int(np.argmax(sums))
    return (int(xs[best]), int(xs[partner[best]])) if sums[best] > 0 else None


class Placement:
    """Where the piece of a length and rank goes. Its size is bounded by the capacity, not by the corpus."""

    def __init__(self, bins: Iterator[Bin]):
        rows, ranks, sequence = [], Counter(), 0
        for b in bins:
            offset = 0
            for length, n in sorted(Counter(b.lengths).items(), reverse=True):
                rows.append((length, ranks[length], n, sequence, offset))
                ranks[length] += n * b.times
                offset += n * length
            sequence += b.times
        rows.sort()
        self.n_sequences = sequence
        self.length, self.first, self.n, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.keys = (self.length << 48) + self.first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 48) + rank, "right") - 1
        turn, slot = np.divmod(rank - self.first[at], self.n[at])
        return self.sequence[at] + turn, self.offset[at] + slot * length


def write_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode whole texts, cut the long ones, and write a row a piece with its ids.

    ``part`` and ``part_rank`` number the pieces of one length within a write
    task. Null and empty texts are a piece of the end id alone; null ids, ties
    and repeated rows are packed like any other row; an empty table gives no
    pieces. Other columns are ignored.
    """

    small_batches(df.sparkSession)

    def rows(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, ids, at in encoded(batches, vocabulary, end_id):
            n = np.diff(at)
            first = (n - 1) % capacity + 1
            pieces = (n - first) // capacity + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1]) if len(ordered) else np.array([], np.int64)
            sizes = np.diff([*heads, len(ordered)])
            rank = np.empty(len(length), np.int64)
            rank[order] = seen[ordered] + np.arange(len(ordered)) - np.repeat(heads, sizes)
            seen[ordered[heads]] += sizes
            # Pieces follow each other as their documents' ids do.
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype("i4")), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(np.full(len(length), part, "i4")), pa.array(rank), lists], names=PIECE_SCHEMA.names)

    id_and_text(df, id_col, text_col).mapInArrow(rows, PIECE_SCHEMA).write.options(**FILE_OPTIONS).parquet(path)


def read_pieces(spark, path: str) -> DataFrame:
    return spark.read.schema(PIECE_SCHEMA).parquet(path)


def place_pieces(rows: DataFrame, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows``, which have the pieces' length, part and part_rank, with sequence_id and offset for those three."""
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # A length has a row for each part, so no window group is larger than the number of write tasks.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    # At most ``capacity`` rows come to the driver.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placement = rows.sparkSession.sparkContext.broadcast(Placement(best_two_fit(histogram, capacity)))
    kept = [c for c in rows.columns if c not in ("part", "part_rank")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches):
        for batch in batches:
            rank = batch.column("base").to_numpy() + batch.column("part_rank").to_numpy()
            sequence, offset = placement.value.place(batch.column("length").to_numpy(), rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=schema.names)

    return rows.join(base, ["length", "part"]).select(*kept, "part_rank", "base").mapInArrow(placed, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every piece with its ids and its place."""
    path = scratch_path(df.sparkSession, "pieces")
    write_pieces(df, path, id_col, text_col, capacity, vocabulary, end_id)
    pieces = read_pieces(df.sparkSession, path)
    return place_pieces(pieces, pieces, capacity)


def pack_digests(df: DataFrame, **options) -> DataFrame:
    """``pack`` with the CRC-32 of a piece's ids instead of the ids, which then needn't be shuffled."""
    path = scratch_path(df.sparkSession, "pieces")
    write_pieces(df, path, **options)
    pieces = read_pieces(df.sparkSession, path)
    digests = with_crc(pieces, ["doc_id", "piece", "start", "length", "part", "part_rank"])
    return place_pieces(digests, pieces, options.get("capacity", CAPACITY)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return pack_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
