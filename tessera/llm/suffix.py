"""Removal of repeated byte strings with sharded suffix arrays.

Operator 8. Every byte that lies in a ``length``-byte string that also starts
somewhere else is removed.

Sharding: the smallest hash of the ``KMER``-byte strings inside a window of
``length`` bytes depends on the window alone, so equal windows carry equal
hashes and meet in the shard of that hash. Neighbouring windows with the same
smallest hash form a segment; only segments whose hash occurs twice or more
anywhere can hold a repeat, and only these are cut out and shuffled.

A shard's distinct segments become one suffix array by induced sorting: suffixes
are classified by whether they are smaller than their right neighbour, the
leftmost-smaller substrings are sorted and named by one induction, the string
of names is sorted, and a second induction gives the array. Inductions go
bucket by bucket, each bucket in array operations. The string of names is sorted
by recursion where the names are few; where they are many it has too many
buckets for that and is sorted by doubling. Permuted common prefixes then
need comparisons only where the characters before two neighbours differ, and
drop by one from there. Windows with a common prefix of ``length`` or more are
repeats.

No shard outgrows a task. Copies in a shard of more than ``COPIES_BYTES`` are
first put together, one row a distinct segment, which only says whether there
were several. Where the distinct ones are more than ``SHARD_BYTES``, the shard
is cut by longer keys (``STEPS``): windows that start about as far before the
shard's hashed string share more than that string, and the hash of all that
they share names a smaller shard, which goes the same way. At the last step a
shard holds one window. Joins back to segments and texts deal frequent segments
over salts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_and_text, join_hot, slices, small_batches, text_key
from tessera.session import materialize

LENGTH = 200
KMER = 32
COPIES_BYTES = 1 << 17
SHARD_BYTES = 1 << 20
STEPS = (57, 19, 7, 1)  # how far apart the windows of a cut shard start at most
RECURSE_NAMES = 512
ARRAY_BYTES = 1 << 20
SLICE_BYTES = 1 << 20

_MIX = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k-byte string of the data, k a power of two."""
    h, base = _MIX[data], _BASE
    width = 1
    while width < k:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, kmer: int = KMER):
    """(text number, hash, first window, last window, occurrences of the hash) of each segment of the texts that end at ``ends``."""
    nothing = (np.zeros(0, np.int64),) * 5
    if len(data) < length:
        return nothing
    h = _kmer_hashes(data, kmer)
    width = length - kmer + 1
    low = _sliding(h, width, np.minimum)
    starts = np.append(0, ends[:-1])
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(low)]
    inside = np.arange(len(low)) + length <= ends[text]
    breaks = np.ones(len(low), bool)
    breaks[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(breaks & inside)
    if not len(first):
        return nothing
    stops = np.append(np.flatnonzero(breaks | ~inside), len(low))
    last = stops[np.searchsorted(stops, first, "right")] - 1
    hashes = low[first]
    # An occurrence of a segment's hash belongs to the last segment with that hash that starts at or before it.
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, low, np.uint64(0)), np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero(most == h)
    order = np.lexsort((first, hashes))
    key = first[order]
    found = np.zeros(len(first), np.int64)
    if len(at):
        # Positions are searched within each hash's run of segments.
        merged = np.lexsort((np.concatenate([np.zeros(len(key), np.int8), np.ones(len(at), np.int8)]), np.concatenate([key, at]), np.concatenate([hashes[order], h[at]])))
        is_segment = merged < len(key)
        owner = np.cumsum(is_segment) - 1
        occurrence = ~is_segment
        mine = owner[occurrence]
        ok = (mine >= 0) & (hashes[order][np.maximum(mine, 0)] == h[at][merged[occurrence] - len(key)])
        found[order] = np.bincount(mine[ok], minlength=len(key))
    return text[first], hashes.view(np.int64), first - starts[text[first]], last - starts[text[first]], np.maximum(found, 1)


def _is_smaller(s: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next; the last, a unique smallest character, counts as smaller."""
    n = len(s)
    change = np.where(s[:-1] != s[1:], np.arange(n - 1), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    return np.append(s[change] < s[np.minimum(change + 1, n - 1)], True)


def _spread(out: np.ndarray, at: np.ndarray, items: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Put items into their characters' buckets in order, from ``at`` on, upwards or downwards."""
    if at.size <= 1 << 16:
        chars = chars.astype(np.uint16)  # numbers this short are sorted by radix, in linear time
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    sizes = np.diff(np.append(heads, len(c)))
    rank = np.arange(len(c)) - np.repeat(heads, sizes)
    out[at[c] + step * rank] = items[order]
    at[c[heads]] += step * sizes


def _induce(s: np.ndarray, small: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The suffix array that follows from leftmost-smaller positions in order."""
    n = len(s)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, np.int64)
    tails = ends - 1
    _spread(sa, tails.copy(), marks[::-1], s[marks[::-1]], -1)
    marked = np.bincount(s[marks], minlength=len(sizes))
    used = np.flatnonzero(sizes)
    # Larger suffixes, by ascending bucket: first those that the bucket has got so far, then its marks.
    at = heads.copy()
    for c in used.tolist():
        pushed, cur = [], sa[heads[c] : at[c]]
        while len(cur):
            before = cur[cur > 0] - 1
            before = before[~small[before]]
            ch = s[before]
            pushed.append(before[ch != c])
            cur = before[ch == c]
            sa[at[c] : at[c] + len(cur)] = cur
            at[c] += len(cur)
        own = sa[ends[c] - marked[c] : ends[c]]
        before = own[own > 0] - 1
        pushed.append(before[~small[before]])
        items = np.concatenate(pushed)
        if len(items):
            _spread(sa, at, items, s[items], 1)
    larger_end = at
    # Smaller suffixes, by descending bucket; the marks give way to what they are found to be.
    at = tails.copy()
    for c in used[::-1].tolist():
        pushed, cur = [], sa[at[c] + 1 : ends[c]][::-1]
        while len(cur):
            before = cur[cur > 0] - 1
            before = before[small[before]]
            ch = s[before]
            pushed.append(before[ch != c])
            cur = before[ch == c]
            if len(cur):
                sa[at[c] - len(cur) + 1 : at[c] + 1] = cur[::-1]
                at[c] -= len(cur)
        own = sa[heads[c] : larger_end[c]][::-1]
        before = own[own > 0] - 1
        pushed.append(before[small[before]])
        items = np.concatenate(pushed)
        if len(items):
            _spread(sa, at, items, s[items], -1)
    sa[0] = n - 1
    return sa


def _ranks_by_doubling(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    c = names[order]
    heads = np.append(True, c[1:] != c[:-1])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    open_ = order[~(heads & np.append(heads[1:], True))]
    step = 1
    while len(open_):
        nxt = open_ + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((second, rank[open_]))
        items, first, second = open_[by], rank[open_][by], second[by]
        new_group = np.append(True, first[1:] != first[:-1])
        heads = new_group | np.append(True, second[1:] != second[:-1])
        position = np.arange(len(items))
        start = np.maximum.accumulate(np.where(new_group, position, 0))
        rank[items] = first + np.maximum.accumulate(np.where(heads, position, 0)) - start
        open_ = items[~(heads & np.append(heads[1:], True))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, whose last is its unique smallest.

    Names that all differ are their own order; few names are sorted by
    recursion. With many, a recursion visits more buckets than there is work in
    them, and they are sorted by doubling.
    """
    most = int(names.max()) + 1
    if most == len(names):
        return np.argsort(names)
    return suffix_array(names) if most <= RECURSE_NAMES else _ranks_by_doubling(names)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a string of small non-negative integers whose last is its unique smallest."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _is_smaller(s)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s)
    rough = _induce(s, small, sizes, marks[np.argsort(s[marks], kind="stable")])
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    ordered = rough[is_mark[rough]]
    # Equal neighbours among the sorted marked substrings share a name. A substring ends with the next mark.
    until = np.append(marks[1:], n - 1) - marks + 1
    size = np.zeros(n, np.int64)
    size[marks] = until
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    left = np.flatnonzero(same)
    t = 0
    while len(left):
        equal = s[a[left] + t] == s[b[left] + t]
        same[left[~equal]] = False
        t += 1
        left = left[equal & (size[a[left]] > t)]
    name = np.zeros(n, np.int64)
    name[ordered] = np.append(0, np.cumsum(~same))
    return _induce(s, small, sizes, marks[_order_of_names(name[marks])])


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the starts of its ``length``-byte windows that start elsewhere too, in it or another part."""
    sizes = np.array([len(p) for p in parts], np.int64)
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    n = len(joined)
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = joined.astype(np.int64) + 2
    s[starts + sizes] = 1  # parts end with a character of their own
    sa = suffix_array(np.append(s, 0))[1:]
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    stop = np.repeat(starts + sizes, sizes + 1)
    room = stop - np.arange(n)
    # Common prefixes with the neighbour, compared where the characters before differ and one less after that.
    prior = before - 1
    i = np.arange(n)
    direct = (before <= 0) | (i == 0)
    direct[1:] |= s[:-1] == 1
    ok = ~direct
    direct[ok] = s[i[ok] - 1] != s[prior[ok]]
    todo = np.flatnonzero(direct & (before >= 0))
    common = np.zeros(n, np.int64)
    padded = np.concatenate([joined, np.zeros(16, np.uint8)]).tobytes()
    eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    other = before[todo]
    limit = np.minimum(room[todo], room[other])
    got = np.zeros(len(todo), np.int64)
    active = np.flatnonzero(limit > 0)
    while len(active):
        p, q = todo[active] + got[active], other[active] + got[active]
        x = eight[p] ^ eight[q]
        match = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        got[active] = np.minimum(got[active] + match, limit[active])
        active = active[(match == 8) & (got[active] < limit[active])]
    common[todo] = got
    last = np.maximum.accumulate(np.where(direct, i, 0))
    common = np.maximum(common[last] - (i - last), 0)
    flag = np.zeros(n, bool)
    hits = np.flatnonzero((common >= length) & (before >= 0))
    flag[hits] = True
    flag[before[hits]] = True
    return [np.flatnonzero(flag[a : a + z]) for a, z in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]


ANCHOR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("n", T.IntegerType())])
PACKED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("z", T.BinaryType())])
SEGMENT = T.StructType([T.StructField("hash", T.LongType()), T.StructField("sid", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("seg", T.BinaryType()), T.StructField("n", T.IntegerType())])
FLAGGED = T.StructType([T.StructField("sid", T.BinaryType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
KEPT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def _anchors(length: int, kmer: int):
    def rows(batches):
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                sizes = np.array([len(x) for x in part.column("text").cast(pa.binary()).to_pylist()], np.int64)
                data = np.frombuffer(b"".join(part.column("text").cast(pa.binary()).to_pylist()), np.uint8)
                text, hashes, first, last, n = segments(data, np.cumsum(sizes), length, kmer)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("h").take(take), pa.array(hashes), pa.array(first.astype("i4")), pa.array(last.astype("i4")), pa.array(n.astype("i4"))], names=ANCHOR.names)

    return rows


def _pack(batches):
    """Texts as Zstandard frames: they travel twice, at less than half the size."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices(batch, SLICE_BYTES):
            z = [packer.compress(x) for x in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(z, pa.binary())], names=PACKED.names)


def _cut(length: int):
    def rows(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out, seen = [], {}
                for doc_id, h, z, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "h", "z", "found")), strict=True):
                    data = unpacker.decompress(z)
                    for f in found:
                        seg = data[f["first"] : f["last"] + length]
                        sid = xxhash.xxh128_digest(seg)
                        if sid in seen:  # the bytes of a segment leave a run of rows once
                            out[seen[sid]][6] += 1
                            out.append([f["hash"], sid, doc_id, h, f["first"], None, 0])
                        else:
                            seen[sid] = len(out)
                            out.append([f["hash"], sid, doc_id, h, f["first"], seg, 1])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=SEGMENT.names)

    return rows


def _flag(length: int):
    def emit(group: dict[bytes, list]):
        sids, firsts, lasts = [], [], []
        for (sid, (seg, n)), starts in zip(group.items(), repeated_windows([x for x, _ in group.values()], length), strict=True):
            if n > 1:
                starts = np.arange(len(seg) - length + 1)
            if len(starts):
                a, b = _runs(starts)
                sids += [sid] * len(a)
                firsts.append(a)
                lasts.append(b)
        if sids:
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), *(pa.array(np.concatenate(x).astype("i4")) for x in (firsts, lasts))], names=FLAGGED.names)

    def rows(batches):
        group, size, current = {}, 0, None
        for batch in batches:
            for hash_, sid, seg, n in zip(*(batch.column(c).to_pylist() for c in ("hash", "sid", "seg", "n")), strict=True):
                if hash_ != current and size >= ARRAY_BYTES:
                    yield from emit(group)
                    group, size = {}, 0
                current = hash_
                if sid in group:
                    group[sid][1] += n
                else:
                    group[sid] = [seg, n]
                    size += len(seg)
        if group:
            yield from emit(group)

    return rows


SPLIT = T.StructType([*(f for f in SEGMENT if f.name in ("hash", "sid", "seg", "n")), T.StructField("parent", T.BinaryType()), T.StructField("off", T.IntegerType()), T.StructField("kmer", T.IntegerType())])


def _split(length: int, step: int):
    """Segments cut where their windows' distance to the shard's hashed string passes a multiple of ``step``, under keys of all that the windows of a part share.

    ``kmer``: the size of the string that ``hash`` names, at the place in the
    segment that its own rows tell: where the smallest hash of that size is.
    """

    def rows(batches):
        for batch in batches:
            for hash_, sid, seg, n, kmer in zip(*(batch.column(c).to_pylist() for c in ("hash", "sid", "seg", "n", "kmer")), strict=True):
                data = np.frombuffer(seg, np.uint8)
                windows = len(data) - length + 1
                low = _kmer_hashes(data, kmer)
                anchors = np.flatnonzero(low == low.min())
                # A window's distance is that to the first of those strings inside it.
                start = np.arange(windows)
                far = anchors[np.searchsorted(anchors, start)] - start
                part = far // step
                cut = np.append(0, np.flatnonzero((np.diff(part) != 0) | (np.diff(far) != -1)) + 1)
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), windows], strict=True):
                    p = int(part[a])
                    anchor = a + int(far[a])
                    shared = seg[anchor - p * step : anchor - min(p * step + step - 1, length - kmer) + length]
                    sub = seg[a : b - 1 + length]
                    key = xxhash.xxh64_intdigest(shared, (hash_ + 31 * p + step) % (1 << 64)) - (1 << 63)
                    yield key, xxhash.xxh128_digest(sub), sub, n, sid, a, kmer

    def batches_of(batches):
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SPLIT_TYPES, strict=True)], names=SPLIT.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SPLIT_TYPES, strict=True)], names=SPLIT.names)

    return batches_of


SPLIT_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32())


def _crowded(units: DataFrame, shard_bytes: int) -> DataFrame:
    """The hashes of shards beyond the bound: one for each ``shard_bytes`` of segments at most. A written table, whose size Spark knows."""
    return materialize(units.groupBy("hash").agg(F.sum(F.octet_length("seg")).alias("size")).where(F.col("size") > shard_bytes).select("hash"), "suffix-crowded")


def _arrays(units: DataFrame, length: int) -> DataFrame:
    return units.repartition("hash").sortWithinPartitions("hash", "sid").mapInArrow(_flag(length), FLAGGED)


def repeated_in_shards(units: DataFrame, length: int = LENGTH, kmer: int = KMER, shard_bytes: int = SHARD_BYTES, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """sid, a, b: runs of windows of a segment that start elsewhere too. ``units``: hash, sid, seg, n, the same segment any number of times."""
    crowded = _crowded(units, min(COPIES_BYTES, shard_bytes))
    found = _arrays(units.join(crowded, "hash", "left_anti"), length)
    if crowded.isEmpty():
        return found
    # Copies meet in a partial aggregate before any shuffle.
    distinct = materialize(units.join(crowded, "hash", "left_semi").groupBy("hash", "sid").agg(F.first("seg").alias("seg"), F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")), "suffix-distinct")
    still = _crowded(distinct, shard_bytes) if steps else None
    if still is None or still.isEmpty():
        return found.union(_arrays(distinct, length))
    found = found.union(_arrays(distinct.join(still, "hash", "left_anti"), length))
    parts = distinct.join(still, "hash", "left_semi").withColumn("kmer", F.lit(kmer)).mapInArrow(_split(length, steps[0]), SPLIT)
    parts = materialize(parts, "suffix-parts")
    # The windows of a part differ from each other, so one that shares its key with no other has no repeat.
    shared = parts.groupBy("hash").agg(F.sum("n").alias("times")).where("times > 1").select("hash")
    inner = repeated_in_shards(parts.join(shared, "hash", "left_semi").select("hash", "sid", "seg", "n"), length, kmer, shard_bytes, steps[1:])
    back = join_hot(parts.select("sid", "parent", "off"), inner, "sid").select(F.col("parent").alias("sid"), (F.col("a") + F.col("off")).alias("a"), (F.col("b") + F.col("off")).alias("b"))
    return found.union(back)


def _keep(length: int):
    def rows(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                kept, sizes, spans = [], [], []
                for z, found in zip(*(part.column(c).to_pylist() for c in ("z", "found")), strict=True):
                    data, out, runs, end = unpacker.decompress(z), [], [], 0
                    for a, b in sorted((f["a"], f["b"] + length) for f in found or []):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    for a, b in runs:
                        out.append(data[end:a])
                        end = b
                    out.append(data[end:])
                    kept.append(b"".join(out))
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, kind)], names=KEPT.names)

    return rows


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kmer: int = KMER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, spans (removed runs, end exclusive) of every row.

    Texts are their UTF-8 bytes, null ones empty. Strings never cross texts and
    are judged on the input. Repeated rows repeat each other, so they lose every
    byte if they are ``length`` bytes or longer; null ids are ids like others.
    Shorter texts are kept whole. Other columns are ignored; an empty table
    gives an empty result.
    """
    small_batches(df.sparkSession)
    docs = id_and_text(df, id_col, text_col).select("doc_id", text_key().alias("h"), "text")
    long_enough = docs.where(F.octet_length("text") >= length)
    anchors = materialize(long_enough.mapInArrow(_anchors(length, kmer), ANCHOR), "suffix-anchors")
    repeated = anchors.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    candidates = anchors.join(repeated, "hash", "left_semi").groupBy("doc_id", "h").agg(F.collect_set(F.struct("hash", "first", "last")).alias("found"))
    packed = docs.mapInArrow(_pack, PACKED)
    with_texts = packed.alias("d").join(candidates.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.h") == F.col("c.h"))).select("d.doc_id", "d.h", "d.z", "c.found")
    cut = materialize(with_texts.mapInArrow(_cut(length), SEGMENT), "suffix-segments")
    flagged = repeated_in_shards(cut.where("seg is not null").select("hash", "sid", "seg", "n"), length, kmer, shard_bytes).distinct()
    found = join_hot(cut.select("sid", "doc_id", "h", "at"), flagged, "sid").select("doc_id", "h", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    by_doc = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    joined = packed.alias("d").join(by_doc.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left").select("d.doc_id", "d.z", "f.found")
    return joined.mapInArrow(_keep(length), KEPT)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
