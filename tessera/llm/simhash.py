"""SimHash near-duplicates with sharded BK-trees.

Operator 4. A document's fingerprint takes the majority of each bit over the
64-bit hashes of its word shingles; documents link where fingerprints differ in
at most ``radius`` bits, and linked documents form components.

Only distinct fingerprints are compared. Cut into ``blocks`` blocks of bits, two
fingerprints within the radius agree on all but ``radius`` of the blocks at
least, so each choice of agreeing blocks and their bits names a shard, and every
link lies within some shard. A shard's fingerprints become a BK-tree: children
are keyed by their Hamming distance to the parent, and a search follows only
edges within the radius of its own distance. Shard trees travel by shuffle with
the fingerprints that search them: a broadcast of all trees would grow with the
corpus. Trees of many shards are built and searched level by level at once.

A shard beyond ``SHARD_LIMIT`` fingerprints is cut into chunks; every pair of
its chunks is a task's tree and searchers, so nothing is left out and no task
holds an unbounded shard. Shards send on a spanning star of each group that
they find, not all pairs.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices, small_batches
from tessera.operators.components import connected_components
from tessera.session import materialize

RADIUS = 3
SEED = 42
SHARD_LIMIT = 2048
BATCH = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a whole text; zero without words. A-Z are lower-cased, words end at ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = list(map(b" ".join, zip(*(islice(found, k, None) for k in range(words)), strict=False))) if len(found) >= words else [b" ".join(found)]
    hash_ = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 15
    for i in range(0, len(shingles), step):
        hashes = np.fromiter([hash_(s, SEED) for s in shingles[i : i + step]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def rows(batches):
        for batch in batches:
            for part in slices(batch, 4 << 20):
                fps = np.array([fingerprint(x, words) for x in part.column("text").to_pylist()], "u8").view("i8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=schema.names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one or more 64-bit words, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees over slices of one array of distinct fingerprints (rows of 64-bit words), a tree for each shard."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray, member: np.ndarray):
        """shard: number of each item's shard, ascending; member: whether the item is in its shard's tree."""
        self.fps = fps
        self.span = 64 * fps.shape[1] + 1
        items = np.flatnonzero(member)
        self.root = np.full(int(shard[-1]) + 1 if len(shard) else 0, -1, np.int64)
        firsts = items[np.unique(shard[items], return_index=True)[1]]
        self.root[shard[firsts]] = firsts
        rest = np.setdiff1d(items, firsts, assume_unique=True)
        at = self.root[shard[rest]]
        edges, children = [], []
        while rest.size:
            edge = at * self.span + _distance(fps[rest], fps[at])
            # The first item at an edge becomes the child there; the others go on below it.
            made, first, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(made)
            children.append(rest[first])
            stay = np.ones(len(rest), bool)
            stay[first] = False
            at, rest = rest[first][which][stay], rest[stay]
        order = np.argsort(edges := np.concatenate([np.zeros(0, np.int64), *edges]))
        self.edges, self.children = edges[order], np.concatenate([np.zeros(0, np.int64), *children])[order]

    def search(self, items: np.ndarray, shard: np.ndarray, radius: int):
        """Pairs (searcher, tree item) within the radius, in blocks."""
        roots = self.root[shard[items]]
        stack = [(items[roots >= 0], roots[roots >= 0])]
        while stack:
            who, node = stack.pop()
            if len(who) > BATCH:
                half = len(who) // 2
                stack += [(who[:half], node[:half]), (who[half:], node[half:])]
                continue
            d = _distance(self.fps[who], self.fps[node])
            hit = (d <= radius) & (who != node)
            if hit.any():
                yield who[hit], node[hit]
            low = np.searchsorted(self.edges, node * self.span + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * self.span + np.minimum(d + radius, self.span - 1), "right") - low
            ends = np.cumsum(n)
            if len(ends) and ends[-1]:
                stack.append((np.repeat(who, n), self.children[np.repeat(low - ends + n, n) + np.arange(ends[-1])]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the items that pairs connect the smallest label among them."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:  # labels are items too: follow them to the end
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _shard_links(bucket: np.ndarray, fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the groups in whole shards, as item numbers; role 1: in the tree, 2: searches it, 3: both."""
    shard = np.cumsum(np.append(0, bucket[1:] != bucket[:-1]))
    forest = BKForest(fps, shard, (role & 1) > 0)
    label = np.arange(len(fps))
    for a, b in forest.search(np.flatnonzero(role & 2), shard, radius):
        _merge(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return linked, label[linked]


def _keys(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks, as lists of (shift, bits), that ``n`` distinct fingerprints are sharded by.

    More fingerprints get more and longer keys; each set of choices finds every link.
    """
    blocks = radius + 1
    while blocks < 2 * radius and n >> (64 * (blocks - radius) // blocks) > 256:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in combinations(range(blocks), blocks - radius)]


def links(fps: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """a, b: pairs of distinct fingerprints within the radius that connect all that such pairs connect. ``fps``: column fp, without repeats."""

    def bits(shift: int, width: int):
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    choices = _keys(fps.count(), radius)
    keys = F.array(*(F.xxhash64(F.lit(i), *(bits(*c) for c in chosen)) for i, chosen in enumerate(choices)))
    return shard_links(fps.select("fp", F.explode(keys).alias("shard")), radius, shard_limit)


def _dealt(keyed: DataFrame, shard_limit: int) -> DataFrame:
    """``keyed`` with bucket and role (1: in the tree, 2: searches it, 3: both); every pair of a shard meets in a bucket of at most two chunks."""
    # Only shards beyond the limit have a row here: one for each ``shard_limit`` keyed fingerprints at most.
    crowded = keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit).select("shard", F.ceil(F.col("n") / shard_limit).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    spread = keyed.join(crowded, "shard", "left").withColumn("own", own).withColumn("other", F.explode(F.expr("if(chunks is null, array(0), sequence(0, chunks - 1))")))
    pair = F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))
    role = F.when(F.col("chunks").isNull() | (F.col("own") == F.col("other")), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    kept = [c for c in keyed.columns if c != "shard"]
    return spread.select(F.when(F.col("chunks").isNull(), F.col("shard")).otherwise(pair).alias("bucket"), *kept, role.alias("role")).repartition("bucket").sortWithinPartitions("bucket")


def _words(column) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy().view("u8").reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _runs(batches, name: str, limit: int = BATCH):
    """Tables of about ``limit`` rows that end where the column's value changes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for i in range(0, batch.num_rows, limit):
            held.append(batch.slice(i, limit))
            n += held[-1].num_rows
            if n >= limit:
                t = pa.Table.from_batches(held)
                value = t.column(name).to_numpy()
                end = int(np.flatnonzero(value == value[-1])[0])
                held, n = t.slice(end).to_batches(), len(value) - end
                if end:
                    yield t.slice(0, end)
    if n:
        yield pa.Table.from_batches(held)


def shard_links(keyed: DataFrame, radius: int, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """a, b: links that connect what pairs of fingerprints within the radius connect in any shard.

    ``keyed``: fp, a long or the bytes of several 64-bit words, and shard, without repeats.
    """
    kind = keyed.schema["fp"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def rows(batches):
        for t in _runs(batches, "bucket"):
            fp = t.column("fp").combine_chunks()
            a, b = _shard_links(t.column("bucket").to_numpy(), _words(fp), t.column("role").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([fp.take(pa.array(a)), fp.take(pa.array(b))], names=schema.names)

    return _dealt(keyed, shard_limit).mapInArrow(rows, schema).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, fp, component_id (the smallest id of the component) of every row.

    Null and empty texts, and texts without words, have fingerprint zero and
    link like any other. Equal texts, repeated rows included, share a component.
    Null ids take part; a component of nothing else has a null id. Other columns
    are ignored; an empty table gives an empty result.
    """
    docs = materialize(fingerprints(df, id_col, text_col, words), "simhash-fingerprints")
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(distinct.select("fp"), radius, shard_limit))
    labelled = materialize(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label")), "simhash-labels")
    component = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return docs.join(labelled.select("fp", "label").join(component, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


WIDE_WORDS = 4
BAND_SEEDS = 24
BANDS = 12
FEW_SHINGLES = 64
DEVIATIONS = 4
VERIFY_ROWS = 2048


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, ascending; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, "<u8")
    shingles = set(map(b" ".join, zip(*(islice(found, k, None) for k in range(words)), strict=False))) if len(found) >= words else {b" ".join(found)}
    return np.unique(np.fromiter([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8", len(shingles)))


def wide_fingerprint(hashes: np.ndarray, similarity: float) -> tuple[bytes, list[int], list[int]]:
    """A fingerprint of ``WIDE_WORDS`` words of 64 bits over distinct shingles with a digest of their set, and its shards.

    Each of ``BANDS`` shards is named by the smallest shingle hashes under two
    hash functions: texts of similarity s share one with probability s ** 2,
    and miss all twelve at 0.8 with probability 0.000005. The first list has
    the shards that are searched by distance. Over fewer than ``FEW_SHINGLES``
    the distance tells too little: those texts, and all that can be similar to
    one of them, are in the shards of the second list.
    """
    if not hashes.size:
        return bytes(8 * (WIDE_WORDS + 2)), [], []
    out = []
    for k in range(WIDE_WORDS):
        ones, mixed = np.zeros(64, np.int64), _mix(hashes, k) if k else hashes
        for i in range(0, len(mixed), 1 << 15):
            ones += np.unpackbits(mixed[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes())
    least = np.array([_mix(hashes, 1000 + k).min() for k in range(BAND_SEEDS)], np.uint64)
    width = BAND_SEEDS // BANDS

    def shards(first: int) -> list[int]:
        return [xxhash.xxh64_intdigest(least[b * width : (b + 1) * width].tobytes(), first + b) - (1 << 63) for b in range(BANDS)]

    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return b"".join([*out, digest]), shards(0) if len(hashes) >= FEW_SHINGLES else [], shards(BANDS) if len(hashes) * similarity < FEW_SHINGLES else []


def candidate_groups(keyed: DataFrame, radius: int, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """grp, fp: groups of two or more fingerprints that distances within the radius connect in a shard, or that share a shard of few shingles.

    ``keyed``: fp, few and shard, without repeats. A group has at most two
    chunks' fingerprints and is named by its members, so groups that several
    shards find are one.
    """
    schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("fp", T.BinaryType())])

    def rows(batches):
        for t in _runs(batches, "bucket"):
            bucket, few, fp = t.column("bucket").to_numpy(), t.column("few").to_numpy(), t.column("fp").combine_chunks()
            # A bucket of few shingles is a group as it is.
            label = np.searchsorted(bucket, bucket)
            far = np.flatnonzero(~few)
            label[far] = far
            if far.size:
                a, b = _shard_links(bucket[far], _words(fp.take(pa.array(far)))[:, :WIDE_WORDS], t.column("role").to_numpy()[far], radius)
                label[far[a]] = far[b]
            order = np.argsort(label, kind="stable")
            cuts = np.flatnonzero(np.diff(label[order])) + 1
            for members in np.split(order, cuts):
                if len(members) > 1:
                    keys = sorted(fp.take(pa.array(members)).to_pylist())
                    name = xxhash.xxh64_intdigest(b"".join(keys)) - (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), name)), pa.array(keys, pa.binary())], names=schema.names)

    return _dealt(keyed, shard_limit).mapInArrow(rows, schema).distinct()


def similar_items(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the smallest number of a set that it is connected with by pairs of that Jaccard similarity or more.

    Every pair is compared, whole, but those that others connect already and
    those whose sizes rule it out.
    """
    n = np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.cumsum(n) - n
    label, mark = np.arange(len(sets)), np.zeros(int(flat.max(initial=0)) + 1, bool)
    for a in range(len(sets)):
        fit = np.minimum(n, n[a]) >= (similarity - 1e-9) * np.maximum(n, n[a])
        fit[: a + 1] = False
        others = np.flatnonzero(fit & (label != label[a]))
        if not others.size:
            continue
        own = flat[first[a] : first[a] + n[a]]
        mark[own] = True
        step = max(1, (1 << 22) // int(n[a]))
        for i in range(0, len(others), step):
            b = others[i : i + step]
            ends = np.cumsum(n[b])
            common = np.add.reduceat(mark[flat[np.repeat(first[b] - ends + n[b], n[b]) + np.arange(ends[-1])]], ends - n[b], dtype=np.int64)
            near = b[common / (n[a] + n[b] - common) >= similarity]
            if near.size:
                joined = np.unique(np.append(label[near], label[a]))
                label[np.isin(label, joined)] = joined[0]
        mark[own] = False
    return label


def _verified(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect what pairs of the similarity connect within a group. ``sets``: fp and its shingles' hashes."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def rows(batches):
        for t in _runs(batches, "grp", VERIFY_ROWS):
            grp, fp, hashes = t.column("grp").to_numpy(), t.column("fp").combine_chunks(), t.column("shingles").combine_chunks()
            ends = hashes.offsets.to_numpy()
            flat = hashes.values.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            a, b = [], []
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                label = similar_items([flat[ends[i] : ends[i + 1]] for i in range(low, high)], similarity)
                linked = np.flatnonzero(label != np.arange(high - low))
                a += (low + linked).tolist()
                b += (low + label[linked]).tolist()
            yield pa.RecordBatch.from_arrays([fp.take(pa.array(a, pa.int64())), fp.take(pa.array(b, pa.int64()))], names=schema.names)

    return candidates.join(sets, "fp").select("grp", "fp", "shingles").repartition("grp").sortWithinPartitions("grp").mapInArrow(rows, schema).distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """doc_id, h (of the text) and component_id for groups of texts whose word shingles are similar to ``similarity`` or more.

    At that similarity 64-bit fingerprints differ in ten bits, too many to shard
    by their own blocks. Here fingerprints have 256 bits, shards are named by
    smallest shingles, and the BK-trees are searched within the distance that
    the similarity leads to, and ``DEVIATIONS`` standard deviations more. That
    only gives candidates: a link is a pair whose whole shingle sets, as 64-bit
    hashes, have the similarity. Nulls, ties and repeated rows as in
    ``near_duplicates``, except that texts without words are no copies of each
    other: each row of them has its own id.
    """
    small_batches(df.sparkSession)
    bits = 64 * WIDE_WORDS
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    radius = int(bits * angle + DEVIATIONS * np.sqrt(bits * angle * (1 - angle)))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("shards", longs), T.StructField("few_shards", longs)])
    set_schema = T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("shingles", longs)])

    def rows(batches):
        for batch in batches:
            for part in slices(batch, 4 << 20):
                fps, shards, few = zip(*(wide_fingerprint(shingle_hashes(x, words), similarity) for x in part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(fps, pa.binary()), pa.array(shards, pa.list_(pa.int64())), pa.array(few, pa.list_(pa.int64()))], names=schema.names)

    def set_rows(batches):
        for batch in batches:
            for part in slices(batch, 4 << 20):
                hashes = [shingle_hashes(x, words) for x in part.column("text").to_pylist()]
                fps = [wide_fingerprint(x, similarity)[0] for x in hashes]
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([x.view("i8") for x in hashes], pa.list_(pa.int64()))], names=set_schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    docs = materialize(texts.mapInArrow(rows, schema), "near-fingerprints")
    worded = (F.size("shards") > 0) | (F.size("few_shards") > 0)
    with_words = docs.where(worded)
    keyed = with_words.select("fp", F.lit(False).alias("few"), F.explode("shards").alias("shard")).unionByName(with_words.select("fp", F.lit(True).alias("few"), F.explode("few_shards").alias("shard"))).distinct()
    candidates = materialize(candidate_groups(keyed, radius, shard_limit), "near-candidates")
    # One row of each candidate's: only these texts are read again.
    row = with_words.join(candidates.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    chosen = materialize(row.select(F.col("r.doc_id").alias("__id"), F.col("r.h").alias("__h")), "near-chosen")
    again = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left_semi")
    sets = again.select("text").mapInArrow(set_rows, set_schema).dropDuplicates(["fp"])
    found = connected_components(_verified(candidates, sets, similarity))
    distinct = with_words.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = materialize(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label")), "near-labels")
    component = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    grouped = with_words.join(labelled.select("fp", "label").join(component, "label").select("fp", "component_id"), "fp").select("doc_id", "h", "component_id")
    return grouped.unionByName(docs.where(~worded).select("doc_id", "h", F.col("doc_id").alias("component_id")))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

