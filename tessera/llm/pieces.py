"""Sampled SentencePiece segmentation and lossless decoding.

Operator 10. A text's words, each with the mark of the space before it, are
segmented into pieces of the vocabulary. Forward filtering gives each position
of a word's lattice the log-sum of the weights of all segmentations that reach
it; backward sampling then draws pieces from the end with probabilities that
make every segmentation as likely as its weight says: exp(theta * the sum of
its scores). Draws come from a counter-based generator over (row key, word
number, draw number), so a row gets the same segmentation wherever it runs.

Characters without a piece fall back to bytes, and so does the space mark itself
where it stands in a text, so decoding gives back every text exactly. Words are
segmented apart: pieces that span several spaces are not used.
"""

from __future__ import annotations


import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_and_text, slices, small_batches

MODEL = public_tokenizers.path("piece_bpe_32k.model")
THETA = 0.001
SEED = 20
TABLE_WORDS = 60_000
BUILD_WORDS = 40_000  # at once, which bounds what building them takes
SLICE_BYTES = 4 << 20
SPACE = "▁"
BYTE_SYMBOL = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Lattices:
    """Lattices of words, laid end to end. A node is a symbol of a word, reached when the symbol is taken in.

    first: by node, its first arc; by arc, ordered by node: cumulative
    probability within the node, the node it comes from (-1: the word's start),
    and its piece. end: by word, its last node.
    """

    def __init__(self, end, first, cumulative, origin, piece):
        self.end, self.first, self.cumulative, self.origin, self.piece = end, first, cumulative, origin, piece

    def __add__(self, other: _Lattices) -> _Lattices:
        nodes, arcs = len(self.first), len(self.piece)
        return _Lattices(
            np.concatenate([self.end, other.end + nodes]),
            np.concatenate([self.first, other.first + arcs]),
            np.concatenate([self.cumulative, other.cumulative]),
            np.concatenate([self.origin, np.where(other.origin < 0, -1, other.origin + nodes)]),
            np.concatenate([self.piece, other.piece]),
        )


class Sampler:
    """Lattices of words, and draws from them."""

    def __init__(self, path: str = MODEL, theta: float = THETA, seed: int = SEED, words: int = TABLE_WORDS):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and SPACE not in names[i][1:]]
        self.pieces = {names[i]: (i, theta * sp.get_score(i)) for i in usable}
        # Symbols are code points; bytes of characters without a piece of their own come after the last code point.
        self.own = np.zeros(BYTE_SYMBOL, bool)
        self.own[[ord(x) for x in self.pieces if len(x) == 1 and x != SPACE]] = True
        symbols = [([ord(c) for c in x], i, w) for x, (i, w) in self.pieces.items()]
        symbols += [([BYTE_SYMBOL + self.bytes_of[i][0]], i, 0.0) for i in range(n) if sp.is_byte(i)]
        # For each length the beginnings of pieces by hash; id -1 where a beginning is no piece itself.
        whole = {tuple(x): (i, w) for x, i, w in symbols}
        self.tables = []
        for length in range(1, max(map(len, whole)) + 1):
            begins = sorted({x[:length] for x in whole if len(x) >= length})
            codes = np.array(begins, np.int64).reshape(-1, length)
            keys = np.zeros(len(begins), np.uint64)
            for column in codes.T:
                keys = keys * _STEP + column.astype(np.uint64)
            order = np.argsort(keys)
            found = [whole.get(x, (-1, 0.0)) for x in begins]
            self.tables.append((keys[order], codes[order], np.array([i for i, _ in found], np.int32)[order], np.array([w for _, w in found])[order]))
        self.seed, self.words = seed, words
        self.index: dict[str, int] = {}
        none = np.zeros(0, np.int32)
        self.known = _Lattices(none, none, np.zeros(0), none, none)

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' symbols, each word after the space mark, and where each word ends."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        foreign = ~self.own[codes]
        width = np.where(foreign, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), 1)
        at = np.repeat(np.arange(len(codes)), width)
        k = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
        c, w = codes[at], width[at]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w]
        byte = np.where(k == 0, lead | (c >> (6 * (w - 1))), 0x80 | ((c >> (6 * (w - 1 - k))) & 0x3F))
        flat = np.where(foreign[at], BYTE_SYMBOL + byte, c)
        owner = np.repeat(np.arange(len(words)), sizes)
        each = np.bincount(owner, weights=width, minlength=len(words)).astype(np.int64) + 1
        ends = np.cumsum(each)
        symbols = np.empty(int(ends[-1]), np.int64)
        starts = ends - each
        inner = np.ones(len(symbols), bool)
        inner[starts] = False
        symbols[starts] = ord(SPACE)
        symbols[inner] = flat
        return symbols, ends

    def lattices(self, words: list[str]) -> _Lattices:
        """The words' lattices, filtered forward."""
        symbols, ends = self._symbols(words)
        starts = np.append(0, ends[:-1])
        sizes = ends - starts
        stop, begin = np.repeat(ends, sizes), np.repeat(starts, sizes)
        at, key = np.arange(len(symbols)), np.zeros(len(symbols), np.uint64)
        found = []
        degree = np.zeros(len(symbols), np.int64)
        for length, (keys, codes, piece, weight) in enumerate(self.tables, 1):
            room = at + length <= stop[at]
            at, key = at[room], key[room]
            key = key * _STEP + symbols[at + length - 1].astype(np.uint64)
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[where] == key)
            where, at, key = where[hit], at[hit], key[hit]  # only beginnings of pieces can go on
            if length > 2:  # hashes of one or two symbols can't collide
                same = np.ones(len(at), bool)
                for k in range(length):
                    same &= codes[where, k] == symbols[at + k]
                if not same.all():
                    where, at, key = where[same], at[same], key[same]
            ids = piece[where]
            full = ids >= 0
            found.append((at[full], ids[full], weight[where[full]]))
            degree[found[-1][0] + length - 1] += 1
        # Arcs by the node that they lead to, and there by length.
        heads = np.cumsum(degree) - degree
        free = heads.copy()
        n_arcs = int(degree.sum())
        tail, node, piece, weight = np.empty(n_arcs, np.int64), np.empty(n_arcs, np.int64), np.empty(n_arcs, np.int32), np.empty(n_arcs)
        for length, (start, ids, w) in enumerate(found, 1):
            last = start + length - 1
            slot = free[last]
            tail[slot], node[slot], piece[slot], weight[slot] = start, last, ids, w
            free[last] += 1
        origin = np.where(tail == begin[tail], -1, tail - 1)
        # Forward: nodes at the same depth of their words depend only on nodes before it.
        depth = node - begin[node]
        by_depth = depth if depth.max() > 65535 else depth.astype(np.uint16)  # short numbers are sorted by radix
        order = np.argsort(by_depth, kind="stable")
        forward = np.zeros(len(symbols) + 1)  # the last entry stands for a word's start
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            arc = order[a:b]
            value = forward[origin[arc]] + weight[arc]
            groups = np.flatnonzero(np.append(True, np.diff(node[arc]) > 0))
            top = np.maximum.reduceat(value, groups)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(groups, len(arc))))), groups)
            forward[node[arc[groups]]] = top + np.log(total)
        share = np.exp(forward[origin] + weight - forward[node])
        running = np.cumsum(share)
        cumulative = running - np.repeat(running[heads] - share[heads], np.diff(np.append(heads, len(node))))
        cumulative[np.append(heads[1:], len(node)) - 1] = 1.0
        return _Lattices((ends - 1).astype(np.int32), heads.astype(np.int32), cumulative, origin.astype(np.int32), piece)

    def _uniform(self, row: np.ndarray, word: np.ndarray, draw: int) -> np.ndarray:
        """Numbers in [0, 1) from a hash of row key, word number and draw number."""
        x = row + word * np.uint64(0x9E3779B97F4A7C15) + np.uint64((draw * 0xD1B54A32D192ED03 + self.seed) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def encode(self, texts: pa.StringArray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin, with the end of the last. Empty texts have none."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.index]
        lattices, number = self.known, self.index
        if new:
            for i in range(0, len(new), BUILD_WORDS):
                lattices = lattices + self.lattices(new[i : i + BUILD_WORDS])
            added = dict(zip(new, range(len(number), len(number) + len(new)), strict=True))
            if len(number) < self.words:  # else they last for this call
                self.known = lattices
                number.update(added)
                added = {}
            numbers = np.array([added[w] if w in added else number[w] for w in words], np.int64)
        else:
            numbers = np.array([number[w] for w in words], np.int64)
        counts = np.diff(offsets)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        which = coded.indices.to_numpy().astype(np.int64)
        row = np.repeat(keys.astype(np.uint64), counts)
        place = (np.arange(len(which)) - np.repeat(offsets[:-1], counts)).astype(np.uint64)
        node = lattices.end[numbers[which]].astype(np.int64)
        node[offsets[:-1][empty]] = -1
        active = np.flatnonzero(node >= 0)
        node = node[active]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        n = np.zeros(len(which), np.int64)
        while len(active):
            u = self._uniform(row[active], place[active], len(steps))
            arc = lattices.first[node].astype(np.int64)
            beyond = np.flatnonzero(lattices.cumulative[arc] <= u)
            while len(beyond):
                arc[beyond] += 1
                beyond = beyond[lattices.cumulative[arc[beyond]] <= u[beyond]]
            steps.append((active, lattices.piece[arc]))
            n[active] += 1
            node = lattices.origin[arc].astype(np.int64)
            more = node >= 0
            active, node = active[more], node[more]
        last = np.cumsum(n)
        ids = np.zeros(int(last[-1]) if len(last) else 0, np.int32)
        for k, (at, found) in enumerate(steps):  # drawn from the end backwards
            ids[last[at] - 1 - k] = found
        bounds = np.append(0, last)[offsets]
        return ids, bounds

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; the space before the first word is dropped."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


_SAMPLERS: dict[tuple, Sampler] = {}


def sampler(path: str, theta: float, seed: int) -> Sampler:
    """One per worker process and setting."""
    key = (path, theta, seed)
    if key not in _SAMPLERS:
        _SAMPLERS[key] = Sampler(path, theta, seed)
    return _SAMPLERS[key]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """doc_id and a sampled segmentation, ids, of every whole text.

    The id is the row key: rows with the same id and text, repeated rows
    included, get the same pieces; a null id counts as 0. Null and empty texts
    have no pieces. Other columns are ignored; an empty table gives an empty
    result.
    """

    small_batches(df.sparkSession)

    def rows(batches):
        s = sampler(model, theta, seed)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                keys = pc.fill_null(part.column("doc_id"), 0).to_numpy().view(np.uint64)
                ids, at = s.encode(part.column("text").cast(pa.string()), keys)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype("i4")), pa.array(ids))], names=ENCODED.names)

    return id_and_text(df, id_col, text_col).mapInArrow(rows, ENCODED)


def decode(df: DataFrame, keep: list[str], ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``keep`` and text, decoded from ids; a null array gives an empty text."""
    small_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def rows(batches):
        s = sampler(model, THETA, SEED)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [s.decode(x or []) for x in part.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(rows, schema)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids_hash (XXH64 of the ids) of every document's sampled segmentation, and decoded_sha256 of what decoding gives back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = encode(docs)
    return decode(encoded.withColumns({"n_pieces": F.size("ids").cast("long"), "ids_hash": F.xxhash64("ids")}), ["doc_id", "n_pieces", "ids_hash"]).select("doc_id", "n_pieces", "ids_hash", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
