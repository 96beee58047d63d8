"""Exact top-k inner products over norm-sorted vectors.

Operator 5. Vectors are dealt by descending length. They are rotated by the
eigenvectors of their second moments (the right singular vectors of the whole
table), which puts most of an inner product into few leading dimensions. The
longest vectors give each query a first k-th best score; every later block of
vectors is left out where length times length can't reach that score, then
where a leading partial sum plus the lengths of both remainders can't
(Cauchy-Schwarz), and only what is left is scored, exactly, in integers.

Queries are a stated set. They go through in blocks of ``QUERY_BYTES``, each
against all vectors in one job, so neither the driver nor a broadcast holds more
than one, and a pass over the vectors serves as many queries as that allows.

Components and scores are longs and end at a long's bounds: what lies beyond
counts as the bound, in ranks too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

K = 20
SCALE = 64.0
QUERY_BYTES = 32 << 20
QUERY_ROWS = 4096  # of a block's queries, met by VECTOR_BLOCK vectors at a time
VECTOR_BLOCK = 1024
SEED_VECTORS = 2048
LEADING = 0.25


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """vec_id, v (array of long), norm2: floor(scale * x) of each component.

    Null vectors and vectors with a null or non-finite component are left out;
    so are vectors with a null id, which no result could name.
    """
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    v = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    v = F.transform(v, lambda c: F.greatest(c, F.lit(-_LONG)))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return df.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("norm2", length)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros, which add nothing to a product."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


_LONG = (1 << 63) - 1
_LIMB = 16


def _limbs(a: np.ndarray) -> list[np.ndarray]:
    """The numbers as four limbs of 16 bits, the last one signed."""
    return [((a >> (_LIMB * k)) & 0xFFFF if k < 3 else a >> (_LIMB * k)).astype(np.float64) for k in range(4)]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b, exact between a long's bounds and the bound beyond them."""
    wide = a.astype(np.float64), b.astype(np.float64)
    bound = float(np.abs(wide[0]).max(initial=0)) * float(np.abs(wide[1]).max(initial=0)) * max(1, a.shape[1])
    rough = wide[0] @ wide[1].T
    if bound < 2.0**53:  # every partial sum is exact in double precision
        return rough.astype(np.int64)
    # Limbs' products are exact in double precision; their sum, modulo 2 ** 64, is the product where that is a long.
    total = np.zeros(rough.shape, np.uint64)
    for i, x in enumerate(_limbs(a)):
        for j, y in enumerate(_limbs(b)):
            if i + j < 4:
                total += (x @ y.T).astype(np.int64).astype(np.uint64) << np.uint64(_LIMB * (i + j))
    out = total.view(np.int64)
    # ``rough`` is off by no more than this; what it leaves open is decided one by one.
    off = np.abs(wide[0]) @ np.abs(wide[1]).T * (1e-15 * max(1, a.shape[1])) + 1e4
    out[rough - off > _LONG] = _LONG
    out[rough + off < -_LONG] = -_LONG
    for i, j in np.argwhere((np.abs(np.abs(rough) - 2.0**63) <= off)).tolist():
        out[i, j] = max(-_LONG, min(_LONG, sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))))
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products over all vectors, strongest first; width x width numbers come to the driver."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype="i4")), pa.array(list(total))], names=schema.names)

    summed = vectors.select("v").mapInArrow(partial, schema).select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    moment = np.zeros((width, width))
    for r in summed.collect():
        moment[r.i, r.j] = r.x
    return np.linalg.eigh(moment)[1][:, ::-1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The order of the k best of one query: highest score, then smallest id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))][:k]
    return np.lexsort((ids, -scores))


class _Search:
    """A block of queries against vectors in any order; the sooner the long ones come, the more of the others is left out."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.lead = max(1, int(len(rotation) * LEADING)) if len(rotation) else 0
        self.rotation = rotation
        rotated = queries @ rotation
        self.first, rest = rotated[:, : self.lead], rotated[:, self.lead :]
        self.norm = np.sqrt((rotated**2).sum(axis=1))
        self.rest = np.sqrt((rest**2).sum(axis=1))
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score so far

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in a block."""
        rotated = vectors @ self.rotation
        norm = np.sqrt((rotated**2).sum(axis=1))
        slack = 1e-6 * (1 + self.norm * norm.max(initial=0))  # for rounding in the bounds; scores are exact
        within = np.flatnonzero(self.norm * norm.max(initial=0) + slack >= self.floor)
        rest = np.sqrt((rotated[:, self.lead :] ** 2).sum(axis=1))
        for i in range(0, len(within), QUERY_ROWS):
            self._score(within[i : i + QUERY_ROWS], slack, ids, vectors, rotated, rest)

    def _score(self, open_: np.ndarray, slack: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, rest: np.ndarray) -> None:
        bound = self.first[open_] @ rotated[:, : self.lead].T + self.rest[open_, None] * rest
        may = bound + slack[open_, None] >= self.floor[open_, None]
        wanted, columns = may.any(axis=1), may.any(axis=0)
        open_, may = open_[wanted], may[np.ix_(wanted, columns)]
        if not open_.size:
            return
        scores, ids = _products(self.queries[open_], vectors[columns]), ids[columns]
        for row, q, ok in zip(scores, open_.tolist(), may, strict=True):
            take = np.flatnonzero(ok & (row >= self.floor[q]) & (ids != self.ids[q]))
            if take.size:
                s, i = (np.concatenate(x) for x in zip(self.found[q], (row[take], ids[take]), strict=True))
                best = _best(s, i, self.k)
                self.found[q] = (s[best], i[best])
                if len(best) == self.k:
                    self.floor[q] = max(self.floor[q], s[best[-1]])


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all vectors but itself.

    ``is_query`` is a condition on vec_id. Scores are exact integer products of
    quantized vectors; ties go to the smaller id, and repeated ids compete as
    rows of their own, and are queries of their own, but never meet a query with
    their id. Components and
    scores beyond a long count as its bound. Shorter vectors count as filled up with zeros. Queries with fewer than k candidates get
    them all; without vectors or queries the result is empty.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, id_col, vector_col, scale).repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id"), "topk-vectors")
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rotation = _rotation(rows, width)
    seeds = rows.orderBy(F.desc("norm2"), "vec_id").limit(SEED_VECTORS).select("vec_id", "v").toArrow()
    seed_ids, seed_vectors = seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v").combine_chunks(), width)
    placed = F.monotonically_increasing_id().alias("place")  # a task's number in the upper 31 bits, and the row's in the task
    queries = materialize(rows.where(is_query("vec_id")).select("vec_id", "v", placed), "topk-queries")
    # One row for each task that wrote queries says where every block of them begins.
    sizes = sorted((r.task, r.n) for r in queries.groupBy(F.shiftright("place", 33).alias("task")).agg(F.count("*").alias("n")).collect())
    block, seen, cuts = max(1, query_bytes // (8 * max(1, width))), 0, []
    for task, n in sizes:
        cuts += [(task << 33) + at for at in range(-seen % block, n, block)]
        seen += n
    found = None
    for low, high in zip(cuts, [*cuts, _LONG][1:], strict=True):
        part = queries.where((F.col("place") >= low) & (F.col("place") < high)).select("vec_id", "v", "place").toArrow()
        places = part.column("place").to_numpy()
        ids, matrix = part.column("vec_id").to_numpy(), _matrix(part.column("v").combine_chunks(), width)
        first = _Search(ids, matrix, rotation, k)
        for i in range(0, len(seed_ids), VECTOR_BLOCK):
            first.block(seed_ids[i : i + VECTOR_BLOCK], seed_vectors[i : i + VECTOR_BLOCK])
        shared = spark.sparkContext.broadcast((places, ids, matrix, rotation, first.floor))

        def search(batches, shared=shared):
            places, ids, matrix, rotation, floor = shared.value
            s = _Search(ids, matrix, rotation, k)
            s.floor = floor.copy()
            # A task reads files in an order of Spark's: a short block says nothing of those after it.
            for batch in batches:
                for i in range(0, batch.num_rows, VECTOR_BLOCK):
                    b = batch.slice(i, VECTOR_BLOCK)
                    s.block(b.column("vec_id").to_numpy(), _matrix(b.column("v"), width))
            n = [len(x) for x, _ in s.found]
            scores, ids_ = (np.concatenate(x) if n else np.zeros(0, np.int64) for x in zip(*s.found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(places, n)), pa.array(np.repeat(ids, n)), pa.array(ids_), pa.array(scores)], names=schema.names)

        best = rows.select("vec_id", "v").mapInArrow(search, schema)
        # A query has at most k rows from each task.
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
        ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
        ranked = materialize(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-block")
        found = ranked if found is None else found.unionByName(ranked)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if found is None else found


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: F.col(c) % 20 == 0)


OP5_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
