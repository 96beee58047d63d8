"""Document fingerprints as homomorphic multiset hashes of paragraphs.

Operator 7, in DataFrame functions throughout. A paragraph (a line with
something in it) is hashed to a wide vector: ``DENSE`` lanes of 32 bits from
hashes of the whole paragraph under different seeds, and ``BITS`` lanes of 32
bits that count, for each bit of two 64-bit hashes of the paragraph's word
shingles, how often it is set, with one more lane for the number of shingles. A document's fingerprint is the sum
of its paragraphs' vectors, each lane modulo its power of two. It doesn't
depend on the paragraphs' order, and a paragraph is inserted or deleted by
adding or subtracting its vector (``combine``).

Equality is decided by all lanes. Likeness is the cosine of the two documents'
bit lanes, centred by the number of shingles: the expected value is that of the
documents' shingle counts, since each hash bit is a random sign. Its standard
error is about 1 / sqrt(BITS), 0.09.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text

DENSE = 8
BITS = 128
SHINGLE_WORDS = 3
DENSE_MASK = (1 << 32) - 1
BIT_MASK = (1 << 32) - 1
PAIR_MASK = (1 << 32) | 1


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: F.trim(p) != F.lit(""))


def _features(text: Column) -> Column:
    """(d0 .. d3, h) structs: one with the paragraph's own hashes and a null, and one a shingle with nulls and its hash."""
    none = F.lit(None).cast("long")

    def of(p: Column) -> Column:
        words = p["words"]
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE_WORDS, F.lit(0)))
        shingles = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE_WORDS))))
        return F.concat(
            F.array(F.struct(*(F.xxhash64(F.lit(i), p["text"]).alias(f"d{i}") for i in range(DENSE // 2)), none.alias("h"))),
            F.transform(shingles, lambda h: F.struct(*(none.alias(f"d{i}") for i in range(DENSE // 2)), h.alias("h"))),
        )

    # Words end at single spaces. They are bound here, once a paragraph, so that the shingles don't split it again.
    split = F.transform(_paragraphs(text), lambda p: F.struct(p.alias("text"), F.split(p, " ").alias("words")))
    return F.flatten(F.transform(split, of))


#: Sums that fit a long: dense lanes are 32-bit values, and two bit lanes share a long, 32 bits each.
SUM_COLUMNS = [*(f"d{i}" for i in range(DENSE)), "n", *(f"b{i}" for i in range(BITS // 2))]


def _sums() -> list[Column]:
    dense = [F.sum(F.coalesce(F.shiftrightunsigned(F.col(f"f.d{i // 2}"), 32 * (i % 2)).bitwiseAND(F.lit(DENSE_MASK)), F.lit(0))).alias(f"d{i}") for i in range(DENSE)]
    hashes = [F.col("f.h"), *(F.col(f"h{k}") for k in range(1, BITS // 64))]
    pairs = [F.sum(F.coalesce(F.shiftrightunsigned(hashes[i // 32], i % 32).bitwiseAND(F.lit(PAIR_MASK)), F.lit(0))).alias(f"b{i}") for i in range(BITS // 2)]
    return [*dense, F.count("f.h").alias("n"), *pairs]


def _lanes(prefix: str = "") -> list[tuple[Column, int]]:
    """Each lane, reduced modulo its power, and its hex digits: dense lanes, the count, then the bit lanes."""

    def c(name: str) -> Column:
        return F.coalesce(F.col(prefix + name), F.lit(0))

    low = [c(f"b{i}").bitwiseAND(F.lit(BIT_MASK)) for i in range(BITS // 2)]
    high = [F.shiftrightunsigned(c(f"b{i}"), 32).bitwiseAND(F.lit(BIT_MASK)) for i in range(BITS // 2)]
    return [*((c(f"d{i}").bitwiseAND(F.lit(DENSE_MASK)), 8) for i in range(DENSE)), (c("n").bitwiseAND(F.lit(DENSE_MASK)), 8), *((x, 8) for x in (*low, *high))]


def _hex(prefix: str = "") -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(lane), digits, "0") for lane, digits in _lanes(prefix))))


def _centred_sums() -> Column:
    lanes = _lanes()
    return F.array(*(_signed(x, lanes[DENSE][0]) for x, _ in lanes[DENSE + 1 :]))


DIGITS = [8] * (DENSE + 1 + BITS)


def lanes_of(fingerprint: Column) -> list[Column]:
    """A fingerprint's lanes as longs."""
    out, at = [], 1
    for digits in DIGITS:
        out.append(F.conv(F.substring(fingerprint, at, digits), 16, 10).cast("long"))
        at += digits
    return out


def combine(a: Column, b: Column, subtract: bool = False) -> Column:
    """The fingerprint of two documents' paragraphs together, or of the first's without the second's."""
    sign = F.lit(-1 if subtract else 1)
    return F.lower(F.concat(*(F.lpad(F.hex(F.pmod(x + sign * y, F.lit(1 << 4 * digits))), digits, "0") for x, y, digits in zip(lanes_of(a), lanes_of(b), DIGITS, strict=True))))


def _signed(x: Column, n: Column) -> Column:
    """A bit lane as a number around zero."""
    return F.pmod(2 * x - n + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def centred(fingerprint: Column) -> Column:
    """The bit lanes as numbers around zero, in an array."""
    n = F.conv(F.substring(fingerprint, 8 * DENSE + 1, 8), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: _signed(F.conv(F.substring(fingerprint, 8 * i + 8 * (DENSE + 1) + 1, F.lit(8)), 16, 10).cast("long"), n))


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, p: s + p)


def _likeness(a: Column, b: Column, x: Column, y: Column) -> Column:
    norms = F.sqrt(_dot(x, x) * _dot(y, y))
    cosine = F.when(norms > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(x, y) / norms))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1; equal fingerprints give 1, and a document without paragraphs is like no other."""
    return _likeness(a, b, centred(a), centred(b))


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, fingerprint and centred (its bit lanes around zero) for each distinct combination of ``keys``, summed over its rows.

    Null and empty texts, and texts of white space alone, have no paragraphs:
    their fingerprint is zero. Shingles meet their sums before any shuffle.
    """
    parts = df.select(*keys, F.explode_outer(_features(F.coalesce(F.col(text_col), F.lit("")))).alias("f"))
    more = {f"h{k}": F.when(F.col("f.h").isNotNull(), F.xxhash64(F.lit(k), F.col("f.h"))) for k in range(1, BITS // 64)}
    return parts.withColumns(more).groupBy(*keys).agg(*_sums()).select(*keys, _hex().alias("fingerprint"), _centred_sums().alias("centred"))


def _bucket_of(bounds: list[int], value: Column) -> Column:
    """The number of bounds up to the value, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def literal(xs):
        return F.array(*(F.lit(x).cast("long") for x in xs))

    coarse = F.size(F.filter(literal([g[0] for g in groups]), lambda x: x <= value))
    fine = F.size(F.filter(F.element_at(F.array(*map(literal, groups)), F.greatest(coarse, F.lit(1))), lambda x: x <= value))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine).cast("int")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, rn, doc_id, text and next_text, the text of the next row by (doc_id, text); the last row's next is the first.

    Rows are dealt by ranges of ids. A range's first rows also go, as ghosts, to
    the range before, so that every range finds its last row's successor without
    a window over the whole table. Null ids sort as the smallest.
    """
    low = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    bounds = sorted({int(x) for x in docs.stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)}) if buckets > 1 else []
    placed = docs.select("doc_id", "text", low.alias("o")).withColumn("bucket", _bucket_of(bounds, F.col("o")))
    # One row for each range.
    firsts = sorted((r.bucket, r.o) for r in placed.groupBy("bucket").agg(F.min("o").alias("o")).collect())
    ghosts = {o: (firsts[i - 1][0], i == 0) for i, (_, o) in enumerate(firsts)}
    own = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    if ghosts:
        spark = docs.sparkSession
        before = spark.createDataFrame([(o, b, 2 if wraps else 1) for o, (b, wraps) in ghosts.items()], "o long, before int, kind int")
        dealt = placed.join(F.broadcast(before), "o", "left").select("doc_id", "text", "o", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.col("kind").alias("ghost"))))).alias("p"))
    else:
        dealt = placed.select("doc_id", "text", "o", own.alias("p"))
    rows = dealt.select("doc_id", "text", "o", "p.bucket", "p.ghost")
    w = Window.partitionBy("bucket").orderBy(F.col("ghost") == 2, "o", "ghost", "text")
    return rows.select("doc_id", "text", "bucket", "ghost", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by the first as many, or all, of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    Rows that share an id are ordered by their texts. A table of one row is its
    own successor.
    """
    docs = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, buckets)
    text, change = F.col("text"), edited(F.col("text"), F.col("next_text"))
    keyed = rows.withColumn("edited", F.when(F.col("ghost") == 0, change))
    facts = F.struct("doc_id", "ghost", F.length(text).cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    both = keyed.select("bucket", "rn", facts.alias("facts"), F.explode(F.array(F.struct(F.lit(0).alias("side"), text.alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    sides = both.where("s.side = 0 or facts.ghost = 0").select("bucket", "rn", "facts", "s.side", "s.t")
    prints = fingerprints(sides, ["bucket", "rn", "facts", "side"], "t")
    # A row's two sides, then the next row's own side, in one order.
    w = Window.partitionBy("bucket").orderBy("rn", "side")
    own = F.struct("fingerprint", "centred")
    out = prints.select("facts", "side", own.alias("own"), F.lead(own).over(w).alias("edited"), F.lead(own, 2).over(w).alias("following")).where("side = 0 and facts.ghost = 0")

    def near(other: str) -> Column:
        return _likeness(F.col("own.fingerprint"), F.col(f"{other}.fingerprint"), F.col("own.centred"), F.col(f"{other}.centred"))

    return out.select(
        "facts.doc_id", "facts.n_chars", "facts.edited_sha256", "own.fingerprint", F.col("edited.fingerprint").alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("following").alias("near_next"),
    )
