"""Near-duplicate line removal by deletion neighbourhoods.

Operator 3, in DataFrame functions throughout. Lines are compared as sequences
of words. A line goes if an earlier line, by (document id, text hash, position),
has the same words, or differs by one inserted, deleted or replaced word while
both have ``MIN_WORDS`` words or more, which makes them similar to 0.8 at least.

A line emits a hashed key for each variant with one word deleted, and one
for itself. Lines of equal length that share the variant without the word at one
position differ at most there; a line that equals a variant of another differs
by the deleted word. So it is enough to know the earliest line of each key: no
pairs are made, and a frequent key meets in a partial aggregate.

Variants are emitted for distinct lines only, and of those for the ones that can
have a partner: two lines one edit apart share all words before the middle of
the longer one or all after it, so lines whose halves occur once are done. Words
are deleted only on the side that isn't shared, and keys made only for lengths
that share the other. What remains is verified word by word against the earlier line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bitmap_of, boxed, in_bitmap
from tessera.session import materialize

MIN_WORDS = 5
RUN = 16  # words at least of a line that are folded together


def _normal(line: Column) -> Column:
    """A line's words with single spaces between; most lines already are that."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for x in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(x))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\t\r\x0b\x0c]+", " "))).otherwise(line)


def _halves(words: Column, n: Column) -> list[Column]:
    """Keys of the half lines that a partner must share, for a longer line of n and of n + 1 words."""
    out = []
    for more in (0, 1):
        longest = n + more
        before = F.shiftright(longest - 1, 1)
        out.append(F.xxhash64(F.lit(0), longest, F.slice(words, F.lit(1), before)))
        out.append(F.xxhash64(F.lit(1), longest, F.slice(words, before + 2 - more, n)))
    return out


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """v, h, pos, near for each line that goes; near is false for repeats of a line. (v, h) is the document.

    Where rows repeat a document, a repeat's place comes once for each of them.
    """
    at = docs.select("v", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    # What a line begins with tells a blank one for less than its normal form.
    lines = at.where(F.ltrim(line, F.lit(" \t\r\x0b\x0c")) != "").select("v", "h", "pos", _normal(line).alias("line"))
    counted = lines.select("v", "h", "pos", "line", F.split(line, " ").alias("words")).select("*", F.size("words").alias("n"))
    halves = [F.when(F.col("n") >= min_words, x).alias(f"half{i}") for i, x in enumerate(_halves(F.col("words"), F.col("n")))]
    seen = materialize(counted.select("v", "h", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), *halves), "line-keys")
    first = F.struct("v", "h", "pos").alias("first")
    names = [f"half{i}" for i in range(4)]
    # Only lines that stand more than once meet to find their first place; the others are their own.
    repeated = bitmap_of(seen.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "k1")
    repeats = in_bitmap(seen, repeated, "k1").groupBy("k1", "k2").agg(F.min(F.struct("v", "h", "pos", *names)).alias("x"), F.count("*").alias("n"))
    repeats = materialize(repeats.select("k1", "k2", "n", F.struct("x.v", "x.h", "x.pos").alias("first"), *(f"x.{c}" for c in names)), "line-repeats")
    distinct = in_bitmap(seen, repeated, "k1", others=True).select(first, *names).unionByName(repeats.select("first", *names))

    # Sides 0 and 1 are those of a longer line, 2 and 3 those of a shorter one.
    keyed = distinct.select("first", F.posexplode(F.array(*names)).alias("side", "half")).where("half is not null")
    met = keyed.groupBy("half").agg(F.count_if(F.col("side") < 2).alias("longer"), F.count_if(F.col("side") > 1).alias("shorter"))
    shared = materialize(met.where("longer > 1 OR (longer > 0 AND shorter > 0)"), "line-halves")
    # In which half a line's edit can lie: replaced words after the middle (1) or before (4), deleted ones (2, 8); whether a longer line can have one word more (16).
    longer, shorter = F.when(F.col("longer") > 1, F.lit(1)).otherwise(F.lit(0)), F.when(F.col("shorter") > 0, F.lit(2)).otherwise(F.lit(0))
    mark = F.when(F.col("side") > 1, F.when(F.col("longer") > 0, F.lit(16)).otherwise(F.lit(0))).when(F.col("side") == 1, (longer + shorter) * 4).otherwise(longer + shorter)
    marked = in_bitmap(keyed, bitmap_of(shared, "half"), "half").join(shared, "half").select("first.*", mark.alias("mark")).where("mark > 0")
    marked = materialize(marked.groupBy("v", "h", "pos").agg(F.bit_or("mark").alias("mark")), "line-places")
    # The candidates' words come from where each line stands first.
    texts = in_bitmap(docs, bitmap_of(marked, "h"), "h").select("v", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    place = F.xxhash64("h", "pos").alias("place")
    texts = in_bitmap(texts.select("*", place), bitmap_of(marked.select(place), "place"), "place").select("v", "h", "pos", F.split(_normal(line), " ").alias("words"))
    # Rows that repeat a document give the same line again.
    wanted = marked.join(texts, ["v", "h", "pos"]).groupBy("v", "h", "pos").agg(F.max("mark").alias("mark"), F.max("words").alias("words"))
    wanted = materialize(wanted.select(first, "mark", "words"), "line-candidates")

    keys = materialize(_variants(wanted), "line-variants")
    # For each key the earliest of the lines themselves and of the variants; a line goes by a variant's earliest, a variant by the line's, one at a position by the earliest there.
    keys = in_bitmap(keys, bitmap_of(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "key")
    least = keys.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, F.col("first"))).alias(f"m{r}") for r in range(3)), F.count("*").alias("n")).where("n > 1")
    witness = F.when(F.col("role") == 0, F.col("m1")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m2"))
    links = keys.join(least, "key").select("first", witness.alias("earlier")).where("earlier < first").groupBy("first").agg(F.min("earlier").alias("earlier"))
    a = links.join(wanted, "first")
    b = a.join(wanted.select(F.col("first").alias("earlier"), F.col("words").alias("other")), "earlier")
    near = b.where(_one_edit(F.col("words"), F.col("other"))).select("first.*", F.lit(True).alias("near"))
    # Of the lines that stand more than once all but the first go, and the first of those that have an earlier neighbour.
    places = in_bitmap(seen.select("v", "h", "pos", "k1", "k2"), repeated, "k1").join(repeats.where("n > 1").select("k1", "k2", "first"), ["k1", "k2"])
    return places.where(F.struct("v", "h", "pos") != F.col("first")).select("v", "h", "pos", F.lit(False).alias("near")).unionByName(near)


def _variants(wanted: DataFrame) -> DataFrame:
    """first, role, key: of lines with their marks, the variants that a partner can share.

    Role 0: the line itself; 1: a variant that may equal it; 2: a variant that
    lines of equal length share at one position. A variant's key combines by xor
    the words before the gap at their positions and those after it one position
    lower. Lines are folded in runs of the square root of their words, so that no
    array is appended to more often than that, and none where no gap can be.
    """
    n, size, none = F.col("n"), F.col("size"), F.lit(0).cast("long")
    each = wanted.select("first", "mark", "words", F.size("words").alias("n"))
    each = each.select("*", F.greatest(F.lit(RUN), F.ceil(F.sqrt(n)).cast("int")).alias("size"), F.shiftright(n - 1, 1).alias("middle"))

    def terms(c: Column) -> Column:
        return F.transform(F.slice("words", c * size + 1, size), lambda w, i: F.struct(F.xxhash64(c * size + i, w).alias("at"), F.xxhash64(c * size + i - 1, w).alias("lower")))

    def xor(run: Column, k: str) -> Column:
        return F.aggregate(F.transform(run, lambda t: t[k]), none, lambda x, t: x.bitwiseXOR(t))

    def ahead(x: Column, s: Column) -> Column:
        here = F.array(F.struct(x["at"].alias("at"), x["lower"].alias("lower")))
        return F.struct(x["at"].bitwiseXOR(s["at"]).alias("at"), x["lower"].bitwiseXOR(s["lower"]).alias("lower"), F.concat(x["before"], here).alias("before"))

    def gap(x: Column, t: Column) -> Column:
        rest = x["rest"].bitwiseXOR(t["lower"])
        return F.struct(x["head"].bitwiseXOR(t["at"]).alias("head"), rest.alias("rest"), F.concat(x["keys"], F.array(x["head"].bitwiseXOR(rest))).alias("keys"))

    each = each.select("first", "mark", "n", "size", "middle", F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), terms).alias("runs"))
    each = each.select("*", F.transform("runs", lambda r: F.struct(xor(r, "at").alias("at"), xor(r, "lower").alias("lower"))).alias("sums"))
    start = F.struct(none.alias("at"), none.alias("lower"), F.array().cast("array<struct<at:bigint,lower:bigint>>").alias("before"))
    each = each.select("first", "mark", "n", "size", "middle", "runs", F.aggregate("sums", start, ahead).alias("line"))
    each = each.select("first", "mark", "n", "size", "middle", "line.at", "line.lower", F.posexplode(F.arrays_zip("runs", F.col("line.before").alias("before"))).alias("c", "run"))

    # A pair's longest line shares with the other the words before the middle one or those after it; the gap is on the other side.
    def gaps(first: Column, last: Column) -> Column:
        after = F.when(last >= F.col("middle"), F.col("mark").bitwiseAND(3)).otherwise(F.lit(0))
        return after.bitwiseOR(F.when(first <= F.col("middle"), F.shiftright("mark", 2).bitwiseAND(3)).otherwise(F.lit(0)))

    def itself(i: Column) -> Column:
        return (i == 0) & (F.col("mark").bitwiseAND(16) > 0)

    each = each.where((gaps(F.col("c") * size, F.col("c") * size + size - 1) > 0) | itself(F.col("c")))
    rest = F.col("lower").bitwiseXOR(F.col("run.before.lower"))
    start = F.struct(F.col("run.before.at").alias("head"), rest.alias("rest"), F.array().cast("array<bigint>").alias("keys"))
    each = each.select("first", "mark", "n", "middle", "at", (F.col("c") * size).alias("start"), F.posexplode(F.aggregate("run.runs", start, gap, lambda x: x["keys"])).alias("i", "gap"))
    i = F.col("start") + F.col("i")
    each = each.select("first", "n", i.alias("i"), "at", "gap", gaps(i, i).alias("gaps"), itself(i).alias("itself")).where("gaps > 0 OR itself")
    keys = F.array(
        F.struct(F.lit(0).alias("role"), F.when(F.col("itself"), F.xxhash64(F.lit(-1), "n", "at")).alias("key")),
        F.struct(F.lit(1).alias("role"), F.when(F.col("gaps").bitwiseAND(2) > 0, F.xxhash64(F.lit(-1), n - 1, "gap")).alias("key")),
        F.struct(F.lit(2).alias("role"), F.when(F.col("gaps").bitwiseAND(1) > 0, F.xxhash64("i", "n", "gap")).alias("key")),
    )
    return each.select("first", F.inline(keys)).where("key is not null")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced word makes two lists equal, by the words that they share at both ends."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    at = F.sequence(F.lit(1), short)
    head = F.coalesce(F.array_min(F.filter(at, lambda i: F.element_at(a, i) != F.element_at(b, i))) - 1, short)
    tail = F.coalesce(F.array_min(F.filter(at, lambda i: F.element_at(a, -i) != F.element_at(b, -i))) - 1, short)
    return (F.abs(n - m) <= 1) & (head + tail >= F.greatest(n, m) - 1)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """row, lines, repeated, near: ``df``'s rows as structs, without repeated and near-duplicate lines in their texts, and how many lines there were, and went.

    Lines end at line feeds; those without a word always stay, and those of
    fewer than ``min_words`` words only go as repeats. A null text stays null.
    Rows that repeat a document, id and text, are treated alike, as one. Null
    ids come before all others. A document can lose all its lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Nulls sort first in structs too.
    keyed = boxed(df, F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).cast("long").alias("id")).alias("v"), F.xxhash64(F.col(id_col).cast("long"), text).alias("h"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    docs = keyed.select(F.struct("v.known", F.coalesce("v.id", F.lit(0)).alias("id")).alias("v"), "h", text.alias("text"))
    gone = removals(docs, min_words).groupBy("v", "h").agg(F.collect_set("pos").alias("gone"), F.count_if("near").alias("near"))
    g = materialize(gone, "line-gone")
    bitmap = bitmap_of(g, "h")
    keyed = keyed.withColumn("v", F.struct("v.known", F.coalesce("v.id", F.lit(0)).alias("id")))
    # Documents that lose nothing stay where they are; only the others' texts are shuffled to meet their lists.
    touched = in_bitmap(keyed, bitmap, "h").join(g, ["v", "h"], "left").select("row", "gone", "near")
    untouched = in_bitmap(keyed, bitmap, "h", others=True).select("row", *(F.lit(None).cast(g.schema[c].dataType).alias(c) for c in ("gone", "near")))
    joined = touched.unionByName(untouched)
    lines = F.split(text, "\n")
    removed = F.map_from_entries(F.transform("gone", lambda p: F.struct(p, F.lit(True))))
    kept = F.filter(lines, lambda x, i: ~F.map_contains_key(removed, i))
    row = F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, F.array_join(kept, "\n")))
    near = F.coalesce("near", F.lit(0))
    return joined.select(row.alias("row"), F.size(lines).cast("long").alias("lines"), (F.coalesce(F.size("gone"), F.lit(0)).cast("long") - near).alias("repeated"), near.alias("near"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_repeated, n_near, n_chars and kept_sha256 of what is left of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return dedup_lines(docs).select("row.doc_id", F.col("lines").alias("n_lines"), F.col("repeated").alias("n_repeated"), F.col("near").alias("n_near"), F.length(text).cast("long").alias("n_chars"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), firsts AS (
  SELECT words, len(words) AS n, min((doc_id, pos)) AS f FROM lines WHERE len(words) > 0 GROUP BY words
), variants AS (
  SELECT f, n, i, list_concat(words[:i - 1], words[i + 1:]) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 5)
), near AS (
  SELECT f FROM (SELECT f, min(f) OVER (PARTITION BY n, i, v) AS e FROM variants) WHERE e < f
  UNION SELECT v.f FROM variants v JOIN firsts w ON w.words = v.v AND w.n >= 5 WHERE w.f < v.f
  UNION SELECT w.f FROM variants v JOIN firsts w ON w.words = v.v AND w.n >= 5 WHERE v.f < w.f
), judged AS (
  SELECT l.doc_id, l.pos, l.line, len(l.words) > 0 AND f.f <> (l.doc_id, l.pos) AS repeated, len(l.words) > 0 AND f.f = (l.doc_id, l.pos) AND f.f IN (SELECT f FROM near) AS near
  FROM lines l LEFT JOIN firsts f ON f.words = l.words
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (repeated) AS n_repeated, count(*) FILTER (near) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT repeated AND NOT near), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT doc_id, n_lines, n_repeated, n_near, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS kept_sha256 FROM kept
"""
