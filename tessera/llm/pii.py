"""Personal data by base patterns and bootstrapped contexts.

Operator 9, in DataFrame functions throughout. Base patterns give e-mail
addresses, IPv4 addresses, payment cards and phone numbers. They are seeds, and
so are hexadecimal strings of a digest's length, which only become spans if a
context says that they are secrets.

The one to three words before a seed, and the one to three after it, are lexical
patterns; words with an at sign or a digit are instances. Each round scores the
graph of patterns and instances. A pattern's confidence for a form is the share
of all its occurrences in the corpus, before or after whatever word, that lead
to a known identifier of that form; an instance's is the noisy-or of its
patterns. Patterns with enough different known identifiers and enough confidence
make unknown instances of their form known, wherever they stand, and the next
round starts from those too, until nothing is added.

Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bitmap_of, boxed, id_and_text, in_bitmap, text_key
from tessera.session import materialize

KINDS = ["email", "ip", "card", "phone"]
SECRET = "secret"  # a kind that only contexts give

#: The base patterns. Possessive groups and starts at the first character of a run change no match, only the time a failed one takes.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier of a form the base patterns don't know: a word with a digit or an at sign.
TOKEN = r"(?<![^\s])(?=[^\s0-9@]*+[0-9@])[^\s]++"
PREFILTER = {"email": "@", "phone": "+"}
SECRET_SEED = r"\A(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\z"
CONTEXT_WORDS = 3
_NEAR = 8  # single spaces from a match within which its context words are looked for


@dataclass(frozen=True)
class Bootstrap:
    """Bounds of the bootstrapping, none of which depends on the corpus."""

    min_support: int = 3  # different known identifiers beside a pattern
    min_confidence: float = 0.5  # of a pattern
    min_score: float = 0.7  # of an instance: one good pattern, or several
    min_digits: int = 7
    min_secret: int = 8


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, d).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", hit.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"))
        .when(kind == "card", n.between(12, 19) & _luhn(F.substring(digits, 1, 19)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def normal(text: Column) -> Column:
    """Lower case, every digit a zero: what contexts are compared by."""
    return F.translate(F.lower(text), "123456789", "000000000")


def _found(kind: str, text: Column) -> Column:
    """Structs for each match: kind, pos, the match, the sizes of it and of what lies between it and the one before, and the text on either side of it."""
    pattern = F.lit(TOKEN if kind == "token" else PATTERNS[kind])

    def matches(b: Column) -> Column:
        gaps, hits = b["gaps"], b["hits"]

        def piece(array: Column, i: Column) -> Column:
            return F.coalesce(F.get(array, i), F.lit(""))

        def match(hit: Column, i: Column) -> Column:
            before, after = piece(gaps, i), piece(gaps, i + 1)
            left, right = F.call_function("substring_index", before, F.lit(" "), F.lit(-_NEAR)), F.call_function("substring_index", after, F.lit(" "), F.lit(_NEAR))
            # Where the gap is short, the match before or after it is part of the context.
            left = F.when(F.length(left) < F.length(before), left).otherwise(F.concat(F.call_function("substring_index", piece(gaps, i - 1), F.lit(" "), F.lit(-_NEAR)), piece(hits, i - 1), left))
            right = F.when(F.length(right) < F.length(after), right).otherwise(F.concat(right, piece(hits, i + 1), F.call_function("substring_index", piece(gaps, i + 2), F.lit(" "), F.lit(_NEAR))))
            sizes = [F.length(before).alias("gap"), F.length(hit).alias("len"), F.octet_length(before).alias("gap_b"), F.octet_length(hit).alias("len_b")]
            return F.struct(F.lit(kind).alias("kind"), i.alias("pos"), *sizes, hit.alias("hit"), left.alias("left"), right.alias("right"))

        return F.transform(hits, match)

    bound = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, 0).alias("hits")))
    possible = F.contains(text, F.lit(PREFILTER[kind])) if kind in PREFILTER else text.rlike("[0-9]" if kind != "token" else "[0-9@]")
    return F.when(possible, F.get(F.transform(bound, matches), 0)).otherwise(F.array())


def _words(text: Column) -> Column:
    return F.filter(F.split(normal(text), r"\s+"), lambda w: w != F.lit(""))


def _keys(sides: list[tuple[int, list[Column]]]) -> Column:
    """Keys of the patterns on each side (-1: before, 1: after) from the hashes of its nearest words, the nearest first; a null for those that reach beyond the text."""
    out = []
    for side, near in sides:
        for k in range(1, CONTEXT_WORDS + 1):
            out.append(F.when(near[k - 1].isNotNull(), F.xxhash64(F.lit(side * k), *near[:k])))
    return F.array(*out)


def observations(docs: DataFrame) -> DataFrame:
    """doc_id, h, kind ("token" for what no base pattern is asked about), start, end, both in bytes too, hit and the keys of the patterns beside it."""
    every = F.concat(*(_found(k, F.col("text")) for k in [*KINDS, "token"]))
    rows = docs.select("doc_id", "h", F.explode(every).alias("x")).select("doc_id", "h", "x.*").distinct()
    # A document's matches of a kind, in order: each begins where the gaps and matches up to it end.
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end, end_b = F.sum(F.col("gap") + F.col("len")).over(w), F.sum(F.col("gap_b") + F.col("len_b")).over(w)
    placed = rows.select("doc_id", "h", "kind", (end - F.col("len")).alias("start"), end.alias("end"), (end_b - F.col("len_b")).alias("start_b"), end_b.alias("end_b"), "hit", "left", "right")
    valid = placed.where(_valid(F.col("kind"), F.col("hit")))
    # The last piece on the left and the first on the right belong to the match's own word.
    lefts, rights = F.split(normal("left"), r"\s+"), F.split(normal("right"), r"\s+")
    sides = valid.withColumns({"left": F.reverse(F.filter(F.slice(lefts, F.lit(1), F.size(lefts) - 1), lambda w: w != F.lit(""))), "right": F.filter(F.slice(rights, F.lit(2), F.size(rights)), lambda w: w != F.lit(""))})

    def near(side: str) -> list[Column]:
        return [F.when(F.size(side) > k, F.xxhash64(F.get(side, k))) for k in range(CONTEXT_WORDS)]

    return sides.withColumn("keys", _keys([(-1, near("left")), (1, near("right"))])).drop("left", "right")


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """key and total: how often each pattern's words stand in the corpus, with whatever word beside them."""
    hashes = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))

    def around(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 1), lambda i: _keys([(side, [F.get(h, i + side * k) for k in range(1, CONTEXT_WORDS + 1)]) for side in (-1, 1)]))

    every = docs.select(F.explode(F.get(F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, around(h))), 0)).alias("keys")).select(F.explode("keys").alias("key"))
    some = in_bitmap(every.where("key is not null"), bitmap_of(patterns, "key"), "key")
    return some.join(patterns, "key", "left_semi").groupBy("key").agg(F.count("*").alias("total"))


def _form(hit: Column, settings: Bootstrap) -> Column:
    """The form of an unknown token: like an address, a secret, a number, or none (null)."""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    secret = hit.rlike(r"\A[A-Za-z0-9_+/=.-]+\z") & hit.rlike("[A-Za-z]") & (digits > 0) & (F.length(hit) >= settings.min_secret)
    return F.when(F.contains(hit, F.lit("@")), F.lit("at")).when(secret, F.lit(SECRET)).when((digits >= settings.min_digits) & (2 * digits >= F.length(hit)), F.lit("number"))


def _unknown(seen: DataFrame, settings: Bootstrap) -> DataFrame:
    """Tokens of identifier form, without outer punctuation, that no base span overlaps."""
    lead = F.regexp_extract("hit", r"\A[^A-Za-z0-9+@]*+", 0)
    core = F.regexp_replace("hit", r"\A[^A-Za-z0-9+@]++|(?<![^A-Za-z0-9])[^A-Za-z0-9]++\z", "")
    tokens = seen.where("kind = 'token'").select("doc_id", "h", (F.col("start") + F.length(lead)).alias("start"), (F.col("start_b") + F.octet_length(lead)).alias("start_b"), core.alias("hit"), "keys")
    tokens = tokens.withColumns({"end": F.col("start") + F.length("hit"), "end_b": F.col("start_b") + F.octet_length("hit"), "form": _form(F.col("hit"), settings)}).where("form is not null")
    base = seen.where("kind <> 'token'").select("doc_id", "h", "start", "end", F.lit(True).alias("base"))
    # Sorted by start, a token is overlapped by a base span that began before and ends after its start, or by the next that starts before its end.
    both = tokens.withColumn("base", F.lit(False)).unionByName(base, allowMissingColumns=True)
    before = Window.partitionBy("doc_id", "h").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("doc_id", "h").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    last_end = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    next_start = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    free = both.withColumn("le", last_end).withColumn("ns", next_start)
    return free.where(~F.col("base") & F.coalesce(F.col("le") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ns") >= F.col("end"), F.lit(True))).select(*tokens.columns)


def bootstrap(docs: DataFrame, seen: DataFrame, settings: Bootstrap) -> DataFrame | None:
    """doc_id, h, kind, start, end, start_b, end_b of the spans that contexts add to the base spans; None if there are none."""
    form_of = F.when(F.col("kind") == "email", F.lit("at")).otherwise(F.lit("number"))
    unknown = materialize(_unknown(seen, settings), "pii-unknown")
    is_seed = (F.col("form") == SECRET) & F.col("hit").rlike(SECRET_SEED)
    facts = ["key", "form", "kind", "hit"]

    def beside(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.explode("keys")).where("key is not null").select(*facts)

    seeds = beside(seen.where("kind <> 'token'").withColumn("form", form_of)).unionByName(beside(unknown.where(is_seed).withColumn("kind", F.lit(SECRET))))
    names, counted = None, None  # identifiers found so far (hit, kind), and patterns' totals, which no round changes
    while True:  # every round finds an identifier that wasn't known, or ends
        known = seeds if names is None else seeds.unionByName(beside(unknown.where(~is_seed).join(names, "hit")))
        by_kind = known.groupBy("key", "form", "kind").agg(F.count("*").alias("n"), F.count_distinct("hit").alias("hits"))
        patterns = by_kind.groupBy("key", "form").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"), F.sum("n").alias("n"), F.sum("hits").alias("support")).where(F.col("support") >= settings.min_support)
        patterns = materialize(patterns, "pii-patterns")
        keys = patterns.select("key").distinct()
        uncounted = materialize(keys if counted is None else keys.join(counted, "key", "left_anti"), "pii-uncounted")
        if not uncounted.isEmpty():
            totals = occurrences(docs, uncounted)
            counted = materialize(totals if counted is None else counted.unionByName(totals), "pii-totals")
        elif counted is None:
            break
        scored = patterns.join(counted, "key").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / F.col("total"))).where(F.col("confidence") >= settings.min_confidence)
        fresh = unknown if names is None else unknown.join(names, "hit", "left_anti")
        edges = fresh.withColumn("key", F.explode("keys")).select("hit", "form", "key").distinct()  # of the graph of patterns and instances
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        found = edges.join(scored.select("key", "form", "kind", "confidence"), ["key", "form"]).groupBy("hit").agg((1 - miss).alias("score"), F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        found = materialize(found.where(F.col("score") >= settings.min_score).select("hit", "kind"), "pii-names")
        if found.isEmpty():
            break
        names = found if names is None else materialize(names.unionByName(found), "pii-names")
    if names is None:
        return None
    return unknown.join(names, "hit").select("doc_id", "h", "kind", "start", "end", "start_b", "end_b")


def _rank() -> Column:
    return F.array_position(F.array(*map(F.lit, [*KINDS, SECRET])), F.col("kind")).cast("int")


def span_rows(docs: DataFrame, settings: Bootstrap | None = None) -> DataFrame:
    """doc_id, h, kind, start, end, start_b, end_b (in bytes), base of every span."""
    seen = materialize(observations(docs), "pii-observations")
    spans = seen.where("kind <> 'token'").select("doc_id", "h", "kind", "start", "end", "start_b", "end_b", F.lit(True).alias("base"))
    more = bootstrap(docs, seen, settings or Bootstrap())
    return spans if more is None else spans.unionByName(more.withColumn("base", F.lit(False)))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(df, id_col, text_col).select("doc_id", text_key().alias("h"), "text")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Bootstrap | None = None) -> DataFrame:
    """doc_id, h, spans: an array of (start, rank, end, kind, base) by start, then kind, for each document with a span.

    ``h`` tells rows with one id and different texts apart; rows that repeat
    both share their entry. Null and empty texts have no spans. Null ids are
    ids like others. Other columns are ignored.
    """
    item = F.struct("start", _rank().alias("rank"), "end", "kind", "base")
    return span_rows(_keyed(df, id_col, text_col), settings).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(item)).alias("spans"))


def _attach(docs: DataFrame, found: DataFrame) -> DataFrame:
    d, f = docs.alias("d"), found.alias("f")
    return d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left").select("d.*", F.coalesce("f.spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def _cuts(spans: DataFrame) -> DataFrame:
    """doc_id, h, cuts: a document's spans as an array of (start_b, end_b, kind) in order; those that overlap are one, of the first's kind."""
    w = Window.partitionBy("doc_id", "h").orderBy("start", "rank", "end")
    ranked = spans.withColumn("rank", _rank())
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = ranked.withColumn("apart", F.coalesce(reached <= F.col("start"), F.lit(True)).cast("int")).withColumn("g", F.sum("apart").over(w))
    one = grouped.groupBy("doc_id", "h", "g").agg(F.min("start_b").alias("start_b"), F.max("end_b").alias("end_b"), F.min_by("kind", F.struct("start", "rank", "end")).alias("kind"))
    return one.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start_b", "end_b", "kind"))).alias("cuts"))


def masked(text: Column, cuts: Column) -> Column:
    """The text with each cut replaced by its kind in brackets. Pieces are taken by bytes, so that many cuts of a long text cost no more than the text."""

    def pieces(data: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            since = F.when(i > 0, F.get(cuts, i - 1)["end_b"]).otherwise(F.lit(0))
            return F.concat(F.substring(data, (since + 1).cast("int"), (c["start_b"] - since).cast("int")).cast("string"), F.lit("["), F.upper(c["kind"]), F.lit("]"))

        end = F.element_at(cuts, -1)["end_b"]
        return F.concat(F.array_join(F.transform(cuts, piece), ""), F.substring(data, (end + 1).cast("int"), F.octet_length(data)).cast("string"))

    return F.when(F.size(cuts) > 0, F.get(F.transform(F.array(text.cast("binary")), pieces), 0)).otherwise(text)


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Bootstrap | None = None) -> DataFrame:
    """``df`` with the personal data in its texts masked; a null text stays null. All columns are kept, whatever their names."""
    cuts = _cuts(span_rows(_keyed(df, id_col, text_col), settings)).alias("c")
    rows = boxed(df, F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).alias("key")).alias("d")
    joined = rows.join(cuts, F.col("d.id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.h")), "left").select("d.row", "c.cuts")
    text = F.col("row")[text_col]
    return joined.select(F.when(F.col("cuts").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, masked(text, F.col("cuts")))).alias("row")).select("row.*")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, all spans and their number, of every document."""
    docs = _keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = _attach(docs.select("doc_id", "h"), find(docs))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
