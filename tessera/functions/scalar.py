"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the base-64 number alphabet.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"


def num_digits(x: Column) -> Column:
    return F.length(F.abs(x).cast("string")).cast("long")


def pad(x: Column, width: int) -> Column:
    """Zero-padded decimal, never cut."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def unpad(s: Column) -> Column:
    return s.cast("long")


def decode_multi(s: Column, width: int) -> Column:
    """The numbers of a string of fixed-width decimals."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / width).cast("int") - 1), lambda i: F.substring(s, i * width + 1, F.lit(width)).cast("long"))


def base64_int(x: Column) -> Column:
    """A non-negative number in base 64, by six bits a digit, without leading zeros."""
    digits = F.transform(F.sequence(F.lit(60), F.lit(0), F.lit(-6)), lambda k: F.substring(F.lit(ALPHABET), F.call_function("shiftright", x, k).bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1)))
    text = F.ltrim(F.array_join(digits, ""), F.lit("0"))
    return F.when(text == "", F.lit("0")).otherwise(text)


def base64_int_decode(s: Column) -> Column:
    return F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda acc, c: acc * 64 + (F.call_function("locate", c, F.lit(ALPHABET)) - 1))


def format_attrs(attrs: Column, delimiter: str) -> Column:
    return F.array_join(attrs, delimiter)


def split_attrs(text: Column, delimiter: str) -> Column:
    return F.split(text, "\\Q" + delimiter + "\\E", -1)


def length_header(attrs: Column, delimiter: str) -> Column:
    """The attributes' lengths, then the attributes."""
    return F.concat_ws(delimiter, F.array_join(F.transform(attrs, lambda a: F.length(a).cast("string")), delimiter), F.array_join(attrs, delimiter))


def fix_width(a: Column, n: int, filler: str = "|") -> Column:
    return F.rpad(F.substring(a, 1, n), n, filler)


def shard(x: Column, shards: int) -> Column:
    return F.pmod(x, F.lit(shards))


def host(x: Column, shards: int, hosts: int) -> Column:
    return F.pmod(shard(x, shards), F.lit(hosts))


def local_id(x: Column, shards: int) -> Column:
    return F.floor(x / shards)


def global_id(local: Column, shard_id: Column, shards: int) -> Column:
    return local * shards + shard_id


def ngram_hash(gram: Column, n: int) -> Column:
    """The first n characters' codes as digits in base 256, the first most significant."""
    out = F.lit(0)
    for i in range(n):
        out = out * 256 + F.ascii(F.substring(gram, i + 1, 1))
    return out.cast("long")


def pack(v: Column, w: Column) -> Column:
    return F.shiftleft(v.cast("long"), 32).bitwiseOR(w.cast("long"))


def transpose_permutation(i: Column, n: int, k: int) -> Column:
    """Where position i goes when 0 .. n - 1, laid out in rows of k, are read by columns."""
    rows, rest = divmod(n, k)
    column, row = i % k, F.floor(i / k)
    return (column * rows + F.least(column, F.lit(rest)) + row).cast("long")


def rotation_permutation(i: Column, n: int, groups: int, shift: int) -> Column:
    """An invertible permutation of 0 .. n - 1: position i joins group i % groups, and groups are rotated by ``shift`` and laid end to end."""
    g = F.pmod(i % groups + shift, F.lit(groups))
    return (F.element_at(_group_starts(n, groups, shift), g.cast("int") + 1) + F.floor(i / groups)).cast("long")


def _group_starts(n: int, groups: int, shift: int) -> Column:
    """Where each place of the rotation starts; groups that were first have one more member where n isn't a multiple of groups."""
    size, rest = divmod(n, groups)
    starts, acc = [], 0
    for place in range(groups):
        starts.append(acc)
        acc += size + ((place - shift) % groups < rest)
    return F.array(*map(F.lit, starts))


def rotation_inverse(j: Column, n: int, groups: int, shift: int) -> Column:
    """The i that rotation_permutation takes to j."""
    array = _group_starts(n, groups, shift)
    place = F.size(F.filter(array, lambda s: s <= j)) - 1
    return ((j - F.element_at(array, place + 1)) * groups + F.pmod(place - shift, F.lit(groups))).cast("long")


def parse_query(line: Column, fields: list[str]) -> list[Column]:
    """Comma-separated numbers by name."""
    parts = F.split(line, ",")
    return [F.element_at(parts, i + 1).cast("long").alias(name) for i, name in enumerate(fields)]


def parse_edge(line: Column) -> list[Column]:
    """i, j and cost of a line "i j label"."""
    pattern = r"^\s*(\d+)\s+(\d+)\s+(\S+)\s*$"
    return [F.regexp_extract(line, pattern, k).cast(t).alias(n) for k, n, t in ((1, "i", "long"), (2, "j", "long"), (3, "cost", "double"))]
