"""Language identification by compression.

Operator 2. Each language gets a raw-content zstandard dictionary: letters of
sample documents of that language. A text's letters are compressed with every
language's dictionary, block by block, and the language whose dictionary makes
them smallest is chosen. The margin over the runner-up is the score; where it
is too narrow the text is rejected.

The dictionaries come from a bounded sample: about ``SAMPLE_DOCS`` documents a
language, a window of at most ``SAMPLE_CHARS`` characters of each (of a longer
one, from a place that a hash of the row names), of which the first
``DICTIONARY_BYTES`` in hash order are used. All languages' samples together have
about ``SAMPLE_TOTAL`` characters at most: with many languages each one's windows
are shorter, and none is left out. Everything else covers all rows and whole
texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices, small_batches

SAMPLE_DOCS = 800
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = 64_000_000
MIN_CHARS = 500  # of a window, however many languages there are
DICTIONARY_BYTES = 256 << 10
LEVEL = 5
BLOCK_BYTES = 16 << 10
MIN_MARGIN = 0.004
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters, with one space for whatever lies between."""
    found = _NOT_LETTERS.sub(" ", text).strip()
    if not found.replace(" ", "").isalpha():  # numerals such as fractions are left
        found = " ".join("".join(c if c.isalpha() else " " for c in found).split())
    return found.lower().encode("utf-8", "surrogatepass")


@dataclass
class LanguageModel:
    """Raw dictionary content by language."""

    dictionaries: dict[str, bytes]
    level: int = LEVEL
    block: int = BLOCK_BYTES
    min_margin: float = MIN_MARGIN

    def compressors(self):
        import zstandard as zstd

        if not hasattr(self, "_compressors"):
            self._compressors = {}
            for lang, content in self.dictionaries.items():
                d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._compressors[lang] = zstd.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._compressors

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin from 0 to 1, rejected.

        Null texts, texts without a letter, and any text when nothing was
        learned are undetermined with score 0. Ties go to the language that
        sorts first. With a single language the score is 1.
        """
        data = letters(text) if text else b""
        if not data or not self.dictionaries:
            return UNDETERMINED, 0.0, True
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.compressors().items())
        margin = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin, margin < self.min_margin


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> LanguageModel:
    """Dictionaries from rows with a label; rows with a null label, and null and empty texts, teach nothing and count for nothing."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # As many rows as there are languages; each language sends about SAMPLE_DOCS windows to the driver.
    n_languages = max(1, counts.count())
    docs = max(8, min(SAMPLE_DOCS, SAMPLE_TOTAL // (n_languages * MIN_CHARS)))
    chars = max(MIN_CHARS, min(SAMPLE_CHARS, SAMPLE_TOTAL // (n_languages * docs)))
    kept = counts.select("lang", F.least(F.lit(1.0), F.lit(float(docs)) / F.col("n")).alias("share"))
    draw = F.xxhash64("doc_id", "text")  # rows that repeat an id are drawn apart
    start = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.join(F.broadcast(kept), "lang").where(F.pmod(draw, F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30))
    windows = drawn.select("lang", draw.alias("h"), F.substring(F.col("text"), start, F.lit(chars)).alias("text")).distinct()
    texts: dict[str, list] = defaultdict(list)
    for r in windows.collect():
        texts[r.lang].append((r.h, r.text))
    content = {}
    for lang, found in sorted(texts.items()):
        held = b""
        for _, text in sorted(found):
            held += letters(text) + b" "
            if len(held) >= DICTIONARY_BYTES:
                break
        if held.strip():
            while len(held) < 8:  # zstandard takes no shorter dictionary
                held += held
            content[lang] = held[:DICTIONARY_BYTES]
    return LanguageModel(content, **options)


def identify(df: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, lang_pred, score and rejected, for every row; only the text decides. ``keep`` names columns of ``df``.

    Repeated rows get the same answer; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    found = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    kept = df.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in keep)).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([kept.schema["row"], *found.fields])

    def rows(batches):
        for batch in batches:
            for part in slices(batch, 4 << 20):
                lang, score, rejected = zip(*map(shared.value.classify, part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return kept.mapInArrow(rows, schema).select("row.*", *found.names)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of all ids that must not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
