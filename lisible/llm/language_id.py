"""Language identification by compression.

One zstandard raw-content dictionary per language is cut from training texts.
A text is encoded with every dictionary; the language whose dictionary gives
the smallest encoding is the prediction, and a narrow margin between the two
smallest sizes rejects it. Texts are reduced to lower-case letter runs first,
split into blocks of ``BLOCK_BYTES`` that are encoded one by one (so the
dictionary matters as much at the end of a long text as at its beginning), and
a text shorter than ``SHORTEST_BYTES`` is repeated up to it, because shorter
blocks are stored uncompressed.

The dictionaries are learned from a bounded sample (``DICTIONARY_BYTES`` per
language): the training texts with the smallest seeded hashes, each text once.

Inputs and their results: a null text, or one without any letter, gives
``und`` with score 0 and is rejected; texts are encoded whole; ties go to the
language with more training rows (then by name); equal texts get equal
results, whatever their doc_id; rows with a null or blank lang are not learned
from; without any learned language every text is ``und``; columns other than
doc_id, text and lang are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from lisible.llm.common import bound_batches, crc_mod, read, stored

#: Bytes of training text per language; the sample, its transfer and the dictionaries are bounded by it.
DICTIONARY_BYTES = 110_000
#: Different training texts per language that the sample aims at; enough to fill a dictionary many times over.
SAMPLE_ROWS = 400
#: Languages whose dictionaries travel to the tasks at once; more are encoded group after group, the two smallest sizes kept.
GROUP = 200
BLOCK_BYTES, SHORTEST_BYTES = 4096, 256
LEVEL, MIN_MATCH = 5, 3
#: Relative margin between the two smallest encodings under which the document is rejected.
MARGIN = 0.002
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-case letter runs of a text, one blank between."""
    kept = _OTHER.sub(" ", text.lower()).strip() if text else ""
    if not kept.replace(" ", "").isalpha():  # number forms that are no digits, like superscripts and fractions
        kept = " ".join("".join(c if c.isalpha() else " " for c in kept).split())
    return kept.encode()


class Encoders:
    """The compressors of one task, made once from the dictionaries."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        params = zstd.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, window_log=20, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for lang, data in dictionaries:
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append((lang, zstd.ZstdCompressor(dict_data=d, compression_params=params)))

    def sizes(self, text: bytes) -> list[int]:
        if len(text) < SHORTEST_BYTES:
            text = (text + b" ") * -(-SHORTEST_BYTES // (len(text) + 1))
        blocks = [text[i:i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for _, c in self.compressors]

    def smallest(self, data: bytes) -> tuple[str, int, int]:
        """(language, its size, the next smallest size or 0). The compressors stand in order of preference, so ties go to the first."""
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        return self.compressors[best][0], sizes[best], min((s for i, s in enumerate(sizes) if i != best), default=0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        data = letters(text)
        return verdict(*self.smallest(data)) if data and self.compressors else verdict(None, 0, 0)


def verdict(lang: str | None, size: int, second: int) -> tuple[str, float, bool]:
    """(language, score, rejected) of the smallest and the second smallest encoding; a second of 0 is none."""
    if lang is None:
        return UNKNOWN, 0.0, True
    margin = (second - size) / second if second else 1.0
    return lang, margin, margin < MARGIN


def better(a: tuple, b: tuple) -> tuple:
    """The two smallest of (language, size, second) of two groups; ties go to ``a``."""
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    first, other = (b, a) if b[1] < a[1] else (a, b)
    return first[0], first[1], min(s for s in (first[2] or other[1], other[1]) if s)


def learn(training: DataFrame, text: str = "text", lang: str = "lang") -> list[list[tuple[str, bytes]]]:
    """Groups of (language, dictionary) from labelled rows, languages with more rows first, at most GROUP to a group.

    The names and counts of all languages come to the driver, and the samples of one group at a time.
    """
    rows = training.select(F.col(text).cast("string").alias("text"), F.trim(F.col(lang)).alias("lang")) \
        .where("lang <> '' and text is not null")
    # copies are in or out together, so the share wanted is one of different texts
    draw = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(1 << 40))
    texts = rows.select("lang", draw.alias("draw")).groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n"))
    counts = sorted(((r["lang"], r["n"], r["texts"]) for r in texts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).collect()),
                    key=lambda x: (-x[1], x[0]))
    groups = [counts[i:i + GROUP] for i in range(0, len(counts), GROUP)]
    return [g for g in (_dictionaries(rows.where(F.col("lang").isin([c[0] for c in group])), draw, group) for group in groups) if g]


def _dictionaries(rows: DataFrame, draw: Column, counts: list[tuple[str, int, int]]) -> list[tuple[str, bytes]]:
    """(language, dictionary) of one group of (language, rows, texts)."""
    # only texts whose hash falls under the share wanted of their language go on, each text once
    share = F.lit(0.0)
    for name, _, n_texts in counts:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, SAMPLE_ROWS / n_texts))).otherwise(share)
    picked = rows.withColumn("draw", draw).where(F.col("draw") <= share * F.lit(float(1 << 40)))
    each = picked.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    # whole texts until the dictionary is full; the text that fills it is cut there
    sized = each.withColumn("bytes", F.octet_length("text"))
    before = Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    kept = sized.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("before") < 2 * DICTIONARY_BYTES)
    kept = kept.select("lang", "draw", F.substring("text", 1, 2 * DICTIONARY_BYTES).alias("text"))
    samples: dict[str, list[bytes]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["draw"])):
        samples.setdefault(r["lang"], []).append(letters(r["text"]))
    return [(name, b" ".join(samples[name])[:DICTIONARY_BYTES]) for name, _, _ in counts if any(samples.get(name, []))]


def identify(docs: DataFrame, groups: list[list[tuple[str, bytes]]], text: Column, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns of every row and lang_pred, score, rejected of its text."""
    fields = docs.select(*keep, text.cast("string").alias("_language_text"))
    kept = fields.drop("_language_text")
    told = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    n = len(kept.columns)
    state = StructType([*fields.schema.fields, StructField("_lang", StringType()), StructField("_size", LongType()), StructField("_second", LongType())])
    groups = groups or [[]]
    for number, dictionaries in enumerate(groups):
        bundle = docs.sparkSession.sparkContext.broadcast(dictionaries)
        first, last = number == 0, number + 1 == len(groups)

        def run(batches, bundle=bundle, first=first, last=last):
            encoders = Encoders(bundle.value)
            for batch in batches:
                before = [(None, 0, 0)] * batch.num_rows if first else list(zip(*(batch.column(n + k).to_pylist() for k in (1, 2, 3))))
                found = []
                for t, old in zip(batch.column(n), before):
                    data = letters(t.as_py())
                    found.append(better(old, encoders.smallest(data)) if data and encoders.compressors else old)
                if last:
                    arrays = [batch.column(i) for i in range(n)] + [pa.array(c, k) for c, k in zip(
                        zip(*(verdict(*f) for f in found)) if found else [[]] * 3, (pa.string(), pa.float64(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=told.names)
                else:
                    arrays = [batch.column(i) for i in range(n + 1)] + [pa.array(c, k) for c, k in zip(
                        zip(*found) if found else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=state.names)

        fields = fields.mapInArrow(run, told if last else state)
        if not last:  # one group's dictionaries at a time in a worker
            fields = stored(fields, "language-groups")
    return fields


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: those outside the held-out quarter of ids."""
    return docs.where(crc_mod("doc_id", 4) != 2).select("text", "lang")


def filter_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with a margin; rejected ones go. Columns and values stay as they are.

    With one group of languages only the text travels to Python and only the
    decision comes back; with more, rows travel as a struct beside their text.
    """
    bound_batches(docs.sparkSession)
    groups = learn(labelled(docs))
    if len(groups) > 1:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        return identify(docs.select(row, F.col("text").alias("t")), groups, F.col("t"), [F.col("row")]).where("not rejected").select("row.*")
    bundle = docs.sparkSession.sparkContext.broadcast(groups[0] if groups else [])

    @F.pandas_udf("boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoders = Encoders(bundle.value)
        for texts in batches:
            yield pd.Series([not encoders.predict(t)[2] for t in texts], dtype=bool)

    return docs.where(told(F.col("text").cast("string")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = identify(docs, learn(labelled(docs)), F.col("text"), [F.col("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out")])
    return told.select("doc_id", "held_out", "lang_pred", F.col("score"), "rejected")
