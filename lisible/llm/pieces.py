"""Piece encoding of whole texts in Spark tasks (see ``wfst`` for the transducer).

Inputs and their results: a null text is empty and has no ids; texts are
encoded whole, whatever their length; repeated rows and equal texts get equal
ids; a null doc_id is kept; ``encode_documents`` leaves all other columns alone
(a column of the table named like a result column gives way to the result);
an empty table gives no rows. ``round_trip`` compares the decoded ids with the
text; the one difference the pieces cannot show is a blank-mark character in
the text itself, which decodes to a blank and is compared as one.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.llm.common import bound_batches, read
from lisible.llm.wfst import MARK, Machine, compile_model

#: Piece model file; a parameter of every function here. The driver reads it and sends it to the tasks (half a megabyte).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts encoded before their ids are handed on, by characters.
BLOCK_CHARS = 2_000_000

_machines: dict[str, Machine] = {}


#: Segments that a worker of the query keeps; in a pipeline, where earlier stages have grown the executors, the model's own bound holds.
QUERY_CACHE_BYTES = 128 << 20


def machine(data: bytes, cache_bytes: int | None = None) -> Machine:
    """The compiled model of this process; compiled once per worker, its cache lives as long."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _machines:
        _machines.clear()
        _machines[key] = compile_model(data)
    if cache_bytes is not None:
        _machines[key].cache_bytes = cache_bytes
    return _machines[key]


def _blocks(texts: pa.Array):
    """Runs of rows whose texts come to about BLOCK_CHARS bytes, at least one row each."""
    start, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts.fill_null("")).to_pylist()):
        if size and size + n > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, text: str = "text", model: str = MODEL, cache_bytes: int | None = None) -> DataFrame:
    """The rows with n_ids, ids (array<int>), decoded_sha256 and round_trip of their text.

    ``cache_bytes`` is what a worker may keep of segments seen before (``Machine``'s own bound unless given).
    """
    bound_batches(docs.sparkSession)
    with open(model, "rb") as f:
        bundle = docs.sparkSession.sparkContext.broadcast(f.read())
    added = ["n_ids", "ids", "decoded_sha256", "round_trip"]
    keep = [c for c in docs.columns if c not in added]
    rows = docs.select(*keep, F.col(text).cast("string").alias("_piece_text"))
    schema = rows.drop("_piece_text").schema.add("n_ids", "long").add("ids", T.ArrayType(T.IntegerType())) \
        .add("decoded_sha256", "string").add("round_trip", "boolean")

    def run(batches):
        m = machine(bundle.value, cache_bytes)
        for batch in batches:
            for start, stop in _blocks(batch.column(batch.num_columns - 1)):
                part = batch.slice(start, stop - start)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                ids = [m.encode(t) for t in texts]
                decoded = [m.decode(x) for x in ids]
                counts = np.array([len(x) for x in ids], np.int64)
                values = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                     pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                     pa.array([d == t.replace(MARK, " ") for d, t in zip(decoded, texts)])], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with ``decoded``, the text of their ids; null ids decode to an empty text."""
    with open(model, "rb") as f:
        bundle = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decoded(column):
        m = machine(bundle.value)
        return column.map(lambda x: "" if x is None else m.decode(x))

    return encoded.withColumn("decoded", decoded(F.col(ids)))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), cache_bytes=QUERY_CACHE_BYTES).drop("text")
