"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (lower-cased run of letters and digits) is the bag of its character
n-grams of ``NGRAMS`` characters, with its ends marked, and of itself; its
vector is their average, so a misspelling that was never seen shares most of
its vector with the word. A passage (``PASSAGE`` words) is the average of its
words and goes through the softmax. A text is as toxic as its worst passage,
so one insult weighs as much in a book as in a line, and texts are read whole.

Embeddings and softmax are trained together by gradient descent with momentum:
first on the averages of whole texts, then on the passage that the model finds
worst in each text (of toxic texts the one that shows why, of clean texts the
one most like a toxic one). Both classes weigh the same.

It is trained on a bounded sample: up to ``SAMPLE_TEXTS`` different texts and
``SAMPLE_BYTES`` bytes of either class, those with the smallest hashes, each text
whole. Subwords are hashed into 2**BUCKET_BITS buckets; those found in under one of
``RARE`` sampled texts are left out. The
training is small numpy work in one task, bounded by the sample; scoring is one
pass over the documents, where a word is one number, its share in the log odds.

Inputs and their results: null texts, empty texts and texts without words have
no passage, and their score is the softmax of its bias; rows without a label,
without a text or without an id are not learned from; a text with both labels is
learned with both; without texts of both classes every score is the share of
toxic ones learned from (0 or 1; 0 without any); equal texts get equal scores, repeated
rows one each; a null doc_id counts as empty text in the choice of held-out
rows; columns other than doc_id, text and labels' doc_id and toxic are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.common import crc_mod, read, stored
from lisible.llm.wordhash import mix

NGRAMS = (3, 4, 5)
#: Words of a passage.
PASSAGE = 12
#: Texts and bytes of either class that are learned from at most.
SAMPLE_TEXTS, SAMPLE_BYTES = 3000, 12_000_000
#: A subword counts if it stands in so large a share of the sample's texts (one in RARE, and in two at least).
RARE = 200
DIMENSION, ROUNDS, WARM_UP = 8, 60, 10
STEP, STEP_SOFTMAX, MOMENTUM, SEED = 2.0, 0.5, 0.9, 13
#: Subwords are told apart by so many bits of their hashes.
BUCKET_BITS = 22
#: Words whose log odds a task remembers, and words hashed together.
CACHE, WORD_BLOCK = 300_000, 20_000
#: Texts scored together.
TEXTS = 200

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of words, and the word (its place in the list) that each belongs to.

    A word with its ends marked is hashed whole and in all pieces of each length in NGRAMS, repeated ones each time.
    """
    marked = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    if not len(words):
        return np.zeros(0, np.int64), owner
    at = (np.arange(len(codes)) - starts[owner]).astype(np.uint64)
    found = [mix(np.add.reduceat(mix(codes + (at << np.uint64(32))), starts))]
    owners = [np.arange(len(words))]
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + len(h)]
        inside = owner[:len(h)] == owner[n - 1:]
        found.append(mix(h[inside]))
        owners.append(owner[:len(h)][inside])
    return (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate(owners)


def passage_starts(n: int) -> range:
    """First words of the passages of a text of n words; a short rest belongs to the last one."""
    return range(0, max(1, n - PASSAGE // 2), PASSAGE)


@dataclass(frozen=True)
class Model:
    """``shares``: what a subword's bucket adds to the log odds of a word's sum of subwords; ``bias``: log odds of no words."""
    shares: dict[int, float]
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS)
        out[np.fromiter(self.shares.keys(), np.int64, len(self.shares))] = np.fromiter(self.shares.values(), float, len(self.shares))
        return out


class Scorer:
    """Scores texts of a task; remembers the log odds of up to CACHE words."""

    def __init__(self, model: Model):
        self.table, self.bias = model.table(), model.bias
        self.known: dict[str, float] = {}

    def learn_words(self, words: list[str]) -> None:
        for i in range(0, len(words), WORD_BLOCK):
            block = words[i:i + WORD_BLOCK]
            buckets, owner = subwords(block)
            mean = np.bincount(owner, self.table[buckets], len(block)) / np.bincount(owner, minlength=len(block))
            self.known.update(zip(block, mean.tolist()))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probabilities that the texts are toxic."""
        documents = [words_of(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        self.learn_words(sorted({w for d in documents for w in d if w not in known}))
        return [self._score([known[w] for w in d]) for d in documents]

    def _score(self, each: list[float]) -> float:
        worst = 0.0
        if each:
            values = np.array(each)
            starts = np.array(passage_starts(len(values)))
            worst = float((np.add.reduceat(values, starts) / np.diff(np.append(starts, len(values)))).max())
        z = self.bias + worst
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))  # never overflows


class _Bags:
    """Bags of members as one flat array; values are taken a dimension at a time, so no temporary is wider than ``flat``."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat = flat.astype(np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.full = np.flatnonzero(np.diff(self.offsets))
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.mean = 1 / np.maximum(1, lengths)

    def gather(self, values: np.ndarray) -> np.ndarray:
        """Sums over the members of each bag; ``values`` is (dimension, member)."""
        out = np.zeros((len(values), len(self.offsets) - 1))
        for row, v in zip(out, values):
            if len(self.full):
                row[self.full] = np.add.reduceat(v[self.flat], self.offsets[self.full])
        return out

    def scatter(self, values: np.ndarray, size: int) -> np.ndarray:
        """Sums over the bags that hold each member; ``values`` is (dimension, bag)."""
        return np.stack([np.bincount(self.flat, v[self.owner], size).astype(float) for v in values])

    def only(self, bags: np.ndarray) -> _Bags:
        lengths = np.diff(self.offsets)[bags]
        return _Bags(self.flat[_ranges(self.offsets[bags], lengths)], lengths)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _known_subwords(names: list[str], documents: list[np.ndarray]) -> tuple[np.ndarray, _Bags, np.ndarray]:
    """Buckets that stand in enough documents, the words as bags of them, and one by each word's number of subwords, rare ones too."""
    flat, sizes = [], []
    for i in range(0, len(names), WORD_BLOCK):
        buckets, owner = subwords(names[i:i + WORD_BLOCK])
        flat.append(buckets[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner))
    every = np.concatenate([*flat, np.zeros(0, np.int32)])
    size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
    start = np.cumsum(size) - size
    held = np.zeros(1 << BUCKET_BITS, np.int32)
    for d in documents:
        if len(d):
            own = np.unique(d)
            held[np.unique(every[_ranges(start[own], size[own])])] += 1
    kept = np.flatnonzero(held >= max(2, -(-len(documents) // RARE)))
    index = np.full(1 << BUCKET_BITS, -1, np.int32)
    index[kept] = np.arange(len(kept))
    at = index[every]
    owner = np.repeat(np.arange(len(names)), size)[at >= 0]
    return kept, _Bags(at[at >= 0], np.bincount(owner, minlength=len(names))), 1 / np.maximum(1, size)


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit on whole texts; the same input gives the same model."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, 800.0 if share == 1 else -800.0)
    number: dict[str, int] = {}
    documents = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    kept, words, scale = _known_subwords(list(number), documents)
    sizes = np.array([len(d) for d in documents])
    tokens = _Bags(np.concatenate(documents), sizes)
    starts = [np.array(passage_starts(n)) if n else np.zeros(1, np.int64) for n in sizes.tolist()]
    begin = np.concatenate([s + o for s, o in zip(starts, tokens.offsets)])
    end = np.concatenate([np.append(s[1:], n) + o for s, n, o in zip(starts, sizes, tokens.offsets)])
    passages = np.array([len(s) for s in starts])
    first = np.cumsum(passages) - passages
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    g = np.random.default_rng(SEED)
    embedding, softmax, bias = g.normal(0, 0.1, (DIMENSION, len(kept))), g.normal(0, 0.25, (2, DIMENSION)), np.zeros(2)
    moving = [np.zeros_like(p) for p in (embedding, softmax, bias)]
    for i in range(ROUNDS):
        if i < WARM_UP:
            own, bag_words, own_scale = words, tokens, scale
        else:
            # a word's log odds are one number; the worst passage of each text follows from their running sums
            odds = words.gather(((softmax[1] - softmax[0]) @ embedding)[None])[0] * scale
            total = np.concatenate([[0.0], np.cumsum(odds[tokens.flat])])
            mean = (total[end] - total[begin]) / np.maximum(1, end - begin)
            hit = np.flatnonzero(mean == np.repeat(np.maximum.reduceat(mean, first), passages))
            worst = hit[np.searchsorted(hit, first)]
            length = end[worst] - begin[worst]
            used, where = np.unique(tokens.flat[_ranges(begin[worst], length)], return_inverse=True)
            own, bag_words, own_scale = words.only(used), _Bags(where, length), scale[used]
        bag = bag_words.gather(own.gather(embedding) * own_scale) * bag_words.mean
        z = softmax @ bag + bias[:, None]
        p = np.exp(z - z.max(axis=0))
        p /= p.sum(axis=0)
        p[y, np.arange(len(y))] -= 1
        p *= balance
        per_word = bag_words.scatter(softmax.T @ p * bag_words.mean, len(own_scale))
        slope = own.scatter(per_word * own_scale, len(kept))
        slope /= np.sqrt((slope * slope).sum()) + 1e-9
        for k, (value, change, step) in enumerate(((embedding, slope, STEP), (softmax, p @ bag.T, STEP_SOFTMAX), (bias, p.sum(axis=1), STEP_SOFTMAX))):
            moving[k] = MOMENTUM * moving[k] + change
            value -= step * moving[k]
    shares = (softmax[1] - softmax[0]) @ embedding
    return Model(dict(zip(kept.tolist(), shares.tolist())), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> DataFrame:
    """(toxic, draw, text): whole texts, a bounded sample of either class by text hash, of rows that may be learned from."""
    named = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")) \
        .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 5) != 0))
    draw = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 40))
    narrow = named.select("doc_id", draw.alias("draw"), F.octet_length("text").alias("bytes"))
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    # copies of a text are in or out together
    each = stored(narrow.join(marked, "doc_id").groupBy("toxic", "draw").agg(F.max("bytes").alias("bytes")), "toxic-draws")
    counts = {r["toxic"]: r["n"] for r in each.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two classes
    chosen: list[tuple[int, int]] = []
    for kind, n in sorted(counts.items()):
        bar = int(min(1.0, 1.5 * texts / n) * (1 << 40))  # half as many again as wanted are looked at
        held = 0
        for r in each.where((F.col("toxic") == kind) & (F.col("draw") < F.lit(bar))).orderBy("draw").limit(texts).collect():
            if held + r["bytes"] <= size:
                held += r["bytes"]
                chosen.append((kind, r["draw"]))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "toxic int, draw bigint"))  # at most twice ``texts``
    return named.select("text", draw.alias("draw")).join(wanted, "draw").groupBy("toxic", "draw").agg(F.min("text").alias("text"))


def learn(sample: DataFrame) -> Model:
    """The model of a bounded sample, trained in one task; its subwords come back to the driver."""
    def run(batches):
        rows = sorted((r["draw"], r["toxic"], r["text"]) for batch in batches for r in batch.to_pylist())
        model = train([t for _, _, t in rows], [k for _, k, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *model.shares], pa.int64()), pa.array([model.bias, *model.shares.values()], pa.float64())],
                                         names=["subword", "share"])

    found = {r["subword"]: r["share"] for r in stored(sample.coalesce(1).mapInArrow(run, "subword bigint, share double"), "toxic-model").collect()}
    # an empty table has no task to train in
    return Model({k: v for k, v in found.items() if k >= 0}, found.get(-1, -800.0))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score of every row."""
    bundle = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        own = Scorer(bundle.value)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                scores = own.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return fields.mapInArrow(run, f"doc_id {dict(fields.dtypes)['doc_id']}, held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    told = score_documents(docs, learn(training_sample(docs, labels)))
    return told.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
