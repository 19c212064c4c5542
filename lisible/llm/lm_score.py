"""Language-model scores by deleted interpolation of word n-grams.

The model mixes three estimates of a token after its context, the word before it::

    p(w | h) = L2[b] * c(h, w) / c(h) + L1[b] * c(w) / N + L0[b] / (V + 1)

with weights per bucket b of the context's count, learned by expectation
maximisation on held-out counts: a fold of the training documents is left out
of the counts while the weights are learned, and put back for scoring. Every
word is a context and a predicted word of its own, however rare, and every
count is exact; the beginning of a text is a context as well. A context without
a count has no bigram estimate, and its weights leave that out. A caller of
``train`` may ask for a smaller n-gram vocabulary (``context_bits``: words with
at least ``N / 2**context_bits`` occurrences); all other words are then one
class, and a word is drawn from it by its share, so that ``c(h, w) / c(h)``
becomes ``c(h, class) / c(h) * c(w) / c(class)``. op10 does not ask for it.

All counts are exact and grow with the corpus: words by their hash, pairs by
both words. What travels to the tasks is bounded whatever the corpus: words with
at least ``N / 2**LEXICON_BITS`` occurrences and pairs with at least
``N / 2**PAIR_BITS`` (no more than ``2**BITS`` can exist). Tokens these tables
answer are scored where the text stands. The others meet in buckets, packed in
blocks: each block names a pair once, with its count and the documents that hold
it, and the bucket gives back sums per document. Tokens whose context and word
both are not in the table (under a hundredth) meet the counts in joins. No key
can be frequent there, since the frequent ones are answered already. A smaller
n-gram vocabulary takes the plainer way: a row per token the tables do not
answer, and joins with the word and pair counts.

Inputs and their results: a null or empty text has one token, its end; texts
are scored whole; rows that repeat a doc_id are one document whose texts are
scored one by one and added up (a null doc_id likewise); without any training
token every token has probability one and both scores are 0; columns other than
doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.common import crc_mod, read, stored
from lisible.llm.wordhash import ORDER, Counter, chunks, mix

LEXICON_BITS, PAIR_BITS = 22, 20
#: Held-out fold of the training documents, on which the mixture weights are learned.
FOLDS, TEST_FOLD, WEIGHT_FOLD = 7, 2, 6
EM_ROUNDS = 60
#: Cells per doubling in which held-out probabilities are gathered for expectation maximisation.
CELLS = 8
#: Buckets of contexts: c(h) = 0, then powers of two of c(h).
BUCKETS = 64
#: The end of a text, as a token.
END = np.uint64(0x5851F42D4C957F2D)
#: The context at the beginning of a text, and the class of words outside a smaller n-gram vocabulary.
BEGIN, RARE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x3C79AC492BA7B653)
#: No held-out estimate: its logarithm's cell.
NONE = -(1 << 20)


def token_chunks(column: pa.Array):
    """(first row, end row, token hashes, tokens of each row): words and one end per text."""
    for start, stop, hashes, counts in chunks(column):
        own = counts + 1
        ends = np.cumsum(own) - 1
        tokens = np.empty(int(own.sum()), np.uint64)
        word = np.ones(len(tokens), dtype=bool)
        word[ends] = False
        tokens[ends] = END
        tokens[word] = hashes
        yield start, stop, tokens, own


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in a sorted table, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


@dataclass
class Counts:
    """Frequent words (by sorted hash), and what is known of every class, for counts with or without the weight fold."""
    hashes: np.ndarray
    counts: np.ndarray
    #: Which of them are in the n-gram vocabulary; if ``whole`` all words are, also those that are not here.
    own: np.ndarray
    whole: bool
    #: Occurrences of all tokens, of the rare class as a word and as a context, and texts.
    tokens: int
    rare: int
    rare_context: int
    texts: int

    def classes(self, tokens: np.ndarray, per_text: np.ndarray):
        """(position, found, class, context) of every token; classes are hashes."""
        at, found = _find(self.hashes, tokens)
        classes = tokens if self.whole else np.where(found & self.own[at] if len(self.own) else False, tokens, RARE)
        context = np.empty_like(tokens)
        context[1:] = classes[:-1]
        context[np.cumsum(per_text) - per_text] = BEGIN
        return at, found, classes, context

    def look_up(self, tokens: np.ndarray, per_text: np.ndarray):
        """(class, context, count of the context, count of the word) of every token; a count not known here is -1."""
        at, found, classes, context = self.classes(tokens, per_text)
        word = np.where(found, self.counts[at], -1) if len(self.counts) else np.full(len(tokens), -1, np.int64)
        of_class = np.where(classes == RARE, self.rare_context, word)
        before = np.empty_like(word)
        before[1:] = of_class[:-1]
        before[np.cumsum(per_text) - per_text] = self.texts
        return classes, context, before, word


def pair_keys(context: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hash of a pair."""
    return mix(context * np.uint64(ORDER[0]) + classes * np.uint64(ORDER[1]))


def _counted(docs: DataFrame, keys_of, schema_key: str) -> DataFrame:
    """(key, kept, left): counts outside and inside the weight fold; summed in the task, then per key."""
    def run(batches):
        counter = Counter(2, BLOCK)

        def block():
            keys, n = counter.take()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1])], [schema_key, "kept", "left"])

        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            for start, stop, tokens, own in token_chunks(batch.column(0)):
                left = np.repeat(fold[start:stop] == WEIGHT_FOLD, own)
                counter.add(keys_of(tokens, own), np.stack([~left, left], axis=1).astype(np.int64))
                if counter.full():
                    yield block()
        yield block()

    return docs.select(F.col("text").cast("string").alias("text"), F.col("fold").cast("int").alias("fold")) \
        .mapInArrow(run, f"{schema_key} bigint, kept bigint, left bigint") \
        .groupBy(schema_key).agg(F.sum("kept").alias("kept"), F.sum("left").alias("left"))


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a table that is bounded by its caller."""
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in df.columns}


@dataclass
class Model:
    """Counts (stored tables; of frequent words also in memory) and mixture weights.

    ``pairs`` holds all pairs of a smaller n-gram vocabulary; else the frequent ones and those of two rare words, and
    ``docs`` has the training documents, from which ``score`` counts the others where their tokens meet.
    """
    words: DataFrame
    pairs: DataFrame
    docs: DataFrame
    counts: Counts
    tokens: int
    distinct: int
    weights: np.ndarray
    lexicon_bits: int


def bucket(count: np.ndarray, total: int = 0) -> np.ndarray:
    """Number of the context's bucket: 0 without a count, else one more than the doublings in c(h)."""
    return np.where(count > 0, np.clip(1 + np.floor(np.log2(np.maximum(count, 1) + 0.5)), 1, BUCKETS - 1), 0).astype(np.int64)


def _bucket(count: Column) -> Column:
    return F.when(count > 0, F.least(F.lit(1) + F.floor(F.log2(count + F.lit(0.5))), F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")


def learn_weights(cells: list[tuple[int, float, float, float, float]], rounds: int = EM_ROUNDS) -> np.ndarray:
    """Mixture weights (L0, L1, L2) per bucket from held-out cells (bucket, p0, p1, p2, n).

    One imagined observation per component keeps every weight above zero; a
    bucket without cells gets the weights of all cells together.
    """
    def maximise(p, n):
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            mixed = p * lam
            share = mixed / mixed.sum(axis=1, keepdims=True)
            lam = (share * n[:, None]).sum(axis=0) + 1.0
            lam /= lam.sum()
        return lam

    if not cells:
        return np.tile(np.array([1.0, 0.0, 0.0]), (BUCKETS, 1))
    b = np.array([c[0] for c in cells])
    p = np.array([c[1:4] for c in cells])
    n = np.array([c[4] for c in cells])
    out = np.tile(maximise(p, n), (BUCKETS, 1))
    for i in np.unique(b):
        out[i] = maximise(p[b == i], n[b == i])
    return out


def _log_cell(p: Column) -> Column:
    return F.when(p > 0, F.round(F.lit(CELLS) * F.log2(p)).cast("int")).otherwise(F.lit(NONE))


def _log_cells(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(CELLS * np.log2(np.maximum(p, 1e-300))), NONE).astype(np.int32)


def train(docs: DataFrame, context_bits: int | None = None, lexicon_bits: int = LEXICON_BITS) -> Model:
    """Learn from documents (text, fold): counts, then weights on the fold WEIGHT_FOLD."""
    spark = docs.sparkSession
    words = stored(_counted(docs, lambda tokens, own: tokens, "h"), "lm-words")
    row = words.agg(F.sum(F.col("kept") + F.col("left")), F.sum("kept"), F.count(F.lit(1)), F.sum((F.col("kept") > 0).cast("int"))).first()
    n, n_kept, v, v_kept = (int(x or 0) for x in row)
    end = words.where(F.col("h") == F.lit(int(END.view(np.int64)))).first()
    texts_kept, texts = (end["kept"], end["kept"] + end["left"]) if end else (0, 0)
    count = F.col("kept") + F.col("left")
    # at most 2**lexicon_bits rows, since their counts add up to no more than N
    top = _arrays(words.where(count * F.lit(1 << lexicon_bits) >= F.lit(n)).select("h", "kept", "left"))
    order = np.argsort(top["h"].view(np.uint64))
    hashes, kept = top["h"].view(np.uint64)[order], top["kept"][order]
    counts = kept + top["left"][order]
    whole = context_bits is None
    own = np.ones(len(hashes), dtype=bool) if whole else counts * (1 << context_bits) >= n
    end_rare = not (own & (hashes == END)).any()

    def known(counts, tokens, texts):
        rare = 0 if whole else tokens - int(counts[own].sum())
        return Counts(hashes, counts, own, whole, tokens, rare, rare - texts if end_rare and not whole else rare, texts)

    full, part = known(counts, n, texts), known(kept, n_kept, texts_kept)
    shared = spark.sparkContext.broadcast(full)

    def keys_of(tokens, own):
        _, _, classes, context = shared.value.classes(tokens, own)
        return pair_keys(context, classes)

    if whole:
        pairs = stored(_met_pairs(docs, full, part, lexicon_bits), "lm-pairs")
        cells = _met_cells(words, pairs, part, v_kept)
    else:
        pairs = stored(_counted(docs, keys_of, "k"), "lm-pairs")
        cells = _held_out_cells(docs, words, pairs, part, lexicon_bits, n, v_kept)
    weights = learn_weights(cells)
    weights[0] = [weights[0, 0] / weights[0, :2].sum(), weights[0, 1] / weights[0, :2].sum(), 0.0]
    return Model(words, pairs, docs, full, n, v, weights, lexicon_bits)


# With all words in the n-gram vocabulary, tokens meet in buckets. A token belongs to its word if that is not in the
# broadcast table, else to its context if that is not, else to their pair. So all occurrences of a rare word meet in
# one bucket, which then knows that word's count, and the counts of its pairs with the table's words. Tokens of two
# rare words meet there as well, for the word's count; their context's count comes from a join.

#: A rare word's bit in an owner, and the bit of a table word that follows a rare one.
TOP, AFTER = np.uint64(1 << 63), np.uint64(1 << 62)
#: Tokens that a task gathers into one block, and tokens (as bytes of text: six each) that one bucket gets.
BLOCK, BUCKET = 1 << 20, 1 << 20
PACKED = ("bucket int, owner binary, other binary, kept binary, left binary, posts binary, first bigint, doc binary, blank binary, "
          "times binary, known binary, base binary, total binary")
EMPTY = np.zeros(0, np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first, as many as the largest needs."""
    values = np.ascontiguousarray(values).astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    planes = data[1:].reshape(int(data[0]), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :len(planes)] = planes.T
    return out.view("<u8").ravel()


@dataclass
class Lexicon:
    """The broadcast words numbered by falling count, and the frequent pairs by sorted key; number 0 stands for the beginning."""
    hashes: np.ndarray
    numbers: np.ndarray
    #: Counts by number, and the bits of a number.
    counts: np.ndarray
    bits: int
    hot_keys: np.ndarray
    hot_counts: np.ndarray

    @classmethod
    def of(cls, known: Counts, full: Counts, lexicon_bits: int, hot_keys=EMPTY, hot_counts=EMPTY) -> Lexicon:
        """Numbers by the counts ``full``, counts ``known``."""
        order = np.argsort(-full.counts, kind="stable")
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(1, len(order) + 1)
        return cls(known.hashes, numbers, np.concatenate([[known.texts], known.counts[order]]).astype(np.int64), lexicon_bits + 1, hot_keys, hot_counts)

    def numbered(self, tokens: np.ndarray, per_text: np.ndarray):
        """(number of the context, number of the word, hash of the context) of every token; -1 is a rare word's number."""
        distinct, where = np.unique(tokens, return_inverse=True)
        at, found = _find(self.hashes, distinct)
        word = (np.where(found, self.numbers[at], -1) if len(self.numbers) else np.full(len(distinct), -1, np.int64))[where]
        context, before = np.empty_like(word), np.empty_like(tokens)
        context[1:], before[1:] = word[:-1], tokens[:-1]
        first = np.cumsum(per_text) - per_text
        context[first], before[first] = 0, BEGIN
        return context, word, before

    def owners(self, context, word, before, tokens) -> tuple[np.ndarray, np.ndarray]:
        """(owner, other) of every token: what it meets by, and what tells it from the owner's other tokens."""
        rare, after = word < 0, context < 0
        own = np.where(rare, tokens | TOP, np.where(after, before | TOP, (context << self.bits | word).astype(np.uint64)))
        other = np.where(rare, np.where(after, before | TOP, context.astype(np.uint64)), np.where(after, word.astype(np.uint64) | AFTER, np.uint64(0)))
        return own, other


def _buckets(owner: np.ndarray, n: int) -> np.ndarray:
    spread = np.where(owner >= TOP, owner << np.uint64(1), mix(owner))
    return ((spread >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.uint16 if n < 1 << 16 else np.uint32)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes from one row to the next."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _block(n: int, owner, other, kept, left, doc=None, blank=None):
    """Rows of PACKED, one for each bucket that gets tokens: each pair once with its counts, and the documents it is in."""
    bucket = _buckets(owner, n)
    order = np.lexsort((other, owner, bucket))
    bucket, owner, other = bucket[order], owner[order], other[order]
    head = np.flatnonzero(_new(owner, other))
    kept, left = np.add.reduceat(kept[order].astype(np.int64), head), np.add.reduceat(left[order].astype(np.int64), head)
    if doc is not None:
        # blank: 0 an id, 1 none, 2 a token that is only counted
        doc, blank = doc[order], blank[order]
        post = np.flatnonzero(_new(owner, other, doc, blank))
        times, of = np.diff(np.append(post, len(doc))), np.searchsorted(head, post, "right") - 1
        scored = blank[post] < 2
        post, times, of = post[scored], times[scored], of[scored]
        posts = np.bincount(of, minlength=len(head))
        ends = np.cumsum(posts)
    bounds = np.append(np.flatnonzero(_new(bucket[head])), len(head))
    for i, j in zip(bounds[:-1], bounds[1:]):
        keys = owner[head[i:j]]
        row = {"bucket": int(bucket[head[i]]), "owner": _pack(np.diff(keys, prepend=np.uint64(0))), "other": _pack(other[head[i:j]]),
               "kept": _pack(kept[i:j]), "left": _pack(left[i:j])}
        if doc is not None:
            at = slice(ends[i] - posts[i], ends[j - 1])
            ids = doc[post[at]]
            first = int(ids.min()) if len(ids) else 0
            row |= {"posts": _pack(posts[i:j]), "first": first, "doc": _pack(ids.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)),
                    "blank": _pack(blank[post[at]]), "times": _pack(times[at])}
        yield row


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _packed(rows: list[dict]):
    """Arrow batches of rows of PACKED, a few rows each."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in PACKED.split(", "))])
    for i in range(0, len(rows), 16):
        yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in rows[i:i + 16]], schema=schema)


def _met(table: pa.Table):
    """The pairs of a bucket: (owner, other, kept, left), the owner word's (kept, left), and the pair's number of every packed one."""
    keys = [{c: _unpack(v) for c, v in zip(("owner", "other", "kept", "left"), row)} for row in
            zip(*(table.column(c).to_pylist() for c in ("owner", "other", "kept", "left"))) if row[0] is not None]
    owner = np.concatenate([EMPTY, *(np.cumsum(r["owner"], dtype=np.uint64) for r in keys)])
    other, kept, left = (np.concatenate([EMPTY, *(r[c] for r in keys)]) for c in ("other", "kept", "left"))
    order = np.lexsort((other, owner))
    owner, other, kept, left = owner[order], other[order], kept[order].astype(np.int64), left[order].astype(np.int64)
    new = _new(owner, other)
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    kept, left = (np.add.reduceat(x, head) if len(head) else x for x in (kept, left))
    owner, other = owner[head], other[head]
    # occurrences of the owner as a word: all of its tokens but those it only stands before
    of = np.cumsum(_new(owner)) - 1
    is_word = (other < AFTER) | (other >= TOP)
    totals = [np.bincount(of, x * is_word).astype(np.int64)[of] if len(of) else x for x in (kept, left)]
    return owner, other, kept, left, totals[0], totals[1], pair


def _before_word(lexicon: Lexicon, owner, other, own):
    """(count of the context, count of the word, whether the word is rare) of pairs with a table word or of two; ``own`` counts the owner."""
    rare, after = (owner >= TOP) & (other < AFTER), (owner >= TOP) & (other >= AFTER)
    both = owner < TOP
    mask = np.uint64((1 << lexicon.bits) - 1)
    h = np.where(both, owner >> np.uint64(lexicon.bits), np.where(rare, other, np.uint64(0))).astype(np.int64)
    w = np.where(both, owner & mask, np.where(after & (other < TOP), other ^ AFTER, np.uint64(0))).astype(np.int64)
    return np.where(after, own, lexicon.counts[h]), np.where(rare, own, lexicon.counts[w]), rare


PAIRS = "kind int, h bigint, w bigint, kept bigint, left bigint, word bigint, q1 int, q2 int"
CELL, HOT, COLD = 0, 1, 2


def _met_pairs(docs: DataFrame, full: Counts, part: Counts, lexicon_bits: int) -> DataFrame:
    """Counts of pairs from their buckets, one row each (PAIRS).

    CELL: held-out tokens by (bucket ``h``, ``q1``, ``q2``), ``left`` of them; HOT: frequent pairs by key ``h``;
    COLD: pairs of the rare words ``h`` and ``w``, the latter counted ``word`` times outside the weight fold.
    """
    n = full.tokens
    buckets = 1 + n // BUCKET
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon.of(part, full, lexicon_bits))

    def out(batches):
        lexicon, held, size = shared.value, [], 0

        def block():
            yield from _packed(list(_block(buckets, *(np.concatenate(x) for x in zip(*held)))))

        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            for start, stop, tokens, per in token_chunks(batch.column(0)):
                context, word, before = lexicon.numbered(tokens, per)
                left = np.repeat(fold[start:stop] == WEIGHT_FOLD, per)
                held.append((*lexicon.owners(context, word, before, tokens), ~left, left))
                size += len(tokens)
                if size >= BLOCK:
                    yield from block()
                    held, size = [], 0
        if held:
            yield from block()

    def met(table: pa.Table) -> pa.Table:
        lexicon = shared.value
        owner, other, kept, left, own, _, _ = _met(table)
        cold = other >= TOP
        seen = (left > 0) & ~cold
        before, word, _ = _before_word(lexicon, owner[seen], other[seen], own[seen])
        cells = np.stack([bucket(before), _log_cells(word / max(part.tokens, 1)), _log_cells(kept[seen] / np.maximum(before, 1))])
        cells, where = np.unique(cells, axis=1, return_inverse=True)
        held = np.bincount(where.ravel(), left[seen], cells.shape[1]).astype(np.int64)
        hot = (owner < TOP) & (kept + left << PAIR_BITS >= n)
        size = (len(held), int(hot.sum()), int(cold.sum()))
        join = lambda *x: np.concatenate([np.broadcast_to(np.asarray(v), k) for v, k in zip(x, size)])
        signed = lambda x: x.view(np.int64)
        columns = [join(CELL, HOT, COLD), join(cells[0], signed(owner[hot]), signed(other[cold])), join(0, 0, signed(owner[cold])),
                   join(0, kept[hot], kept[cold]), join(held, left[hot], left[cold]), join(0, 0, own[cold]), join(cells[1], 0, 0), join(cells[2], 0, 0)]
        return pa.table({c.split()[0]: pa.array(x, _ARROW[c.split()[1]]) for c, x in zip(PAIRS.split(", "), columns)})

    return docs.select(F.col("text").cast("string").alias("text"), F.col("fold").cast("int").alias("fold")) \
        .mapInArrow(out, PACKED).groupBy("bucket").applyInArrow(met, PAIRS)


def _topped(words: DataFrame, h: str, **counts: Column) -> DataFrame:
    """Counts of words by their hash as an owner."""
    return words.select(F.col("h").bitwiseOR(F.lit(-1 << 63)).alias(h), *[c.alias(name) for name, c in counts.items()])


def _met_cells(words: DataFrame, pairs: DataFrame, part: Counts, v_kept: int):
    """(bucket, p0, p1, p2, n) of the weight fold's tokens, under the counts without that fold, gathered in cells."""
    if not part.tokens:
        return []
    met = pairs.where((F.col("kind") == COLD) & (F.col("left") > 0)) \
        .join(_topped(words.where((F.col("left") > 0) & (F.col("kept") > 0)), "h", before=F.col("kept")), "h", "left") \
        .withColumn("before", F.coalesce("before", F.lit(0)))
    rows = pairs.where(F.col("kind") == CELL).select(F.col("h").cast("int").alias("b"), "q1", "q2", "left").unionByName(met.select(
        _bucket(F.col("before")).alias("b"), _log_cell(F.col("word") / F.lit(part.tokens)).alias("q1"),
        _log_cell(F.col("kept") / F.greatest(F.col("before"), F.lit(1))).alias("q2"), "left"))
    got = rows.groupBy("b", "q1", "q2").agg(F.sum("left").alias("n")).collect()
    value = lambda q: 0.0 if q == NONE else 2.0 ** (q / CELLS)
    return [(r["b"], 1.0 / (v_kept + 1), value(r["q1"]), value(r["q2"]), float(r["n"])) for r in got]


SUMS = "doc_id bigint, tokens bigint, known bigint, base double, total double"
PARTS = "part int, first bigint, doc binary, blank binary, tokens binary, known binary, base binary, total binary"
#: Documents whose sums meet in one group.
GROUP = 1 << 13


def _summed(sums: list[np.ndarray], *keys: np.ndarray) -> list[np.ndarray]:
    """Sums by distinct keys, which come sorted before them."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    head = np.flatnonzero(_new(*keys))
    return [*(k[head] for k in keys), *(np.add.reduceat(x[order], head) if len(head) else x for x in sums)]


def _gathered(rows: list[tuple]) -> list[np.ndarray]:
    """Sums of rows (ids, blank, sums ...) per document."""
    ids, blank, *sums = (np.concatenate(x) for x in zip(*rows))
    return _summed(sums, ids, blank)


def _met_scores(docs: DataFrame, model: Model, pair_bits: int, learned: Column | None) -> DataFrame:
    n, v, weights = model.tokens, model.distinct, model.weights
    unseen, floor = 1.0 / (v + 1), np.log10(1.0 / (n + v + 1))
    hot = _arrays(model.pairs.where((F.col("kind") == HOT) & ((F.col("kept") + F.col("left")) * F.lit(1 << pair_bits) >= F.lit(n)))
                  .select("h", (F.col("kept") + F.col("left")).alias("n")))
    order = np.argsort(hot["h"])
    shared = docs.sparkSession.sparkContext.broadcast(
        Lexicon.of(model.counts, model.counts, model.lexicon_bits, hot["h"][order].view(np.uint64), hot["n"][order]))
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, (F.lit(False) if learned is None else learned).alias("counted"), F.lit(True).alias("scored"))
    if learned is None:
        rows = rows.unionByName(model.docs.select(F.lit(None).cast("bigint").alias("doc_id"), text, F.lit(True).alias("counted"), F.lit(False).alias("scored")))
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    buckets, groups = 1 + int(size[0] or 0) // (6 * BUCKET), 1 + size[1] // GROUP

    def probability(before, word, both):
        lam = weights[bucket(before)]
        return lam[:, 2] * both / np.maximum(before, 1) + lam[:, 1] * word / max(n, 1) + lam[:, 0] * unseen

    def out(batches):
        """Sums over what the tables answer, and the other tokens in blocks."""
        lexicon, held, sums, size, texts, number = shared.value, [], [], 0, 0, 0

        def block():
            if held:
                yield from _packed(list(_block(buckets, *(np.concatenate(x) for x in zip(*held)))))
            ids, blank, tokens, known, base, total = (np.concatenate(x) for x in zip(*sums))
            if len(ids):
                yield from _packed([{"bucket": number % buckets, "first": 0, "doc": _pack(ids.view(np.uint64)), "blank": _pack(blank), "times": _pack(tokens),
                                     "known": _pack(known), "base": base.tobytes(), "total": total.tobytes()}])

        for batch in batches:
            ids, none = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            counted, scored = (batch.column(i).fill_null(False).to_numpy(zero_copy_only=False) for i in (2, 3))
            for start, stop, tokens, per in token_chunks(batch.column(1)):
                context, word, before = lexicon.numbered(tokens, per)
                owner, other = lexicon.owners(context, word, before, tokens)
                where, met = _find(lexicon.hot_keys, owner)
                each = lambda x: np.repeat(x[start:stop], per)
                which = each(scored)
                answered = met & which
                total = np.zeros(len(tokens))
                if answered.any():
                    total[answered] = np.log10(probability(lexicon.counts[context[answered]], lexicon.counts[word[answered]], lexicon.hot_counts[where[answered]]))
                known = np.where(word < 0, 0, lexicon.counts[np.maximum(word, 0)])
                first, own = np.cumsum(per) - per, scored[start:stop]
                sums.append([x[own] for x in (ids[start:stop], none[start:stop], per, np.add.reduceat((known > 0).astype(np.int64), first),
                                              np.add.reduceat(np.log10(known + 1.0) + floor, first), np.add.reduceat(total, first))])
                # tokens of two rare words are scored on their own: here they only count their word
                alone = other >= TOP
                sent = ~met & (each(counted) | ~alone)
                mark = np.where(which & ~alone, each(none).astype(np.uint8), 2)
                held.append((owner[sent], np.where(alone, TOP, other)[sent], each(counted)[sent], np.zeros(int(sent.sum()), dtype=bool),
                             np.where(mark == 2, 0, each(ids))[sent], mark[sent]))
                size, texts, number = size + int(sent.sum()), texts + stop - start, int(tokens[0] >> np.uint64(40))
                if size >= BLOCK or texts >= BLOCK >> 4:
                    yield from block()
                    held, sums, size, texts = [], [], 0, 0
        if sums:
            yield from block()

    def met(table: pa.Table) -> pa.Table:
        lexicon = shared.value
        owner, other, both, _, own, _, pair = _met(table)
        usable = other < TOP
        before, word, rare = _before_word(lexicon, owner, np.where(usable, other, np.uint64(0)), own)
        value = np.log10(probability(before, word, both))
        parts, at, size = [], 0, 0
        for r in table.select(["owner", "posts", "first", "doc", "blank", "times", "known", "base", "total"]).to_pylist():
            times, blank = _unpack(r["times"]).astype(np.int64), _unpack(r["blank"]).astype(np.uint8)
            ids = (_unpack(r["doc"]) + np.uint64(r["first"] & (1 << 64) - 1)).view(np.int64)
            if r["owner"] is None:
                parts.append((ids, blank, times, _unpack(r["known"]).astype(np.int64), np.frombuffer(r["base"]), np.frombuffer(r["total"])))
                continue
            posts = _unpack(r["posts"]).astype(np.int64)
            p = np.repeat(pair[at:at + len(posts)], posts)
            at += len(posts)
            parts.append((ids, blank, np.zeros(len(ids), np.int64), times * (rare[p] & (word[p] > 0)), times * np.where(rare[p], np.log10(word[p] + 1.0), 0.0), times * value[p]))
            size += len(ids)
            if size >= BLOCK >> 2:
                parts, size = [_gathered(parts)], 0
        ids, blank, *sums = _gathered(parts)
        part = (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        part, ids, blank, *sums = _summed(sums, part, ids, blank)
        bounds = np.append(np.flatnonzero(_new(part)), len(part))
        made = [{"part": int(part[i]), "first": int(ids[i]), "doc": _pack(np.diff(ids[i:j].view(np.uint64), prepend=ids[i:i + 1].view(np.uint64))), "blank": _pack(blank[i:j]),
                 "tokens": _pack(sums[0][i:j]), "known": _pack(sums[1][i:j]), "base": sums[2][i:j].tobytes(), "total": sums[3][i:j].tobytes()}
                for i, j in zip(bounds[:-1], bounds[1:])]
        return pa.Table.from_pylist(made, schema=pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in PARTS.split(", ")]))

    def gathered(table: pa.Table) -> pa.Table:
        rows = [((np.cumsum(_unpack(r["doc"]), dtype=np.uint64) + np.uint64(r["first"] & (1 << 64) - 1)).view(np.int64), _unpack(r["blank"]), _unpack(r["tokens"]).astype(np.int64),
                 _unpack(r["known"]).astype(np.int64), np.frombuffer(r["base"]), np.frombuffer(r["total"])) for r in table.to_pylist()]
        ids, blank, *sums = _gathered(rows)
        return pa.table([pa.array(ids, mask=blank > 0), *map(pa.array, sums)], names=[c.split()[0] for c in SUMS.split(", ")])

    def alone(batches):
        """Scored tokens of two rare words, each pair of a text once."""
        lexicon = shared.value
        for batch in batches:
            for start, stop, tokens, per in token_chunks(batch.column(1)):
                context, word, before = lexicon.numbered(tokens, per)
                at = np.flatnonzero((context < 0) & (word < 0))
                if len(at):
                    row, h, w = np.repeat(np.arange(start, stop), per)[at], before[at] | TOP, tokens[at] | TOP
                    order = np.lexsort((h, w, row))
                    row, h, w = row[order], h[order], w[order]
                    head = np.flatnonzero(_new(row, h, w))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[head])), pa.array(h[head].view(np.int64)), pa.array(w[head].view(np.int64)),
                                                      pa.array(np.diff(np.append(head, len(row))))], ["doc_id", "h", "w", "times"])

    sums = rows.mapInArrow(out, PACKED).groupBy("bucket").applyInArrow(met, PARTS).groupBy("part").applyInArrow(gathered, SUMS)
    count = F.col("kept") + F.col("left")
    cold = model.words.where(count * F.lit(1 << model.lexicon_bits) < F.lit(n))
    lone = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(alone, "doc_id bigint, h bigint, w bigint, times bigint") \
        .join(model.pairs.where(F.col("kind") == COLD).select("h", "w", count.alias("both")), ["h", "w"], "left") \
        .join(_topped(cold, "h", before=count), "h", "left").join(_topped(cold, "w", word=count), "w", "left").fillna(0, ["both", "before", "word"])
    lam = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, i]]), _bucket(F.col("before")) + 1) for i in range(3)]
    p = lam[2] * F.col("both") / F.greatest(F.col("before"), F.lit(1)) + lam[1] * F.col("word") / F.lit(float(max(n, 1))) + lam[0] * F.lit(unseen)
    lone = lone.select("doc_id", F.lit(0).cast("bigint").alias("tokens"), F.when(F.col("word") > 0, F.col("times")).otherwise(F.lit(0)).alias("known"),
                       (F.col("times") * F.log10(F.col("word") + F.lit(1.0))).alias("base"), (F.col("times") * F.log10(p)).alias("total"))
    return sums.unionByName(lone).groupBy("doc_id").agg(
        F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("total").alias("score"))


def _hot(pairs: DataFrame, n: int, pair_bits: int, count: Column) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the frequent pairs, by key: at most 2**pair_bits rows."""
    hot = _arrays(pairs.where((F.col("kept") + F.col("left")) * F.lit(1 << pair_bits) >= F.lit(n)).select("k", count.alias("n")))
    order = np.argsort(hot["k"])
    return hot["k"][order], hot["n"][order]


OPEN = "key bigint, doc_id bigint, h bigint, w bigint, before bigint, word bigint, rare boolean, tokens int, known int, base double, total double"


def _rows(key, doc, h, w, before, word, rare, tokens=0, known=0, base=0.0, total=0.0) -> pa.RecordBatch:
    n = len(key)
    of = lambda x, kind: pa.array(np.broadcast_to(np.asarray(x), n).astype(kind))
    return pa.RecordBatch.from_arrays(
        [of(key, np.int64), doc, of(h, np.int64), of(w, np.int64), of(before, np.int64), of(word, np.int64), of(rare, bool),
         of(tokens, np.int32), of(known, np.int32), of(base, float), of(total, float)], [x.split()[0] for x in OPEN.split(", ")])


def _open_tokens(docs: DataFrame, shared, strange: bool, answered=None) -> DataFrame:
    """The tokens of documents (doc_id, text) that the broadcast tables do not answer, one row each.

    With ``strange`` those whose context or word has no count there, else the others; the latter come with
    what ``answered(tables, per text, classes, before, word, count of the pair, answered)`` makes of the
    answered ones: rows whose keys meet nothing.
    """
    def run(batches):
        tables, hot_keys, hot_counts = shared.value
        for batch in batches:
            doc_ids = batch.column(0)
            for start, stop, tokens, per in token_chunks(batch.column(1)):
                classes, context, before, word = tables.look_up(tokens, per)
                keys = pair_keys(context, classes).view(np.int64)
                known = (before >= 0) & (word >= 0)
                if strange:
                    at = np.flatnonzero(~known)
                else:
                    where, hot = _find(hot_keys, keys)
                    done = known & hot
                    if answered:
                        yield from answered(tables, start, stop, doc_ids, per, classes, before, word, hot_counts[where] if len(hot_counts) else where, done)
                    at = np.flatnonzero(known & ~hot)
                if len(at):
                    text = np.repeat(np.arange(start, stop), per)
                    # a count that is known here is not looked up: the key of the pair stands in, which spreads and meets nothing
                    h = np.where(before[at] < 0, context[at].view(np.int64), keys[at])
                    w = np.where(word[at] < 0, tokens[at].view(np.int64), keys[at])
                    yield _rows(keys[at], doc_ids.take(pa.array(text[at])), h, w, before[at], word[at], classes[at] == RARE)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OPEN)


def _with_counts(docs: DataFrame, words: DataFrame, pairs: DataFrame, shared, n: int, lexicon_bits: int, count: Column, answered) -> DataFrame:
    """Open tokens with all three counts: ``before`` of the context, ``word``, ``both`` (null if never seen); and the rows of ``answered``."""
    cold = words.where((F.col("kept") + F.col("left")) * F.lit(1 << lexicon_bits) < F.lit(n))
    strange = _open_tokens(docs, shared, True).select("key", "doc_id", "h", "w", "before", "word", "rare") \
        .join(cold.select("h", count.alias("n_h")), "h", "left").join(cold.select(F.col("h").alias("w"), count.alias("n_w")), "w", "left")
    looked_up = lambda have, found: F.when(F.col(have) >= 0, F.col(have)).otherwise(F.coalesce(F.col(found), F.lit(0)))
    unknown = F.when(F.col("word") < 0, F.coalesce("n_w", F.lit(0))).otherwise(F.lit(0))
    strange = strange.select(
        "key", "doc_id", looked_up("before", "n_h").alias("before"), looked_up("word", "n_w").alias("word"), "rare", F.lit(0).alias("tokens"),
        (unknown > 0).cast("int").alias("known"), F.log10(unknown + F.lit(1.0)).alias("base"), F.lit(0.0).alias("total"))
    rows = _open_tokens(docs, shared, False, answered).select(strange.columns).unionByName(strange)
    return rows.join(pairs.select(F.col("k").alias("key"), count.alias("both")), "key", "left")


def _two(rare: int) -> Column:
    """The bigram estimate c(h, w) / c(h), for a word of the rare class by its share."""
    share = F.when(F.col("rare"), F.col("word") / F.lit(float(max(rare, 1)))).otherwise(F.lit(1.0))
    return F.coalesce(F.col("both"), F.lit(0)) / F.greatest(F.col("before"), F.lit(1)) * share


def _held_out_cells(docs, words, pairs, part: Counts, lexicon_bits: int, n: int, v_kept: int):
    """(bucket, p0, p1, p2, n) of the weight fold's tokens, under the counts without that fold, gathered in cells."""
    if not part.tokens:
        return []
    shared = docs.sparkSession.sparkContext.broadcast((part, *_hot(pairs, n, PAIR_BITS, F.col("kept"))))

    def answered(part, start, stop, doc_ids, per, classes, before, word, both, done):
        """Cells: bucket, both logarithms and how many tokens, in a row's columns."""
        b, w, c, rare = before[done], word[done], both[done], classes[done] == RARE
        two = c / np.maximum(b, 1) * np.where(rare, w / max(part.rare, 1), 1.0)
        cells, times = np.unique(np.stack([bucket(b), _log_cells(w / part.tokens), _log_cells(two)]), axis=1, return_counts=True)
        if len(times):
            yield _rows(np.arange(len(times)) * 0x9E3779B1 + start, pa.nulls(len(times), pa.int64()), 0, 0, cells[0], 0, False, times, 0, cells[1], cells[2])

    seen = docs.where(F.col("fold") == WEIGHT_FOLD).select(F.lit(None).cast("bigint").alias("doc_id"), "text")
    # what the fold's texts hold was counted as left; a kept count of 0 is the same as none
    met = (F.col("left") > 0) & (F.col("kept") > 0)
    rows = _with_counts(seen, words.where(met), pairs.where(met), shared, n, lexicon_bits, F.col("kept"), answered)
    cell = F.col("tokens") > 0
    # cells: buckets x the range of a double's exponent, whatever the corpus
    got = rows.groupBy(
        F.when(cell, F.col("before").cast("int")).otherwise(_bucket(F.col("before"))).alias("b"),
        F.when(cell, F.col("base").cast("int")).otherwise(_log_cell(F.col("word") / F.lit(part.tokens))).alias("q1"),
        F.when(cell, F.col("total").cast("int")).otherwise(_log_cell(_two(part.rare))).alias("q2"),
    ).agg(F.sum(F.when(cell, F.col("tokens")).otherwise(F.lit(1))).alias("n")).collect()
    value = lambda q: 0.0 if q == NONE else 2.0 ** (q / CELLS)
    return [(r["b"], 1.0 / (v_kept + 1), value(r["q1"]), value(r["q2"]), float(r["n"])) for r in got]


def score(docs: DataFrame, model: Model, pair_bits: int = PAIR_BITS, learned: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of documents (doc_id, text).

    ``learned`` tells which of them are the documents that the model was learned from, if all of those are among them:
    their tokens then travel once, to be counted and to be scored.
    """
    if model.counts.whole:
        return _met_scores(docs, model, min(pair_bits, PAIR_BITS), learned)
    n, v, weights = model.tokens, model.distinct, model.weights
    unseen, floor = 1.0 / (v + 1), np.log10(1.0 / (n + v + 1))
    count = F.col("kept") + F.col("left")
    shared = docs.sparkSession.sparkContext.broadcast((model.counts, *_hot(model.pairs, n, pair_bits, count)))

    def answered(counts, start, stop, doc_ids, per, classes, before, word, both, done):
        """One row per text: its tokens, and the sums over those that need no other table."""
        known = np.maximum(word, 0)
        base = np.log10(known + 1.0) + floor
        lam = weights[bucket(before)]
        two = both / np.maximum(before, 1) * np.where(classes == RARE, known / max(counts.rare, 1), 1.0)
        p = lam[:, 2] * two + lam[:, 1] * known / max(n, 1) + lam[:, 0] * unseen
        total = np.where(done, np.log10(np.where(done, p, 1.0)), 0.0)
        first = np.cumsum(per) - per
        texts = stop - start
        yield _rows(np.arange(texts, dtype=np.int64) * 0x9E3779B1 + start, doc_ids.slice(start, texts), 0, 0, -1, 0, False,
                    per, np.add.reduceat((word > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(total, first))

    rows = _with_counts(docs, model.words, model.pairs, shared, n, model.lexicon_bits, count, answered)
    lam = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, i]]), _bucket(F.col("before")) + 1) for i in range(3)]
    p = lam[2] * _two(model.counts.rare) + lam[1] * F.col("word") / F.lit(float(max(n, 1))) + lam[0] * F.lit(unseen)
    return rows.groupBy("doc_id").agg(
        F.sum("tokens").cast("bigint").alias("n_tokens"), F.sum("known").cast("bigint").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum(F.when(F.col("tokens") > 0, F.col("total")).otherwise(F.log10(p))).alias("score"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", crc_mod("doc_id", FOLDS).alias("fold"))
    model = train(docs.where(F.col("fold") != TEST_FOLD))
    return score(docs, model, learned=F.col("fold") != TEST_FOLD).select(
        "doc_id", (crc_mod("doc_id", FOLDS) == TEST_FOLD).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
