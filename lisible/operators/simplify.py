"""Sentence-by-sentence simplification as set jobs.

Flow: sentences → level per sentence → prompts (system + user message)
→ rendered chat → generation → ordered reassembly → re-scoring →
versioned storage. Generators share one contract,
``DataFrame(doc_id, pos, sentence, ...) -> DataFrame(..., prediction, status, error)``,
so a rule rewrite, a file exchange with an external model service or a
per-worker model in ``mapInPandas`` are interchangeable.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.constants import (DEFAULT_GENERATOR, GENERATION_BATCH_SIZE, GENERATION_MIN_LENGTH,
                               LEVELS, SCORER_MAX_TOKENS)
from lisible.functions.levels import dominant_level, level_dim, level_rank
from lisible.functions.text import TOKEN, sentence_array
from lisible.operators.catalog import assign_dense_ids, ordinal_within
from lisible.operators.joins import salted_join

# --- prompt wording (our own; a parameter of the job) -----------------------
SYSTEM_PROMPT = (
    "Tu réécris des phrases françaises pour des lecteurs qui apprennent la langue. "
    "Garde le sens de la phrase de départ, mais rends-la plus facile : un niveau du CECRL "
    "plus bas (C2 vers C1, C1 vers B2, B2 vers B1, B1 vers A2, A2 vers A1)."
)
USER_TEMPLATE = ("Phrase de niveau {level} :\n\"\"\"{sentence}\"\"\"\n"
                 "Écris une seule phrase de niveau {target} qui dit la même chose.")

# --- chat template as data: role → (prefix, suffix) ------------------------
CHAT_BOS = "<s>"
CHAT_TEMPLATE = {
    "system": ("<|system|>\n", "</s>\n"),
    "user": ("<|user|>\n", "</s>\n"),
    "assistant": ("<|assistant|>\n", "</s>\n"),
}
GENERATION_PROMPT = "<|assistant|>\n"

# --- token ids: reserved ids, then the corpus vocabulary by frequency -------
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
PAD_ID = EOS_ID
FIRST_VOCAB_ID = 3

# --- rule rewrite stand-in --------------------------------------------------
CLAUSE_SPLIT = ";| : "
PARENS = "\\([^()]*\\)"

# --- generator registry (fixed): base name, resolved id, listing order ------
GENERATORS = [
    (DEFAULT_GENERATOR, DEFAULT_GENERATOR + ":v1", 0),
    ("rule-rewrite-keep", "rule-rewrite-keep:v1", 1),
]


def sentence_levels(sents: DataFrame, scorer=None) -> DataFrame:
    """``sentence_level``: arg-max level per sentence (no length filter) and its status."""
    from lisible.operators.scoring import DEFAULT_SCORER
    from lisible.operators.sentences import with_token_counts
    scored = (scorer or DEFAULT_SCORER).score(with_token_counts(sents))
    return scored.select(
        *[c for c in sents.columns], "n_tokens",
        dominant_level().alias("difficulty"),
        F.when(F.col("n_tokens") > SCORER_MAX_TOKENS, F.lit("too_long")).otherwise(F.lit("ok")).alias("status"))


def _fill(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns, by concatenation."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            parts.append(F.lit(head))
        parts.append(cols[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def render_message(role: Column, content: Column) -> Column:
    """One message between its role's marks. A missing text is empty, a missing role the user's; a role that the
    template does not name gets marks made of its name."""
    who = F.coalesce(role, F.lit("user"))
    prefix, suffix = F.concat(F.lit("<|"), who, F.lit("|>\n")), F.lit("</s>\n")
    for r, (p, s) in CHAT_TEMPLATE.items():
        prefix = F.when(who == r, F.lit(p)).otherwise(prefix)
        suffix = F.when(who == r, F.lit(s)).otherwise(suffix)
    return F.concat(prefix, F.coalesce(content, F.lit("")), suffix)


def simplification_prompts(levels: DataFrame) -> DataFrame:
    """Per sentence: the two-message chat and its rendered form (with generation prompt)."""
    dim = F.broadcast(level_dim(levels.sparkSession).select(
        F.col("level").alias("difficulty"), F.col("reduced_level").alias("target")))  # fixed 10 rows
    j = levels.join(dim, "difficulty", "left")
    user = _fill(USER_TEMPLATE, level=F.col("difficulty"), sentence=F.col("sentence"), target=F.col("target"))
    system = F.lit(SYSTEM_PROMPT)
    chat = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    formatted = F.concat(F.lit(CHAT_BOS), render_message(F.lit("system"), system),
                         render_message(F.lit("user"), user), F.lit(GENERATION_PROMPT))
    return j.select(*levels.columns, "target", user.alias("user"), chat.alias("chat"),
                    formatted.alias("formatted_chat"))


def render_chat(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rendered pieces of a stored conversation, one row per turn.

    Concatenating ``piece`` in turn order gives the whole rendered chat: the
    first turn carries the begin marker, the last one the generation prompt.
    No conversation is gathered into one task; the last turn per
    conversation is a partial+final aggregate joined back with a salt.
    """
    bounds = turns.groupBy(key).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    j = salted_join(turns, bounds, [key], salt_from=[order])
    piece = F.concat(
        F.when(F.col(order) == F.col("_first"), F.lit(CHAT_BOS)).otherwise(F.lit("")),
        render_message(F.col("role"), F.col("text")),
        F.when(F.col(order) == F.col("_last"), F.lit(GENERATION_PROMPT)).otherwise(F.lit("")))
    return j.select(key, order, "role", piece.alias("piece"))


def render_conversations(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(key, n_turns, formatted_chat)``: each stored conversation as one string, turns in order, generation prompt last.

    A conversation is one row by its nature; turns of equal number go by role, then text.
    """
    whole = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("at"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("_t"))
    pieces = F.transform("_t", lambda t: render_message(t["role"], t["text"]))
    return whole.select(key, F.size("_t").cast("bigint").alias("n_turns"),
                        F.concat(F.lit(CHAT_BOS), F.array_join(pieces, ""), F.lit(GENERATION_PROMPT)).alias("formatted_chat"))


def vocabulary(texts: DataFrame, text: str = "formatted_chat") -> DataFrame:
    """``(token, n, token_id)``: ids by descending frequency then token, after the reserved ids."""
    toks = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0)).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = assign_dense_ids(counts, [F.col("n").desc(), F.col("token")], id_col="token_id", base=FIRST_VOCAB_ID, key=["n", "token"])
    return ranked.select("token", "n", "token_id")


#: Tokens are frequent as far as the vocabulary's first FREQUENT_SHARE ids go (ids follow the frequency), so no more than that many are.
FREQUENT_SHARE = 500_000
#: Id of a token that is not frequent, until the vocabulary tells it.
COLD = -1


def encode_prompts(prompts: DataFrame, vocab: DataFrame, keys=("doc_id", "pos"), text: str = "formatted_chat") -> DataFrame:
    """``(keys, ids)``: begin id then the token ids of each prompt, in order."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0)
    return _encode_slots(prompts.select(*keys, F.array(tokens).alias("_slots")), vocab, list(keys), [[BOS_ID], []], 1)


def _list_arrays():
    """(offsets of sizes, list array of sizes and values, sizes of a list array); made here, so that they travel with a task."""
    import numpy as np
    import pyarrow.compute as pc

    def offsets(sizes):
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])

    def listed(sizes, values):
        return pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), values)

    def sizes(lists):
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets, listed, sizes


def _frequent_ids(vocab: DataFrame):
    """array<string> -> (found, at, cold): ids of frequent tokens, COLD for the others; places and names of the latter."""
    found = vocab.where(F.col("token_id") < FIRST_VOCAB_ID + FREQUENT_SHARE).select("token", "token_id").toArrow()   # at most FREQUENT_SHARE
    shared = vocab.sparkSession.sparkContext.broadcast((found["token"].combine_chunks(), found["token_id"].to_numpy()))

    offsets, listed, sizes_of = _list_arrays()

    @F.arrow_udf("struct<found: array<bigint>, at: array<int>, cold: array<string>>")
    def told(tokens: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        names, numbers = shared.value
        table = dict(zip(names.to_pylist(), numbers.tolist()))   # built once per task, batches ask it for their different tokens
        for lists in tokens:
            flat, sizes = lists.flatten().cast(pa.string()), sizes_of(lists)
            coded = flat.dictionary_encode()
            own = np.array([table.get(t, COLD) for t in coded.dictionary.to_pylist()], np.int64)
            ids = own[coded.indices.to_numpy()]
            cold = np.flatnonzero(ids == COLD)
            row = np.searchsorted(offsets(sizes), cold, side="right") - 1
            n_cold = np.bincount(row, minlength=len(sizes))
            yield pa.StructArray.from_arrays(
                [listed(sizes, pa.array(ids)), listed(n_cold, pa.array((cold - offsets(sizes)[row]).astype(np.int32))),
                 listed(n_cold, flat.take(pa.array(cold)))], ["found", "at", "cold"])
    return told


def _filled():
    """(found, at, more) -> array<bigint>: ``found`` with the ids ``more`` at the places ``at``; what is still COLD is unknown."""
    offsets, listed, sizes_of = _list_arrays()

    @F.arrow_udf("array<bigint>")
    def filled(found: pa.Array, at: pa.Array, more: pa.Array) -> pa.Array:
        import numpy as np
        sizes = sizes_of(found)
        ids = found.flatten().to_numpy(zero_copy_only=False).copy()
        places = np.repeat(offsets(sizes)[:-1], sizes_of(at)) + at.flatten().to_numpy(zero_copy_only=False)
        ids[places] = more.flatten().to_numpy(zero_copy_only=False)
        ids[ids == COLD] = UNK_ID
        return listed(sizes, pa.array(ids))
    return filled


def _encode_slots(prompts: DataFrame, vocab: DataFrame, keys: list, constants: list[list[int]], n_slots: int, late: bool = False,
                  spent: tuple = ()):
    """``(keys, ids)`` of ``(keys, _slots array<array<string>>)``: constants and the ids of the slots' tokens in turn.

    With ``late`` a pair instead: the stored table ``(keys, _ends, _ids)`` of the
    slots' ids alone, and the column that makes ``ids`` of it, so that constants
    that all prompts share are neither stored nor shuffled. Stored tables that
    nothing but ``prompts`` reads can be given as ``spent``; they go once their ids are stored.

    Frequent tokens (a bounded set, see FREQUENT_SHARE) are looked up inside
    the row; only the others meet the vocabulary in a shuffle, as (row, place,
    token), and are put back at their places in Arrow arrays. Rows are told
    apart by the number they are stored with, whatever their keys. The most
    common word is always frequent, so no token gathers in one task.
    """
    from lisible.session import PACKED, discard, materialize
    known = _frequent_ids(vocab)
    flat = prompts.select(*keys, F.transform("_slots", lambda s: F.size(s)).alias("_ends"), known(F.flatten("_slots")).alias("_t"))
    flat = flat.select(F.monotonically_increasing_id().alias("_row"), *keys, "_ends", "_t.found", "_t.at", "_t.cold")
    stored = materialize(flat, "prompt-ids", **PACKED)
    discard(*spent)
    flat = stored.where(F.forall("_ends", lambda n: n >= 0))   # a prompt without a text has no row
    asked = flat.select("_row", F.inline(F.arrays_zip("at", "cold")))
    told = asked.join(vocab.select("token", "token_id"), F.col("cold") == F.col("token")).groupBy("_row") \
        .agg(F.collect_list(F.struct("at", "token_id")).alias("_more"))
    done = flat.where(F.size("cold") == 0).select(*keys, "_ends", F.col("found").alias("_ids"))
    rest = flat.where(F.size("cold") > 0).select("_row", *keys, "_ends", "found").join(told, "_row", "left")
    rows = done.unionByName(rest.select(*keys, "_ends", _filled()("found", F.col("_more")["at"], F.col("_more")["token_id"]).alias("_ids")))
    fixed = lambda x: F.array(*[F.lit(i).cast("bigint") for i in x]) if x else F.array().cast("array<bigint>")

    slot_ids, before = F.col("_ids").cast("array<bigint>"), F.lit(0)
    parts = [fixed(constants[0])]
    for k in range(n_slots):
        size = F.get("_ends", F.lit(k))
        parts += [F.slice(slot_ids, before + 1, size), fixed(constants[k + 1])]
        before = before + size
    ids = F.concat(*parts)
    if not late:
        return rows.select(*keys, ids.alias("ids"))
    if (vocab.agg(F.max("token_id")).first()[0] or 0) < 2**31:   # half as wide where all ids fit
        rows = rows.withColumn("_ids", F.col("_ids").cast("array<int>"))
    rows = materialize(rows, "prompt-slots", **PACKED)
    discard(stored)
    return rows, ids


def generation_batches(encoded: DataFrame, keys=("doc_id", "pos"), batch_size: int = GENERATION_BATCH_SIZE,
                       pad_to: str = "batch", ids: Column | None = None) -> DataFrame:
    """Length-bucketed batches: prompts ordered by (length, key) are cut every ``batch_size``.

    Each batch is padded on the left to its own longest prompt (``pad_to="batch"``)
    or to the longest prompt overall (``pad_to="global"``, as the original
    does), with the pad id; the mask marks real tokens; labels are the
    input ids. Output limit per batch: ``max(128, 2 × padded length)``;
    ``global_len`` is the longest prompt overall.

    Rows are put in order once and stored so; their places follow from the
    sizes of the parts, and the lengths of batches from how many prompts have
    each length: a batch in which no length begins has its rows' own. ``ids``
    tells how the ids are made of the columns of ``encoded`` (by default its
    column ``ids``): only those columns travel.
    """
    from lisible.session import PACKED, discard, materialize
    spark, keys = encoded.sparkSession, list(keys)
    ids = F.col("ids") if ids is None else ids
    rows = encoded if hasattr(encoded, "stored_at") else materialize(encoded, "prompt-rows", **PACKED)   # the range sampler reads it as well
    sized = rows.select("*", F.size(ids).cast("bigint").alias("n_ids"))
    by = ["n_ids", *keys, F.xxhash64(ids)]   # rows with the same key and length by their ids
    # what is written is many times what travels: as many parts as a shuffle has, not merged by their size here
    ranged = sized.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    ranged = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()}), "prompt-order", **PACKED)
    if rows is not encoded:
        discard(rows)
    # a row per length and one more per partition; texts of so many different lengths grow with the square of their number
    spans = sorted(tuple(r) for r in ranged.groupBy("_part", "n_ids").agg(F.min("_mono").alias("_mono"), F.count(F.lit(1)).alias("_n"))
                   .select("_mono", "_part", "n_ids", "_n").collect())
    starts, longest, place = {}, {}, 0
    for first, part, n_ids, size in spans:
        starts.setdefault(part, (place, first))
        if n_ids is not None:
            longest[place // batch_size] = n_ids   # the last length that begins in a batch is its longest
        place += size
    shift = spark.createDataFrame([(p, *x) for p, x in starts.items()], "_part int, _start bigint, _first bigint")
    j = ranged.join(F.broadcast(shift), "_part")
    j = j.withColumn("batch_id", F.floor((F.col("_start") + F.col("_mono") - F.col("_first")) / batch_size).cast("bigint"))
    j = j.withColumn("global_len", F.lit(max((n for _, _, n, _ in spans if n is not None), default=None)).cast("bigint"))
    if pad_to == "global":
        j = j.withColumn("batch_len", F.col("global_len"))
    else:
        mixed = spark.createDataFrame(list(longest.items()), "batch_id bigint, _longest bigint")
        j = j.join(F.broadcast(mixed), "batch_id", "left").withColumn("batch_len", F.coalesce("_longest", "n_ids"))
    pad = (F.col("batch_len") - F.col("n_ids")).cast("int")
    input_ids = F.concat(F.array_repeat(F.lit(PAD_ID).cast("bigint"), pad), ids)
    mask = F.concat(F.array_repeat(F.lit(0).cast("bigint"), pad), F.array_repeat(F.lit(1).cast("bigint"), F.col("n_ids").cast("int")))
    return j.select(*keys, "batch_id", "n_ids", "batch_len", "global_len",
                    F.greatest(F.lit(GENERATION_MIN_LENGTH).cast("bigint"), 2 * F.col("batch_len")).alias("max_length"),
                    input_ids.alias("input_ids"), mask.alias("attention_mask"), input_ids.alias("labels"))


OUTPUT_COLUMNS = ("prediction", "status", "error")


class Generator:
    """``DataFrame(..., sentence, formatted_chat) -> DataFrame(..., prediction, status, error)``."""

    name = DEFAULT_GENERATOR

    def generate(self, prompts: DataFrame) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def expression(self, sentence: Column) -> Column | None:
        """A per-sentence column expression, if the generator is native."""
        return None


def rule_rewrite(sentence: Column) -> Column:
    """Stand-in rewrite: first clause (before ``;`` or `` : ``), parentheses dropped, blanks collapsed."""
    first = F.split(sentence, CLAUSE_SPLIT)[0]
    return _tidy(F.regexp_replace(first, PARENS, ""))


def _tidy(text: Column) -> Column:
    collapsed = F.regexp_replace(text, "[ \\t\\n\\r]+", " ")
    return F.regexp_replace(collapsed, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")


def _unless_empty(out: Column, sentence: Column) -> Column:
    """``out``, or the sentence if it is empty; inside lambdas, a ``when`` would compute ``out`` twice."""
    return F.coalesce(F.get(F.filter(F.array(out, sentence), lambda x: x != ""), F.lit(0)), sentence)


class RuleGenerator(Generator):
    """Deterministic rule rewrite in JVM expressions; not a language model."""

    def expression(self, sentence: Column) -> Column:
        return _unless_empty(rule_rewrite(sentence), sentence)

    def generate(self, prompts: DataFrame) -> DataFrame:
        out = rule_rewrite(F.col("sentence"))
        ok = out != ""
        return prompts.drop(*OUTPUT_COLUMNS).select(
            "*",
            F.when(ok, out).otherwise(F.col("sentence")).alias("prediction"),
            F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
            F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("empty output")).alias("error"))


class KeepGenerator(Generator):
    """Deterministic rewrite that keeps every clause: parentheses dropped, blanks collapsed."""

    name = "rule-rewrite-keep"

    def expression(self, sentence: Column) -> Column:
        return _unless_empty(_tidy(F.regexp_replace(sentence, PARENS, "")), sentence)

    def generate(self, prompts: DataFrame) -> DataFrame:
        return prompts.drop(*OUTPUT_COLUMNS).select(
            "*", self.expression(F.col("sentence")).alias("prediction"), F.lit("ok").alias("status"),
            F.lit(None).cast("string").alias("error"))


class FileExchangeGenerator(Generator):
    """A model service outside Spark: requests out as JSON lines, responses joined back.

    ``write_requests`` writes ``(keys, model, messages, max_tokens)``; the
    service writes ``(keys, prediction)`` (or ``error``) files; ``generate``
    joins them on the keys, never on row order. Missing responses come
    back with ``status='pending'``.
    """

    def __init__(self, requests_path: str, responses_path: str, model: str = DEFAULT_GENERATOR,
                 keys: tuple[str, ...] = ("doc_id", "pos")):
        self.requests_path, self.responses_path, self.model, self.keys = requests_path, responses_path, model, list(keys)

    def write_requests(self, prompts: DataFrame) -> None:
        (prompts.select(*self.keys, F.lit(self.model).alias("model"), F.col("chat").alias("messages"),
                        (2 * F.length("formatted_chat")).alias("max_tokens"))
         .write.mode("overwrite").json(self.requests_path))

    def generate(self, prompts: DataFrame) -> DataFrame:
        prompts = prompts.drop(*OUTPUT_COLUMNS)
        schema = T.StructType([prompts.schema[k] for k in self.keys]).add("prediction", "string").add("error", "string")
        resp = prompts.sparkSession.read.schema(schema).json(self.responses_path)
        j = prompts.join(resp, self.keys, "left")
        status = (F.when(F.col("error").isNotNull(), F.lit("error"))
                  .when(F.col("prediction").isNull(), F.lit("pending")).otherwise(F.lit("ok")))
        return j.select(*prompts.columns, F.coalesce(F.trim("prediction"), F.col("sentence")).alias("prediction"),
                        status.alias("status"), "error")


class PandasGenerator(Generator):
    """A model opened once per Python worker; prompts travel in Arrow batches.

    ``generate_batch(model, list[str]) -> list[str]``. When a batch fails its
    rows are tried one by one, so only the rows at fault are marked ``error``
    (with the whole message) and keep their original sentence. All columns of
    the prompts come back, whatever the keys are called.
    """

    def __init__(self, load: Callable[[], object], generate_batch: Callable[[object, list], list]):
        self._load, self._gen = load, generate_batch

    def generate(self, prompts: DataFrame) -> DataFrame:
        load, gen = self._load, self._gen
        base = prompts.drop(*OUTPUT_COLUMNS)
        carried = [c for c in base.columns if c not in ("sentence", "formatted_chat")]
        rows = base.select(F.struct(*carried).alias("_row"), "sentence", "formatted_chat")
        schema = T.StructType(rows.schema.fields + [T.StructField(c, T.StringType()) for c in OUTPUT_COLUMNS])

        def one_by_one(model, chats, sentences):
            for chat, sentence in zip(chats, sentences):
                try:
                    yield str(gen(model, [chat])[0]).strip(), "ok", None
                except Exception as e:  # noqa: BLE001 - a failed row must not stop the job
                    yield sentence, "error", str(e)

        def run(batches: Iterator):
            import pyarrow as pa
            model = None
            for batch in batches:
                if model is None:
                    model = load()
                sentences, chats = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                try:
                    out = [(str(x).strip(), "ok", None) for x in gen(model, chats)]
                    if len(out) != len(chats):
                        raise ValueError(f"{len(out)} outputs for {len(chats)} prompts")
                except Exception:  # noqa: BLE001
                    out = list(one_by_one(model, chats, sentences))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array([o[i] for o in out], pa.string()) for i in range(3))], names=schema.names)

        done = rows.mapInArrow(run, schema)
        return done.select(*[F.col(f"_row.{c}") if c in carried else F.col(c) for c in base.columns], *OUTPUT_COLUMNS)


DEFAULT_GENERATOR_IMPL = RuleGenerator()

#: Resolved model id → what runs it. A registry entry without one here is an unknown model.
IMPLEMENTATIONS: dict[str, Generator] = {
    DEFAULT_GENERATOR + ":v1": DEFAULT_GENERATOR_IMPL,
    "rule-rewrite-keep:v1": KeepGenerator(),
}


PARAGRAPH_BREAK = "\n{2,}"


def simplify_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       generator: Generator = DEFAULT_GENERATOR_IMPL, keep_paragraphs: bool = False,
                       carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, carry..., simplified)``: every sentence rewritten, joined with single spaces in order.

    A native generator runs inside the row (no explode, no shuffle). Other
    generators go through the sentence table and an ordered regroup per
    document. ``keep_paragraphs=True`` (native generators) keeps blank-line
    paragraph breaks instead of running all sentences together.
    """
    expr = generator.expression(F.lit("x"))
    if expr is not None:
        if keep_paragraphs:
            paras = F.filter(F.split(F.col(text), PARAGRAPH_BREAK), lambda p: F.regexp_replace(p, "[ \\t\\n\\r]", "") != "")
            joined = F.transform(paras, lambda p: F.array_join(F.transform(sentence_array(p), generator.expression), " "))
            return docs.select(key, *carry, F.array_join(joined, "\n\n").alias("simplified"))
        parts = F.transform(sentence_array(F.col(text)), generator.expression)
        return docs.select(key, *carry, F.array_join(parts, " ").alias("simplified"))
    from lisible.operators.sentences import sentences
    sents = sentences(docs.select(key, text), key=key, text=text)
    prompts = simplification_prompts(sentence_levels(sents))
    gen = generator.generate(prompts)
    grouped = gen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "prediction"))).alias("_p"))
    return docs.select(key, *carry).join(grouped, key, "left").select(
        key, *carry, F.coalesce(F.array_join(F.transform("_p", lambda x: x["prediction"]), " "), F.lit("")).alias("simplified"))


def generator_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(model, fine_tuned_model, registry_order)``: built-in generators, or a folder of JSON documents."""
    if path:
        from lisible.sources.tables import model_registry
        return model_registry(spark, path).select("model", "fine_tuned_model", F.col("registry_order").cast("bigint"))
    return spark.createDataFrame(GENERATORS, "model string, fine_tuned_model string, registry_order bigint")


def default_model(registry: DataFrame | None = None) -> Column:
    """Resolved id of the first registry entry: a constant for the built-in registry, else a scalar subquery."""
    if registry is None:
        return F.lit(min(GENERATORS, key=lambda g: g[2])[1])
    return registry.select(F.min_by("fine_tuned_model", "registry_order")).scalar()


def resolve_model(requests: DataFrame, registry: DataFrame, default: Column | None = None,
                  implementations: dict[str, Generator] | None = None) -> DataFrame:
    """Requested base model → resolved id; none → first registry entry; unknown → ``unknown_model``.

    A registry entry that nothing implements is unknown too. Models that many
    requests share are salted (``salted_join``), the registry has one row per model.
    """
    default = default if default is not None else default_model(registry)
    names = sorted(implementations if implementations is not None else IMPLEMENTATIONS)
    reg = registry.select("model", F.when(F.col("fine_tuned_model").isin(names), F.col("fine_tuned_model")).alias("_ft"))
    j = salted_join(requests, reg, ["model"], "left")
    resolved = F.when(F.col("model").isNull(), default).otherwise(F.col("_ft"))
    status = F.when(resolved.isNull(), F.lit("unknown_model")).otherwise(F.lit("ok"))
    return j.select(*requests.columns, resolved.alias("resolved_model"), status.alias("model_status"))


def request_status(requests: DataFrame, registry: DataFrame, articles: DataFrame, default: Column | None = None) -> DataFrame:
    """Every request once, with ``resolved_model`` and ``reason``: null if it is served, else why it is refused.

    ``invalid_ordinal``: missing or negative; ``unknown_model``: not in the
    registry, or nothing implements it; ``unknown_article``: not in the catalog.
    """
    resolved = resolve_model(requests, registry, default=default)
    known = articles.select("article_id").distinct().withColumn("_known", F.lit(True))
    j = salted_join(resolved, known, ["article_id"], "left", salt_from=["seq"])
    reason = (F.when(F.col("n").isNull() | (F.col("n") < 0), "invalid_ordinal").when(F.col("model_status") != "ok", F.col("model_status"))
              .when(F.col("_known").isNull(), "unknown_article"))
    return j.select(*requests.columns, "resolved_model", reason.alias("reason"))


def stored_ordinals(versions: DataFrame) -> DataFrame:
    """``simplification_id``: 0-based position of each stored version inside its article."""
    return ordinal_within(versions, "article_id", "seq", name="simplification_id")


def pending_simplifications(requests: DataFrame, stored: DataFrame, default_model: Column, counted: bool = False) -> DataFrame:
    """Missing ordinals of every article, as rows to create; requests are served in the order of ``seq``.

    A request for ordinal ``n`` of an article that has ``count`` versions makes
    versions ``count`` to ``n``: the first with its own (resolved) model, the
    rest with the default, and a later request finds them stored. So only
    requests that ask for more than all before them make any: among equal
    ``n`` the first to arrive, and the ordinals from the highest ``n`` before it
    on. Requests are reduced to one per (article, n) before anything is
    expanded, and every missing ordinal is expanded once. Negative or null
    ``n`` is rejected. ``stored`` has a row per version, or with ``counted`` a
    row (article_id, _count) per article.
    """
    first = requests.where(F.col("n") >= 0).groupBy("article_id", F.col("n").cast("bigint").alias("n")).agg(
        F.min(F.struct("seq", "resolved_model")).alias("_r"))
    counts = stored if counted else stored.groupBy("article_id").agg(F.count(F.lit(1)).alias("_count"))
    r = first.join(counts, "article_id", "left").select(
        "article_id", "n", F.col("_r.seq").alias("seq"), F.col("_r.resolved_model").alias("resolved_model"),
        F.coalesce(F.col("_count"), F.lit(0)).cast("bigint").alias("_count"))
    earlier = Window.partitionBy("article_id").orderBy("seq", "n").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_from", F.greatest(F.col("_count"), F.coalesce(F.max("n").over(earlier) + 1, F.lit(0).cast("bigint"))))
    need = r.where(F.col("n") >= F.col("_from")).select(
        "article_id", "resolved_model", "_from", F.explode(F.sequence("_from", "n")).alias("simplification_id"))
    model = F.when(F.col("simplification_id") == F.col("_from"), F.col("resolved_model")).otherwise(default_model)
    return need.select("article_id", "simplification_id", model.alias("model"))


def versions_gain(versions: DataFrame, articles: DataFrame) -> DataFrame:
    """Dominant level of the original and of each version, and the rank difference."""
    before = articles.select("article_id", dominant_level().alias("level_before"))
    after = versions.select("article_id", "simplification_id", dominant_level().alias("level_after"))
    j = salted_join(after, before, ["article_id"], salt_from=["simplification_id"])
    return j.select("article_id", "simplification_id", "level_before", "level_after",
                    (level_rank(F.col("level_before")) - level_rank(F.col("level_after"))).cast("bigint").alias("gain"))


def simplify_and_rescore(todo: DataFrame, articles: DataFrame, scorer=None,
                         implementations: dict[str, Generator] | None = None) -> DataFrame:
    """New versions for ``todo(article_id, simplification_id, model)``, made from the original text by their model.

    One join brings each row its article's title and text (``todo`` has one row
    per version, so no article is hot beyond its versions); they travel along.
    All native generators run as one expression chosen by the row's model,
    others on the rows of their model. Rows whose model nothing implements
    make no version; versions without a scorable sentence are left out.
    """
    from lisible.operators.scoring import DEFAULT_SCORER, scored_documents
    runs = implementations if implementations is not None else IMPLEMENTATIONS
    native = {m: g for m, g in runs.items() if g.expression(F.lit("x")) is not None}
    rows = todo.join(articles.select("article_id", "title", "text"), "article_id").select(
        F.struct("article_id", "simplification_id").alias("k"), "model", "title", "text")
    carry = ("model", "title")
    out = None
    if native:
        parts = sentence_array(F.col("text"))
        text = None
        for m, g in sorted(native.items()):
            rewritten = F.array_join(F.transform(parts, g.expression), " ")
            text = F.when(F.col("model") == m, rewritten) if text is None else text.when(F.col("model") == m, rewritten)
        out = rows.where(F.col("model").isin(sorted(native))).select("k", *carry, text.alias("simplified"))
    for m, g in runs.items():
        if m not in native:
            own = simplify_documents(rows.where(F.col("model") == m), key="k", generator=g, carry=carry)
            out = own if out is None else out.unionByName(own)
    scored = scored_documents(out.withColumnRenamed("simplified", "text"), key="k", scorer=scorer or DEFAULT_SCORER) \
        .where(F.col("n_sentences") > 0)
    return scored.select(F.col("k.article_id").alias("article_id"),
                         F.col("k.simplification_id").cast("bigint").alias("simplification_id"),
                         "model", "title", "text", *LEVELS)


# ----------------------------------------------------------------------------
# template-aware encoding: only the variable fields of a prompt are tokenized
# ----------------------------------------------------------------------------

SLOT_COLUMNS = {"level": "difficulty", "sentence": "sentence", "target": "target"}


def rendered_template() -> str:
    """The whole rendered prompt with ``{level}``, ``{sentence}``, ``{target}`` slots."""
    sys_p, sys_s = CHAT_TEMPLATE["system"]
    usr_p, usr_s = CHAT_TEMPLATE["user"]
    return CHAT_BOS + sys_p + SYSTEM_PROMPT + sys_s + usr_p + USER_TEMPLATE + usr_s + GENERATION_PROMPT


def template_parts(template: str) -> tuple[list[str], list[str]]:
    """Literal pieces (one more than slots) and slot names, in order."""
    pieces, slots, rest = [], [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        pieces.append(head)
        slots.append(name)
    pieces.append(rest)
    return pieces, slots


def with_sentence_tokens(levels: DataFrame) -> DataFrame:
    """The sentence's tokens as a column, for a table that is stored before vocabulary and encoding read it."""
    return levels.withColumn("tokens", F.regexp_extract_all(F.col(SLOT_COLUMNS["sentence"]), F.lit(TOKEN), 0))


def _slot_tokens(levels: DataFrame, slot: str) -> Column:
    if slot == "sentence" and "tokens" in levels.columns:
        return F.col("tokens")
    return F.regexp_extract_all(F.col(SLOT_COLUMNS[slot]), F.lit(TOKEN), 0)


def _boundary_safe(pieces: list[str]) -> bool:
    """Tokens never span a slot boundary when the literal sides are not letters or digits."""
    inner = pieces[1:-1]
    ends_ok = (not pieces[0] or not pieces[0][-1].isalnum()) and (not pieces[-1] or not pieces[-1][0].isalnum())
    return ends_ok and all(p and not p[0].isalnum() and not p[-1].isalnum() for p in inner)


def slots_stand_apart() -> bool:
    """Whether the prompt template is encoded by its slots alone, from the sentences' tokens."""
    return _boundary_safe(template_parts(rendered_template())[0])


def _constant_tokens(spark: SparkSession, pieces: list[str]) -> list[list[str]]:
    """Tokenize the fixed literal pieces with the same JVM pattern (a handful of short strings)."""
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pieces)], "i int, p string")
    rows = df.select("i", F.regexp_extract_all("p", F.lit(TOKEN), 0).alias("t")).collect()
    return [list(r["t"]) for r in sorted(rows, key=lambda r: r["i"])]


def template_vocabulary(levels: DataFrame) -> DataFrame:
    """Vocabulary of the rendered prompts computed from their variable fields.

    Equals ``vocabulary(simplification_prompts(levels))``: literal-piece token
    counts are added once, weighted by the number of prompts (a scalar), and
    only slot values are exploded and counted.
    """
    spark = levels.sparkSession
    pieces, slots = template_parts(rendered_template())
    if not _boundary_safe(pieces):
        return vocabulary(simplification_prompts(levels))
    with_target = _with_target(levels)
    var = with_target.select(F.explode(F.concat(*[_slot_tokens(with_target, s) for s in slots])).alias("token"))
    var_counts = var.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    const = {}
    for toks in _constant_tokens(spark, pieces):
        for t in toks:
            const[t] = const.get(t, 0) + 1
    n_prompts = levels.select(F.lit(1).alias("_one")).agg(F.count(F.lit(1))).scalar()  # scoring pruned
    const_df = spark.createDataFrame(sorted(const.items()), "token string, per_prompt bigint").select(
        "token", (F.col("per_prompt") * n_prompts).alias("n"))
    counts = var_counts.unionByName(const_df).groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")
    ranked = assign_dense_ids(counts, [F.col("n").desc(), F.col("token")], id_col="token_id", base=FIRST_VOCAB_ID, key=["n", "token"])
    return ranked.select("token", "n", "token_id")


def _with_target(levels: DataFrame) -> DataFrame:
    dim = F.broadcast(level_dim(levels.sparkSession).select(
        F.col("level").alias("difficulty"), F.col("reduced_level").alias("target")))  # fixed 10 rows
    return levels.join(dim, "difficulty", "left")


def encode_template_prompts(levels: DataFrame, vocab: DataFrame, keys=("doc_id", "pos"), late: bool = False,
                            spent: tuple = ()):
    """Token ids of every rendered prompt, splicing constant ids of the template with slot ids.

    Equals ``encode_prompts(simplification_prompts(levels), vocab)`` but
    tokenizes only the slot values (sentence, level names). A template
    whose literal pieces could grow together with a slot takes the general way.
    With ``late``: the slots' ids and the column that makes ``ids`` of them (see ``_encode_slots``, also for ``spent``).
    """
    keys = list(keys)
    pieces, slots = template_parts(rendered_template())
    if not _boundary_safe(pieces):
        whole = encode_prompts(simplification_prompts(levels), vocab, keys)
        return (whole, F.col("ids")) if late else whole
    constant = _constant_tokens(levels.sparkSession, pieces)
    wanted = sorted({t for toks in constant for t in toks})
    table = {r["token"]: r["token_id"] for r in vocab.where(F.col("token").isin(wanted)).collect()}   # the template's own tokens
    constant_ids = [[table.get(t, UNK_ID) for t in toks] for toks in constant]
    with_target = _with_target(levels)
    tokens = F.array(*[_slot_tokens(with_target, slot) for slot in slots])
    constant_ids[0] = [BOS_ID, *constant_ids[0]]
    return _encode_slots(with_target.select(*keys, tokens.alias("_slots")), vocab, keys, constant_ids, len(slots), late, spent)


def compat_predictions(generated: DataFrame) -> DataFrame:
    """Compatibility view: a failed generation shows the literal ``Error`` as its text."""
    return generated.withColumn("prediction", F.when(F.col("status") == "error", F.lit("Error"))
                                .otherwise(F.col("prediction")))


def simplify_rounds(articles: DataFrame, rounds: int, generator: Generator = DEFAULT_GENERATOR_IMPL) -> DataFrame:
    """Versions made from the *previous* version (not the original), for a fixed number of rounds.

    ``(article_id, simplification_id, text)`` with ``simplification_id`` 0 ..
    rounds-1. Each round reads the last one from a written table in the
    shared checkpoint folder, so lineage stays one round deep.
    """
    from lisible.session import materialize
    current = articles.select("article_id", "text")
    out = None
    for i in range(rounds):
        nxt = simplify_documents(current, key="article_id", generator=generator).select(
            "article_id", F.col("simplified").alias("text"))
        nxt = materialize(nxt, f"simplify-round-{i}")
        version = nxt.select("article_id", F.lit(i).cast("bigint").alias("simplification_id"), "text")
        out = version if out is None else out.unionByName(version)
        current = nxt
    return out
