"""Personal data: base patterns, and terms that reveal protected entities by corpus co-occurrence.

The base finds emails, IPv4 addresses, payment cards (Luhn) and phone numbers
by fixed patterns. Every distinct base value is a protected entity ``e``. A
word ``t`` within ``NEAR`` words of an occurrence of ``e``, on its line or the
lines next to it, co-occurs with it. With document frequencies over the whole
corpus of ``N`` documents, ``P(e) = df(e) / N`` and the chance of ``e`` for one
who sees ``t`` is ``P(e | t) = (df(t, e) + P(e)) / (df(t) + 1)``, smoothed by one
document that knows nothing but the base rate, so that one meeting is weaker
evidence than ten. The disclosure of ``e`` by ``t`` is the information that
``t`` gives about ``e`` over the most that anything can give,
``log(P(e | t) / P(e)) / log(1 / P(e))``. Wherever a term whose disclosure
reaches ``REMOVE_AT`` stands in a document that holds the entity, it is
removed; from ``GENERALISE_AT`` on it is replaced by a general form of its
shape. Entities of a single document are judged like all others: a word found
nowhere else leads to them, a word that many documents hold does not.

Inputs and their results: a null text is empty and has no spans; texts are
searched whole; rows with the same doc_id and equal texts get the same spans;
a null doc_id is a document like any other; columns other than doc_id and text
are left alone (``sanitise`` keeps them, whatever their names, and replaces
``text``); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.bloom import bloom_filter, bloom_positions
from lisible.llm.common import join_on_hot_key, read, stored
from lisible.llm.wordhash import PLAIN_SPACE, Counter, chunks, distinct, words

#: Kinds of the base, in the order in which spans are listed; "term" is the method's own and comes last.
KINDS = ["email", "ip", "card", "phone"]
#: Words on either side of an entity, within its line and the ones next to it, that count as co-occurring.
NEAR = 8
GENERALISE_AT, REMOVE_AT = 0.85, 0.95

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match must begin where a run of digits begins: from inside the run it would end the same way
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# a term: letters, digits and non-ASCII characters (the words of wordhash with PLAIN_SPACE)
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")


def emails(text: str):
    """Leftmost non-overlapping ``local@label(.label)+``, found from each @ outwards (linear on any text)."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, stop) in code points, by kind, then start. A match that fails its check is dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _value(kind: int, found: str) -> str:
    """One spelling for an entity however it is written."""
    if kind == 0:
        return found.lower()
    if kind == 1:
        return found
    return "".join(_DIGIT.findall(found))


def text_words(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places of the words of a text and the hashes under which ``document_frequencies`` counts them."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hashes, _ = words(data, np.array([0, len(data)]), PLAIN_SPACE)
    return [m.span() for m in _WORD.finditer(text)], hashes.view(np.int64)


def term_hash(term: str) -> int:
    return int(text_words(term)[1][0])


def _open_words(text: str, spans) -> list[tuple[int, int, int, int]]:
    """(number, start, stop, hash) of the words of two characters or more that no span covers."""
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out = []
    for number, ((s, e), h) in enumerate(zip(*text_words(text))):
        i = bisect_left(covered, [e]) - 1  # the last covered stretch that begins before e
        if e - s >= 2 and not (i >= 0 and covered[i][1] > s):
            out.append((number, s, e, int(h)))
    return out


def near_terms(text: str, spans) -> set[tuple[str, int]]:
    """(entity, term hash) of the words within NEAR words of a span, on its line or a line next to it."""
    places = [m.span() for m in _WORD.finditer(text)]
    starts, stops = [s for s, _ in places], [e for _, e in places]
    open_ = {number: h for number, _, _, h in _open_words(text, spans)}
    out = set()
    for kind, a, b in spans:
        entity = f"{KINDS[kind]}:{_value(kind, text[a:b])}"
        above = text.rfind("\n", 0, max(0, text.rfind("\n", 0, a))) + 1
        below = text.find("\n", b)
        below = len(text) if below < 0 else text.find("\n", below + 1)
        below = len(text) if below < 0 else below
        first, last = bisect_left(stops, a + 1), bisect_left(starts, b)  # words before and after the span
        for number in (*range(max(0, first - NEAR), first), *range(last, min(len(places), last + NEAR))):
            if number in open_ and above <= starts[number] and stops[number] <= below:
                out.add((entity, open_[number]))
    return out


FOUND = ("doc_id bigint, text_hash binary, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, "
         "body string, entities array<string>, words array<bigint>, near array<struct<entity:string,term:bigint>>")


def find_base(docs: DataFrame) -> DataFrame:
    """One row per document: counts and spans of the base; where it has any, the text, its entities, its words and those near."""
    def run(batches):
        names = [c.split()[0] for c in FOUND.split(", ")]
        near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.int64())]))
        kinds = {"text_hash": pa.binary(), "base": pa.string(), "base_sha256": pa.string(), "body": pa.string(), "entities": pa.list_(pa.string()),
                 "words": pa.list_(pa.int64()), "near": near}
        for batch in batches:
            cols = {name: [] for name in names[1:]}
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                for k, kind in enumerate(KINDS):
                    cols[f"n_{kind}"].append(sum(s[0] == k for s in spans))
                joined = spans_text((KINDS[k], a, b) for k, a, b in spans)
                cols["base"].append(joined)
                cols["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                cols["text_hash"].append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16] if spans else None)
                cols["body"].append(text if spans else None)
                cols["entities"].append(sorted({f"{KINDS[k]}:{_value(k, text[a:b])}" for k, a, b in spans}))
                cols["words"].append(sorted({h for _, _, _, h in _open_words(text, spans)}) if spans else [])
                cols["near"].append([{"entity": e, "term": t} for e, t in sorted(near_terms(text, spans))] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items())], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_hash, df): documents that hold each of ``terms`` (distinct hashes), over all documents and whole texts.

    A Bloom filter of fixed size keeps the other words in their tasks; distinct
    words of each text are counted within the task first, then summed.
    """
    bloom = bloom_filter(terms.select(F.col("term").alias("h")))
    bits = len(bloom) * 64
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        filled, counter = shared.value, Counter(1)

        def holds(at):
            return (filled[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

        def block():
            keys, n = counter.take()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[:, 0])], ["term_hash", "n"])

        for batch in batches:
            for _, _, hashes, counts in chunks(batch.column(0), space=PLAIN_SPACE):
                owner = np.repeat(np.arange(len(counts)), counts)
                low, high = bloom_positions(hashes, bits)
                kept = holds(low) & holds(high)
                values, _ = distinct(hashes[kept], np.bincount(owner[kept], minlength=len(counts)))
                counter.add(values, np.ones((len(values), 1), np.int64))
                if counter.full():
                    yield block()
        yield block()

    words_ = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term_hash bigint, n bigint")
    return words_.groupBy("term_hash").agg(F.sum("n").alias("df"))


def disclosure(n_docs, df_entity, df_term, df_both):
    """Columns or numbers: the part of the entity's information that the term gives."""
    log = np.log if isinstance(n_docs, (int, float)) and not isinstance(df_entity, Column) else F.log
    rate = df_entity / n_docs
    return log((df_both + rate) / ((df_term + 1) * rate)) / log(1 / rate)


def revealing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, d): the pairs whose disclosure reaches GENERALISE_AT; ``found`` is the stored ``find_base``."""
    n_docs = found.count()
    # a document counts once per pair and per entity; sums are made in the tasks first, so no entity or term gathers
    pairs = stored(found.select(F.explode("near").alias("x")).groupBy(F.col("x.entity").alias("entity"), F.col("x.term").alias("term"))
                   .agg(F.count(F.lit(1)).alias("df_both")), "pii-pairs")
    total = pairs.count()
    per_entity = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    per_entity = per_entity.join(pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n_pairs")), "entity")
    terms = stored(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_pairs")), "pii-words")
    per_term = terms.join(document_frequencies(docs, terms).withColumnRenamed("term_hash", "term"), "term")
    df = join_on_hot_key(pairs, per_entity, ["entity"], "n_pairs", total).drop("n_pairs")
    df = join_on_hot_key(df, per_term, ["term"], "n_pairs", total).drop("n_pairs")
    # the only document with an entity of all documents says nothing: its rate is one
    d = F.when(F.col("df_entity") < n_docs, disclosure(F.lit(float(n_docs)), F.col("df_entity"), F.greatest("df", "df_both"), F.col("df_both")))
    return df.withColumn("d", d).where(F.col("d") >= GENERALISE_AT).select("entity", "term", "d")


def _mark_terms(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, terms) of rows (doc_id, text_hash, body, told array<struct<term, d>>): every place of a told term."""
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("action", pa.string())]))
        for batch in batches:
            out = []
            for text, told in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                worst = {t["term"]: t["d"] for t in told}
                out.append([{"start": s, "stop": e, "action": "remove" if worst[h] >= REMOVE_AT else "generalise"}
                            for _, s, e, h in _open_words(text, base_spans(text)) if h in worst])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "text_hash", "terms"])

    return rows.select("doc_id", "text_hash", "body", "told").mapInArrow(
        run, "doc_id bigint, text_hash binary, terms array<struct<start:int,stop:int,action:string>>")


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, ``spans`` (all, as text) and ``terms`` (the method's own spans).

    ``terms`` is array<struct<start, stop, action>>, action ``generalise`` or ``remove``.
    """
    found = stored(find_base(docs), "pii-base")
    revealing = stored(revealing_terms(docs, found), "pii-terms")
    # a document and text once; its words meet what they reveal, and only the document's own entities count
    holders = stored(found.where("body is not null").groupBy("doc_id", "text_hash").agg(
        F.min("body").alias("body"), F.first("entities").alias("entities"), F.first("words").alias("words")), "pii-holders")
    held = holders.select("doc_id", "text_hash", "entities", F.explode("words").alias("term"))
    # a term can reveal hardly more entities than stand together in a document
    per_term = revealing.groupBy("term").agg(F.collect_list(F.struct("entity", "d")).alias("reveals"))
    per_term = stored(per_term.join(held.groupBy("term").agg(F.count(F.lit(1)).alias("n_held")), "term"), "pii-reveals")
    told = join_on_hot_key(held, per_term, ["term"], "n_held", held.count()).where("reveals is not null")
    d = F.array_max(F.transform(F.filter("reveals", lambda r: F.array_contains("entities", r["entity"])), lambda r: r["d"]))
    told = told.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "term", d.alias("d")).where("d is not null") \
        .groupBy("_doc", "_hash").agg(F.collect_list(F.struct("term", "d")).alias("told"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["_doc"]) & (a["text_hash"] == b["_hash"])
    marked = _mark_terms(holders.join(told, same(holders, told))).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "terms")
    rows = found.drop("body", "entities", "words", "near")
    out = rows.join(marked, same(rows, marked), "left").drop("_doc", "_hash")
    empty = F.array().cast("array<struct<start:int,stop:int,action:string>>")
    out = out.withColumn("terms", F.coalesce("terms", empty))
    listed = F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["stop"].cast("string")))
    return out.withColumn("spans", F.array_join(F.filter(F.concat(F.array("base"), listed), lambda s: s != ""), ","))


def redacted(text: str, terms: list) -> str:
    """The text with base spans replaced by their kind, terms generalised or removed; overlaps are merged."""
    marks = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base_spans(text)]
    for t in terms:
        word = text[t["start"]:t["stop"]]
        general = "[NUMBER]" if _DIGIT.search(word) else "[NAME]" if word[:1].isupper() else "[TERM]"
        marks.append((t["start"], t["stop"], general if t["action"] == "generalise" else ""))
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if b <= at:
            continue
        out.append(text[at:max(a, at)])
        if a >= at:
            out.append(mark)
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """The same rows and columns; in ``text`` personal data is masked, revealing terms generalised or removed.

    Null texts stay null. Texts without a digit and without an @ hold no base
    span and stay where they are; the others meet the table of term spans, and
    their base spans are found again there.
    """
    spans = find_spans(docs).where(F.size("terms") > 0).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.first("terms").alias("t"))
    text = F.col("text").cast("string")
    maybe = F.coalesce(text.rlike("[@0-9]"), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.where(maybe).select(row, F.col("doc_id").cast("bigint").alias("id"), F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("own"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("h")), "left").select("row", "t")

    @F.pandas_udf("string")
    def rewrite(text, terms):
        return text.combine(terms, lambda x, t: None if x is None else redacted(x, [] if t is None else list(t)))

    done = joined.select(*[(rewrite(F.col("row.text").cast("string"), F.col("t")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    kept = docs.where(~maybe).select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(done)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
