"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a measure of the text (one or more columns) and a condition that
rejects. ``plan_cascade`` runs each rule over a sample of the documents, takes
its time per row as cost and its share of rejected rows as selectivity, and
orders the rules by rejections per cost, highest first. ``apply_cascade``
evaluates them in that order inside a ``CASE``: a row that one rule rejects
does not compute the measures of the later ones. The verdict is a conjunction,
so the order changes the work and never the rows.

Inputs and their results: a null or empty text has no words and is rejected;
texts are read whole; repeated rows and equal texts get equal results; a null
doc_id is kept as it is; columns other than doc_id and text are ignored by the
query; an empty table gives no rows (and the rules keep their given order).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.llm.common import SPACE, WORD, read, stored

#: Width of the windows whose repetition counts.
WINDOW = 8
#: Rows of the sample on which cost and selectivity are estimated (expected number, chosen by text hash).
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
#: Limits of the rules beyond the base; wide, so that ordinary prose passes.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MAX_SYMBOLS_PER_100_WORDS, MAX_MEAN_WORD, MAX_DUP_LINE_PERCENT, MAX_UPPER_PERCENT, MAX_EXCLAIM_PERCENT = 60, 25, 60, 70, 60


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator: computed once, not inlined into the lambdas that read them."""
    fields = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select("*", F.inline(F.array(fields)))


def text_measures(docs: DataFrame) -> DataFrame:
    """Measures that are cheap: words, lines and characters of the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = _barrier(docs, _text=text)
    df = _barrier(df, _words=F.filter(F.split("_text", SPACE, -1), lambda w: w != ""),
                  _lines=F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    return df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": (F.length("_text") - F.length(F.regexp_replace("_text", WORD, ""))).cast("bigint"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    })


def repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words that lie in a window of WINDOW words found twice or more in the text.

    Windows are compared by the 64-bit hash of their words' hashes. Only texts
    with a repeated window sort them; the words they cover follow from the
    gaps between the sorted positions of repeated windows.
    """
    df = _barrier(df, _wh=F.transform("_words", lambda w: F.xxhash64(w)))
    n_windows = F.size("_wh") - F.lit(WINDOW - 1)
    df = _barrier(df, _windows=F.when(n_windows >= 2, F.transform(
        F.sequence(F.lit(1), n_windows), lambda i: F.xxhash64(F.slice("_wh", i, F.lit(WINDOW))))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = _barrier(df, _sorted=F.when(F.col("_windows").isNotNull() & repeats, F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    # each window beside the next one in hash order; a pair with equal hashes gives both positions
    following = F.slice("_sorted", F.lit(2), F.size("_sorted"))
    pairs = F.zip_with("_sorted", following, lambda a, b: F.when(
        a["h"] == b["h"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")))
    df = _barrier(df, _at=F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: F.size(p) > 0)))))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("bigint").alias("n"), p.alias("last")),
        lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))) \
        .drop("_wh", "_windows", "_sorted", "_at")


@dataclass(frozen=True)
class Rule:
    """``measure`` is a column over ``_text`` and the cheap measures; ``rejects`` a condition on the measured value."""
    name: str
    measure: Column
    rejects: object

    def condition(self) -> Column:
        return F.coalesce(self.rejects(self.measure), F.lit(False))


def _characters(pattern: str) -> Column:
    return F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))


def default_rules() -> list[Rule]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("symbols", F.lit(100) * F.col("n_symbols") / words, lambda v: v > MAX_SYMBOLS_PER_100_WORDS),
        Rule("word_length", F.col("word_chars") / words, lambda v: v > MAX_MEAN_WORD),
        Rule("duplicate_lines", F.lit(100) * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), lambda v: v > MAX_DUP_LINE_PERCENT),
        Rule("letters", F.col("_text").rlike(r"\p{L}"), lambda v: ~v),
        Rule("upper_case", F.lit(100) * _characters(r"\p{Lu}+") / F.greatest(_characters(r"\p{L}+"), F.lit(1)), lambda v: v > MAX_UPPER_PERCENT),
        Rule("exclamations", F.lit(100) * _characters(r"!+[\x20\x09-\x0D]|!+\z") / (F.lit(2) * words), lambda v: v > MAX_EXCLAIM_PERCENT),
    ]


def plan_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds per row, share rejected), by share rejected per cost, highest first.

    The sample holds the texts whose hash falls under ``sample_rows / rows``; it
    only steers the order of evaluation.
    """
    rules = default_rules() if rules is None else rules
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    bar = int(share * 1_000_000)
    picked = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1_000_000)) < F.lit(bar))
    sample = stored(text_measures(picked).drop("_words", "_lines"), "quality-sample")
    n = sample.count()
    if n == 0:
        return [(r, 0.0, 0.0) for r in rules]

    def timed(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.sum(condition.cast("int"))).first()[0]
        return time.perf_counter() - began, int(hits or 0)

    floor = min(timed(F.length("_text") < F.lit(0))[0] for _ in range(2))
    measured = []
    for rule in rules:
        seconds, hits = timed(rule.condition())
        measured.append((rule, max(seconds - floor, 1e-4) / n, hits / n))
    return sorted(measured, key=lambda x: -x[2] / x[1])


def apply_cascade(measured: DataFrame, ordered: list[Rule]) -> DataFrame:
    """Add ``rejected_by``: the first rule in the given order that rejects, null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(rule.condition(), F.lit(rule.name)).otherwise(verdict)
    return measured.withColumn("rejected_by", verdict)


def quality(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, rejected_by (first rule in cascade order) and kept."""
    rows = docs.select("doc_id", F.col("text"))
    ordered = [r for r, _, _ in plan_cascade(rows, rules)]
    df = repeat_words(text_measures(rows))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    df = apply_cascade(df.withColumn("base_failed", failed), ordered)
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (
  SELECT k, i, list_aggregate(words[i:i+7], 'string_agg', ' ') AS win
  FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 9)),
rep AS (
  SELECT k, i FROM win WHERE (k, win) IN (SELECT (k, win) FROM win GROUP BY k, win HAVING count(*) > 1)),
cov AS (
  SELECT k, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 8)) AS j) GROUP BY k),
m AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (k)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND 100.0 * n_symbols / greatest(n_words, 1) <= 60
  AND 1.0 * word_chars / greatest(n_words, 1) <= 25
  AND 100.0 * n_dup_lines / greatest(n_lines, 1) <= 60
  AND regexp_matches(text, '\p{L}')
  AND 100.0 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) / greatest(length(text) - length(regexp_replace(text, '\p{L}', '', 'g')), 1) <= 70
  AND 100.0 * (length(text) - length(regexp_replace(text, '!+[\x20\x09-\x0D]|!+\z', '', 'g'))) / (2 * greatest(n_words, 1)) <= 60
  AS kept
FROM f
"""
