"""Queries of the trained sentence splitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.functions.text import SENT_END
from lisible.operators import boundaries as B
from lisible.plans import sql as S
from lisible.plans.memo import memoized
from lisible.session import materialize
from lisible.sources.tables import documents


@memoized
def places(spark, sf_dir) -> DataFrame:
    return materialize(B.candidates(documents(spark, sf_dir)), "boundary-places")


def q_sentence_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its decision and the reason."""
    at = places(spark, sf_dir)
    told = B.boundaries(at, B.learn_boundaries(documents(spark, sf_dir), at))
    return told.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "last", "next", "boundary", "reason")


def q_sentences_trained(spark, sf_dir):
    docs, at = documents(spark, sf_dir), places(spark, sf_dir)
    return B.sentences_by(docs, at, B.learn_boundaries(docs, at)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


QUERIES = {
    "sentence_boundaries": q_sentence_boundaries,
    "sentences_trained": q_sentences_trained,
}


def _type(word: str) -> str:
    return f"CASE WHEN regexp_matches({word}, '^[0-9]+$') THEN '##' ELSE lower({word}) END"


def _case(word: str) -> str:
    return f"CASE WHEN regexp_matches({word}, '^\\p{{Lu}}') THEN 'U' WHEN regexp_matches({word}, '^\\p{{Ll}}') THEN 'l' ELSE '-' END"


def _likelihood(a: str, b: str, ab: str, n: str) -> str:
    rest = f"greatest({n} - {a}, 1)"

    def fit(k, of, p):
        term = lambda x, q: f"CASE WHEN {x} > 0 THEN ({x}) * ln({q}) ELSE 0.0 END"
        return f"({term(k, p)} + {term(f'({of}) - ({k})', f'1.0 - {p}')})"
    p, p1, p2 = f"(CAST({b} AS DOUBLE) / {n})", f"(CAST({ab} AS DOUBLE) / {a})", f"(CAST({b} - {ab} AS DOUBLE) / {rest})"
    return f"(-2.0 * ({fit(ab, a, p)} + {fit(f'({b} - {ab})', rest, p)} - {fit(ab, a, p1)} - {fit(f'({b} - {ab})', rest, p2)}))"


def ctes() -> list[tuple[str, str]]:
    marked = f"regexp_replace(replace(text, {S.ESCAPE_SQL}, {S.ESCAPED_SQL}), {S.lit(SENT_END)}, '\\1' || {S.MARK_SQL}, 'g')"
    segs = (f"list_filter(list_transform(string_split({marked}, {S.MARK_SQL}), "
            f"lambda s: replace({S.strip_ws('s')}, {S.ESCAPED_SQL}, {S.ESCAPE_SQL})), lambda s: s <> '')")
    last = lambda g: f"regexp_extract(seg, {S.lit(B.LAST)}, {g})"
    token = f"regexp_extract_all(seg, {S.lit(B.WORD_TOKEN + '[.]?')})"
    word = "regexp_replace(token, '[.]$', '')"
    letters = "CAST(length(replace(type, '.', '')) AS DOUBLE)"
    fit = lambda p: f"(n_period * ln({p}) + (n - n_period) * ln(1.0 - {p}))"
    return [
        ("seg_list", f"SELECT doc_id, {segs} AS segs FROM documents"),
        ("seg", "SELECT doc_id, i - 1 AS pos, segs[i] AS seg, segs[i + 1] AS following FROM (SELECT *, generate_subscripts(segs, 1) AS i FROM seg_list) x"),
        ("raw", f"SELECT doc_id, pos, {last(1)} AS l, {last(2)} AS m, regexp_extract(following, {S.lit(B.FIRST)}, 1) AS f FROM seg WHERE following IS NOT NULL"),
        ("places", f"SELECT doc_id, pos, {_type('l')} AS last, CASE WHEN m = '.' THEN 'period' WHEN regexp_matches(m, '[!?]') THEN 'mark' ELSE 'ellipsis' END AS mark, "
                   f"{_type('f')} AS next, {_case('f')} AS next_case FROM raw"),
        ("tokens", f"SELECT k, t[k] AS token FROM (SELECT t, generate_subscripts(t, 1) AS k FROM (SELECT {token} AS t FROM seg) x) y"),
        ("types", "SELECT type, count(*) AS n, sum(CAST(token LIKE '%.' AS BIGINT)) AS n_period, sum(CAST(k > 1 AND c = 'l' AS BIGINT)) AS lower_in, "
                  f"sum(CAST(k > 1 AND c = 'U' AS BIGINT)) AS upper_in FROM (SELECT k, token, {_type(word)} AS type, {_case(word)} AS c FROM tokens) x GROUP BY type"),
        ("totals", "SELECT CAST(sum(n) AS BIGINT) AS words, least(greatest(CAST(sum(n_period) AS DOUBLE) / sum(n), 1e-9), 1 - 1e-9) AS rate FROM types"),
        ("short", f"SELECT type FROM types, totals WHERE n_period > 0 AND regexp_matches(type, '\\p{{L}}') AND "
                  f"-2.0 * ({fit('rate')} - {fit(str(B.ABBREVIATION_RATE))}) * exp(-{letters}) * (length(type) - {letters} + 1) "
                  f"* pow({letters}, -CAST(n - n_period AS DOUBLE)) >= {B.ABBREVIATION_SCORE}"),
        ("pairs", "SELECT last, mark, next, next_case, count(*) AS times FROM places GROUP BY ALL"),
        ("first", "SELECT *, mark = 'mark' OR mark = 'period' AND NOT abbreviation AS sure FROM (SELECT *, last IN (SELECT type FROM short) AS abbreviation FROM pairs) x"),
        ("sure_count", "SELECT CAST(sum(times) AS BIGINT) AS sures FROM first WHERE sure"),
        ("after", "SELECT next, " + ", ".join(
            f"CAST(coalesce(sum(times) FILTER ({c}), 0) AS BIGINT) AS {n}" for n, c in (
                ("after", "sure"), ("lower_first", "sure AND next_case = 'l'"), ("upper_first", "sure AND next_case = 'U'"),
                ("lower_more", "NOT sure AND next_case = 'l'"), ("upper_more", "NOT sure AND next_case = 'U'"))) + " FROM first GROUP BY next"),
        ("evidence", "SELECT next, n AS next_n, after > 0 AND after * words > n * sures AND regexp_matches(next, '^\\p{L}') AND "
                     f"CASE WHEN after > 0 THEN {_likelihood('sures', 'n', 'after', 'words')} >= {B.STARTER_LIKELIHOOD} ELSE false END AS starter, "
                     "lower_in + lower_more + lower_first > 0 AND upper_in + upper_more = 0 AS upper_tells, "
                     "upper_in + upper_more + upper_first > 0 OR lower_first = 0 AS lower_tells, lower_in + lower_more + lower_first > 0 AS seen_lower "
                     "FROM after JOIN types ON type = next, totals, sure_count"),
        ("by_pair", "SELECT last, next, CAST(sum(times) AS BIGINT) AS together FROM first WHERE mark = 'period' GROUP BY last, next"),
        ("full_pairs", "SELECT f.*, e.* EXCLUDE (next), t.n_period AS last_n, b.together, words, regexp_matches(f.last, '^\\p{L}$') AS initial, "
                       "coalesce(f.next_case = 'U' AND upper_tells, false) AS begins, coalesce(f.next_case = 'l' AND lower_tells, false) AS goes_on "
                       "FROM first f LEFT JOIN evidence e ON e.next = f.next LEFT JOIN types t ON t.type = f.last "
                       "LEFT JOIN by_pair b ON b.last = f.last AND b.next = f.next, totals"),
        ("decisions", "SELECT last, mark, next, next_case, CASE WHEN mark = 'mark' THEN 'mark' "
                      "WHEN mark = 'ellipsis' THEN CASE WHEN begins OR next_case = 'U' AND NOT goes_on THEN 'ellipsis_end' ELSE 'ellipsis' END "
                      "WHEN (abbreviation OR initial OR last = '##') AND NOT starter AND together * words > last_n * next_n "
                      f"AND {_likelihood('last_n', 'next_n', 'together', 'words')} >= {B.COLLOCATION_LIKELIHOOD} THEN 'collocation' "
                      "WHEN abbreviation THEN CASE WHEN begins THEN 'abbreviation_end' WHEN next_case = 'U' AND starter THEN 'abbreviation_starter' ELSE 'abbreviation' END "
                      "WHEN initial AND goes_on THEN 'initial' "
                      "WHEN initial AND next_case = 'U' AND NOT begins AND NOT coalesce(seen_lower, false) THEN 'initial_name' "
                      "WHEN last = '##' AND goes_on THEN 'ordinal' ELSE 'period' END AS reason FROM full_pairs"),
        ("told", f"SELECT doc_id, pos, last, next, reason NOT IN ({', '.join(map(S.lit, B.NO_BOUNDARY))}) AS boundary, reason "
                 "FROM places JOIN decisions USING (last, mark, next, next_case)"),
    ]


def oracle() -> dict[str, str]:
    return {
        "sentence_boundaries": S.with_ctes(ctes(), "SELECT doc_id, pos, last, next, boundary, reason FROM told"),
        "sentences_trained": S.with_ctes(ctes() + [
            ("started", "SELECT seg.doc_id, seg.pos, seg, coalesce(lag(boundary) OVER (PARTITION BY seg.doc_id ORDER BY seg.pos), true) AS starts "
                        "FROM seg LEFT JOIN told ON told.doc_id = seg.doc_id AND told.pos = seg.pos"),
            ("numbered", "SELECT *, sum(CAST(starts AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM started")],
            "SELECT doc_id, CAST(p AS BIGINT) AS pos, string_agg(seg, ' ' ORDER BY pos) AS sentence FROM numbered GROUP BY doc_id, p"),
    }
