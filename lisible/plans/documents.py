"""Queries over ``documents``: sentences, scores, text articles and their read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.constants import (DESCRIPTION_LENGTH, LEVELS, OFFERED_LEVEL,
                               PROMPT_REDUCED_LEVEL, SCORER_MAX_TOKENS, TEXT_ICON,
                               TEXT_URL, TITLE_LENGTH)
from lisible.functions.levels import dominant_level, level_dim
from lisible.operators import catalog as cat
from lisible.operators import scoring, sentences as sn
from lisible.plans import sql as S
from lisible.plans.memo import memoized
from lisible.sources.tables import documents

LV = ", ".join(LEVELS)


# ----------------------------------------------------------------------------
# shared building blocks
# ----------------------------------------------------------------------------

def _sentences(spark, sf_dir) -> DataFrame:
    return sn.sentences(documents(spark, sf_dir))


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.scored_documents(documents(spark, sf_dir).select("doc_id", "text"))


@memoized
def doc_catalog(spark, sf_dir) -> DataFrame:
    return cat.text_articles(documents(spark, sf_dir))


def sql_sentences() -> str:
    return S.sentences_cte("documents")


def sql_scored_ctes() -> list[tuple[str, str]]:
    """CTEs: sents, short, scored sentences (p), doc means (doc_means)."""
    return [
        ("sents", sql_sentences()),
        ("short", f"SELECT *, {S.token_count('sentence')} AS n_tokens FROM sents"),
        ("kept", f"SELECT * FROM short WHERE n_tokens <= {SCORER_MAX_TOKENS}"),
        *S.lix_probability_ctes("kept"),
        ("doc_means", f"SELECT doc_id, count(*) AS n_sentences, "
                      + ", ".join(f"avg({lv}) AS {lv}" for lv in LEVELS) + " FROM p GROUP BY doc_id"),
    ]


def sql_catalog_ctes() -> list[tuple[str, str]]:
    return sql_scored_ctes() + [
        ("articles", "SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS article_id, d.doc_id, "
                     f"{S.lit(TEXT_URL)} AS url, {S.clip('d.text', TITLE_LENGTH)} AS title, "
                     f"{S.lit(TEXT_ICON)} AS image, {S.clip('d.text', DESCRIPTION_LENGTH)} AS description, d.text, "
                     + ", ".join(f"m.{lv}" for lv in LEVELS)
                     + " FROM documents d JOIN doc_means m ON d.doc_id = m.doc_id"),
    ]


# ----------------------------------------------------------------------------
# queries
# ----------------------------------------------------------------------------

def q_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


def q_token_counts(spark, sf_dir):
    t = sn.with_token_counts(_sentences(spark, sf_dir))
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


def q_short_sentences(spark, sf_dir):
    t = sn.short_sentences(_sentences(spark, sf_dir))
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence",
                    F.col("n_tokens").cast("bigint").alias("n_tokens"))


def q_sentence_difficulty(spark, sf_dir):
    t = scoring.sentence_difficulty(sn.short_sentences(_sentences(spark, sf_dir)))
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), *scoring.rounded_levels())


def q_sentence_level(spark, sf_dir):
    t = scoring.sentence_difficulty(sn.with_token_counts(_sentences(spark, sf_dir)))
    return t.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence",
        dominant_level().alias("difficulty"),
        F.when(F.col("n_tokens") > SCORER_MAX_TOKENS, F.lit("too_long")).otherwise(F.lit("ok")).alias("status"),
    )


def q_doc_difficulty(spark, sf_dir):
    t = scoring.sentence_difficulty(sn.short_sentences(_sentences(spark, sf_dir)))
    return scoring.doc_difficulty(t).select("doc_id", *scoring.rounded_levels())


def q_scored_articles(spark, sf_dir):
    t = cat.scorable(_scored(spark, sf_dir))
    return t.select("doc_id", F.col("n_sentences").cast("bigint").alias("n_sentences"), *scoring.rounded_levels())


def q_dominant_level(spark, sf_dir):
    t = cat.scorable(_scored(spark, sf_dir))
    return t.select("doc_id", dominant_level().alias("level"))


def q_level_percentages(spark, sf_dir):
    return cat.level_percentages(cat.scorable(_scored(spark, sf_dir)), key="doc_id")


def q_clip_text(spark, sf_dir):
    from lisible.functions.text import clip
    d = documents(spark, sf_dir)
    return d.select("doc_id", clip(F.col("text"), TITLE_LENGTH).alias("title"),
                    clip(F.col("text"), DESCRIPTION_LENGTH).alias("description"))


def q_text_articles(spark, sf_dir):
    a = doc_catalog(spark, sf_dir)
    return a.select("article_id", "doc_id", "url", "title", "image", "description", "text", *scoring.rounded_levels())


def q_article_cards(spark, sf_dir):
    return cat.article_cards(doc_catalog(spark, sf_dir))


LISTING_PAGE_SIZE = 20


def q_article_listing(spark, sf_dir):
    cards = cat.article_cards(doc_catalog(spark, sf_dir))
    return (cards.select(F.floor(F.col("article_id") / LISTING_PAGE_SIZE).cast("bigint").alias("page"),
                         "article_id", "title", "level", "minutes", "band")
            .orderBy("article_id"))


def lookup_requests(spark, sf_dir) -> DataFrame:
    """Route strings derived from every document: valid ids, ids past the end, non-numeric."""
    d = documents(spark, sf_dir).select("doc_id")
    route = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string")))
             .otherwise((F.col("doc_id") * 2).cast("string")))
    return d.select(route.alias("route"))


def q_article_by_id(spark, sf_dir):
    return cat.article_by_id(doc_catalog(spark, sf_dir), lookup_requests(spark, sf_dir))


def catalog_size(spark, sf_dir) -> DataFrame:
    """Number of articles: documents with a scorable sentence, counted where they stand (no ids, nothing written)."""
    return cat.scorable_documents(documents(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_articles"))


def q_catalog_size(spark, sf_dir):
    return catalog_size(spark, sf_dir)


def q_catalog_audit(spark, sf_dir):
    """The catalog exported, read back and audited."""
    return cat.catalog_audit(_read_back(spark, sf_dir))


def _read_back(spark, sf_dir) -> DataFrame:
    from lisible.session import materialize, scratch_path
    from lisible.sources.sinks import export_json
    from lisible.sources.tables import scan_articles
    path = scratch_path(spark, "articles-json")
    export_json(doc_catalog(spark, sf_dir), path)
    return materialize(scan_articles(spark, path), "articles-back")


def q_target_level(spark, sf_dir):
    t = cat.scorable(_scored(spark, sf_dir)).select("doc_id", dominant_level().alias("level"))
    dim = F.broadcast(level_dim(spark))  # fixed 10-row dimension
    return t.join(dim, "level").select("doc_id", "level", F.col("rank").cast("bigint").alias("rank"),
                                       "reduced_level", "offered_level")


def q_scan_articles(spark, sf_dir):
    """Text catalog exported as JSON lines and scanned back with the fixed schema."""
    back = _read_back(spark, sf_dir)
    return back.select("article_id", "url", "title", "image", "description",
                       F.length("text").cast("bigint").alias("n_chars"),
                       *[F.round(F.col(lv), 6).alias(lv) for lv in LEVELS],
                       F.col("_corrupt_record").isNotNull().alias("corrupt"))


def q_learn_abbreviations(spark, sf_dir):
    return sn.learn_abbreviations(documents(spark, sf_dir))


def q_sentences_learned(spark, sf_dir):
    """Sentences split with the abbreviations that the corpus itself teaches."""
    docs = documents(spark, sf_dir)
    t = sn.sentences_with_learned(docs, sn.learn_abbreviations(docs))
    return t.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


QUERIES = {
    "sentences": q_sentences,
    "sentences_learned": q_sentences_learned,
    "token_counts": q_token_counts,
    "short_sentences": q_short_sentences,
    "sentence_difficulty": q_sentence_difficulty,
    "sentence_level": q_sentence_level,
    "doc_difficulty": q_doc_difficulty,
    "scored_articles": q_scored_articles,
    "dominant_level": q_dominant_level,
    "level_percentages": q_level_percentages,
    "clip_text": q_clip_text,
    "text_articles": q_text_articles,
    "article_cards": q_article_cards,
    "article_listing": q_article_listing,
    "article_by_id": q_article_by_id,
    "catalog_size": q_catalog_size,
    "catalog_audit": q_catalog_audit,
    "target_level": q_target_level,
    "learn_abbreviations": q_learn_abbreviations,
    "scan_articles": q_scan_articles,
}


# ----------------------------------------------------------------------------
# oracle SQL
# ----------------------------------------------------------------------------

def _level_dim_values() -> str:
    rows = []
    numbered = [k for k in PROMPT_REDUCED_LEVEL if k not in LEVELS]
    for i, lv in enumerate(LEVELS + numbered):
        rank = i if lv in LEVELS else int(lv.replace("level", "")) - 1
        off = OFFERED_LEVEL.get(lv)
        rows.append(f"('{lv}', {rank}, '{PROMPT_REDUCED_LEVEL[lv]}', {S.lit(off) if off else 'NULL'})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(level, rank, reduced_level, offered_level)"


def _cards_select(src: str = "articles") -> str:
    m = S.reading_minutes("text")
    return (f"SELECT article_id, title, image, description, {S.dominant_level()} AS level, "
            f"{m} AS minutes, CAST({S.reading_band(m)} AS BIGINT) AS band FROM {src}")


def oracle() -> dict[str, str]:
    sc = sql_scored_ctes()
    cc = sql_catalog_ctes()
    lix = S.lix_probability_ctes("short")
    from lisible.operators.sentences import ABBREV_P1, ABBREV_THRESHOLD, ABBREV_TOKEN, LAST_WORD
    abbrev_ctes = [
        ("toks", f"SELECT unnest(regexp_extract_all(text, {S.lit(ABBREV_TOKEN)})) AS tok FROM documents"),
        ("typed", "SELECT lower(regexp_replace(tok, '[.]$', '')) AS type, CAST(tok LIKE '%.' AS INTEGER) AS with_period FROM toks"),
        ("per_type", "SELECT type, count(*) AS n, sum(with_period) AS n_period FROM typed GROUP BY type"),
        ("rate", "SELECT CAST(sum(n_period) AS DOUBLE) / sum(n) AS p0 FROM per_type"),
        ("scored", "SELECT type, n, n_period, "
                   "(-2.0 * ((n_period * ln(p0) + (n - n_period) * ln(1.0 - p0)) "
                   f"- (n_period * ln({ABBREV_P1}) + (n - n_period) * ln(1.0 - {ABBREV_P1})))) "
                   "* exp(-CAST(length(replace(type, '.', '')) AS DOUBLE)) "
                   "* CAST(length(type) - length(replace(type, '.', '')) + 1 AS DOUBLE) "
                   "* pow(CAST(length(replace(type, '.', '')) AS DOUBLE), -CAST(n - n_period AS DOUBLE)) AS score "
                   "FROM per_type, rate WHERE n_period > 0"),
    ]
    abbrev = S.with_ctes(abbrev_ctes, f"SELECT type, CAST(n AS BIGINT) AS n, CAST(n_period AS BIGINT) AS n_period, round(score, 6) AS score "
                                      f"FROM scored WHERE score >= {ABBREV_THRESHOLD}")
    learned = abbrev_ctes + [
        ("learned", f"SELECT type FROM scored WHERE score >= {ABBREV_THRESHOLD}"),
        ("sents", sql_sentences()),
        ("ended", f"SELECT *, lower(regexp_extract(sentence, {S.lit(LAST_WORD)}, 1)) IN (SELECT type FROM learned) AS open FROM sents"),
        ("started", "SELECT *, NOT coalesce(lag(open) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM ended"),
        ("numbered", "SELECT *, sum(CAST(starts AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM started"),
    ]
    pct = " UNION ALL ".join(
        f"SELECT doc_id, '{lv}' AS level, round_even({lv} * 100.0, 0) AS pct FROM doc_means" for lv in LEVELS)
    return {
        "sentences": sql_sentences(),
        "sentences_learned": S.with_ctes(learned, "SELECT doc_id, CAST(p AS BIGINT) AS pos, string_agg(sentence, ' ' ORDER BY pos) AS sentence "
                                                  "FROM numbered GROUP BY doc_id, p"),
        "token_counts": S.with_ctes([("sents", sql_sentences())],
                                    f"SELECT doc_id, pos, {S.token_count('sentence')} AS n_tokens FROM sents"),
        "short_sentences": S.with_ctes(sc[:3], "SELECT doc_id, pos, sentence, n_tokens FROM kept"),
        "sentence_difficulty": S.with_ctes(sc[:-1], f"SELECT doc_id, pos, {S.rounded_levels()} FROM p"),
        "sentence_level": S.with_ctes(sc[:2] + lix,
                                      f"SELECT doc_id, pos, sentence, {S.dominant_level()} AS difficulty, "
                                      f"CASE WHEN n_tokens > {SCORER_MAX_TOKENS} THEN 'too_long' ELSE 'ok' END AS status FROM p"),
        "doc_difficulty": S.with_ctes(sc, f"SELECT doc_id, {S.rounded_levels()} FROM doc_means"),
        "scored_articles": S.with_ctes(sc, f"SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, {S.rounded_levels()} FROM doc_means"),
        "dominant_level": S.with_ctes(sc, f"SELECT doc_id, {S.dominant_level()} AS level FROM doc_means"),
        "level_percentages": S.with_ctes(sc, pct),
        "clip_text": f"SELECT doc_id, {S.clip('text', TITLE_LENGTH)} AS title, {S.clip('text', DESCRIPTION_LENGTH)} AS description FROM documents",
        "text_articles": S.with_ctes(cc, f"SELECT article_id, doc_id, url, title, image, description, text, {S.rounded_levels()} FROM articles"),
        "article_cards": S.with_ctes(cc, _cards_select()),
        "article_listing": S.with_ctes(cc + [("cards", _cards_select())],
                                       f"SELECT CAST(floor(article_id / {LISTING_PAGE_SIZE}) AS BIGINT) AS page, "
                                       "article_id, title, level, minutes, band FROM cards ORDER BY article_id"),
        "article_by_id": S.with_ctes(cc + [
            ("req", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'x' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id * 2 AS VARCHAR) END AS route FROM documents"),
            ("req_id", "SELECT route, coalesce(TRY_CAST(route AS BIGINT), -1) AS article_id FROM req")],
            "SELECT r.route, r.article_id, a.title IS NOT NULL AS found, a.title, a.url "
            "FROM req_id r LEFT JOIN articles a ON r.article_id = a.article_id"),
        "catalog_size": S.with_ctes(cc, "SELECT count(*) AS n_articles FROM articles"),
        "catalog_audit": S.with_ctes(cc + [
            ("dup", f"SELECT count(*) AS duplicate_urls FROM (SELECT url FROM articles WHERE url <> {S.lit(TEXT_URL)} GROUP BY url HAVING count(*) > 1) x")],
            "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT article_id) AS BIGINT) AS n_ids, "
            "CAST(min(article_id) AS BIGINT) AS min_id, CAST(max(article_id) AS BIGINT) AS max_id, "
            "(count(DISTINCT article_id) = count(*) AND coalesce(max(article_id) - min(article_id) + 1, 0) = count(*)) AS ids_dense, "
            "CAST(coalesce(sum(CAST(title IS NULL AS INTEGER)), 0) AS BIGINT) AS null_titles, "
            "CAST(coalesce(sum(CAST(text IS NULL AS INTEGER)), 0) AS BIGINT) AS null_texts, "
            f"CAST(coalesce(sum(CAST(abs({' + '.join(LEVELS)} - 1.0) > 1e-6 AS INTEGER)), 0) AS BIGINT) AS bad_probability_sums, "
            "CAST((SELECT duplicate_urls FROM dup) AS BIGINT) AS duplicate_urls, CAST(0 AS BIGINT) AS corrupt_rows FROM articles"),
        "target_level": S.with_ctes(sc + [("dim", _level_dim_values()),
                                          ("lv", f"SELECT doc_id, {S.dominant_level()} AS level FROM doc_means")],
                                    "SELECT lv.doc_id, lv.level, CAST(dim.rank AS BIGINT) AS rank, dim.reduced_level, dim.offered_level "
                                    "FROM lv JOIN dim ON lv.level = dim.level"),
        "learn_abbreviations": abbrev,
        "scan_articles": S.with_ctes(cc, "SELECT article_id, url, title, image, description, CAST(length(text) AS BIGINT) AS n_chars, "
                                         + ", ".join(f"round(round({lv}, 10), 6) AS {lv}" for lv in LEVELS)
                                         + ", false AS corrupt FROM articles"),
    }
