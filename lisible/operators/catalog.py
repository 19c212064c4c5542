"""Article catalog jobs: dense ids, text articles, cards, lookups, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lisible.constants import (DESCRIPTION_LENGTH, LEVELS, TEXT_ICON, TEXT_URL,
                               TITLE_LENGTH)
from lisible.functions.levels import dominant_level, reading_band, reading_minutes
from lisible.functions.text import clip
from lisible.operators.scoring import DEFAULT_SCORER, Scorer, scored_documents


def assign_dense_ids(df: DataFrame, order_by, id_col: str = "article_id",
                     base: int | DataFrame = 0, partitions: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Dense 0-based ids in ``order_by`` order, offset by ``base``, without a global window.

    ``order_by`` is a column name or a list of names/Columns; ``key`` names the
    columns they are made of (by default the names in ``order_by``). The input
    is written once (so neither the range sampler nor the join below
    recomputes the upstream plan); only its key columns are range-partitioned
    and sorted. Partition id and position of the keys are written as a narrow
    table in the shared checkpoint folder, which cuts the lineage (a retried
    task reproduces the same positions: the shuffle output and the sort on
    the key are fixed). Per-partition counts (one row per partition, bounded
    by the partition count) become running offsets, joined back as a small
    local table, and the ids meet the payload in one join on the key. Rows
    that share a key (repeated rows) get an id each.
    ``base`` may be an int or a one-row DataFrame holding the next free id
    (committed maximum plus one).
    """
    from lisible.session import materialize, scratch_path
    spark = df.sparkSession
    order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    key = list(key) if key is not None else [k for k in order if isinstance(k, str)]
    payload = [c for c in df.columns if c not in key]
    # equal keys are told apart by the rest of their rows
    twin = F.xxhash64(*payload) if payload else F.lit(0).cast("bigint")
    df = materialize(df.withColumn("_twin", twin), "dense-ids-input")
    keys = df.groupBy(*key, "_twin").agg(F.count(F.lit(1)).alias("_times"))
    by = [*order, "_twin"]
    # without an explicit count AQE may coalesce small range partitions; ids only
    # depend on the partition ids seen by the single write job below
    ranged = keys.repartitionByRange(partitions, *by) if partitions else keys.repartitionByRange(*by)
    ranked = ranged.sortWithinPartitions(*by)
    ranked = ranked.withColumn("_part", F.spark_partition_id()).withColumn(
        "_mono", F.monotonically_increasing_id())
    path = scratch_path(spark, "dense-ids")
    ranked.write.parquet(path)
    stable = spark.read.parquet(path)
    # one row per partition (bounded by the partition count): computed once, joined back as a local table
    counts = sorted(tuple(r) for r in stable.groupBy("_part").agg(F.sum("_times"), F.min("_mono")).collect())
    start = int(base.first()[0] or 0) if isinstance(base, DataFrame) else int(base)
    shifts, running = [], start
    for part, size, first in counts:
        shifts.append((int(part), running, int(first)))
        running += int(size)
    shift = spark.createDataFrame(shifts, "_part int, _start bigint, _first bigint")
    ids = stable.join(F.broadcast(shift), "_part")
    ids = ids.withColumn("_id", F.col("_start") + F.col("_mono") - F.col("_first"))
    if not stable.where("_times > 1").isEmpty():   # rows repeated in full: each takes an id of its own
        earlier = Window.partitionBy("_part").orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
        ids = ids.withColumn("_id", F.col("_id") + F.coalesce(F.sum(F.col("_times") - 1).over(earlier), F.lit(0)))
        ids = ids.withColumn("_id", F.explode(F.sequence(F.col("_id"), F.col("_id") + F.col("_times") - 1)))
        df = df.dropDuplicates([*key, "_twin"])
    narrow = ids.select(*[F.col(k).alias(f"_key_{k}") for k in key], F.col("_twin").alias("_key_twin"), F.col("_id").cast("bigint").alias(id_col))
    if not payload:
        return narrow.select(*[F.col(f"_key_{k}").alias(k) for k in key], id_col)
    on = [df[k].eqNullSafe(narrow[f"_key_{k}"]) for k in key] + [df["_twin"] == narrow["_key_twin"]]
    return df.join(narrow, on).select(*key, *payload, id_col)


def ordinal_within(df: DataFrame, group: str, order_by, name: str = "ordinal") -> DataFrame:
    """0-based position of each row inside its group, in ``order_by`` order.

    Same result as ``row_number() over (partition by group order by ...) - 1``
    but a hot group is not sorted in one task: rows get a global dense rank
    (range-partitioned), each group's first rank is a partial+final
    aggregate, and it is attached with a salted join.
    """
    from lisible.operators.joins import salted_join
    keys = [group] + ([order_by] if isinstance(order_by, (str, Column)) else list(order_by))
    ranked = assign_dense_ids(df, keys, id_col="_rank")
    first = ranked.groupBy(group).agg(F.min("_rank").alias("_first_rank"))
    j = salted_join(ranked, first, [group], salt_from=["_rank"])
    return j.withColumn(name, (F.col("_rank") - F.col("_first_rank")).cast("bigint")).drop("_rank", "_first_rank")


def scorable_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that ``scorable`` would keep, told without scoring: one sentence within the scorer's length is enough."""
    from lisible.constants import SCORER_MAX_TOKENS
    from lisible.functions.text import sentence_array, within_tokens
    return docs.where(F.exists(sentence_array(F.col(text)), lambda s: within_tokens(s, SCORER_MAX_TOKENS)))


def scorable(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("n_sentences") > 0)


def text_articles(docs: DataFrame, scorer: Scorer = DEFAULT_SCORER, base: int | DataFrame = 0) -> DataFrame:
    """Pasted-text articles: title and description are the clipped text, fixed icon, url ``text``.

    Documents without any scorable sentence are left out (see ``rejected_documents``).
    """
    from lisible.session import materialize
    docs = docs.select("doc_id", "text")
    scored = scorable(scored_documents(docs, scorer=scorer))
    # ids and levels travel without the text, which meets them once, where it is asked for
    narrow = scored.select("doc_id", F.xxhash64("text").alias("_text_hash"), *LEVELS)
    ids = materialize(assign_dense_ids(narrow, ["doc_id", "_text_hash"], base=base), "article-ids")
    ids = ids.select("article_id", F.col("doc_id").alias("_doc_id"), "_text_hash", *LEVELS)
    if not ids.groupBy("_doc_id", "_text_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])   # repeated rows have an id each, and one text
    # what is made of the text is made before the join, so that a text nobody asks for stays out of the shuffle
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), clip(F.col("text"), TITLE_LENGTH).alias("title"),
                       clip(F.col("text"), DESCRIPTION_LENGTH).alias("description"))
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_doc_id"]) & (F.col("_hash") == F.col("_text_hash")))
    return rows.select("article_id", "doc_id", F.lit(TEXT_URL).alias("url"), "title", F.lit(TEXT_ICON).alias("image"), "description", "text", *LEVELS)


def article_cards(articles: DataFrame) -> DataFrame:
    """Read model of a card: id, title, image, description, dominant level, minutes, band."""
    minutes = reading_minutes(F.col("text"))
    return articles.select(
        "article_id", "title", "image", "description",
        dominant_level().alias("level"),
        minutes.alias("minutes"),
        reading_band(minutes).cast("bigint").alias("band"),
    )


def level_percentages(articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Long form ``(key, level, pct)``; pct rounds half to even like Python's ``round``."""
    long = articles.unpivot([key], LEVELS, "level", "p")
    return long.select(key, "level", F.bround(F.col("p") * F.lit(100.0), 0).alias("pct"))


def article_by_id(articles: DataFrame, requests: DataFrame, route: str = "route") -> DataFrame:
    """Batch point lookups: a route string is cast to an id (else -1), first match or null."""
    from lisible.operators.joins import salted_join
    # equal routes are counted first and come back after the join, so a route that many ask for is one row;
    # every unparsable route maps to -1, a key that stays hot and is salted by the route
    req = requests.groupBy(route).agg(F.count(F.lit(1)).alias("_times")) \
        .withColumn("article_id", F.coalesce(F.col(route).try_cast("bigint"), F.lit(-1).cast("bigint")))
    found = salted_join(req, articles.select("article_id", "title", "url"), ["article_id"], "left", salt_from=[route])
    found = found.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return found.select(route, "article_id", F.col("title").isNotNull().alias("found"), "title", "url")


def catalog_audit(articles: DataFrame) -> DataFrame:
    """Read-back checks as one aggregate: counts, density of ids, nulls, duplicate URLs, probability sums, corrupt records."""
    if "_corrupt_record" not in articles.columns:
        articles = articles.withColumn("_corrupt_record", F.lit(None).cast("string"))
    total = sum((F.col(lv) for lv in LEVELS[1:]), F.col(LEVELS[0]))
    per_url = (articles.where(F.col("url") != F.lit(TEXT_URL)).groupBy("url").count()
               .where("count > 1").select(F.count(F.lit(1)).alias("duplicate_urls")))
    base = articles.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("_corrupt_record").alias("corrupt_rows"),
        F.count_distinct("article_id").alias("n_ids"),
        F.min("article_id").alias("min_id"),
        F.max("article_id").alias("max_id"),
        F.sum(F.col("title").isNull().cast("int")).alias("null_titles"),
        F.sum(F.col("text").isNull().cast("int")).alias("null_texts"),
        F.sum((F.abs(total - F.lit(1.0)) > F.lit(1e-6)).cast("int")).alias("bad_probability_sums"),
    )
    return base.select(
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_ids").cast("bigint").alias("n_ids"),
        F.col("min_id").cast("bigint").alias("min_id"),
        F.col("max_id").cast("bigint").alias("max_id"),
        ((F.col("n_ids") == F.col("n_rows")) & (F.coalesce(F.col("max_id") - F.col("min_id") + 1, F.lit(0)) == F.col("n_rows"))).alias("ids_dense"),
        F.coalesce(F.col("null_titles"), F.lit(0)).cast("bigint").alias("null_titles"),
        F.coalesce(F.col("null_texts"), F.lit(0)).cast("bigint").alias("null_texts"),
        F.coalesce(F.col("bad_probability_sums"), F.lit(0)).cast("bigint").alias("bad_probability_sums"),
        F.lit(per_url.scalar()).cast("bigint").alias("duplicate_urls"),
        F.col("corrupt_rows").cast("bigint").alias("corrupt_rows"),
    )


def new_urls(batch: DataFrame, catalog: DataFrame, order_by: str = "page_id") -> DataFrame:
    """Submissions worth fetching: first per URL inside the batch, and not already stored.

    The in-batch rule is a per-URL ``row_number`` (planned as a window group
    limit); the catalog check is a left anti join on URL, which the planner
    turns into a broadcast when the URL set is small at run time. Pasted
    texts (url ``text``) and rows without a URL are no duplicates of each
    other: all of them stay.
    """
    w = Window.partitionBy("url").orderBy(order_by)
    crawled = batch.where(F.col("url") != F.lit(TEXT_URL))
    first = crawled.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    known = catalog.where(F.col("url") != F.lit(TEXT_URL)).select("url")
    others = batch.where(F.col("url").isNull() | (F.col("url") == F.lit(TEXT_URL)))
    return first.join(known, "url", "left_anti").select(*batch.columns).unionByName(others)
