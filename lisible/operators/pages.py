"""Page → article jobs: fields, links, images, main text, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lisible.constants import DEFAULT_IMAGE, NO_DESCRIPTION
from lisible.functions import html as H
from lisible.functions.urls import resolve
from lisible.operators.joins import salted_join

TEMPLATE_SHARE = 0.5        # a block on at least this share of a host's pages is a template
TEMPLATE_MIN_PAGES = 5      # only hosts with at least this many pages have templates
LINK_DENSITY_MAX = 0.5      # blocks whose text is mostly link text are navigation

IMAGE_SIZES_SCHEMA = T.StructType([T.StructField("src", T.StringType()), T.StructField("width", T.IntegerType())])
INT_TEXT = "^[ \\t\\n\\r]*[+-]?[0-9]+[ \\t\\n\\r]*$"
HEADING_PREFIX = "^([1-6])" + H.HEADING_MARK


def page_fields(pages: DataFrame, compat: bool = False) -> DataFrame:
    """One row per page: host, title (with fallback), description (with fallback), og image.

    The title fallback is the host; ``compat=True`` gives what splitting the
    URL at ``//`` gives instead (the scheme and its colon).
    """
    fallback = F.concat(H.scheme(F.col("url")), F.lit(":")) if compat else H.host(F.col("url"))
    return pages.select(
        "page_id", "url",
        H.host(F.col("url")).alias("host"),
        F.coalesce(H.page_title_raw(F.col("html")), fallback).alias("title"),
        F.coalesce(H.meta_content(F.col("html"), H.META_DESCRIPTION), F.lit(NO_DESCRIPTION)).alias("description"),
        H.meta_content(F.col("html"), H.META_IMAGE).alias("og_image"),
    )


def _has_attr(attr: str):
    return lambda t: t.rlike(H.has_attr_pattern(attr))


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, tag, attr, pos, raw, absolute)`` for a[href], img[src], link[href], script[src].

    One pass over the HTML: the four tag lists become one array of structs,
    exploded once.
    """
    html = F.regexp_replace("html", "(?is)<!--.*?-->", " ")
    parts = []
    for tag, attr in H.LINK_TAGS:
        tags = F.filter(F.regexp_extract_all(html, F.lit(H.tag_pattern(tag)), 0), _has_attr(attr))
        parts.append(F.transform(tags, _link_struct(tag, attr)))
    links = pages.select("page_id", "url", F.explode(F.concat(*parts)).alias("l"))
    return links.select("page_id", "l.tag", "l.attr", "l.pos", "l.raw",
                        resolve(F.col("url"), F.col("l.raw")).alias("absolute"))


def _link_struct(tag: str, attr: str):
    return lambda t, i: F.struct(F.lit(tag).alias("tag"), F.lit(attr).alias("attr"),
                                 i.cast("bigint").alias("pos"), H.attr_value(t, attr).alias("raw"))


def page_images(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, src, width_raw)`` for every ``<img>``; src made absolute."""
    imgs = pages.select("page_id", "url", F.posexplode(
        F.regexp_extract_all(F.col("html"), F.lit(H.tag_pattern("img")), 0)).alias("pos", "_tag"))
    return imgs.select("page_id", F.col("pos").cast("bigint").alias("pos"),
                       resolve(F.col("url"), H.attr_value(F.col("_tag"), "src")).alias("src"),
                       H.attr_value(F.col("_tag"), "width").alias("width_raw"))


def declared_width(raw: Column) -> Column:
    """Integer width like ``int(raw)``, or 0 when absent or not an integer."""
    return F.when(raw.rlike(INT_TEXT), F.regexp_replace(raw, "[ \\t\\n\\r]", "").try_cast("bigint")).otherwise(
        F.lit(0)).cast("bigint")


def largest_image(images: DataFrame, image_sizes: DataFrame | None = None) -> DataFrame:
    """Widest image per page; declared width, else the crawled width; ties go to the first.

    Images with no usable width, no source, or width ≤ 0 are skipped. The
    width lookup is a left join on the source URL, salted because one logo
    may sit on a large share of all pages.
    """
    imgs = images.withColumn("declared", F.coalesce(declared_width(F.col("width_raw")), F.lit(0).cast("bigint")))
    if image_sizes is not None:
        sizes = image_sizes.select("src", F.col("width").cast("bigint").alias("fetched"))
        imgs = salted_join(imgs, sizes, ["src"], "left", salt_from=["page_id", "pos"])
    else:
        imgs = imgs.withColumn("fetched", F.lit(None).cast("bigint"))
    width = F.when(F.col("declared") != 0, F.col("declared")).otherwise(F.col("fetched"))
    cand = imgs.select("page_id", "pos", "src", width.alias("width")).where(
        F.col("src").isNotNull() & (F.col("width") > 0))
    return cand.groupBy("page_id").agg(
        F.max_by("src", F.struct(F.col("width"), -F.col("pos"))).alias("src"),
        F.max("width").alias("width"))


def largest_image_src(html: Column, url: Column) -> Column:
    """Widest ``<img>`` by declared width, inside the row (no crawled widths): first one wins ties."""
    tags = F.regexp_extract_all(html, F.lit(H.tag_pattern("img")), 0)
    cands = F.transform(tags, lambda t, i: F.struct(
        declared_width(H.attr_value(t, "width")).alias("width"), (-i).alias("neg_pos"),
        resolve(url, H.attr_value(t, "src")).alias("src")))
    valid = F.filter(cands, lambda c: c["src"].isNotNull() & (c["width"] > 0))
    return F.array_max(valid)["src"]


def page_image(fields: DataFrame, largest: DataFrame, compat: bool = False) -> DataFrame:
    """og image, else the largest image, else the default icon (``compat``: null)."""
    j = fields.select("page_id", "og_image").join(largest.select("page_id", F.col("src").alias("largest")),
                                                  "page_id", "left")
    chosen = F.coalesce(F.col("og_image"), F.col("largest"))
    if not compat:
        chosen = F.coalesce(chosen, F.lit(DEFAULT_IMAGE))
    return j.select("page_id", chosen.alias("image"))


def _block(b: Column, i: Column, url: Column) -> Column:
    level = F.regexp_extract(b, HEADING_PREFIX, 1)
    body = F.regexp_replace(b, HEADING_PREFIX, "")
    link_text = H.clean_text(F.array_join(F.regexp_extract_all(body, F.lit(H.LINK_TEXT), 1), " "))
    return F.struct(
        i.alias("pos"),
        F.when(level == "", F.lit(0)).otherwise(level.cast("int")).alias("level"),
        H.unescape_marks(H.clean_text(body)).alias("text"),
        F.length(link_text).alias("link_chars"),
        H.unescape_marks(H.clean_text(H.emphasis_to_markdown(H.links_to_markdown(body, url)))).alias("md"),
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """Adds ``blocks``: array<struct<pos, level, text, link_chars, md>> of non-empty blocks in page order.

    ``text`` is plain (it tells templates and link density), ``md`` keeps links, images and emphasis.
    """
    url = F.col("url")
    body = pages.withColumn("_body", H.escape_marks(F.regexp_replace("html", H.NOISE, " ")))
    body = body.withColumn("_body", H.images_to_markdown(F.col("_body"), url))
    blocks = F.transform(H.block_html(F.col("_body")), lambda b, i: _block(b, i, url))
    return body.withColumn("blocks", F.filter(blocks, lambda b: b["text"] != "")).drop("_body")


def block_statistics(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(host, key, n_pages)`` and ``(host, host_pages)`` for a set of pages with blocks.

    Keys are 64-bit hashes of the block text. Each page contributes each key
    once (``array_distinct`` in the row); both counts are partial+final hash
    aggregates, so a host owning a large share of all pages never sends its
    rows to one task. Counts are additive: statistics of several batches can
    be unioned and summed.
    """
    keys = blocks.select("host", F.explode(F.array_distinct(
        F.transform("blocks", lambda b: F.xxhash64(b["text"])))).alias("key"))
    per_key = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    per_host = blocks.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return per_key, per_host


def template_keys(blocks: DataFrame | None = None, per_key: DataFrame | None = None,
                  per_host: DataFrame | None = None) -> DataFrame:
    """``(host, key)`` of blocks repeated on at least half the pages of a host with ≥5 pages.

    The per-host page count is attached to the per-key counts with a salted
    join (one host may own a large share of all keys).
    """
    if per_key is None or per_host is None:
        per_key, per_host = block_statistics(blocks)
    j = salted_join(per_key, per_host, ["host"], salt_from=["key"])
    return j.where((F.col("host_pages") >= TEMPLATE_MIN_PAGES)
                   & (F.col("n_pages") >= F.col("host_pages") * F.lit(TEMPLATE_SHARE))).select("host", "key")


def _markdown_block(b: Column) -> Column:
    prefix = F.when(b["level"] > 0, F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "))).otherwise(F.lit(""))
    return F.concat(prefix, b["md"])


def page_main_text(pages: DataFrame, statistics=None, carry: list[str] | None = None) -> DataFrame:
    """``(page_id, url, host, main_text, n_blocks)``: blocks minus host templates and link-dense blocks.

    Per-host template key sets (bounded: a template covers half the host's
    pages, so a host has at most about twice a page's block count of them)
    are joined to pages on host with a salt, and filtered inside the row.
    ``statistics`` — a function ``blocks -> (per_key, per_host)``, e.g. one
    that adds counts accumulated over earlier stream batches — replaces the
    statistics of ``pages`` alone. The parsed blocks feed both the statistics
    and the join, so they are written once (the HTML is parsed once).
    """
    from lisible.session import materialize
    carry = list(carry or [])
    # a page without html has no block; a page without url has the empty host
    with_host = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("host", F.coalesce(H.host(F.col("url")), F.lit("")))
    blocks = materialize(page_blocks(with_host).select("page_id", "url", "host", "blocks", *carry), "page-blocks")
    per_key, per_host = statistics(blocks) if statistics is not None else block_statistics(blocks)
    tmpl = template_keys(per_key=per_key, per_host=per_host).groupBy("host").agg(F.collect_set("key").alias("tmpl"))
    j = salted_join(blocks, tmpl, ["host"], "left", salt_from=["page_id"])
    empty = F.array().cast("array<bigint>")
    kept = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce(F.col("tmpl"), empty), F.xxhash64(b["text"]))
                    & ~(b["link_chars"] > F.length(b["text"]) * F.lit(LINK_DENSITY_MAX)))
    out = j.withColumn("_kept", kept)
    return out.select("page_id", "url", "host",
                      F.array_join(F.transform("_kept", _markdown_block), "\n\n").alias("main_text"),
                      F.size("_kept").cast("bigint").alias("n_blocks"), *carry)


BLANK = "^[ \\t\\n\\r]*$"


def page_article_status(pages: DataFrame, image_sizes: DataFrame | None = None, compat: bool = False,
                        statistics=None) -> DataFrame:
    """Every page once, as an article before ids, with ``reason``: null if accepted, else why it is not.

    ``fetch_failed``: html null or blank; ``no_main_text``: no block is left;
    ``no_sentence``: nothing that can be scored. Fields and the widest declared
    image are computed inside the row and ride along the template join of the
    main-text step; only a crawled ``image_sizes`` table needs a join of its own.
    """
    from lisible.constants import DESCRIPTION_LENGTH, LEVELS, TITLE_LENGTH
    from lisible.functions.markdown import relocate_images
    from lisible.functions.text import clip
    from lisible.operators.scoring import scored_documents
    fallback = F.concat(H.scheme(F.col("url")), F.lit(":")) if compat else H.host(F.col("url"))
    html = F.coalesce(F.col("html"), F.lit(""))
    enriched = pages.select(
        "page_id", "url", "html",
        html.rlike(BLANK).alias("_blank"),
        F.coalesce(H.page_title_raw(html), fallback).alias("title"),
        F.coalesce(H.meta_content(html, H.META_DESCRIPTION), F.lit(NO_DESCRIPTION)).alias("description"),
        H.meta_content(html, H.META_IMAGE).alias("og_image"),
        (largest_image_src(html, F.col("url")) if image_sizes is None
         else F.lit(None).cast("string")).alias("_largest"),
    )
    main = page_main_text(enriched, statistics, carry=["title", "description", "og_image", "_largest", "_blank"])
    if image_sizes is not None:
        from lisible.session import materialize
        # image tags are parsed once; the key counts of the width join read the narrow table
        images = materialize(page_images(pages), "page-images")
        largest = largest_image(images, image_sizes).select("page_id", F.col("src").alias("_crawled"))
        main = main.drop("_largest").join(largest, "page_id", "left").withColumnRenamed("_crawled", "_largest")
    image = F.coalesce(F.col("og_image"), F.col("_largest"))
    if not compat:
        image = F.coalesce(image, F.lit(DEFAULT_IMAGE))
    text = main.select("page_id", "url", "title", "description", image.alias("image"), "_blank", "n_blocks",
                       relocate_images(F.col("main_text")).alias("text"))
    scored = scored_documents(text, key="page_id")
    reason = (F.when(F.col("_blank"), "fetch_failed").when(F.col("n_blocks") == 0, "no_main_text")
              .when(F.col("n_sentences") == 0, "no_sentence"))
    return scored.select("page_id", "url", clip(F.col("title"), TITLE_LENGTH).alias("title"), "image",
                         clip(F.col("description"), DESCRIPTION_LENGTH).alias("description"), "text", *LEVELS,
                         reason.alias("reason"))


def page_article_rows(pages: DataFrame, image_sizes: DataFrame | None = None, compat: bool = False,
                      statistics=None) -> DataFrame:
    """Accepted page articles before ids: clipped title/description, image, relocated text, levels."""
    return page_article_status(pages, image_sizes, compat, statistics).where("reason is null").drop("reason")
