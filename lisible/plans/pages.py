"""Queries over ``pages``: fields, links, images, main text, catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.constants import DEFAULT_IMAGE, DESCRIPTION_LENGTH, LEVELS, NO_DESCRIPTION, TITLE_LENGTH
from lisible.functions import html as H
from lisible.functions.markdown import relocate_images
from lisible.operators import catalog as cat
from lisible.operators import pages as pg
from lisible.operators.scoring import rounded_levels, scored_documents
from lisible.plans import documents as D
from lisible.plans import sql as S
from lisible.plans.memo import memoized
from lisible.sources.tables import documents
from lisible.sources.tables import pages as stored_pages

NN = "chr(10) || chr(10)"


# ----------------------------------------------------------------------------
# building blocks
# ----------------------------------------------------------------------------

# Fixture: every stored page whole, with what they lack put in by expressions on page_id (description and image
# metadata, images in several spellings: declared width, none, quoted and not). Cases of failure are further rows
# with ids of their own (negative), so no stored row is changed into one: fetches that gave no html or blanks only.
DESCRIPTION_TAG = "<meta name=\"description\" content=\"About page &amp; more\">"
IMAGE_TAG = "<meta property='og:image' content='/og.png'>"
WIDE = "<p><img src=\"/wide.png\" alt=\"Wide one\" width=\"640\"> seen here.</p>"
NARROW = ("<p><img width='90' src='img/narrow.png'>Small.</p><p>And <img src=bare.png> too, see "
          "<a class=x href='../more?a=1&amp;b=2'> the <i>rest</i> </a> of <strong> it all </strong>.</p>")


RETRY = "#retry"


def fresh_id(name: str):
    """An id for a row derived from another one; stored ids are never negative."""
    return (F.lit(-1).cast("bigint") - F.col(name)).alias(name)


def pages(spark, sf_dir) -> DataFrame:
    i = F.col("page_id")
    head = F.concat(F.when(i % 4 == 0, F.lit(DESCRIPTION_TAG)).otherwise(""), F.when(i % 5 == 1, F.lit(IMAGE_TAG)).otherwise(""), F.lit("</head>"))
    body = F.concat(F.when(i % 3 == 0, F.lit(WIDE)).otherwise(""), F.when(i % 3 == 1, F.lit(NARROW)).otherwise(""), F.lit("</article>"))
    html = F.replace(F.replace("html", F.lit("</head>"), head), F.lit("</article>"), body)
    given = stored_pages(spark, sf_dir)
    failed = given.where(i % 17 == 5).withColumn("html", F.lit(None).cast("string")) \
        .unionByName(given.where(i % 17 == 9).withColumn("html", F.lit(" \n ")))
    return given.select("page_id", "url", html.alias("html")).unionByName(
        failed.select(fresh_id("page_id"), F.concat("url", F.lit(RETRY)).alias("url"), "html"))


def image_sizes(spark, sf_dir) -> DataFrame:
    """Crawled widths, as a table: one per image source without a declared width."""
    images = pg.page_images(pages(spark, sf_dir)).where("width_raw is null").select("src").distinct()
    return images.select("src", (F.length("src") * 37 % 900 + 10).cast("int").alias("width"))


@memoized
def page_text(spark, sf_dir) -> DataFrame:
    """``(page_id, url, host, text, n_blocks)``: main text with images moved to paragraph ends."""
    main = pg.page_main_text(pages(spark, sf_dir))
    return main.withColumn("text", relocate_images(F.col("main_text")))


def page_rows(spark, sf_dir, compat: bool = False) -> DataFrame:
    """Accepted page articles before ids."""
    return pg.page_article_rows(pages(spark, sf_dir), image_sizes(spark, sf_dir), compat=compat)


def submissions(spark, sf_dir) -> DataFrame:
    """Every stored page submitted once, odd page ids a second time (a duplicate inside the batch); besides them
    pasted texts and submissions without url, as rows of their own."""
    given = stored_pages(spark, sf_dir).select("page_id", "url")
    rep = given.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.col("page_id") % 2)).alias("copy"))
    rep = rep.select((F.col("page_id") * 2 + F.col("copy")).alias("seq"), "page_id", "url")
    other = [given.where(F.col("page_id") % 11 == 3).withColumn("url", F.lit(None).cast("string")),
             given.where(F.col("page_id") % 13 == 4).withColumn("url", F.lit("text"))]
    for k, rows in enumerate(other):
        rep = rep.unionByName(rows.select((-F.col("page_id") * 2 - 1 - k).alias("seq"), fresh_id("page_id"), "url"))
    return rep


def known_catalog(spark, sf_dir) -> DataFrame:
    """Catalog already holding the earliest page of every host (a partial+final aggregate per host)."""
    p = stored_pages(spark, sf_dir).select("page_id", "url", H.host(F.col("url")).alias("host"))
    return p.groupBy("host").agg(F.min_by("url", "page_id").alias("url")).select("url")


def documents_and_null_texts(spark, sf_dir) -> DataFrame:
    """Every stored document, and rows of their own without a text."""
    given = documents(spark, sf_dir).select("doc_id", "text")
    return given.unionByName(given.where(F.col("doc_id") % 19 == 7).select(fresh_id("doc_id"), F.lit(None).cast("string").alias("text")))


# ----------------------------------------------------------------------------
# queries
# ----------------------------------------------------------------------------

def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.page_links(pages(spark, sf_dir))


def q_page_main_text(spark, sf_dir):
    return pg.page_main_text(pages(spark, sf_dir)).select("page_id", "host", "main_text", "n_blocks")


def q_page_title(spark, sf_dir):
    return pg.page_fields(pages(spark, sf_dir)).select("page_id", "url", "title")


def q_page_description(spark, sf_dir):
    return pg.page_fields(pages(spark, sf_dir)).select("page_id", "description")


def q_relocate_images(spark, sf_dir):
    return page_text(spark, sf_dir).select("page_id", "text")


def q_largest_image(spark, sf_dir):
    return pg.largest_image(pg.page_images(pages(spark, sf_dir)), image_sizes(spark, sf_dir))


def q_page_image(spark, sf_dir):
    p = pages(spark, sf_dir)
    return pg.page_image(pg.page_fields(p), pg.largest_image(pg.page_images(p), image_sizes(spark, sf_dir)))


def q_new_urls(spark, sf_dir):
    return cat.new_urls(submissions(spark, sf_dir), known_catalog(spark, sf_dir), order_by="seq").select(
        "seq", "page_id", "url")


def q_rejected_inputs(spark, sf_dir):
    """Inputs that become no article, one reason each; accepted and rejected inputs are all inputs."""
    status = pg.page_article_status(pages(spark, sf_dir), image_sizes(spark, sf_dir))
    page = status.where("reason is not null").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), "reason")
    docs = scored_documents(documents_and_null_texts(spark, sf_dir)).where("n_sentences = 0")
    return page.unionByName(docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit("no_sentence").alias("reason")))


def q_assign_article_ids(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    return cat.assign_dense_ids(rows, "page_id").select("article_id", "page_id", "url")


def q_union_articles(spark, sf_dir):
    text = D.doc_catalog(spark, sf_dir)
    next_id = text.agg(F.count(F.lit(1)))
    page = cat.assign_dense_ids(page_rows(spark, sf_dir), "page_id", base=next_id)
    both = text.unionByName(page, allowMissingColumns=True)
    return both.select("article_id", "url", "title", "doc_id", "page_id", *rounded_levels())


QUERIES = {
    "page_links": q_page_links,
    "page_main_text": q_page_main_text,
    "page_title": q_page_title,
    "page_description": q_page_description,
    "relocate_images": q_relocate_images,
    "largest_image": q_largest_image,
    "page_image": q_page_image,
    "new_urls": q_new_urls,
    "rejected_inputs": q_rejected_inputs,
    "assign_article_ids": q_assign_article_ids,
    "union_articles": q_union_articles,
}


# ----------------------------------------------------------------------------
# oracle SQL
# ----------------------------------------------------------------------------

def _pg() -> tuple[str, str]:
    head = (f"(CASE WHEN page_id % 4 = 0 THEN {S.lit(DESCRIPTION_TAG)} ELSE '' END) || "
            f"(CASE WHEN page_id % 5 = 1 THEN {S.lit(IMAGE_TAG)} ELSE '' END) || '</head>'")
    body = (f"(CASE WHEN page_id % 3 = 0 THEN {S.lit(WIDE)} ELSE '' END) || "
            f"(CASE WHEN page_id % 3 = 1 THEN {S.lit(NARROW)} ELSE '' END) || '</article>'")
    html = f"replace(replace(html, '</head>', {head}), '</article>', {body})"
    return ("pg", f"SELECT page_id, url, {html} AS html, {S.host('url')} AS host FROM pages UNION ALL "
                  f"SELECT -1 - page_id, url || {S.lit(RETRY)}, CASE WHEN page_id % 17 = 5 THEN '' ELSE ' ' || chr(10) || ' ' END, {S.host('url')} "
                  "FROM pages WHERE page_id % 17 IN (5, 9)")


def _title() -> str:
    t = S.nullif_empty(S.clean_text(f"regexp_extract(html, {S.lit(H.TITLE)}, 1)"))
    h1 = S.nullif_empty(S.clean_text(f"regexp_extract(html, {S.lit(H.H1)}, 1)"))
    return f"coalesce({t}, {h1}, host)"


def _meta(pattern: str) -> str:
    tag = f"regexp_extract(html, {S.lit(pattern)}, 0)"
    return S.nullif_empty(S.clean_text(f"coalesce({S.attr_value(tag, 'content')}, '')"))


def _fields() -> tuple[str, str]:
    return ("fields", f"SELECT page_id, url, host, {_title()} AS title, "
                      f"coalesce({_meta(H.META_DESCRIPTION)}, {S.lit(NO_DESCRIPTION)}) AS description, "
                      f"{_meta(H.META_IMAGE)} AS og_image FROM pg")


def _blocks_ctes() -> list[tuple[str, str]]:
    bm, hm = "chr(57344) || chr(57346)", "chr(57344) || chr(57347)"

    def rewritten(text: str, tag: str, one: str) -> str:
        """Tags of one kind in ``text`` replaced, each with the text after it: ``one`` over t and rest."""
        tags, parts = f"regexp_extract_all({text}, {S.lit(H.tag_pattern(tag))})", f"regexp_split_to_array({text}, {S.lit(H.tag_pattern(tag))})"
        each = f"list_transform(list_zip({tags}, ({parts})[2:]), lambda z: {one.replace('@t', 'z[1]').replace('@rest', 'z[2]')})"
        return f"(({parts})[1] || array_to_string({each}, ''))"

    src = S.resolve("url", S.attr_value("@t", "src"))
    image = (f"(CASE WHEN {src} IS NULL THEN ' ' ELSE ' ![' || coalesce({S.attr_value('@t', 'alt')}, '') || '](' || {src} || ') ' END) || @rest")
    target = S.resolve("url", S.attr_value("@t", "href"))
    inner = f"regexp_replace(regexp_extract(@rest, {S.lit(H.LINK_INNER)}, 1), {S.lit(H.TRIM)}, '', 'g')"
    link = (f"CASE WHEN {target} IS NOT NULL AND {S.clean_text(inner)} <> '' THEN '[' || {inner} || '](' || {target} || ')' || "
            f"regexp_replace(@rest, {S.lit(H.LINK_INNER)}, '') ELSE @rest END")
    md = rewritten("body", "a", link)
    md = f"regexp_replace(regexp_replace({md}, {S.lit(H.BOLD)}, '**\\1**', 'g'), {S.lit(H.ITALIC)}, '*\\1*', 'g')"
    body = rewritten("quiet", "img", image)
    body = f"regexp_replace({body}, {S.lit(H.HEADING_OPEN)}, {bm} || '\\1' || {hm}, 'g')"
    body = f"regexp_replace({body}, {S.lit(H.BLOCK_TAG)}, {bm}, 'g')"
    prefix = "'^([1-6])' || " + hm
    return [
        ("calm", f"SELECT page_id, url, host, replace(regexp_replace(html, {S.lit(H.NOISE)}, ' ', 'g'), {S.ESCAPE_SQL}, {S.ESCAPED_SQL}) AS quiet FROM pg"),
        ("raw", f"SELECT page_id, url, host, string_split({body}, {bm}) AS bl FROM calm"),
        ("ub", "SELECT page_id, url, host, bl[i] AS b, i - 1 AS pos FROM (SELECT *, generate_subscripts(bl, 1) AS i FROM raw) x"),
        ("ub2", f"SELECT *, regexp_extract(b, {prefix}, 1) AS lvl, regexp_replace(b, {prefix}, '') AS body FROM ub"),
        ("blk", "SELECT page_id, url, host, pos, CASE WHEN lvl = '' THEN 0 ELSE CAST(lvl AS INTEGER) END AS level, "
                f"replace({S.clean_text('body')}, {S.ESCAPED_SQL}, {S.ESCAPE_SQL}) AS text, "
                f"replace({S.clean_text(md)}, {S.ESCAPED_SQL}, {S.ESCAPE_SQL}) AS md, "
                f"length({S.clean_text(f'array_to_string(regexp_extract_all(body, {S.lit(H.LINK_TEXT)}, 1), {S.lit(chr(32))})')}) AS link_chars FROM ub2"),
        ("nb", "SELECT * FROM blk WHERE text <> ''"),
        ("per_key", "SELECT host, text, count(DISTINCT page_id) AS n_pages FROM nb GROUP BY host, text"),
        ("per_host", "SELECT host, count(*) AS host_pages FROM pg GROUP BY host"),
        ("tmpl", f"SELECT k.host, k.text FROM per_key k JOIN per_host h ON k.host = h.host "
                 f"WHERE h.host_pages >= {pg.TEMPLATE_MIN_PAGES} AND k.n_pages >= h.host_pages * {pg.TEMPLATE_SHARE}"),
        ("kept_blocks", f"SELECT nb.* FROM nb ANTI JOIN tmpl ON nb.host = tmpl.host AND nb.text = tmpl.text "
                 f"WHERE NOT (nb.link_chars > length(nb.text) * {pg.LINK_DENSITY_MAX})"),
        ("main_agg", "SELECT page_id, string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' ELSE '' END || md, "
                     f"{NN} ORDER BY pos) AS main_text, count(*) AS n_blocks FROM kept_blocks GROUP BY page_id"),
        ("main", "SELECT pg.page_id, pg.url, pg.host, coalesce(m.main_text, '') AS main_text, "
                 "CAST(coalesce(m.n_blocks, 0) AS BIGINT) AS n_blocks FROM pg LEFT JOIN main_agg m ON pg.page_id = m.page_id"),
        ("ptext", f"SELECT page_id, url, host, n_blocks, {S.relocate_images('main_text')} AS text FROM main"),
    ]


def _images_ctes() -> list[tuple[str, str]]:
    tag_re = S.lit(H.tag_pattern("img"))
    w = S.attr_value("tag", "width")
    declared = (f"CAST(CASE WHEN {w} IS NOT NULL AND regexp_matches({w}, {S.lit(pg.INT_TEXT)}) "
                f"THEN TRY_CAST(regexp_replace({w}, '[ \\t\\n\\r]', '', 'g') AS BIGINT) ELSE 0 END AS BIGINT)")
    return [
        ("img_list", f"SELECT page_id, url, regexp_extract_all(html, {tag_re}) AS tags FROM pg"),
        ("img", "SELECT page_id, url, tags[i] AS tag, i - 1 AS pos FROM (SELECT *, generate_subscripts(tags, 1) AS i FROM img_list) x"),
        ("img2", f"SELECT page_id, pos, {S.resolve('url', S.attr_value('tag', 'src'))} AS src, "
                 f"coalesce({declared}, 0) AS declared, {w} IS NULL AS undeclared FROM img"),
        ("crawled", "SELECT DISTINCT src, length(src) * 37 % 900 + 10 AS fetched FROM img2 WHERE undeclared AND src IS NOT NULL"),
        ("img3", "SELECT i.page_id, i.pos, i.src, CAST(CASE WHEN declared <> 0 THEN declared ELSE c.fetched END AS BIGINT) AS width "
                 "FROM img2 i LEFT JOIN crawled c ON i.src = c.src"),
        ("cand", "SELECT * FROM img3 WHERE src IS NOT NULL AND width > 0"),
        ("largest", "SELECT page_id, src, width FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY width DESC, pos) AS rn FROM cand) x WHERE rn = 1"),
        ("maxw", "SELECT page_id, max(width) AS width FROM cand GROUP BY page_id"),
    ]


def _scored_text_ctes(source: str, key: str) -> list[tuple[str, str]]:
    return S.scored_text_ctes(source, key, "tx") + [("t_means", "SELECT * FROM tx_means")]


def _page_rows_ctes() -> list[tuple[str, str]]:
    return [_pg(), _fields()] + _blocks_ctes() + _images_ctes() + [
        ("accepted", "SELECT page_id, text FROM ptext WHERE n_blocks > 0"),
        *_scored_text_ctes("accepted", "page_id"),
        ("rows", f"SELECT f.page_id, f.url, {S.clip('f.title', TITLE_LENGTH)} AS title, "
                 f"coalesce(f.og_image, l.src, {S.lit(DEFAULT_IMAGE)}) AS image, "
                 f"{S.clip('f.description', DESCRIPTION_LENGTH)} AS description, a.text, "
                 + ", ".join(f"m.{lv}" for lv in LEVELS)
                 + " FROM t_means m JOIN accepted a ON m.page_id = a.page_id JOIN fields f ON f.page_id = m.page_id "
                   "LEFT JOIN largest l ON l.page_id = m.page_id"),
    ]


def oracle() -> dict[str, str]:
    links = []
    for tag, attr in H.LINK_TAGS:
        links.append(
            f"SELECT page_id, url, '{tag}' AS tag, '{attr}' AS attr, i - 1 AS pos, tags[i] AS t FROM ("
            f"SELECT *, generate_subscripts(tags, 1) AS i FROM (SELECT page_id, url, list_filter(regexp_extract_all("
            f"regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), {S.lit(H.tag_pattern(tag))}), "
            f"lambda t: regexp_matches(t, {S.lit(H.has_attr_pattern(attr))})) AS tags FROM pg) a) b")
    raw_cases = "CASE attr " + " ".join(f"WHEN '{a}' THEN {S.attr_value('t', a)}" for _, a in H.LINK_TAGS) + " END"
    blocks = [_pg()] + _blocks_ctes()
    page_rows = _page_rows_ctes()
    doc_scored = D.sql_scored_ctes()
    submissions = ("subs", "SELECT page_id * 2 + c AS seq, page_id, url FROM (SELECT page_id, url, "
                           "unnest(generate_series(0, page_id % 2)) AS c FROM pages) x UNION ALL "
                           "SELECT -page_id * 2 - 1, -1 - page_id, NULL FROM pages WHERE page_id % 11 = 3 UNION ALL "
                           "SELECT -page_id * 2 - 2, -1 - page_id, 'text' FROM pages WHERE page_id % 13 = 4")
    known = ("known", f"SELECT arg_min(url, page_id) AS url FROM pages GROUP BY {S.host('url')}")
    return {
        "page_links": S.with_ctes([_pg(), ("lk", " UNION ALL ".join(links)), ("lk2", f"SELECT *, {raw_cases} AS raw FROM lk")],
                                  f"SELECT page_id, tag, attr, pos, raw, {S.resolve('url', 'raw')} AS absolute FROM lk2"),
        "page_main_text": S.with_ctes(blocks, "SELECT page_id, host, main_text, n_blocks FROM main"),
        "page_title": S.with_ctes([_pg(), _fields()], "SELECT page_id, url, title FROM fields"),
        "page_description": S.with_ctes([_pg(), _fields()], "SELECT page_id, description FROM fields"),
        "relocate_images": S.with_ctes(blocks, "SELECT page_id, text FROM ptext"),
        "largest_image": S.with_ctes([_pg()] + _images_ctes(), "SELECT page_id, src, width FROM largest"),
        "page_image": S.with_ctes([_pg(), _fields()] + _images_ctes(),
                                  f"SELECT f.page_id, coalesce(f.og_image, l.src, {S.lit(DEFAULT_IMAGE)}) AS image "
                                  "FROM fields f LEFT JOIN largest l ON f.page_id = l.page_id"),
        "new_urls": S.with_ctes([submissions, known],
                                "SELECT seq, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM subs) x "
                                "WHERE url IS NULL OR url = 'text' OR rn = 1 AND url NOT IN (SELECT url FROM known WHERE url <> 'text')"),
        "rejected_inputs": S.with_ctes(blocks + [("accepted", "SELECT page_id, text FROM ptext WHERE n_blocks > 0")]
                                       + _scored_text_ctes("accepted", "page_id") + doc_scored,
                                       "SELECT 'pages' AS source, page_id AS id, 'fetch_failed' AS reason FROM pg WHERE page_id < 0 "
                                       "UNION ALL SELECT 'pages', page_id, 'no_main_text' FROM ptext WHERE n_blocks = 0 AND page_id >= 0 "
                                       "UNION ALL SELECT 'pages', a.page_id, 'no_sentence' FROM accepted a ANTI JOIN t_means m ON a.page_id = m.page_id "
                                       "UNION ALL SELECT 'documents', d.doc_id, 'no_sentence' FROM documents d LEFT JOIN doc_means m ON d.doc_id = m.doc_id "
                                       "WHERE m.doc_id IS NULL "
                                       "UNION ALL SELECT 'documents', -1 - doc_id, 'no_sentence' FROM documents WHERE doc_id % 19 = 7"),
        "assign_article_ids": S.with_ctes(page_rows, "SELECT row_number() OVER (ORDER BY page_id) - 1 AS article_id, page_id, url FROM rows"),
        "union_articles": S.with_ctes(
            D.sql_catalog_ctes() + page_rows,
            f"SELECT article_id, url, title, doc_id, CAST(NULL AS BIGINT) AS page_id, {S.rounded_levels()} FROM articles "
            "UNION ALL SELECT (SELECT count(*) FROM articles) + row_number() OVER (ORDER BY page_id) - 1, url, title, "
            f"CAST(NULL AS BIGINT), page_id, {S.rounded_levels()} FROM rows"),
    }
