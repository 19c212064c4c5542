"""Queries of the element-tree extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.functions import html as H
from lisible.operators import page_tree as T
from lisible.operators.pages import LINK_DENSITY_MAX, TEMPLATE_MIN_PAGES, TEMPLATE_SHARE
from lisible.plans import pages as P
from lisible.plans import sql as S


def q_page_tree_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ["run", "depth", "chars", "link_chars", "parent_chars", "parent_link_chars"]
    return T.page_tree_blocks(P.pages(spark, sf_dir)).withColumns({c: F.col(c).cast("bigint") for c in numbers})


def q_page_tree_text(spark, sf_dir):
    return T.page_tree_text(P.pages(spark, sf_dir))


QUERIES = {
    "page_tree_blocks": q_page_tree_blocks,
    "page_tree_text": q_page_tree_text,
}


def ctes() -> list[tuple[str, str]]:
    names = lambda xs: "(" + ", ".join(map(S.lit, xs)) + ")"
    ends = f"(k = 'O' AND (top = 'p' OR top = name AND name IN {names(T.REPEATED)}))"
    base = f"CASE WHEN {ends} THEN regexp_replace(f.path, '{T.ELEMENT}$', '') ELSE f.path END"
    cut = "string_split(f.path, '/' || name || ':')"
    mark = "'/' || name || ':'"
    words = f"regexp_extract_all(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '{T.WORD}')"
    slices = [f"list_min(list_transform(h, lambda x: substr(x, {i * T.SLICE + 1}, {T.SLICE})))" for i in range(T.BANDS * T.ROWS)]
    keys = ", ".join(f"path || ' {b} ' || " + " || ".join(slices[b * T.ROWS:(b + 1) * T.ROWS]) for b in range(T.BANDS))
    return [
        P._pg(),
        ("tree_raw", f"SELECT page_id, regexp_extract_all(regexp_replace(html, {S.lit(T.RAW)}, ' ', 'g'), {S.lit(T.TOKEN)}) AS t FROM pg"),
        ("tree_token", f"SELECT *, lower(regexp_extract(tok, {S.lit(T.NAME)}, 1)) AS name FROM (SELECT page_id, i - 1 AS idx, t[i] AS tok FROM "
                       "(SELECT *, generate_subscripts(t, 1) AS i FROM tree_raw) x) y"),
        ("tree_kind", "SELECT *, CASE WHEN tok LIKE '<!%' OR tok LIKE '<?%' THEN 'x' WHEN name = '' THEN 't' "
                      f"WHEN name IN {names(T.BREAKS)} THEN 'B' WHEN name IN {names(T.VOID)} THEN 'x' "
                      f"WHEN tok LIKE '%/>' THEN CASE WHEN name IN {names(T.INLINE)} THEN 'x' ELSE 'B' END "
                      f"WHEN name IN {names(T.INLINE)} THEN CASE WHEN tok LIKE '</%' THEN 'c' ELSE 'o' END "
                      "ELSE CASE WHEN tok LIKE '</%' THEN 'C' ELSE 'O' END END AS k FROM tree_token"),
        ("tree_seq", "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS i FROM tree_kind WHERE k <> 'x'"),
        ("fold", "SELECT page_id, CAST(0 AS BIGINT) AS i, '' AS path, CAST(0 AS BIGINT) AS run, '' AS top, '' AS text FROM pg UNION ALL "
                 f"SELECT page_id, i, path, run, regexp_extract(path, '{T.LAST_ELEMENT}', 1), text FROM ("
                 f"SELECT s.page_id, s.i, CASE WHEN k IN ('o', 'O') THEN {base} || {mark} || idx "
                 f"WHEN k IN ('c', 'C') AND contains(f.path, {mark}) THEN substr(f.path, 1, length(f.path) - length(({cut})[-1]) - length({mark})) ELSE f.path END AS path, "
                 "CASE WHEN k IN ('O', 'C', 'B') THEN f.run + 1 ELSE f.run END AS run, CASE WHEN k = 't' THEN tok ELSE '' END AS text "
                 "FROM fold f JOIN tree_seq s ON s.page_id = f.page_id AND s.i = f.i + 1) x"),
        ("tree_text", f"SELECT page_id, run, regexp_replace(arg_min(path, i), {S.lit(T.TRAILING_INLINE)}, '') AS whole, {S.clean_text("string_agg(text, '' ORDER BY i)")} AS text, "
                      f"sum(CASE WHEN contains(path, '/a:') THEN length({S.clean_text('text')}) ELSE 0 END) AS link_chars FROM fold WHERE text <> '' GROUP BY page_id, run"),
        ("tree_block", f"SELECT page_id, run, whole, regexp_replace(whole, '{T.ELEMENT}$', '') AS parent, regexp_replace(whole, ':[0-9]+', '', 'g') AS path, text, "
                       "length(text) AS chars, link_chars FROM tree_text WHERE text <> ''"),
        ("tree_sum", "SELECT a.page_id, a.run, sum(b.chars) AS parent_chars, sum(b.link_chars) AS parent_link_chars FROM tree_block a JOIN tree_block b "
                     "ON a.page_id = b.page_id AND (b.whole = a.parent OR starts_with(b.whole, a.parent || '/')) GROUP BY a.page_id, a.run"),
        ("tree_hash", f"SELECT page_id, run, path, list_transform(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]) ELSE w END, "
                      f"lambda p: md5(p)) AS h FROM (SELECT page_id, run, path, {words} AS w FROM tree_block) x"),
        ("tree_key", f"SELECT page_id, run, unnest([{keys}]) AS key FROM tree_hash"),
        ("tree_template", "SELECT host, key FROM tree_key JOIN pg USING (page_id) JOIN (SELECT host, count(*) AS host_pages FROM pg GROUP BY host) p USING (host) "
                          f"WHERE host_pages >= {TEMPLATE_MIN_PAGES} GROUP BY host, key, host_pages HAVING count(DISTINCT page_id) >= host_pages * {TEMPLATE_SHARE}"),
        ("tree_told", "SELECT b.page_id, b.run, path, len(string_split(path, '/')) - 1 AS depth, text, chars, link_chars, parent_chars, parent_link_chars, "
                      "EXISTS (SELECT 1 FROM tree_key k JOIN tree_template t ON t.key = k.key AND t.host = pg.host WHERE k.page_id = b.page_id AND k.run = b.run) AS template "
                      "FROM tree_block b JOIN tree_sum s ON s.page_id = b.page_id AND s.run = b.run JOIN pg ON pg.page_id = b.page_id"),
        ("tree", f"SELECT *, NOT template AND NOT link_chars > chars * {LINK_DENSITY_MAX} AND NOT parent_link_chars > parent_chars * {LINK_DENSITY_MAX} "
                 f"AND NOT regexp_matches(path, {S.lit(T.SIDE_ELEMENT)}) AS kept FROM tree_told"),
    ]


def oracle() -> dict[str, str]:
    def sql(final):
        return S.with_ctes(ctes(), final).replace("WITH ", "WITH RECURSIVE ", 1)
    return {
        "page_tree_blocks": sql("SELECT page_id, run, path, depth, text, chars, CAST(link_chars AS BIGINT) AS link_chars, CAST(parent_chars AS BIGINT) AS parent_chars, "
                                "CAST(parent_link_chars AS BIGINT) AS parent_link_chars, template, kept FROM tree"),
        "page_tree_text": sql("SELECT pg.page_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY run) FILTER (kept), '') AS main_text, "
                              "CAST(coalesce(count(*) FILTER (kept), 0) AS BIGINT) AS n_blocks FROM pg LEFT JOIN tree ON tree.page_id = pg.page_id GROUP BY pg.page_id"),
    }
