"""Pages as element trees: blocks with their tag paths, densities over subtrees, templates by similarity.

A page is a sequence of tags and texts. A fold over it keeps the path of open
elements (name and number of each) and closes it tolerantly: an end tag closes
the last open element of its name with everything in it, one without an open
element is ignored, list items, cells and paragraphs end where the next one
begins, void elements open nothing. A *block* is the text between two block
boundaries; its path ends at the nearest block element.

Three things tell boilerplate: an element that never carries main content in
the path; links that make up most of the block's or its container's text (the
container's numbers are sums over its subtree); and a template, a block that
returns on at least half of a host's pages. Blocks are compared by path and a
similarity hash (least hashes of word pairs, digits alike, in bands), so a date
or a name that changes from page to page does not hide a template.

Everything but the statistics per host happens inside the page's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisible.functions import html as H
from lisible.functions.staged import staged
from lisible.operators.joins import salted_join
from lisible.operators.pages import LINK_DENSITY_MAX, TEMPLATE_MIN_PAGES, TEMPLATE_SHARE
from lisible.session import materialize

# --- fixed values: HTML element names ------------------------------------------------------------------------------
INLINE = ["a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
          "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BREAKS = ["br", "hr"]
#: Elements that end where the next one of their kind begins.
REPEATED = ["dd", "dt", "li", "option", "p", "td", "th", "tr"]
#: Elements whose text is no part of the page.
RAW_TEXT = ["noscript", "script", "style", "template", "textarea"]
#: Elements that carry no main content.
SIDE = ["aside", "footer", "form", "head", "header", "nav"]

RAW = "(?is)<!--.*?-->|" + "|".join(f"<{t}(?:{H.WSC}[^>]*)?>.*?</{t}{H.WSC}*>" for t in RAW_TEXT)
TOKEN = "(<[^>]*>|[^<]+|<)"
NAME = "^</?([A-Za-z][A-Za-z0-9]*)"
ELEMENT = "/[a-z0-9]+:[0-9]+"
LAST_ELEMENT = "/([a-z0-9]+):[0-9]+$"
TRAILING_INLINE = "(/(" + "|".join(INLINE) + "):[0-9]+)+$"
SIDE_ELEMENT = "/(" + "|".join(SIDE) + ")(/|$)"
WORD = "[^ ]+"

#: Least hashes of a block: BANDS times ROWS slices of SLICE hexadecimal digits.
BANDS, ROWS, SLICE = 4, 2, 4


def page_tokens(html: Column) -> Column:
    """Array of ``(k, name, idx, text)``: k is t (text), o/c (inline start and end), O/C (block start and end) or B (a break)."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), RAW, " "), F.lit(TOKEN), 1)

    def token(t, i):
        name = F.lower(F.regexp_extract(t, NAME, 1))
        closing, empty = t.startswith("</"), t.endswith("/>")
        inline, void = name.isin(INLINE), name.isin(VOID)
        k = (F.when(t.startswith("<!") | t.startswith("<?"), F.lit("x")).when(name == "", F.lit("t"))
             .when(name.isin(BREAKS), F.lit("B")).when(void, F.lit("x"))
             .when(empty, F.when(inline, F.lit("x")).otherwise(F.lit("B")))
             .when(inline, F.when(closing, F.lit("c")).otherwise(F.lit("o")))
             .otherwise(F.when(closing, F.lit("C")).otherwise(F.lit("O"))))
        return F.struct(k.alias("k"), name.alias("name"), i.alias("idx"), F.when(k == "t", t).otherwise(F.lit("")).alias("text"))
    return F.filter(F.transform(tokens, token), lambda t: t["k"] != "x")


def fold_blocks(tokens: Column) -> Column:
    """Array of ``(run, path, text, link_chars)``: the blocks of a token sequence in page order, paths with element numbers."""
    block = "struct<run:int,path:string,text:string,link_chars:int>"
    start = F.struct(F.lit("").alias("path"), F.lit(0).alias("run"), F.lit("").alias("at"), F.lit("").alias("text"), F.lit(0).alias("links"),
                     F.array().cast(f"array<{block}>").alias("out"))

    def closed_block(acc):
        one = F.struct(acc["run"].alias("run"), F.regexp_replace(acc["at"], TRAILING_INLINE, "").alias("path"), acc["text"].alias("text"),
                       acc["links"].alias("link_chars"))
        return F.when(H.clean_text(acc["text"]) != "", F.array_append(acc["out"], one)).otherwise(acc["out"])

    def step(acc, t):
        path, k, name = acc["path"], t["k"], t["name"]
        top = F.regexp_extract(path, LAST_ELEMENT, 1)
        ends = (k == "O") & ((top == "p") | ((top == name) & name.isin(REPEATED)))
        base = F.when(ends, F.regexp_replace(path, ELEMENT + "$", "")).otherwise(path)
        mark = F.concat(F.lit("/"), name, F.lit(":"))
        rest = F.call_function("substring_index", path, mark, F.lit(-1))
        closed = F.when(F.call_function("instr", path, mark) > 0, F.substring(path, F.lit(1), F.length(path) - F.length(rest) - F.length(mark))).otherwise(path)
        event, is_text = k.isin("O", "C", "B"), k == "t"
        linked = F.when(path.contains("/a:"), F.length(H.clean_text(t["text"]))).otherwise(F.lit(0))
        return F.struct(
            F.when(k.isin("o", "O"), F.concat(base, mark, t["idx"].cast("string"))).when(k.isin("c", "C"), closed).otherwise(path).alias("path"),
            F.when(event, acc["run"] + 1).otherwise(acc["run"]).alias("run"),
            F.when(is_text & (acc["text"] == ""), path).otherwise(acc["at"]).alias("at"),
            F.when(is_text, F.concat(acc["text"], t["text"])).when(event, F.lit("")).otherwise(acc["text"]).alias("text"),
            F.when(is_text, acc["links"] + linked).when(event, F.lit(0)).otherwise(acc["links"]).alias("links"),
            F.when(event, closed_block(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, start, step, closed_block)


def similarity_keys(path: Column, text: Column) -> Column:
    """One key per band: the path and the least hashes of the block's word pairs, digits taken as one."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit("(" + WORD + ")"), 1)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                                                 lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(words)

    def least(hashes, i):
        return F.array_min(F.transform(hashes, lambda x: F.substring(x, i * SLICE + 1, SLICE)))

    def bands(hashes):
        return F.array(*[F.concat(path, F.lit(f" {b} "), *[least(hashes, b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])
    # an array of one element, so that the hashes are a variable and not computed once for each slice
    return F.transform(F.array(F.transform(pairs, F.md5)), bands)[0]


def page_tree(pages: DataFrame) -> DataFrame:
    """``(page_id, host, blocks)``: per block run, path, depth, text, chars, link_chars, parent_chars, parent_link_chars, keys."""
    df = pages.select("page_id", F.coalesce(H.host(F.col("url")), F.lit("")).alias("host"), "html")
    df = staged(df, _tokens=page_tokens(F.col("html"))).drop("html")
    df = staged(df, _folded=fold_blocks(F.col("_tokens"))).drop("_tokens")
    cleaned = F.transform("_folded", lambda b: F.struct(
        b["run"].alias("run"), b["path"].alias("full"), F.regexp_replace(b["path"], ELEMENT + "$", "").alias("parent"),
        F.regexp_replace(b["path"], ":[0-9]+", "").alias("path"), H.clean_text(b["text"]).alias("text"), b["link_chars"].alias("link_chars")))
    df = staged(df, _clean=cleaned).drop("_folded")
    df = staged(df, _parents=F.array_distinct(F.transform("_clean", lambda b: b["parent"])))

    def total(parent, value):
        inside = F.filter("_clean", lambda b: (b["full"] == parent) | b["full"].startswith(F.concat(parent, F.lit("/"))))
        return F.aggregate(inside, F.lit(0), lambda acc, b: acc + value(b))
    sums = F.transform("_parents", lambda p: F.struct(total(p, lambda b: F.length(b["text"])).alias("chars"),
                                                      total(p, lambda b: b["link_chars"]).alias("links")))
    df = staged(df, _sums=sums)
    df = staged(df, _keys=F.transform("_clean", lambda b: similarity_keys(b["path"], b["text"])))

    def block(b, i):
        own = F.get(F.col("_sums"), F.array_position(F.col("_parents"), b["parent"]).cast("int") - 1)
        return F.struct(b["run"].alias("run"), b["path"].alias("path"), (F.size(F.split(b["path"], "/")) - 1).alias("depth"), b["text"].alias("text"),
                        F.length(b["text"]).alias("chars"), b["link_chars"].alias("link_chars"), own["chars"].alias("parent_chars"),
                        own["links"].alias("parent_link_chars"), F.get(F.col("_keys"), i).alias("keys"))
    return df.select("page_id", "host", F.transform("_clean", block).alias("blocks"))


def template_keys(trees: DataFrame) -> DataFrame:
    """``(host, keys)``: similarity keys found on at least half of the pages of a host with enough pages.

    A page counts once per key; both counts are partial and final aggregates. A
    host has at most about twice as many of them as a page has keys.
    """
    keys = trees.select("host", F.explode(F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["keys"])))).alias("key"))
    per_key = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages > 1")
    per_host = trees.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= TEMPLATE_MIN_PAGES)
    j = salted_join(materialize(per_key, "tree-keys"), per_host, ["host"], salt_from=["key"])
    return j.where(F.col("n_pages") >= F.col("host_pages") * F.lit(TEMPLATE_SHARE)).groupBy("host").agg(F.collect_set("key").alias("template"))


def page_tree_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, run, path, depth, text, chars, link_chars, parent_chars, parent_link_chars, template, kept)`` in page order."""
    trees = materialize(page_tree(pages), "page-trees")
    told = salted_join(trees, template_keys(trees), ["host"], "left", salt_from=["page_id"])
    rows = told.select("page_id", "template", F.explode("blocks").alias("b"))
    template = F.coalesce(F.arrays_overlap("b.keys", "template"), F.lit(False))
    rows = rows.select("page_id", *[f"b.{c}" for c in ("run", "path", "depth", "text", "chars", "link_chars", "parent_chars", "parent_link_chars")],
                       template.alias("template"))
    links = (F.col("link_chars") > F.col("chars") * F.lit(LINK_DENSITY_MAX)) | (F.col("parent_link_chars") > F.col("parent_chars") * F.lit(LINK_DENSITY_MAX))
    return rows.withColumn("kept", ~F.col("template") & ~links & ~F.col("path").rlike(SIDE_ELEMENT))


def page_tree_text(pages: DataFrame) -> DataFrame:
    """``(page_id, main_text, n_blocks)`` of every page: kept blocks, a blank line between."""
    kept = page_tree_blocks(pages).where("kept").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("run", "text"))).alias("b"))
    return pages.select("page_id").join(kept, "page_id", "left").select(
        "page_id", F.coalesce(F.array_join(F.transform("b", lambda x: x["text"]), "\n\n"), F.lit("")).alias("main_text"),
        F.coalesce(F.size("b"), F.lit(0)).cast("bigint").alias("n_blocks"))
