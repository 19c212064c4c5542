"""HTML to fields and blocks with engine-neutral regular expressions.

No DOM: pages are treated as text; elements that never carry main content
are cut out, block-level tags become block boundaries, inline tags are
dropped. Patterns use explicit classes and lazy quantifiers only, so
Spark (Java regex) and the SQL oracle (RE2) produce the same strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lisible.functions.text import ESCAPE, ESCAPED
from lisible.functions.urls import resolve

WSC = "[ \\t\\n\\r]"

# --- fixed values: named entities decoded (``&amp;`` last) --------------------
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]

# elements removed with their content
NOISE_TAGS = ["script", "style", "noscript", "template", "header", "head", "nav", "footer", "aside", "form"]
# tags turned into block boundaries
BLOCK_TAGS = ["p", "div", "li", "ul", "ol", "article", "section", "main", "blockquote", "pre", "table",
              "tr", "td", "th", "figure", "figcaption", "h[1-6]", "br", "hr", "dl", "dt", "dd", "body", "html"]

# marks of two characters behind an escape character that is itself escaped in the page (see functions.text)
BLOCK_MARK = ESCAPE + "\ue002"
HEADING_MARK = ESCAPE + "\ue003"


def _open(tag: str) -> str:
    return "<" + tag + "(?:" + WSC + "[^>]*)?/?>"


NOISE = "(?is)<!--.*?-->|" + "|".join(_open(t) + ".*?</" + t + WSC + "*>" for t in NOISE_TAGS)
HEADING_OPEN = "(?i)<h([1-6])(?:" + WSC + "[^>]*)?>"
BLOCK_TAG = "(?i)</?(?:" + "|".join(BLOCK_TAGS) + ")(?:" + WSC + "[^>]*)?/?>"
TAG = "<[^>]*>"
WS_RUN = WSC + "+"
TRIM = "^" + WSC + "+|" + WSC + "+$"
LINK_TEXT = "(?is)<a(?:" + WSC + "[^>]*)?>(.*?)</a" + WSC + "*>"
TITLE = "(?is)<title(?:" + WSC + "[^>]*)?>(.*?)</title" + WSC + "*>"
H1 = "(?is)<h1(?:" + WSC + "[^>]*)?>(.*?)</h1" + WSC + "*>"
META_TEMPLATE = "(?is)<meta" + WSC + "[^>]*(?:name|property)" + WSC + "*=" + WSC + "*[\"'](?:%s)[\"'][^>]*>"
META_DESCRIPTION = META_TEMPLATE % "description|og:description"
META_IMAGE = META_TEMPLATE % "og:image"
LINK_CLOSE = "</a" + WSC + "*>"
LINK_INNER = "(?is)^(.*?)" + LINK_CLOSE
# emphasis around plain text; its ends keep their blanks outside the marks
BOLD = "(?i)<(?:b|strong)(?:" + WSC + "[^>]*)?>" + WSC + "*([^< \\t\\n\\r](?:[^<]*[^< \\t\\n\\r])?)" + WSC + "*</(?:b|strong)" + WSC + "*>"
ITALIC = "(?i)<(?:i|em)(?:" + WSC + "[^>]*)?>" + WSC + "*([^< \\t\\n\\r](?:[^<]*[^< \\t\\n\\r])?)" + WSC + "*</(?:i|em)" + WSC + "*>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"

# link-bearing tags and their URL attribute
LINK_TAGS = [("a", "href"), ("img", "src"), ("link", "href"), ("script", "src")]


def tag_pattern(tag: str) -> str:
    return "(?is)<" + tag + WSC + "[^>]*>"


def has_attr_pattern(attr: str) -> str:
    return "(?is)" + WSC + attr + WSC + "*="


def attr_pattern(attr: str) -> str:
    return "(?is)" + WSC + attr + WSC + "*=" + WSC + "*(\"[^\"]*\"|'[^']*'|[^ \\t\\n\\r>\"']*)"


def unescape(c: Column) -> Column:
    for k, v in ENTITIES:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def clean_text(c: Column) -> Column:
    """Tags dropped, entities decoded, whitespace runs collapsed, trimmed."""
    c = F.regexp_replace(c, TAG, " ")
    c = unescape(c)
    c = F.regexp_replace(c, WS_RUN, " ")
    return F.regexp_replace(c, TRIM, "")


def attr_value(tag: Column, attr: str) -> Column:
    """Value of ``attr`` in one tag (quotes removed, entities decoded); null if absent."""
    def unquoted(x):
        raw = x["raw"]
        quoted = raw.startswith('"') | raw.startswith("'")
        val = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(x["there"], unescape(val))
    # a lambda over an array of one element: the pattern runs once, however often its match is read
    return F.transform(F.array(F.struct(F.regexp_extract(tag, attr_pattern(attr), 1).alias("raw"), tag.rlike(has_attr_pattern(attr)).alias("there"))), unquoted)[0]


def meta_content(html: Column, pattern: str) -> Column:
    tag = F.regexp_extract(html, pattern, 0)
    return F.nullif(clean_text(F.coalesce(attr_value(tag, "content"), F.lit(""))), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def page_title_raw(html: Column) -> Column:
    t = F.nullif(clean_text(F.regexp_extract(html, TITLE, 1)), F.lit(""))
    h1 = F.nullif(clean_text(F.regexp_extract(html, H1, 1)), F.lit(""))
    return F.coalesce(t, h1)


def _rewrite_tags(c: Column, tag: str, rewrite) -> Column:
    """``rewrite(tag, text up to the next such tag)`` in place of each tag and the text that follows it."""
    parts = F.split(c, tag_pattern(tag), -1)
    tags = F.regexp_extract_all(c, F.lit(tag_pattern(tag)), 0)
    return F.concat(parts[0], F.array_join(F.zip_with(tags, F.slice(parts, F.lit(2), F.size(parts)), rewrite), ""))


def images_to_markdown(c: Column, url: Column) -> Column:
    """``<img>`` tags become Markdown images in place, alt text kept, source absolute; any quoting of attributes."""
    def image(t, rest):
        one = F.array(F.struct(resolve(url, attr_value(t, "src")).alias("src"), F.coalesce(attr_value(t, "alt"), F.lit("")).alias("alt")))
        return F.concat(F.transform(one, lambda x: F.when(x["src"].isNull(), F.lit(" ")).otherwise(
            F.concat(F.lit(" !["), x["alt"], F.lit("]("), x["src"], F.lit(") "))))[0], rest)
    return _rewrite_tags(c, "img", image)


def links_to_markdown(c: Column, url: Column) -> Column:
    """``<a href>`` with a text inside the block becomes ``[text](absolute url)``; others stay as they are."""
    def link(t, rest):
        inner = F.regexp_replace(F.regexp_extract(rest, LINK_INNER, 1), TRIM, "")
        one = F.array(F.struct(resolve(url, attr_value(t, "href")).alias("target"), inner.alias("inner")))
        return F.transform(one, lambda x: F.when(x["target"].isNotNull() & (clean_text(x["inner"]) != ""), F.concat(
            F.lit("["), x["inner"], F.lit("]("), x["target"], F.lit(")"), F.regexp_replace(rest, LINK_INNER, ""))).otherwise(rest))[0]
    return _rewrite_tags(c, "a", link)


def emphasis_to_markdown(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, BOLD, "**$1**"), ITALIC, "*$1*")


def escape_marks(c: Column) -> Column:
    return F.replace(c, F.lit(ESCAPE), F.lit(ESCAPED))


def unescape_marks(c: Column) -> Column:
    return F.replace(c, F.lit(ESCAPED), F.lit(ESCAPE))


def block_html(body: Column) -> Column:
    """array<string>: raw HTML of each block of a page body without noise, in page order (heading level marked)."""
    body = F.regexp_replace(body, HEADING_OPEN, BLOCK_MARK + "$1" + HEADING_MARK)
    body = F.regexp_replace(body, BLOCK_TAG, BLOCK_MARK)
    return F.split(body, BLOCK_MARK)
