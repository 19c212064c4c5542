"""Element trees: nesting, unclosed tags, densities, templates whose dates change."""

import re

import pytest

from lisible.operators import page_tree as T


def blocks(spark, *pages):
    df = spark.createDataFrame([(i, f"https://h.example/{i}", h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    return sorted(T.page_tree_blocks(df).collect(), key=lambda r: (r["page_id"], r["run"]))


def short(rows):
    return [(r["path"], r["depth"], r["text"]) for r in rows]


def test_nested_and_unclosed_tags(spark):
    got = short(blocks(spark, "<!DOCTYPE html><body><div>one<div><p>two <b>bold<i>both</b> three<p>four</div>five</DIV></nosuch>six<br>seven</body>"))
    assert got == [("/body/div", 2, "one"), ("/body/div/div/p", 4, "two bold both three".replace("bold both", "boldboth")), ("/body/div/div/p", 4, "four"),
                   ("/body/div", 2, "five"), ("/body", 1, "six"), ("/body", 1, "seven")]


def test_lists_tables_and_implied_ends(spark):
    got = short(blocks(spark, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><p>h<div>i</div>"))
    assert [(p, t) for p, _, t in got] == [("/ul/li", "a"), ("/ul/li", "b"), ("/ul/li/ul/li", "c"), ("/ul/li", "d"),
                                           ("/table/tr/td", "e"), ("/table/tr/td", "f"), ("/table/tr/td/tr/td", "g"), ("/p", "h"), ("/div", "i")]


def test_raw_text_comments_void_and_empty_elements(spark):
    got = short(blocks(spark, "<p>a<script>if (a<b) '<p>x'</script><!-- <p>no --><img src=x>b<hr>c<section/>d</p> 1 < 2 <style>p {}</style>", None, "", " <p> </p>"))
    assert got == [("/p", 1, "a b"), ("/p", 1, "c"), ("/p", 1, "d"), ("", 0, "1 < 2")]


def test_sums_over_the_container(spark):
    rows = blocks(spark, "<div><p>12345</p><ul><li><a href=x>abc</a></li><li>de</li></ul></div>")
    assert [(r["text"], r["chars"], r["link_chars"], r["parent_chars"], r["parent_link_chars"], r["kept"]) for r in rows] == [
        ("12345", 5, 0, 10, 3, True), ("abc", 3, 3, 5, 3, False), ("de", 2, 0, 5, 3, False)]


def test_side_elements_are_left_out_with_all_in_them(spark):
    rows = blocks(spark, "<nav><div>menu</div></nav><main><p>text</p></main><footer><p>end</p></footer><navy><p>more</p></navy>")
    assert [(r["text"], r["kept"]) for r in rows] == [("menu", False), ("text", True), ("end", False), ("more", True)]


def test_templates_are_found_though_dates_change(spark):
    own = ["the quick brown fox", "a lazy dog sleeps here", "seven cats on the roof", "rain falls over the old town", "she reads a long letter", "nobody came at all"]
    pages = [f"<body><p>Published on {3 * i + 1} May 20{10 + i} by the editors of this small page</p><div><p>{t} today</p></div></body>" for i, t in enumerate(own)]
    rows = blocks(spark, *pages)
    assert {r["template"] for r in rows if r["text"].startswith("Published")} == {True}
    assert {r["template"] for r in rows if r["text"].endswith("today")} == {False}
    few = blocks(spark, *pages[:4])
    assert not any(r["template"] for r in few)


def plain(html):
    """(run, path, text) of the blocks by a stack."""
    html = re.sub(T.RAW, " ", html or "")
    stack, run, held, out = [], 0, [], []

    def flush():
        text = re.sub("<[^>]*>", " ", "".join(t for _, t in held))
        text = re.sub(r"[ \t\n\r]+", " ", text.replace("&amp;", "&")).strip(" ")
        if text:
            path = held[0][0]
            while path and path[-1] in T.INLINE:
                path = path[:-1]
            out.append((run, "".join("/" + n for n in path), text))
        held.clear()

    for tok in re.findall(r"<[^>]*>|[^<]+|<", html):
        name = (re.match(r"</?([A-Za-z][A-Za-z0-9]*)", tok) or [None, ""])[1].lower()
        if tok.startswith(("<!", "<?")):
            continue
        if not name:
            held.append((tuple(stack), tok))
            continue
        if name in T.VOID or tok.endswith("/>"):
            if name in T.BREAKS or (name not in T.VOID and name not in T.INLINE):
                flush()
                run += 1
            continue
        if name not in T.INLINE:
            flush()
            run += 1
        if tok.startswith("</"):
            if name in stack:
                while stack.pop() != name:
                    pass
        else:
            if name not in T.INLINE and stack and (stack[-1] == "p" or stack[-1] == name and name in T.REPEATED):
                stack.pop()
            stack.append(name)
    flush()
    return out


def test_given_pages_equal_a_plain_stack(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    rows = blocks(spark, *pages)
    got = {}
    for r in rows:
        got.setdefault(r["page_id"], []).append((r["run"], r["path"], r["text"]))
    clean = lambda t: t.replace("&copy;", "©").replace("&middot;", "·")
    assert got == {i: [(a, b, clean(c)) for a, b, c in plain(h)] for i, h in enumerate(pages) if plain(h)}


@pytest.mark.parametrize("html", ["<", "<>", "</p>", "<p", "<a><div></a>x</div>", "<b>x<p>y</b>z", "<p/><p>q", "&lt;p&gt;"])
def test_broken_pages_do_not_fail(spark, html):
    assert all(r["chars"] > 0 for r in blocks(spark, html))


def test_text_of_every_page(spark):
    df = spark.createDataFrame([(1, "https://h.example/", "<p>a</p><p>b</p>"), (2, None, None)], "page_id bigint, url string, html string")
    assert sorted(tuple(r) for r in T.page_tree_text(df).collect()) == [(1, "a\n\nb", 2), (2, "", 0)]
