"""Page operators on inline pages: fields, links, images, template blocks."""

from pyspark.sql import functions as F

from lisible.constants import DEFAULT_IMAGE, NO_DESCRIPTION
from lisible.operators import pages as pg


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_fields_fallbacks_and_meta(spark):
    rows = [
        (1, "https://a.example.com/x", '<html><head><title>T &amp; U</title>'
         '<meta name="description" content="Desc &quot;q&quot;"><meta property="og:image" content="/og.png">'
         '</head><body><p>x</p></body></html>'),
        (2, "https://b.example.com/y", "<html><body><p>no title</p></body></html>"),
    ]
    f = {r["page_id"]: r for r in pg.page_fields(_pages(spark, rows)).collect()}
    assert f[1]["title"] == "T & U" and f[1]["description"] == 'Desc "q"' and f[1]["og_image"] == "/og.png"
    assert f[2]["title"] == "b.example.com" and f[2]["description"] == NO_DESCRIPTION and f[2]["og_image"] is None
    compat = {r["page_id"]: r for r in pg.page_fields(_pages(spark, rows), compat=True).collect()}
    assert compat[2]["title"] == "https:"


def test_links_are_absolute_and_ignore_comments(spark):
    html = ('<a href="/z">1</a><a class="k" href=\'../w\'>2</a><a name="n">3</a><!-- <a href="/hidden"> -->'
            '<img src="i.png"><link rel="x" href="//cdn/s.css"><script src="?v=2"></script>')
    got = pg.page_links(_pages(spark, [(7, "https://h.example/a/b/c", html)])).collect()
    out = sorted((r["tag"], r["pos"], r["raw"], r["absolute"]) for r in got)
    assert out == [
        ("a", 0, "/z", "https://h.example/z"),
        ("a", 1, "../w", "https://h.example/a/w"),
        ("img", 0, "i.png", "https://h.example/a/b/i.png"),
        ("link", 0, "//cdn/s.css", "https://cdn/s.css"),
        ("script", 0, "?v=2", "https://h.example/a/b/c?v=2"),
    ]


def test_largest_image_rules(spark):
    html = ('<img src="a.png" width="100%"><img src="b.png" width=" 42 "><img width="500">'
            '<img src="c.png" width="42"><img src="d.png" width="0"><img src="e.png" width="-5">'
            '<img src="f.png">')
    p = _pages(spark, [(1, "https://h.example/", html), (2, "https://h.example/none", "<p>x</p>")])
    sizes = spark.createDataFrame([("https://h.example/d.png", 40), ("https://h.example/f.png", 90)], pg.IMAGE_SIZES_SCHEMA)
    best = {r["page_id"]: (r["src"], r["width"]) for r in pg.largest_image(pg.page_images(p), sizes).collect()}
    # tie 42/42 goes to the first; declared 0 takes the crawled width; no src or width <= 0 skipped
    assert best == {1: ("https://h.example/f.png", 90)}
    best_no_sizes = {r["page_id"]: r["src"] for r in pg.largest_image(pg.page_images(p), None).collect()}
    assert best_no_sizes == {1: "https://h.example/b.png"}
    img = {r["page_id"]: r["image"] for r in pg.page_image(pg.page_fields(p), pg.largest_image(pg.page_images(p), sizes)).collect()}
    assert img == {1: "https://h.example/f.png", 2: DEFAULT_IMAGE}


def test_template_blocks_removed_per_host(spark):
    rows = []
    for i in range(6):
        rows.append((i, f"https://host.example/{i}",
                     f"<body><div>Subscribe to our letter</div><h2>Part {i}</h2><p>Body text number {i}.</p></body>"))
    rows.append((10, "https://other.example/1", "<body><div>Subscribe to our letter</div><p>Alone.</p></body>"))
    main = {r["page_id"]: r["main_text"] for r in pg.page_main_text(_pages(spark, rows)).collect()}
    assert main[0] == "## Part 0\n\nBody text number 0."
    assert main[10] == "Subscribe to our letter\n\nAlone."   # host with fewer than five pages keeps it


def test_noise_elements_and_entities(spark):
    html = ('<html><head><title>x</title><script>var t="</p>";</script></head><body><nav><a href="/a">A</a></nav>'
            '<article><h1>Head</h1><p>One&nbsp;two &lt;b&gt;<br>three</p></article><footer>f</footer></body>')
    main = pg.page_main_text(_pages(spark, [(1, "https://h.example/", html)])).first()["main_text"]
    assert main == "# Head\n\nOne two <b>\n\nthree"


def test_inrow_largest_image_equals_join_path(spark):
    html = ('<img src="a.png" width="100%"><img src="b.png" width=" 42 "><img width="500">'
            '<img src="c.png" width="42"><img src="d.png" width="0"><img src="e.png" width="-5"><img src="f.png">')
    p = _pages(spark, [(1, "https://h.example/", html), (2, "https://h.example/z", "<p>none</p>"),
                       (3, "https://h.example/q", '<img src="/x.png" width="7"><img src="/y.png" width="9">')])
    joined = {r["page_id"]: r["src"] for r in pg.largest_image(pg.page_images(p), None).collect()}
    inrow = {r["page_id"]: r["s"] for r in p.select("page_id", pg.largest_image_src(F.col("html"), F.col("url")).alias("s")).collect()
             if r["s"] is not None}
    assert inrow == joined == {1: "https://h.example/b.png", 3: "https://h.example/y.png"}


def test_page_article_rows_with_crawled_widths(spark):
    body = "<body><h1>Titre</h1><p>Une phrase simple. Une autre phrase.</p>"
    p = _pages(spark, [(1, "https://h.example/a", body + '<img src="/w.png"></body>'),
                       (2, "https://h.example/b", body + '<img src="/v.png" width="10"></body>')])
    sizes = spark.createDataFrame([("https://h.example/w.png", 300)], pg.IMAGE_SIZES_SCHEMA)
    with_sizes = {r["page_id"]: r["image"] for r in pg.page_article_rows(p, sizes).collect()}
    without = {r["page_id"]: r["image"] for r in pg.page_article_rows(p).collect()}
    assert with_sizes == {1: "https://h.example/w.png", 2: "https://h.example/v.png"}
    assert without == {1: DEFAULT_IMAGE, 2: "https://h.example/v.png"}


def test_main_text_keeps_links_images_and_emphasis(spark):
    from lisible.operators.pages import page_main_text
    html = ("<body><p>See <a href='/x?a=1&amp;b=2'>the <b>page</b></a>, <img src=a.png alt='An image'> and <em> more </em> here.</p>"
            "<p><a name=\"n\">anchor</a> with <a href=\"y\"></a> nothing <img alt=\"no source\"> else <b></b>.</p><a href='z'><p>Split link.</p></a></body>")
    rows = [(1, "http://h.example/d/p.html", html), (2, None, "<p>No url <a href='x'>y</a> at all, really.</p>"), (3, "http://h.example/", None), (4, "http://h.example/", " ")]
    got = {r["page_id"]: r for r in page_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["main_text"].split("\n\n") == [
        "See [the **page**](http://h.example/x?a=1&b=2), ![An image](http://h.example/d/a.png) and *more* here.",
        "anchor with nothing else .", "Split link."]
    assert got[2]["n_blocks"] == 1 and got[3]["n_blocks"] == got[4]["n_blocks"] == 0


def test_accepted_and_rejected_pages_are_all_pages(spark):
    from lisible.operators.pages import page_article_status
    rows = [(1, "http://h.example/a", "<p>A sentence here.</p>"), (2, "http://h.example/b", None), (3, None, "\n "), (4, None, "<script>x</script>"),
            (5, "u", "<p>" + "long " * 3000 + "</p>"), (6, "text", "<p>Fine.</p>")]
    got = {r["page_id"]: r["reason"] for r in page_article_status(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: None, 2: "fetch_failed", 3: "fetch_failed", 4: "no_main_text", 5: "no_sentence", 6: None}


def test_pasted_texts_and_missing_urls_are_no_duplicates(spark):
    from lisible.operators.catalog import new_urls
    batch = spark.createDataFrame([(1, "text"), (2, "text"), (3, None), (4, None), (5, "http://a"), (6, "http://a"), (7, "http://b")], "page_id long, url string")
    known = spark.createDataFrame([("http://b",), ("text",), (None,)], "url string")
    assert sorted(r["page_id"] for r in new_urls(batch, known).collect()) == [1, 2, 3, 4, 5]


def test_private_use_characters_of_icon_fonts_come_back(spark):
    from lisible.functions.markdown import relocate_images
    from lisible.operators.pages import page_main_text
    icons = "a\ue000b\ue002c\ue003d\ue001e\ue000\ue002f\ue004g"
    pages = spark.createDataFrame([(1, "http://h.example/", f"<h2>{icons}</h2><p>{icons} <a href='/x'>{icons}</a> and more words around it</p>")], "page_id long, url string, html string")
    out = page_main_text(pages).select(F.col("main_text"), relocate_images(F.col("main_text")).alias("moved")).first()
    assert out["main_text"] == f"## {icons}\n\n{icons} [{icons}](http://h.example/x) and more words around it"
    assert icons in out["moved"] and out["moved"].count("\ue004") == 3
