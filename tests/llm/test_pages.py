from letterlens.llm.extract import main_text

SCHEMA = "page_id long, url string, html string, text string, page string, host string, places string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], SCHEMA).repartition(3)


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in main_text(pages(spark, rows), **options).collect()}


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><a href="/">Home</a></nav><main><div class=cookie-notice>We use cookies</div><article class="post"><h1>Fish &amp; chips</h1>
<p>One <script>a("</p>")</script>two&nbsp;\n three<span class="ad-slot">AD</span><p>Four &lt;5&gt; &#233;<form><input>send</form>
<section id="comments"><article class=comment><p>nice</p></article></section><ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table>
<!-- no --><div hidden>gone</div><pre> x
 y</pre></article><div>beside</div></main><aside>side</aside><footer>&copy; us</footer></body></html>"""


def test_article(spark):
    got = texts(spark, [(1, "http://h/1", ARTICLE), (2, None, None), (3, "http://h/3", ""), (4, "", "only text < 5 & more")])
    assert got[1] == "Fish & chips\nOne two three\nFour <5> é\na\nb\nc1\nc2\nx y"
    assert (got[2], got[3], got[4]) == ("", "", "only text < 5 & more")


def test_shared_article_text_stays(spark):
    body = "<article><p>" + " ".join(f"w{i}" for i in range(60)) + "</p><p>own {}</p></article>"
    got = texts(spark, [(i, f"http://h/{i}", body.format(i)) for i in range(6)])
    assert all(text.startswith("w0 w1") and text.endswith(f"own {i}") for i, text in got.items())


def test_repeated_runs_go_where_no_article_is_marked(spark):
    line = "<div>All rights reserved by the owners of this fine site since ever</div>"
    rows = [(i, f"http://H.example/{i}", f"<body>{line}<p>{' '.join(f'p{i}x{j}' for j in range(30))}</p>{line}</body>") for i in range(5)]
    rows += [(50 + i, "http://copy.example/", "<p>the very same page twice over as it was before and again</p>") for i in range(2)]
    rows += [(60, "http://lone.example/", line), (61, None, line), (62, "http://big.example/", "<p>" + "word " * 60_000 + "</p>")]
    got = texts(spark, rows)
    assert all(got[i] == " ".join(f"p{i}x{j}" for j in range(30)) for i in range(5))
    assert got[50] == got[51] == "the very same page twice over as it was before and again"
    assert got[60].startswith("All rights") and got[61].startswith("All rights") and got[62] == ("word " * 60_000).strip()


def test_one_template_of_a_large_host(spark):
    """Boilerplate of a few of a host's pages goes as it would on a small host."""
    notice = "<div>This part of the site is kept by its {} readers and friends only</div>"
    own = lambda i: " ".join(f"p{i}x{j}" for j in range(30))
    names = ["first", "second", "third", "fourth", "fifth"]
    rows = [(i, f"http://large/{i}", f"<body><p>{own(i)}</p>{notice.format(names[i % 5])}</body>") for i in range(60)]
    rows += [(60 + i, f"http://large/{60 + i}", f"<body><p>{own(60 + i)}</p>{notice.format('sixth')}</body>") for i in range(2)]
    rows += [(62 + i, "http://large/twice", f"<body><p>{own(62)}</p>{notice.format('lone')}</body>") for i in range(2)]
    got = texts(spark, rows)
    assert all(got[i] == own(i) for i in range(62))
    assert got[62] == got[63] == f"{own(62)}\nThis part of the site is kept by its lone readers and friends only"


def test_one_text_at_several_addresses(spark):
    """Near-equal pages are one page: their text stays whole, and what they share with others goes."""
    line = "<div>All rights reserved by the owners of this fine site since ever</div>"
    words = lambda i: " ".join(f"p{i}x{j}" for j in range(200))
    view = "<body>{}<p>{}</p><p>This page was viewed {} times until now by all of its readers</p></body>"
    rows = [(i, f"http://twice/{i}", f"<body><p>{words(0)}</p><p>This page was viewed {i} times</p></body>") for i in range(2)]
    rows += [(10 + i, f"http://many/{i}", view.format(line, words(i // 3), f"{i} or {i}1")) for i in range(9)]
    got = texts(spark, rows)
    assert all(got[i] == f"{words(0)}\nThis page was viewed {i} times" for i in range(2))
    assert all(got[10 + i].startswith(words(i // 3)) for i in range(9))


def test_wrappers_of_the_article(spark):
    article = "<article><p>the text</p></article>"
    whole = [
        f'<div class="content has-sidebar">{article}</div><div class="sidebar">side</div>', f'<form id="aspnetForm">{article}</form>',
        f'<div class="widget-area">{article}</div>', '<article class="post comments-open"><p>the text</p></article>',
        '<form><h1>the text</h1></form>', '<article><section id="related-work"><p>the text</p></section></article>',
        f'<p>the text</p><div class="siteFooter">foot</div><form><p>fill in</p></form><div class="related-posts">{article}</div>',
        f'<p>the text</p><div class="sidebar"><article>teaser</article></div><div id="reader-comments">{article}</div>',
        '<article><p>the text</p><div class="user-comments"><article>nice</article></div><form><p>send</p></form></article>',
    ]
    got = texts(spark, [(i, f"http://h{i}/", page) for i, page in enumerate(whole)])
    assert got == {i: "the text" for i in range(len(whole))}


def test_columns_and_empty_table(spark):
    out = main_text(pages(spark, [(1, "http://h", "<p>a</p>"), (1, "http://h", "<p>a</p>")]))
    assert sorted(out.columns) == sorted([*pages(spark, []).columns, "n_blocks", "n_dropped"])
    assert [r.text for r in out.collect()] == ["a", "a"]
    assert main_text(pages(spark, [])).count() == 0
