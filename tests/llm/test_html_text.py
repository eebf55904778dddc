"""Main text of hand-made pages, and site templates."""

from girder.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use</div><nav><ul><li><a href="/">x</a></ul></nav><div class="ad">Buy</div>
<article><h1>One &amp; two</h1><p>first<br>line &#233;<p>second <b>bold<p>third</b>\n  end<ul><li>a<li>b</ul><form>f</form><div class="comments"><p>me!</p></div>
<table><tr><td>1<td>2</table></article><aside>more</aside><footer>&copy; me</footer></body>"""


def text(page):
    return "\n".join(ht.blocks(*ht.main_parts(ht.parse(page)), ()))


def test_main_text():
    assert text(PAGE) == "One & two\nfirst line é\nsecond bold\nthird end\na\nb\n1\n2"
    assert text("") == "" and text("a < b <p>c <i") == "a < b\nc"
    assert text("<div>" * 20000 + "deep") == "deep"
    assert text('<body><div id="content"><p>x</p></div><div id="sidebar"><p>y</p></div></body>') == "x"


def test_templates_go_and_copied_articles_stay(spark):
    rows = []
    for k in range(10):
        rows.append((k, f"https://a.example.com/{k}", f"<body><div><p>Sign our list</p><span>now</span></div><div><p>text number {k}</p><p>own words {k * 7}</p></div></body>"))
        rows.append((100 + k, f"http://B.example.com:80/{k}", "<body><article><p>the same</p><div><p>copied</p></div></article></body>"))
    rows += [(200, None, None), (201, "odd", "<p>x</p>"), (201, "odd", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, templates int")
    got = ht.extract(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert all(by[k].text == f"text number {k}\nown words {k * 7}" for k in range(10))
    assert all(by[100 + k].text == "the same\ncopied" and by[100 + k].n_chars == 15 for k in range(10))
    assert by[200].text == "" and by[201].text == "x"
    assert ht.extract(pages.limit(0)).count() == 0


def test_templates_inside_articles_go(spark):
    own = "<p>own <b>Note</b> words {0} of this page</p><table><tr><td>Yes</td><td>{0}</td></tr></table>"
    page = "<body><article><h1>Title {0}</h1><p>Sign our letter</p>" + own + "<ul><li>Offer of the day<li>item {0}</ul></article></body>"
    pages = spark.createDataFrame([(k, "https://a.example.com/", page.format(k)) for k in range(8)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ht.extract(pages).collect()}
    assert all(got[k] == f"Title {k}\nown Note words {k} of this page\nYes\n{k}\nitem {k}" for k in range(8))


def test_nothing_else_is_lost():
    assert text("<body><article class='card'>teaser</article><div class='content'>a long text</div></body>") == "teaser\na long text"
    assert text("<body><aside><article>teaser</article></aside><div>the text</div></body>") == "the text"
    assert text("<main><h1>head</h1><article>one</article><p>end</p></main>") == "head\none\nend"
    assert text("<main>a</main><div role=main>b</div><main>c</main>") == "a\nb\nc"
    assert text("<div class='content'>first part</div><div class='content'>second</div>") == "first part\nsecond"
    assert text("<form><article>kept</article></form><div class='with-nav'><main>too</main></div>") == "kept\ntoo"


def test_names_alone_drop_no_large_part():
    for name in ("has-sidebar", "no-sidebar", "right-rail", "comments-open", "sidebar"):
        assert text(f"<body class='{name}'><p>some text</p></body>") == "some text"
    for tag, name in (("div", "share-price"), ("p", "alert-level"), ("section", "related-work")):
        assert text(f"<article><p>a</p><{tag} class='{name}'>kept</{tag}></article>") == "a\nkept"
    long = "words of the text " * 30
    assert text(f"<div class='widget'>{long}</div>") == long.strip()
    assert text(f"<p>{long}</p><div class='widget'>short</div><div class='sidebar'>{'<a>link to it</a> ' * 40}</div>") == long.strip()
