from ragloom.functions.html import parse_page
from ragloom.operators import web

PAGE = """<!DOCTYPE html><html><head><title>Main &amp; Co</title><style>p{x}</style></head>
<body><header>Top bar</header><nav><a href="/nav-target-page">Navigation link</a></nav>
<!-- c1 -->before<!-- c2 -->after &copy; here
<div>Two  spaces   here<footer>foot<b>bold</b></footer></div>
<a href="/articles/one">Read article one</a>
<a href="https://other.example.com/x">Other host article</a>
<a href="http://site.example.com:8080/y">Port differs link</a>
<a href="/articles/one#frag">Read article one again</a>
<a href="#top">Back to top link</a><a href="mailto:a@b.c">Mail us today</a>
<a href="javascript:void(0)">Script link text</a><a href="">Empty href link</a>
<a href="/about/team">Our team page</a><a href="/articles/two">Contact sales now</a>
<a href="/articles/one">Read article one</a><a href="relative/page">Relative page link</a>
<a href="/short">short</a><a href="/self">Self reference</a>
</body></html>"""
BASE = "http://site.example.com/dir/index.html"


def test_parse_page_text_title_links():
    p = parse_page(PAGE, BASE)
    assert p["title"] == "Main & Co"
    nodes = p["text"].split("\n")
    assert "Top bar" not in p["text"] and "foot" not in p["text"] and "bold" not in p["text"]
    assert "Navigation link" not in p["text"] and "p{x}" not in p["text"]
    assert "before" in nodes and "after © here" in nodes  # comments split nodes, entities do not
    hrefs = [link["href"] for link in p["links"]]
    assert hrefs[0] == "/nav-target-page"  # links are collected before nav removal
    assert p["links"][1]["abs_url"] == "http://site.example.com/articles/one"
    rel = [link for link in p["links"] if link["href"] == "relative/page"][0]
    assert rel["abs_url"] == "http://site.example.com/dir/relative/page"


def test_title_variants():
    assert parse_page("<html><body>x</body></html>", BASE)["title"] is None
    assert parse_page("<title></title>", BASE)["title"] is None
    assert parse_page("<title>a<b>c</b></title>", BASE)["title"] in (None, "a<b>c</b>")
    assert parse_page("<p>unclosed <b>bold <i>it", BASE)["text"].split("\n") == ["unclosed ", "bold ", "it"]


def test_link_rules_and_order(spark):
    pages = spark.createDataFrame([(1, BASE, PAGE)], "page_id long, url string, html string")
    parsed = web.parsed_pages(pages)
    links = [r.url for r in web.page_links(parsed).orderBy("pos").collect()]
    assert links == [
        "http://site.example.com/nav-target-page",
        "http://site.example.com/articles/one",
        "http://site.example.com/articles/one#frag",
        "http://site.example.com/dir/relative/page",
        "http://site.example.com/self",
    ]
    capped = [r.url for r in web.page_links(parsed, 3).orderBy("pos").collect()]
    assert capped == links[:3]
    text = parsed.first().text
    assert "Two\nspaces\nhere" in text


def test_linked_pages_join(spark):
    rows = [
        (1, "http://h.example.com/a", "<title>A</title><p>alpha</p><a href='/b'>Go to page bee</a>"
                                      "<a href='/c#x'>Go to page cee</a><a href='/missing'>Missing page</a>"),
        (2, "http://h.example.com/b", "<title>B</title><p>bravo</p>"),
        (3, "http://h.example.com/c", "<title>C</title><p>charlie</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = web.parsed_pages(pages)
    out = {r.page_id: r for r in web.pages_with_links(parsed).collect()}
    a = out[1]
    assert a.includes_linked_content and a.linked_pages_count == 2
    assert a.text == ("A\nalpha\nGo to page bee\nGo to page cee\nMissing page"
                      "\n\n--- LINKED CONTENT ---\n\n"
                      "--- Content from B (http://h.example.com/b) ---\n\nB\nbravo\n\n"
                      "\n--- Content from C (http://h.example.com/c#x) ---\n\nC\ncharlie\n\n")
    assert not out[2].includes_linked_content and out[2].linked_pages_count == 0
    # the cap applies before the lookup: with one link allowed only B is joined
    assert {r.page_id: r.linked_pages_count for r in web.pages_with_links(parsed, 1).collect()}[1] == 1


def test_page_metadata_precedence(spark):
    pages = spark.createDataFrame([(1, "http://u:p@h.example.com:81/x", "<p>no title</p>")],
                                  "page_id long, url string, html string")
    parsed = web.parsed_pages(pages)
    m = web.page_metadata(parsed, {"folder_name": "F", "source": "ignored"}).first()
    assert m.domain == "u:p@h.example.com:81" and m.title == "Untitled"
    assert m.document_name == "Untitled" and m.source == "http://u:p@h.example.com:81/x"
    assert m.metadata["folder_name"] == "F" and m.source_type == "web"
    named = web.page_metadata(parsed, {"document_name": "Mine"}).first()
    assert named.document_name == "Mine"


def test_url_batch_receipts(spark):
    pages = spark.createDataFrame([(1, "http://h.example.com/a", "<p>x</p>"), (2, "http://h.example.com/e", "")],
                                  "page_id long, url string, html string")
    urls = spark.createDataFrame([("http://h.example.com/a",), ("http://h.example.com/e",),
                                  ("http://nowhere.example.com/",)], "url string")
    got = {r.url: r for r in web.url_batch(urls, web.parsed_pages(pages)).collect()}
    assert got["http://h.example.com/a"].status == "success" and got["http://h.example.com/a"].chunks == 1
    assert got["http://h.example.com/e"].chunks == 1  # placeholder text
    assert got["http://nowhere.example.com/"].status == "error"


def test_content_type_dispatch(spark):
    rows = [(1, "http://h.example.com/a", "<title>A</title><a href='/doc.pdf'>The pdf document</a>"
                                          "<a href='/b'>Page bee link</a>", "text/html; charset=utf-8"),
            (2, "http://h.example.com/doc.pdf", "%PDF-1.4", "application/pdf"),
            (3, "http://h.example.com/b", "<title>B</title><p>bee</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, content_type string")
    parsed = web.parsed_pages(pages)
    a = {r.page_id: r for r in web.pages_with_links(parsed).collect()}[1]
    assert a.linked_pages_count == 1 and "Content from B" in a.text  # the PDF target is skipped
    urls = pages.select("url")
    got = {r.url: r for r in web.url_batch(urls, parsed).collect()}
    assert got["http://h.example.com/doc.pdf"].status == "error"
    assert "PDF" in got["http://h.example.com/doc.pdf"].error
    assert got["http://h.example.com/b"].status == "success"
    meta = {r.page_id: r.content_type for r in web.page_metadata(parsed).collect()}
    assert meta == {1: "html", 2: "pdf", 3: "html"}


def test_one_target_per_url_and_fragment_receipts(spark):
    from ragloom.operators import web

    link = '<a href="/b">the other page</a>'
    rows = [(1, "http://h/a", f"<title>A</title><p>text a</p>{link}"), (2, "http://h/b#x", "<title>B</title><p>late</p>"),
            (0, "http://h/b", "<title>B</title><p>text b</p>")]
    parsed = web.parsed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    page = web.pages_with_links(parsed).where("page_id = 1").first()
    assert page.linked_pages_count == 1 and "text b" in page.text and "late" not in page.text
    urls = spark.createDataFrame([("http://h/b#sec",), ("http://h/none",)], "url string")
    got = {r.url: r.status for r in web.url_batch(urls, parsed).collect()}
    assert got == {"http://h/b#sec": "success", "http://h/none": "error"}


def test_parser_error_becomes_a_receipt(spark, monkeypatch):
    from ragloom.functions import html

    assert html.parse_page("<p>x</p>", "http://h/")["error"] is None
    monkeypatch.setattr(html._PageParser, "finish", lambda self: 1 / 0)
    assert html.parse_page("<p>x</p>", "http://h/")["error"].startswith("ZeroDivisionError")


def test_pages_are_parsed_block_by_block(monkeypatch):
    import pyarrow as pa

    from ragloom.functions import html

    parsed, parse = [], html.parse_page
    monkeypatch.setattr(html, "parse_page", lambda h, u: (parsed.append(u), parse(h, u))[1])
    pages = [None, PAGE, "<p>é</p>" + "x" * (html.BLOCK_BYTES + 1), "", PAGE] + ["<p>" + "y" * 100_000 for _ in range(40)]
    urls = [f"{BASE}?{i}" for i in range(len(pages))]
    out = html._parse_batches(iter([(pa.array(pages), pa.array(urls)), (pa.array([], pa.string()), pa.array([], pa.string()))]))
    got = next(out).to_pylist()
    assert len(got) == len(parsed) == 2         # no page of the second block is touched yet
    got += [r for block in out for r in block.to_pylist()]
    assert got == [parse(h, u) for h, u in zip(pages, urls)]


def test_link_targets_with_repeated_and_null_page_ids(spark):
    cols = "page_id long, url string, content_type string, title string, text string, parse_error string"
    pages = spark.createDataFrame([(7, "http://a/x#1", None, "T", "low", None), (7, "http://a/x", None, "T", "low again", None),
                                   (9, "http://a/x", None, "T", "high", None), (None, "http://a/y", None, "T", "no id", None)], cols)
    links = spark.createDataFrame([(1, 0, "http://a/x#2"), (1, 1, "http://a/y"), (2, 0, "http://a/z")], "page_id long, pos long, url string")
    out = web.linked_content(pages, links=links, materialized=True)
    assert sorted(r.block for r in out.collect()) == [f"--- Content from T (http://a/x#2) ---\n\n{t}\n\n" for t in ("low", "low again")]
