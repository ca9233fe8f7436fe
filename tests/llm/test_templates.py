from oddlog.llm import templates

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><script>var t="</p><article>x</article>";</script></head><body>'
    '<nav><ul>{nav}</ul></nav><!-- ad <p>no</p> --><div class="top-ad">Buy</div><article class="post"><header><h1>Head  line</h1></header>'
    "<p>One &amp; two&nbsp;<b>bold<br>next<p>{body}</p><form><p>Subscribe</p></form><div class='comments'><p>First!</p></div></article>"
    "<aside>Aside</aside><footer>&copy; {host}</footer>"
)


def page(i):
    nav = "".join(f"<li><a href='/{j}'>n{j}</a></li>" for j in range(1 + i % 3))
    return PAGE.format(nav=nav, body=f"Body {i} &lt;x&gt;", host="h")


def test_text_of_a_page():
    want = "Head line\nOne & two bold next\nBody 7 <x>"
    assert templates.main_text(page(7), "html/body/article.post") == want
    assert templates.main_text(page(7), None) == want  # judged on its own
    assert templates.main_text(page(7), "html/body/no.such") == want


def test_odd_markup():
    own = templates.main_text
    assert own("", None) == "" and own("just  text\n &amp", None) == "just text &"
    assert own("<p>a<p>b<div>c</p>d<ul><li>e<li>f</ul>", None).split("\n") == ["a", "b", "c", "d", "e", "f"]
    assert own('<main><p title="a > b">x</main><script>never closed <p>y', None) == "x"
    assert own("<div>a</div><!-- never closed <p>y", None) == "a"
    assert own("</div></p>text<textarea>t</textarea><style>s</style>", None) == "text"
    assert own("<table><tr><td>1<td>2<tr><td>3</table>", None).split("\n") == ["1", "2", "3"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert own(deep, None) == "x"


def test_template_has_classes_of_equal_occurrence(spark):
    rows = [(i, f"https://News.example.com/{i}", page(i)) for i in range(12)] + [(50, "http://alone.example.com/", page(1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = templates.template(pages).collect()
    assert {r.host for r in found} == {"news.example.com"}
    by_class = {}
    for r in found:
        by_class.setdefault(r["class"], set()).add(r.path)
    root = next(paths for paths in by_class.values() if "html" in paths)
    assert {"html/body", "html/body/article.post", "html/body/footer", "html/body/nav"} <= root
    assert "html/body/nav/ul/li" not in root  # another vector: one to three entries a page
    slots = templates.main_slots(templates.template(pages)).collect()
    assert [(r.host, r.slot) for r in slots] == [("news.example.com", "html/body/article.post")]


def test_main_slot_without_semantic_tags(spark):
    html = "<html><body><div class='menu'>{m}</div><div class='story'><p>{t}</p></div><div class='links'><a>{m}</a></div></body></html>"
    rows = [(i, f"http://h.example/{i}", html.format(m="menu words " * 9, t=f"story {i} " * 30)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = templates.extract(pages).collect()
    assert all(r.main_text == " ".join([f"story {r.page_id}"] * 30) for r in got)


def test_edge_rows(spark):
    rows = [(1, "http://a.b/1", None, "s"), (None, None, "", "s"), (2, "no url", page(2), "s"), (2, "no url", page(2), "s"), (3, "http://a.b/1", "<p>" + "x " * 200_000, "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, slot string").withColumn("host", templates.F.lit("own"))
    got = templates.extract(pages)
    assert got.columns == [*pages.columns, "main_text"]
    texts = sorted((r.page_id or 0, r.main_text[:9], r.slot, r.host) for r in got.collect())
    assert texts == [(0, "", "s", "own"), (1, "", "s", "own"), (2, "Head line", "s", "own"), (2, "Head line", "s", "own"), (3, "x x x x x", "s", "own")]
    assert templates.extract(pages.limit(0)).count() == 0


def test_words_about_the_layout_do_not_hide_the_article():
    own = templates.main_text
    for around in (
        "<div class='layout with-sidebar'><article>{}</article></div>",
        "<div id='page' class='no-sidebar'><main>{}</main></div>",
        "<article class='post related'>{}</article>",
        "<div class='social-article'><div role='main'>{}</div></div>",
    ):
        page = "<body><nav>menu</nav>" + around.format("<h1>Head</h1><p>Body</p><div class='share'>Share</div><div class='comments'>First!</div>")
        assert own(page, None) == own(page, "html/body/div") == "Head\nBody", around
    assert own("<body><nav>menu</nav><section class='comments'><article>First!</article></section>", None) == ""
    assert own("<body><aside><article>Aside</article></aside><div class='menu'>menu</div>", None) == ""


def test_identical_pages_count_and_do_not_cancel(spark, monkeypatch):
    monkeypatch.setattr(templates, "TOKENS", 2)
    one, other = "<div class='x'></div><div class='y'></div>", "<div class='z'></div><div class='w'></div>"
    rows = [("http://h.a/1", one)] * 2 + [("http://h.a/2", other)] * 2 + [("http://h.a/3", one + other)]
    found = templates.template(spark.createDataFrame(rows, "url string, html string").repartition(3)).collect()
    by_class = {}
    for r in found:
        by_class.setdefault(r["class"], set()).add(r.path)
    assert sorted(map(sorted, by_class.values())) == [["div.w", "div.z"], ["div.x", "div.y"]]
    assert {r.pages for r in found} == {3}
