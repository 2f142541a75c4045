import random

from pyspark.sql import functions as F

from stockline.llm import html_text as H


def text(page):
    return "\n".join(t for t, _ in H.lines(page))


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>top</header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad <p>1</p> --><div class="box ad">buy</div>
    <article id=a1><h1>Title &amp; more</h1><p><b>One<br>two &nbsp; three<br><p>Four &lt;b&gt; a < b</p><aside>no</aside><form><p>f</p></form>
    <div class="comments"><p>reader</p></div><ul><li>i</li><li>j</li></ul></article><div id="cookie-notice">c</div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "Title & more\nOne two three\nFour <b> a < b\ni\nj"
    assert not any(d for _, d in H.lines(page))
    assert H.lines(None) == [] == H.lines("")
    assert text("<article><p>a</p><p>b <a hre") == "a\nb"
    assert text("<article><p>kept</p><script>never closed <p>x</p>") == "kept"
    assert H.lines("<p>loose</p>") == [("loose", True)]


def test_common_lines_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = H.common_lines(a, b)
        assert len(got) == table[-1][-1] and got == sorted(set(got))
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in got)


def test_doubtful_lines_are_differenced(spark):
    page = lambda i, body: (i, f"http://h.example/a/{i:03}", f"<p>Welcome to us</p>{body}<p>All rights reserved</p>", "z")
    rows = [page(i, f"<p>own text {i}</p><p>more {i}</p>") for i in range(20)]
    rows += [(90 + i, f"http://h.example/b/{i}", "<p>Welcome to us</p><article><p>same story</p></article>", "z") for i in range(2)]
    rows += [(100, "http://alone.example/", "<p>only</p>", "z"), (101, None, None, "z"), (None, "odd", "", "z"), (7, *rows[7][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {(r.page_id, r.url): r for r in H.main_text(pages, group=8).collect()}
    assert len(got) == len(rows) - 1 and H.main_text(pages, group=8).count() == len(rows)
    for i in range(20):
        assert got[i, rows[i][1]].text == f"own text {i}\nmore {i}"
    assert got[90, "http://h.example/b/0"].text == "same story" == got[91, "http://h.example/b/1"].text
    assert got[100, "http://alone.example/"].text == "only" and got[101, None].n_chars == 0
    assert H.main_text(pages.where("false")).count() == 0


def test_articles_of_the_pages(spark, sf_dir):
    """The article's text by another parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.parts.append("\n" if tag in ("p", "h1") else " " if tag == "br" else "")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.parts.append("\n" if tag in ("p", "h1") else "")

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data.replace("\n", " "))

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Article()
        p.feed(r.html)
        want[r.page_id] = "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.parts).split("\n")) if x)
    got = {r.page_id: r.text for r in H.main_text(pages).collect()}
    assert got == want


def test_sections_smaller_than_a_group_meet_their_neighbour(spark):
    """On a host of many groups, each pair of URLs has a line of its own that only true neighbours share."""
    rows = [(2 * i + k, f"http://h.example/{i:04}/{k}", f"<p>section {i}</p><p>own {i} {k}</p>") for i in range(200) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.main_text(pages, group=10).collect()}
    assert got == {2 * i + k: f"own {i} {k}" for i in range(200) for k in range(2)}


def test_copies_of_a_url_meet_the_next_url(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS_OF_A_URL", 2)
    rows = [(i, "http://h.example/a", f"<p>Welcome</p><p>crawl {i}</p>") for i in range(7)] + [(50, "http://h.example/b", "<p>Welcome</p><p>b</p>")]
    rows += [(100 + i, None if i % 2 else "", f"<p>Menu</p><p>text {i}</p>") for i in range(6)] + [(200, "odd", "<p>Menu</p><p>odd</p>"), (200, "odd", "<p>Menu</p><p>odd</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text) for r in H.main_text(pages).collect())
    want = [(i, f"crawl {i}") for i in range(7)] + [(50, "b")] + [(100 + i, f"text {i}") for i in range(6)] + [(200, "odd")] * 2
    assert got == want


def test_names_of_parts_and_broken_markup():
    """Classes count as whole words; paragraphs end where the next begins; stray quotes stay inside their tag."""
    assert text('<div class="layout has-sidebar"><p>Main text</p></div>') == "Main text"
    assert text('<article><section class="search-algorithms"><p>Binary search</p></section></article>') == "Binary search"
    assert text('<main><div class="entry-header"><h1>Title</h1></div><p>x</p></main>') == "Title\nx"
    assert text('<p class="ad">Buy<p>Main') == "Main"
    assert text("""<p title="it"s">Hello""") == "Hello"
    assert text('<ul><li class="ad">one<li>two</ul><table><tr><td class="ad">x<td>y<tr><td>z</table>') == "two\ny\nz"
    assert text('<div class="site-footer"><p>f</p></div><p>main</p>') == "main"
    assert text("<article>a <span class=ad>buy</span> b</article>") == "a\nb"
    assert text('<p>a <a title="x > y" href=z>b</a> c') == "a b c"


def test_kinds_of_lines():
    page = "<nav><a>Home</a></nav><p>open</p><article><p>story</p><aside>see also</aside></article><footer>end</footer>"
    assert H.blocks(page) == [("Home", "out"), ("open", "open"), ("story", "main"), ("see also", "out"), ("end", "out")]


def test_differencing_meets_menus_and_adverts(spark, sf_dir):
    """All lines take part in the alignment; articles lose nothing by it."""
    rows = [(i, f"http://h.example/{i}", f"<nav><a>Home</a></nav><article><p>story</p></article><p>Subscribe now</p><div class=ad>ad {i}</div><footer>end</footer>") for i in range(6)]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert {(r.text, r.n_lines, r.n_differenced) for r in got} == {("story", 5, 3)}
    whole = H.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert sum(r.n_differenced for r in whole) > 0 and all(r.n_lines > r.n_differenced for r in whole)


def test_long_page_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} of a long page</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://h.example/a", long, 1), (2, "http://h.example/b", long.replace("article", "div") + "<p>own</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path long").withColumn("lines", F.lit(1)).withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    assert got[1].text.count("\n") == 19_999 and got[2].text == "own" and got[2].n_differenced == 20_000
