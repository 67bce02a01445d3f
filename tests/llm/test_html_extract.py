import random

from tidewire.llm import html_extract as HX


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ([bytes([rng.randrange(4)]) for _ in range(rng.randrange(14))] for _ in range(2))
        for got in (sorted(HX._align(a, b)), sorted(HX._align(a, b, 4)), sorted(HX.common(a, b))):
            rest = iter(b)
            assert len(got) == longest(a, b) and all(a[i] in rest for i in got)


def texts(page):
    return [b.text for b in HX.blocks(page)]


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>menu</ul></nav>
      <div class="cookie-notice">We use</div><main><header><h1>Head &amp;  line</h1></header><p>one <b>two</b>\n three<br>four<p>five &lt;six&gt; 5 < 6
      <ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table><form>no<input></form><aside>no</aside><section class="comments"><p>me too</p></section>
      <!-- no <p>no</p> --><script>var x = "</p><p>no";</script><pre>x   y</pre></main><footer>&copy; no</footer></body></html>"""
    assert texts(page) == ["Head & line", "one two three", "four", "five <six> 5 < 6", "a", "b", "c", "d", "x y"]
    assert texts("") == [] and texts("just text") == ["just text"] and texts("<p>open <b>bold") == ["open bold"]
    assert texts("<div hidden>no</div><div>&amp;lt; once</div><svg><text>no</text></svg>") == ["&lt; once"]


def pages(spark):
    body = "<body><div>Menu of the house</div><p>Text {0} of its own.</p><p>More {0}.</p><div>All rights of the house</div></body>"
    rows = [(i, f"http://a.example/{i // 10}/{i:03d}?x=1", body.format(i)) for i in range(60)]
    rows += [(100, "http://b.example/only", body.format(100)), (101, None, body.format(101)), (102, "", None), (103, "http://c.example/", "")]
    rows += [(104, "https://d.example/x", "<article><p>shared</p><p>mine</p></article>"), (105, "https://d.example/y", "<article><p>shared</p><p>yours</p></article>")]
    rows += [(None, "http://a.example/0/000", body.format(7)), (5, "http://a.example/0/005?x=1", body.format(5))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS range", "'h' AS host")


def test_shared_lines_go_wherever_the_ranges_end(spark):
    want = None
    for n in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = sorted(str(tuple(r)) for r in HX.main_text(pages(spark)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert want is None or got == want
        want = got
    found = {r.page_id: r for r in HX.main_text(pages(spark)).collect()}
    assert found[33].text == "Text 33 of its own.\nMore 33." and found[33].n_chars == len(found[33].text)
    assert found[100].text.startswith("Menu") and found[101].text.startswith("Menu")         # no neighbour, nothing to compare with
    assert found[102].text == found[103].text == "" and found[104].text == "shared\nmine" and found[105].text == "shared\nyours"


def test_empty_table(spark):
    assert HX.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def at_any_border(spark, rows):
    """{key: texts}; the same wherever the ranges end."""
    want = None
    for n in (1, 3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = sorted((r.page_id, r.text) for r in HX.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert want is None or got == want
        want = got
    return dict(want)


def test_differencing_decides_pages_with_an_article(spark):
    body = ("<body><div>House menu</div><main><div>More of the house</div><h1>Head {0}</h1><p>A passage that all share.</p><p>Own text of page {0}.</p></main>"
            "<div>Beside the article, only on {0}.</div><div>Rights of the house</div></body>")
    found = at_any_border(spark, [(i, f"http://a.example/{i:02d}", body.format(i)) for i in range(12)])
    assert all(found[i] == f"Head {i}\nA passage that all share.\nOwn text of page {i}.\nBeside the article, only on {i}." for i in range(12))


def test_copies_do_not_erase_each_other(spark):
    body = "<body><div>Menu of the house</div><p>Text {0} of its own.</p><p>More {0}.</p><div>All rights of the house</div></body>"
    rows = [(i, f"http://a.example/x{i:02d}", body.format(i)) for i in range(5)]
    rows += [(10 + i, f"http://a.example/x02?page={i}", body.format(2)) for i in range(20)]           # over several ranges
    rows += [(40 + i, f"http://b.example/{i}", body.format(7)) for i in range(9)]                     # a host of copies only
    long = "A notice of so many words that next to it nothing else counts for anything at all. " * 3
    rows += [(60 + i, f"http://c.example/{i}", f"<p>{long}</p><p>At {i}.</p>") for i in range(2)]     # near copies
    found = at_any_border(spark, rows)
    assert all(found[i] == f"Text {i} of its own.\nMore {i}." for i in range(5))
    assert all(found[10 + i] == found[2] for i in range(20))
    assert all(found[40 + i].startswith("Menu of the house\nText 7") for i in range(9))
    assert all(found[60 + i] == f"{long.strip()}\nAt {i}." for i in range(2))
