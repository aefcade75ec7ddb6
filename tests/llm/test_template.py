"""Template deduction by equivalence classes: articles are read too, and order and nesting decide."""

from collections import Counter

from weftgraph.llm import html


def test_template_inside_articles_goes(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><article><p>Subscribers read more</p><p>own text {i}</p></article></body>") for i in range(10)]
    rows += [(20 + i, f"http://b.org/{i}", f"<body><p>Shown on {i}</p><article><p>One article</p></article></body>") for i in range(5)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own text {i}" for i in range(10)} | {20 + i: "One article" for i in range(5)}


def test_shuffled_lines_are_no_template(spark):
    """Each on all pages, but in an order that differs: content, not template."""
    lines = ["<p>alpha</p>", "<p>beta</p>", "<p>gamma</p>"]
    rows = [(i, f"http://c.org/{i}", "<body><div>" + "".join(lines[i % 3 :] + lines[: i % 3]) + f"<p>n{i}</p></div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all({"alpha", "beta", "gamma", f"n{i}"} == set(got[i].split()) for i in got) and len(got) == 9


def test_crossing_classes():
    classes = {1: 10, 2: 10, 3: 20, 4: 20}
    sizes = Counter(classes.values())
    assert html.shapes([1, 3, 4, 2], classes, sizes) == {10: ((1, 2), True), 20: ((3, 4), True)}
    assert html.shapes([1, 3, 2, 4], classes, sizes)[20][1] is False
    assert html.shapes([1, 2, 1, 2], classes, sizes)[10][1] and not html.shapes([1, 2, 2, 1], classes, sizes)[10][1]


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


LOSSES = [
    ('<div class="layout has-sidebar"><article><p>Text {i}</p></article></div>', "Text {i}"),
    ("<form><article><p>Text {i}</p></article></form>", "Text {i}"),
    ('<article><div class="article-header"><h1>Title {i}</h1></div><p class="related-work">Text {i}</p></article>', "Title {i} Text {i}"),
    ("<main><p>Intro {i}</p><article>A{i}</article><p>Outro {i}</p></main>", "Intro {i} A{i} Outro {i}"),
    ('<article><p>Text {i}</p><p><a href="/x">A paragraph {i} that is all link</a></p></article>', "Text {i} A paragraph {i} that is all link"),
]


def test_words_in_class_names_drop_nothing(spark):
    """With a template (six pages of a host) and without (one page of a host)."""
    rows, want = [], {}
    for k, (body, text) in enumerate(LOSSES):
        for i in range(7):
            n = 10 * k + i
            rows.append((n, f"http://{f'h{k}' if i < 6 else f'one{k}'}.org/{i}", f"<body><nav><a href='/'>Home</a></nav>{body.format(i=i)}<footer>f{i}</footer></body>"))
            want[n] = text.format(i=i)
    assert extracted(spark, rows) == want


def test_template_decides_without_tags(spark):
    """No article, no main, no known name: the region is the template's element with most of the text."""
    side = "<div class=q><ul><li><a href=/1>one {i}</a></li><li><a href=/2>two</a></li><li><a href=/3>three</a></li></ul><p>tip {i}</p></div>"
    rows = [(i, f"http://p.org/{i}", f"<body>{side.format(i=i)}<div class=z><h1>Head {i}</h1><div class=share>Tell a friend now</div>" + "".join(f"<p>own words {i} {k} in a long text</p>" for k in range(i + 2)) + "</div><div class=w>seen today</div></body>") for i in range(8)]
    got = extracted(spark, rows)
    assert got == {i: " ".join([f"Head {i}", *(f"own words {i} {k} in a long text" for k in range(i + 2))]) for i in range(8)}


def test_classes_like_brute_force(spark):
    pages = ["<body><div class=a><p>x</p><p>x</p></div><div class=b>y{i}</div>{opt}</body>".format(i=i, opt="<ul><li>z</li></ul>" if i % 2 else "") for i in range(6)]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    found = {int(t) for r in html.templates(df).collect() for t in r.template[1:]}
    seen = [Counter(html.Page(p).tokens()) for p in pages]
    vector = {t: tuple(c[t] for c in seen) for t in set().union(*seen)}
    share = {t: sum(map(bool, v)) / len(pages) for t, v in vector.items()}
    frequent = {t: v for t, v in vector.items() if share[t] >= (html.TEXT_SHARE if t[1] else html.SHARE)}
    classes = Counter(frequent.values())
    # The paragraphs and their text (twice a page, in turn) are valid, too: they lie in one gap.
    assert found == {t[0] for t, v in frequent.items() if classes[v] >= html.LARGE} and len(found) >= 5


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"http://c.org/{i}", f"<body><p>Shown on {i}</p><article><h1>T</h1><p>Same article</p></article></body>") for i in range(5)]
    rows += [(10 + i, f"http://d.org/{i}", f"<body><article><p>{'Copied text' if i % 2 else f'own {i}'}</p><p>n{i}</p></article></body>") for i in range(8)]
    got = extracted(spark, rows)
    assert all(got[i] == "T Same article" for i in range(5))
    assert all(got[10 + i] == f"{'Copied text' if i % 2 else f'own {i}'} n{i}" for i in range(8))


def test_deep_and_long_pages(spark):
    got = extracted(spark, [(1, "http://e.org/", "<div>" * 20_000 + "x"), (2, "http://e.org/", "<p>a " * 50_000), (3, "http://e.org/", "<div>b " * 20_000)])
    assert got[1] == "x" and got[2].count("a") == 50_000 and got[3].count("b") == 20_000


def test_joined_templates(spark, monkeypatch):
    rows = [(i, f"http://j{i % 2}.org/{i}", f"<body><div class=z><p>Same line</p><p>own {i}</p></div></body>") for i in range(12)]
    want = extracted(spark, rows)
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert extracted(spark, rows) == want == {i: f"own {i}" for i in range(12)}
