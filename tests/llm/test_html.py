import random
import time

from pyspark.sql import functions as F

from palisade.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article><h1>Head &amp; line</h1><p><b>One
  two<br><p>three&nbsp;&#233; &lt;x&gt;</p><form><input><button>Send</button></form><ul><li>i<li>j</ul><div class="comments"><p>first!</p></div></article>
<footer>&copy; x</footer></body></html>"""
TEXT = "Head & line One two three é <x> i j"


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))


def test_article_only():
    assert html.extract([PAGE]) == [TEXT]
    assert html.extract(["", "plain words", "<p>a<b>b</b> c</p>", "<article><p>cut &am", "<script>only"]) == ["", "plain words", "ab c", "cut &am", ""]


def test_without_article_the_wrapper_decides():
    def page(i):
        return f"<body><div class='menu'><a href='/'>Home</a></div><div><p>Welcome to our site</p></div><div id='c'><p>Story {i} has its own words, number {i}.</p><p>More of it {i}.</p></div></body>"

    out = html.extract([page(i) for i in range(5)])
    assert out == [f"Story {i} has its own words, number {i}. More of it {i}." for i in range(5)]


def test_wrapper_is_union_free():
    wrapper = html.Wrapper()
    for p in ("<ul><li>a</li><li>b</li></ul><p>same</p>", "<ul><li>c</li></ul><p>same</p><h2>extra</h2>"):
        wrapper.learn(html.runs(html.parse(p)))
    assert wrapper.expression() == "(<ul/li>#TEXT)+ (<p>same) (<h2>#TEXT)?"


def test_table_edges(spark):
    rows = [(1, "http://h.example/x", PAGE), (1, "http://h.example/x", PAGE), (2, None, PAGE), (3, "nonsense", None), (4, "http://H.example", ""), (None, None, None), (5, "http://h.example/y", "<p>" * 3000 + "deep")]
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html.main_text(table(spark, rows)).collect())
    texts = {1: TEXT, 2: TEXT, 5: "deep"}
    assert got == sorted((str(i), str(u), texts.get(i, ""), len(texts.get(i, ""))) for i, u, _ in rows)
    assert html.main_text(table(spark, [])).count() == 0


def test_one_host_in_many_batches(spark):
    rows = [(i, "http://hot.example/", f"<article><p>page {i}</p></article>") for i in range(500)]
    assert {r.page_id: r.text for r in html.main_text(table(spark, rows), batch=16).collect()} == {i: f"page {i}" for i in range(500)}


def copied(i, story):
    return f"<body><div id='top'><p>Welcome to our site</p></div><div class='ad'>Buy {i}</div><script>n={i}</script><!-- {i} --><div id='c'><p>{story}</p></div></body>"


def test_copies_are_no_constants():
    pages = [copied(i, "One story that all copies hold.") for i in range(5)]
    assert html.extract(pages) == ["One story that all copies hold."] * 5
    mixed = pages + [f"<body><div id='top'><p>Welcome to our site</p></div><div id='d'><p>Another story, number {i}.</p></div></body>" for i in range(4)]
    assert html.extract(mixed) == ["One story that all copies hold."] * 5 + [f"Another story, number {i}." for i in range(4)]


def test_constants_are_judged_over_the_host(spark):
    """Batches of copies, of one page, and a host in many parts: the same texts as over all pages at once."""
    stories = ["One story that all copies hold."] * 40 + [f"Story {i} has its own words, number {i}." for i in range(25)]
    rows = [(i, "http://hot.example/", copied(i, t)) for i, t in enumerate(stories)] + [(100 + i, f"http://h{i}.example/", copied(i, "Alone on its host, with words enough for a story.")) for i in range(3)]
    for batch in (1, 4, 64):
        got = {r.page_id: r.text for r in html.main_text(table(spark, rows), batch=batch).collect()}
        assert {i: got[i] for i in range(len(stories))} == dict(enumerate(stories))
        assert all(got[100 + i] == "Alone on its host, with words enough for a story." for i in range(3)) and len(got) == len(rows)


def test_the_wrapper_decides_inside_the_container():
    def page(i, extra=""):
        return f"<body><p>Visit {i}</p><article><p>Story {i} has its own words.</p><div class='x'><p>All rights are with the house.</p></div>{extra}</article></body>"

    assert html.extract([page(i) for i in range(4)]) == [f"Story {i} has its own words." for i in range(4)]
    assert html.extract([page(0), page(1)]) == [f"Story {i} has its own words. All rights are with the house." for i in range(2)]
    # copies of an article take nothing from each other, whatever lies around it
    same = [f"<body><p>Visit {i}</p><article><p>One story.</p></article></body>" for i in range(5)]
    assert html.extract(same) == ["One story."] * 5


def test_deep_and_long_pages_take_proportional_time():
    """Depth, many runs, and unclosed inline tags: ten times the page takes about ten times the time."""
    def took(page):
        began = time.process_time()
        html.extract([page] * 3)
        return time.process_time() - began

    for make in (lambda n: "<div>x" * n, lambda n: "<b>" * n + "<div>x</div>" * n + "</i>" * n, lambda n: "".join(f"<p class={'abcdefgh'[i * i % 8]}>t{i}</p>" for i in range(n))):
        assert took(make(20_000)) < 30 * took(make(2_000)) + 5
    assert html.extract(["<div>x" * 100_000])[0].count("x") == 100_000


def test_alignment_pairs_equal_items_in_order():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        got = html.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))
        assert html.aligned(a, a) == [(i, i) for i in range(len(a))]


def test_a_host_s_model_stays_small():
    """Pages with ids and classes of their own: what the host's model holds doesn't grow with its pages."""
    def page(i):
        return f"<body><div id='post-{i}' class='post p{i}'><p><a href='/'>Home {i}</a></p><p>Story {i} has its own words, number {i}.</p></div><div id='slug-{'abcdefgh'[i % 8] * (i + 1)}'>x {i}</div></body>"

    sizes = []
    for n in (50, 800):
        host = html.Host()
        for at in range(0, n, html.PAGES):
            host.learn([page(i) for i in range(at, min(at + html.PAGES, n))])
        sizes.append(sum(map(len, host.model())))
    assert sizes[0] == sizes[1] < 10


def test_partitions_change_nothing(spark):
    rows = [(i, f"http://h{i % 7}.example/", copied(i, f"Story {i} has its own words, number {i}.")) for i in range(150)] + [(500 + i, "http://h1.example/", "<p><a>x</a></p><div>own text</div>") for i in range(40)]
    old, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "41"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted((r.page_id, r.text) for r in html.main_text(table(spark, rows), batch=8).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2] and dict(results[0])[7] == "Story 7 has its own words, number 7."
