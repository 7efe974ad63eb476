from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillspark.llm.html_text import common_lines, extract_text, page_lines

ARTICLE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>Cookies!</div><div id=\"ad\">Buy</div><article><header><h1>The &amp;  title</h1></header><p>One\n<b>two</b>&nbsp;three<br>four<p>Five &lt;6&gt; caf&eacute;<form><input>sign up</form><div class=comments><div>nice</div></div><p>Seven</article><aside>More</aside><footer>&copy;</footer>"


def _lines(html):
    return [x for x, _ in page_lines(html)]


def test_article():
    assert [x for x, kept in page_lines(ARTICLE) if kept] == ["The & title", "One two three four", "Five <6> café", "Seven"]


@pytest.mark.parametrize(("html", "lines"), [("", []), ("<p>", []), ("plain  text", ["plain text"]), ("<p>a<!-- x > y --><p>b<!-- open", ["a", "b"]), ("<script>x", []), ("a < b & c", ["a < b & c"]), ("<nav>menu<article><p>kept</article>", ["kept"]), ("<article><aside>side</article><p>after", ["after"]), ("<div hidden>no</div><p style='display:none'>no</p>yes", ["yes"]), ("<p title='a>b'>c", ["c"])])
def test_markup(html, lines):
    assert _lines(html) == lines


def test_common_lines_are_longest():
    import random

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(8))] for _ in range(2))
        mask = common_lines(a, b)
        got = [x for x, m in zip(a, mask) if m]
        it = iter(b)
        assert all(x in it for x in got)
        best = max(n for n in range(len(a) + 1) for c in combinations(a, n) if all(x in it2 for it2 in [iter(b)] for x in c))
        assert len(got) == best


def test_neighbours_settle_what_markup_leaves_open(spark):
    page = lambda i: f"<body><p>Our site<p>Menu one<p>Story {i} of its own<p>More {i}<p>All rights reserved"
    rows = [(i, f"https://a.example/news/{i}.html?x={i}", page(i)) for i in range(5)] + [(9, "https://b.example/news/9", page(9))]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Story {i} of its own\nMore {i}" and got[i].n_chars == len(got[i].text) and got[i].url == rows[i][1] for i in range(5))
    assert got[9].text.startswith("Our site")


def test_articles_that_share_text_keep_it(spark):
    rows = [(i, f"https://a.example/{i}", "<nav>m</nav><article><p>Same story</article>") for i in range(4)]
    assert {r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Same story"}


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "http://h/a", "<p>b", "y"), (2, "no url", "<p>c", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page_key string").withColumn("shared", F.lit(1))
    assert sorted((r.text, r.n_chars) for r in extract_text(pages).collect()) == [("", 0), ("", 0), ("b", 1), ("c", 1)]
    assert extract_text(pages.limit(0)).count() == 0


def _brute(page):
    """The article of a page of the given tables, read by Python's own parser: one line a block."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        blocks = {"article", "h1", "h2", "h3", "p", "ul", "ol", "li", "div", "blockquote", "pre", "table", "tr", "td", "th"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.lines, self.held = False, [], ""

        def end(self):
            line = " ".join(self.held.split())
            self.lines += [line] if line else []
            self.held = ""

        def handle_starttag(self, tag, attrs):
            if tag in self.blocks:
                self.end()
            self.held += " " if tag == "br" else ""
            self.open |= tag == "article"

        def handle_endtag(self, tag):
            if tag in self.blocks:
                self.end()
            self.open &= tag != "article"

        def handle_data(self, data):
            self.held += data if self.open else ""

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(reader.lines)


def test_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: (r.url, _brute(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_text(pages).collect()}
    assert got == {i: (url, text, len(text)) for i, (url, text) in want.items()}
    assert any("\n" in text for _, text in want.values())


def test_very_long_pages(spark):
    long = "word " * 200_000
    rows = [(1, "http://a.example/1", f"<nav>m</nav><article><p>{long}</article>"), (2, "http://a.example/2", "<p>a<p>b" * 20_000)]
    got = _texts(spark, rows)
    assert got[1] == long.strip() and got[2] == "\n".join(["a", "b"] * 20_000)


def _texts(spark, rows):
    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def _page(i, section):
    return f"<body><p>Our site<p>Section {section}<p>Story {i} of its own<p>All rights reserved"


def test_pairs_cross_directories_and_take_the_nearer_path(spark):
    paths = ["/about/", "/2024/05/12/slug", "/2023/01/02/slug", "/blog/topic/slug", "/x/b/1", "/x/a/9", "/x/b/2"]
    rows = [(i, f"https://a.example{p}", _page(i, p[:4])) for i, p in enumerate(paths)]
    got = _texts(spark, rows)
    assert all("Our site" not in x and "reserved" not in x and f"Story {i} of its own" in x for i, x in got.items())
    # /x/b/1 comes after /x/a/9, but /x/b/2 is nearer.
    near = [(1, "https://b.example/x/a/9", "<p>Menu a<p>One"), (2, "https://b.example/x/b/1", "<p>Menu b<p>Two"), (3, "https://b.example/x/b/2", "<p>Menu b<p>Three")]
    assert _texts(spark, near) == {1: "Menu a\nOne", 2: "Two", 3: "Three"}


def test_copies_of_a_page_are_not_its_neighbours(spark):
    rows = [(i, f"https://a.example/n/{i % 2}?t={i}", _page(i % 2, "n")) for i in range(6)]
    assert _texts(spark, rows) == {i: f"Story {i % 2} of its own" for i in range(6)}


def test_pairs_do_not_depend_on_the_number_of_pages(spark):
    page = lambda i: f"<p>Our site<p>Tens {i // 10}<p>Story {i}"
    rows = [(i, f"https://a.example/en/{i:05d}", page(i)) for i in range(2500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few, many = ({r.page_id: r.text for r in extract_text(pages.filter(f"page_id < {n}")).collect()} for n in (990, 2500))
    # Every page has a page of its own ten beside it, which shares a longer beginning than the ten before or after.
    assert many == {i: f"Story {i}" for i in range(2500)}
    assert few == {i: many[i] for i in range(990)}


def test_a_large_host_is_ordered_in_several_ranges(spark):
    rows = [(i, f"https://a.example/en/{i:05d}", f"<p>Our site<p>Story {i}") for i in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        assert _texts(spark, rows) == {i: f"Story {i}" for i in range(500)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        ("<p>a<svg viewBox='0 0 1 1'/><p>b", ["a", "b"]),
        ("<p>a<math/>b<svg><path d=x/></svg>c", ["ab", "c"]),
        ("<article><p title=it's>Hello<p class=\"a>b\" title='c>d'>x</article>", ["Hello", "x"]),
        ("<article><div class=share-price>12</div><section class='related-work'>w</section><math><mi>x</mi>=1</math><div class='share-buttons'>no</div></article>", ["12", "w", "x=1"]),
        ("a " + "<a " * 20_000, ["a " + "<a " * 19_999 + "<a"]),
        *[(f"<div><p>a<{x} data-x=1>b</p></div><p>c<{x}>gone</{x}>d", ["a", "b", "c", "d"]) for x in ("iframe", "object", "select", "button", "canvas", "audio", "video", "noscript", "template")],
        ("<p>a<svg><p>b<p>c", ["a", "b", "c"]),
        ("<p>a<object/><p>b</p><object>x</object>", ["a", "b"]),
        ("<svg><svg>x</svg>y</svg>a<svg><title>t</title><foreignObject><p>f</foreignObject></svg>b", ["a", "b"]),
        ("<article><p class=notice>n<p>a<p>b</article>", ["a", "b"]),
        ("<p class=notice>n <b>x</b><h2>a</h2>b", ["a", "b"]),
        ("<ul><li class=share>s<ul><li>t</ul><li>a</ul><p>b", ["a", "b"]),
        ("<ul><li class=share>s</ul>a", ["a"]),
        ("<table><tr><td class=ad>x<td>a<tr class=promo><td>y<tr><td>b</table>c", ["a", "b", "c"]),
        ("<dl><dt class=ad>x<dd class=ad>y<dt>a<dd>b</dl>", ["a", "b"]),
        ("<div><span class=share>s</div>a", ["a"]),
        ("<div><div class=ad><ul><li>x</div>a</div>b", ["a", "b"]),
        ("<div class='ad'/><p>a", ["a"]),
        ("<iframe src=http://x/>gone</iframe>a", ["a"]),
        ("<nav><script>'</nav>'</script>x</nav>a", ["a"]),
        ("<head><title>t</title><script>'</head>'</script><body>a</body>", ["a"]),
        ("<article><div class=comments><article>c</article><article>d</article></div>a</article>", ["a"]),
    ],
)
def test_unclosed_elements_end_with_what_ends_them(html, lines):
    assert _lines(html) == lines


BODY = "<article><h1>Title</h1><p>Body</p></article>"


@pytest.mark.parametrize(
    "more",
    [
        "<div id='comments'><ol class='comment-list'><li><article class='comment-body'><p>reader comment</p></article></li></ol></div>",
        "<aside class='sidebar'><article class='teaser'><p>another story</p></article></aside>",
        "<article class='comment'><p>reader comment</p></article>",
        "<div class='comments'><div><article><p>one</p></article></div><article><p>two</p></article></div>",
        "<section role='complementary'><article><p>aside</p></article></section>",
    ],
)
def test_articles_in_marked_zones_stay_out(more):
    assert [x for x, _ in page_lines(f"<body>{BODY}{more}</body>")] == ["Title", "Body"]
    assert [x for x, _ in page_lines(f"<body>{more}{BODY}</body>")] == ["Title", "Body"]


@pytest.mark.parametrize("said", ["class='user-comments'", "class='reader-comments'", "class='c-comment'", "id='js-comments'", "class='adsbygoogle'", "class='is-ad'", "class='sticky-banner'", "role='complementary'", "role=contentinfo"])
def test_marks_within_an_article(said):
    assert [x for x, _ in page_lines(f"<article><p>Body</p><div {said}><p>no</p></div><p>end</p></article>")] == ["Body", "end"]


@pytest.mark.parametrize("said", ["class='share-price'", "class='related-work'", "id='user'", "class='reader'", "class='js'", "class='comment-on-rates'"])
def test_other_words_mark_nothing(said):
    assert [x for x, _ in page_lines(f"<article><p>Body</p><div {said}><p>yes</p></div></article>")] == ["Body", "yes"]


def test_zones_that_never_end_and_zones_around_all():
    assert [x for x, _ in page_lines(f"<div class='menu'><p>menu</p>{BODY}")] == ["Title", "Body"]
    assert [x for x, _ in page_lines(f"<div class='menu'><p>menu</p><div>{BODY}</div>")] == ["Title", "Body"]
    # Nothing else would be left of the page's article.
    assert [x for x, _ in page_lines(f"<div class='modal-content'><p>x</p>{BODY}</div>")] == ["Title", "Body"]
    assert [x for x, _ in page_lines("<article class='comment'><p>only</p></article>")] == ["only"]


def test_many_zones_take_linear_time():
    assert page_lines("<div class='ad'><article><p>x</p>" * 20_000)
    assert page_lines("<div class='ad'><article><p>x</p></article></div>" * 20_000)


def test_pages_with_articles_are_differenced(spark):
    # The list of the latest stories, unmarked, is on both pages; a line that both stories quote stays.
    page = lambda i: f"<body><div class=ad>Ad {i}</div><main><article><h1>Story {i}</h1><p>To be or not to be</p></article><article><p>Latest</p><p>Another story</p></article></main>"
    rows = [(i, f"https://a.example/en/{i}", page(i)) for i in range(4)]
    assert _texts(spark, rows) == {i: f"Story {i}\nTo be or not to be" for i in range(4)}
    # A page shared whole keeps its article, and so does one without neighbours.
    alike = [(1, "https://b.example/1", page(1)), (2, "https://b.example/2", page(1)), (3, "https://c.example/", page(3))]
    assert _texts(spark, alike) == {i: f"Story {k}\nTo be or not to be\nLatest\nAnother story" for i, k in ((1, 1), (2, 1), (3, 3))}


def test_marked_lines_take_part_in_the_comparison(spark):
    rows = [(1, "https://a.example/1", "<nav>Home</nav><p>Sign up now<p>One"), (2, "https://a.example/2", "<nav>Home</nav><div class=notice>Sign up now</div><p>Two")]
    assert _texts(spark, rows) == {1: "One", 2: "Two"}
    # Copies whose adverts differ are still one page.
    copies = [(i, f"https://b.example/{i // 2}", f"<div class=ad>Ad {i}</div><p>Our site<p>Story {i // 2}") for i in range(4)]
    assert _texts(spark, copies) == {i: f"Story {i // 2}" for i in range(4)}


def test_large_comparisons_are_halved(monkeypatch):
    import random

    from quillspark.llm import html_text

    rng = random.Random(3)
    pairs = [([rng.randrange(5) for _ in range(rng.randrange(40))], [rng.randrange(5) for _ in range(rng.randrange(40))]) for _ in range(100)]
    want = [sum(common_lines(a, b)) for a, b in pairs]
    monkeypatch.setattr(html_text, "CELLS", 20)
    for (a, b), n in zip(pairs, want, strict=True):
        mask = common_lines(a, b)
        rest = iter(b)
        assert sum(mask) == n and all(x in rest for x, m in zip(a, mask, strict=True) if m)
