from stockyard.llm import pages
from stockyard.llm.queries import QUERIES

from .helpers import FOLDER

SCHEMA = "page_id long, url string, html string, text string"


def extract(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return {r.page_id: (r.text, r.n_chars) for r in pages.extract(df).collect()}


def one(spark, html):
    return extract(spark, [(1, "http://h.example/x", html)])[1][0]


def test_article_only(spark):
    html = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>'
        '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>hidden</p> -->'
        '<div class="ad">Buy</div><div id="cookie-notice">Cookies</div><article><header><h1>Head &amp; line</h1></header>'
        "<p>One   <b>bold</b>\n text<br>more<p>Two &lt;x&gt; &#233;<ul><li>a<li>b</ul>"
        '<aside>Side</aside><form><p>Name</p><input></form><section class="comments"><p>First!</p></section></article>'
        "<footer>&copy; me</footer></body></html>"
    )
    assert one(spark, html) == "Head & line\nOne bold text more\nTwo <x> é\na\nb"


def test_broken_markup(spark):
    assert one(spark, "<article><p><b>One<br><p>Two</article><footer>x") == "One\nTwo"
    assert one(spark, "a < b and <p>c") == "a < b and\nc"
    assert one(spark, "<p>x</p><script>never closed <p>y") == "x"
    assert one(spark, "<p title='a>b'>x</p><p title='never>y") == "x\ny"
    assert one(spark, "plain &amp text &am") == "plain & text &am"


def test_template_of_a_site_is_cut(spark):
    def page(n, extra):
        body = "".join(f"<div class='story'><p>Story {n} part {k} of page</p></div>" for k in range(n % 4 + 1))
        return f"<html><body><div class='top'><p>Welcome to our site</p></div>{body}<div class='legal'><p>All rights</p></div>{extra}</body></html>"

    rows = [(n, "http://a.example/p", page(n, "")) for n in range(12)]
    rows += [(100 + n, "http://few.example/p", page(n, "")) for n in range(3)]
    got = extract(spark, rows)
    for n in range(12):
        assert got[n][0] == "\n".join(f"Story {n} part {k} of page" for k in range(n % 4 + 1))
    assert got[100][0].startswith("Welcome to our site")  # too few pages to tell


def test_copies_do_not_make_a_template(spark):
    html = "<html><body><div class='x'><p>The same page again</p></div></body></html>"
    got = extract(spark, [(n, "http://a.example/p", html) for n in range(20)])
    assert set(got.values()) == {("The same page again", 19)}


def test_unnamed_boilerplate_inside_article_is_cut(spark):
    def page(n, around):
        parts = "".join(f"<p>Story {n} part {k}</p>" for k in range(n % 4 + 1))
        return around.format(
            f"<h1>Head {n}</h1><div class='k1'><p>We use your data</p></div>{parts}<h2>Sources</h2><p>Source of {n}</p><p>Read our letter</p>"
            "<div class='k2'><h4>More</h4><ul><li>First place</li><li>Second place</li></ul></div>"
        )

    rows = [(n, "http://a.example/p", page(n, f"<article id='post-{n}' class='t{n}'>{{}}</article>")) for n in range(12)]
    rows += [(100 + n, "http://b.example/p", page(n, "<main><div>{}</div></main>")) for n in range(12)]
    rows += [(200 + n, "http://few.example/p", page(n, "<article>{}</article>")) for n in range(7)]
    got = extract(spark, rows)
    for n in range(24):
        own = n % 12
        parts = [f"Story {own} part {k}" for k in range(own % 4 + 1)]
        # "Sources" is on every page as well, but heads a text that is not.
        assert got[own + 100 * (n > 11)][0].split("\n") == [f"Head {own}", *parts, "Sources", f"Source of {own}"]
    assert "Read our letter" in got[200][0]  # too few pages to tell


def test_unnamed_boilerplate_without_article_is_cut(spark):
    rows = [(n, "http://a.example/p", f"<div><p>Welcome</p><p>Story {n}</p><p>All rights</p></div>") for n in range(12)]
    assert {i: t for i, (t, _) in extract(spark, rows).items()} == {n: f"Story {n}" for n in range(12)}


def test_copies_of_one_page_among_others_are_no_template(spark):
    def page(n):
        return f"<article><p>Story {n}</p><p>More of {n}</p><p>Read our letter</p></article>"

    rows = [(n, "http://a.example/p", page(n)) for n in range(12)] + [(100 + n, "http://a.example/p", page(5)) for n in range(200)]
    got = extract(spark, rows)
    assert all(got[n][0] == f"Story {n}\nMore of {n}" for n in range(12))
    assert all(got[100 + n][0] == "Story 5\nMore of 5" for n in range(200))


def test_article_that_is_the_same_on_every_page_stays(spark):
    rows = [(n, "http://a.example/p", f"<article><p>The same text</p></article><p>Outside {n}</p>") for n in range(12)]
    assert all(text == f"The same text\nOutside {n}" for n, (text, _) in extract(spark, rows).items())


def test_names_inside_article_only_lower_the_prior(spark):
    def page(n):
        return (
            f"<div class='with-sidebar'><main><div class='post-header'><h1>Head {n}</h1></div><h2 id='search-for-life'>Search {n}</h2>"
            f"<section id='related-work'><p>Related work {n}</p></section><p class='notice'>Take care of {n}</p>"
            f"<h2 id='social-impact'>Impact {n}</h2><p>Text {n}</p>"
            f"<div class='share'><p>Share this {'page' if n % 2 else 'story'}</p></div><div class='notice'><p>Under {n} notice</p></div></main></div>"
        )

    own = "Head {0}\nSearch {0}\nRelated work {0}\nTake care of {0}\nImpact {0}\nText {0}\n{1}Under {0} notice"
    rows = [(n, "http://a.example/p", page(n)) for n in range(12)] + [(100, "http://few.example/p", page(0))]
    got = extract(spark, rows)
    assert all(got[n][0] == own.format(n, "") for n in range(12))
    assert got[100][0] == own.format(0, "Share this story\n")


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>part {n} of many</p>" for n in range(20_000)) + "</article>"
    rows = [(1, None, None), (2, "no host", ""), (3, None, "<p>x</p>"), (4, "http://b.example", long), (None, "http://b.example", "<p>y</p>")]
    got = extract(spark, rows)
    assert got[1] == got[2] == ("", 0) and got[3] == ("x", 1) and got[None] == ("y", 1)
    assert got[4][0].count("\n") == 19_999
    assert extract(spark, rows[:1])[1] == ("", 0)
    assert pages.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_deep_nesting_is_no_problem(spark):
    assert one(spark, "<div>" * 3000 + "x" + "</div>" * 3000) == "x"


def test_query(spark):
    rows = QUERIES["op5_html_text"](spark, FOLDER).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        inner = source[r.page_id].partition("<article>")[2].partition("</article>")[0]
        assert r.n_chars == len(r.text)
        for block in r.text.split("\n"):
            assert block and block == " ".join(block.split())
        wanted = pages.references.unescape(pages.re.sub("<[^>]*>", " ", inner)).split()
        assert r.text.split() == wanted


def test_article_ends_what_names_around_it_say(spark):
    around = [
        "<div class='layout with-sidebar'>{}</div>", "<div id='content' class='has-comments'>{}</div>", "<div class='share-page'>{}</div>",
        "<section id='related-work'>{}</section>", "<div class='widget'><div class='header'>{}</div></div>", "<form id='f'><div>{}</div></form>",
    ]
    for wrap in around:
        rows = [
            (100 * k + n, f"http://{k}.example/p", wrap.format(body.format(n)))
            for k, body in enumerate(["<article><p>Story {}</p></article>", "<main><p>Story {}</p></main>"])
            for n in range(12)
        ]
        assert {i: t for i, (t, _) in extract(spark, rows).items()} == {i: f"Story {i % 100}" for i, _, _ in rows}


def test_words_of_names_without_an_article_are_only_a_prior(spark):
    def page(n):
        parts = "<div class='has-comments'><p>Story {0}</p></div><section id='related-work'><p>Work {0}</p></section>".format(n)
        return f"<div class='site-header'><p>Our site</p></div>{parts}<div class='cookie-bar'><p>Cookies {n % 2}</p></div>"

    rows = [(n, "http://a.example/p", page(n)) for n in range(12)]
    assert {i: t for i, (t, _) in extract(spark, rows).items()} == {n: f"Story {n}\nWork {n}" for n in range(12)}


def test_articles_in_named_noise_beside_one_outside_go(spark):
    html = "<article><p>Story</p></article><div class='{}'><article><p>Other</p></article></div>"
    for name in ("related", "comments", "widget"):
        assert one(spark, html.format(name)) == "Story"
    assert one(spark, "<aside><article><p>Other</p></article></aside><p>Text</p>") == "Text"
    assert one(spark, "<main><div class='sidebar'><p>Links</p></div><article><p>Story</p></article></main>") == "Story"


def test_other_peoples_texts_inside_article_go_without_repeating(spark):
    for name in ("id='comments'", "class='commentlist'", "class='comment-list'", "class='ad-slot'", "class='x advert-box'", "id='adSlot3'"):
        assert one(spark, f"<article><p>Story</p><div {name}><p>Other</p><article><p>Nested</p></article></div></article>") == "Story"
    own = "class='ad-hoc'", "class='comment'", "id='comments-on-theory'", "class='adverb-list'", "class='has-comments'"
    for name in own:
        assert one(spark, f"<article><p>Story</p><div {name}><p>Own</p></div></article>") == "Story\nOwn"
    assert one(spark, "<article><h2 id='comments'>Comments</h2><p>On the text</p></article>") == "Comments\nOn the text"
