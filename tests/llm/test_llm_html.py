from balsam.llm import html_extract as H

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><style>p{{margin:0}}</style>
<script>var t="</p><article>";</script></head><body class="home"><header><a href="/">Site</a></header>
<nav><ul><li><a href=/a>Home<li>About</ul></nav><!-- <article>no</article> --><div class="ad">Buy {i}</div>
<main><article><header><h1>Title {i}</h1></header><p>First <b>bold</b>line<br>x &lt; y &amp&copy;<p>Second\n  &nbsp; one.
<aside>Aside</aside><form><button>Go</button></form><p>A line that repeats.<div class="comments"><p>Nice!</p></div>
<ul><li>one<li>two</ul></article></main><div id='sidebar'>Side</div><footer>&copy; host</footer></body></html>"""
WANT = "Title {i} First boldline x < y &© Second one. A line that repeats. one two"

SOUP = """<html><body><div class="top"><span>Welcome to the site</span></div><div class="x9"><p>Story number {i}
is told here.</p><p>{j} more words</p></div><div class="end"><span>All rights reserved</span></div>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_slots(spark):
    rows = [(i, f"http://Host.example.com/{i}", PAGE.format(i=i)) for i in range(5)] + [(9, "http://one.example.org", PAGE.format(i=9))]
    got = {r["page_id"]: r["text"] for r in H.extract_text(pages(spark, rows)).collect()}
    assert got == {i: WANT.format(i=i) for i in (0, 1, 2, 3, 4, 9)}


def test_template_text_goes_where_there_is_no_article(spark):
    rows = [(i, "http://h.example.com/", SOUP.format(i=i, j=i * 7)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in H.extract_text(pages(spark, rows)).collect()}
    assert got == {i: f"Story number {i} is told here. {i * 7} more words" for i in range(6)}


def test_classes_share_an_occurrence_vector(spark):
    rows = [(f"h{i % 2}", i, SOUP.format(i=i, j=i)) for i in range(6)]
    d = spark.createDataFrame(rows, "host string, uid long, html string")
    got = H.templates(d).collect()
    other = H.tokens(SOUP.format(i=2, j=2))
    fixed = {k: n for k, n in H.tokens(SOUP.format(i=1, j=1)).items() if k in other}
    # two tags occur more often: the paragraphs' and the outer blocks', each alone in its class
    once = [k for k, n in fixed.items() if n == 1]
    assert sorted(n for n in fixed.values() if n > 1) == [2, 3]
    for r in got:
        assert sorted(r["template"]) == sorted(once) and r["classes"] == 1


def test_names_do_not_drop_articles():
    """Names are matched as a whole and never for the page's own frame."""
    for page in ("<body class='has-sidebar'><article class='post comments-open'><p>Told here.</p></article>",
                 "<body class='sidebar' id=menu><main class=search><article id='share'><p>Told here.",
                 "<div class='with-sidebar'><p>Told here.</p></div>",
                 "<article><div class='side-by-side'>Told</div><p data-id='menu' class='search-results'>here.</p></article>"):
        assert H.extract(page, frozenset()) == "Told here.", page


def test_raw_names_inside_other_tags():
    page = "<article><template-card>Told</template-card> <svg/> <svg class='i' /> <p>here.</p><svg><text>no</text></svg></article>"
    assert H.extract(page, frozenset()) == "Told here."


def test_a_named_element_goes_only_with_template_support(spark):
    page = "<body><article><h1>Number {i}</h1><div class=related>More {i} of it</div>{x}</article><p>End</p></body>"
    rows = [(i, "http://h.example.com/", page.format(i=i, x="<p class=notice>Kept here.</p>" * (i == 3))) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in H.extract_text(pages(spark, rows)).collect()}
    assert got == {i: f"Number {i}" + " Kept here." * (i == 3) for i in range(6)}


def test_repeated_pages_keep_their_text(spark):
    page = "<html><body><div class=menu>Home</div><div><p>Story {i} told here.</p><p>More of {i}.</p></div></body></html>"
    rows = [(1, "http://a.example/1", page.format(i=1)), (2, "http://a.example/2", page.format(i=1)), (3, "http://a.example/3", page.format(i=3))]
    rows += [(4, "http://b.example/1", page.format(i=4))] * 3 + [(5, "http://c.example/1", page.format(i=5)), (6, "http://c.example/2", page.format(i=5) + " ")]
    rows += [(100 + i, "http://d.example/x", page.format(i=i // 10)) for i in range(40)]  # four pages, ten times each
    for url in ("url", "'http://d.example/' || page_id AS url"):
        got = H.extract_text(pages(spark, rows).selectExpr("page_id", url, "html")).collect()
        assert len(got) == len(rows)
        for r in got:
            i = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}.get(r["page_id"], (r["page_id"] - 100) // 10)
            assert f"Story {i} told here. More of {i}." in r["text"]


def test_support_counts_different_pages(spark):
    rows = [("h", f"<p>Same</p><b>x</b><i>{i % 4}</i>") for i in range(40)] + [("h", f"<u>{i}</u>") for i in range(3)]
    d = spark.createDataFrame(rows, "host string, html string").repartition(5)
    assert sorted(r["html"] for r in H.distinct_pages(d).collect()) == sorted({h for _, h in rows})
    got = H.templates(d).collect()
    want = {k for k in H.tokens(rows[0][1]) if k in H.tokens(rows[1][1])}
    assert [set(r["template"]) for r in got] == [want]  # on 4 of 7 pages


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", ""), (2, "not a url", "plain text"), (None, "http://x/", "<p>a<"),
            (3, "http://x/", "<article><p>cut off &am"), (4, "http://x/", "<p>unclosed <a href='x"),
            (5, "http://x/", "<div>" * 3000 + "deep"), (6, "http://x/", "<article>" + "word " * 40_000),
            (7, "http://x/", "<<>> 1 < 2 </nope> &#x41;&#65;"), (8, "http://x/", "<script>x")]
    got = H.extract_text(pages(spark, rows).selectExpr("*", "html as host", "url as key")).collect()
    assert len(got) == len(rows)
    n = {r["page_id"]: r["text"] for r in got}
    assert n[1] == "" and n[3] == "cut off &am" and n[5] == "deep" and n[8] == ""
    assert n[6] == ("word " * 40_000).strip()
    assert H.extract_text(pages(spark, [])).count() == 0


SHOP = """<html><body><div class="row"><span>Share</span><p>{a}</p><b>Price</b></div><div class="row"><span>{b}</span><p>by us</p>
</div><div class="row"><span>Terms</span></div>"""


def test_roles_are_told_apart_by_the_class_around_them(spark):
    """A text of the template that some pages have as data, too: by its path alone it is in no class."""
    rows = [(i, "http://s.example.com/", SHOP.format(a=f"Item {i}", b="Share" if i % 3 == 0 else f"No {i}")) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in H.extract_text(pages(spark, rows)).collect()}
    assert got == {i: f"Item {i} " + ("Share" if i % 3 == 0 else f"No {i}") for i in range(9)}


def test_classes_are_ordered_and_nested(spark):
    a, b, c = "<div><i>One</i></div>", "<div><b>Two</b></div>", "<div><u>Three</u></div>"
    rows = [("h", f"{x}<p>{i}</p>") for i, x in enumerate([a + b + c, b + a + c, a + b + c, b + a + c])]
    rows += [("g", f"<ul>{'<li>x' * 2}</ul>{'<p><a>y</a>' * 2}{i}") for i in range(4)]
    got = {r["host"]: r["levels"] for r in H.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    for host, page in rows:
        t = H.Template(got[host])
        seq = H.sequence(page)
        for n, level in enumerate(t.levels):
            roles = H.Template(got[host][:n + 1]).roles(seq)
            assert not level.conflicts(roles) and not level.walk(roles)[1]
    one, two = (H.sequence(x)[-2:] for x in (a, b))
    of = {r: c for c, roles in enumerate(got["h"][0]) for r in roles}
    assert of[one[0]] == of[one[1]] != of[two[0]] == of[two[1]]  # they change places, so not one class


def test_crossing_classes_are_broken():
    level = H.Level([[1, 2, 3], [4, 5]])
    assert level.walk([1, 4, 2, 5, 3])[1] == {(4, 1)}
    assert H.uncrossed(level.classes, {1: 9, 2: 9, 3: 9, 4: 5, 5: 5}, {(4, 1)}, False) == [[1, 2, 3], [4], [5]]
    assert H.uncrossed(level.classes, {1: 9, 2: 9, 3: 9, 4: 5, 5: 5}, {(4, 1)}, True) == [[1], [2], [3], [4], [5]]
    before = level.walk([9, 1, 4, 9, 5, 9, 2, 9, 3, 9])[0]
    assert [before[i] for i in (0, 3, 5, 7, 9)] == [0, 4, 1, 2, 0]
