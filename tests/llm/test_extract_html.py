import itertools
import random
import time

from taproom.llm import extract_html as X

SCHEMA = "page_id long, url string, html string, blocks string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><ul><li><a href="/">Home</a></li></ul></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="cookie-notice">We use cookies. Accept them.</div>
<!-- <p>not here</p> --><div class=ad>Buy this now, it is a very good thing to buy.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;words<br>go on.<p>Ti.
<p>A longer paragraph of text, which says something &lt;b&gt; useful.</p><aside>See also this other page.</aside><ul><li>Point one<li>Point two</ul>
<form>Name <input name=x> <button>Send</button></form><p hidden>secret</p></article>
<section id="comments"><p>I liked this article a lot, thank you for writing it.</p></section>
<footer>&copy; me</footer></body></html>"""


def text(page):
    return "\n".join(t for t, c in X.labelled(page) if c)


def test_article_only():
    assert text(PAGE) == (
        "Title & more\nFirst bold words go on.\nTi.\nA longer paragraph of text, which says something <b> useful.\nPoint one\nPoint two"
    )


def test_page_without_hints_keeps_prose_and_drops_links():
    prose = "<p>" + "Plain words that form a sentence of some length, again and again. " * 3 + "</p>"
    page = "<div><a href=1>Home</a> <a href=2>About</a></div>" + prose * 3 + "<div><a href=3>Terms of use</a></div>"
    assert text(page).count("\n") == 2 and "Home" not in text(page) and "Terms" not in text(page)


def test_cut_off_and_broken_markup():
    assert text("<article><p>One sentence is here now.</p><p>Two is cut off &am") == "One sentence is here now.\nTwo is cut off &am"
    assert text("<article><p>One sentence is here now.</p><p class='x") == "One sentence is here now."
    assert text("<article><p>One sentence is here now.</p><!-- open") == "One sentence is here now."
    assert text("<article><p>a < b and 3 > 2 is <em>true</p>still the article text.</article>") == "a < b and 3 > 2 is true\nstill the article text."
    assert text("") == "" and text("<script>alert(1)") == "" and text(" \n ") == ""
    assert text("<article>" + "<div>" * 3000 + "Deep text is still found here.") == "Deep text is still found here."


def test_articles_in_forms_and_under_mixed_class_names():
    prose = "<p>" + "Plain words that form a sentence of some length, again and again. " * 3 + "</p>"
    frame = "<nav><a href=/>Home</a></nav>%s<footer>&copy; me</footer>"
    for body in (
        "<form>%s</form>", "<form><article>%s</article></form>", "<form><label>Name</label><input name=q><select><option>One</select>%s",
        "<div class='content has-sidebar'>%s</div>", "<div class='post comments-open'>%s</div>", "<div id='main' class='with-related'>%s</div>",
        "<div class='widget'>%s</div>", "<main><form>%s</form></main>",
    ):
        for times in (1, 4):
            assert text(frame % (body % (prose * times))).count("Plain words") == 3 * times, body
    join = "<form>Join us and read one more long letter on every single day of the whole coming week. <button>Go</button></form>"
    assert "Join" not in text(frame % (join + "<article>" + prose + "</article>")) + text(frame % ("<article>" + prose * 2 + join + "</article>"))
    assert "Join" not in text(frame % (prose * 3 + join)) and "Join" not in text(frame % ("<div class=sidebar>" + join + "</div>" + prose))
    for alone in ("comments", "cookie-notice", "post-comments"):
        assert text(frame % f"<div class='{alone}'>{prose}</div>") == ""


def test_long_broken_and_deep_pages_take_time_in_proportion():
    for page in (
        '<a "' * 100_000, "<a '<a \"" * 50_000, "<a" * 200_000 + '"> x', "<!--" * 100_000, '</a "' * 100_000, "<div>" * 50_000 + "</p></b>" * 50_000,
        "<b>" * 50_000 + "<div></div></b>" * 30_000, "<li><td>" * 30_000 + "<div></div>" * 30_000, "<p>aa bb cc dd.</p>" * 5000,
    ):
        began = time.process_time()
        X.labelled(page)
        assert time.process_time() - began < 10, page[:20]


def test_raw_text_ends_at_its_own_place():
    assert text("<article>\u0130\u0130\u0130<script>x</SCRIPT>After the script comes one more sentence.</article>").endswith("After the script comes one more sentence.")
    assert text('<article><p>One sentence is <a href="x>here now.</p><p>Two follows at once.</p></article>').endswith("Two follows at once.")


def test_minimum_cut_is_least():
    draw = random.Random(4)
    for _ in range(300):
        n = draw.randint(1, 8)
        margins = [draw.choice([-5, -3, -1, 0, 1, 2, 4]) for _ in range(n)]
        edges = [(a, b, draw.randint(1, 4)) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]

        def cost(label):
            own = sum(max(m, 0) if not x else max(-m, 0) for m, x in zip(margins, label))
            return own + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(X.minimum_cut(margins, edges)) == best


def test_smoothness_moves_an_unsure_block():
    assert X.minimum_cut([500, -50, 500], [(0, 1, 200), (1, 2, 200)]) == [True, True, True]
    assert X.minimum_cut([-500, 50, -500], [(0, 1, 200), (1, 2, 200)]) == [False, False, False]


def test_table_cases(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "x"), (3, "w", "<article><p>" + "long words here. " * 20000, "x")]
    got = X.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text[:12] for r in got) == ["", "", "Title & more", "Title & more", "long words h"]
    assert max(len(r.text) for r in got) == 17 * 20000 - 1
    assert X.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages_keep_their_article(spark):
    got = X.main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    assert len(got) == 50 and all(r.text and "©" not in r.text for r in got)
