"""Extraction on hand-made pages with known articles, and on the generated pages against their article element."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from gridmark.llm.extract import extract, main_text, strange_name

LONG = "The committee met on Tuesday, and after a long debate, it agreed on the plan; nobody objected."
PAGES = [
    # no article element: ratios decide
    (f"<body><div class=top><a href=/>Home</a> <a href=/b>News</a></div><div id=c><h2>Title here</h2><p>{LONG}</p><p>{LONG} More &amp; more.</p></div>"
     "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div class='site-footer'>&copy; us</div></body>",
     f"Title here\n{LONG}\n{LONG} More & more."),
    # what stands inside the article but is none of it
    (f"<article><header>By A</header><h1>Head\n  line</h1><p>{LONG}<br>next</p><aside>see also</aside><form>Mail <input></form>"
     f"<ul><li>first point<li>second point</ul><section class=\"comments\"><p>{LONG}</p></section><footer>tags</footer></article>",
     f"Head line\n{LONG} next\nfirst point\nsecond point"),
    ("<article><div class='entry-header'><h1>T</h1></div><p>Short.</p><div class='cookie-notice'>We use cookies, really, all of them.</div></article>", "T\nShort."),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>Only &lt;this&gt; &#233;&nbsp;x</p><!-- <p>not</p> -->", "Only <this> é x"),
    ("<p>unclosed <b>bold<p>second", "unclosed bold\nsecond"),
    ("plain text, without tags", "plain text, without tags"),
    ("a < b", "a < b"),
    ("<nav><a href=x>menu</a></nav>", ""), ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("</p></div>", ""), ("<article></article>", ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_known_articles(page, want):
    assert main_text(page) == want


CARD = "<article class=card><p>Read more here.</p></article>"
INSIDE = [("<ul><li>first point</li><li>next point</li><li>third point</li></ul>", "first point\nnext point\nthird point"),
          ("<table><tr><td>cell one<td>cell two</table>", "cell one\ncell two"), ("<blockquote><div>short quote</div></blockquote>", "short quote")]


@pytest.mark.parametrize(("part", "lines"), INSIDE)
def test_short_blocks_inside_a_div(part, lines):
    page = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div id=c>{f'<p>{LONG}</p>' * 3}{part}<p>{LONG}</p></div></body>"
    assert main_text(page) == "\n".join([LONG] * 3 + [lines, LONG])


def test_teaser_cards_do_not_hide_the_page():
    for card in (CARD, "<ul><li class=article-link><a href=x>Another story</a></ul>"):
        got = main_text(f"<body><div class=text>{f'<p>{LONG}</p>' * 4}</div>{card}</body>").splitlines()
        assert got[:4] == [LONG] * 4


def test_rows(spark):
    df = spark.createDataFrame([(i if i else None, None, p, "t") for i, (p, _) in enumerate(PAGES)] + [(1, None, PAGES[1][0], "t")],
                               "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted(
        (str(i or None), t, len(t)) for i, t in [*((i, w) for i, (_, w) in enumerate(PAGES)), (1, PAGES[1][1])])
    assert extract(df.limit(0)).count() == 0


def test_very_long_page():
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").splitlines()) == 20_000
    main_text("<div>" * 3000 + LONG)


KEPT = [(f"<article><div class='notice-period'><p>{LONG}</p></div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='share-price'>{LONG}</div></article>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>one link</a><li><a href=2>two</a></ul><p><a href=3>only a link</a></p></article>", f"{LONG}\none link\ntwo\nonly a link"),
        (f"<article><p>super<wbr>cali</p><p>{LONG}</p></article>", f"supercali\n{LONG}"),
        (f"<body><form id=aspnet><div class=post><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div></div><div class=user-comments><p>{LONG}</p></div></form></body>", f"T\n{LONG}\n{LONG}"),
        (f"<body><div id=w><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><p>Short, but the same path.</p></section></div><div>Ad.</div></body>",
         f"{LONG}\n{LONG}\n{LONG}\nShort, but the same path.")]


@pytest.mark.parametrize(("page", "want"), KEPT)
def test_names_and_links_do_not_cost_text(page, want):
    assert main_text(page) == want


def test_names():
    assert all(map(strange_name, ["ad", "site-footer", "cookieNotice", "share_buttons", "comments-list", "navbar"]))
    assert not any(map(strange_name, ["notice-period", "share-price", "entry-header", "article-comments", "content", "reader", "adapter"]))


@pytest.mark.parametrize("page", ["<a " * 350_000 + '"', '<a ">"' * 170_000, "<div>A sentence, with marks. " * 36_000, "<div>" * 200_000 + "x" + "</p></b>" * 5000,
                                  "<b>" * 170_000 + "</i>" * 120_000, "<li><p>x" * 130_000, "<p class='" * 100_000])
def test_ill_formed_megabytes_take_linear_time(page):
    spent = []
    for part in (page[:len(page) // 4], page):
        start = time.process_time()  # not the clock, so that other work on the machine does not count
        main_text(part)
        spent.append(time.process_time() - start)
    assert spent[1] < max(12 * spent[0], 3)  # square growth would take sixteen times as long, and minutes


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.select("page_id", F.col("html")).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_generated_pages_without_names(spark):
    """With every region a plain div the ratios alone decide: most articles are found, and none without them."""
    right = off = n = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = [x for x in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body)) if x]
        page = re.sub(r"<(/?)(?:nav|header|footer|aside|form|article)\b", r"<\1div", r.html)
        right += main_text(page).splitlines() == want
        off += main_text(page, threshold=0).splitlines() == want
        n += 1
    assert right >= 0.9 * n and off == 0
