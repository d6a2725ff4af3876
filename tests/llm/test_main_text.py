"""Main text of pages: the scan against brute force, layouts of many kinds, awkward rows."""

import random

import pytest

from folioframe.llm import main_text

TEXT = ["A title of a page", "The first paragraph says a few words, and then a few more of them.", "Short.", "The last one tells about R&D © 2020 and ends here."]
WANT = "\n\n".join(TEXT)
BODY = f"<h1>{TEXT[0]}</h1><p>The first <b>paragraph</b>\n says a&nbsp;few words,<br>and then a few <a href=x>more</a> of them.<p>{TEXT[2]}</p><p>The last one tells about R&amp;D &copy; 2020 and ends here."
MENU = "<nav><ul>" + "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(12)) + "</ul></nav>"
FOOT = "<footer>&copy; Somebody with rather many words of a notice that nobody reads at all</footer>"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>No</title><style>p{{}}</style></head><body>{MENU}<article>{BODY}</article>{FOOT}</body></html>",
        f"<body><div class=menu><a>Home</a> <a>About</a></div><div id='content'>{BODY}</div><div class='site-footer'>All rights reserved by us</div>",
        f"<HTML><BODY><TABLE><TR><TD><A HREF=a>One</A><TD>{BODY}</TABLE>",
        f"{MENU}<main><article class=post><header>{BODY}</article></main><aside><h2>Related</h2><p>Some other story with quite some words in it</p></aside>",
        f"<body class='has-sidebar ads'><div class='page with-sidebar'><article>{BODY}</article><div class=sidebar><p>An aside of words</div></div>",
        f"<article>{BODY.replace('<p>Short', '<div class=ad-slot>Buy now ' + 'a thing ' * 80 + '</div><p>Short')}<section id=comments><h2>2 comments</h2><article><p>I agree with all of this</p></article></section></article>",
        f"<form action=x>{MENU}<article>{BODY}</article><input name=q><button>Go</button></form>{FOOT}",
        f"<script>var a='<p>not</p>';</script><!-- <p>nor this</p> --><article>{BODY}</article><form><label>Name</label><input></form><noscript>Turn it on</noscript>",
        f"<div role=banner>Our site, the best of all sites there are</div><div role='main'>{BODY}</div><div hidden>unseen words in a box</div><div style='display: none'>more of these</div>",
        f"<div class='cookie-notice'><p>We use cookies to make your visit better, do you agree with that?</p></div>{MENU}<article>{BODY}</article>",
    ],
)
def test_layouts(html):
    assert main_text.main_text(html, {}) == WANT


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("   ", ""), ("<", "<"), ("<nav><a>Home</a></nav>", ""), ("<form>Log in <input></form>", ""), ("<div class=cookies>We use cookies</div>", ""),
        ("<article></article>", ""), ("<article>a < b &lt; c &#233;&#x1F600;&bogus; &amp;amp;</article>", "a < b < c é😀&bogus; &amp;"),
        ("<article><p title='>'>x<p class=\"a>b\">y</article>", "x\n\ny"), ("<p>one <img alt='a\" b>two", "one two"), ("<article><ul><li>a<li>b<ul><li>c</ul></ul></article>", "a\n\nb\n\nc"),
        ("<article><script>never closed <p>x", ""), ("<article><p>said<!-- never closed <p>x", "said"), ("<article><p>x" + "<br>" * 500 + "<p>end</article>", "x\n\nend"),
    ],
)
def test_awkward_pages(html, want):
    assert main_text.main_text(html, {}) == want


def test_scan_against_all_regions():
    rng = random.Random(3)
    for _ in range(400):
        scores = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) for _ in range(rng.randrange(0, 14))]
        start, end = main_text.best_region(scores)
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:end]) == max(best, 0)


def test_long_pages_take_linear_time():
    for unit in ("<div>", "<p>", "<li>a", "</div>", "<a href='", '"', "<!--", "&", "<x", "< ", "<ul><li><b>"):
        main_text.main_text("<article>" + unit * 50_000, {})
    long = "<article>" + "".join(f"<p>word {k} of many</p>" for k in range(50_000)) + "</article>"
    assert main_text.main_text(long, {}).count("\n\n") == 49_999


def test_weights_are_learnt(spark):
    """Where lists in plain boxes stand outside on labelled pages, they are left out on others too."""
    box = "<div>" + "<ul>" + "<li>read this as well and more of it</li>" * 3 + "</ul></div>"
    rows = [(f"{box}<article><p>{'word ' * 50}</p></article>{box}",) for _ in range(60)]
    counts = main_text.fit(spark.createDataFrame(rows, "html string"))
    page = f"{box}<div><p>{'word ' * 30}</p></div>{box}"
    assert main_text.main_text(page, counts) == ("word " * 30).strip()
    assert "read this" in main_text.main_text(page, {})
    assert counts[("word", "li", False, "")] == (0, 60 * 6 * 8)


def test_query(spark, tmp_path):
    rows = [(1, "u", f"{MENU}<article>{BODY}</article>", "t"), (1, "u", f"{MENU}<article>{BODY}</article>", "t"), (None, None, None, None), (2**60 + 1, "v", "", "t"), (4, None, "<p>a b</p>", "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in main_text.op12_main_text(spark, str(tmp_path)).select("page_id", "url", "text", "n_chars").collect()]
    want = [(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0), (2**60 + 1, "v", "", 0), (4, None, "a b", 3)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert main_text.op12_main_text(spark, f"{tmp_path}/none").collect() == []
