"""Main text of pages, and the cut behind it."""

import html
import itertools
import random
import re

from tidemark.llm.html_text import blocks_of, extract, labels_of, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var t="</p><article>no</article>";</script></head>
<body class="no-sidebar post-template"><header><a href="/">Home</a><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and tell you so in a sentence of many words.</div>
<!-- ad 1 --><div class="ad">Buy this now, with a text as long as any paragraph of the article itself.</div>
<div id="sidebar"><p>Beside the point: words that go on and on, as sidebars will, for a line or more.</p></div>
<article><header><h1>A &lt;real&gt;&nbsp; title</h1></header><p><b>First line.<br><p>Second   line,
with <a href="/x">a link</a> &amp; more.</p><ul><li>one<li>two items</ul><aside>By the way, a long aside that is no part of it.</aside>
<form><label>Name</label><input><button>Send</button></form><p>Yes.</p><blockquote>Quoted words.</blockquote>
<section class="comments"><h2>Comments</h2><p>I liked this article very much, and write a long comment about it.</p></section></article>
<footer>&copy; site &middot; All rights reserved, in a long line of words at the end.</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE).split("\n") == ["A <real> title", "First line.", "Second line, with a link & more.", "one", "two items", "Yes.", "Quoted words."]


def test_pages_without_an_article_tag():
    page = PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>").replace("<header><h1>A", "<h1>A").replace("title</h1></header>", "title</h1>")
    assert main_text(page) == main_text(PAGE)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("a < b and c > d, said a plain text") == "a < b and c > d, said a plain text"
    assert main_text("<p>unclosed <b>bold<p>second &amp paragraph") == "unclosed bold\nsecond & paragraph"
    assert main_text("<article><p>a</p><script>no end") == "a"
    assert main_text("<article><p title='>'>x &#233; &eacute;</p><!-- open") == "x é é"
    assert main_text("<article>" + "<div>" * 2000 + "deep words here" + "</div>" * 2000) == "deep words here"
    long = "<article>" + "".join(f"<p>paragraph {i} of many.</p>" for i in range(5000)) + "</article>"
    assert main_text(long).count("\n") == 4999
    assert len(blocks_of("<" * 5000)) <= 1


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 8)
        source, sink = [rng.choice([0, rng.random() * 3]) for _ in range(n)], [rng.choice([0, rng.random() * 3]) for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            return sum(t if k else s for k, s, t in zip(side, source, sink)) + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(source, sink, edges)) - best) < 1e-9


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<p>" + "😀 words " * 9, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(pages).collect()), key=repr)
    assert [(i, u, len(t)) for i, u, t, n in got] == [(i, u, n) for i, u, t, n in got] and len(got) == 5
    assert got[0][2] == got[1][2] == main_text(PAGE)
    assert (2, None, "", 0) in got and (None, "v", "", 0) in got
    assert extract(pages.limit(0)).count() == 0


def prose(n):
    return "".join(f"<p>Paragraph {i} of this text goes on for some words, as the paragraphs of most texts will.</p>" for i in range(n))


def test_names_that_tell_of_a_subject():
    plain = main_text(PAGE)
    for attributes in ('class="post-12 type-post category-search tag-social tag-form"', 'id="discussion"', 'class="post share related"', 'aria-label="Banner notice"'):
        assert main_text(PAGE.replace("<article>", f"<article {attributes}>")) == plain
    for tag in ('section id="discussion"', 'section id="related-work"', 'div id="history-of-advertising"', 'div class="category-search"', 'section id="form"'):
        page = f'<nav><a href="/">Home</a></nav><article><h1>Title</h1>{prose(3)}<{tag}><h2 id="search">Results</h2>{prose(3)}</{tag.split()[0]}></article>'
        assert main_text(page).split("\n") == ["Title", *main_text("<article>" + prose(3)).split("\n"), "Results", *main_text("<article>" + prose(3)).split("\n")], tag
    assert main_text('<article><h2 id="related-work">Related work</h2><p>See the others.</p></article>') == "Related work\nSee the others."


def test_much_text_outweighs_a_name():
    whole = main_text("<article>" + prose(60))
    for name in ("social", "search-form", "related", "banner"):
        assert main_text(f'<div class="{name}">{prose(60)}</div>') == whole
        assert main_text(f'<article>{prose(9)}</article><div class="{name}">{prose(2)}</div>') == main_text("<article>" + prose(9))
        links = "".join(f'<li><a href="/{i}">Another page of this site, with a long title of many words</a></li>' for i in range(60))
        assert main_text(f'<main>{prose(9)}<div class="{name}"><ul>{links}</ul></div></main>') == main_text("<article>" + prose(9))
    assert main_text(f'<div class="sidebar">{prose(300)}</div>') == main_text("<article>" + prose(300))
    for name in ("comments", "sidebar", "newsletter"):
        assert main_text(f'<article>{prose(20)}<div class="{name}">{prose(40)}</div></article>') == main_text("<article>" + prose(20))
    assert main_text(f'<article>{prose(2)}<div class="post" hidden>{prose(60)}</div><div role="dialog">{prose(4)}</div></article>') == main_text("<article>" + prose(2))


def test_no_name_empties_an_article():
    text = main_text("<article>" + prose(3))
    for page in (f'<article id="search-history">{prose(3)}</article>', f'<div class="content sidebar-right"><article>{prose(3)}</article></div>', f'<div class="market-share"><article>{prose(3)}</article></div>', f'<form id="aspnet"><nav><a href="/">Home</a></nav><article>{prose(3)}</article></form>', f'<article><section id="related-work">{prose(3)}</section></article>'):
        assert main_text(page) == text, page
    comments = f'<section class="comments"><article class="comment">{prose(2)}</article><article class="comment">{prose(1)}</article></section>'
    assert main_text(f"<article>{prose(3)}</article>{comments}") == text
    assert main_text(f'<nav><article>{prose(1)}</article></nav><article>{prose(3)}</article>') == text


def test_attributes_and_inline_elements():
    assert main_text("<article><p title=it's>One, two.<p data-x='>' class=\"a>b\">Three.<p title=a\"b>Four.") == "One, two.\nThree.\nFour."
    assert main_text('<article><p>Before <span class="ad">buy <span>this</span> now</span>after <span style="display: none">not <i>this</i></span>it.<p>Then <b hidden>no</b>more.') == "Before after it.\nThen more."
    assert main_text('<article><p>An <span class="address">old</span> street, <span hidden>unclosed<p>Next one.') == "An old street,\nNext one."
    assert main_text('<article><p title="class=ad hidden">Kept as it is.') == "Kept as it is."


def test_the_cut_decides():
    """Lines too short to tell, and text that alone would be taken for content, are labelled by what is around them."""
    page = f'<div><div><h1>A title</h1>{prose(2)}<p>So.</p>{prose(2)}</div><div class="sidebar">{prose(1)}</div></div>'
    blocks, odds, content = labels_of(page)
    flipped = {b[0][:9]: keep for b, x, keep in zip(blocks, odds, content) if keep != (x > 0)}
    assert flipped == {"So.": True, "Paragraph": False} or flipped == {"So.": True, "Paragraph": False, "A title": True}
    assert main_text(page).split("\n")[3] == "So." and main_text(page).count("Paragraph") == 4


def test_deep_and_broken_pages():
    deep = 40_000
    assert main_text("<article>" + "<div>" * deep + "<p>One line of text.</p>" + "</div>" * deep + "<p>And more text.</p></article>") == "One line of text.\nAnd more text."
    assert main_text("<article><x>" * 3000 + "<p>One line of text.</p>" + "</section>" * 30_000).startswith("One line")
    assert main_text("<article><ul>" + "<li>an item of many" * 3000).count("\n") == 2999


def test_query_against_loops(spark):
    """Every page of the table against what stands between its article tags, taken apart by plain patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        kept = [b[0] for b, keep in zip(*labels_of(r.html)[::2]) if keep]
        assert got[r.page_id] == ("\n".join(kept), len("\n".join(kept)))
        article = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        if article:
            plain = re.sub(r"<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "", article[1], flags=re.S)
            plain = re.split(r"</?(?:p|h\d|ul|li|div|section|blockquote|table|tr|td)[^>]*>", plain)
            plain = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in plain]
            assert kept == [x for x in plain if x]
