import random
import time

import pytest

from garim.llm import html_text as H

LONG = "This paragraph is long enough to count as the text of an article on a page that marks none at all."

PAGES = [
    ("<article><h1>T</h1><p>a <b>b</b>c<br>d &amp; &eacute;</p></article><footer>no</footer>", "T a bc d & é"),
    ("<nav><ul><li><a href='/x'>menu</a></ul></nav><div class='ad'>buy</div><article><p>one<p>two</article>", "one two"),
    ("<script>var t='</p><article>no';</script><style>p{}</style><main>yes<!-- no --> more</main>", "yes more"),
    ("<article><p>x</p><form>no<input></form><div id='comments'><p>no</p></div><aside>no</aside><p>y</p></article>", "x y"),
    ("<div class='sidebar'>no</div><div><p>" + LONG + "</p><p>short one</p></div><div class='comment-list'>no</div>", LONG + " short one"),
    ("<article><p>1 < 2 and <a href=\"a>b\">link</a></p></article>", "1 < 2 and link"),
    ("<article>unclosed <p>rest", "unclosed rest"),
    ("<article><p>&lt;p&gt; &#x41;&nbsp;B</p></article>", "<p> A B"),
    ("<article><p>&am<b>p;</b></p></article>", "&amp;"),
    (None, ""),
    ("", ""),
    ("<", "<"),  # text, as browsers show it
    ("<p class=\"" * 50, ""),
    # Names that only look like those of other parts.
    ("<article><h2 id='related-work'>Related work</h2><section id='search-engines'><p>They index.</p></section></article>", "Related work They index."),
    ("<article><h2 class='title' id='comments'>Comments on it</h2><p>x</p><div id='comments-section'>no</div></article>", "Comments on it x"),
    (f"<div class='with-sidebar'><p>{LONG}</p></div><div id='main-sidebar'>no</div>", LONG),
    (f"<div class='page sidebar'><main><p>{LONG}</p></main><p>no</p></div>", LONG),
    (f"<form><div><p>{LONG}</p></div></form><form>Name <input></form>", LONG),
    # End tags that HTML implies.
    ("<p class='advert'>buy<p>article text", "article text"),
    ("<article><ul><li class='share'>no<li>one<li>two</ul></article>", "one two"),
    ("<article><table><tr><td class='ad'>no<td>a<tr><td>b</table><dl><dt class=ad>no<dd>c</dl></article>", "a b c"),
    ("<head><title>no</title><p>text", "text"),
    # No marks, and little text.
    ("<body><p>A whole article in one paragraph of some sixty characters.</p></body>", "A whole article in one paragraph of some sixty characters."),
    (f"<div><h1>Title</h1><p>by me</p><p>{LONG}</p><div class='ad'>buy</div><p>bye</p></div>", f"Title by me {LONG} bye"),
    (f"<div><p>{LONG}</p><p><a href='/'>All of this is a link</a></p><p>bye</p></div>", f"{LONG} All of this is a link bye"),
    # Marks inside of what is left out mark nothing.
    ("<div><p>long body</p></div><aside><article>teaser</article></aside>", "long body"),
    ("<article class='comment'>no</article><div><p>body of it</p></div>", "body of it"),
    ("<article><p>x</p><article class='comment'>no</article></article>", "x"),
    ("<a title=it's>no</a><article>don't do</article>", "don't do"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_gap_between_two_stretches():
    page = f"<div><p>{LONG}</p></div><nav>menu</nav><div><p>{LONG}!</p></div>"
    assert H.main_text(page) == f"{LONG} {LONG}!"


@pytest.mark.parametrize("unit", ["<p>w <b>x</b>", "<div>w", "<b>x", "<a href=x>y", "<p class='", "<li>x<ul>", "<div class=ad><p>x", "</div>", "<td>x", "<span><div>x</span>"])
def test_time_grows_with_the_page(unit):
    page, began = unit * (5_000_000 // len(unit)), time.time()
    H.main_text(page)
    assert time.time() - began < 30
    if unit == "<p>w <b>x</b>":
        assert H.main_text(page) == " ".join(["w x"] * (5_000_000 // len(unit)))


def by_definition(page):
    """Surges and dives over windows that are added up line by line."""
    found, weights, marked = H.lines(page)
    rows = []
    for x, w in zip(found, weights.tolist(), strict=True):
        rows += [(None, 0)] * (H.WINDOW * x.gap) + [(x, w)]
    sums = [sum(w for _, w in rows[i : i + H.WINDOW]) for i in range(len(rows))]
    least = 0 if marked else min(H.SURGE, H.SHARE * max(sums, default=0))
    out, on = [], False
    for (x, w), s in zip(rows, sums, strict=True):
        on = s > 0 if on else s > least
        if x and on and (w or x.passage and not marked):
            out.append(x.text)
    return " ".join(out)


def test_blocks_by_definition():
    rng = random.Random(5)
    tags = ["p", "div", "ul", "li", "nav", "aside", "h1", "article", "a", "b", "section", "td", "form"]
    for _ in range(400):
        page = ""
        for _ in range(rng.randrange(40)):
            tag = rng.choice(tags if rng.random() < 0.9 else ["article", "main"])
            name = rng.choice(["", "", "", " class=ad", " class='sidebar'", " id=comments"])
            page += rng.choice([f"<{tag}{name}>", f"</{tag}>", "word " * rng.choice([1, 3, 30])])
        assert H.main_text(page) == by_definition(page), page


def test_query_and_long_page(spark):
    pages = [(i, f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(99, None, "<article>" + "<p>w</p>" * 20000 + "</article>", None)]
    pages += pages[:1]  # a repeated row
    rows = H.op10(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    found = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    assert all(found[i].text == t and found[i].n_chars == len(t) for i, (_, t) in enumerate(PAGES))
    assert found[99].n_chars == 39999 and found[99].url is None
    assert H.op10(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WORDS = "The town council met on Monday and spoke about the bridge for two hours, as the mayor had asked it to do. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{WORDS}</p></article><ol class='commentlist'><li>c1 said a lot about this</li></ol>", WORDS.strip()),
        (f"<div><p>{WORDS}</p><p>{WORDS}</p></div><ol class=commentlist><li>{WORDS}</li></ol>", f"{WORDS.strip()} {WORDS.strip()}"),
        (f"<article><p>{WORDS}</p><div class='newsletter-signup-inline'>Sign up now</div><p>{WORDS}</p></article>", f"{WORDS.strip()} {WORDS.strip()}"),
        (f"<article><p>{WORDS}</p><div class='promo-xyz-newsletter'>Sign up now</div></article>", WORDS.strip()),
        (f"<div><h1>Bridge to close</h1></div><article><p>{WORDS}</p></article>", f"Bridge to close {WORDS.strip()}"),
        (f"<div><h1>The Daily</h1></div><article><h1>Bridge to close</h1><p>{WORDS}</p></article>", f"Bridge to close {WORDS.strip()}"),
        (f"<div><h1>The Daily</h1></div><p>Monday</p><article><p>{WORDS}</p></article>", WORDS.strip()),
        (f"<article><p hidden>no</p><p style='color:red; display : none'>no</p><p>{WORDS}</p><p style='display:block'>yes</p></article>", f"{WORDS.strip()} yes"),
        (f"<body style='display:none'><article><p hidden=until-found>{WORDS}</p><div hidden><p>no</p></div></article></body>", WORDS.strip()),
        (f"<article class='has-sidebar-comments-xyz'><p>{WORDS}</p></article>", WORDS.strip()),
    ],
)
def test_comments_boxes_headlines_and_hidden_elements(page, text):
    assert H.main_text(page) == text
