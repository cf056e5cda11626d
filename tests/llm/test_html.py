import math
import random

import pytest

from pixelplan.llm import html
from pixelplan.llm.html import main_text

ARTICLE = ["A title", "First paragraph with a link, some words and more words & signs.", "Tiny.", "Second block goes on over lines with emphasis.", "item one", "item two", "quoted text of some length, no more than that", "cell a", "cell b", "Last words"]
INNER = """<h1>A title</h1><p>First paragraph with <a href="/x">a link</a>, some words
 and   more words &amp; signs.<p>Tiny.<div>Second block <b>goes on
over lines with</b> emphasis.</div><script>if (a < b) { document.write("<p>no</p>") }</script><ul><li>item one<li>item two</ul>
<blockquote>quoted text of some length, <i>no more</i> than that</blockquote><!-- <p>gone</p> --><table><tr><td>cell a<td>cell b</table>
<aside>A side note</aside><div class="share-buttons"><a href="#">Share</a></div>Last&nbsp;words"""
AROUND = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Site name</a></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies on this site, do you agree?</div>
<div id="main">%s</div><div class="sidebar"><p>Read these too, they are long enough to look like text.</p></div>
<form><label>Your mail</label><input name=q value="x>y"><button>Send</button></form>
<section id="comments"><h2>2 comments</h2><p>I think so too, and here I say at length why I think so.</p></section>
<div class="ad">Buy this, it is a good thing to buy and cheap, buy it now.</div><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class='post'>%s</div>", "<main><div><section>%s</section></div></main>"])
def test_article_without_what_is_around(wrap):
    assert html.main_text(AROUND % (wrap % INNER)).split("\n") == ARTICLE


@pytest.mark.parametrize("names", ["class='content-sidebar-wrap'", "class='layout has-sidebar'", "id='page-with-nav'", "class='related-work'"])
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>"])
def test_wrappers_named_after_what_they_hold_stay(names, wrap):
    long = INNER + "<p>" + "More words of the article. " * 20 + "</p>"
    want = [*ARTICLE, " ".join(["More words of the article."] * 20)]
    page = f"<body><nav><a href=x>menu</a></nav><section {names}>{wrap % long}<div class='sidebar'><p>Read these too.</p></div></section></body>"
    assert html.main_text(page).split("\n") == want


def test_sections_stay_together():
    parts = ["".join(f"<p>{'words of section %d ' % k * (3 + 4 * k)}</p>" for _ in range(k + 1)) for k in range(3)]
    page = "<body><nav><a href=x>menu</a></nav><div>" + "".join(f"<section>{p}</section>" for p in parts) + "</div></body>"
    assert len(html.main_text(page).split("\n")) == 6


@pytest.mark.parametrize("page", [None, "", " ", "<", "<<>><p", "<script>x", "<!--", "<nav>only a menu</nav>", "</p></div>", "<p></p><div></div>"])
def test_nothing_to_find(page):
    assert html.main_text(page) in ("", "<", "<<>>", "<<>") or page == "<<>><p"


def test_odd_markup():
    assert html.main_text("plain text, no markup at all") == "plain text, no markup at all"
    assert html.main_text("<p>a<br>b</p><P TITLE='x>y'>c &lt;d&gt; &#8364;&eacute;") == "a b\nc <d> €é"
    assert html.main_text("<article><p>cut off <b>in the mid") == "cut off in the mid"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html.main_text(deep) == "deep"


def test_densities():
    root = html.parse("<body><div><a href=x>link text here</a></div><div>plain text here</div></body>")
    html.measure(root)
    first, second = root.parts[0].children()
    assert (first.chars, first.tags, first.link_chars, first.link_tags) == (12, 1, 12, 1)
    assert second.density > first.density >= 0
    assert root.parts[0].total == first.density + second.density


def plain_density(tree, share, linked=False):
    """Characters, tags, link characters, link tags and density of a tree (tag, parts), from the definition."""
    tag, parts = tree
    linked = linked or tag == "a"
    chars = sum(len(x) for x in parts if isinstance(x, str))
    out = [chars, 0, chars * linked, 0]
    for x in parts:
        if not isinstance(x, str):
            c, t, lc, lt, _ = plain_density(x, share, linked)
            out = [out[0] + c, out[1] + t + 1, out[2] + lc, out[3] + lt + (linked or x[0] == "a")]
    c, t, lc, lt = out
    if not c:
        return (*out, 0.0)
    base = math.log(c / max(1, c - lc) * max(1, lc) + share * c + math.e)
    return (*out, max(0.0, c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, lt)) / math.log(base)))


def test_densities_and_choice_equal_the_definition():
    r = random.Random(4)

    def grow(depth):
        parts = [r.choice(["div", "section"])]
        own = [("x" * r.randint(1, 40)) if r.random() < 0.5 or depth == 0 else grow(depth - 1) if r.random() < 0.7 else ("a", ["y" * r.randint(1, 20)]) for _ in range(r.randint(1, 4))]
        return (parts[0], own)

    def text(tree):
        return f"<{tree[0]}>" + "".join(x if isinstance(x, str) else text(x) for x in tree[1]) + f"</{tree[0]}>"

    def every(tree):
        return [tree, *(y for x in tree[1] if not isinstance(x, str) for y in every(x))]

    for _ in range(200):
        tree = ("body", [grow(3), grow(2)])
        c, _, lc, _, _ = plain_density(tree, 0)
        share = lc / c
        root = html.parse(text(tree))
        html.measure(root)
        nodes, stack = [], [root.parts[0]]
        while stack:
            node = stack.pop()
            nodes.append(node)
            stack.extend(reversed(list(node.children())))
        links = []

        def mark(t, linked=False):
            links.append(linked)
            for x in t[1]:
                if not isinstance(x, str):
                    mark(x, linked or t[0] == "a")

        mark(tree)
        want = [plain_density(t, share, inside) for t, inside in zip(every(tree), links, strict=True)]
        assert [(n.chars, n.tags, n.link_chars, n.link_tags, n.density) for n in nodes] == want
        sums = {id(t): sum(plain_density(x, share)[4] for x in t[1] if not isinstance(x, str)) for t in every(tree)}
        assert [n.total for n in nodes if n.tag != "a"] == pytest.approx([sums[id(t)] for t in every(tree) if t[0] != "a"])
        core = max(nodes, key=lambda n: (n.total, n.density))
        found, threshold = html.select(root)
        path = [core]
        while path[-1] is not root.parts[0]:
            path.append(path[-1].parent)
        assert threshold == min(n.density for n in path) and found in path


def test_names_inside_the_article_do_not_remove_it():
    body = "".join(f"<p>{'words of paragraph %d ' % k * 6}</p>" for k in range(4))
    page = f"<body><nav><a href=x>menu</a></nav><div><h2 class='header'>Heading</h2><p class='notice-period'>Three months.</p><div class='market-share'>A third of it.</div><p class='comment'>A remark.</p>{body}<div class='share-buttons'><a href=x>Share</a></div><div class='post-comments'><p>I think so too.</p></div></div><div class='cookie-bar'>Cookies here, yes?</div></body>"
    lines = html.main_text(page).split("\n")
    assert lines[:4] == ["Heading", "Three months.", "A third of it.", "A remark."] and len(lines) == 8


def test_article_elements_have_no_say():
    body = "".join(f"<p>{'words of paragraph %d ' % k * 9}</p>" for k in range(3))
    assert html.main_text(f"<body><article><a href=x>Other</a> <a href=y>teasers</a></article><div><h1>T</h1>{body}</div></body>").startswith("T\nwords of paragraph 0")


def test_references_end_with_their_text_and_quotes_with_their_tag():
    assert html.main_text("<p>&not<b>in;</b> &am<i>p;</i></p>") == "\u00acin; &amp;"
    assert html.main_text('<p class="x>bad') == "bad"
    assert html.main_text("<p>one</p><p title='a>b' class=\"x>two</p><p>three</p>") == "one\ntwo\nthree"
    assert html.main_text("<p>a <![CDATA[&amp;]]> b") == "a b"  # a comment, as HTML reads it


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", AROUND % INNER, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", "<p>x" + " long" * 50000, "t"), (1, "u", AROUND % INNER, "t")], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "u", 250001), (1, "u", len("\n".join(ARTICLE))), (1, "u", len("\n".join(ARTICLE))), (2, "", 0), (3, "u", 0)]
    assert html.extract(pages.limit(0)).count() == 0


LONG = "The old mill stood by the river for three hundred years, and every spring the water rose to its second step without harm. "


def test_names_that_only_look_like_marks_and_marks_in_compounds():
    kept = "<div class='ad-hoc-group'><p>A group met once.</p></div><div class='lunch-menu-text'><p>Soup and bread were served.</p></div><p>Energy is <math><mi>E</mi></math> here.</p>"
    gone = "<div class='comment-body'><p>Nice read!</p></div><div class='legal-notice'><p>All rights reserved.</p></div><div class='share-bar'>Share this</div><![CDATA[hidden words]]>"
    page = f"<html><body><div id='story'><h1>The mill</h1><p>{LONG * 4}</p>{kept}<p>{LONG * 4}</p>{gone}</div><div class='responses'><p>I was there too.</p></div></body></html>"
    text = main_text(page)
    assert all(x in text for x in ("A group met once.", "Soup and bread were served.", "Energy is E here.", "The mill"))
    assert not any(x in text for x in ("Nice read!", "All rights", "Share this", "hidden words", "I was there"))


def test_sources_under_a_heading_and_paragraphs_of_links_stay():
    links = "".join(f"<li><a href='/{k}'>Source number {k}</a></li>" for k in range(5))
    menu = "".join(f"<li><a href='/m{k}'>Go {k}</a></li>" for k in range(6))
    page = f"<html><body><article><h1>T</h1><p>{LONG * 5}</p><ul>{menu}</ul><p>{LONG * 5}</p><p><a>Alpha</a>, <a>Beta</a>, <a>Gamma</a></p><h2>Sources</h2><ul>{links}</ul></article></body></html>"
    lines = main_text(page).split("\n")
    assert "Alpha, Beta, Gamma" in lines and lines[-6:] == ["Sources", *(f"Source number {k}" for k in range(5))] and "Go 1" not in lines


def test_deep_and_very_long_pages():
    deep = "<div>" * 3000 + f"<p>{LONG * 3}</p>" + "</div>" * 3000
    assert main_text(f"<body>{deep}</body>") == (LONG * 3).strip()
    long_ = "".join(f"<p>{LONG}{k}.</p>" for k in range(4000))
    assert len(main_text(f"<body><article>{long_}</article></body>").split("\n")) == 4000
