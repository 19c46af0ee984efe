"""Main text: articles among boilerplate, references, white space, broken and hostile markup."""

import random
import time

import pytest

from tixpark.llm.htmltext import extracted, main_text

P = "The first paragraph of it, with commas, and quite some words to read, so it scores."
Q = "Another paragraph follows, shorter, yes, but a paragraph."
SIDE = "<li><a href=/a>Link one</a><li><a href=/b>Link two, three</a>"


def page(body, head="<title>T</title><style>p{}</style><script>var a='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("body, text", [
    (f"<nav><ul>{SIDE}</ul></nav><article><h1>Head</h1><p>{P}</p><p>{Q}</p></article><footer>&copy; me</footer>", f"Head {P} {Q}"),
    (f"<header>Site, name, of it</header><div id=main-content><p>{P}<p>{Q}</div><div class=sidebar><p>{P}</p></div>", f"{P} {Q}"),
    (f"<div class='ad'>{P}</div><main><p>{P}</p><div class=\"share-buttons\">tweet, like</div><p>{Q}</p></main>", f"{P} {Q}"),
    (f"<article><p>{P}</p><section id=comments><p>{P}{P}</p></section></article>", P),
    (f"<article><p>{P}</p><form><p>{Q}</p><input type=text value=x></form></article>", P),
    (f"<article><p><b>{P}<br><p>{Q}</p></article>", f"{P} {Q}"),
    (f"<article><p>a&amp;b &lt;c&gt; &eacute; &#233; &#x1F600; d&nbsp;&nbsp;e</p><p>{P}</p></article>", f"a&b <c> é é \U0001F600 d e {P}"),
    (f"<article><p>in<b>li</b>ne <a href=x>li\n\tnk</a>s</p>\n\n<p>{P}</p></article>", f"inline li nks {P}"),
    (f"<article><p>{P}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", f"{P} one two x y"),
    (f"<article><!-- <p>hidden</p> --><p>{P}</p><div style='display: none'>{Q}</div><p hidden>{Q}</p><noscript>{Q}</noscript></article>", P),
    (f"<div><div><div class=entry><p>{P}</p><p>{Q}</p></div></div><div role=navigation>{SIDE}</div></div>", f"{P} {Q}"),
    (f"<div class='cookie-notice'><p>{P}</p></div><div class=post><p>{P}</p></div><aside><p>{P}</p></aside>", P),
    (f"<article><p>{P}</p><pre>a  b\nc</pre><blockquote>said, so</blockquote></article>", f"{P} a b c said, so"),
    (f"<article><p>1 < 2 and 3 > 2, {P}</article>", f"1 < 2 and 3 > 2, {P}"),
])
def test_articles(body, text):
    assert main_text(page(body)) == text


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("   ", ""), ("plain  text &amp; more", "plain text & more"), ("<p>", ""), ("</div></p>x", "x"),
                                        ("<script>only()", ""), ("<!-- open", ""), ("<nav>menu</nav>", ""), ("<p>a<p>b", "a b")])
def test_edges(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("names", ["post no-sidebar", "content has-sidebar", "entry comments-open", "article-body notice-free", "share-enabled post", "story shop",
                                   "hentry tags-news", "shop", "post sidebar", "siteLayoutSidebar", "related-topics"])
def test_names_on_the_article_do_not_lose_it(names):
    side = f"<div class='sidebar widget'><p>{Q}</p></div><div class='related'><p>{Q}</p></div>"
    assert main_text(page(f"<nav>{SIDE}</nav><div class='{names}'><p>{P}</p><p>{P}</p><p>{P}</p></div>{side}")) == f"{P} {P} {P}"


@pytest.mark.parametrize("names", ["sidebar", "siteHeader", "cookie-notice", "post-comments", "content-sidebar", "ad", "share-buttons", "related", "nav-tabs", "login",
                                   "comment-content", "entry-footer", "newsletter signup"])
@pytest.mark.parametrize("where", ["in", "after"])
def test_names_of_boilerplate_leave_it_out(names, where):
    other = f"<div class='{names}'><p>{Q}</p></div>"
    inside, after = (other, "") if where == "in" else ("", other)
    assert main_text(page(f"<article><p>{P}</p>{inside}<p>{P}</p></article>{after}")) == f"{P} {P}"


@pytest.mark.parametrize("body, text", [
    (f"<article><div class='article-header'><h1>Head</h1></div><p>{P}</p><p class=notice>Note, this.</p><p class=ad>Buy.</p></article>", f"Head {P} Note, this."),
    (f"<article><header><h1>Head</h1> by <a href=/me>me</a></header><p>{P}</p></article>", f"Head {P}"),
    (f"<article><p data-x=it's>{P}</p><p>it's {Q}</p></article>", f"{P} it's {Q}"),
    (f"<article><p>foo<img src=x>bar a<wbr>b c<script>d</script>e x<br>y</p><p>{P}</p></article>", f"foobar ab ce x y {P}"),
    (f"<article><p title='never closed>{P}</p><p>{Q}</article>", f"{P} {Q}"),
    (f"<article><p title='a > b' class=\"x\">{P}</p></article>", P),
    (f"<form><article><p>{P}</p><p>{Q}</p><p>{P}</p></article><input name=q><select><option>one</select></form>", f"{P} {Q} {P}"),
    (f"<div class='sidebar-right'><article><p>{P}</p></article></div>", P),
    (f"<article><p>{P}</p><p style='visibility: hidden'>{Q}</p></article>", P),
    (f"<article><p>{P}</p><p>&#{'9' * 5000}; &#0000000000065; &#x0041;</p></article>", f"{P} \ufffd A A"),
    (f"<div class='ad'><p>{P}</p></div>", ""),
    (f"<form><p>{P}</p></form>", ""),
])
def test_names_headers_quotes_and_forms(body, text):
    assert main_text(page(body)) == text


@pytest.mark.parametrize("seed", range(30))
def test_generated_pages(seed):
    """Articles of known text among boilerplate of known kinds, in any order and nesting."""
    r = random.Random(seed)

    def sentence(low, high):
        return " ".join("".join(r.choices("abcdeéßñ", k=r.randint(2, 8))) + r.choice(["", "", ","]) for _ in range(r.randint(low, high))) + "."

    blocks = [(r.choice(["p", "p", "p", "h2", "blockquote", "pre"]), sentence(12, 60)) for _ in range(r.randint(3, 9))]
    marked = [f"<{t}>{'<b>' * (r.random() < .3)}{x.replace(' ', r.choice([' ', chr(10) + '  ', ' <i></i>', '&#32;']))}</{t}>" for t, x in blocks]
    noise = [f"<nav>{SIDE}</nav>", f"<div class=ad>{sentence(5, 12)}</div>", f"<aside><p>{sentence(5, 30)}</p></aside>", f"<footer>{sentence(3, 9)}</footer>",
             f"<section id=comments><article class=comment><p>{sentence(20, 90)}</p></article></section>", "<script>if (a < b) { x = '<p>no, no</p>'; }</script>",
             f"<!-- <p>{sentence(20, 40)}</p> -->", f"<form><label>{sentence(2, 5)}</label><input></form>", f"<div role=alert>{sentence(4, 20)}</div>"]
    for _ in range(r.randint(0, 3)):
        marked.insert(r.randint(0, len(marked)), r.choice(noise))
    holder = r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class='post no-sidebar'>{}</div>", "<div id=content class=has-ads>{}</div>"])
    around = [r.choice(noise) for _ in range(r.randint(1, 6))]
    cut = r.randint(0, len(around))
    body = "".join(around[:cut]) + holder.format("".join(marked)) + "".join(around[cut:])
    assert main_text(page(f"<div>{body}</div>" if r.random() < .5 else body)) == " ".join(x for _, x in blocks)


@pytest.mark.parametrize("unit", ["<a ", "<a href='", "</p>", "<b>x</i>", "<div>some words that are, say, long enough", "</script ", "<!--", "<div><td></td>",
                                  "<p><i></b>", "<article><header><h1>x", "<form><div class=shop>abc", "<a b='\"", "&#0", "<ul><li><div>"])
def test_time_grows_with_the_page(unit):
    start = time.process_time()
    main_text("<div>" * 10_000 + "<i>" * 10_000 + unit * 30_000)
    assert time.process_time() - start < 20


def test_long_and_deep_pages():
    words = " ".join(f"word{i}," for i in range(60_000))
    assert main_text(page(f"<article><p>{words}</p></article>")) == words
    assert main_text("<div>" * 30_000 + P) == P
    assert main_text("<article>" + "<b>" * 20_000 + P) == P


def test_frame(spark):
    html = page(f"<article><p>{P} 😀</p></article>")
    frame = spark.createDataFrame([(1, "u", html, 9), (1, "u", html, 9), (None, None, None, 9)], "page_id long, url string, html string, text int")
    got = extracted(frame).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == [("1", "u", P + " 😀", len(P) + 2)] * 2 + [("None", "None", "", 0)]
    assert extracted(frame.limit(0)).count() == 0
