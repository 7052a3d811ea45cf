"""Classes that mention chrome without being it, and pages of uneven paragraphs."""

import html
import re
import time

import hypothesis
import hypothesis.strategies as st
import pytest

from gridproof.llm.html_text import extract, extract_main_text

TEXT = "One whole paragraph of the article, long enough to be content of its own."


@pytest.mark.parametrize("name", ["home has-sidebar", "single right-sidebar", "col-md-8 no-sidebar", "main-content with-sidebar", "fixed-header", "post comments-open", "post type-post category-social-issues", "sidebar"])
def test_holders_keep_their_article(name):
    for page in (f"<body class='{name}'><article><p>{TEXT}</p></article></body>", f"<body><article class='{name}'><p>{TEXT}</p></article></body>", f"<body><div class='{name}'><main><p>{TEXT}</p></main></div></body>"):
        assert extract(page) == TEXT
    if name != "sidebar":
        assert extract(f"<body><div class='{name}'><p>{TEXT}</p></div></body>") == TEXT


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "site-header", "x comments", "related-posts", "nav_menu", "widget-2"])
def test_chrome_goes(name):
    assert extract(f"<body><article><p>{TEXT}</p></article><div class='{name}'><article>Other words.</article></div></body>") == TEXT
    assert extract(f"<body><article><p>{TEXT}</p><div class='{name}'>Other words.</div></article></body>") == TEXT


@pytest.mark.parametrize("sizes", [[140, 150, 160, 170, 3000, 180, 190, 200, 210, 220, 155, 165], [30, 900, 60, 300, 45, 700, 90, 500, 35, 120, 800, 250, 40, 400]])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_uneven_paragraphs_stay_and_link_lines_go(sizes, tag):
    parts = [("word " * n)[:n].strip() for n in sizes]
    body = "".join(f"<p>{p}</p>" for p in parts)
    links = "".join(f"<li><a href=x>Link number {i}</a></li>" for i in range(8))
    assert extract(f"<body><{tag}>{body}</{tag}></body>") == "\n\n".join(parts)
    assert extract(f"<body><{tag}><ul>{links}</ul>{body}<ul>{links}</ul></{tag}></body>") == "\n\n".join(parts)


def test_short_lines_at_the_head_of_an_article_stay():
    assert extract(f"<article><h1>A.</h1><p>B.</p><p><b>C</b> d.</p><p>{TEXT * 9}</p></article>") == f"A.\n\nB.\n\nC d.\n\n{TEXT * 9}"


PARAGRAPHS = [f"{TEXT} It goes on as number {i}." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(7)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body>{BODY}",
        f"<title>T</title><link rel=x href=y>{BODY}",
        f"<html><head><title>T</title>{BODY}",
        f"<html><head><script>var a;</script><div>{BODY}</div>",
        f"<body class='page right-sidebar'>{BODY}</body>",
        f"<main><div class='content side'>{BODY}</div></main>",
        f"<main><div class='side'>{BODY}</div></main>",
        f"<body><form id=aspnetForm><input type=hidden>{BODY}<button>Send</button></form></body>",
        f"<body><form><nav>{MENU}</nav>{BODY}<aside>Aside.</aside></form></body>",
        f"<body><form>{MENU}<article>{BODY}</article></form></body>",
        f"<body><nav>{MENU}{BODY}</body>",
        f"<body><nav>{MENU}<article>{BODY}</article></body>",
        f"<body><![foo[bar]]>{BODY}</body>",
        f"<body>{BODY}<![",
        f"<body>{BODY}<![CDATA[x]]>",
        f"<body>{BODY}<!x <!--",
        "<body><article>" + "".join(f"<p><a href=/x>{p}</a></p>" for p in PARAGRAPHS) + "</article></body>",
        f"<body><article>{MENU}" + "".join(f"<p>{p[:40]}<a href=/x>{p[40:]}</a></p>" for p in PARAGRAPHS) + f"{MENU}</article></body>",
        f"<body><form><p>Your name</p><input></form>{BODY}<div class=comments>{BODY * 9}</div></body>",
        f"<body><article>{BODY}</article><form>{BODY * 9}</form></body>",
    ],
)
def test_ordinary_pages_give_their_paragraphs(page):
    assert extract(page) == "\n\n".join(PARAGRAPHS)


@hypothesis.given(st.lists(st.sampled_from(["<", "</", "<!", "<![", "<!--", "-->", "]]>", ">", "<p>", "</p>", "<a href='", "&#", "&amp", "<body>", "<form>", "</nav>", "<head>", "<script>", "</script>", "<?", "x y", "\"", "=", "\0", "CDATA["]), max_size=30))
@hypothesis.settings(max_examples=800, deadline=None)
def test_malformed_markup_never_raises(parts):
    assert isinstance(extract("".join(parts)), str)


def test_pages_against_exact_text(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = re.sub(r"(?s)<!--.*?-->", "", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")])
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|div|ul|li|br)\b[^>]*>", inside)]
        assert extract(r.html) == "\n\n".join(b for b in blocks if b), r.page_id


@pytest.mark.parametrize("tag", ["li", "td", "tr", "dt", "dd", "option", "div", "b", "span", "p", "section", "head", "b><p", "form", "ul><li", "table><tr><td", "dl><dt"])
def test_open_tags_take_linear_time(tag):
    page = f"<body><article><p>{TEXT}</p>" + f"<{tag}>" * 100_000 + "</article></body>"
    began = time.perf_counter()
    assert extract(page).startswith(TEXT) or tag == "form"
    assert time.perf_counter() - began < 8  # 2 on an idle machine; quadratic time takes minutes


@pytest.mark.parametrize("n", [1, 3, 5, 12, 200])
@pytest.mark.parametrize("holder", ["form", "div class=sidebar"])
def test_nested_holders_are_read_to_the_end(n, holder):
    assert extract("<body>" + f"<{holder}>" * n + BODY + f"</{holder.split()[0]}>" * n + "</body>") == "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "post-comments", "blog-comments", "comment_item", "commentlist", "CommentSection", "disqus_thread", "adsbygoogle", "comments-area", "comment-list", "userComments", "comments_wrapper"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_reader_comments_and_adverts_go(name, kind):
    remark = f"<div {kind}='{name}'><p>{TEXT} I disagree with every word of it.</p></div>"
    assert extract(f"<body><article>{BODY}</article>{remark}</body>") == "\n\n".join(PARAGRAPHS)
    assert extract(f"<body><article>{BODY}{remark}</article></body>") == "\n\n".join(PARAGRAPHS)
    assert extract(f"<body><div>{BODY}</div>{remark}</body>") == "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize("name", ["no-comments", "has-comments", "comments-open", "comments-closed", "commentary-track-lead", "post-body", "entry-author", "user-story", "postItem"])
def test_names_that_only_mention_comments_stay(name):
    assert extract(f"<body><div class='{name}'>{BODY}</div></body>") == "\n\n".join(PARAGRAPHS)


def test_linked_text_of_an_article_stays():
    links = [f"Read the report of the year {i} here." for i in range(4)]
    items = "<ul>" + "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(links)) + "</ul>"
    assert extract(f"<article><p>{TEXT}</p><p><a href=/x>{TEXT}</a></p>{items}<p>{TEXT}</p></article>") == "\n\n".join([TEXT, TEXT, *links, TEXT])
    assert extract(f"<article><p><a href=/x>{TEXT}</a></p></article>") == TEXT
    assert extract(f"<article>{items}</article>") == "\n\n".join(links)


def test_optional_end_tags():
    assert extract("<article><p>" + TEXT + "<table><tr><td>a cell<td>another<tr><td>third</table><dl><dt>term<dd>what it means<dt>next</dl><ul><li>one<ul><li>inner</ul><li>two</ul></article>").split("\n\n") == [TEXT, "a cell", "another", "third", "term", "what it means", "next", "one", "inner", "two"]


def test_pages_through_the_query(spark):
    pages = [
        (1, f"<body><article>{BODY}</article><div class=reader-comments><p>{TEXT}</p></div></body>", "\n\n".join(PARAGRAPHS)), (2, "<body>" + "<form>" * 5 + BODY + "</body>", "\n\n".join(PARAGRAPHS)),
        (3, f"<article><p>{TEXT}</p><p><a href=/x>{TEXT}</a></p></article>", f"{TEXT}\n\n{TEXT}"), (4, None, ""), (5, "", ""), (6, "<li>" * 20_000, ""), (7, f"<p>&eacute;&amp;&#x41; {TEXT}", f"é&A {TEXT}"), (None, f"<p>{TEXT}", TEXT),
    ]
    docs = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h, _ in pages], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(docs).collect()), key=repr) == sorted(((i, f"u{i}", t, len(t)) for i, _, t in pages), key=repr)
