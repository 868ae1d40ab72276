import os
import time
from html.parser import HTMLParser

import pytest

from packloom.llm import html_text as H
from packloom.llm import queries
from packloom.llm.html_text import main_text, second_pass, with_main_text

TABLES = "/root/testdata/sf0.01"

BODY = "The first part of the article is long enough and has many of the words that all texts in this language have. " * 2
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- x --><div class='ad'>Buy it now and save on the best of all.</div>"
    "{main}<div id='comments'><p>" + BODY + "</p></div><aside><p>" + BODY + "</p></aside>"
    "<form>Name <input name=a><button>Go</button></form><footer>&copy; 2020 &middot; all of it</footer></body></html>"
)


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_page(shell):
    inner = f"<h1>Title &amp; more</h1><p>{BODY}</p><p>Short.</p><p><b>{BODY}<br>x\n  y &lt;z&gt;</b>"
    got = main_text(PAGE.replace("{main}", shell.format(inner)))
    assert got == f"Title & more {BODY.strip()} Short. {BODY.strip()} x y <z>"


@pytest.mark.parametrize(
    "shell",
    [
        "<div class='content-sidebar-wrap'><main>{}</main></div>",
        "<div class='sidebar'><main>{}</main></div>",
        "<div class='page has-sidebar'>{}</div>",
        "<div id='no-sidebar'><div class='post'>{}</div></div>",
        "<div class='content-sidebar'>{}</div>",
        "<div class='notice'><div class='widget related'><article>{}</article></div></div>",
        "<article class='post comments-open'>{}</article>",
        "<article aria-label='Share prices fall'>{}</article>",
        "<div aria-label='Share prices fall'>{}</div>",
        "<main><div class='widget'><article class='related notice'>{}</article></div></main>",
        "<div role='main' class='share'>{}</div>",
    ],
)
def test_marks_do_not_take_the_main_text(shell):
    inner = f"<h1>Title</h1><p>{BODY}</p><p>Short.</p>"
    assert main_text(PAGE.replace("{main}", shell.format(inner))) == f"Title {BODY.strip()} Short."


@pytest.mark.parametrize(
    "other",
    [
        "<div class='share-buttons'>Share it</div>",
        "<div id='sidebar' class='wide'><p>" + BODY + "</p></div>",
        "<div class='site-footer'>" + BODY + "</div>",
        "<section id='comments'><ol class='comment-list'><li><article class='comment-body'>" + BODY + "</article></li></ol></section>",
        "<div class='related'><article>" + BODY + "</article></div>",
        "<div class='related-posts'><p>One title</p><p>Another title</p></div>",
        "<section class='reader-comments'><p>" + BODY + "</p></section>",
        "<ul class='comment-list'><li>" + BODY + "</li></ul>",
        "<div class='article-replies'><p>" + BODY + "</p></div>",
        "<div style='color:red; Display : none'><p>" + BODY + "</p></div>",
    ],
)
def test_marks_still_take_boilerplate(other):
    for page in ("<article><p>{0}</p></article>{1}", "{1}<main><p>{0}</p></main>", "<main><article><p>{0}</p></article>{1}</main>"):
        assert main_text(page.format(BODY, other)) == BODY.strip()


def test_open_inline_elements_and_links():
    got = main_text(f"<article><p><b>Bold start<br><p>Next</p><p>a<i>b</i>c</p><ul><li><a href=x>Related one</a></li></ul></article><p>{BODY}</p>")
    assert got == f"Bold start Next abc {BODY.strip()}"


def test_short_blocks_follow_the_nearest_decided_one():
    assert second_pass(["bad", "short", "short", "good", "short"]) == [False, False, True, True, True]
    assert second_pass(["bad", "short", "good"]) == [False, True, True]
    assert second_pass(["short", "short"]) == [False, False]
    assert second_pass([]) == []


@pytest.mark.parametrize("html", [None, "", "<", "<p", "&amp", "<script>never closed", "</p></div>", "<!-- open", "<a <b>"])
def test_broken_pages_do_not_crash(html):
    assert isinstance(main_text(html), str)


def test_deep_and_long_pages():
    assert main_text("<div class='widget related-x'>" * 3000 + f"<article>{BODY}</article>" * 300).count(BODY.strip()) == 300
    assert main_text("<div>" * 5000 + f"<p>{BODY}</p>") == BODY.strip()
    assert len(main_text(f"<article>{'<p>' + BODY + '</p>'}</article>" * 300)) > 300 * 200


@pytest.mark.parametrize("inside", ["<section class='reader-comments'><p>{}</p></section>", "<ul class='comment-list'><li>{}</li></ul>"])
def test_comments_inside_the_article(inside):
    assert main_text(f"<article><p>{BODY}</p>{inside.format(BODY)}</article>") == BODY.strip()


@pytest.mark.parametrize(
    "mark", ["<![foo[bar]]>", "<![CDATA[x]]>", "<!doctype x>", "<!>", "<!-->", "<!--->", "<!-- a --!>", "<?php x ?>", "</ x>", "<![if !IE]>", "<!ELEMENT a>"]
)
def test_declarations(mark):
    assert main_text(f"<article><p>a{mark}b</p></article>") == "ab"


def test_copyright_in_a_text():
    assert main_text(f"<p>{BODY}© 2020 {BODY}</p>") == f"{BODY}© 2020 {BODY}".strip()
    assert main_text(f"<p>{BODY}</p><p>© 2020 by all of us</p>") == BODY.strip()


def test_languages_without_known_words():
    russian, chinese = "Это первая часть статьи, она довольно длинная. " * 5, "这是文章的第一部分内容足够长。" * 12
    for body in (russian, chinese):
        assert main_text(f"<nav><a href=x>{body}</a></nav><div><p>{body}</p><p>a <a href=y>{body}</a></p></div>") == body.strip()
    assert main_text("<nav>Home</nav><p>One line.</p><p>Two.</p>") == "One line. Two."


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<a x='" * 170_000 + ">", "<b>" + "<div>" * 100_000 + "</b>" * 100_000, "<!--" * 250_000, "<script></script" * 60_000,
        "</" * 500_000, "<" * 1_000_000, "<p " + "a=b " * 250_000 + ">", "<![CDATA[" * 110_000, "<div class='widget x'>" * 45_000,
    ],
)
def test_long_malformed_pages(page):
    started = time.monotonic()
    main_text(page)
    assert time.monotonic() - started < 4


class Tree(HTMLParser):
    """A page by another tokenizer, with every text's ancestors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.runs, self.block, self.with_article = [], [], 0, set()

    def handle_starttag(self, tag, attrs):
        names = [n for k, v in attrs if k in ("class", "id", "role") for n in (v or "").lower().split()]
        if tag in H.ARTICLE or "main" in names:
            self.with_article |= {id(e) for e in self.open}
        element = (tag, names, any(k == "hidden" for k, _ in attrs))
        if tag in H.BLOCKS or set(names) & H.MARKS or element[2] or tag in H.HIDDEN:
            self.block += 1
        if tag not in H.VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        at = max((n for n, e in enumerate(self.open) if e[0] == tag), default=None)
        if at is not None and (tag in H.BLOCKS or not any(e[0] in H.BLOCKS - {"p"} for e in self.open[at:])):
            if any(e[0] in H.BLOCKS | H.HIDDEN or set(e[1]) & H.MARKS or e[2] for e in self.open[at:]):
                self.block += 1
            del self.open[at:]

    def handle_data(self, data):
        self.runs.append((self.block, data, list(self.open)))

    def text(self):
        blocks = {}
        for block, data, around in self.runs:
            if any(tag in H.HIDDEN or hidden for tag, _, hidden in around):
                continue
            of = blocks.setdefault(block, {"text": "", "linked": 0, "bad": False, "article": False})
            of["text"] += data
            of["linked"] += len(data.strip()) if any(tag == "a" for tag, *_ in around) else 0
            inside = False
            for e in around:
                inside |= e[0] in H.ARTICLE or "main" in e[1]
                of["bad"] |= e[0] in H.BOILERPLATE or (e[0] == "header" and not inside)
                of["bad"] |= bool(set(e[1]) & H.MARKS) and id(e) not in self.with_article and e[0] not in H.ARTICLE
            of["article"] |= inside
        told = []
        for of in blocks.values():
            text = " ".join(of["text"].split())
            if not text:
                continue
            stops = sum(w.strip(".,;:!?\"'()&%$#*").lower() in H.STOP_WORDS for w in text.split()) / len(text.split())
            if of["bad"] or of["linked"] > 0.5 * len(text):
                told.append((text, False))
            elif of["article"]:
                told.append((text, True))
            elif "©" in text and len(text) < 140:
                told.append((text, False))
            elif len(text) >= 40 and (stops >= 0.3 or (stops >= 0.12 and len(text) >= 140)):
                told.append((text, True))
            else:
                told.append((text, None if len(text) < 40 or stops >= 0.12 else False))
        out = []
        for n, (text, good) in enumerate(told):
            if good is None:
                known = [(abs(m - n), not label) for m, (_, label) in enumerate(told) if label is not None]
                good = bool(known) and not min(known)[1]
            if good:
                out.append(text)
        return " ".join(out)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_query_against_a_tree(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    rows = queries.op7_html_text(spark, TABLES).collect()
    assert len(rows) == len(html)
    for r in rows:
        tree = Tree()
        tree.feed(html[r.page_id])
        tree.close()
        assert r.text == tree.text() and r.n_chars == len(r.text)


def test_frame(spark):
    rows = [(1, "u", PAGE.replace("{main}", f"<article>{BODY}</article>"), 5), (2, None, None, None), (2, None, "", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in with_main_text(pages).collect()), key=str)
    assert got == [(1, BODY.strip(), len(BODY.strip())), (2, "", 0), (2, "", 0)]
    assert with_main_text(pages.limit(0)).count() == 0
