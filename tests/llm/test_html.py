import re

import pytest

from loomfactor.llm import html
from loomfactor.llm.common import table

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("a<div>b</div>c", "a\nb\nc"),
    ("<h1>T</h1>x  y\n z", "T\n\nx y z"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
    ("<table><tr><th>Name<th>N<tr><td>x<td>10<tr><td>long one<td>2</table>", "Name     | N\nx        | 10\nlong one | 2"),
    ("<table><caption>C</caption><tbody><tr><td>a</td></tr></tbody></table>z", "C\na\n\nz"),
    ("<style>p{}</style><script>var t='</p>';</script>x<!-- no -->y", "xy"),
    ("<p hidden>no</p><p style='display: none'>no</p><p data-hidden-x=1>yes", "yes"),
    ("<table><tr><td><table><tr><td>a<td>bb<tr><td>ccc<td>d</table><td>e<tr><td>f<td>g</table>", "a   | bb | e\nccc | d  |\nf        | g"),
    ("<table><tr><td colspan=2>x<table><tr><td>y</table><td>z</table>", "x   | z\ny   |"),
    ("<p>a <span aria-hidden=true>seen</span>", "a seen"),
    ("<p>name <input value='Ann'> <input type=hidden value=no> <input type=submit value=Go> <input type=checkbox value=on>", "name Ann Go"),
    ("<style>.a .b{display:none} ul > li.c{display:none} #x p .d{visibility:hidden}</style><p class=b>1<div class=a><p>2<b class=b>no</b></div><ul><li class=c>no<li>3</ul><div id=x><p>4<i class=d>no</i></div><i class=d>5</i>", "1\n\n2\n\n- 3\n\n4\n\n5"),
    ("<style>div > .b{display:none}</style><div><p class=b>no</p><p><i class=b>1</i></div>", "1"),
    ("<details><summary>more</summary>no <p>no</details><details open><summary>all</summary>seen</details>", "more\nall\nseen"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("a<br>b&amp;c &lt;d&gt;", "a\nb&c <d>"),
    ("<b>bold<i>x</b>y</i>z", "boldxyz"),
    ("<head><title>t</title></head><body>b</body>", "b"),
    ("1 < 2 <", "1 < 2 <"),
    ("<a href='x>y'>link</a>", "link"),
    ("</div></p>ok<span", "ok<span"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\nb\nc\nd"),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert html.render(page) == text


def test_deep_and_long_pages():
    assert html.render("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.render("<p>" + "x " * 200000).count("x") == 200000


def test_whole_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        seen = got[r.page_id]
        assert "track(" not in seen and "margin:0" not in seen and "<p>" not in seen
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|head)\b.*?</\1>", "", r.html or "")
        first = re.search(r"<p>([A-Za-z]{4,})", body)
        assert not first or first[1] in seen
    odd = spark.createDataFrame([(None, "<p>a", "t"), (1, None, "t"), (1, None, "t")], "page_id long, html string, text string")
    assert sorted((repr(r.page_id), r.text) for r in html.extract(odd).collect()) == [("1", ""), ("1", ""), ("None", "a")]
    assert html.extract(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><p>all text", "all text"),
        ("<head><meta charset=x>bare text<p>more", "bare text\n\nmore"),
        ("<head><style>a{}</style> <script>x</script></head>b", "b"),
        ("<p style='overflow: hidden !important'>a</p><p title='a hidden gem'>b<p class='x hidden y' data-x='display:none'>c", "a\n\nb\n\nc"),
        ("<p style='display:none; display:block'>a<p style='display: none !important; display:block'>no", "a"),
        ("<p STYLE='color:red;VISIBILITY : Hidden'>no<p HIDDEN=''>no<p id=a hidden>no<p>yes", "yes"),
        ("a <math><mi>x</mi><annotation>no</annotation></math> <textarea>b &amp; <i></textarea> c", "a x b & <i> c"),
        ("<table><tbody>stray<tr><td>a</table>", "stray\na"),
    ],
)
def test_no_visible_text_is_lost(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>", "yes"),
        ("<style>.gone{display:none} #x, p.y { visibility : hidden } @media print { .z{display:none} }</style><p class='a gone'>no<p id=x>no<p class=y>no<p class=z>yes", "yes"),
        ("<style>.gone{display:none} .gone.back{display:block} b .far{display:none}</style><p class='gone back'>yes<p class=far>too", "yes\n\ntoo"),
        ("<p hidden style='display:block'>yes", "yes"),
        ("<select><option>one<option selected>two</select><svg><title>no</title><text>drawn</text></svg>", "twodrawn"),
        ("<table><tr><td colspan=2>wide cell<td>c<tr><td>a<td>b<td>d</table>", "wide cell | c\na | b     | d"),
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2<tr><td>y<td>3</table>", "x | 1\n  | 2\ny | 3"),
        ("<p title=it's>a</p><p title=\"x>b</p>", "a\n\nb"),
        ("<a b=\"" * 3, "<a b=\"" * 3),
    ],
)
def test_visibility_spans_and_broken_tags(page, text):
    assert html.render(page) == text


def test_layout_does_not_depend_on_depth():
    for depth in (3, 450, 5000):
        assert html.render("<div>" * depth + "<p>one</p><p>two</p>") == "one\n\ntwo"
        assert html.render("<i>" * depth + "<ul><li>a<li>b</ul>") == "- a\n- b"
        assert html.render("<table>" + "<tbody>" * depth + "<tr><td>a") == "a"
    assert html.render("<ul><li>x" * 300).split()[-1] == "x"


def test_many_open_quotes_are_read_in_linear_time():
    import time

    start = time.perf_counter()
    for page in ("<a b=\"" * 100_000, "<a b='" * 99_999 + ">", "<" * 200_000, "<a " * 200_000 + ">"):
        html.render(page)
    assert time.perf_counter() - start < 20


def _grow(rng, depth, words, shown=True):
    """A random tree as HTML with implied end tags left out, and its visible words in the order of the page."""
    out, seen = [], []
    for _ in range(int(rng.integers(1, 5))):
        kind = rng.choice(["text", "p", "div", "span", "ul", "ol", "none", "unseen", "back", "comment", "class"] if depth else ["text"])
        if kind == "text":
            said = f"w{next(words)}"
            out.append(f" {said} ")
            seen += [said] if shown else []
        elif kind == "p":
            said = f"w{next(words)}"
            out.append(f"<p data-hidden='hidden'> {said} " + rng.choice(["", "</p>"]))
            out.append("<div></div>")
            seen += [said] if shown else []
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>")
            for _ in range(int(rng.integers(1, 4))):
                inner, found = _grow(rng, depth - 1, words, shown)
                out.append(f"<li>{inner}" + rng.choice(["", "</li>"]))
                seen += found
            out.append(f"</{kind}>")
        elif kind == "comment":
            out.append(rng.choice(["<!-- <p>no -->", "<script>'<p>no'</script>", "<style>x{}</style>", "<!DOCTYPE no>"]))
        else:
            look = {"none": "style='display:none'", "unseen": "style='visibility: hidden'", "back": "style=visibility:visible", "class": "class='q secret'"}.get(kind, "")
            inner, found = _grow(rng, depth - 1, words, {"unseen": False, "back": True}.get(kind, shown))
            tag = "span" if kind == "span" else "div"
            out.append(f"<{tag} {look}>{inner}</{tag}>")
            seen += [] if kind in ("none", "class") else found
    return "".join(out), seen


@pytest.mark.parametrize("seed", range(40))
def test_visible_words_of_random_trees(seed):
    """Independent of the parser: the tree is known, so its visible words and their order are too."""
    import itertools

    import numpy as np

    page, seen = _grow(np.random.default_rng(seed), 4, itertools.count())
    got = re.findall(r"w\d+", html.render("<style>.secret{display:none}</style>" + page))
    assert got == seen


def test_pages_against_a_plain_reader(spark):
    """The visible words of every page, read with the standard library's parser and a stack of elements."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.words, self.stack = [], []

        def handle_starttag(self, tag, attrs):
            said = dict(attrs)
            style = (said.get("style") or "").replace(" ", "").lower()
            off = tag in html.UNSEEN or "hidden" in said or "display:none" in style or "visibility:hidden" in style
            if tag not in html.VOID:
                self.stack.append((tag, off))

        def handle_endtag(self, tag):
            at = max((i for i, (t, _) in enumerate(self.stack) if t == tag), default=None)
            if at is not None:
                del self.stack[at:]

        def handle_data(self, data):
            if not any(off for _, off in self.stack):
                self.words += re.findall(r"\w+", data)

    wrong = []
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        got = re.findall(r"\w+", re.sub(r"(?m)^ *(?:\d+\.|-) ", "", html.render(r.html)))
        if sorted(got) != sorted(reader.words):
            wrong.append((r.page_id, set(got) ^ set(reader.words)))
    assert not wrong, wrong[:3]
