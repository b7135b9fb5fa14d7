"""Rendering of pages: by hand, against a plain renderer of random trees, against the words that the standard parser sees, and on broken markup."""

import random
import re
import time
from html import escape
from html.parser import HTMLParser

import pytest

from quarry.llm import html_text

CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br/>c", "a\nb\nc"), ("<div>a<div>b</div></div>c", "a\nb\nc"),
    ("<title>no</title><style>x{}</style><script>if (a < b) {}</script><body>yes", "yes"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"), ("<table><tr><td>a<td>long<tr><td>bbb<td>c</table>", "a    long\nbbb  c"), ("<p hidden>x</p><p style='display: none'>y</p>z", "z"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"), ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("a &amp; b &lt;c&gt; &eacute;", "a & b <c> é"), ("<details><summary>s</summary>rest</details>", "s"),
    ("<details open><summary>s</summary>rest</details>", "s\nrest"), ("<!-- no --><!doctype html>x<!-- open", "x"), ("a < b and c > d", "a < b and c > d"), ("<b>un</b><i>broken</i>", "unbroken"), ("<script>never closed", ""),
    ("<a title='x > y'>t</a>", "t"), ("<h1>T</h1>text<hr>more", "T\n\ntext\n---\nmore"), ("</p></div></td>x", "x"), ("<select><option>a<option>b</select>", "a\nb"), ("<blockquote>q</blockquote>", "  q"),
    # attributes
    ('<table><tr><td colspan="²">a<td>b</table>', "a  b"), (f'<table><tr><td colspan="{"9" * 5000}">a<td>b</table>', "a  b"), ('<ol start="--5"><li>a</ol>', "1. a"), ("<ol start='²'><li>a</ol>", "1. a"),
    ("<p don't>text it's</p>after", "text it's\n\nafter"), ("<p title=>x</p>", "x"), ("<p a=1 a=2 / hidden>x</p>y", "y"), ("<a title=\"never ended>x</a> y", ""), (f"&#{'9' * 5000};x", "�x"), (f"&#{'0' * 5000}65;", "A"),
    ("<div style='color:red; DISPLAY : none !important'>x</div>y", "y"), ("<div style='x-display:none'>x</div>", "x"), ("<ol type=i start=4><li>a<li value=9>b</ol>", "iv. a\nix. b"), ("<ol type=a start=27><li>a</ol>", "aa. a"),
    # tables
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td rowspan=0>a<br>z<td>b<tr><td>c</table>", "a  b\nz  c"), ("<table><caption>C</caption><tr><th colspan=2>h<tr><td>a<td>b</table>", "C\nh\na  b"),
    ("<table><tr><td>x<table><tr><td>a<td>b</table><td>y</table>", "x     y\na  b"), ("<table><tr><td>" * 40 + "deep", "deep"), ("<table>loose<tr><td>a</table>", "loose\n\na"),
    # what is drawn, fields, raw text
    ("<svg><title>t</title><defs><text>no</text></defs><path d=''/><text>drawn</text></svg>", "drawn"), ("<math><mi>x</mi><annotation>no</annotation></math>", "x"), ("<svg><defs/><text>yes</text></svg>", "yes"),
    ("<input value=v> <input type=password value=no><input type=hidden value=no><input placeholder=p>", "v p"), ("a<plaintext>b <b>c", "a\n\nb <b>c"), ("<xmp><b>&amp;</b></xmp>", "<b>&amp;</b>"), ("<textarea>\n<b>&lt;</textarea>", "<b><"),
    ("<optgroup label=L><option>o", "L\no"), ("<b>one<div>two</b>three</div>four", "one\ntwothree\nfour"), ("a</br>b", "a\nb"), ("<span hidden><div></span>no</div>no", ""), ("<h2>a</h3>b", "a\n\nb"), ("<pre>\nx</pre>", "x"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_render(html, text):
    assert html_text.render(html) == text


def laid_out(nodes):
    """A plain renderer of trees: (name, children) or a text. Marks first (0 or 1: a new line or a blank one is due), then lines."""
    out = []  # text, or a mark

    def walk(node, indent):
        if isinstance(node, str):
            out.append(("text", re.sub(r"\s+", " ", node), indent))
            return
        name, children = node
        if name in ("script", "hidden"):
            return
        if name == "br":
            out.append(("break", "", indent))
        elif name == "b":
            for c in children:
                walk(c, indent)
        elif name in ("ul", "ol"):
            nested = indent != "" and any(x in (" ",) for x in indent)
            out.append(("mark", 0 if nested else 1, ""))
            for i, (_, inside) in enumerate(children):
                sign = "- " if name == "ul" else f"{i + 1}. "
                out.append(("mark", 0, ""))
                out.append(("sign", sign, indent))
                for c in inside:
                    walk(c, indent + " " * len(sign))
                out.append(("mark", 0, ""))
                out.append(("nosign", "", ""))
            out.append(("mark", 0 if nested else 1, ""))
        elif name == "table":
            out.append(("mark", 1, ""))
            grid = [[laid_out(cell) or [""] for cell in row] for row in children]
            widths = [max(max(map(len, row[k])) if k < len(row) else 0 for row in grid) for k in range(max(map(len, grid)))]
            for row in grid:
                for i in range(max(map(len, row))):
                    line = "".join((cell[i] if i < len(cell) else "").ljust(w + 2 if w else 0) for cell, w in zip(row, widths)).rstrip()
                    if line:
                        out.append(("line", line, indent))
            out.append(("mark", 1, ""))
        else:
            mark = int(name in ("p", "h1"))
            out.append(("mark", mark, ""))
            for c in children:
                walk(c, indent)
            out.append(("mark", mark, ""))

    for node in nodes:
        walk(node, "")
    lines, line, where, due, sign = [], "", "", 0, None

    def flush(always=False):
        nonlocal line, due, sign
        text = line.rstrip(" ")
        if text or always:
            if due and lines and text:
                lines.append("")
            if text:
                due = 0
            start = where
            if sign is not None and text:
                start, sign = start[: len(start) - len(sign)] + sign, None
            lines.append((start + text).rstrip())
        line = ""

    for kind, value, indent in out:
        if kind == "text":
            where = indent
            line += value.lstrip(" ") if not line or line.endswith(" ") else value
        elif kind == "break":
            where = indent
            flush(always=True)
        elif kind == "mark":
            flush()
            due = max(due, value)
        elif kind == "sign":
            sign = value
        elif kind == "nosign":
            sign = None
        else:
            where, line = indent, value
            flush()
    flush()
    return lines


def some_tree(rng, depth=0, blocks=True):
    word = lambda: "".join(rng.choice("abcdeé<&") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "b", "br", "script"] + (["div", "p", "h1", "ul", "ol", "table", "hidden"] if blocks and depth < 4 else []))
        if kind == "text":
            out.append(" ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice(["", " ", "\n "]))
        elif kind in ("br", "script"):
            out.append((kind, []))
        elif kind in ("ul", "ol"):
            out.append((kind, [("li", [word(), *some_tree(rng, depth + 1)]) for _ in range(rng.randint(1, 3))]))
        elif kind == "table":
            out.append((kind, [[some_tree(rng, 3, blocks=False) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]))
        else:
            out.append((kind, some_tree(rng, depth + 1, blocks=kind in ("div", "hidden"))))
    return out


def written(rng, nodes):
    """The tree as markup; ends that may be left out sometimes are."""
    out = ""
    for i, node in enumerate(nodes):
        if isinstance(node, str):
            out += escape(node)
            continue
        name, children = node
        if name == "script":
            out += "<script>if (a < b) { '</p>' }</script>"
        elif name == "br":
            out += rng.choice(["<br>", "<BR/>", "<br clear=all>"])
        elif name == "hidden":
            out += rng.choice(["<div hidden>", "<div style='display:none'>"]) + written(rng, children) + "</div>"
        elif name in ("ul", "ol"):
            out += f"<{name}>" + "".join(f"<li>{written(rng, c)}{rng.choice(['', '</li>'])}" for _, c in children) + f"</{name}>"
        elif name == "table":
            out += "<table>" + "".join("<tr>" + "".join(f"<td>{written(rng, c)}{rng.choice(['', '</td>'])}" for c in row) + rng.choice(["", "</tr>"]) for row in children) + "</table>"
        else:
            follows = nodes[i + 1][0] if i + 1 < len(nodes) and not isinstance(nodes[i + 1], str) else None
            end = "" if name == "p" and follows in ("p", "div", "h1", "ul", "ol", "table") and rng.random() < 0.5 else f"</{name}>"
            out += f"<{name} class='x > y'>" + written(rng, children) + end
    return out


def test_random_trees():
    for seed in range(1500):
        rng = random.Random(seed)
        tree = some_tree(rng)
        assert html_text.render(written(rng, tree)) == "\n".join(laid_out(tree)).strip("\n"), (seed, tree)


def test_broken_markup_never_fails():
    rng = random.Random(5)
    parts = ["<", ">", "/", "=", '"', "'", "&", "#", ";", "-", "!", "²", "\x00", "\n", " ", "x", "<p", "</p>", "<td", "<table>", "<tr>", "<li value=", "<ol start=", "<svg>", "<math/", "</", "<!--", "-->", "<pre>", "<details>", "<summary>", "style=", "display:none", "colspan=", "rowspan=", "0", "99999999999", "&#x", "&#55555555555;", "&#xD800;", "<select>", "<option", "<caption>", "<input value=", "<br>", "<script>", "</script", "<title>", "<body hidden>", "<head>", "<plaintext>", "﻿", "ſ", "İ"]
    for _ in range(6000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        assert html_text.render(html).encode().decode() is not None


def test_deep_and_long_pages():
    assert html_text.render("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert html_text.render("<table><tr><td>" * 60 + "x") == "x"
    assert html_text.render("<p>word " * 20_000).count("word") == 20_000
    assert "x" in html_text.render("<" * 3000 + " x")
    began = time.perf_counter()
    for html in ("<div>" * 100_000 + "x", "x" + "</i>" * 100_000, "<div><p>" * 50_000 + "x", "<ol><li>" * 50_000 + "x", "<table><tr><td>" * 20_000 + "x", "<table><tr>" + "<td>" * 100_000 + "x", "<table>" + "<tr><td rowspan=9><td>x" * 20_000, "<a x='" * 50_000 + "'>x", "<b><div></b>" * 50_000 + "x"):
        assert html_text.render(html).strip()[-1:] == "x"
    assert time.perf_counter() - began < 60


def test_output_is_bounded():
    """Staircases of cells, also inside one another, cost no more than a constant times their page; small ones are aligned."""
    assert html_text.render("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    stairs = lambda n, inside="": "<table>" + "".join(f"<tr><td rowspan=0>cell {i}{inside}" for i in range(n)) + "</table>"
    began = time.perf_counter()
    for html in (stairs(500), stairs(4000), stairs(40_000), stairs(300, stairs(20)), "<table>" + "<tr><td rowspan=0>" + "x" * 500 + "<tr><td colspan=1000>y" * 3000):
        text = html_text.render(html)
        assert len(text) <= 12 * (len(html) + 1000) and text.count("cell") == html.count("cell")
    assert time.perf_counter() - began < 30


def test_lone_returns_and_ruby():
    assert html_text.render("<pre>a\rb\r\nc</pre>") == "a\nb\nc"
    assert html_text.render("<ruby>base<rp>(</rp><rt>top</rt><rp>)</rp></ruby>") == "basetop"


class Words(HTMLParser):
    """Visible words as the standard parser sees them, for pages whose hidden parts are scripts, styles and titles alone."""

    def __init__(self):
        super().__init__()
        self.hidden, self.found = None, []

    def handle_starttag(self, tag, attrs):
        self.hidden = tag if tag in ("script", "style", "title") else self.hidden
        self.found.append(" " if tag in ("p", "li", "br", "div", "h1", "nav", "ul", "article", "footer", "body") else "")

    def handle_endtag(self, tag):
        self.hidden = None if tag == self.hidden else self.hidden
        self.found.append(" " if tag in ("p", "li", "div", "h1", "nav", "ul", "article", "footer") else "")

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def plain_words(html):
    parser = Words()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.found).split()


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/pages.parquet").withColumnRenamed("url", "row")
    rows = html_text.visible_text(pages, ["page_id", "row", "html"]).collect()
    assert len(rows) == pages.count()
    for r in rows:
        words = [w for line in r.text.split("\n") for w in line.removeprefix("- ").split()]
        assert words == plain_words(r.row.html)


def test_awkward_pages(spark):
    odd = [(1, None, "t", "r"), (1, "<p>x", "t", "r"), (1, "<p>x", "t", "r"), (None, "", None, None), (2, "x" * 300_000, "t", "r")]
    pages = spark.createDataFrame(odd, "page_id long, html string, text string, row string")
    found = html_text.visible_text(pages, ["page_id", "text", "row", "html"]).collect()
    assert sorted((str(r.row.page_id), r.text) for r in found) == sorted((str(i), "x" if h == "<p>x" else h or "") for i, h, _, _ in odd)
    assert {r.row.text for r in found} == {"t", None} and html_text.visible_text(pages.limit(0), ["page_id"]).count() == 0
