"""HTML extraction: numbers and references of any length, depth, spans and widths, and random markup."""

import random
import time

import pytest

from scoregate.llm.html_text import page_text

PARTS = [
    "<", ">", "</", "/>", '"', "'", "=", "&", ";", "&#", "&#x", "9" * 5000, "0", "-", "--3", " "
    "", "\n", "\x00", "é", "日本", "x", "a b", "<!--", "-->", "<!", "]]>",
    "<table>", "</table>", "<tr>", "<td>", "<td rowspan=3>", "<th colspan=4>", "<td colspan=0 rowspan=0>", "<td "
    "rowspan=99999999999>", "<ol start=--3>", "<li value=9e9>", "<li>", "</ol>", "<ul>",
    "<p>", "</p>", "<pre>", "<textarea>", "<script>", "</script>", "<svg>", "<text>", "<math>", "<foreignobject>", "<details>", "<summary>", "<dl>", "<dt>", "<dd>", "<select>", "<option>",
    "<template>", "<head>", "<body>", "<blockquote>", "<br>", "<hr>", "<img alt=x>", "<div hidden>", "<div "
    "style='display:none'>", "</div>", "<div>", "&amp;", "&copy", "&#65;", "&#xD800;", "&#1114112;",
]


@pytest.mark.parametrize("seed", range(4))
def test_random_markup_never_fails(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        page_text("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60))))
    for _ in range(1500):
        page_text("".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xD7FF), 60, 62, 34, 38))) for _ in range(rng.randrange(1, 200))))


@pytest.mark.parametrize("page,text", [
    ('<ol start="--3"><li>a', "1. a"), (
        '<ol><li value="--3">a<li>b', "1. a\n2. b"
    ), ("<ol start=-2><li>a<li>b", "-2. a\n-1. b"), (f"<ol start={'9' * 5000}><li>a", "1. a"),
    (f"<table><td colspan={'9' * 5000}>x", "x"), (f"&#{'9' * 5000};a", "�a"), (f"&#x{'f' * 5000};a", "�a"), ("&#0000000000065;&#x00000000041;", "AA"),
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", "A  b1\n   b2"), ("<table><tr><td rowspan=0>A<td>1<tr><td>2<tr><td>3</table>", "A  1\n   2\n   3"),
    (
        "<table><tr><th colspan=2>wide heading here<tr><td>a<td>b</table>", "wide heading here\na         b"
    ), ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
    ("<table><tr><td rowspan=2>a<br>b<br>c<td>1<tr><td>2<tr><td>x<td>y</table>", "a  1\nb  2\nc\nx  y"), ("<ul><li><ul><li>x</ul><li>z</ul>", "- - x\n- z"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
])
def test_odd_numbers_and_spans(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize("tag", ["div", "b", "ul><li", "p><div", "table><tr><td", "blockquote", "ol><li>x"])
def test_time_grows_with_the_page_and_not_with_its_depth(tag):
    took = []
    for depth in (5_000, 40_000):
        start = time.process_time()
        assert page_text(f"<{tag}>" * depth + "deep").endswith("deep")
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 1


def test_tables_by_brute_force():
    """Cells painted one by one on a sheet: each column as wide as its widest cell needs, each row one line."""
    rng = random.Random(8)
    for _ in range(150):
        rows = [
            [
                ("".join(rng.choice("abc日") for _ in range(rng.randrange(1, 6))), rng.choice((1, 1, 1, 2)))
                for _ in range(rng.randrange(1, 5))
            ]
            for _ in range(rng.randrange(1, 6))
        ]
        page = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={down}>{text}" for text, down in row) for row in rows) + "</table>"
        taken, cells = set(), []
        for r, row in enumerate(rows):
            column = 0
            for text, down in row:
                while (r, column) in taken:
                    column += 1
                taken |= {(k, column) for k in range(r, min(r + down, len(rows)))}
                cells.append((r, column, text))
                column += 1
        wide = lambda t: sum(2 if c == "日" else 1 for c in t)
        used = sorted({c for _, c, _ in cells})
        widths = {c: max(wide(t) for _, k, t in cells if k == c) for c in used}
        lines = []
        for r in range(len(rows)):
            line = ""
            for c in used:
                text = next((t for q, k, t in cells if (q, k) == (r, c)), "")
                line += text + " " * (widths[c] - wide(text) + 2)
            lines.append(line.rstrip())
        assert page_text(page) == "\n".join(lines).strip("\n"), page
