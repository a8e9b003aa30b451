"""Tables: time and output grow with the page, whatever its spans and widths, and no text is lost."""

import itertools
import random
import time

import pytest

from scoregate.llm.html_text import ALIGNED, NESTED, page_text

PAGES = {
    "rows to the end": lambda n: "<table>" + "".join(f"<tr><td rowspan=0>x{i}" for i in range(n)),
    "differing rows": lambda n: "<table>" + "".join(f"<tr><td rowspan={2 + i * 7919 % n}>x{i}" for i in range(n)),
    "a long cell": lambda n: "<table><tr><td>" + "y" * 4 * n + "<td>z" + "".join(f"<tr><td>x{i}<td>b" for i in range(n)),
    "wide cells": lambda n: "<table>" + "".join(f"<tr><td colspan=1000>x{i}<td>b" for i in range(n)),
    "wide cells to the end": lambda n: "<table>" + "".join(f"<tr><td colspan=9 rowspan=0>x{i}" for i in range(n)),
    "nested": lambda n: "<table><tr><td>a long first cell<td>" * (n // 4) + "".join(f"<p>x{i}" for i in range(n)),
    "nested rows": lambda n: f"<table><tr><td>{'w' * 150}<tr><td>b<td>" * 12 + "<br>".join(f"x{i}" for i in range(n)),
}


@pytest.mark.parametrize("kind", PAGES)
def test_time_and_output_grow_with_the_page(kind):
    took, sizes = [], []
    for n in (2_000, 16_000):
        page = PAGES[kind](n)
        start = time.process_time()
        text = page_text(page)
        took.append(time.process_time() - start)
        sizes.append(len(text) / len(page))
        assert {f"x{i}" for i in range(n)} <= set(text.split())
    assert took[1] < 20 * took[0] + 1 and took[1] < 15
    assert sizes[1] < 2 * sizes[0] + 1 and sizes[1] < ALIGNED * NESTED


def sheet(rows):
    """Cells put on a sheet one place at a time: (row, column) of each, by the first free place of its row."""
    taken, out = {}, []
    for r, row in enumerate(rows):
        column = 0
        for text, across, down in row:
            while taken.get((r, column)):
                column += 1
            end = len(rows) if down == 0 else min(len(rows), r + down)
            out.append((text, r, end, column, column + across))
            for y, x in itertools.product(range(r, end), range(column, column + across)):
                taken[y, x] = True
            column += across
    return out


def drawn(rows):
    """The layout of a small table worked out place by place."""
    cells = sheet(rows)
    starts = sorted({c[3] for c in cells})
    if len(starts) < 2 and all(end - r == 1 for _, r, end, _, _ in cells):
        return [c[0] for c in cells]
    width = dict.fromkeys(starts, 0)
    under = lambda c: [s for s in starts if c[3] <= s < c[4]]
    for c in cells:
        if len(under(c)) == 1:
            width[c[3]] = max(width[c[3]], len(c[0]))
    for c in sorted(cells, key=lambda c: (len(under(c)), starts.index(c[3]), len(c[0]))):
        own = under(c)
        lacking = len(c[0]) - sum(width[s] for s in own) - 2 * (len(own) - 1)
        for k in range(len(own) if len(own) > 1 and lacking > 0 else 0):
            width[own[k]] += lacking // len(own) + (k < lacking % len(own))
    left = {s: sum(width[t] + 2 for t in starts if t < s) for s in starts}
    out = []
    for r in range(len(rows)):
        line = ""
        for c in sorted((c for c in cells if c[1] == r), key=lambda c: c[3]):
            line += " " * (left[c[3]] - len(line)) + c[0]
        if any(c[1] == r for c in cells):
            out.append(line)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_spans_by_brute_force(seed):
    """Rows and columns that cells span, cells that overlap left out, as their order in a line is then no question of places."""
    rng, seen = random.Random(seed), 0
    while seen < 400:
        rows = [
            [
                (
                    "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))),
                    rng.choice((1, 1, 1, 2, 3)),
                    rng.choice((1, 1, 1, 2, 3, 0))
                )
                for _ in range(rng.randrange(1, 5))
            ]
            for _ in range(rng.randrange(1, 6))
        ]
        places = [(y, x) for _, r, end, c, last in sheet(rows) for y in range(r, end) for x in range(c, last)]
        if len(places) != len(set(places)):
            continue
        seen += 1
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in rows) + "</table>"
        assert page_text(page).split("\n") == [x.rstrip() for x in drawn(rows)], page


def test_random_tables_lose_no_text():
    rng = random.Random(2)
    for _ in range(4000):
        words, page = iter(range(10_000)), ""
        n = 0
        for _ in range(rng.randrange(1, 14)):
            page += rng.choice(("<table>", "<tr>", "<tr>", "</table>", "<ul><li>", "</ul>", "<blockquote>", "<p>", "", ""))
            page += f"<td rowspan={rng.choice((0, 1, 1, 2, 5, 70000))} colspan={rng.choice((1, 1, 2, 9, 2000))}>x{next(words)} "
            n += 1
        assert sorted(w for w in page_text(page).split() if w[0] == "x") == sorted(f"x{i}" for i in range(n)), page


def test_tables_in_tables():
    assert page_text("<table><tr><td>a<td><table><tr><td>b<td>c</table>") == "a  b  c"
    deep = "<table><tr><td>" * (NESTED + 3) + "x<td>y<tr><td>z"
    assert page_text(deep).split() == ["x", "y", "z"]
