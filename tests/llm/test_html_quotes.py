"""Pages with odd quotes in tags, and the text of drawings and formulas."""

import pytest

from scoregate.llm import html_text


@pytest.mark.parametrize("page,text", [
    ('<a href="x"">link</a> rest of page', "link rest of page"), ("<p title=don't>one</p><p>two", "one\n\ntwo"), ('<a href="x>link</a> rest', "link rest"),
    ('<a "b">c</a> d', "c d"), ("<a href=\"x>y\" title='>'>z</a>", "z"), ("<p hidden='>x>no</p>yes", "yes"), ('<p style="display:none">no</p>yes', "yes"),
    ("a<svg><title>no</title><defs/><g>no<text x='1'>b</text><text>c</text></g><path d='M0'/></svg>d", "a b c d"), ("<svg><path d='M0'><p>shown", "shown"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> end", "x=1 end"),
])
def test_odd_quotes_and_foreign_text(page, text):
    assert html_text.page_text(page).strip() == text
