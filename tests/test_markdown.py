"""Blocks, inline encoding and exact round trips, on fixtures of our own wording."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.functions import markdown, markers

FIXTURES = {
    "plain": "# Title\n\nOne short paragraph.\n",
    "inline": "# Mix\n\nSome **bold with *italic* inside**, `code`, ***both***.\n\nA **[link in bold](https://a.example/x?y=1&z=2)** here.\n",
    "fences": "# Code\n\nBefore `List<int>`.\n\n```ts\nconst x: A<B> = `t ${y}`;\n\n# no heading\n```\n\nBetween.\n\n~~~\n<div>\n~~~\n\nAfter.\n",
    "links": "# Links\n\nSee [docs](https://a.example/?q=1 \"T\") now.\n\nMail <https://b.example>.\n\n![alt](img.png \"T\") and [`code`](u).\n",
    "table": "# T\n\n| A | B | C |\n| --- | :-: | --- |\n| 1 | `x|y` | **3** |\n| 4 | 5 | 6 |\n",
    "lists": "# L\n\n1. first\n   - inner `a`\n   - inner two\n2. second\n3. third\n",
    "quotes": "# Q\n\n> line one\n> line `two`\n",
    "html": "# H\n\n<div class=\"x\">\nraw\n</div>\n\nText <span>in</span> it.<br/>\nNext.\n",
    "crlf": "# W\r\n\r\nOne\r\ntwo  \r\nthree\\\r\nfour\r\n\r\n- a\r\n- b\r\n",
    "setext": "Title\n=====\n\nUnder\n-----\n\ntext\n\n---\n\nmore [ref][r] &amp; [r]\n\n[r]: http://x.example \"t\"\n",
    "odd": "*open\n\n**\n\n[not](\n\n``a ` b``\n\n\\*no\\* &copy; <not a tag\n\n* * *\n\n    code\n\n- [ ] task\n",
}
KINDS = {
    "plain": ["Heading", "Paragraph"],
    "inline": ["Heading", "Paragraph", "Paragraph"],
    "fences": ["Heading", "Paragraph", "Paragraph", "Paragraph"],
    "links": ["Heading", "Paragraph", "Paragraph", "Paragraph"],
    "table": ["Heading"] + ["TableCell"] * 9,
    "lists": ["Heading"] + ["ListItem"] * 5,
    "quotes": ["Heading", "BlockQuote"],
    "html": ["Heading", "Paragraph"],
    "crlf": ["Heading", "Paragraph", "ListItem", "ListItem"],
}


def back(text):
    found = markdown.parse(text)
    return markdown.rebuild(text, [(c.start, c.stop, markers.splice(c.text, c.placeholders, c.links, c.emphasis)) for c in found])


@pytest.mark.parametrize("name", KINDS)
def test_kinds(name):
    assert [c.kind for c in markdown.parse(FIXTURES[name])] == KINDS[name]


@pytest.mark.parametrize("name", [n for n in FIXTURES if n != "setext"])
def test_round_trip(name):
    assert back(FIXTURES[name]) == FIXTURES[name]


@pytest.mark.parametrize(
    ("text", "encoded"),
    [
        ("**bold *it* x**", "<strong0>bold <em1>it</em1> x</strong0>"),
        ("[`f()`](u)", "<link0>⟦CODE0⟧</link0>"),
        ("![alt](i.png)", "<link0>alt</link0>"),
        ("<https://a.example>", "⟦AUTOLINK0⟧"),
        ("a <b>c</b> d", "a ⟦HTML0⟧c⟦HTML1⟧ d"),
        ("plain text", "plain text"),
        ("use `x` now", "use ⟦CODE0⟧ now"),
        ("one\ntwo", "one⟦BR0⟧two"),
        ("&copy; x", "⟦HTML0⟧ x"),
        ("snake_case_word", "snake_case_word"),
    ],
)
def test_encoding(text, encoded):
    assert markdown.parse(text)[0].text == encoded


def test_nothing_leaks_from_code_and_html():
    for name in ("fences", "html"):
        joined = " ".join(c.text for c in markdown.parse(FIXTURES[name]))
        assert "const" not in joined and "raw" not in joined and "div" not in joined


def test_link_data_and_references():
    first, second = [c for c in markdown.parse(FIXTURES["links"]) if c.links][:2]
    assert first.links[0] == {"url": "https://a.example/?q=1", "title": "T", "is_image": False}
    assert second.links[0]["is_image"]
    (ref,) = [c for c in markdown.parse(FIXTURES["setext"]) if c.links]
    assert ref.text == "more <link0>ref</link0> ⟦HTML0⟧ <link1>r</link1>"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab *_`[]()<>!#|-\n\\&;1.>~:", max_size=60))
def test_any_text_parses_to_ordered_slices(text):
    at = 0
    for c in markdown.parse(text):
        assert at <= c.start <= c.stop <= len(text)
        at = c.stop
        markers.scan(c.text) if "⟦" not in text and not any(t in text for t in ("<em", "<strong", "<link", "</")) else None


def test_empty_and_blank():
    assert markdown.parse("") == [] and markdown.parse(" \n\n\t\n") == []
