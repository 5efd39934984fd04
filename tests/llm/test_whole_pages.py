"""Pages whose article has several sections, and what a kept block may not lose."""

from __future__ import annotations

import pytest

from lexloom.llm import html_text

NAV = f'<nav><ul>{"<li><a href=x>menu</a></li>" * 20}</ul></nav>'
FOOT = "<footer><a href=y>c</a> small</footer>"


@pytest.mark.parametrize("sections", [(6, 5, 4), (3, 3), (10, 2, 8, 7)])
def test_every_section_is_kept(sections):
    lines = [[f"Plain words of part {k} number {i}, with more. " * 8 for i in range(n)] for k, n in enumerate(sections)]
    article = "".join(f"<section>{''.join(f'<p>{x}</p>' for x in part)}</section>" for part in lines)
    text = html_text.extract(f"<html><body>{NAV}<article>{article}</article>{FOOT}</body></html>")[1]
    assert text.split("\n") == [x.strip() for part in lines for x in part]


def test_a_paragraph_with_markup_is_not_cut():
    first, second = "The first section. " * 40, "start of it " * 30
    page = f"<body>{NAV}<div><section><p>{first}</p><p>{first}</p></section><section><p>{second}<span><b>aaaa</b> <b>bbb</b></span> end</p></section></div>{FOOT}</body>"
    text = html_text.extract(page)[1]
    assert text.split("\n") == [first.strip()] * 2 + [second + "aaaa bbb end"]
