"""Leaf blocks of generated trees."""

import html
import random

import pytest

from strandweave.llm import html_blocks

INLINE = ["b", "i", "span", "a", "ruby", "rt", "math", "mi", "picture", "output", "meter", "object", "x-note", "font", "unheard"]
BLOCK = ["div", "section", "article", "ul", "blockquote", "table", "main", "figure"]


def tree(rng, depth, inline):
    """(HTML, marks): the marks are texts, and None where a block begins or ends."""
    out, marks = "", []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            text = rng.choice(["one", "two  three", " \n", "a & b", "<c>", "é", " x", "y "])
            out += html.escape(text) if rng.random() < 0.8 else "".join(f"&#{ord(c)};" for c in text)
            marks.append(text)
        elif kind < 0.5:
            out += rng.choice(["<br>", "<br/>", "<wbr>", "<!-- no -->", "<img src='x>y'>"])
            marks.append(" " if out.endswith(("<br>", "<br/>")) else "")
        else:
            within = inline or rng.random() < 0.5
            tag = rng.choice(INLINE if within else BLOCK)
            inner, own = tree(rng, depth - 1, within)
            out += f"<{tag} class='{rng.choice(['', 'k', 'k l'])}'>{inner}</{tag}>"
            marks += own if within else [None, *own, None]
    return out, marks


@pytest.mark.parametrize("seed", range(200))
def test_blocks_of_a_tree(seed):
    page, marks = tree(random.Random(seed), 5, False)
    want, held = [], ""
    for m in [*marks, None]:
        held += m or ""
        if m is None and held.split():
            want.append(" ".join(held.split()))
        held = "" if m is None else held
    assert [b[0] for b in html_blocks.leaf_blocks(page)] == want


def test_elements_in_a_line_do_not_cut_it():
    page = "<p>pre <ruby>x<rt>y</rt></ruby> <math><mi>z</mi></math>, <picture><img></picture><my-thing>w</my-thing> <object>o</object> end</p><p>next</p>"
    assert [b[0] for b in html_blocks.leaf_blocks(page)] == ["pre xy z, w o end", "next"]
