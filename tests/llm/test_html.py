"""Tables, hidden parts, lists and broken pages of the HTML renderer."""

from __future__ import annotations

import random
import re
import time

from loomset.llm import html_render


def shown(page):
    return html_render.render(html_render.parse(page))


def test_text_of_a_table_outside_of_its_cells_is_kept():
    page = "<table>stray<form><tr><td>inform</td></tr></form><tr><td>x</td>loose</tr></table>after"
    assert shown(page) == "strayloose\n\ninform\nx\n\nafter"
    assert shown("<table><td>a<td>b<tr><p>c</p><td>d</table>") == "c\n\na | b\nd"


def test_cells_keep_their_blocks():
    page = "<table><tr><td><ul><li>a<li>b</ul><pre>k\n  l</pre><p>p1<p>p2<td>z</table>"
    lines = shown(page).split("\n")
    assert [x.split("|")[0].rstrip() for x in lines] == ["- a", "- b", "", "k", "  l", "", "p1", "", "p2"]
    assert lines[0] == "- a | z"
    inner = "<table><tr><td>out<td><table><tr><th>n<th>value<tr><td>1<td>2</table></table>"
    assert shown(inner) == "out | n | value\n    | 1 | 2"


def test_cells_that_span_rows_and_columns():
    page = "<table><tr><td rowspan=2>r<td>1<td>2<tr><td>3<td>4<tr><td colspan=2>c<td>5<tr><td rowspan=x>a<td>b<td>c</table>"
    assert shown(page) == "r | 1 | 2\n  | 3 | 4\nc |   | 5\na | b | c"


def test_visibility_and_depth():
    assert shown("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>") == "yes"
    assert shown("<div style='display:none'>no <b style='visibility: visible'>no</b></div>x") == "x"
    assert shown("<i>" * 300 + "<div hidden>secret<p>more</p></div>shown</i>") == "shown"
    assert shown("<i>" * 300 + "<script>secret</script><b style='display:none'>no</b>shown") == "shown"


def test_numbers_of_list_items():
    assert shown("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert shown("<ol reversed><li>a<li>b</ol>") == "2. a\n1. b"
    assert shown("<ol reversed start=9><li>a<li>b</ol><ol start=-1><li>c<li>d</ol>") == "9. a\n8. b\n\n-1. c\n0. d"


def test_broken_pages_take_linear_time():
    pages = [
        "<a " * 300_000, '<a "' * 200_000 + ">", "<a ='" * 200_000 + ">", "<a href=" * 100_000, "<div>" * 60_000 + "x" + "</div>" * 60_000,
        "<p><table><td>" + "<b>" * 30_000 + "<div></div>" * 30_000, "<!--" * 200_000, "<" * 900_000, "<table><tr><td>" * 20_000 + "x",
        "<a " + "b " * 300_000 + ">x", "<p " * 1000 + ">" * 100_000, "</b>" * 200_000, "<textarea>x" * 50_000, "&" * 900_000,
    ]
    for page in pages:
        start = time.process_time()
        shown(page)
        assert time.process_time() - start < 15, page[:30]
    assert shown("text <a cut off") == "text" and shown("1 < 2 <b>c</b>") == "1 < 2 c"


def test_random_pages_keep_every_visible_word():
    """Words of a well-formed random page against a walk over its own tree."""
    rng, made = random.Random(8), 0

    def grow(depth, visible):
        nonlocal made
        out, words = "", []
        for _ in range(rng.randrange(1, 5)):
            made += 1
            kind = rng.random()
            if depth == 0 or kind < 0.4:
                out += f" w{made} "
                words += [f"w{made}"] if visible else []
                continue
            name = rng.choice(["div", "b", "span", "section", "blockquote", "li", "td"])
            hide = rng.random() < 0.15
            inner, own = grow(depth - 1, visible and not hide)
            text = f"<{name}{' hidden' if hide else ''}>{inner}</{name}>"
            out += {"li": f"<ul>{text}</ul>", "td": f"<table><tr>{text}</tr></table>"}.get(name, text)
            words += own
        return out, words

    for _ in range(150):
        page, words = grow(5, True)
        assert re.findall(r"w\d+", shown(page)) and sorted(re.findall(r"w\d+", shown(page))) == sorted(words) or not words
