"""Deep nesting and wide cells cost no more than their length."""

import time

from lectern.llm import html_text


def test_deep_nesting_is_linear():
    start = time.time()
    for page in ("<div>" * 60_000 + "deep", "<p><table><tr><td>" + "<div>" * 60_000 + "cell", "<p>" + "<b>" * 60_000 + "x" + "</i>" * 60_000):
        assert html_text.build_tree(page)
    assert time.time() - start < 20


def test_a_wide_cell_pads_no_column():
    rows = "".join(f"<tr><td>a{i}<td>b" for i in range(2000))
    text = html_text.html_to_text(f"<table><tr><td>{'w' * 20_000}<td>x{rows}</table>")
    assert len(text) < 60_000 and text.startswith("w" * 20_000 + "  x\n") and text.endswith("a1999  b")


def test_scopes_hold():
    page = "<p>one<table><tr><td>in<p>two</td></tr></table>three</p><ul><li>a<li>b<ul><li>c</ul><li>d</ul></p></div>end"
    assert [x.strip() for x in html_text.html_to_text(page).split("\n") if x.strip()] == ["one", "in two", "three", "- a", "- b", "- c", "- d", "end"]
