"""Which attributes hide an element, and which only look like it."""

import pytest

from lectern.llm import html_text


@pytest.mark.parametrize(
    ("attrs", "hidden"),
    [
        ("hidden", True),
        ("HIDDEN=''", True),
        ("id=x hidden class=y", True),
        ("hidden=until-found", True),
        ("style='display:none'", True),
        ('style="color: red; DISPLAY : None !important"', True),
        ("style=visibility:hidden", True),
        ("style='visibility: collapse;'", True),
        ("style='display&#58;none'", True),
        ("style='display:none!important; display:block'", True),
        ("style='background:url(\"a;b\"); display:none'", True),
        ("style='/* a */ display/* b */: none'", True),
        ("style='backface-visibility:hidden'", False),
        ("style='-webkit-backface-visibility: hidden'", False),
        ("style='overflow:hidden'", False),
        ("style='display:none; display:block'", False),
        ("style='content:\"; display:none\"'", False),
        ("style='x-display:none'", False),
        ("style='/* display:none */'", False),
        ("title='A hidden gem'", False),
        ("class='a hidden b'", False),
        ("class=hidden", False),
        ("data-type='hidden'", False),
        ("type='hidden'", False),
        ("aria-hidden='false' data-hidden", False),
        ("data-style='display:none'", False),
        ("alt='style=display:none'", False),
        ("title='x' title='hidden' /", False),
    ],
)
def test_hiding(attrs, hidden):
    assert html_text.html_to_text(f"a<div {attrs}>b <b>c</b></div>d") == ("ad" if hidden else "a\nb c\nd")


def test_attributes():
    assert html_text.attributes(" A=1 b = 'x y' c/ d=\"&amp;\" a=2 e=") == {"a": "1", "b": "x y", "c": "", "d": "&", "e": ""}
