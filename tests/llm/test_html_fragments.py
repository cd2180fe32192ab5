"""Rows without a table and heads that nothing closes keep their visible text."""

import pytest

from lanewise.llm.html_text import render

CASES = {
    "<tr><td>text</td></tr>": "text",
    "<tr><td>a<td>b</tr><tr><td>c</tr>after": "a | b\nc\nafter",
    "x<tr>one<td>two</td>three<td>four": "x\none\ntwo\nthree\nfour",
    "<div><tr><th>a<td>b<br>c</tr>d</div>": "a\nb\nc\nd",
    "<tr><td></td></tr>": "",
    "<tr><td><table><tr><td>a<td>b</table></tr>": "a | b",
    "<head><title>T</title>Hello <b>world</b> <a>link</a>": "Hello world link",
    "<head><title>T</title> <b>world</b><p>x": "world\n\nx",
    "<head> <meta charset=x><script>no</script><style>no</style><noscript>no</noscript>\n<br>x": "\nx",
    "<head><head>text": "text",
    "<html><head><title>T</title></head><body>b": "b",
    "<div hidden><head>no</div>x": "x",
}


@pytest.mark.parametrize("html", CASES)
def test_fragments(html):
    assert render(html) == CASES[html]
