import re

import pytest

from kbspark.functions.html import protected_email, read_page


def code(email, key=0x2A):
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in email)


CASES = [
    ("<body><header><h1>Ann</h1></header><nav><p>menu menu</p></nav><footer>x</footer>text</body>", "[H1] Ann\n\ntext"),
    ("<table><tr><td><p>Closed Sundays</p></td></tr></table>", "[SB]Closed Sundays"),
    ("<ul><li>one<li>two <b>x</b></li><li> </li></ul>", "[SB]one, two x"),
    ("<ul><li>a<ul><li>b</li><li>c</li></ul></li></ul>", "[SB]a [SB]b, c".replace("[SB]b", "b")),
    ("<p>one<br>two</p>", "[SB]one\ntwo"),
    ("<p>first<p>second", "[SB]first\n\n[SB]second"),
    ("<p><b>bold<br><p>next</p>", "[SB]bold\n\n[SB]next"),
    ("<h2> Hours &amp; more </h2><div>a   \t b</div>", "[H2] Hours & more\n\na b"),
    ('<script>var t="</p>";</script><p>kept</p><!-- no -->', "[SB]kept"),
    ("<dl><dt>T<dd>D<dd>E</dl>", "[SB]T\n\n[SB]D\n\n[SB]E"),
    ("<head><title>no</title></head><body>yes</body>", "yes"),
    ("plain", "plain"),
    ("", ""),
    (None, ""),
    ("<ul><div><li>lost</li></div></ul>", ""),
    ("<p>wrapped\nline</p>", "[SB]wrapped\nline"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_text(html, text):
    assert read_page(html)["text"] == text


def test_protected_email():
    link = f'<p>Mail <a href="/cdn-cgi/l/email-protection#{code("a@b.org")}">[email&nbsp;protected]</a> now</p>'
    page = read_page(link)
    assert page["text"] == "[SB]Mail a@b.org now" and page["links"] == []
    assert protected_email("zz") is None and protected_email("") is None


def test_links_and_nav():
    html = '<nav><a href="/n">n</a></nav><a href="/a">x</a><a href="#top">t</a><a href="mailto:a@b.c">m</a>'
    assert read_page(html)["links"] == ["/a"]
    assert read_page(html, keep_nav_links=True)["links"] == ["/n", "/a"]


@pytest.mark.parametrize(
    "html,needs",
    [
        ("<h1>x</h1>", False), ("<p>x</p>", True), ('<h1>x</h1><script src="/static/react.min.js"></script>', True),
        ('<h1>x</h1><meta name="generator" content="Wix.com">', True), ('<h1>x</h1><div id="__next"></div>', True),
    ],
)
def test_needs_render(html, needs):
    assert read_page(html)["needs_render"] is needs


def test_deep_nesting_and_soup():
    assert read_page("<div>" * 5000 + "deep")["text"] == "deep"
    assert re.sub(r"\s+", " ", read_page("</p></div>a</b><table><td>b</table>c")["text"]) == "a [SB]b c"
