"""P1/P2 section extraction: FIXTURES.md rows and malformed pages."""

from quarry.operators.htmltext import page_sections

PAGE = (
    '<body><section id="x"><h1>T<a href="#x">#</a></h1><p>Hello <b>w</b></p>'
    '<section id="y"><h2>U<a href="#y">#</a></h2></section></section></body>'
)


def test_fixture_sections():
    status, secs = page_sections(PAGE)
    assert status == "ok"
    assert [(p, h, t) for p, h, _, t in secs] == [(0, "#x", "T#\nHello w"), (1, "#y", "U#")]


def test_no_section_and_no_body():
    assert page_sections("<body><p>x</p></body>") == ("no_section", [])
    assert page_sections("<html><p>x</p></html>") == ("no_body", [])


def test_anchor_rules():
    _, secs = page_sections("<body><section><a>q</a>t</section><section>u</section></body>")
    assert secs[0][1] is None and secs[0][2] is True  # <a> without href
    assert secs[1][1] is None and secs[1][2] is False  # no <a>


def test_section_nested_in_div_shows_twice():
    html = "<body><section><a href='a'>A</a><div><section><a href='b'>B</a></section></div></section></body>"
    _, secs = page_sections(html)
    assert [t for *_, t in secs] == ["A\nB", "B"]


def test_unclosed_tags_and_script():
    html = "<body><section><a href='h'>x</a><p>one<p>two<script>var a='</p>';</script></section>"
    _, secs = page_sections(html)
    assert secs[0][3] == "x\nonetwo"


def test_entities_and_blank_elements():
    html = "<body><nav><a href='/a'>x &amp; y</a><p>  </p></nav></body>"
    _, secs = page_sections(html, "nav")
    assert secs[0][3] == "x & y\n"
