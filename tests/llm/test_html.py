import pytest

from orefield.llm.html_text import Sheet, html_text

PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<ol start=9><li>a<li value=20>b<li>c</ol>", "9. a\n20. b\n21. c"),
    ("<dl><dt>k<dd>v<dt>k2<dd>v2</dl>", "k\n  v\nk2\n  v2"),
    ("<table><caption>cap</caption><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "cap\na    bb\nccc  d"),
    ("<table><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E<tr><td colspan=2>F<td>G</table>", "A  B  C\n   D  E\nF     G"),
    ("<table><tr><td rowspan=0>A<td>1<tr><td>2<tr><td>3</table>", "A  1\n   2\n   3"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
    ("<table><tr><td>数据<td>x<tr><td>a<td>y</table>", "数据  x\na     y"),
    ('<a title="x > y">text</a>', "text"),
    ("<a title='<b>no</b>'>text</a>", "text"),
    ("<style>.x{display:none} p.z,#i{visibility:hidden}</style><p class='y x'>no<p class=z>no<span style='visibility:visible'>yes</span><p id=i>no<p>b", "yes\n\nb"),
    ("<style>b{display:none} b.on{display:inline} @media print{i{display:none}}</style><b>no</b> <b class=on>yes</b> <i>i</i>", "yes i"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<div hidden>no</div><div hidden style='display:block'>yes</div>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<svg><title>no</title><g><text>lab<tspan>el</tspan></text></g></svg>", "label"),
    ("x <math><mi>y</mi><mo>=</mo><mn>2</mn></math>", "x y=2"),
    ("<input value=v><input type=hidden value=no><input type=checkbox value=no><input type=submit value=Go>", "v Go"),
    ("<pre>\na\n  b\n</pre>c", "a\n  b\n\nc"),
    ("a<br>b<hr>c", "a\nb\n\nc"),
    ("<p>a &lt;b&gt; &amp;amp; &#x41;", "a <b> &amp; A"),
    ("<!-- no --><![CDATA[yes]]><!doctype html>", "yes"),
    ("<script>if (a<b) no()</script><noscript>no</noscript>x", "x"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("</div></p>x</b>", "x"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages_show_their_text(page, text):
    assert html_text(page) == text


@pytest.mark.parametrize("tag", ["ul", "ol", "ul><li", "table", "table><tr><td", "blockquote", "div", "b", "dl><dd", "details open", "math"])
def test_elements_nest_as_deep_as_they_like(tag):
    assert html_text(f"<{tag}>" * 5000 + "deep").endswith("deep")


def test_rules_of_higher_rank_win():
    s = Sheet("p{display:none} .a{display:block} #i{visibility:hidden} p > b{display:none} .a.b:hover{display:none}")
    assert s.of("p", {}) == {"display": "none"} and s.of("p", {"class": "a"}) == {"display": "block"}
    assert s.of("b", {"id": "i", "style": "visibility: visible"}) == {"visibility": "visible"} and s.of("b", {}) == {}
