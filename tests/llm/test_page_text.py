import time

import pytest

from tidebars.llm.page_text import extract_text, tree_events, visible_text


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<b>a</b>  <i> b</i>c", "a bc"), ("<p>x<b>y<br><p>z</p>", "xy\n\nz"),
    ("<title>t</title><style>p{}</style><script>var t='</p>';</script>seen", "seen"),
    ("<p hidden>a</p><p style='display: none'>b</p><span aria-hidden=true>c</span>d", "d"),
    ("<p style='color:red'>a<!-- x --></p>", "a"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<table><tr><th>n<th>value<tr><td>long name<td>1</table>", "n         | value\nlong name | 1"),
    ("<table><td>a<td>b</table>", "a | b"),
    ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        | y\n         |\nin | ner |"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("<details><summary>s</summary>body</details>t", "s\nt"), ("<details open><summary>s</summary>body</details>", "s\nbody"),
    ("<td>a</td> b", "a b"), ("a</div></p>b", "ab"), ("<!doctype html><html><head><meta charset=x></head><body>q</body></html>", "q"),
    ("<p title=\"a>b\" x='<p>'>k", "k"), ("a <p title=\"open", "a"), ("1 < 2 <3", "1 < 2 <3"), ("<dl><dt>t<dd>d</dl>", "t\nd"),
    ("<noscript>n</noscript><template>t</template><textarea>a\nb</textarea>", "a\nb"), ("<input type=text value=v>w", "w"), ("a<wbr>b", "ab"),
    ("<select><option>x<option>y</select>", "x\ny"), ("İ<script>x</script>b", "İb"),
])
def test_layout(page, want):
    assert visible_text(page) == want


def test_events_nest():
    page = "<table><tr><td><p>a<div>b</table><li>c<ul><li>d</ul></p><td>e</b></i><a><b></a>"
    stack = []
    for kind, name, _ in tree_events(page):
        if kind == "open":
            stack.append(name)
        elif kind == "close":
            assert stack.pop() == name
    assert not stack


def test_long_and_deep_pages_take_linear_time():
    t = time.process_time()
    assert visible_text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert len(visible_text("<p>word " * 100000)) > 500000
    assert visible_text("<a x=\"" * 3000) == ""
    visible_text("<table>" + f"<tr><td>{'w' * 9000}<td>b" * 300 + "</table>")
    assert time.process_time() - t < 30


def test_table(spark):
    rows = [(1, "<p>a", 0), (2, None, 0), (None, "<b>b", 0), (1, "<p>a", 0)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == [("1", "a"), ("1", "a"), ("2", ""), ("None", "b")]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
