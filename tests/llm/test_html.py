import pytest

from quillmill.llm.html import extract, to_text

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<h1>T</h1><p>x <b>y</b>z</p>", "T\n\nx yz"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ol type=a><li>x<li>y</ol>", "a. x\nb. y"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n\n  b"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><tr><th colspan=2>head<tr><td>a<td>b</table>", "head\na  b"),
    ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
    ("<table><caption>C</caption><tr><td>a</table>after", "C\na\n\nafter"),
    ("<pre>\n a\n   b</pre>", " a\n   b"),
    ("x<script>y</script><style>z</style><!-- c -->w", "xw"),
    ("<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no <span style='visibility:visible'>yes</span></p>", "yes"),
    ("<p class='hidden' data-hidden=1>seen</p>", "seen"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<details><summary>s</summary>body</details><details open><summary>s</summary>body</details>", "s\ns\nbody"),
    ("a &amp; b &lt;c&gt; &nbsp;d", "a & b <c>  d"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<p>a</div>b</p>", "ab"),
    ("<a href=x>one <a href=y>two</a>", "one two"),
    ("<b>x<p>y</b>z", "x\n\nyz"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("<p>un<wbr>broken</p>", "unbroken"),
    ("<div><p>open", "open"),
    ("<", "<"),
    ("<img alt='pic'> x", "pic x"),
    ("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3</table>", "x  1\n   2\n   3"),
    ("<table><tbody><tr><td rowspan=0>x<td>1<tr><td>2<tbody><tr><td>y<td>3</table>", "x  1\n   2\ny  3"),
    ("<table><tbody><tr><td rowspan=9>x<td>1<tbody><tr><td>y<td>3</table>", "x  1\ny  3"),
    ("<p style='display:none;display:block'>seen</p><p style='display:block; display: none'>no</p>", "seen"),
    ("<p style='display:none !important;display:block'>no</p><p style='visibility:hidden;visibility:visible'>seen", "seen"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_layout(html, text):
    assert to_text(html)[1] == text


def test_wide_characters_keep_columns_aligned():
    lines = to_text("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>")[1].split("\n")
    assert lines == ["日本  x", "abcd  y"]


@pytest.mark.parametrize("deep", [1, 19, 20, 21, 300, 2000])
def test_tables_nested_at_any_depth_are_laid_out_alike(deep):
    inner = "<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>"
    assert to_text("<table><tr><td>" * deep + inner + "</table>" * deep)[1] == "aa  b\nc   dddd"


def test_titles_nulls_and_hostile_input():
    assert to_text("<title>a &amp;\n b</title>x") == ("a & b", "x")
    assert to_text(None) == (None, None) and to_text("") == (None, "")
    assert to_text("<div>" * 50_000 + "deep")[1] == "deep"
    assert to_text("<table><tr><td>" * 60 + "deep")[1].strip() == "deep"
    assert to_text("<p " + "a" * 100_000)[1].startswith("<p") and to_text("<!--" * 1000)[1] == ""
    assert to_text("<li>" * 5000)[1] is not None


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    got = sorted((r.id, r.text) for r in extract(pages).where("id is not null").collect())
    assert got == [(1, "a"), (1, "a")] and extract(pages).count() == 3 and extract(pages.limit(0)).count() == 0


MISPLACED = [
    ("<table><td>x</table>", "x"),
    ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<table><tbody><td>a<td>b</tbody><th>c</table>", "a  b\nc"),
    ("<table><form><tr><td>x</td></tr></form></table>", "x"),
    ("<table><colgroup><col><tr><td>x</table>", "x"),
    ("<table>text<tr><td>x</table>", "text\n\nx"),
    ("<table><tr>text<td>x</td>more</table>after", "textmore\n\nx\n\nafter"),
    ("one<table><tr><td>x</td><div>two<td>y</table>", "one\ntwo\n\nx  y"),
    ("<table><tbody>t<b>u</b><tr><td>x</table>", "tu\n\nx"),
    ("<table><tr><td>x</tr><table><tr><td>y</table>", "x\n\ny"),
    ("<table><tr hidden>no<td>no<tr><td>x<script>no</script></table>", "x"),
    ("<table><form>" * 2000 + "<td>deep", "deep"),
    ("<table>" + "<div>" * 20_000 + "deep", "deep"),
]


@pytest.mark.parametrize(("html", "text"), MISPLACED)
def test_no_visible_text_of_a_table_is_lost(html, text):
    assert to_text(html)[1] == text


def test_clashing_names_and_ties(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, "u", None)], "page_id long, url string, html string")
    clash = pages.withColumns({c: F.lit("mine") for c in ("id", "title", "text")})
    assert sorted(map(repr, extract(clash).collect())) == sorted(map(repr, extract(pages).collect())) and extract(clash.where("false")).count() == 0
