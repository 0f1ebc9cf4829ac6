"""Pages to lines: nested hidden blocks, body blocks, broken styles, superscripts, entities, missing ends."""

import pytest

from lexweave.sources import pages

BODY = 'class="w-100 pull-left body'


def lines(spark, page, **options):
    found = pages.page_lines(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html", **options).orderBy("pos").collect()
    assert [r.pos for r in found] == list(range(len(found)))
    return [r.line for r in found]


@pytest.mark.parametrize("page, wanted", [
    ("<p>a</p><p>b<br>c</p>", ["a", "b", "c"]),
    ('<div>one<div style="display:none">x<div>y</div>z<p>q</p></div>two</div><div>three</div>', ["one", "two", "three"]),
    ('<p style="color:red; display: none">gone</p><p>stays</p><span style="display:none"><span>in</span> out</span> end', ["stays", "end"]),
    ('<div style="display:none">never closed <p>x</p>', []),
    ("<div>a</div></div><div>b", ["a", "b"]),
    ("a<script>var t = '</p>'; if (1 < 2) {}</script>b<style>p{}</style>c<!-- <p>no</p> -->d", ["a b c d"]),
    ("5<span>1</span> x<sup> 12&nbsp;</sup>y<sup>ab</sup>z<sup>3<b>4</b></sup>", ["51 x¹²yabz³⁴"]),
    ("a &amp;quot; &lt;b&gt; &#1105;&nbsp;&copy; c", ["a &quot; <b> ё © c"]),
    ("<td>1</td><td>2</td></tr><tr><td>3</td>", ["1 2", "3"]),
    ('<p class="x" style="a>margin: 0; color:red">text</p>', ["text"]),
    ("1 < 2 and <b>3</b>", ["1 < 2 and 3"]), ("x\ny\r\nz", ["x", "y", "z"]), ("", []), (None, []), (" <p> \n </p>", []),
])
def test_lines(spark, page, wanted):
    assert lines(spark, page) == wanted


def test_body_blocks_are_sliced(spark):
    page = f'<p>head</p><div {BODY} x">one<p>two</p><script>s</script><p>after script</p></div>between<div {BODY}">three<div><div {BODY}">four</div></div></div><style>z</style>tail'
    assert lines(spark, page, body=BODY) == ["one two", "three", "four"]
    assert lines(spark, "<p>no body</p>", body=BODY) == ["no body"]
    assert lines(spark, '<p>a</p><span class="icon-s x">print <span>me</span></span><p>b</p>', dropped='class="icon-s') == ["a", "b"]


def test_many_pages_and_a_long_one(spark):
    rows = [(i, "<p>" + "</p><p>".join(f"{i} {k}" for k in range(i)) + "</p>") for i in range(40)] + [(900, '<div style="display:none">' * 300 + "x" + "</div>" * 300 + "<p>y</p>" * 3000)]
    found = pages.page_lines(spark.createDataFrame(rows, "id long, html string"), "id", "html").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in found} == {i: i for i in range(1, 40)} | {900: 3000}
    assert pages.page_lines(spark.createDataFrame([], "id long, html string"), "id", "html").count() == 0


@pytest.mark.parametrize("query", ["x_html_lines", "x_page_lines"])
def test_registered_queries_leave_references_without_semicolon(spark, tmp_path, query):
    import duckdb

    from lexweave.plans import catalog

    spark.createDataFrame([(1, "<title>a &amp;&amp</title><p>b &amp;amp; &copy; &am</p>&quot;c &notit; &#1105;"), (2, "&amp"), (3, None)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = {tuple(r) for r in catalog.QUERIES[query](spark, str(tmp_path)).where("line NOT LIKE '\"c%'").collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        wanted = {r for r in con.execute(catalog.ORACLES[query]).fetchall() if not r[2].startswith('"c')}
    assert found == wanted and (1, 0, "a &&amp") in found and (2, 0, "&amp") in found
    assert [r.line for r in catalog.QUERIES[query](spark, str(tmp_path)).where("line LIKE '\"c%'").collect()] == ['"c &notit; ё']


def test_references_without_semicolon_are_decoded_by_default(spark):
    assert lines(spark, "<p>a &amp b &copy</p>") == ["a & b ©"]


def test_tokens_stay_with_their_page(spark):
    plan = pages.page_lines(spark.createDataFrame([(1, "<p>a</p>")], "id long, html string"), "id", "html")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
