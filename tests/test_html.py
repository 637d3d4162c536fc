import pytest
from pyspark.sql import functions as F

from ledgerine.operators import extract, html, ixbrl
from ledgerine.plans import sec

PAGE = "<section>\n<h4>Opening <em>words</em></h4>\n  <article>\n <b>deep</b><br>tail<div>block <i>in</i></div>\n </article><ol><li>uno<li>due</ol>\n<p>closing</section><p>outside</p>"


def nodes_of(spark, *sources):
    return html.parse_html(spark.createDataFrame(list(enumerate(sources)), "k int, h string"), ["k"], "h")


def test_text_of_blocks():
    tree = html.tree(PAGE)
    assert [c.tag for c in tree.children[0].children] == ["head", "body"]
    found = {r[6]: r[12] for r in html.rows(PAGE) if r[10] and r[5] == "element"}
    assert (found["li"], found["p"], found["em"], found["b"]) == ("due\n", "outside\n", "words", "deep\n")
    assert [r[12] for r in html.rows(PAGE) if r[6] == "li"] == ["uno\n", "due\n"]


def brute_following(rows, at, budget):
    """As the rule is worded: texts of leaves one after the other until the trimmed text is long enough."""
    out = ""
    for row in rows[at + 1 :]:
        if row[0] > rows[at][1] and row[10] and row[12] and row[3] >= rows[at][3] - 2 and not (row[11] and row[3] - 1 >= rows[at][3] - 2) and len(out.strip().encode()) < budget:
            out += row[12]
    return out.strip()


@pytest.mark.parametrize("budget", [0, 1, 5, 9, 20, 700])
def test_following_text(budget):
    for source in (PAGE, PAGE.replace("deep", "d\u00e9\u6f22" * 3), "<div><p>\u3000x\xa0</p><p>\u2003</p><p>y</p></div>"):
        rows = html.rows(source)
        for at in range(len(rows)):
            assert extract.following(rows, at, budget) == brute_following(rows, at, budget)


def test_one_pass_equals_the_node_table(spark):
    sources = [PAGE, "<table><tr><td>Name<table><tr><td>Name $</td></tr></table></td></tr></table>", None, "", "<p>Opening</p>"]
    docs = spark.createDataFrame(list(enumerate(sources)), "k int, h string")
    wanted = extract.Wanted(leaf=lambda t: "o" in t, anchor=lambda t: "O" in t, budget=30, table=lambda t: "Name" in t)
    one = extract.extracts(docs.withColumn("facts", F.lit(1)), ["k"], "h", wanted, 3)
    assert one.count() == 5
    nodes = html.parse_html(docs, ["k"], "h")
    flat = lambda c, *names: sorted(tuple(r) for r in one.select("k", F.explode(c).alias("x")).select("k", *[f"x.{n}" for n in names]).collect())
    assert flat("leaves", "node_id", "text") == sorted(tuple(r) for r in html.leaf_texts(nodes, lambda t: F.when(F.contains(t, F.lit("o")), t)).select("k", "node_id", "text").collect())
    assert flat("tables", "node_id", "text", "outer_html") == sorted(tuple(r) for r in html.tables_where(nodes, lambda t: F.contains(t, F.lit("Name"))).select("k", "node_id", "text", "outer_html").collect())
    assert len(flat("tables", "node_id")) == 2 and len(flat("anchors", "text")) == 2


def test_markup_of_any_node(spark):
    odd = "<div a='1&quot;' b=\"it's\"><p>x &amp; y<br><img src=q>z<!-- n --></p><script>a<b&&c</script><table><tr><td>1<td>2</table></div><style>p>q</style>"
    nodes = nodes_of(spark, PAGE, odd, "", None)
    wanted = nodes.where("kind = 'element'").select("k", "node_id", "subtree_end", "tag", "outer_html")
    found = {(r["k"], r["node_id"]): r["markup"] for r in html.markup(nodes, wanted, ["k"]).collect()}
    assert len(found) == wanted.count()
    for r in wanted.where("outer_html is not null").collect():
        assert found[r["k"], r["node_id"]] == r["outer_html"]
    for k, source in enumerate((PAGE, odd)):  # reading the markup again gives the same tree
        page = next(found[k, i] for i in range(3) if (k, i) in found)
        assert page.startswith("<html>") and [r[5:9] for r in html.rows(page)] == [r[5:9] for r in html.rows(source)]
    assert "<script>a<b&&c</script>" in found[1, 1] or "<script>a<b&&c</script>" in page


def test_implied_elements_and_intervals():
    rows = html.rows("<p><b>one<br><p>two</b><table><tr><td>a<td>b</table><ul><li>x<li>y</ul>")
    tags = [r[6] for r in rows if r[5] == "element"]
    assert tags == ["html", "head", "body", "p", "b", "br", "p", "b", "table", "tbody", "tr", "td", "td", "ul", "li", "li"]
    for i, end, parent, depth, *_ in rows:
        assert end >= i and (parent is None or rows[parent][1] >= end and rows[parent][3] == depth - 1)


def body(source):
    def markup(node):
        if node.kind == "text":
            return node.data
        return f"<{node.tag}>" + "".join(map(markup, node.children)) + (f"</{node.tag}>" if node.tag not in html.VOID else "")

    return "".join(map(markup, html.tree(source).children[-1].children[-1].children))


@pytest.mark.parametrize(("source", "expected"), [
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<div><a><b><div><div>x</a>", "<div><a><b></b></a><b><div><a></a><div><a>x</a></div></div></b></div>"),
    ("<a><p>x<a>y</a></p>", "<a></a><p><a>x</a><a>y</a></p>"),
    ("<font><p>a<font>b</p>c</font>d", "<font><p>a<font>b</font></p><font>c</font>d</font>"),
    ("<table>loose<tr><td>a", "loose<table><tbody><tr><td>a</td></tr></tbody></table>"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
    ("A<table><tr> B</tr> </em>C</table>", "A BC<table><tbody><tr></tr> </tbody></table>"),
    ("<table><ix:x>q</ix:x><tr><td>y", "<ix:x>q</ix:x><table><tbody><tr><td>y</td></tr></tbody></table>"),
    ("<table><tr><td>x<table><tr><td>y</table>z</table>", "<table><tbody><tr><td>x<table><tbody><tr><td>y</td></tr></tbody></table>z</td></tr></tbody></table>"),
    ("<table><caption>c<tr><th>h<td>d<tbody><tr><td>q</table>t", "<table><caption>c</caption><tbody><tr><th>h</th><td>d</td></tr></tbody><tbody><tr><td>q</td></tr></tbody></table>t"),
    ("<table><col><col><tr><td><b>x</td><td>y</table>z", "<table><colgroup><col><col></colgroup><tbody><tr><td><b>x</b></td><td>y</td></tr></tbody></table>z"),
    ("<td>x</td><div>y</div></p>", "x<div>y</div><p></p>"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul><h1>a<h2>b</h1>c", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><h1>a</h1><h2>b</h2>c"),
    ("<!DOCTYPE html><p>a<table></table>", "<p>a</p><table></table>"),
    ("<!DOCTYPE HTML PUBLIC '-//W3C//DTD HTML 3.2//EN'><p>a<table></table>", "<p>a<table></table></p>"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN"><p>a<table></table>', "<p>a<table></table></p>"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN" "http://www.w3.org/TR/html4/loose.dtd"><p>a<table></table>', "<p>a</p><table></table>"),
    ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "x"><p>a<table></table>', "<p>a</p><table></table>"),
    ('<!DOCTYPE html SYSTEM "about:legacy-compat"><p>a<table></table>', "<p>a</p><table></table>"),
    ("<!DOCTYPE note><p>a<table></table>", "<p>a<table></table></p>"),
    ("<select><div>a<option>b<option>c<b>d</select>e", "<select>a<option>b</option><option>cd</option></select>e"),
    ("<select><optgroup><option>a<optgroup><option>b</optgroup>c<hr>d</select>", "<select><optgroup><option>a</option></optgroup><optgroup><option>b</option></optgroup>c<hr>d</select>"),
    ("<p><select><option>a<input>b", "<p><select><option>a</option></select><input>b</p>"),
    ("<select><option>a<select>b", "<select><option>a</option></select>b"),
    ("<table><tr><td><select><option>a<td>b</table>c", "<table><tbody><tr><td><select><option>a</option></select></td><td>b</td></tr></tbody></table>c"),
    ("<b>x<select><option>y</b>z</select>w", "<b>x<select><option>yz</option></select>w</b>"),
    ("<p>a<table></table>", "<p>a<table></table></p>"),
])
def test_tree_construction(source, expected):
    assert body(source) == expected


def test_elements_that_are_no_xml_go_with_all_inside(spark):
    f = lambda name, inside: f'<ix:nonNumeric name="{name}">{inside}</ix:nonNumeric>'
    inner = '<ix:nonFraction name="in" contextRef="c">1</ix:nonFraction><xbrli:context id="c"></xbrli:context>'
    src = "<div>" + f("script", "<script>a<b</script>" + inner) + f("control", "5\x01") + f("comment", "<!-- a--b -->") + f("name", "<x:y:z>1</x:y:z>") + f("good", "<!-- a-b -->5<b>&lt;</b>") + '<foo:bar a"b="1">' + f("inside unknown", "5") + "</foo:bar></div>"
    assert [x["name"] for x in ixbrl.facts_of(src)] == ["good", "inside unknown"]
    nodes = nodes_of(spark, src)
    assert [r["name"] for r in ixbrl.facts(nodes, ["k"]).orderBy("node_id").collect()] == ["good", "inside unknown"] and ixbrl.contexts(nodes, ["k"]).count() == 0


def test_empty_null_and_deep(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    counts = {r["k"]: r["n"] for r in nodes_of(spark, "", None, deep).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 4, 1: 4, 2: 3005}


def test_any_namespace_and_last_context(spark):
    src = '<custom:element>x</custom:element><xbrli:context id="c"><xbrli:period><xbrli:instant>2020-01-01</xbrli:instant></xbrli:period></xbrli:context><xbrli:context id="c"><xbrli:period><xbrli:startDate>2021-12-27</xbrli:startDate><xbrli:endDate>2022-12-31</xbrli:endDate></xbrli:period></xbrli:context><ix:nonFraction contextRef="c" name="n" scale="3">27,163</ix:nonFraction><ix:nonFraction contextRef="zz" name="n" scale="3">1</ix:nonFraction>'
    nodes = nodes_of(spark, src)
    assert ixbrl.tagged(nodes).where("type is null").select("tag").first()["tag"] == "custom:element"
    found = ixbrl.with_context(ixbrl.facts(nodes, ["k"]), ixbrl.contexts(nodes, ["k"]), ["k"]).orderBy("node_id").collect()
    assert found[0]["context"]["period"]["end_date"] == "2022-12-31" and found[1]["context"] is None


def test_pay_ratio_and_headcount(spark):
    src = "<div><p><b>CEO Pay Ratio</b></p><p>The pay of our CEO was $74,609,802 and of the median employee $114,738.</p><p>As of December 31, 2024 we had 12,345 full-time employees</p></div>"
    found = sec.of_documents(spark.createDataFrame([(0, src), (1, "<p>nothing</p>"), (2, None)], "k int, h string"), ["k"], "h").orderBy("k").collect()
    assert [[(x["ratio"]["ceo"], x["ratio"]["median"]) for x in r["ratios"]] for r in found] == [[(74609802.0, 114738.0)], [], []]
    assert [[x["employees"] for x in r["employees"]] for r in found] == [[12345], [], []] and all(r["buybacks"] is None for r in found)


def test_facts_of_organisations(spark):
    fact = lambda name, v, end: f'<xbrli:context id="c"><xbrli:entity><xbrli:segment><x:y scheme="zz"></x:y></xbrli:segment><xbrli:identifier scheme="s">7</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:endDate>{end}</xbrli:endDate></xbrli:period></xbrli:context><ix:nonFraction name="{name}" contextRef="c">{v}</ix:nonFraction>'
    net, back = sec.CONCEPTS["net_income_loss"], sec.CONCEPTS["buybacks"]
    table = "<table><tr><td>Name</td><td>Salary</td><td>$1</td></tr></table>"
    rows = [("1", 0, fact(net, 5, "2020-01-01") + table, "a"), ("1", 1, fact(net, 6, "2021-01-01") + fact(back, 9, "2021-06-01") + table + table, "b"), ("1", 2, None, "c"), ("2", 0, "<p>December: 1,500 employees", "d")]
    names = spark.createDataFrame([("1", "T", "N")], "cik string, ticker string, company_name string")
    found = {r["cik"]: r for r in sec.facts(spark.createDataFrame(rows, "cik string, doc_ord int, content string, form string"), names, tasks=2).collect()}
    assert [x["content"] for x in found["1"]["net_income_loss"]] == ["6", "5"] and [x["content"] for x in found["1"]["buybacks"]] == ["9"] and found["1"]["cash"] is None
    assert found["1"]["net_income_loss"][0]["context"]["entity"]["identifier"]["scheme"] == "s" and len(found["1"]["exec_compensation_html"]) == 3
    assert [x["form"] for x in found["1"]["filings"]] == ["a", "b", "c"] and (found["2"]["employees_count"], found["2"]["company_name"], found["2"]["ceo_pay_ratio"]) == (1500, "", None)


def test_documents_of_one_template_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(html, "tree", lambda source, own=html.tree: parsed.append(source) or own(source))
    page = '<div id="d%d"><p title="a">  x &amp; %s<br><b>%s</b></p><table>%s<tr><td>%s</table><ix:nonFraction name="n" contextRef="c">%d</ix:nonFraction></div><script>a<b</script>'
    own = [page % (i, "&lt" * (i % 2) + str(i), "é" * (i + 1), i, " " if i % 3 else i, i) for i in range(30)]
    found = [html.rows(x) for x in own]
    assert len(parsed) == 2  # with a blank cell and without
    assert found == [html.Layout(html.tree(x)).rows(None) for x in own]


@pytest.mark.parametrize("source", ['<p>a<a title="x>y">b</p>', "<p>a<a title='x>%s'>b</p>", "<p>&#32;%s</p>", "<script>%s", "<!-- > -->%s<!--", "<textarea><p>%s", "a < b %s", '<b id="k">1<p>%s</b>', "\U000f0001%s"])
def test_what_layouts_cannot_tell_is_parsed_by_itself(source):
    for text in ("x", "&amp;", " "):
        own = source.replace("%s", text)
        assert html.rows(own) == html.Layout(html.tree(own)).rows(None)
