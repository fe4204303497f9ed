import pytest
from arborel.api import VERSIONS, Functions, Selector, expression, iter_select, select
from arborel.errors import UnsupportedError, XPathArithmeticError, XPathError, XPathNameError
from arborel.plans.parser import StaticContext
from arborel.plans.trees import select as select_nodes
from arborel.sources import files
from arborel.sources.shred import xml_nodes
from arborel.streaming.documents import select_documents, select_rows
from pyspark.sql import functions as F


def test_rows_tables_and_trees(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "n long, s string")
    assert [r["value"] for r in select(df, "string-length(s) + n").orderBy("n").collect()] == [4, 2]
    assert select({"t": df}, "/t/row[n gt 1]/n").collect()[0]["value"] == 2
    assert Selector("count(tokenize(s, ' '))").over_rows(df).where("n = 1").first()["value"] == 2
    nodes = xml_nodes(spark.createDataFrame([(1, "<a><b/></a>")], "doc_id long, xml string"))
    assert [r["name"] for r in iter_select(nodes, "//b")] == ["b"]


def test_errors_of_jobs(spark):
    df = spark.createDataFrame([(0,)], "n long")
    with pytest.raises(XPathArithmeticError):
        list(iter_select(df, "1 idiv n"))
    with pytest.raises(XPathNameError):
        select(df, "unknown(n)")
    with pytest.raises(XPathNameError):
        select(df, "$nothing")


def test_variables_and_functions(spark):
    df = spark.createDataFrame([(3,)], "n long")
    own = Functions()
    own.external("ext:twice", lambda x: None if x is None else x * 2, ("xs:integer",), "xs:integer")
    from arborel.plans.parser import StaticContext

    static = StaticContext(namespaces=(("ext", "http://ext"),))
    assert df.select(expression(df, "ext:twice(n) + $v", static, own, v=F.lit(4))).first()[0] == 10
    with pytest.raises(Exception, match="XPST0017"):
        own.external("ext:bad", lambda x, y: x, ("xs:integer",), "xs:integer")


def test_versions(spark):
    df = spark.createDataFrame([(1, "12")], "n long, s string")
    assert df.select(expression(df, "s = 12", VERSIONS["1.0"])).first()[0] is True
    with pytest.raises(XPathNameError):
        expression(df, "parse-json(s)", VERSIONS["3.0"])


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<a x="1&amp;2" xmlns:p="u"><p:b>t &lt; u</p:b><!--c--><?pi d?><e/></a>')
    (tmp_path / "b.txt").write_text("one\r\ntwo\rthree\n")
    (tmp_path / "c.json").write_text('{"k": [1, 2]}')
    nodes = files.documents(spark, str(tmp_path / "a.xml"))
    uri = nodes.where("kind = 'document'").first()["base_uri"]
    assert files.document(nodes, uri).count() == nodes.count()
    assert files.serialize(nodes).first()["text"] == '<a xmlns:p="u" x="1&amp;2"><p:b>t &lt; u</p:b><!--c--><?pi d?><e/></a>'
    assert files.serialize(nodes, "text").first()["text"] == "t < u"
    assert [r["line"] for r in files.text_lines(spark, str(tmp_path / "b.txt")).orderBy("line_number").collect()] == ["one", "two", "three"]
    assert files.text_available(spark, str(tmp_path / "b.txt")) and not files.text_available(spark, str(tmp_path / "z"))
    assert select(files.json_documents(spark, str(tmp_path / "c.json")), "xs:integer((json)?k?2)").first()["value"] == 2
    assert select({"dir": files.folder_rows(spark, str(tmp_path))}, "count(/dir/row[ends-with(name, '.xml')])").first()["value"] == 1


def test_scopes_reach_the_writer_as_text(spark):
    nodes = xml_nodes(spark.createDataFrame([(1, "<a xmlns='u&quot;v' xmlns:p='w'><b/><p:c xmlns:q='x'/></a>")], "doc_id long, xml string"))
    written = files.serialize(nodes)
    assert "to_json(ns_map" in written._jdf.queryExecution().analyzed().toString()
    assert written.first()["text"] == "<a xmlns='u\"v' xmlns:p=\"w\"><b/><p:c xmlns:q=\"x\"/></a>"


def test_serialized_trees_parse_to_equal_nodes(spark):
    docs = [(1, "<a><b>x<c/>y</b><b k='2'/></a>"), (2, "<z/>")]
    nodes = xml_nodes(spark.createDataFrame(docs, "doc_id long, xml string")).cache()
    again = xml_nodes(files.serialize(nodes), "text").cache()
    key = lambda df: sorted((r["doc_id"], r["pre"], r["kind"], r["local"], r["value"] or "") for r in df.collect())
    assert key(nodes) == key(again)
    assert select_nodes(again, "//c").count() == 1


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", []
    spark.createDataFrame([(1, "<a><b>1</b><b>2</b></a>"), (2, "<broken>")], "doc_id long, xml string").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id long, xml string").parquet(str(source))
    query = select_documents(stream, "sum(//b)", lambda df, _: out.extend(r["value"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert out == [3.0]
    query = select_rows(stream, "string-length(xml)").writeStream.format("memory").queryName("lengths").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["value"] for r in spark.table("lengths").collect()) == [8, 23]


def test_parsed_documents_in_expressions(spark):
    df = spark.createDataFrame([(1, "<a><b>1</b><b>2</b></a>"), (2, None), (3, "<a><b>1</b><b>2</b></a>"), (4, "<a/>")], "k long, _0found string")
    got = select(df, "sum(parse-xml(_0found)//b) + count(parse-xml(_0found)/a)")
    assert got.columns == ["k", "_0found", "value"]
    assert {r["k"]: r["value"] for r in got.collect()} == {1: 4.0, 2: 0.0, 3: 4.0, 4: 1.0}
    with pytest.raises(Exception, match="FODC0006"):
        list(iter_select(spark.createDataFrame([("<a>",)], "x string"), "count(parse-xml(x)//*)"))


def test_resources_in_expressions(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\r\ntwo\n")
    (tmp_path / "j.json").write_text('{"k": [1, 2]}')
    df = spark.createDataFrame([(1,), (2,)], "n long")
    static = StaticContext(base_uri=f"file://{tmp_path}/")
    value = lambda text: [r["value"] for r in select(df, text, static).collect()]
    assert value("string-length(unparsed-text('t.txt')) + n") == [10, 11]
    assert value("unparsed-text-lines('t.txt')[2]") == [["two"]] * 2
    assert value("unparsed-text-available('t.txt') and not(unparsed-text-available('z'))") == [True, True]
    assert value("xs:integer(json-doc('j.json')?k?2) * n") == [2, 4]
    assert value("count(uri-collection('.'))") == [2, 2]
    with pytest.raises(XPathError, match="FOUT1170"):
        value("unparsed-text('none.txt')")


def test_set_operators_with_positions(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "c")], "n long, s string").repartition(3)
    value = lambda text: sorted(r["value"] for r in select({"t": rows}, text).collect())
    assert value("/t/row[position() le 2]/s | /t/row[n = 3]/s") == ["a", "a", "c", "c"]
    assert value("/t/row/n except /t/row[last()]/n") == [1, 1, 2, 3]
    assert value("/t/row[n = 1]/s intersect /t/row[s = 'a']/s") == ["a", "a"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_without_nested_loops_or_row_loops(spark):
    orders = spark.createDataFrame([(1, 2.0)], "k long, v double")
    items = spark.createDataFrame([(1, 2.0)], "k long, x double")
    tables = {"orders": orders, "items": items}
    assert "NestedLoop" not in plan_of(select(tables, "/orders/row[some $i in /items/row satisfies $i/x gt v]/k"))
    assert [r["value"] for r in select(tables, "/orders/row[every $i in /items/row satisfies $i/x ge v]/k").collect()] == [1]
    assert select(tables, "/orders/row[some $i in /items/row[x gt 5] satisfies $i/x lt v]/k").count() == 0
    assert select(tables, "/orders/row[every $i in /items/row[x gt 5] satisfies $i/x lt v]/k").count() == 1
    with pytest.raises(UnsupportedError):
        select(tables, "/orders/row[some $i in /items/row satisfies $i/x != v]/k")
    with pytest.raises(UnsupportedError):
        select(tables, "for $o in /orders/row return if (exists(/items/row[x gt $o/v])) then 1 else ()")
    assert "Python" not in plan_of(select(orders, "format-integer(k, '000')")) and "Arrow" not in plan_of(select(orders, "format-integer(k, '000')"))
