"""Types, constructors and typed values by an XSD."""

import pytest
from arborel.api import Functions, Selector, expression
from arborel.errors import XPathError, XPathNameError, from_spark
from arborel.plans.parser import StaticContext
from arborel.plans.trees import select
from arborel.sources.schema import Schema
from arborel.sources.shred import xml_nodes
from pyspark.sql import functions as F

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:t="http://t" targetNamespace="http://t" elementFormDefault="qualified">
  <xs:simpleType name="size"><xs:restriction base="xs:int"><xs:minInclusive value="1"/><xs:maxInclusive value="50"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="even"><xs:restriction base="t:size"><xs:pattern value="[0-9]*[02468]"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="colour"><xs:restriction base="xs:token"><xs:enumeration value="red"/><xs:enumeration value="blue"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="code"><xs:restriction base="xs:string"><xs:length value="3"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="price"><xs:restriction base="xs:decimal"><xs:totalDigits value="5"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="either"><xs:union memberTypes="t:size t:colour"/></xs:simpleType>
  <xs:element name="things"><xs:complexType><xs:sequence>
    <xs:element ref="t:thing" maxOccurs="unbounded"/>
    <xs:element name="size" type="t:size"/><xs:element name="day" type="xs:date"/>
    <xs:element name="mixed" type="xs:int"/><xs:element name="money"><xs:complexType><xs:simpleContent><xs:extension base="xs:double"><xs:attribute name="unit" type="t:code"/></xs:extension></xs:simpleContent></xs:complexType></xs:element>
  </xs:sequence></xs:complexType></xs:element>
  <xs:element name="thing" type="xs:string"/>
  <xs:element name="tool" type="xs:string" substitutionGroup="t:thing"/>
  <xs:element name="hammer" type="xs:string" substitutionGroup="t:tool"/>
  <xs:complexType name="other"><xs:sequence><xs:element name="mixed" type="xs:string"/></xs:sequence></xs:complexType>
</xs:schema>"""
DOC = '<things xmlns="http://t" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><thing>a</thing><hammer>b</hammer><size>7</size><size>12</size><day>2020-02-29</day><mixed>5</mixed><money unit="EUR">1.5</money><thing xsi:nil="true"/></things>'
STATIC = StaticContext(namespaces=(("t", "http://t"),))


@pytest.fixture(scope="module")
def schema():
    return Schema(XSD)


def test_constructors(spark, schema):
    own = Functions()
    own.schema(schema, "t")
    df = spark.createDataFrame([("x",)], "s string")
    value = lambda text: df.select(expression(df, text, STATIC, own)).first()[0]
    assert value("t:size('7') + 1") == 8 and value("t:even(12)") == 12 and value("t:colour(' red ')") == "red"
    assert value("t:code('abc')") == "abc" and float(value("t:price('123.45')")) == 123.45
    assert value("t:either('blue')") == "blue" and value("t:either(' 9 ')") == "9" and value("empty(t:size(()))")
    for bad in ("t:size(0)", "t:size('x')", "t:even(51)", "t:even(7)", "t:colour('green')", "t:code('abcd')", "t:price('1.234')", "t:price('123456')", "t:either('99')"):
        with pytest.raises(Exception) as problem:
            value(bad)
        assert from_spark(problem.value).code == "FORG0001", bad


def test_types(schema):
    assert {t.name for t in schema.iter_atomic_types()} == {"size", "even", "colour", "code", "price", "either"}
    assert schema.type_of("element", "http://t", "day").base == "date" and schema.type_of("element", "http://t", "money").base == "double"
    assert schema.type_of("attribute", "", "unit").name == "code" and schema.type_of("element", "http://t", "mixed") is None
    assert schema.get_type("even").derives("integer") and not schema.get_type("colour").derives("integer")
    assert schema.substitutes("element", "http://t", "thing") == {("http://t", n) for n in ("thing", "tool", "hammer")}
    with pytest.raises(XPathNameError):
        schema.get_type("none")
    with pytest.raises(XPathError):
        Schema("<a/>")


def test_typed_trees(spark, schema):
    nodes = xml_nodes(spark.createDataFrame([(1, DOC)], "doc_id long, xml string"))
    value = lambda text: [r["value"] for r in select(nodes, text, STATIC, schema).collect()]
    assert value("sum(//t:size[. > 1])") == [19] and value("max(//t:day) + xs:dayTimeDuration('P1D')") == ["2020-03-01"]
    assert value("//t:money * 2") == [3.0] and value("//t:size[2] instance of xs:integer") == [True]
    assert sorted(value("//schema-element(t:thing)")) == ["", "a", "b"]
    assert value("count(//t:thing[nilled(.)])") == [1] and value("count(//t:size[nilled(.)])") == [0]
    with pytest.raises(XPathNameError):
        value("//schema-element(t:size)")
    kinds = {(r["local"], r["xsd_type"]) for r in schema.typed(nodes).where(F.col("xsd_type").isNotNull()).collect()}
    assert kinds == {("thing", "xs:string"), ("hammer", "xs:string"), ("size", "size"), ("day", "xs:date"), ("money", "xs:double"), ("unit", "code")}


def test_schema_tree(spark, schema):
    static = StaticContext(namespaces=(("x", "http://www.w3.org/2001/XMLSchema"),))
    assert sorted(r["value"] for r in select(schema.nodes(spark), "/x:schema/x:element/@name", static).collect()) == ["hammer", "thing", "things", "tool"]


def test_names_and_source():
    chosen = Selector("/a/b[c = 1]/@d | //e[f]")
    assert chosen.leaf_elements() == {"c", "@d", "e", "f"}
    assert Selector(chosen.source).source == chosen.source
