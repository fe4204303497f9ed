import random

import pytest
from arborel import queries
from arborel.errors import XPathError
from arborel.plans.trees import select
from arborel.sources.shred import json_to_xml, shred, xml_nodes, xml_to_json

DOCS = [
    (1, '<A><B1><C1 a="1"/><C2/><C3/></B1><B2 xml:id="x"><C1/><C2/><C3>t</C3><C4/></B2><!--c--><?pi d?></A>'),
    (2, '<r xmlns:p="http://p" xml:lang="en-US"><p:v>3</p:v><v>20</v><v>4.5</v></r>'),
    (3, None),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return xml_nodes(spark.createDataFrame(DOCS, "doc_id long, xml string")).cache()


CASES = {
    "/A/B2/C3/preceding-sibling::*": [(1, 9), (1, 10)],
    "//C3/ancestor::*": [(1, 1), (1, 2), (1, 7)],
    "//C2/following::*": [(1, 6), (1, 7), (1, 9), (1, 10), (1, 11), (1, 13)],
    "//C4/preceding::C1": [(1, 3), (1, 9)],
    "//@a": [(1, 4)],
    "/A/*[2]/*[last()]": [(1, 13)],
    "//B2/* except //C4": [(1, 9), (1, 10), (1, 11)],
    "id('x')": [(1, 7)],
    "//comment() | //processing-instruction()": [(1, 14), (1, 15)],
    "//C3[text()='t']/..": [(1, 7)],
    "outermost(//*)": [(1, 1), (2, 1)],
    "//*:v": [(2, 3), (2, 5), (2, 7)],
    "//v[. > 10]": [(2, 5)],
    "//v[lang('en')]": [(2, 5), (2, 7)],
    "//C2/preceding-sibling::*[1]": [(1, 3), (1, 9)],
    "//C4[preceding-sibling::C1 << .]": [(1, 13)],
}


@pytest.mark.parametrize("text", CASES)
def test_nodes(nodes, text):
    assert sorted((r["doc_id"], r["pre"]) for r in select(nodes, text).collect()) == CASES[text]


@pytest.mark.parametrize("text,want", [("count(//*)", {1: 10, 2: 4}), ("sum(//v)", {1: 0.0, 2: 24.5}), ("exists(//C4)", {1: True, 2: False}), ("string(/r)", {1: None, 2: "3204.5"})])
def test_values(nodes, text, want):
    assert {r["doc_id"]: r["value"] for r in select(nodes, text).collect()} == want


def test_for_and_names(nodes):
    got = select(nodes, "for $x in //B2/* return name($x)").collect()
    assert sorted(r["value"] for r in got) == ["C1", "C2", "C3", "C4"]
    assert sorted(r["value"] for r in select(nodes, "/r/*/name()").collect()) == ["p:v", "v", "v"]


def test_documents_by_uri(spark):
    docs = spark.createDataFrame([(1, "<a><b/></a>", "http://x/1"), (2, '<a xmlns:q="u"><b/><b/></a>', "http://x/2")], "doc_id long, xml string, uri string")
    nodes = xml_nodes(docs, uri="uri").cache()
    assert select(nodes, "doc('http://x/2')//b").count() == 2
    assert select(nodes, "collection('http://x/')//b").count() == 3
    assert [r["value"] for r in select(nodes, "for $e in /a return base-uri($e)").orderBy("doc_id").collect()] == ["http://x/1", "http://x/2"]
    assert [r["value"] for r in select(nodes, "for $e in /a return namespace-uri-for-prefix('q', .)").orderBy("doc_id").collect()] == [None, "u"]
    assert {r["value"] for r in select(nodes, "doc-available('http://x/3')").collect()} == {False}


def test_entities_are_refused():
    for text in ('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><a>&x;</a>', "<a>", ""):
        with pytest.raises(XPathError) as problem:
            shred(text)
        assert problem.value.code == "FODC0006"


def test_fragment():
    rows = shred("a<b/>c", fragment=True)
    assert [(r["kind"], r["local"], r["value"]) for r in rows] == [("document", "", None), ("text", "", "a"), ("element", "b", None), ("text", "", "c")]
    assert rows[0]["string_value"] == "ac" and rows[0]["last_desc"] == 3


def test_json_and_xml():
    text = '{"a":1.5,"b":[true,null,"x<"]}'
    assert xml_to_json(json_to_xml(text)) == text


def random_tree(rng, depth=4):
    name = rng.choice("abc")
    inner = "".join(random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
    attrs = f' k="{rng.randint(0, 2)}"' if rng.random() < 0.5 else ""
    return f"<{name}{attrs}>{inner}{rng.choice(['', 't'])}</{name}>"


def test_axes_against_tree_walking(spark):
    """Each axis from all elements of random trees, by the rows' parents alone."""
    rng = random.Random(5)
    docs = [(k, random_tree(rng)) for k in range(12)]
    nodes = xml_nodes(spark.createDataFrame(docs, "doc_id long, xml string")).cache()
    want = {a: set() for a in ("child", "descendant", "ancestor", "following", "preceding", "following-sibling", "preceding-sibling")}
    for k, xml in docs:
        rows = [r for r in shred(xml, k) if r["kind"] in ("element", "document")]
        parent = {r["pre"]: r["parent_pre"] for r in rows}

        def above(p, parent=parent):
            out = []
            while parent[p] is not None:
                p = parent[p]
                out.append(p)
            return out

        found = [r["pre"] for r in rows if r["local"] == "a" and r["kind"] == "element"]
        for c in found:
            for n in (r["pre"] for r in rows if r["kind"] == "element"):
                for axis, is_in in (
                    ("child", parent[n] == c), ("descendant", c in above(n)), ("ancestor", n in above(c)),
                    ("following", n > c and c not in above(n)), ("preceding", n < c and n not in above(c)),
                    ("following-sibling", parent[n] == parent[c] and n > c), ("preceding-sibling", parent[n] == parent[c] and n < c),
                ):
                    if is_in:
                        want[axis].add((k, n))
    for axis, expected in want.items():
        assert {(r["doc_id"], r["pre"]) for r in select(nodes, f"//a/{axis}::*").collect()} == expected, axis


SF = "/root/testdata/sf0.001"
TREES = [q for q in queries.queries() if q.startswith(("xp_tree_", "xp_schema_", "xp_parse_xml")) and q not in ("xp_tree_count", "xp_schema_constructor")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", TREES)
def test_nodes_are_not_sent_to_the_driver(spark, name):
    assert "Broadcast" not in plan(queries.queries()[name](spark, SF))


def test_texts_of_one_file_are_parsed_by_many_tasks(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert queries.customer_documents(spark, SF).selectExpr("spark_partition_id() as p").distinct().count() == 4
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize(
    "name,shredded",
    [("xp_tree_local_name", 1), ("xp_schema_element", 1), ("xp_tree_attributes", 1), ("xp_tree_name", 1), ("xp_tree_text", 1), ("xp_tree_braced", 2), ("xp_tree_base_uri", 2), ("xp_tree_before", 2), ("xp_tree_sum", 3), ("xp_tree_quantified", 3), ("xp_tree_is", 3)],
)
def test_steps_from_the_root_are_filters(spark, name, shredded):
    """How often the texts are parsed, where no exchange is reused: once for each path from the root, and for each further step of it."""
    assert plan(queries.queries()[name](spark, SF)).count("MapInArrow") == shredded


@pytest.mark.parametrize("text,want", [("//B2//@*", [(1, 8)]), ("//*//@*", [(1, 4), (1, 8), (2, 2)]), ("//B1//@a", [(1, 4)]), ("//@*[. = 'x']", [(1, 8)]), ("//@a//@*", []), ("/*//@*[1]", [(1, 4), (1, 8), (2, 2)]), ("/descendant::C1[2]", [(1, 9)]), ("/*[2] | /r", [(2, 1)]), ("//C1[count(//C1) = 2]", [(1, 3), (1, 9)])])
def test_paths_from_the_root(nodes, text, want):
    assert sorted((r["doc_id"], r["pre"]) for r in select(nodes, text).collect()) == want
