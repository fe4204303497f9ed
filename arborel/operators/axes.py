"""The thirteen axes as joins over the node relation.

Context rows carry `k`, the iteration they belong to, and the node columns; each axis is an equality
on doc_id with an interval or equality on the pre-order numbers, so one partitioning by doc_id serves
all steps of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..plans.ast import Test

NODE = ["doc_id", "pre", "last_desc", "parent_pre", "level", "kind", "ns_uri", "prefix", "local", "value", "string_value", "sib_ord", "path", "ns_map", "base_uri", "lang", "id_value"]
#: No axis of XPath: the attributes of a node and of its descendants, which descendant-or-self::node()/attribute::* reaches.
WITHIN = "attribute-within"
REVERSE = ("parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling")
#: Axes on which different context nodes can reach the same node.
OVERLAPPING = ("descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "following", "following-sibling", "preceding", "preceding-sibling", WITHIN)


def test_of(test: Test, axis: str) -> Column:
    """The node test as a filter on the node columns."""
    kind = F.col("kind")
    if test.kind == "name":
        out = kind == ("attribute" if axis in ("attribute", WITHIN) else "element")
    elif test.kind in ("node", "item"):
        out = F.lit(True)
    elif test.kind == "document-node":
        out = kind == "document"
    elif test.kind == "namespace-node":
        out = kind == "namespace"
    elif test.kind == "schema-element":
        out = kind == "element"
    elif test.kind == "schema-attribute":
        out = kind == "attribute"
    elif test.kind in ("text", "comment", "processing-instruction", "element", "attribute"):
        out = kind == test.kind
    else:
        raise UnsupportedError("XPST0003", f"no filter for {test.kind}()")
    if test.kind != "document-node":
        if test.local is not None:
            out = out & (F.col("local") == test.local)
        if test.ns is not None and test.kind != "processing-instruction":
            out = out & (F.col("ns_uri") == test.ns)
    return out


def condition(axis: str) -> Column:
    """The join condition of an axis, context columns with the prefix c_."""
    n, c = F.col, lambda name: F.col(f"c_{name}")
    same = n("doc_id") == c("doc_id")
    plain = n("kind") != "attribute"
    inside = (n("pre") > c("pre")) & (n("pre") <= c("last_desc"))
    around = (n("pre") < c("pre")) & (n("last_desc") >= c("pre")) & n("kind").isin("element", "document")
    itself = n("pre") == c("pre")
    sibling = (n("parent_pre") == c("parent_pre")) & plain & (c("kind") != "attribute")
    return same & {
        "child": (n("parent_pre") == c("pre")) & plain,
        "descendant": inside & plain,
        "descendant-or-self": itself | (inside & plain),
        "parent": n("pre") == c("parent_pre"),
        "ancestor": around,
        "ancestor-or-self": itself | around,
        "following-sibling": sibling & (n("sib_ord") > c("sib_ord")),
        "preceding-sibling": sibling & (n("sib_ord") < c("sib_ord")),
        "following": (n("pre") > c("last_desc")) & plain,
        "preceding": (n("last_desc") < c("pre")) & plain,
        "self": itself,
        "attribute": (n("parent_pre") == c("pre")) & (n("kind") == "attribute"),
        WITHIN: inside & (n("kind") == "attribute"),
    }[axis]


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join with nodes that is never a broadcast: from the size of the texts Spark takes their nodes for few."""
    return left.join(right.hint("merge"), on, how)


#: What each of these axes reaches from the document node, whose pre is 0: that needs no join.
FROM_ROOT = {
    "child": "parent_pre = 0 and kind <> 'attribute'", "descendant": "kind not in ('attribute', 'document')", "descendant-or-self": "kind <> 'attribute'",
    "attribute": "false", WITHIN: "kind = 'attribute'", "self": "kind = 'document'",
}


def root_step(nodes: DataFrame, axis: str, test: Test) -> DataFrame:
    """Rows (k, c_pre, node columns) of a step along one of FROM_ROOT from the document nodes of all documents; k is the doc_id."""
    found = nodes.where(F.col("doc_id").isNotNull() & F.expr(FROM_ROOT[axis]) & test_of(test, axis))
    return found.select(F.col("doc_id").alias("k"), F.lit(0).cast("long").alias("c_pre"), *NODE)


#: The context nodes of these axes that alone matter where no predicate asks for the others: columns besides k and doc_id, and their bounds.
BOUNDS = {
    "following": ([], {"last_desc": F.min}), "preceding": ([], {"pre": F.max}),
    "following-sibling": (["parent_pre", "kind"], {"sib_ord": F.min}), "preceding-sibling": (["parent_pre", "kind"], {"sib_ord": F.max}),
}


def bounded_step(context: DataFrame, nodes: DataFrame, axis: str, test: Test) -> DataFrame:
    """Rows (k, node columns), each once, of a step along one of BOUNDS: the outermost context node of a document, or of siblings, reaches all."""
    by, bounds = BOUNDS[axis]
    if "kind" in by:
        context = context.where("kind <> 'attribute'").withColumn("kind", F.lit("element"))
    least = context.groupBy("k", "doc_id", *by).agg(*[f(c).alias(f"c_{c}") for c, f in bounds.items()])
    left = least.select("k", *[F.col(c).alias(f"c_{c}") for c in ("doc_id", *by)], *[f"c_{c}" for c in bounds])
    return joined(left, nodes.where(test_of(test, axis)).select(*NODE), condition(axis)).select("k", *NODE)


def step(context: DataFrame, nodes: DataFrame, axis: str, test: Test) -> DataFrame:
    """Rows (k, c_pre, node columns) of one axis step, not yet free of duplicates."""
    if axis == "namespace":
        found = context.where("kind = 'element'").select("k", F.col("pre").alias("c_pre"), "*", F.explode("ns_map").alias("ns_prefix", "ns_value"))
        if test.local is not None:
            found = found.where(F.col("ns_prefix") == test.local)
        renamed = {"kind": F.lit("namespace"), "local": F.col("ns_prefix"), "value": F.col("ns_value"), "string_value": F.col("ns_value"), "ns_uri": F.lit(""), "prefix": F.lit("")}
        return found.select("k", "c_pre", *[renamed.get(c, F.col(c)).alias(c) for c in NODE])
    if axis == "self":
        return context.where(test_of(test, axis)).withColumn("c_pre", F.col("pre")).select("k", "c_pre", *NODE)
    needed = ["doc_id", "pre", "last_desc", "parent_pre", "kind", "sib_ord"]
    left = context.select("k", *[F.col(c).alias(f"c_{c}") for c in needed])
    return joined(left, nodes.where(test_of(test, axis)).select(*NODE), condition(axis)).select("k", "c_pre", *NODE)
