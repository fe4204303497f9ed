"""fn:parse-xml and fn:parse-xml-fragment inside an expression over rows.

A path that begins with one of them is answered by the tree lane for the distinct texts, and its
values come back to the rows as an array column, which the rest of the expression uses.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, of_type, to_string
from ..operators.axes import joined
from ..sources.shred import xml_nodes
from .ast import Ex
from .parser import StaticContext
from .row import RowCompiler
from .trees import Trees

PARSERS = ("parse-xml", "parse-xml-fragment")


def _begins(e: Ex) -> Ex | None:
    """The call that an expression begins with, if that is of a parser."""
    head = e.args[0] if e.op == "path" and e.val == "" and e.args else e
    return head if head.op == "call" and head.val in PARSERS else None


def resolved(df: DataFrame, e: Ex, static: StaticContext, compiler: RowCompiler) -> tuple[DataFrame, Ex, dict[str, Val]]:
    """The rows with a column for each path into a parsed text, the expression with variables in their place, and these.

    A null text has no document and gives the empty sequence; one that is not well-formed raises
    FODC0006. Texts are told by a 64-bit hash, so rows of equal texts are parsed once.
    """
    found: dict[str, Val] = {}

    def walk(x: Ex) -> Ex:
        nonlocal df
        head = _begins(x)
        if head is None:
            return replace(x, args=tuple(walk(a) for a in x.args))
        stem = f"_{len(found)}"
        while any(c.startswith(stem) for c in df.columns):
            stem += "_"
        xml, key, name = f"{stem}xml", f"{stem}key", f"{stem}found"
        df = df.withColumn(xml, to_string(compiler(head.args[0]))).withColumn(key, F.xxhash64(xml))
        texts = df.where(F.col(xml).isNotNull()).select(F.col(key).alias("doc_id"), F.col(xml).alias("xml")).dropDuplicates(["doc_id"])
        nodes = xml_nodes(texts, fragment=head.val == "parse-xml-fragment")
        rest = x.args[1:] if x.op == "path" else ()
        out = Trees(nodes, static).compile(Ex("path", "/", rest) if rest else Ex("call", "string", (Ex("path", "/"),)))
        order = next((c for c in ("pre", "of", "at") if c in out.columns), "value")
        kind = of_type(out.schema["value"].dataType, F.col("value")).type
        values = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("value").alias("v")))), lambda s: s["v"])
        grouped = out.groupBy("doc_id").agg(values.alias(name)).withColumnRenamed("doc_id", f"{key}_")
        df = joined(df, grouped, F.col(key) == F.col(f"{key}_"), "left").drop(f"{key}_", xml, key)
        found[name] = Val(F.coalesce(F.col(name), F.array()), "untypedAtomic" if kind == "string" else kind, True)
        return Ex("var", name)

    e = walk(e)
    return df, e, found
