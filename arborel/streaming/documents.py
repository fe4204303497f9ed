"""Expressions on streams: each row or document is a query of its own, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..api import Functions, Selector
from ..plans.parser import StaticContext
from ..sources.shred import xml_nodes


def select_rows(stream: DataFrame, text: str, static: StaticContext | None = None, functions: Functions | None = None) -> DataFrame:
    """The stream with the value of a row-local expression; no micro-batch needs another."""
    return Selector(text, static or StaticContext()).over_rows(stream, functions)


def select_documents(stream: DataFrame, text: str, sink: Callable[[DataFrame, int], None], column: str = "xml", key: str = "doc_id", static: StaticContext | None = None, invalid: str = "skip") -> DataStreamWriter:
    """A writer that evaluates an expression on the XML documents of each micro-batch and hands the result to the sink."""
    selector = Selector(text, static or StaticContext())

    def batch(docs: DataFrame, number: int) -> None:
        sink(selector.over_trees(xml_nodes(docs, column, key, invalid=invalid)), number)

    return stream.writeStream.foreachBatch(batch)
