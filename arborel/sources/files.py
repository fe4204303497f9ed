"""Documents, collections, text resources and folders as relations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import error
from ..runtime import ship
from .shred import xml_nodes


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """fn:unparsed-text of all files under the paths: (uri, text), one row for a file."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("uri"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """fn:unparsed-text-lines: (uri, line_number, line), by any of the three line ends."""
    lines = F.split("text", r"\r\n|\r|\n", -1)
    whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return texts(spark, *paths).select("uri", F.posexplode(whole).alias("line_number", "line")).withColumn("line_number", F.col("line_number") + 1)


def text_available(spark: SparkSession, path: str) -> bool:
    """fn:unparsed-text-available of one path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """fn:doc and fn:collection: the node relation of XML files; doc_id is a hash of the uri, the uri is the base-uri of each node."""
    files = texts(spark, *paths).select(F.xxhash64("uri").alias("doc_id"), "uri", F.col("text").alias("xml"))
    return xml_nodes(files, uri="uri")


def document(nodes: DataFrame, uri: str) -> DataFrame:
    """The nodes of one document of a collection, by its uri."""
    return nodes.join(nodes.where((F.col("kind") == "document") & (F.col("base_uri") == uri)).select("doc_id"), "doc_id", "left_semi")


def json_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """fn:json-doc: (uri, json) with JSON values as VARIANT; FOJS0001 where a file is no JSON."""
    parsed = F.try_parse_json("text")
    bad = F.raise_error(F.lit("[err:FOJS0001] invalid JSON")).cast("variant")
    return texts(spark, *paths).select("uri", F.when(parsed.isNull(), bad).otherwise(parsed).alias("json"))


def folder_rows(spark: SparkSession, path: str) -> DataFrame:
    """A folder's files as (path, name, size, modified), without reading them; to be queried as a virtual document."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name: Column = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def serialize(nodes: DataFrame, method: str = "xml") -> DataFrame:
    """fn:serialize of whole documents: (doc_id, text). Each document is written by one task from its rows in order."""
    if method not in ("xml", "text", "html"):
        raise error("SEPM0016", f"unknown method {method}")
    if method == "text":
        return nodes.where("kind = 'document'").select("doc_id", F.col("string_value").alias("text"))
    ship(nodes.sparkSession)
    # few scopes are different: as texts, they are read once
    needed = nodes.select("doc_id", "pre", "last_desc", "kind", "prefix", "local", "value", F.to_json("ns_map").alias("ns_map"))
    ordered = needed.repartition("doc_id").sortWithinPartitions("doc_id", "pre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out.append((held[0][0], _write(held, method)))
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], names=["doc_id", "text"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([_write(held, method)], pa.string())], names=["doc_id", "text"])

    return ordered.mapInArrow(run, "doc_id long, text string")


# HTML elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@lru_cache(10_000)
def _declared(own: str, outer: str) -> str:
    """The declarations of the namespaces that a scope does not share with the outer one; both as JSON."""
    outer_, new = json.loads(outer), json.loads(own)
    return "".join(f" xmlns{':' + k if k else ''}={quoteattr(v)}" for k, v in sorted(new.items()) if k != "xml" and outer_.get(k) != v)


def _write(rows: list[tuple], method: str) -> str:
    """The text of one document from its nodes in order: doc_id, pre, last_desc, kind, prefix, local, value, ns_map as JSON."""
    out: list[str] = []
    open_: list[tuple[int, str]] = []
    scopes = ["{}"]
    pending = ""

    def close(before: int) -> None:
        nonlocal pending
        while open_ and open_[-1][0] < before:
            _, tag = open_.pop()
            scopes.pop()
            if pending:
                out.append((">" if tag.lower() in VOID else f"></{tag}>") if method == "html" else "/>")
                pending = ""
            elif not (method == "html" and tag.lower() in VOID):
                out.append(f"</{tag}>")

    for _, pre, last_desc, kind, prefix, local, value, ns_map in rows:
        if open_ and open_[-1][0] < pre:
            close(pre)
        if kind == "attribute":
            out.append(f" {prefix + ':' if prefix else ''}{local}={quoteattr(value)}")
            continue
        if pending and kind != "document":
            out.append(pending)
            pending = ""
        if kind == "element":
            tag = f"{prefix}:{local}" if prefix else local
            own = ns_map or "{}"
            out.append(f"<{tag}" if own == scopes[-1] else f"<{tag}{_declared(own, scopes[-1])}")
            pending = ">"
            open_.append((last_desc, tag))
            scopes.append(own)
        elif kind == "text":
            out.append(escape(value))
        elif kind == "comment":
            out.append(f"<!--{value}-->")
        elif kind == "processing-instruction":
            out.append(f"<?{local} {value}?>")
    close(1 << 62)
    return "".join(out)
