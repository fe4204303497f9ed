"""XML texts as one flat relation of nodes in pre-order.

A node's interval (pre, last_desc] holds its descendants; attributes come right after their element.
Entity declarations and external entities are refused, as they can be used for attacks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import error
from ..runtime import ship

XML = "http://www.w3.org/XML/1998/namespace"
SCHEMA = (
    "doc_id long, pre long, last_desc long, parent_pre long, level int, kind string, ns_uri string, prefix string, local string,"
    " value string, string_value string, sib_ord int, name_ord int, path string, ns_map map<string,string>, base_uri string, lang string, id_value string"
)
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]


#: Places of the columns in a row.
LAST_DESC, STRING_VALUE, PATH, NS_MAP, BASE_URI, LANG, ID_VALUE = (COLUMNS.index(c) for c in ("last_desc", "string_value", "path", "ns_map", "base_uri", "lang", "id_value"))
#: Names of elements and attributes that are kept split.
NAMES = 10_000


@lru_cache(NAMES)
def _split(name: str) -> tuple[str, str, str, str, str]:
    """Namespace, prefix and local part of a name of the parser, and its step in the path of an element (without its position) and of an attribute."""
    parts = name.split("\n")
    ns, local, prefix = ("", parts[0], "") if len(parts) == 1 else (parts[0], parts[1], parts[2] if len(parts) > 2 else "")
    return ns, prefix, local, f"/Q{{{ns}}}{local}[", f"/@{'Q{' + ns + '}' if ns else ''}{local}"


class Shredder:
    """Adds the rows of one document to a list, from parser events; each is a list of values in the order of COLUMNS."""

    def __init__(self, rows: list[list], doc_id: int | None, uri: str | None = None, fragment: bool = False) -> None:
        self.rows, self.first, self.doc_id, self.fragment = rows, len(rows), doc_id, fragment
        self.scopes: list[dict[str, str]] = [{"xml": XML}]
        self.pending: dict[str, str] = {}
        self.text: list[str] = []
        #: All texts so far; for each open node its row, children, children by step and the number of texts before it.
        self.texts: list[str] = []
        document = [doc_id, 0, 0, None, 0, "document", "", "", "", None, None, None, None, "", None, uri, None, None]
        rows.append(document)
        self.stack: list[tuple[list, list[int], dict[str, int], int]] = [(document, [0], {}, 0)]

    def _child(self, kind: str, ns: str, prefix: str, local: str, value: str | None, step: str) -> list:
        parent, children, steps, _ = self.stack[-1]
        children[0] = at = children[0] + 1
        steps[step] = of = steps.get(step, 0) + 1
        pre = len(self.rows) - self.first
        row = [self.doc_id, pre, pre, parent[1], len(self.stack), kind, ns, prefix, local, value, value, at, of, f"{parent[PATH]}{step}{of}]", None, parent[BASE_URI], parent[LANG], None]
        self.rows.append(row)
        return row

    def flush(self) -> None:
        if self.text:
            value = "".join(self.text)
            self.text = []
            if len(self.stack) == 1 and not self.fragment:
                return
            self._child("text", "", "", "", value, "/text()[")
            self.texts.append(value)

    def characters(self, value: str) -> None:
        self.text.append(value)

    def namespace(self, prefix: str | None, uri: str | None) -> None:
        self.pending[prefix or ""] = uri or ""

    def start(self, name: str, attributes: list[str]) -> None:
        if self.text:
            self.flush()
        scope = self.scopes[-1]
        if self.pending:
            scope = {k: v for k, v in (scope | self.pending).items() if v}
            self.pending = {}
        self.scopes.append(scope)
        ns, prefix, local, step, _ = _split(name)
        row = self._child("element", ns, prefix, local, None, step)
        row[NS_MAP] = scope
        self.stack.append((row, [0], {}, len(self.texts)))
        rows, first, doc_id, parent, level = self.rows, self.first, self.doc_id, row[1], len(self.stack)
        for k in range(0, len(attributes), 2):
            value = attributes[k + 1]
            ns, prefix, local, _, step = _split(attributes[k])
            pre = len(rows) - first
            rows.append([doc_id, pre, pre, parent, level, "attribute", ns, prefix, local, value, value, None, None, row[PATH] + step, None, row[BASE_URI], row[LANG], None])
            if ns == XML:
                if local == "lang":
                    row[LANG] = value
                elif local == "base":
                    from urllib.parse import urljoin

                    row[BASE_URI] = urljoin(row[BASE_URI] or "", value)
                elif local == "id":
                    row[ID_VALUE] = value

    def end(self, name: str) -> None:
        if self.text:
            self.flush()
        self.scopes.pop()
        self._close()

    def _close(self) -> None:
        row, _, _, before = self.stack.pop()
        row[LAST_DESC] = len(self.rows) - 1 - self.first
        row[STRING_VALUE] = "".join(self.texts[before:])

    def comment(self, value: str) -> None:
        self.flush()
        self._child("comment", "", "", "", value, "/comment()[")

    def instruction(self, target: str, value: str) -> None:
        self.flush()
        self._child("processing-instruction", "", "", target, value, f"/processing-instruction({target})[")

    def finish(self) -> None:
        self._close()


def shred(xml: str, doc_id: int | None = None, uri: str | None = None, fragment: bool = False) -> list[dict]:
    """The node rows of one text; FODC0006 where it is not well-formed. fragment: any content, under a document node."""
    rows: list[list] = []
    _shred(rows, xml, doc_id, uri, fragment)
    return [dict(zip(COLUMNS, row)) for row in rows]


def _forbid(*_):
    raise error("FODC0006", "entities are not allowed")


def _shred(rows: list[list], xml: str, doc_id: int | None, uri: str | None, fragment: bool) -> None:
    """Adds the rows of one text to a list."""
    out = Shredder(rows, doc_id, uri, fragment)
    parser = expat.ParserCreate(namespace_separator="\n")
    parser.namespace_prefixes = True
    parser.ordered_attributes = True
    parser.buffer_text = True
    depth = 0

    def start(name, attributes):
        nonlocal depth
        depth += 1
        if depth > 1:
            out.start(name, attributes)

    def end(name):
        nonlocal depth
        depth -= 1
        if depth:
            out.end(name)

    parser.StartElementHandler, parser.EndElementHandler = (start, end) if fragment else (out.start, out.end)
    parser.CharacterDataHandler = out.characters
    parser.CommentHandler, parser.ProcessingInstructionHandler = out.comment, out.instruction
    parser.StartNamespaceDeclHandler = out.namespace
    parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = _forbid
    parser.ExternalEntityRefHandler = _forbid
    try:
        parser.Parse(f"<fragment>{xml}</fragment>" if fragment else xml, True)
    except expat.ExpatError as problem:
        raise error("FODC0006", str(problem)) from None
    if fragment:
        out.flush()
    out.finish()


def xml_nodes(docs: DataFrame, column: str = "xml", key: str = "doc_id", uri: str | None = None, invalid: str = "raise", fragment: bool = False) -> DataFrame:
    """The node relation of a column of XML texts. invalid: 'raise' FODC0006 or 'skip' what is not well-formed; nulls have no nodes.

    The texts are dealt out before they are parsed, as a small file of many documents would be parsed by one task.
    """
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("xml"), (F.col(uri) if uri else F.lit(None).cast("string")).alias("uri"))
    if not docs.isStreaming:
        chosen = chosen.repartition(F.xxhash64("doc_id", "xml"))
    ship(docs.sparkSession)
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("pre", pa.int64()), ("last_desc", pa.int64()), ("parent_pre", pa.int64()), ("level", pa.int32()), *((c, pa.string()) for c in COLUMNS[5:11])]
        + [("sib_ord", pa.int32()), ("name_ord", pa.int32()), ("path", pa.string()), ("ns_map", pa.map_(pa.string(), pa.string())), *((c, pa.string()) for c in COLUMNS[15:])]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for doc_id, xml, name in zip(*(c.to_pylist() for c in batch.columns)):
                if xml is None:
                    continue
                before = len(rows)
                try:
                    _shred(rows, xml, doc_id, name, fragment)
                except Exception:
                    if invalid == "raise":
                        raise
                    del rows[before:]
                while len(rows) >= 20_000:
                    yield _batch(rows[:20_000], arrow)
                    rows = rows[20_000:]
            if rows:
                yield _batch(rows, arrow)

    return chosen.mapInArrow(run, SCHEMA)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    values = list(zip(*rows))
    columns = [_maps(v, f.type) if k == NS_MAP else pa.array(v, f.type) for k, (v, f) in enumerate(zip(values, schema))]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _maps(values: tuple[dict | None, ...], kind: pa.DataType) -> pa.Array:
    """An array of maps, of which few are different."""
    places: dict[tuple | None, int] = {}
    at = [places.setdefault(None if v is None else tuple(v.items()), len(places)) for v in values]
    return pa.array([None if v is None else list(v) for v in places], kind).take(pa.array(at, pa.int32()))


def json_to_xml(text: str | None) -> str | None:
    """fn:json-to-xml, as the text of the document."""
    if text is None:
        return None
    from xml.sax.saxutils import escape, quoteattr

    def pairs(found):
        names = [k for k, _ in found]
        if len(set(names)) < len(names):
            raise error("FOJS0003", "duplicate key")
        return dict(found)

    try:
        data = json.loads(text, object_pairs_hook=pairs, parse_float=str, parse_int=str)
    except json.JSONDecodeError as problem:
        raise error("FOJS0001", str(problem)) from None

    def write(x, key=None, top=False, number=False) -> str:
        attrs = (' xmlns="http://www.w3.org/2005/xpath-functions"' if top else "") + (f" key={quoteattr(key)}" if key is not None else "")
        if x is None:
            return f"<null{attrs}/>"
        if isinstance(x, bool):
            return f"<boolean{attrs}>{str(x).lower()}</boolean>"
        if isinstance(x, _Number):
            return f"<number{attrs}>{x}</number>"
        if isinstance(x, str):
            return f"<string{attrs}>{escape(x)}</string>"
        if isinstance(x, list):
            return f"<array{attrs}>{''.join(write(y) for y in x)}</array>"
        return f"<map{attrs}>{''.join(write(v, k) for k, v in x.items())}</map>"

    data = json.loads(text, object_pairs_hook=pairs, parse_float=_Number, parse_int=_Number)
    return write(data, top=True)


class _Number(str):
    """A JSON number by its own digits."""


def xml_to_json(xml: str | None) -> str | None:
    """fn:xml-to-json of a document in the JSON vocabulary."""
    if xml is None:
        return None
    rows = shred(xml)
    children: dict[int, list[dict]] = {}
    for r in rows:
        children.setdefault(r["parent_pre"] if r["parent_pre"] is not None else -1, []).append(r)

    def attribute(row, name):
        return next((a["value"] for a in children.get(row["pre"], ()) if a["kind"] == "attribute" and a["local"] == name), None)

    def write(row) -> str:
        inner = [c for c in children.get(row["pre"], ()) if c["kind"] == "element"]
        text = row["string_value"]
        match row["local"]:
            case "null":
                return "null"
            case "boolean":
                if text.strip() not in ("true", "false", "1", "0"):
                    raise error("FOJS0006", "no boolean")
                return "true" if text.strip() in ("true", "1") else "false"
            case "number":
                value = float(text)
                return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
            case "string":
                return json.dumps(text, ensure_ascii=False).replace("/", "\\/")
            case "array":
                return "[" + ",".join(map(write, inner)) + "]"
            case "map":
                keys = [attribute(c, "key") for c in inner]
                if None in keys or len(set(keys)) < len(keys):
                    raise error("FOJS0006", "keys are missing or repeated")
                return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(c)}" for k, c in zip(keys, inner)) + "}"
        raise error("FOJS0006", f"unexpected element {row['local']}")

    return write(next(c for c in children[0] if c["kind"] == "element"))
