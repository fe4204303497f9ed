"""XSD schemas: types of elements and attributes, constructors of simple types, and the schema as a tree.

Types are known before any data. A path whose last step names an element or attribute that has one
type throughout the schema gives values of that type; other paths stay untyped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import error
from ..functions import regex
from ..functions.library import one
from ..functions.values import ATOMIC, SPARK, Val, base_of, cast_to, raise_, to_string
from ..plans.operators import compare
from ..plans.parser import StaticContext
from .shred import SCHEMA, shred

XS = "http://www.w3.org/2001/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
ORDERED = {"minInclusive": "ge", "maxInclusive": "le", "minExclusive": "gt", "maxExclusive": "lt"}
SIZES = {"length": lambda n, k: n == k, "minLength": lambda n, k: n >= k, "maxLength": lambda n, k: n <= k}


@dataclass(frozen=True)
class Simple:
    """A simple type: the built-in type that holds its values, and what it asks of them. members: those of a union."""

    name: str
    base: str
    facets: tuple[tuple[str, str], ...] = ()
    members: tuple[Simple, ...] = ()

    def cast(self, v: Val, strict: bool = True) -> Val:
        """One item as a value of this type; where it is none FORG0001, or null if not strict."""
        v = one(v)
        if self.members:
            found = F.coalesce(*[to_string(m.cast(v, False)) for m in self.members])
            return Val(self._checked(v.col, found.isNotNull(), found, "string", strict), "string")
        out = cast_to(v, self.base, strict)
        if not self.facets or v.type == "empty":
            return out
        return out.with_col(self._checked(out.col, self._holds(out), out.col, SPARK[out.type], strict))

    def _checked(self, given: Column, good: Column, value: Column, spark: str, strict: bool) -> Column:
        bad = raise_("FORG0001", f"not a value of {self.name}", spark) if strict else F.lit(None).cast(spark)
        return F.when(given.isNull(), F.lit(None).cast(spark)).when(good, value).otherwise(bad)

    def _holds(self, v: Val) -> Column:
        text, good = to_string(v), F.lit(True)
        same: list[Column] = []
        patterns: list[Column] = []
        for kind, value in self.facets:
            if kind == "enumeration":
                same.append(compare("eq", v, cast_to(Val(F.lit(value), "string"), self.base), StaticContext()))
            elif kind == "pattern":
                patterns.append(text.rlike(f"^(?:{regex.translate(value)})$"))
            elif kind in ORDERED:
                good = good & compare(ORDERED[kind], v, cast_to(Val(F.lit(value), "string"), self.base), StaticContext())
            elif kind in SIZES:
                good = good & SIZES[kind](F.length(text), int(value))
            elif kind == "totalDigits":
                good = good & (F.length(F.regexp_replace(F.regexp_replace(text, r"^[-+]?0*", ""), r"[^0-9]", "")) <= int(value))
            elif kind == "fractionDigits":
                good = good & (F.length(F.regexp_extract(text, r"\.([0-9]*)$", 1)) <= int(value))
        for some in (same, patterns):
            if some:
                any_of = some[0]
                for c in some[1:]:
                    any_of = any_of | c
                good = good & any_of
        return good

    def derives(self, name: str) -> bool:
        """Whether values of this type are values of a built-in type."""
        return name in (self.base, base_of(self.base), "anyAtomicType", "anySimpleType")


class Schema:
    """The declarations of one schema document."""

    def __init__(self, text: str) -> None:
        self.rows = shred(text)
        self.children: dict[int, list[dict]] = {}
        self.attributes_of: dict[int, dict[str, str]] = {}
        for r in self.rows:
            if r["kind"] == "element":
                self.children.setdefault(r["parent_pre"], []).append(r)
            elif r["kind"] == "attribute" and not r["ns_uri"]:
                self.attributes_of.setdefault(r["parent_pre"], {})[r["local"]] = r["value"]
        root = next(r for r in self.rows if r["kind"] == "element")
        if (root["ns_uri"], root["local"]) != (XS, "schema"):
            raise error("XPST0003", "no XSD schema")
        own = self.attributes_of.get(root["pre"], {})
        self.target, self.root = own.get("targetNamespace", ""), root["pre"]
        self.named = {self.attributes_of[r["pre"]]["name"]: r for r in self._below(root) if r["parent_pre"] == self.root and r["local"] in ("simpleType", "complexType")}
        self.types: dict[tuple[str, str, str], set[Simple | None]] = {}
        self.globals: set[tuple[str, str, str]] = set()
        self.heads: dict[tuple[str, str], set[tuple[str, str]]] = {}
        for r in self._below(root):
            a = self.attributes_of.get(r["pre"], {})
            if r["local"] not in ("element", "attribute") or "name" not in a:
                continue
            is_global = r["parent_pre"] == self.root
            form = a.get("form", own.get(f"{r['local']}FormDefault", "unqualified"))
            key = (r["local"], self.target if is_global or form == "qualified" else "", a["name"])
            self.types.setdefault(key, set()).add(self._type_of(r))
            if is_global:
                self.globals.add(key)
            if "substitutionGroup" in a:
                self.heads.setdefault(self._name(r, a["substitutionGroup"]), set()).add(key[1:])

    # reading

    def _below(self, row: dict) -> Iterator[dict]:
        yield row
        for c in self.children.get(row["pre"], ()):
            yield from self._below(c)

    def _name(self, row: dict, qname: str) -> tuple[str, str]:
        prefix, _, local = qname.rpartition(":")
        if prefix and prefix not in row["ns_map"]:
            raise error("XPST0081", f"prefix {prefix!r} is not bound")
        return row["ns_map"].get(prefix, ""), local

    def _resolved(self, row: dict, qname: str) -> Simple | None:
        ns, local = self._name(row, qname)
        if ns == XS:
            return Simple(f"xs:{local}", local) if local in ATOMIC else Simple("xs:string", "string") if local in ("anySimpleType", "anyAtomicType") else None
        if ns != self.target or local not in self.named:
            raise error("XPST0051", f"unknown type {qname}")
        found = self.named[local]
        out = self._simple(found) if found["local"] == "simpleType" else self._content(found)
        return replace(out, name=local) if out is not None else None

    def _simple(self, row: dict) -> Simple | None:
        """The type of a simpleType element; a list has no single value and gives None."""
        for c in self.children.get(row["pre"], ()):
            a = self.attributes_of.get(c["pre"], {})
            if c["local"] == "restriction":
                inner = [x for x in self.children.get(c["pre"], ()) if x["local"] == "simpleType"]
                base = self._resolved(c, a["base"]) if "base" in a else self._simple(inner[0])
                facets = [(x["local"], self.attributes_of[x["pre"]]["value"]) for x in self.children.get(c["pre"], ()) if "value" in self.attributes_of.get(x["pre"], {})]
                return None if base is None else replace(base, facets=(*base.facets, *facets))
            if c["local"] == "union":
                named = [self._resolved(c, n) for n in a.get("memberTypes", "").split()]
                own = [self._simple(x) for x in self.children.get(c["pre"], ()) if x["local"] == "simpleType"]
                return Simple("union", "string", members=tuple(m for m in (*named, *own) if m is not None))
        return None

    def _content(self, row: dict) -> Simple | None:
        """The type of the text of a complexType with simple content, else None."""
        for c in self.children.get(row["pre"], ()):
            if c["local"] == "simpleContent":
                for x in self.children.get(c["pre"], ()):
                    return self._resolved(x, self.attributes_of[x["pre"]]["base"])
        return None

    def _type_of(self, row: dict) -> Simple | None:
        a = self.attributes_of.get(row["pre"], {})
        if "type" in a:
            return self._resolved(row, a["type"])
        for c in self.children.get(row["pre"], ()):
            if c["local"] in ("simpleType", "complexType"):
                return self._simple(c) if c["local"] == "simpleType" else self._content(c)
        return None

    # use

    def get_type(self, name: str) -> Simple:
        """A simple type of the schema by its local name, or a built-in one as xs:name."""
        if name.startswith("xs:"):
            return Simple(name, name[3:])
        out = self._simple(self.named[name]) if name in self.named and self.named[name]["local"] == "simpleType" else None
        if out is None:
            raise error("XPST0051", f"unknown type {name}")
        return replace(out, name=name)

    def iter_atomic_types(self) -> Iterator[Simple]:
        for name, row in self.named.items():
            if row["local"] == "simpleType" and self._simple(row) is not None:
                yield self.get_type(name)

    def type_of(self, kind: str, ns: str, local: str) -> Simple | None:
        """The one simple type of all elements or attributes of a name, or None."""
        found = self.types.get((kind, ns, local), set())
        return next(iter(found)) if len(found) == 1 else None

    def substitutes(self, kind: str, ns: str, local: str) -> set[tuple[str, str]]:
        """The names that a global declaration stands for: its own and those of its substitution group."""
        if (kind, ns, local) not in self.globals:
            raise error("XPST0008", f"no global {kind} {local} in the schema")
        out, todo = set(), [(ns, local)]
        while todo:
            name = todo.pop()
            if name not in out:
                out.add(name)
                todo += self.heads.get(name, ()) if kind == "element" else ()
        return out

    def is_instance(self, v: Val, name: str) -> Column:
        return self.get_type(name).cast(v, False).col.isNotNull()

    def cast_as(self, v: Val, name: str) -> Val:
        return self.get_type(name).cast(v)

    def constructors(self, prefix: str) -> dict[tuple[str, int], object]:
        """A function for each simple type of the schema, to be given to the compiler."""
        return {(f"{prefix}:{t.name}", 1): t.cast for t in self.iter_atomic_types()}

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The schema document itself as a node relation; it is as small as its text."""
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(0 if n == "doc_id" else r[n] for n in names) for r in self.rows], SCHEMA)

    def typed(self, nodes: DataFrame) -> DataFrame:
        """Adds xsd_type to a node relation: the name of the type of each element and attribute that has one."""
        flat = [x for (kind, ns, local), found in self.types.items() for t in [next(iter(found)) if len(found) == 1 else None] if t is not None for x in (F.lit(f"{kind} {ns} {local}"), F.lit(t.name))]
        known = F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
        return nodes.withColumn("xsd_type", F.try_element_at(known, F.concat_ws(" ", "kind", "ns_uri", "local")))
