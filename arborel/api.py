"""Entry points: one-shot and compiled queries over columns, tables and trees."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from .errors import error, from_spark
from .functions.library import literal
from .functions.values import SPARK, Val, cast_to, full_type, items, of_type, single, to_string
from .plans.ast import Ex, to_xpath
from .plans.documents import resolved
from .plans.parser import StaticContext, parse
from .plans.row import RowCompiler, output
from .plans.tables import Tables
from .plans.trees import Trees

#: A static context for each language version.
VERSIONS = {v: StaticContext(version=v) for v in ("1.0", "2.0", "3.0", "3.1")}


@dataclass
class Functions:
    """Functions of the caller, by name and arity: built from typed values, or Spark UDFs with declared types."""

    known: dict[tuple[str, int], Callable[..., Val]] = field(default_factory=dict)

    def register(self, name: str, build: Callable[..., Val], arity: int | None = None) -> None:
        """A function whose body makes a column expression from its arguments."""
        self.known[name, arity if arity is not None else len(inspect.signature(build).parameters)] = build

    def schema(self, schema, prefix: str) -> None:
        """The constructors of the simple types of a schema, as functions under a prefix."""
        self.known.update(schema.constructors(prefix))

    def external(self, name: str, call: Callable, arguments: tuple[str, ...], result: str) -> None:
        """A Python callable as a vectorised UDF; types are names such as xs:integer, with ? where () is allowed."""
        kinds = [a.removeprefix("xs:").rstrip("?") for a in arguments]
        out = result.removeprefix("xs:").rstrip("?")
        if any(k not in SPARK for k in (*kinds, out)):
            raise error("XPST0051", "unknown type")
        if len(kinds) != len(inspect.signature(call).parameters):
            raise error("XPST0017", f"{name} takes another number of arguments")
        udf = F.udf(call, SPARK[out], useArrow=True)

        def build(*values: Val) -> Val:
            columns = []
            for v, k, a in zip(values, kinds, arguments):
                c = cast_to(single(v), k).col
                columns.append(c if a.endswith("?") else F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"[err:XPDY0050] {name} needs {a}")).cast(SPARK[k])))
            return Val(udf(*columns), out)

        self.known[name, len(kinds)] = build


def expression(df: DataFrame, text: str, static: StaticContext | None = None, functions: Functions | None = None, **variables: Column) -> Column:
    """An expression over the columns of a DataFrame as one Column."""
    columns = {f.name: of_type(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields}
    bound = {n: v if isinstance(v, Val) else of_type(df.select(v.alias("v")).schema[0].dataType, v) for n, v in variables.items()}
    compiler = RowCompiler(static or StaticContext(), columns=columns, variables=bound, functions=functions.known if functions else {})
    return output(compiler(parse(text, compiler.static)), "value")


@dataclass
class Selector:
    """An expression compiled once, for any number of inputs."""

    text: str
    static: StaticContext = field(default_factory=StaticContext)
    tree: Ex = field(init=False)

    def __post_init__(self) -> None:
        self.tree = parse(self.text, self.static)

    def over_rows(self, df: DataFrame, functions: Functions | None = None) -> DataFrame:
        """Adds `value` to each row; works on streams too, but for paths into texts that the expression parses."""
        columns = {f.name: of_type(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields}
        compiler = RowCompiler(self.static, columns=columns, functions=functions.known if functions else {})
        wide, e, found = resolved(df, self.tree, self.static, compiler)
        value = output(replace(compiler, variables=found)(e), "value")
        return wide.withColumn("value", value).drop(*found) if found else df.withColumn("value", value)

    def over_tables(self, frames: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
        return Tables(frames, keys or {}, self.static).compile(self.tree)

    def over_trees(self, nodes: DataFrame, schema=None, **variables: Val) -> DataFrame:
        return Trees(nodes, self.static, variables, schema).select(self.text)

    @property
    def source(self) -> str:
        """The expression written again from its tree."""
        return to_xpath(self.tree)

    def leaf_elements(self) -> set[str]:
        """The names of elements and attributes at which paths of the expression end."""
        out = set()
        inner = {id(a) for e in self.tree.walk() if e.op == "path" for a in e.args[:-1]}
        for e in self.tree.walk():
            if e.op == "step" and id(e) not in inner and e.val[1].local is not None:
                out.add(("@" if e.val[0] == "attribute" else "") + e.val[1].local)
        return out


def select(source: DataFrame | dict[str, DataFrame], text: str, static: StaticContext | None = None) -> DataFrame:
    """Runs an expression on tables (a dict), on a node relation (it has `pre`), or on rows."""
    selector = Selector(text, static or StaticContext())
    if isinstance(source, dict):
        return selector.over_tables(source)
    return selector.over_trees(source) if "pre" in source.columns else selector.over_rows(source)


def iter_select(source: DataFrame | dict[str, DataFrame], text: str, static: StaticContext | None = None) -> Iterator[Row]:
    """The result rows one partition at a time; Spark's errors come as those of the language."""
    try:
        yield from select(source, text, static).toLocalIterator()
    except Exception as problem:
        told = from_spark(problem)
        if told is None:
            raise
        raise told from problem


__all__ = ["VERSIONS", "Functions", "Selector", "StaticContext", "expression", "full_type", "items", "iter_select", "literal", "select", "to_string"]
