"""SELECT: a typed logical query becomes one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt import types as ty
from veldt.errors import ExecError, PlanError, unsupported
from veldt.functions import typed as fn
from veldt.functions.typed import Mode, Typed
from veldt.sql import nodes as n
from veldt.sql.parser import FUNCTIONS

#: The hidden column of managed tables: a row's position.
POS = "_pos"


@dataclass
class Relation:
    """A table as the engine sees it: types by column name, in order; other columns of df are carried but have no name."""

    name: str
    df: DataFrame
    kinds: dict[str, str]
    not_null: frozenset[str] = frozenset()


@dataclass
class Source:
    relation: Relation
    alias: str | None
    mark: str  # in front of this side's columns
    df: DataFrame = field(init=False)

    def __post_init__(self):
        keep = [c for c in (*self.relation.kinds, POS) if c in self.relation.df.columns]
        self.df = self.relation.df.select(*[F.col(f"`{c}`").alias(self.mark + c) for c in keep])

    def answers(self, table: str) -> bool:
        return table in (self.relation.name, self.alias)

    def column(self, name: str) -> Typed:
        mine = self.mark + name
        kind = self.relation.kinds[name]
        local = kind == ty.TIMESTAMP and isinstance(self.df.schema[mine].dataType, T.TimestampNTZType)
        return Typed(F.col(f"`{mine}`"), kind, name not in self.relation.not_null, local=local)

    @property
    def place(self) -> Column | None:
        return F.col(f"`{self.mark}{POS}`") if self.mark + POS in self.df.columns else None


class Scope:
    def __init__(self, sources: list[Source], mode: Mode):
        self.sources, self.mode = sources, mode

    def find(self, c: n.Col) -> tuple[Source, str]:
        among = [s for s in self.sources if c.table is None or s.answers(c.table)]
        # Of a self-join both sides have the table's name: it means the left one, unless an alias says else.
        if c.table is not None and len(among) > 1:
            among = [s for s in among if s.alias == c.table] or among[:1]
        hits = [s for s in among if c.name in s.relation.kinds]
        if len(hits) != 1:
            raise ExecError(f"column not found: {c.name}")
        return hits[0], c.name

    def value(self, x: Any) -> Typed:
        if isinstance(x, n.Lit):
            return fn.constant(x.kind, x.value)
        if isinstance(x, n.Col):
            source, name = self.find(x)
            return source.column(name)
        if isinstance(x, n.Arith):
            return fn.arithmetic(x.op, self.value(x.left), self.value(x.right), self.mode)
        if isinstance(x, n.Call) and x.name in FUNCTIONS:
            return fn.call(x.name, self.value(x.arg), self.mode)
        raise unsupported(ExecError)

    def predicate(self, x: Any) -> Typed:
        if isinstance(x, n.Compare):
            return fn.compare(x.op, self.value(x.left), self.value(x.right), self.mode)
        if isinstance(x, n.Not):
            inner = self.predicate(x.arg)
            return Typed(~inner.col, ty.BOOL, guarded=inner.guarded)
        a, b = self.predicate(x.left), self.predicate(x.right)
        guarded = a.guarded or b.guarded
        if b.guarded:  # the right side must not be looked at where the left one settles it
            made = F.when(a.col, b.col).otherwise(F.lit(False)) if x.op == "AND" else F.when(a.col, F.lit(True)).otherwise(b.col)
        else:
            made = a.col & b.col if x.op == "AND" else a.col | b.col
        return Typed(made, ty.BOOL, guarded=guarded)


@dataclass
class Result:
    df: DataFrame
    columns: list[str]
    column_types: list[str]  # the declared type of plain columns, "" of expressions


def literal_select(spark: SparkSession, tree: n.LiteralSelect, mode: Mode) -> Result:
    value = Scope([], mode).value(tree.expr)
    return Result(spark.range(1).select(value.col.alias("value")), ["value"], [""])


def _first_equality(x: Any) -> n.Compare | None:
    """The first comparison of two columns for equality anywhere in a predicate."""
    if isinstance(x, n.Compare):
        return x if x.op == "=" and isinstance(x.left, n.Col) and isinstance(x.right, n.Col) else None
    if isinstance(x, n.Not):
        return _first_equality(x.arg)
    return (_first_equality(x.left) or _first_equality(x.right)) if isinstance(x, n.Logic) else None


def join_key(tree: n.Select, scope: Scope) -> tuple[Typed, Typed]:
    """The left and the right column of the join."""
    on = tree.on if tree.on is not None else _first_equality(tree.where)
    if not (isinstance(on, n.Compare) and on.op == "=" and isinstance(on.left, n.Col) and isinstance(on.right, n.Col)) or None in (on.left.table, on.right.table):
        raise unsupported(PlanError)
    sides = [scope.find(c) for c in (on.left, on.right)]
    if sides[0][0] is sides[1][0]:
        raise unsupported(PlanError)
    if sides[0][0] is not scope.sources[0]:
        sides.reverse()
    return sides[0][0].column(sides[0][1]), sides[1][0].column(sides[1][1])


def select(tree: n.Select, relations: list[Relation], mode: Mode) -> Result:
    joined = len(relations) == 2
    sources = [Source(r, t.alias, f"{'lr'[i]}." if joined else "") for i, (r, t) in enumerate(zip(relations, tree.tables, strict=True))]
    scope = Scope(sources, mode)
    where = scope.predicate(tree.where) if tree.where is not None else None
    df = sources[0].df
    if joined:
        left, right = join_key(tree, scope)
        on = fn.compare("=", left, right, mode).col
        df = df.join(sources[1].df, on, "inner")
        if where is not None and where.guarded:  # so that only matching pairs are looked at, the guard needs both sides
            where.col = F.when(on, where.col).otherwise(F.lit(False))
    if where is not None:
        df = df.filter(where.col)

    items = tree.items
    if items is not None and any(isinstance(i.expr, n.Agg) for i in items):
        return _aggregates(tree, scope, df, joined)
    if items is None:
        cells = [(s, c) for s in sources for c in s.relation.kinds]
        made = [(s.column(c), c, s.relation.kinds[c]) for s, c in cells]
    else:
        made = []
        for i in items:
            plain = scope.find(i.expr)[0].relation.kinds[i.expr.name] if isinstance(i.expr, n.Col) else ""
            made.append((scope.value(i.expr), i.label if joined or i.alias is None else i.alias, plain))
    if tree.order:
        keys = [fn.sort_key(_order_value(o, items, scope, joined), o.descending, mode) for o in tree.order]
        df = df.orderBy(*keys, *[s.place.asc() for s in sources if s.place is not None])
    return Result(df.select(*[t.col.alias(name) for t, name, _ in made]), [m[1] for m in made], [m[2] for m in made])


def _order_value(o: n.Order, items: tuple[n.Item, ...] | None, scope: Scope, joined: bool) -> Typed:
    if o.col.table is None and not joined:
        for i in items or ():
            if i.alias == o.col.name:
                return scope.value(i.expr)
    return scope.value(o.col)


def _aggregates(tree: n.Select, scope: Scope, df: DataFrame, joined: bool) -> Result:
    if tree.order or not all(isinstance(i.expr, n.Agg) for i in tree.items):
        raise unsupported(ExecError)
    place = scope.sources[0].place if len(scope.sources) == 1 else None
    cols, names = [], []
    for i in tree.items:
        if i.expr.name != "COUNT" and i.expr.arg is None:
            raise unsupported(ExecError)
        value = fn.aggregate(i.expr.name, None if i.expr.arg is None else scope.value(i.expr.arg), place)
        sole = len(tree.items) == 1 and i.expr.arg is None and i.alias is None
        names.append("count" if sole else i.alias if i.alias and not joined else i.label)
        cols.append(value.col.alias(names[-1]))
    return Result(df.agg(*cols), names, [""] * len(names))

