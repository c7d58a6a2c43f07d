"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    kind: str
    value: Any


@dataclass(frozen=True)
class Param:
    place: int


@dataclass(frozen=True)
class Col:
    table: str | None
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    arg: Any


@dataclass(frozen=True)
class Agg:
    name: str
    arg: Any  # None for COUNT(*)


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None
    label: str  # the item's own text


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None


@dataclass(frozen=True)
class Order:
    col: Col
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None for *
    tables: tuple[TableRef, ...]
    on: Compare | None = None
    where: Any = None
    order: tuple[Order, ...] = ()


@dataclass(frozen=True)
class LiteralSelect:
    expr: Any


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Any], ...]
    where: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass
class Column:
    name: str
    kind: str
    not_null: bool = False
    has_default: bool = False
    default: Any = None  # a literal's value


@dataclass
class Primary:
    name: str
    columns: list[str]
    index: str


@dataclass
class Foreign:
    name: str
    columns: list[str]
    parent: str
    parent_columns: list[str]
    index: str
    cascade: bool


@dataclass
class Index:
    name: str
    columns: list[tuple[str, bool]]  # name, descending
    unique: bool = False


@dataclass
class CreateTable:
    table: str
    columns: list[Column]
    primary: list[Primary] = field(default_factory=list)
    foreign: list[Foreign] = field(default_factory=list)


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    table: str
    index: Index


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: Column


@dataclass(frozen=True)
class AddConstraint:
    table: str
    constraint: Primary | Foreign


@dataclass(frozen=True)
class DropPrimary:
    table: str


@dataclass(frozen=True)
class DropForeign:
    table: str
    name: str


@dataclass(frozen=True)
class EndTransaction:
    word: str
