"""The catalog: what tables there are, their columns, keys, indexes, and the Parquet folders that hold their rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import asdict, dataclass, field

from veldt import types as ty
from veldt.errors import ExecError
from veldt.sql import nodes as n

FORMAT = 1


@dataclass
class Table:
    id: int
    name: str
    columns: list[n.Column]
    primary: n.Primary | None = None
    foreign: list[n.Foreign] = field(default_factory=list)
    indexes: list[n.Index] = field(default_factory=list)
    data: list[str] = field(default_factory=list)
    rows: int = 0
    next_pos: int = 0

    def column(self, name: str) -> n.Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ExecError(f"column not found: {name}")

    @property
    def kinds(self) -> dict[str, str]:
        return {c.name: c.kind for c in self.columns}

    def required(self) -> set[str]:
        keys = [self.primary] if self.primary else []
        return {c.name for c in self.columns if c.not_null} | {c for k in [*keys, *self.foreign] for c in k.columns}


@dataclass
class Catalog:
    zone: str | None = None
    version: int = 0
    next_id: int = 1
    tables: dict[str, Table] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ExecError(f"table not found: {name}")
        return self.tables[name]

    def index(self, name: str) -> tuple[Table, n.Index] | None:
        return next(((t, i) for t in self.tables.values() for i in t.indexes if i.name == name), None)

    def children(self, name: str) -> list[tuple[Table, n.Foreign]]:
        return [(t, f) for t in self.tables.values() for f in t.foreign if f.parent == name]

    def to_json(self) -> str:
        return json.dumps({"format": FORMAT, **asdict(self)}, default=_plain, indent=1)

    @staticmethod
    def from_json(text: str) -> Catalog:
        d = json.loads(text)
        out = Catalog(d["zone"], d["version"], d["next_id"])
        for name, t in d["tables"].items():
            out.tables[name] = Table(
                t["id"], name, [_column(c) for c in t["columns"]], n.Primary(**t["primary"]) if t["primary"] else None, [n.Foreign(**f) for f in t["foreign"]],
                [n.Index(i["name"], [tuple(c) for c in i["columns"]], i["unique"]) for i in t["indexes"]], t["data"], t["rows"], t["next_pos"],
            )
        return out

    def digest(self) -> str:
        """A hash of the schema: tables, columns, keys and indexes, not of rows."""
        d = json.loads(self.to_json())
        shape = [[t["name"], t["columns"], t["primary"], t["foreign"], sorted(t["indexes"], key=lambda i: i["name"])] for _, t in sorted(d["tables"].items())]
        return hashlib.sha256(json.dumps(shape, sort_keys=True).encode()).hexdigest()


def _plain(x):
    if isinstance(x, dt.date | dt.datetime):
        return x.isoformat()
    raise TypeError(type(x).__name__)


def _column(c: dict) -> n.Column:
    out = n.Column(**c)
    if out.has_default:
        kind, value = out.default["kind"], out.default["value"]
        if kind == ty.DATE:
            value = dt.date.fromisoformat(value)
        elif kind == ty.TIMESTAMP:
            value = dt.datetime.fromisoformat(value)
        out.default = n.Lit(kind, value)
    return out


#: The virtual tables: name -> columns and types, all read-only.
SYSTEM = {
    "sys_tables": {"table_id": ty.INT, "table_name": ty.TEXT},
    "sys_tb_columns": {"table_id": ty.INT, "column_name": ty.TEXT, "column_type": ty.TEXT, "ordinal_position": ty.INT},
    "sys_indexes": {"index_id": ty.INT, "index_name": ty.TEXT, "table_id": ty.INT, "is_unique": ty.BOOL},
    "sys_ix_columns": {"index_id": ty.INT, "column_name": ty.TEXT, "ordinal_position": ty.INT},
}


def system_rows(catalog: Catalog, name: str) -> list[tuple]:
    tables = sorted(catalog.tables.values(), key=lambda t: t.id)
    if name == "sys_tables":
        return [(t.id, t.name) for t in tables]
    if name == "sys_tb_columns":
        return [(t.id, c.name, c.kind, k) for t in tables for k, c in enumerate(t.columns, 1)]
    indexes = [(k, t, i) for k, (t, i) in enumerate(((t, i) for t in tables for i in t.indexes), 1)]
    if name == "sys_indexes":
        return [(k, i.name, t.id, i.unique) for k, t, i in indexes]
    return [(k, c, at) for k, _, i in indexes for at, (c, _) in enumerate(i.columns, 1)]
