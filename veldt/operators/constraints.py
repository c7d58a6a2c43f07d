"""Keys and uniqueness: checks are jobs over the rows; what is found is reported, nothing is collected but one row."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt import types as ty
from veldt.errors import ExecError, constraint_violation
from veldt.operators.select import POS
from veldt.sources.catalog import Catalog, Table
from veldt.sql import nodes as n

#: The longest TEXT value in bytes that an index takes.
INDEXED_TEXT = 512


def _any(df: DataFrame) -> bool:
    return not df.isEmpty()


def _null(df: DataFrame, columns: list[str]) -> DataFrame:
    nulls = F.lit(False)
    for c in columns:
        nulls = nulls | F.col(f"`{c}`").isNull()
    return df.filter(nulls)


def _quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _flags(df: DataFrame, conditions: list[Column]) -> list[bool]:
    """Whether any row meets each condition, in one pass."""
    if not conditions:
        return []
    row = df.agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(conditions)]).first()
    return [bool(v) for v in row]


def _any_null(columns: list[str]) -> Column:
    nulls = F.lit(False)
    for c in columns:
        nulls = nulls | F.col(f"`{c}`").isNull()
    return nulls


def _too_long(table: Table, columns: list[str]) -> Column:
    long = F.lit(False)
    for c in columns:
        if table.kinds[c] == ty.TEXT:
            long = long | (F.octet_length(f"`{c}`") > INDEXED_TEXT)
    return long


def _repeated(columns: list[str], df: DataFrame, old: DataFrame | None, one: dict[str, Any] | None) -> bool:
    """Whether a key of df stands twice, in df or in df and old. one: the values of df's only row, if it has one only."""
    if one is not None:
        same = F.lit(True)
        for c in columns:
            same = same & (F.col(f"`{c}`") == F.lit(one[c]))
        return old is not None and _any(old.filter(same))
    if _any(df.groupBy(*_quoted(columns)).count().filter("count > 1")):
        return True
    if old is None:
        return False
    keys = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)])
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & (F.col(f"`{c}`") == F.col(f"__k{i}"))
    return _any(old.join(keys, on, "left_semi"))


def check_rows(table: Table, df: DataFrame, old: DataFrame | None = None, one: dict[str, Any] | None = None, touched: set[str] | None = None) -> None:
    """NOT NULL, indexed text, unique indexes and the primary key of rows that are new, beside `old` ones that were checked before.

    What a row shows by itself is looked for in one pass; keys are compared among the new rows and with the old. one: the values of a
    single new row. touched: the columns that have changed, where others need no look.
    """
    seen = lambda columns: touched is None or bool(touched & set(columns))
    required = [c.name for c in table.columns if c.not_null and seen([c.name])]
    indexes = [(i, [c for c, _ in i.columns]) for i in table.indexes if seen([c for c, _ in i.columns])]
    primary = table.primary if table.primary and seen(table.primary.columns) else None
    conditions = [_any_null([c]) for c in required] + [x for _, columns in indexes for x in (_too_long(table, columns), _any_null(columns))]
    flags = iter(_flags(df, conditions + ([_any_null(primary.columns)] if primary else [])))
    for c in required:
        if next(flags):
            raise ExecError(f"NOT NULL constraint failed: {table.name}.{c}")
    for i, columns in indexes:
        long, null = next(flags), next(flags)
        _check_index(table, i, columns, long, null, lambda columns=columns: _repeated(columns, df, old, one))
    if primary:
        if next(flags):
            raise constraint_violation(table.name, primary.name, "primary_key_null")
        if _repeated(primary.columns, df, old, one):
            raise constraint_violation(table.name, primary.name, "primary_key_duplicate")


def _check_index(table: Table, index: n.Index, columns: list[str], long: bool, null: bool, repeated: Callable[[], bool]) -> None:
    if long:
        raise ExecError("indexed TEXT column value exceeds 512-byte limit")
    if not index.unique or (table.primary and table.primary.index == index.name):
        return
    if null:
        raise ExecError("NULL exists in unique indexed key")
    if repeated():
        raise ExecError("duplicate indexed key values already exist")


def check_index(table: Table, index: n.Index, df: DataFrame) -> None:
    columns = [c for c, _ in index.columns]
    long, null = _flags(df, [_too_long(table, columns), _any_null(columns)])
    _check_index(table, index, columns, long, null, lambda: _repeated(columns, df, None, None))


def check_primary(table: Table, key: n.Primary, df: DataFrame) -> None:
    if _any(_null(df, key.columns)):
        raise constraint_violation(table.name, key.name, "primary_key_null")
    if _repeated(key.columns, df, None, None):
        raise constraint_violation(table.name, key.name, "primary_key_duplicate")


def check_foreign(child: Table, key: n.Foreign, rows: DataFrame, parents: DataFrame) -> None:
    if _any(_null(rows, key.columns)):
        raise constraint_violation(child.name, key.name, "foreign_key_null")
    if _any(_referring(rows, parents, key, "left_anti")):
        raise constraint_violation(child.name, key.name, "foreign_key_missing_parent")


def check_foreign_row(child: Table, key: n.Foreign, row: dict[str, Any], parents: DataFrame) -> None:
    """check_foreign of one row, by a look for its parent; a row of a key to its own table may be its own parent."""
    if any(row[c] is None for c in key.columns):
        raise constraint_violation(child.name, key.name, "foreign_key_null")
    if key.parent == child.name and all(row[c] == row[p] for c, p in zip(key.columns, key.parent_columns, strict=True)):
        return
    same = F.lit(True)
    for c, p in zip(key.columns, key.parent_columns, strict=True):
        same = same & (F.col(f"`{p}`") == F.lit(row[c]))
    if not _any(parents.filter(same)):
        raise constraint_violation(child.name, key.name, "foreign_key_missing_parent")


def _referring(rows: DataFrame, parents: DataFrame, key: n.Foreign, how: str) -> DataFrame:
    p = parents.select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(key.parent_columns)])
    on = F.lit(True)
    for i, c in enumerate(key.columns):
        on = on & (F.col(f"`{c}`") == F.col(f"__p{i}"))
    return rows.join(p, on, how)


def cascade(catalog: Catalog, rows: dict[str, DataFrame], table: str, gone: DataFrame, settle) -> dict[str, DataFrame]:
    """The rows of each table that a delete of `gone` from `table` takes along: name -> positions.

    rows: each table's rows; settle: writes a frame of positions down, as the closure goes on from it. A RESTRICT key with a
    surviving child row fails the statement.
    """
    taken = {table: settle(gone.select(POS))}
    fresh = {table: taken[table]}
    while fresh:
        found: dict[str, DataFrame] = {}
        for parent, positions in fresh.items():
            parents = rows[parent].join(positions, POS, "left_semi")
            for child, key in catalog.children(parent):
                if key.cascade:
                    hit = _referring(rows[child.name], parents, key, "left_semi").select(POS)
                    if child.name in taken:
                        hit = hit.join(taken[child.name], POS, "left_anti")
                    found[child.name] = found[child.name].union(hit) if child.name in found else hit
        fresh = {}
        for name, hit in found.items():
            hit = settle(hit.distinct())
            if _any(hit):
                fresh[name] = hit
                taken[name] = settle(taken[name].union(hit).distinct()) if name in taken else hit
    for parent, positions in taken.items():
        parents = rows[parent].join(positions, POS, "left_semi")
        for child, key in catalog.children(parent):
            if not key.cascade:
                left = rows[child.name]
                left = left.join(taken[child.name], POS, "left_anti") if child.name in taken else left
                if _any(_referring(left, parents, key, "left_semi")):
                    raise constraint_violation(child.name, key.name, "foreign_key_restrict")
    return taken


def check_cascades(catalog: Catalog) -> None:
    """No cycle of CASCADE keys, and no two CASCADE paths from one table to another; cycles are reported first.

    Tables are looked at by name, and a table's children by their name and their key's, so that what is reported is settled.
    """
    below: dict[str, list[tuple[str, str]]] = {name: [] for name in sorted(catalog.tables)}
    for t in catalog.tables.values():
        for f in t.foreign:
            if f.cascade and f.parent in below:
                below[f.parent].append((t.name, f.name))
    for edges in below.values():
        edges.sort()
    labels = lambda path: ",".join(dict.fromkeys(f"{child}.{key}" for child, key in path))
    cleared: set[str] = set()

    def look_for_cycle(at: str, above: dict[str, int], path: list[tuple[str, str]]) -> None:
        """above: the tables on the way here, with the number of keys followed before each."""
        above = {**above, at: len(path)}
        for edge in below[at]:
            if edge[0] in above:
                raise ExecError(f"foreign key cascade cycle detected: constraints={labels([*path[above[edge[0]] :], edge])}")
            if edge[0] not in cleared:
                look_for_cycle(edge[0], above, [*path, edge])
        cleared.add(at)

    for name in below:
        if name not in cleared:
            look_for_cycle(name, {}, [])
    for source in below:
        first: dict[str, list[tuple[str, str]]] = {}
        ahead = [[edge] for edge in reversed(below[source])]
        while ahead:  # depth first
            path = ahead.pop()
            target = path[-1][0]
            if target in first:
                raise ExecError(f"foreign key multiple cascade paths detected: source={source} target={target} constraints={labels([*first[target], *path])}")
            first[target] = path
            ahead += [[*path, edge] for edge in reversed(below[target])]


def foreign_shape(catalog: Catalog, child: Table, key: n.Foreign) -> None:
    """What a foreign key needs of its tables."""
    if key.parent not in catalog.tables:
        raise ExecError("foreign key parent table not found")
    parent = catalog.tables[key.parent]
    if len(key.columns) != len(key.parent_columns):
        raise ExecError("foreign key column count mismatch")
    if parent.primary is None or parent.primary.columns != key.parent_columns:
        raise ExecError("foreign key parent primary key not found")
    for c, p in zip(key.columns, key.parent_columns, strict=True):
        if child.column(c).kind != parent.column(p).kind:
            raise ExecError("foreign key column type mismatch")
    found = catalog.index(key.index)
    if found is None:
        raise ExecError("supporting index not found")
    if found[0] is not child:
        raise ExecError("supporting index belongs to different table")
    if found[1].columns[: len(key.columns)] != [(c, False) for c in key.columns]:
        raise ExecError("foreign key supporting index shape mismatch")


def primary_shape(catalog: Catalog, table: Table, key: n.Primary) -> None:
    for c in key.columns:
        table.column(c)
    found = catalog.index(key.index)
    if found is None:
        raise ExecError("supporting index not found")
    if found[0] is not table:
        raise ExecError("supporting index belongs to different table")
    if not found[1].unique:
        raise ExecError("primary key supporting index must be unique")
    if [c for c, _ in found[1].columns] != key.columns:
        raise ExecError("supporting index shape mismatch")
