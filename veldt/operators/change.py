"""Changes of rows and of schemas. Each works on a copy of the catalog, which is thrown away if anything fails."""

from __future__ import annotations

import datetime as dt
import uuid
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt import types as ty
from veldt.errors import ExecError, StorageError, constraint_violation, mismatch
from veldt.functions import typed as fn
from veldt.functions.typed import Mode, Typed
from veldt.operators import constraints as k
from veldt.operators.select import POS, Relation, Scope, Source
from veldt.sources.catalog import SYSTEM, Catalog, Table
from veldt.sources.files import Files
from veldt.sql import nodes as n

#: Folders of one table after which they are written together.
FOLDERS = 32


def schema(table: Table) -> T.StructType:
    return T.StructType([*(T.StructField(c.name, ty.SPARK[c.kind], True, {"logical": c.kind}) for c in table.columns), T.StructField(POS, T.LongType())])


class Changes:
    """Statements against one catalog, which the caller publishes or forgets."""

    def __init__(self, spark: SparkSession, files: Files, catalog: Catalog, mode: Mode):
        self.spark, self.files, self.mode = spark, files, mode
        self.catalog = deepcopy(catalog)
        #: Folders written by this statement, for the caller to delete if it fails.
        self.written: list[str] = []

    # Rows

    def rows(self, table: Table) -> DataFrame:
        """A table's rows; columns added since a folder was written have their default there."""
        shape = schema(table)
        if not table.data:
            return self.spark.createDataFrame([], shape)
        parts: dict[int, list[str]] = {}
        for folder in table.data:
            width = int(folder.split("-")[0])
            parts.setdefault(width, []).append(self.files.at("data", str(table.id), folder))
        out = None
        for width, paths in parts.items():
            own = T.StructType([*shape.fields[:width], shape.fields[-1]])
            df = self.spark.read.schema(own).parquet(*paths)
            late = [self._assigned(c, Scope([], self.mode).value(c.default) if c.has_default else fn.constant(ty.NULL, None)).alias(c.name) for c in table.columns[width:]]
            df = df.select(*[F.col(f"`{f.name}`") for f in shape.fields[:width]], *late, F.col(POS))
            out = df if out is None else out.unionByName(df)
        return out

    def relation(self, table: Table) -> Relation:
        return Relation(table.name, self.rows(table), table.kinds, frozenset(table.required()))

    def _write(self, table: Table, df: DataFrame) -> str:
        folder = f"{len(table.columns)}-{uuid.uuid4().hex}"
        self.written.append(f"data/{table.id}/{folder}")
        df.write.parquet(self.files.at("data", str(table.id), folder))
        return folder

    def _settle(self, df: DataFrame) -> DataFrame:
        path = self.files.at("data", "scratch", uuid.uuid4().hex)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _replace(self, table: Table, df: DataFrame) -> DataFrame:
        """df as the table's only folder, and what it reads back as."""
        table.data = [self._write(table, df)]
        out = self.rows(table)
        table.rows = out.count()
        return out

    def _assigned(self, c: n.Column, value: Typed) -> Any:
        """A value as the column takes it: nothing is coerced but literals' widths."""
        kind = value.kind
        if kind == ty.NULL:
            return F.lit(None).cast(ty.SPARK[c.kind])
        if kind == ty.UNTYPED and c.kind in ty.INTEGERS:
            if value.constant and not ty.fits(value.value, c.kind):
                raise mismatch()
            return value.col.cast(ty.SPARK[c.kind])
        if kind != c.kind:
            raise mismatch()
        return fn.instant(value, False, self.mode) if kind == ty.TIMESTAMP else value.col

    def _writable(self, name: str) -> Table:
        if name in SYSTEM:
            raise ExecError("system tables are read-only")
        return self.catalog.table(name)

    def _check_parents(self, table: Table, df: DataFrame, touched: set[str] | None = None) -> None:
        """The foreign keys of df, rows of a table whose whole new state the catalog names."""
        for key in table.foreign:
            if touched is None or touched & set(key.columns):
                k.check_foreign(table, key, df, self.rows(self.catalog.table(key.parent)))

    def insert(self, tree: n.Insert) -> int:
        table = self._writable(tree.table)
        names = list(tree.columns) if tree.columns is not None else [c.name for c in table.columns]
        if len(names) != len(tree.values):
            raise ExecError("column count mismatch")
        for name in names:
            table.column(name)
        given = dict(zip(names, tree.values, strict=True))
        scope, cells = Scope([], self.mode), []
        for c in table.columns:
            if c.name in given:
                value = scope.value(given[c.name])
            else:
                value = scope.value(c.default) if c.has_default else fn.constant(ty.NULL, None)
            if value.kind == ty.NULL and c.not_null:
                raise ExecError(f"NOT NULL constraint failed: {table.name}.{c.name}")
            cells.append(self._assigned(c, value).alias(c.name))
        row = self.spark.range(1).select(*cells, F.lit(table.next_pos).cast("long").alias(POS))
        row = self.spark.createDataFrame(row.collect(), schema(table))  # one row, its values settled
        # Only the new row is looked at; keys are looked up by an equality that reaches the scan.
        values = row.first().asDict()
        k.check_rows(table, row, self.rows(table), values)
        for key in table.foreign:
            k.check_foreign_row(table, key, values, self.rows(self.catalog.table(key.parent)))
        table.data.append(self._write(table, row.coalesce(1)))
        table.next_pos += 1
        table.rows += 1
        if len(table.data) > FOLDERS:
            self._replace(table, self.rows(table))
        return 1

    def load(self, name: str, df: DataFrame) -> int:
        """Append a DataFrame of the table's columns, in its order. It is written once; its rows are checked by themselves and against the others' keys."""
        table = self._writable(name)
        if [(f.name, ty.of_spark(f.dataType)) for f in df.schema.fields] != [(c.name, ty.INT if c.kind == ty.TIME else c.kind) for c in table.columns]:
            raise mismatch()
        before = self.rows(table)
        # Positions rise with partition and row; gaps don't matter.
        folder = self._write(table, df.withColumn(POS, F.monotonically_increasing_id() + table.next_pos))
        placed = self.spark.read.schema(schema(table)).parquet(self.files.at("data", str(table.id), folder))
        k.check_rows(table, placed, before if table.data else None)
        table.data.append(folder)
        self._check_parents(table, placed)
        loaded, last = placed.agg(F.count(F.lit(1)), F.max(POS)).first()
        table.next_pos = table.next_pos if last is None else last + 1
        table.rows += loaded
        return loaded

    def _matching(self, table: Table, where: Any) -> tuple[Source, Scope, Any]:
        source = Source(self.relation(table), None, "")
        scope = Scope([source], self.mode)
        return source, scope, F.lit(True) if where is None else scope.predicate(where).col

    def update(self, tree: n.Update) -> int:
        table = self._writable(tree.table)
        source, scope, where = self._matching(table, tree.where)
        df = source.df.withColumn("__hit", where)
        for i, c in enumerate(c for c in (table.primary.columns if table.primary else []) if c in {name for name, _ in tree.sets}):
            df = df.withColumn(f"__old{i}", F.col(f"`{c}`"))
        for name, expr in tree.sets:  # from left to right, each seeing what the ones before it made
            c = table.column(name)
            value = scope.value(expr)
            if value.kind == ty.NULL and c.not_null and self._any(df.filter("__hit")):
                raise ExecError(f"NOT NULL constraint failed: {table.name}.{name}")
            df = df.withColumn(name, F.when(F.col("__hit"), self._assigned(c, value)).otherwise(F.col(f"`{name}`")))
        touched = {name for name, _ in tree.sets}
        key = [c for c in table.primary.columns if c in touched] if table.primary else []
        moved = F.lit(False)
        for i, c in enumerate(key):
            moved = moved | ~F.col(f"`{c}`").eqNullSafe(F.col(f"__old{i}"))
        # Written once; what must be known of the rows is counted on the way.
        seen = Observation()
        counted = df.withColumn("__moved", moved).observe(seen, F.count(F.when(F.col("__hit"), 1)).alias("hits"), F.count(F.when(F.col("__moved"), 1)).alias("moved"))
        table.data = [self._write(table, counted.select(*[F.col(f"`{f.name}`") for f in schema(table).fields]))]
        if seen.get["moved"]:
            raise constraint_violation(table.name, table.primary.name, "primary_key_update")
        after = self.rows(table)
        k.check_rows(table, after, touched=touched - set(key))
        self._check_parents(table, after, touched)
        return seen.get["hits"]

    def _any(self, df: DataFrame) -> bool:
        return not df.isEmpty()

    def delete(self, tree: n.Delete) -> int:
        table = self._writable(tree.table)
        source, _, where = self._matching(table, tree.where)
        if not self.catalog.children(table.name):
            had = table.rows
            self._replace(table, source.df.filter(~where))
            return had - table.rows
        rows = {t.name: self.rows(t) for t in self.catalog.tables.values()}
        gone = k.cascade(self.catalog, rows, table.name, source.df.filter(where), self._settle)
        hits = gone[table.name].count()
        for name, positions in gone.items():
            if name != table.name or hits:
                self._replace(self.catalog.table(name), rows[name].join(positions, POS, "left_anti"))
        return hits

    # Schemas

    def create_table(self, tree: n.CreateTable) -> int:
        if tree.table in self.catalog.tables or tree.table in SYSTEM:
            raise ExecError("table already exists")
        table = Table(self.catalog.next_id, tree.table, deepcopy(tree.columns))
        self.catalog.next_id += 1
        self.catalog.tables[tree.table] = table
        if len(tree.primary) > 1:
            raise ExecError("multiple primary keys not allowed")
        names = [c.name for c in [*tree.primary, *tree.foreign]]
        if len(set(names)) != len(names):
            raise ExecError("duplicate constraint name on table")
        for c in table.columns:
            if c.has_default:
                self._assigned(c, Scope([], self.mode).value(c.default))
        for c in tree.primary:
            self._add_index(table, n.Index(c.index, [(x, False) for x in c.columns], True))
            self._add_primary(table, c)
        for c in tree.foreign:
            if self.catalog.index(c.index) is None:
                self._add_index(table, n.Index(c.index, [(x, False) for x in c.columns]))
            self._add_foreign(table, c)
        return 0

    def drop_table(self, tree: n.DropTable) -> int:
        table = self._writable(tree.table)
        del self.catalog.tables[table.name]
        for t in self.catalog.tables.values():
            t.foreign = [f for f in t.foreign if f.parent != table.name]
        return 0

    def _add_index(self, table: Table, index: n.Index) -> None:
        for c, _ in index.columns:
            table.column(c)
        if self.catalog.index(index.name):
            raise ExecError("index already exists")
        if any(i.columns == index.columns and i.unique == index.unique for i in table.indexes):
            raise ExecError("equivalent index already exists")
        simple = lambda i: len(i.columns) == 1 and not i.unique
        if simple(index) and any(simple(i) and i.columns[0][0] == index.columns[0][0] for i in table.indexes):
            raise ExecError("index/table mismatch")
        table.indexes.append(index)

    def create_index(self, tree: n.CreateIndex) -> int:
        table = self._writable(tree.table)
        self._add_index(table, tree.index)
        k.check_index(table, tree.index, self.rows(table))
        return 0

    def drop_index(self, tree: n.DropIndex) -> int:
        found = self.catalog.index(tree.name)
        if found is None:
            raise ExecError("index not found")
        table, index = found
        holders = [*([table.primary] if table.primary else []), *table.foreign]
        for h in holders:
            if h.index == index.name:
                kind = "primary_key" if isinstance(h, n.Primary) else "foreign_key"
                raise ExecError(f"index required by constraint: table={table.name} index={index.name} constraint={h.name} type={kind}")
        table.indexes.remove(index)
        return 0

    def add_column(self, tree: n.AddColumn) -> int:
        table, c = self._writable(tree.table), deepcopy(tree.column)
        if any(x.name == c.name for x in table.columns):
            raise ExecError(f"column already exists: {c.name}")
        if c.has_default:
            self._assigned(c, Scope([], self.mode).value(c.default))
        if c.not_null and not c.has_default and table.rows:
            raise ExecError("cannot add NOT NULL column without DEFAULT to non-empty table")
        table.columns.append(c)
        return 0

    def _constraint_names(self, table: Table) -> set[str]:
        return {c.name for c in [*([table.primary] if table.primary else []), *table.foreign]}

    def _add_primary(self, table: Table, key: n.Primary) -> None:
        if table.primary:
            raise ExecError("multiple primary keys not allowed")
        k.primary_shape(self.catalog, table, key)
        k.check_primary(table, key, self.rows(table))
        table.primary = key

    def _add_foreign(self, table: Table, key: n.Foreign) -> None:
        for c in key.columns:
            table.column(c)
        k.foreign_shape(self.catalog, table, key)
        table.foreign.append(key)
        k.check_cascades(self.catalog)
        k.check_foreign(table, key, self.rows(table), self.rows(self.catalog.table(key.parent)))

    def add_constraint(self, tree: n.AddConstraint) -> int:
        table = self._writable(tree.table)
        if tree.constraint.name in self._constraint_names(table):
            raise ExecError("duplicate constraint name on table")
        (self._add_primary if isinstance(tree.constraint, n.Primary) else self._add_foreign)(table, deepcopy(tree.constraint))
        return 0

    def drop_primary(self, tree: n.DropPrimary) -> int:
        table = self._writable(tree.table)
        if not table.primary:
            raise ExecError(f"primary key not found: table={table.name}")
        table.primary = None
        for t in self.catalog.tables.values():
            t.foreign = [f for f in t.foreign if f.parent != table.name]
        return 0

    def drop_foreign(self, tree: n.DropForeign) -> int:
        table = self._writable(tree.table)
        if not any(f.name == tree.name for f in table.foreign):
            raise ExecError(f"foreign key not found: table={table.name} constraint={tree.name}")
        table.foreign = [f for f in table.foreign if f.name != tree.name]
        return 0

    def run(self, tree: Any) -> int:
        if isinstance(tree, n.EndTransaction):
            raise ExecError("unsupported query form")
        step = {
            n.Insert: self.insert, n.Update: self.update, n.Delete: self.delete, n.CreateTable: self.create_table, n.DropTable: self.drop_table, n.CreateIndex: self.create_index,
            n.DropIndex: self.drop_index, n.AddColumn: self.add_column, n.AddConstraint: self.add_constraint, n.DropPrimary: self.drop_primary, n.DropForeign: self.drop_foreign,
        }[type(tree)]
        return step(tree)


def clock(seconds: int | None) -> dt.time | None:
    """A stored TIME as a time of day."""
    return None if seconds is None else dt.time(seconds // 3600, seconds // 60 % 60, seconds % 60)


def checked_zone(zone: str | None) -> str | None:
    import zoneinfo

    if zone is not None:
        try:
            zoneinfo.ZoneInfo(zone)
        except Exception:
            raise StorageError(f"invalid timezone: {zone}") from None
    return zone
