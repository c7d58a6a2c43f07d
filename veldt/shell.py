"""A small shell: commands by their first word, anything else is SQL for the open database."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

import veldt
from veldt.database import Database
from veldt.errors import EngineError, UsageError

HELP = {
    "help": "help [sql]           this list, or the statements",
    "version": "version              the engine's version",
    "db": "db                   which database is open",
    "create": "create PATH [ZONE]   make a database and open it",
    "open": "open PATH            open a database",
    "close": "close                close it",
    "sample": "sample PATH          make a database with two small tables and open it",
    "run": "run PATH             run the statements of a file, which end in semicolons",
    "tables": "tables               the tables' names",
    "schema": "schema [TABLE]       a table's columns, or all tables'",
    "exit": "quit, exit, q, bye   leave",
}
LEAVE = ("exit", "quit", "q", "bye", "\\q")
STATEMENTS = """SELECT ... FROM t [a] [JOIN u [b] ON a.x = b.y] [WHERE ...] [ORDER BY ...]
INSERT INTO t [(...)] VALUES (...) | UPDATE t SET c = ... [WHERE ...] | DELETE FROM t [WHERE ...]
CREATE TABLE t (...) | CREATE [UNIQUE] INDEX i ON t (...) | DROP TABLE t | DROP INDEX i | ALTER TABLE t ..."""
SAMPLE = (
    "CREATE TABLE boats (hull INT, name TEXT, built DATE, CONSTRAINT pk_boats PRIMARY KEY (hull) USING INDEX boats_pk)",
    "CREATE TABLE trips (hull INT, miles REAL, port TEXT, CONSTRAINT fk_boat FOREIGN KEY (hull) REFERENCES boats (hull) USING INDEX trips_boat ON DELETE CASCADE)",
    "INSERT INTO boats VALUES (7, 'Petrel', '1988-05-01')", "INSERT INTO boats VALUES (8, 'Auk', '2003-09-17')",
    "INSERT INTO trips VALUES (7, 61.5, 'Bergen')", "INSERT INTO trips VALUES (8, 12.0, 'Leith')",
)


def statements(text: str) -> list[str]:
    """The statements of a script; a semicolon in quotes ends none."""
    out, quoted, start = [], False, 0
    for at, c in enumerate(text):
        quoted ^= c == "'"
        if c == ";" and not quoted:
            out.append(text[start:at].strip())
            start = at + 1
    return [s for s in [*out, text[start:].strip()] if s]


class Shell:
    def __init__(self, spark: SparkSession):
        self.spark, self.db, self.done = spark, None, False

    def run(self, line: str) -> str:
        """What a line answers; errors answer with their text."""
        line = line.strip().rstrip(";")
        word, _, rest = line.partition(" ")
        try:
            if line.lower() in LEAVE:
                return self.do_exit("")
            if word.lower() in HELP:
                return getattr(self, f"do_{word.lower()}")(rest.strip())
            return self.sql(line) if line else ""
        except (EngineError, UsageError, OSError) as e:
            return f"error: {e}"

    def opened(self) -> Database:
        if self.db is None:
            raise UsageError("no database is open")
        return self.db

    def sql(self, text: str) -> str:
        db = self.opened()
        if text.split(None, 1)[0].upper() == "SELECT":
            r = db.result(text)
            return "\n".join("\t".join("NULL" if v is None else str(v) for v in row) for row in [r.columns, *db.rows(text)])
        n = db.exec(text)
        return f"{n} row{'s' * (n != 1)}"

    def do_help(self, rest: str) -> str:
        return STATEMENTS if rest.lower() == "sql" else "\n".join(HELP.values())

    def do_version(self, rest: str) -> str:
        return veldt.__version__

    def do_db(self, rest: str) -> str:
        return self.db.path if self.db else "none"

    def do_create(self, rest: str) -> str:
        path, _, zone = rest.partition(" ")
        self.do_close("")
        self.db = Database.create(self.spark, path, timezone=zone.strip() or None)
        return f"created {path}"

    def do_open(self, rest: str) -> str:
        self.do_close("")
        self.db = Database.open(self.spark, rest)
        return f"opened {rest}"

    def do_close(self, rest: str) -> str:
        if self.db:
            self.db.close()
        self.db = None
        return "closed"

    def do_sample(self, rest: str) -> str:
        said = self.do_create(rest)
        for s in SAMPLE:
            self.opened().exec(s)
        return f"{said}, with boats and trips"

    def do_run(self, rest: str) -> str:
        self.opened()
        with open(rest) as f:
            return "\n".join(self.sql(s) for s in statements(f.read()))

    def do_tables(self, rest: str) -> str:
        return "\n".join(t.name for t in self.opened().list_tables())

    def do_schema(self, rest: str) -> str:
        db = self.opened()
        tables = [db.table_schema(rest)] if rest else db.list_tables()
        return "\n".join(f"{t.name}: {', '.join(f'{c.name} {c.type}' + ' NOT NULL' * c.not_null for c in t.columns)}" for t in tables)

    def do_exit(self, rest: str) -> str:
        self.done = True
        return self.do_close("")


def main(lines: Iterable[str] = sys.stdin) -> None:
    shell = Shell(SparkSession.builder.appName("veldt").getOrCreate())
    for line in lines:
        print(shell.run(line), flush=True)
        if shell.done:
            break


if __name__ == "__main__":
    main()
