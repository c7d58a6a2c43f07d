"""Registered queries that run statements and tell what came of each: rows touched, or the error's text, and the rows that are left.

Each returns (step, said). What is expected stands beside the statement; rows that are read back from the driver's two smallest tables,
which never grow, are expected as SQL over those tables.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

import veldt
from veldt.database import Database
from veldt.errors import EngineError, UsageError

SHAPE = "step int, said string"

#: A database, whether it was filled by the driver's tables or by statements.
Make = Callable[[SparkSession, str], Database]


def heard(call: Callable[[], Any]) -> str:
    """What a call returns, as text, or the text of its error."""
    try:
        return str(call())
    except (EngineError, UsageError) as e:
        return f"{type(e).__name__}: {e}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(said: Iterable[str]) -> str:
    return "SELECT CAST(step AS INT) AS step, said FROM (VALUES " + ", ".join(f"({k}, {_quoted(s)})" for k, s in enumerate(said, 1)) + ") AS t(step, said)"


def told(make: Make, steps: list[tuple[str, str]], left: tuple[str, str] | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query that executes the statements of `steps` and then reads `left`, and its SQL.

    steps: statements with what is expected of each; left: a SELECT of (INT, TEXT) rows, and SQL for the same rows, numbered from 100.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = make(spark, sf_dir)

        def step(sql: str) -> Any:
            return db.rows(sql) if sql.startswith("SELECT") else db.exec(sql)

        out = spark.createDataFrame([(k, heard(lambda sql=sql: step(sql))) for k, (sql, _) in enumerate(steps, 1)], SHAPE)
        if left is None:
            return out
        rows = db.query(left[0]).toDF("step", "said")
        return out.unionByName(rows.selectExpr("cast(step AS int) AS step", "said"))

    sql = values(expected for _, expected in steps)
    return run, sql if left is None else f"{sql} UNION ALL {left[1]}"


def listed(make: Make, lines: Callable[[Database], list[Any]], expected: list[str]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query of what calls on a database answer, one line each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = make(spark, sf_dir)
        return spark.createDataFrame([(k, heard(x) if callable(x) else str(x)) for k, x in enumerate(lines(db), 1)], SHAPE)

    return run, values(expected)


E, U = "ExecError: execution: ", "UsageError: "


def scenarios(empty: Make, regions: Make, nations: Make, attached: Make) -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """By name, a query and its SQL. regions, nations: databases with these tables, loaded from the driver's."""

    def of(*statements: str) -> Make:
        def make(spark: SparkSession, sf_dir: str) -> Database:
            db = empty(spark, sf_dir)
            for s in statements:
                db.exec(s)
            return db

        return make

    def indexed(spark: SparkSession, sf_dir: str) -> Database:
        db = nations(spark, sf_dir)
        db.exec("CREATE INDEX nations_label ON nations (label)")
        return db

    harbour = "CREATE TABLE harbours (code INT, town TEXT, CONSTRAINT pk_harbours PRIMARY KEY (code) USING INDEX harbours_pk)"

    def ships(action: str) -> str:
        return f"CREATE TABLE ships (hull INT, home INT, CONSTRAINT pk_ships PRIMARY KEY (hull) USING INDEX ships_pk, CONSTRAINT fk_home FOREIGN KEY (home) REFERENCES harbours (code) USING INDEX ships_home ON DELETE {action})"

    violated = lambda table, name, kind: f"{E}constraint violation: table={table} constraint={name} type={kind}"
    everyone = ("SELECT id + 100, label FROM nations", "SELECT CAST(n_nationkey + 100 AS INT), n_name FROM nation")
    out: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

    # Scans of an indexed table
    out["index_equality"] = (lambda spark, d: indexed(spark, d).query("SELECT id, label FROM nations WHERE label = 'france'"), "SELECT n_nationkey AS id, n_name AS label FROM nation WHERE lower(n_name) = 'france'")
    out["index_count"] = (lambda spark, d: indexed(spark, d).query("SELECT COUNT(*) FROM nations"), 'SELECT count(*) AS "count" FROM nation')
    out["index_projection"] = (lambda spark, d: indexed(spark, d).query("SELECT region_id FROM nations"), "SELECT n_regionkey AS region_id FROM nation")
    out["index_fallback"] = (lambda spark, d: indexed(spark, d).query("SELECT id, label FROM nations WHERE label > 'france' AND region_id != 2 ORDER BY label DESC"), "SELECT n_nationkey AS id, n_name AS label FROM nation WHERE lower(n_name) > 'france' AND n_regionkey <> 2")
    path = lambda db, sql: (lambda p: f"{p.scan_type}|{p.table_name}|{p.index_name}|{p.uses_index}")(db.explain_path(sql))
    asked = ["SELECT 1", "SELECT * FROM nations", "SELECT id FROM nations WHERE label = 'peru'", "SELECT id FROM nations WHERE 'peru' = label", "SELECT COUNT(*) FROM nations", "SELECT label FROM nations", "SELECT id FROM nations WHERE label > 'peru'", "SELECT id FROM nations WHERE label = 'peru' AND id = 1", "SELECT a.id FROM nations a JOIN regions b ON a.region_id = b.id"]
    out["explain_paths"] = listed(indexed, lambda db: [path(db, q) for q in asked], ["|||False", "table|nations||False", "index|nations|nations_label|True", "index|nations|nations_label|True", "index-only|nations|nations_region|True", "index-only|nations|nations_label|True", "table|nations||False", "table|nations||False", "join|nations||False"])

    # What SELECT names, types, and refuses
    name_and_type = lambda db, sql: (lambda r: ", ".join(f"{c}:{t}" for c, t in zip(r.columns, r.column_types, strict=True)))(db.result(sql))
    out["output_names"] = listed(
        nations,
        lambda db: [name_and_type(db, q) for q in ("SELECT * FROM regions", "SELECT label AS what, id FROM nations", "SELECT COUNT(*) FROM nations", "SELECT COUNT(*) AS n FROM nations", "SELECT 4 + 5")],
        ["id:INT, label:TEXT", "what:TEXT, id:INT", "count:", "n:", "value:"],
    )
    refused = "PlanError: plan: unsupported query form", f"{E}unsupported query form", "ParseError: parse: unsupported query form"
    out["refused_forms"] = told(
        nations,
        [
            ("SELECT id FROM nations WHERE COUNT(*) = 1", refused[1]), ("SELECT COUNT(*), id FROM nations", refused[1]), ("SELECT COUNT(*) FROM nations ORDER BY id", refused[1]),
            ("SELECT MAX(id) + 1 FROM nations", refused[1]), ("SELECT REVERSE(label) FROM nations", refused[1]), ("SELECT id FROM nations WHERE label LIKE 'a'", "ParseError: parse: invalid where clause"), ("SELECT id FROM nations GROUP BY id", refused[2]),
        ],
    )
    out["checked_when_empty"] = told(
        of("CREATE TABLE empties (n INT, t TEXT, d DATE, b BOOL)"),
        [
            ("SELECT n FROM empties", "[]"), ("SELECT nope FROM empties", f"{E}column not found: nope"), ("SELECT n FROM empties WHERE n = 'x'", f"{E}type mismatch"), ("SELECT n FROM empties WHERE b > TRUE", f"{E}type mismatch"),
            ("SELECT n FROM empties WHERE t = 5", f"{E}type mismatch"), ("SELECT LENGTH(n) FROM empties", f"{E}type mismatch"), ("SELECT SUM(t) FROM empties", f"{E}type mismatch"), ("SELECT n FROM nowhere", f"{E}table not found: nowhere"), ("SELECT COUNT(*) FROM empties", "[(0,)]"),
        ],
    )
    out["literal_arithmetic"] = told(attached, [("SELECT 10-3", "[(7,)]"), ("SELECT 10 - 3", "[(7,)]"), ("SELECT 10 -3", "[(7,)]"), ("SELECT 1 + 2 - 8", refused[2]), ("SELECT (9 - 4)", "[(5,)]"), ("SELECT 9 - (4 - 2)", refused[2]), ("SELECT 2147483647 + 1", f"{E}integer out of range"), ("SELECT 1.5 + 0.25", refused[2]), ("SELECT 'here,there'", "[('here,there',)]"), ("SELECT 'here there'", refused[2])])
    out["arith_chain"] = (lambda spark, d: nations(spark, d).query("SELECT id + (10 - (region_id + 2)) - 1 AS x, id FROM nations WHERE (id - 3) + 1 >= (5)"), "SELECT n_nationkey + (10 - (n_regionkey + 2)) - 1 AS x, n_nationkey AS id FROM nation WHERE (n_nationkey - 3) + 1 >= 5")

    # Types of every kind in predicates
    log = of(
        "CREATE TABLE watches (no INT, day DATE, hour TIME, seen TIMESTAMP, calm BOOL, note TEXT)",
        "INSERT INTO watches VALUES (1, '2031-02-03', '04:00:00', '2031-02-03 04:10:00', TRUE, 'Fog, then rain')",
        "INSERT INTO watches VALUES (2, '2031-02-03', '16:30:05', '2031-02-03 16:40:00', FALSE, 'ΣΑΣ')",
        "INSERT INTO watches VALUES (3, '2031-11-30', '23:59:59', '2031-12-01 00:00:00', TRUE, NULL)",
    )
    out["typed_predicates"] = told(
        log,
        [
            ("SELECT no FROM watches WHERE day = '2031-02-03' ORDER BY no", "[(1,), (2,)]"), ("SELECT no FROM watches WHERE day > '2031-02-03'", "[(3,)]"), ("SELECT no FROM watches WHERE hour >= '16:30:05' ORDER BY no", "[(2,), (3,)]"),
            ("SELECT no FROM watches WHERE hour != '04:00:00' AND calm = TRUE", "[(3,)]"), ("SELECT no FROM watches WHERE calm = FALSE", "[(2,)]"), ("SELECT no FROM watches WHERE seen < '2031-02-03 16:40:00'", "[(1,)]"),
            ("SELECT no FROM watches WHERE note = 'fog, THEN rain'", "[(1,)]"), ("SELECT no FROM watches WHERE note = 'σασ'", "[(2,)]"), ("SELECT no FROM watches WHERE note = 'ςαΣ'", "[(2,)]"), ("SELECT no FROM watches WHERE day = '04:00:00'", f"{E}type mismatch"),
            ("SELECT no FROM watches WHERE note = NULL OR LENGTH(note) > 6 ORDER BY no DESC", "[(3,), (1,)]"), ("SELECT no FROM watches WHERE note != NULL AND LENGTH(note) = 6", "[(2,)]"),
        ],
    )
    out["row_values"] = told(
        log,
        [
            ("SELECT day, hour, seen, calm FROM watches WHERE no = 1", "[(datetime.date(2031, 2, 3), datetime.time(4, 0), datetime.datetime(2031, 2, 3, 4, 10), True)]"),
            ("INSERT INTO watches VALUES ('x', NULL, NULL, NULL, NULL, NULL)", f"{E}type mismatch"), ("INSERT INTO watches VALUES (4, '10:00:00', NULL, NULL, NULL, NULL)", f"{E}type mismatch"),
            ("UPDATE watches SET calm = 1", f"{E}type mismatch"), ("UPDATE watches SET note = 'a, b' WHERE no = 3", "1"), ("SELECT note FROM watches WHERE no = 3", "[('a, b',)]"),
        ],
    )

    # Order
    ties = of("CREATE TABLE marks (who TEXT, points INT)", *(f"INSERT INTO marks VALUES ('{w}', {p})" for w, p in (("d", 3), ("a", 1), ("c", 3), ("b", 1), ("e", 2), ("A", 3))))
    out["stable_order"] = told(ties, [("SELECT who FROM marks ORDER BY points DESC", "[('d',), ('c',), ('A',), ('e',), ('a',), ('b',)]"), ("SELECT who, points FROM marks ORDER BY who, points DESC", "[('A', 3), ('a', 1), ('b', 1), ('c', 3), ('d', 3), ('e', 2)]"), ("SELECT x.who, y.who FROM marks x JOIN marks y ON x.points = y.points WHERE x.points = 1 ORDER BY x.points", "[('a', 'a'), ('a', 'b'), ('b', 'a'), ('b', 'b')]")])

    # Constraints on rows
    tide = "CREATE TABLE tides (port INT NOT NULL, mark TEXT)"
    out["not_null"] = told(of(tide), [("INSERT INTO tides VALUES (NULL, 'x')", f"{E}NOT NULL constraint failed: tides.port"), ("INSERT INTO tides (mark) VALUES ('x')", f"{E}NOT NULL constraint failed: tides.port"), ("INSERT INTO tides VALUES (7, NULL)", "1"), ("UPDATE tides SET port = NULL", f"{E}NOT NULL constraint failed: tides.port"), ("UPDATE tides SET port = 8", "1"), ("SELECT port, mark FROM tides", "[(8, None)]")])
    out["unique_index"] = told(
        regions,
        [
            ("CREATE UNIQUE INDEX by_label ON regions (label)", "0"), ("INSERT INTO regions VALUES (50, 'ASIA')", f"{E}duplicate indexed key values already exist"), ("INSERT INTO regions VALUES (51, 'asia')", "1"),
            ("INSERT INTO regions VALUES (52, NULL)", f"{E}NULL exists in unique indexed key"), ("UPDATE regions SET label = 'same'", f"{E}duplicate indexed key values already exist"), (f"INSERT INTO regions VALUES (53, '{'x' * 513}')", f"{E}indexed TEXT column value exceeds 512-byte limit"),
            (f"INSERT INTO regions VALUES (54, '{'y' * 512}')", "1"), ("DELETE FROM regions WHERE id >= 51", "2"),
        ],
        ("SELECT id + 100, label FROM regions", "SELECT CAST(r_regionkey + 100 AS INT), r_name FROM region"),
    )
    out["primary_key"] = told(
        regions,
        [
            ("INSERT INTO regions VALUES (1, 'again')", violated("regions", "pk_regions", "primary_key_duplicate")), ("INSERT INTO regions VALUES (NULL, 'none')", violated("regions", "pk_regions", "primary_key_null")),
            ("UPDATE regions SET id = 9 WHERE id = 1", violated("regions", "pk_regions", "primary_key_update")), ("UPDATE regions SET id = id, label = 'kept' WHERE id = 1", "1"),
        ],
        ("SELECT id + 100, label FROM regions", "SELECT CAST(r_regionkey + 100 AS INT), CASE WHEN r_regionkey = 1 THEN 'kept' ELSE r_name END FROM region"),
    )
    out["foreign_key"] = told(
        nations,
        [
            ("INSERT INTO nations VALUES (90, 'Atlantis', 77)", violated("nations", "fk_region", "foreign_key_missing_parent")), ("INSERT INTO nations VALUES (91, 'Atlantis', NULL)", violated("nations", "fk_region", "foreign_key_null")),
            ("UPDATE nations SET region_id = 78 WHERE id = 3", violated("nations", "fk_region", "foreign_key_missing_parent")), ("INSERT INTO nations VALUES (92, 'Atlantis', 2)", "1"),
        ],
        (everyone[0], everyone[1] + " UNION ALL SELECT 192, 'Atlantis'"),
    )
    fleet = [f"INSERT INTO harbours VALUES ({c}, '{t}')" for c, t in ((10, "Brest"), (20, "Cork"), (30, "Turku"))]
    out["restrict"] = told(
        of(harbour, ships("RESTRICT"), *fleet, "INSERT INTO ships VALUES (1, 20)"),
        [("DELETE FROM harbours WHERE code = 20", violated("ships", "fk_home", "foreign_key_restrict")), ("DELETE FROM harbours", violated("ships", "fk_home", "foreign_key_restrict")), ("DELETE FROM harbours WHERE code = 10", "1"), ("DELETE FROM ships", "1"), ("DELETE FROM harbours WHERE code < 30", "1"), ("SELECT code, town FROM harbours", "[(30, 'Turku')]")],
    )
    out["composite_keys"] = told(
        of("CREATE TABLE berths (quay INT, slot TEXT, CONSTRAINT pk_berths PRIMARY KEY (quay, slot) USING INDEX berths_pk)", "CREATE TABLE stays (n INT, quay INT, slot TEXT, CONSTRAINT fk_berth FOREIGN KEY (quay, slot) REFERENCES berths (quay, slot) USING INDEX stays_berth ON DELETE CASCADE)", "INSERT INTO berths VALUES (1, 'a|b')", "INSERT INTO berths VALUES (1, 'a')"),
        [
            ("INSERT INTO berths VALUES (1, 'a')", violated("berths", "pk_berths", "primary_key_duplicate")), ("INSERT INTO stays VALUES (1, 1, 'a|b')", "1"), ("INSERT INTO stays VALUES (2, 1, 'b')", violated("stays", "fk_berth", "foreign_key_missing_parent")), ("INSERT INTO stays VALUES (3, 1, 'a')", "1"),
            ("DELETE FROM berths WHERE slot = 'a'", "1"), ("SELECT n FROM stays", "[(1,)]"),
        ],
    )
    pilot = "CREATE TABLE pilots (no INT, chief INT, CONSTRAINT pk_pilots PRIMARY KEY (no) USING INDEX pilots_pk, CONSTRAINT fk_chief FOREIGN KEY (chief) REFERENCES pilots (no) USING INDEX pilots_chief ON DELETE "
    out["self_reference"] = told(
        of(),
        [
            (pilot + "CASCADE)", f"{E}foreign key cascade cycle detected: constraints=pilots.fk_chief"), (pilot + "RESTRICT)", "0"), ("INSERT INTO pilots VALUES (1, 1)", "1"), ("INSERT INTO pilots VALUES (2, 1)", "1"), ("INSERT INTO pilots VALUES (3, 4)", violated("pilots", "fk_chief", "foreign_key_missing_parent")),
            ("DELETE FROM pilots WHERE no = 1", violated("pilots", "fk_chief", "foreign_key_restrict")), ("DELETE FROM pilots WHERE no = 2", "1"), ("DELETE FROM pilots", "1"),
        ],
    )
    made = lambda name, *keys: f"CREATE TABLE {name} (no INT" + "".join(f", {p}_no INT" for p in keys) + f", CONSTRAINT pk_{name} PRIMARY KEY (no) USING INDEX {name}_pk" + "".join(f", CONSTRAINT {name}_{p} FOREIGN KEY ({p}_no) REFERENCES {p} (no) USING INDEX {name}_{p}_ix ON DELETE CASCADE" for p in keys) + ")"
    out["illegal_cascades"] = told(
        of(made("sea"), made("bay", "sea"), made("cove", "bay"), made("isle", "sea"), "ALTER TABLE sea ADD COLUMN cove_no INT", "CREATE INDEX sea_cove ON sea (cove_no)", "ALTER TABLE isle ADD COLUMN bay_no INT", "CREATE INDEX isle_bay ON isle (bay_no)"),
        [
            ("ALTER TABLE sea ADD CONSTRAINT round FOREIGN KEY (cove_no) REFERENCES cove (no) USING INDEX sea_cove ON DELETE CASCADE", f"{E}foreign key cascade cycle detected: constraints=cove.cove_bay,sea.round,bay.bay_sea"),
            ("ALTER TABLE isle ADD CONSTRAINT twice FOREIGN KEY (bay_no) REFERENCES bay (no) USING INDEX isle_bay ON DELETE CASCADE", f"{E}foreign key multiple cascade paths detected: source=sea target=isle constraints=bay.bay_sea,isle.twice,isle.isle_sea"),
            (made("reef", "bay", "isle"), f"{E}foreign key multiple cascade paths detected: source=sea target=reef constraints=bay.bay_sea,reef.reef_bay,isle.isle_sea,reef.reef_isle"),
            ("ALTER TABLE isle ADD CONSTRAINT once FOREIGN KEY (bay_no) REFERENCES bay (no) USING INDEX isle_bay ON DELETE RESTRICT", "0"), ("SELECT COUNT(*) FROM reef", f"{E}table not found: reef"),
        ],
    )

    # Changes of schemas
    out["indexes"] = told(
        of(harbour, "CREATE TABLE logs (n INT, t TEXT)", "INSERT INTO logs VALUES (1, 'a')", "INSERT INTO logs VALUES (1, 'b')"),
        [
            ("CREATE INDEX logs_n ON logs (n)", "0"), ("CREATE INDEX logs_n ON logs (t)", f"{E}index already exists"), ("CREATE INDEX other ON logs (n)", f"{E}equivalent index already exists"), ("CREATE INDEX down ON logs (n DESC)", f"{E}index/table mismatch"), ("CREATE UNIQUE INDEX only ON logs (n)", f"{E}duplicate indexed key values already exist"),
            ("CREATE UNIQUE INDEX only ON logs (t DESC, n)", "0"), ("CREATE INDEX x ON logs (nope)", f"{E}column not found: nope"), ("CREATE INDEX x ON nowhere (n)", f"{E}table not found: nowhere"), ("DROP INDEX logs_n", "0"), ("DROP INDEX logs_n", f"{E}index not found"),
            ("DROP INDEX harbours_pk", f"{E}index required by constraint: table=harbours index=harbours_pk constraint=pk_harbours type=primary_key"), ("SELECT n, t FROM logs ORDER BY t", "[(1, 'a'), (1, 'b')]"),
        ],
    )
    out["constraints_added"] = told(
        of("CREATE TABLE harbours (code INT, town TEXT)", "CREATE TABLE ships (hull INT, home INT, name TEXT)", "INSERT INTO harbours VALUES (1, 'Brest')", "INSERT INTO ships VALUES (5, 1, 'Vega')", "CREATE UNIQUE INDEX h_ix ON harbours (code)", "CREATE INDEX s_ix ON ships (home)", "CREATE INDEX s_name ON ships (name)", "CREATE INDEX h_town ON harbours (town)"),
        [
            ("ALTER TABLE ships ADD CONSTRAINT fk FOREIGN KEY (home) REFERENCES harbours (code) USING INDEX s_ix ON DELETE RESTRICT", f"{E}foreign key parent primary key not found"),
            ("ALTER TABLE harbours ADD CONSTRAINT pk PRIMARY KEY (code) USING INDEX none", f"{E}supporting index not found"), ("ALTER TABLE harbours ADD CONSTRAINT pk PRIMARY KEY (town) USING INDEX h_town", f"{E}primary key supporting index must be unique"),
            ("ALTER TABLE harbours ADD CONSTRAINT pk PRIMARY KEY (code) USING INDEX s_ix", f"{E}supporting index belongs to different table"), ("ALTER TABLE harbours ADD CONSTRAINT pk PRIMARY KEY (code) USING INDEX h_ix", "0"), ("ALTER TABLE harbours ADD CONSTRAINT pk2 PRIMARY KEY (code) USING INDEX h_ix", f"{E}multiple primary keys not allowed"),
            ("ALTER TABLE ships ADD CONSTRAINT fk FOREIGN KEY (name) REFERENCES harbours (code) USING INDEX s_name ON DELETE RESTRICT", f"{E}foreign key column type mismatch"), ("ALTER TABLE ships ADD CONSTRAINT fk FOREIGN KEY (home) REFERENCES harbours (code) USING INDEX s_name ON DELETE RESTRICT", f"{E}foreign key supporting index shape mismatch"),
            ("ALTER TABLE ships ADD CONSTRAINT fk FOREIGN KEY (home) REFERENCES docks (code) USING INDEX s_ix ON DELETE RESTRICT", f"{E}foreign key parent table not found"), ("ALTER TABLE ships ADD CONSTRAINT fk FOREIGN KEY (home) REFERENCES harbours (code) USING INDEX s_ix ON DELETE RESTRICT", "0"),
            ("ALTER TABLE ships ADD CONSTRAINT fk FOREIGN KEY (home) REFERENCES harbours (code) USING INDEX s_ix ON DELETE RESTRICT", f"{E}duplicate constraint name on table"), ("DELETE FROM harbours", violated("ships", "fk", "foreign_key_restrict")), ("DROP INDEX s_ix", f"{E}index required by constraint: table=ships index=s_ix constraint=fk type=foreign_key"),
            ("ALTER TABLE ships DROP FOREIGN KEY fk", "0"), ("ALTER TABLE ships DROP FOREIGN KEY fk", f"{E}foreign key not found: table=ships constraint=fk"), ("ALTER TABLE harbours DROP PRIMARY KEY", "0"), ("ALTER TABLE harbours DROP PRIMARY KEY", f"{E}primary key not found: table=harbours"), ("DELETE FROM harbours", "1"), ("SELECT hull, home, name FROM ships", "[(5, 1, 'Vega')]"),
        ],
    )
    out["drop_table"] = told(nations, [("DROP TABLE regions", "0"), ("SELECT id FROM regions", f"{E}table not found: regions"), ("INSERT INTO nations VALUES (93, 'Free', 99)", "1"), ("DROP TABLE regions", f"{E}table not found: regions"), ("CREATE TABLE nations (x INT)", f"{E}table already exists")], (everyone[0], everyone[1] + " UNION ALL SELECT 193, 'Free'"))

    # The handle
    touched = lambda db, *sql: [(lambda q=q: db.exec(q)) for q in sql]
    out["rows_touched"] = listed(regions, lambda db: touched(db, "UPDATE regions SET label = 'x' WHERE id >= 2", "UPDATE regions SET label = 'y' WHERE id = 70", "DELETE FROM regions WHERE id = 0 OR id = 4", "DELETE FROM regions", "DELETE FROM regions", "SELECT id FROM regions"), ["3", "0", "2", "3", "0", U + "Exec disallows SELECT statement"])
    out["query_row"] = listed(regions, lambda db: [(lambda q=q: db.query_row(q)) for q in ("SELECT id FROM regions WHERE id = 2", "SELECT id FROM regions WHERE id = 70", "SELECT id FROM regions", "DELETE FROM regions", "SELECT id FROM nowhere")], ["(2,)", "NoRows: no rows", "MultipleRows: multiple rows", U + "Query requires SELECT statement", f"{E}table not found: nowhere"])

    def handle(db: Database) -> list[Any]:
        tx = db.begin()
        lines: list[Any] = [db.begin, lambda: tx.exec("DELETE FROM regions"), lambda: tx.query_row("SELECT COUNT(*) FROM regions"), lambda: db.query_row("SELECT COUNT(*) FROM regions"), tx.rollback, lambda: tx.exec("DELETE FROM regions"), db.close, lambda: db.query("SELECT id FROM regions"), db.list_tables]
        return [heard(x) for x in lines]

    out["handle_states"] = listed(regions, handle, [U + "transaction already active", "5", "(0,)", "(5,)", "None", U + "transaction is not active", "None", U + "closed", U + "closed"])

    def catalogued(db: Database) -> list[Any]:
        described = [f"{t.name}({', '.join(f'{c.name} {c.type}' for c in t.columns)})" for t in db.list_tables()]
        same = db.schema_digest() == db.schema_digest_from_system_catalog() and db.verify_digest()
        first = db.schema_digest()
        db.exec("DELETE FROM nations WHERE id = 1")
        rows_only = db.schema_digest() == first
        db.exec("CREATE INDEX extra ON nations (label)")
        report = db.report()
        tables = [f"{t['name']}:{t['columns']}:{t['rows']}" for t in report["inventory"]["tables"]]
        indexes = sorted(f"{i['name']}:{i['table']}:{i['unique']}:{'+'.join(i['columns'])}" for i in report["inventory"]["indexes"])
        status = report["status"]
        return [*described, same, rows_only, db.schema_digest() == first, len(first), *tables, *indexes, report["check"], f"{status['tables']} {status['indexes']} {status['timezone']}", report["usage"]["files"] > 0]

    out["introspection"] = listed(
        nations,
        catalogued,
        ["nations(id INT, label TEXT, region_id INT)", "regions(id INT, label TEXT)", "True", "True", "False", "64", "regions:2:5", "nations:3:24", "extra:nations:False:label", "nations_pk:nations:True:id", "nations_region:nations:False:region_id", "regions_pk:regions:True:id", "{'ok': True, 'tables': 2}", "2 4 UTC", "True"],
    )
    out["error_kinds"] = listed(
        regions,
        lambda db: [(lambda q=q: db.rows(*q)) for q in (("SELEC",), ("SELECT id FROM regions r JOIN regions s ON r.id > s.id",), ("SELECT id FROM regions WHERE id = ?",), ("",), ("SELECT id FROM regions WHERE label = 5",))] + [lambda: Database.open(db.spark, db.path + "-none"), lambda: Database.create(db.spark, db.path), veldt.__version__ == str(veldt.__version__)],
        [refused[2], refused[0], "BindError: bind: placeholder count mismatch: expected 1, got 0", U + "invalid argument", f"{E}type mismatch", "StorageError: storage: database does not exist", "StorageError: storage: database already exists", "True"],
    )

    def scripted(db: Database) -> list[Any]:
        from veldt.shell import Shell

        shell = Shell(db.spark)
        with tempfile.TemporaryDirectory() as folder:
            script = os.path.join(folder, "script.sql")
            with open(script, "w") as f:
                f.write("INSERT INTO regions VALUES (80, 'a;b');\nUPDATE regions SET label = 'c' WHERE id = 80;\nSELECT label FROM regions WHERE id = 80;")
            lines = ("tables", f"open {db.path}", "db", f"run {script}", "tables", "schema regions", "SELECT COUNT(*) FROM regions", "SELECT nope FROM regions", "close")
            return [shell.run(line).replace(db.path, "PATH") for line in lines]

    out["shell_script"] = listed(regions, scripted, ["error: no database is open", "opened PATH", "PATH", "1 row\n1 row\nlabel\nc", "regions", "regions: id INT, label TEXT", "count\n6", "error: execution: column not found: nope", "closed"])
    return out
