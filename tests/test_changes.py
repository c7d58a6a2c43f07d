"""Changes of rows and schemas, keys, transactions, persistence."""

import pytest

from veldt.database import Database
from veldt.errors import EngineError, ExecError, StorageError, UsageError

SENSORS = "CREATE TABLE sensors (code INT NOT NULL, unit TEXT DEFAULT 'kelvin', working BOOL NOT NULL DEFAULT FALSE, reading REAL)"
HARBOURS = "CREATE TABLE harbours (id INT, CONSTRAINT pk_harbours PRIMARY KEY (id) USING INDEX harbours_pk_ix)"


def ships(action, name="ships", parent="harbours"):
    return (
        f"CREATE TABLE {name} (id INT, berth INT, CONSTRAINT pk_{name} PRIMARY KEY (id) USING INDEX ix_{name}_pk, "
        f"CONSTRAINT fk_{name} FOREIGN KEY (berth) REFERENCES {parent} (id) USING INDEX ix_{name}_parent ON DELETE {action})"
    )


def rows(db, table, columns="id"):
    return sorted(db.rows(f"SELECT {columns} FROM {table}"))


def test_defaults_and_nullability(db, run):
    run(SENSORS, "INSERT INTO sensors (code) VALUES (40)", "INSERT INTO sensors (reading, code, unit) VALUES (3.25, 41, NULL)")
    assert db.rows("SELECT * FROM sensors ORDER BY code") == [(40, "kelvin", False, None), (41, None, False, 3.25)]
    for sql in ("INSERT INTO sensors (unit) VALUES ('bar')", "INSERT INTO sensors VALUES (NULL, 'bar', TRUE, 1.0)", "UPDATE sensors SET working = NULL"):
        with pytest.raises(ExecError, match="NOT NULL constraint failed: sensors"):
            db.exec(sql)
    with pytest.raises(ExecError, match="column count mismatch"):
        db.exec("INSERT INTO sensors VALUES (40)")
    assert len(db.rows("SELECT code FROM sensors")) == 2


def test_update_applies_sets_in_order(db, run):
    run("CREATE TABLE t (id INT, a INT, b INT)", "INSERT INTO t VALUES (1, 10, 20)", "INSERT INTO t VALUES (2, 1, 1)")
    assert db.exec("UPDATE t SET a = b, b = a + 1 WHERE a = 10") == 1
    assert db.rows("SELECT * FROM t ORDER BY id") == [(1, 20, 21), (2, 1, 1)]
    assert db.exec("UPDATE t SET a = 0") == 2 and db.exec("DELETE FROM t WHERE id = 2") == 1 and db.exec("DELETE FROM t") == 1
    for sql in ("UPDATE t SET nope = 1", "UPDATE t SET a = 'x'", "UPDATE t SET a = 1 WHERE nope = 1", "INSERT INTO nope VALUES (1)", "INSERT INTO sys_tables VALUES (1, 'x')"):
        with pytest.raises(EngineError):
            db.exec(sql)


def test_add_column(db, run):
    run("CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)", "ALTER TABLE t ADD COLUMN name TEXT NOT NULL DEFAULT 'old'", "INSERT INTO t VALUES (2, 'new')", "ALTER TABLE t ADD COLUMN x REAL")
    assert db.rows("SELECT * FROM t ORDER BY id") == [(1, "old", None), (2, "new", None)]
    assert db.exec("UPDATE t SET x = 1.5 WHERE name = 'OLD'") == 1 and db.rows("SELECT x FROM t ORDER BY id") == [(1.5,), (None,)]
    with pytest.raises(ExecError, match="cannot add NOT NULL column without DEFAULT to non-empty table"):
        db.exec("ALTER TABLE t ADD COLUMN y INT NOT NULL")


def test_unique_indexes(db, run):
    run("CREATE TABLE t (id INT, name TEXT)", "CREATE UNIQUE INDEX u ON t (id, name)", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (1, 'A')")
    for sql, why in (
        ("INSERT INTO t VALUES (1, 'a')", "duplicate indexed key values already exist"), ("INSERT INTO t VALUES (NULL, 'a')", "NULL exists in unique indexed key"),
        (f"INSERT INTO t VALUES (2, '{'x' * 513}')", "512-byte limit"), ("CREATE UNIQUE INDEX v ON t (id)", "duplicate indexed key"), ("CREATE INDEX u ON t (id)", "index already exists"),
        ("CREATE UNIQUE INDEX w ON t (id, name)", "equivalent index already exists"), ("DROP INDEX nope", "index not found"), ("CREATE INDEX n ON nope (id)", "table not found: nope"),
    ):
        with pytest.raises(ExecError, match=why):
            db.exec(sql)
    run("CREATE INDEX w ON t (id DESC, name)", "DROP INDEX u", "INSERT INTO t VALUES (1, 'a')")
    assert len(rows(db, "t")) == 3


def test_primary_key(db, run):
    run(HARBOURS, "INSERT INTO harbours VALUES (1)")
    for sql, kind in (("INSERT INTO harbours VALUES (1)", "primary_key_duplicate"), ("INSERT INTO harbours VALUES (NULL)", "primary_key_null"), ("UPDATE harbours SET id = 2", "primary_key_update")):
        with pytest.raises(ExecError, match=f"constraint violation: table=harbours constraint=pk_harbours type={kind}"):
            db.exec(sql)
    with pytest.raises(ExecError, match="index required by constraint: table=harbours index=harbours_pk_ix constraint=pk_harbours type=primary_key$"):
        db.exec("DROP INDEX harbours_pk_ix")
    run(ships("RESTRICT"), "ALTER TABLE harbours DROP PRIMARY KEY", "INSERT INTO harbours VALUES (2)", "INSERT INTO ships VALUES (1, 77)")
    with pytest.raises(ExecError, match="primary key not found"):
        db.exec("ALTER TABLE harbours DROP PRIMARY KEY")
    run("ALTER TABLE harbours ADD CONSTRAINT pk PRIMARY KEY (id) USING INDEX harbours_pk_ix")


def test_restrict(db, run):
    run(HARBOURS, ships("RESTRICT"), *(f"INSERT INTO harbours VALUES ({i})" for i in (1, 2, 3)), "INSERT INTO ships VALUES (10, 2)")
    assert db.exec("DELETE FROM harbours WHERE id = 1") == 1
    with pytest.raises(ExecError, match="table=ships constraint=fk_ships type=foreign_key_restrict"):
        db.exec("DELETE FROM harbours WHERE id = 2 OR id = 3")
    assert rows(db, "harbours") == [(2,), (3,)]
    for sql, kind in (("INSERT INTO ships VALUES (11, 9)", "foreign_key_missing_parent"), ("INSERT INTO ships VALUES (11, NULL)", "foreign_key_null"), ("UPDATE ships SET berth = 9", "foreign_key_missing_parent")):
        with pytest.raises(ExecError, match=kind):
            db.exec(sql)
    assert db.exec("UPDATE ships SET berth = 3") == 1
    run("ALTER TABLE ships DROP FOREIGN KEY fk_ships", "DELETE FROM harbours")
    with pytest.raises(ExecError, match="foreign key not found: table=ships constraint=fk_ships"):
        db.exec("ALTER TABLE ships DROP FOREIGN KEY fk_ships")


def test_cascade_chain(db, run):
    run(HARBOURS, ships("CASCADE"), ships("CASCADE", "crews", "ships"), "INSERT INTO harbours VALUES (1)", "INSERT INTO harbours VALUES (2)", "INSERT INTO ships VALUES (10, 1)", "INSERT INTO ships VALUES (20, 2)", "INSERT INTO crews VALUES (100, 10)", "INSERT INTO crews VALUES (200, 20)")
    assert db.exec("DELETE FROM harbours WHERE id = 1") == 1
    assert rows(db, "ships") == [(20,)] and rows(db, "crews") == [(200,)]
    run("DROP TABLE harbours", "INSERT INTO ships VALUES (30, 5)")


def test_illegal_cascades(db, run):
    run(HARBOURS, ships("CASCADE", "b"), "CREATE TABLE c (id INT, p INT, q INT, CONSTRAINT fk_p FOREIGN KEY (p) REFERENCES harbours (id) USING INDEX ix_p ON DELETE CASCADE)", "CREATE INDEX ix_q ON c (q)")
    with pytest.raises(ExecError, match="foreign key multiple cascade paths detected: source=harbours target=c constraints=b.fk_b,c.fk_q,c.fk_p$"):
        db.exec("ALTER TABLE c ADD CONSTRAINT fk_q FOREIGN KEY (q) REFERENCES b (id) USING INDEX ix_q ON DELETE CASCADE")
    run("ALTER TABLE harbours ADD COLUMN up INT NOT NULL", "CREATE INDEX ix_up ON harbours (up)")
    with pytest.raises(ExecError, match="foreign key cascade cycle detected: constraints=harbours.fk_up,b.fk_b$"):
        db.exec("ALTER TABLE harbours ADD CONSTRAINT fk_up FOREIGN KEY (up) REFERENCES b (id) USING INDEX ix_up ON DELETE CASCADE")
    run("ALTER TABLE harbours ADD CONSTRAINT fk_self FOREIGN KEY (up) REFERENCES harbours (id) USING INDEX ix_up ON DELETE RESTRICT", "INSERT INTO harbours VALUES (1, 1)", "DELETE FROM harbours")


def test_composite_keys(db, run):
    run(
        "CREATE TABLE p (a INT, b TEXT, CONSTRAINT pk PRIMARY KEY (a, b) USING INDEX pk_ix)",
        "CREATE TABLE c (x INT, y TEXT, CONSTRAINT fk FOREIGN KEY (x, y) REFERENCES p (a, b) USING INDEX fk_ix ON DELETE RESTRICT)",
        "INSERT INTO p VALUES (1, 'u|v')", "INSERT INTO c VALUES (1, 'u|v')",
    )
    with pytest.raises(ExecError, match="foreign_key_missing_parent"):
        db.exec("INSERT INTO c VALUES (1, 'u')")


def test_transactions(db, run):
    run("CREATE TABLE t (id INT)", "INSERT INTO t VALUES (1)")
    tx = db.begin()
    tx.exec("INSERT INTO t VALUES (2)")
    assert rows(tx, "t") == [(1,), (2,)] and rows(db, "t") == [(1,)]
    with pytest.raises(UsageError, match="already active"):
        db.begin()
    tx.commit()
    assert rows(db, "t") == [(1,), (2,)]
    with pytest.raises(UsageError, match="not active"):
        tx.exec("DELETE FROM t")
    tx = db.begin()
    tx.exec("DELETE FROM t")
    tx.rollback()
    assert rows(db, "t") == [(1,), (2,)]
    tx = db.begin()
    tx.exec("INSERT INTO t VALUES (3)")
    db.exec("INSERT INTO t VALUES (4)")
    with pytest.raises(ExecError, match="write conflict"):
        tx.commit()
    assert rows(db, "t") == [(1,), (2,), (4,)]
    assert db.vacuum() >= 1 and rows(db, "t") == [(1,), (2,), (4,)]


def test_reopen(spark, tmp_path):
    path = str(tmp_path / "db")
    with Database.create(spark, path, timezone="Europe/Paris") as db:
        db.exec("CREATE TABLE t (id INT NOT NULL DEFAULT 7, day DATE DEFAULT '2026-04-10', seen TIMESTAMP DEFAULT '2026-04-10 13:45:21', CONSTRAINT pk PRIMARY KEY (id) USING INDEX ix)")
        db.exec("INSERT INTO t (id) VALUES (1)")
        digest = db.schema_digest()
    with pytest.raises(StorageError):
        Database.create(spark, path)
    with pytest.raises(StorageError):
        Database.open(spark, path + "x")
    with Database.open(spark, path) as db:
        db.exec("INSERT INTO t (id) VALUES (2)")
        assert len({r[1:] for r in db.rows("SELECT * FROM t")}) == 1 and db.schema_digest() == digest and db.verify_digest()
        assert db.check()["ok"] and db.report()["status"]["timezone"] == "Europe/Paris" and db.usage()["files"] > 0
        assert [c.name for c in db.table_schema("t").columns] == ["id", "day", "seen"] and [t.name for t in db.list_tables()] == ["t"]
        assert db.rows("SELECT table_name FROM sys_tables") == [("t",)]
        with pytest.raises(ExecError, match="primary_key_duplicate"):
            db.exec("INSERT INTO t (id) VALUES (2)")


def test_many_inserts_are_written_together(db, run, monkeypatch):
    from veldt.operators import change

    monkeypatch.setattr(change, "FOLDERS", 3)
    run("CREATE TABLE t (id INT)", *(f"INSERT INTO t VALUES ({i})" for i in range(6)))
    assert [r[0] for r in db.rows("SELECT id FROM t ORDER BY id")] == list(range(6)) and len(db._state.tables["t"].data) <= 3


def test_load(db, run, spark):
    run(HARBOURS)
    assert db.load("harbours", spark.range(50).selectExpr("cast(id AS int) AS id")) == 50
    with pytest.raises(ExecError, match="primary_key_duplicate"):
        db.load("harbours", spark.range(1).selectExpr("cast(id AS int) AS id"))
    with pytest.raises(ExecError, match="type mismatch"):
        db.load("harbours", spark.range(1))
    assert db.query_row("SELECT COUNT(*) FROM harbours") == (50,)


def test_paths(db, run):
    run("CREATE TABLE t (id INT, name TEXT)", "CREATE INDEX ix ON t (id)")
    path = lambda sql: (p := db.explain_path(sql)).scan_type + (f":{p.index_name}" if p.uses_index else "")
    assert path("SELECT 1") == "" and path("SELECT * FROM t WHERE id = 1") == "index:ix" and path("SELECT COUNT(*) FROM t") == "index-only:ix" and path("SELECT id FROM t") == "index-only:ix"
    assert path("SELECT id AS x FROM t") == "table" and path("SELECT name FROM t") == "table" and path("SELECT a.id FROM t a JOIN t b ON a.id = b.id") == "join"
