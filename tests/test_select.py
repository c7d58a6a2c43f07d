"""SELECT semantics: text folding, two-valued nulls, strict types, widths, joins, aggregates, names and order."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from veldt.errors import EngineError, ExecError, MultipleRows, NoRows, PlanError, UsageError
from veldt.types import Int16, Int32, Int64


def ids(db, where, table="t"):
    return sorted(r[0] for r in db.rows(f"SELECT id FROM {table} WHERE {where}"))


@pytest.mark.parametrize(
    ("sql", "value"),
    [("SELECT 6", 6), ("SELECT -17", -17), ("SELECT 20+3", 23), ("SELECT 31 - 8", 23), ("SELECT 4+-9", -5), ("SELECT (-6+2)", -4), (" select 70 ", 70), ("SELECT 'gull'", "gull"), ("SELECT ''", ""), ("SELECT FALSE", False), ("SELECT -0.75", -0.75), ("SELECT NULL", None), ("SELECT '2031-02-03'", "2031-02-03")],
)
def test_literal_select(db, sql, value):
    assert db.query_row(sql) == (value,)


def test_text_ignores_case(db, run):
    run("CREATE TABLE t (id INT, tree TEXT)", *(f"INSERT INTO t VALUES ({i}, '{s}')" for i, s in enumerate(["Oak", "elm", "Pine", "ELM", "Elm"], 1)))
    assert [r[0] for r in db.rows("SELECT tree FROM t ORDER BY tree")] == ["elm", "ELM", "Elm", "Oak", "Pine"]
    assert [r[0] for r in db.rows("SELECT tree FROM t ORDER BY tree DESC")] == ["Pine", "Oak", "elm", "ELM", "Elm"]
    assert ids(db, "tree = 'eLm'") == [2, 4, 5] and ids(db, "tree < 'OAL'") == [1, 2, 4, 5]
    assert db.query_row("SELECT MIN(tree), MAX(tree) FROM t WHERE tree = 'ELM'") == ("elm", "elm")
    run("CREATE INDEX trees ON t (tree)")
    assert ids(db, "tree = 'elm'") == [2, 4, 5]


def test_text_equality_folds_characters(db, run):
    """One character for one: all three sigmas are equal, also at a word's end, and the long s is an s; nothing grows."""
    texts = ["ΣΑΣ", "σας", "σασ", "ſet", "SET", "\u212a", "k", "ß", "SS", "µ", "Μ"]
    run("CREATE TABLE t (id INT, name TEXT)", *(f"INSERT INTO t VALUES ({i}, '{s}')" for i, s in enumerate(texts)))
    for want in ([0, 1, 2], [3, 4], [5, 6], [7], [8], [9, 10]):
        for i in want:
            assert ids(db, f"name = '{texts[i]}'") == want and ids(db, f"NOT name != '{texts[i]}'") == want
    pairs = db.rows("SELECT a.id, b.id FROM t a JOIN t b ON a.name = b.name WHERE a.id != b.id")
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in ((0, 1), (0, 2), (1, 2), (3, 4), (5, 6), (9, 10))}


def test_nulls_are_two_valued(db, run):
    run("CREATE TABLE t (id INT, active BOOL, name TEXT)", "INSERT INTO t VALUES (1, TRUE, 'alpha')", "INSERT INTO t VALUES (2, FALSE, 'beta')", "INSERT INTO t VALUES (3, NULL, NULL)")
    for where, want in (
        ("active = TRUE", [1]), ("active != TRUE", [2, 3]), ("active != FALSE", [1, 3]), ("active = NULL", [3]), ("active != NULL", [1, 2]), ("name = NULL", [3]), ("1 != NULL", [1, 2, 3]),
        ("NOT active = TRUE", [2, 3]), ("active != TRUE AND id = 3", [3]), ("NOT (active = NULL OR id = 1)", [2]), ("id < 3 AND name < 'b'", [1]),
    ):
        assert ids(db, where) == want, where
    for sql in ("SELECT id FROM t WHERE name < 'z'", "SELECT LOWER(name) FROM t", "SELECT name FROM t ORDER BY name"):
        with pytest.raises(PySparkException, match="execution: type mismatch"):
            db.rows(sql)
    with pytest.raises(ExecError, match="type mismatch"):
        db.query("SELECT id FROM t WHERE name < NULL")


def test_lenient_mode(spark, tmp_path):
    from veldt.database import Database

    db = Database.create(spark, str(tmp_path / "x"), strict=False)
    db.exec("CREATE TABLE t (id INT, name TEXT)")
    db.exec("INSERT INTO t VALUES (1, NULL)")
    db.exec("INSERT INTO t VALUES (2, 'a')")
    assert ids(db, "name < 'z'") == [2] and ids(db, "NOT name < 'z'") == [1] and ids(db, "name < NULL") == []
    assert db.rows("SELECT LOWER(name) FROM t ORDER BY name") == [(None,), ("a",)]


@pytest.mark.parametrize(
    "where",
    ["id = 'x'", "id = 1.0", "x = 1", "x = 'a'", "x = TRUE", "name = 1", "active < TRUE", "active = 1", "day = 'abc'", "day = '13:45:21'", "small = 40000", "LENGTH(id) = 1", "ABS(name) = 1", "id + x = 1", "small + id = 1", "SUM(id) = 1", "NOSUCH(id) = 1"],
)
def test_types_never_mix(db, run, where):
    run("CREATE TABLE t (id INT, x REAL, name TEXT, active BOOL, day DATE, small SMALLINT, big BIGINT)")
    with pytest.raises(EngineError, match="type mismatch|unsupported query form"):
        db.query(f"SELECT id FROM t WHERE {where}")


def test_widths(db, run):
    run("CREATE TABLE t (id INT, small SMALLINT, big BIGINT)")
    db.exec("INSERT INTO t VALUES (?, ?, ?)", Int32(22), Int16(11), Int64(2**40))
    assert ids(db, "small < id AND id < big") == [22]
    assert db.query_row("SELECT small + 1, id - 2, big + 1, ABS(id) FROM t") == (12, 20, 2**40 + 1, 22)
    assert [t for _, t in db.query("SELECT small + 1, id, big FROM t").dtypes] == ["smallint", "int", "bigint"]
    with pytest.raises(PySparkException):
        db.rows("SELECT small + 32767 FROM t")
    for bad in ("INSERT INTO t VALUES (1, 40000, 1)", "INSERT INTO t VALUES (1.0, 1, 1)", "INSERT INTO t VALUES ('1', 1, 1)"):
        with pytest.raises(ExecError, match="type mismatch"):
            db.exec(bad)
    with pytest.raises(ExecError, match="type mismatch"):
        db.exec("INSERT INTO t VALUES (?, 1, 1)", Int64(1))
    with pytest.raises(ExecError, match="integer out of range"):
        db.query("SELECT 2147483647 + 1")


def test_temporal(db, run):
    run("CREATE TABLE t (id INT, day DATE, at TIME, seen TIMESTAMP)", *(f"INSERT INTO t VALUES ({i}, '2026-04-{9 + i}', '13:45:{s}', '2026-04-10 13:4{m}:21')" for i, s, m in ((1, 21, 5), (2, 20, 5), (3, 22, 6))))
    assert ids(db, "day = '2026-04-10'") == [1] and ids(db, "at >= '13:45:21'") == [1, 3]
    assert ids(db, "seen = '2026-04-10 13:45:21'") == [1, 2] and ids(db, "seen > '2026-04-10 13:45:21'") == [3]
    assert db.rows("SELECT day, at, seen FROM t ORDER BY at DESC")[0] == (dt.date(2026, 4, 12), dt.time(13, 45, 22), dt.datetime(2026, 4, 10, 13, 46, 21))
    with pytest.raises(ExecError, match="type mismatch"):
        db.query("SELECT MAX(at) FROM t")


def test_timestamp_needs_a_zone(spark, tmp_path):
    from veldt.database import Database

    db = Database.create(spark, str(tmp_path / "x"))
    db.exec("CREATE TABLE t (seen TIMESTAMP)")
    with pytest.raises(ExecError, match="timezone"):
        db.exec("INSERT INTO t VALUES ('2026-04-10 13:45:21')")


def test_functions(db, run):
    run("CREATE TABLE t (id INT, name TEXT, x REAL)", "INSERT INTO t VALUES (-5, 'Éa', -2.5)")
    assert db.query_row("SELECT LENGTH(name), LOWER(name), UPPER(name), ABS(id), ABS(x), x - 1.0 FROM t") == (3, "éa", "ÉA", 5, 2.5, -3.5)
    assert ids(db, "LENGTH(name) = 3 AND (id + 10) > 4") == [-5]


def test_aggregates(db, run):
    run("CREATE TABLE t (id INT, name TEXT, score REAL, active BOOL)")
    assert db.query_row("SELECT COUNT(*), SUM(score), MIN(name), AVG(id) FROM t") == (0, None, None, None)
    run("INSERT INTO t VALUES (1, 'beta', 1.5, TRUE)", "INSERT INTO t VALUES (2, 'alpha', 2.5, NULL)", "INSERT INTO t VALUES (3, NULL, 3.0, NULL)")
    r = db.result("SELECT COUNT(name), AVG(score), SUM(id), MIN(name) AS low, MAX(score + score) FROM t")
    assert r.columns == ["COUNT(name)", "AVG(score)", "SUM(id)", "low", "MAX(score + score)"]
    assert r.df.collect()[0][:] == (2, 7.0 / 3, 6.0, "alpha", 6.0)
    assert db.query("SELECT COUNT(*) FROM t").columns == ["count"]
    for bad in ("SELECT COUNT(*), name FROM t", "SELECT COUNT(*) FROM t ORDER BY id", "SELECT SUM(*) FROM t", "SELECT SUM(id) + 1 FROM t", "SELECT MAX(COUNT(*)) FROM t", "SELECT MIN(active) FROM t", "SELECT SUM(name) FROM t"):
        with pytest.raises(EngineError):
            db.query(bad)


def test_names_types_and_order_by_alias(db, run):
    run("CREATE TABLE t (id INT, name TEXT)", "INSERT INTO t VALUES (1, 'b')", "INSERT INTO t VALUES (2, 'a')")
    r = db.result("SELECT id, name AS id2, id + 1 FROM t ORDER BY id2")
    assert r.columns == ["id", "id2", "id + 1"] and r.column_types == ["INT", "TEXT", ""] and [x[0] for x in r.df.collect()] == [2, 1]
    assert [x[0] for x in db.rows("SELECT name AS id FROM t ORDER BY id")] == ["a", "b"]
    with pytest.raises(ExecError, match="column not found: nope"):
        db.query("SELECT id FROM t WHERE nope = 1")
    with pytest.raises(ExecError, match="table not found: nope"):
        db.query("SELECT id FROM nope")
    with pytest.raises(ExecError):
        db.query("SELECT ID FROM t")


@pytest.fixture
def shop(run):
    run("CREATE TABLE customers (cust_nbr INT, name TEXT)", "CREATE TABLE orders (cust_nbr INT, order_nbr INT, total_amt INT)", "INSERT INTO customers VALUES (1, 'alice')", "INSERT INTO customers VALUES (2, 'bob')", "INSERT INTO customers VALUES (NULL, 'zoe')")
    run("INSERT INTO orders VALUES (1, 101, 75)", "INSERT INTO orders VALUES (1, 102, 25)", "INSERT INTO orders VALUES (2, 103, 60)", "INSERT INTO orders VALUES (NULL, 104, NULL)")


def test_joins(db, shop):
    comma = "SELECT a.cust_nbr, a.name, b.order_nbr, b.total_amt FROM customers a, orders b WHERE a.cust_nbr = b.cust_nbr AND b.order_nbr < 104 AND b.total_amt > 50 ORDER BY a.name"
    joined = "SELECT a.cust_nbr, a.name, b.order_nbr, b.total_amt FROM customers AS a INNER JOIN orders b ON b.cust_nbr = a.cust_nbr WHERE b.order_nbr < 104 AND b.total_amt > 50 ORDER BY a.name"
    assert db.rows(comma) == db.rows(joined) == [(1, "alice", 101, 75), (2, "bob", 103, 60)]
    assert db.result(comma).columns == ["a.cust_nbr", "a.name", "b.order_nbr", "b.total_amt"]
    assert db.rows("SELECT a.name, b.order_nbr FROM customers a JOIN orders b ON a.cust_nbr = b.cust_nbr WHERE a.name = 'zoe'") == [("zoe", 104)]
    assert db.query("SELECT * FROM customers a JOIN orders b ON a.cust_nbr = b.cust_nbr").columns == ["cust_nbr", "name", "cust_nbr", "order_nbr", "total_amt"]
    assert db.query_row("SELECT COUNT(*), SUM(b.order_nbr) FROM customers a JOIN orders b ON a.cust_nbr = b.cust_nbr") == (4, 410.0)
    assert sorted(db.rows("SELECT a.name, b.name FROM customers a JOIN customers b ON a.cust_nbr = b.cust_nbr")) == [("alice", "alice"), ("bob", "bob"), ("zoe", "zoe")]


def test_guards_look_at_matching_pairs_only(db, run):
    run("CREATE TABLE l (id INT)", "CREATE TABLE r (id INT, v INT)", "INSERT INTO l VALUES (1)", "INSERT INTO r VALUES (1, 5)", "INSERT INTO r VALUES (2, NULL)")
    assert db.rows("SELECT l.id FROM l JOIN r ON l.id = r.id WHERE r.v > 1") == [(1,)]


def test_join_shapes(db, shop):
    for bad in ("SELECT name FROM customers a, orders b WHERE a.name = 'x'", "SELECT name FROM customers a JOIN orders b ON a.cust_nbr > b.cust_nbr", "SELECT name FROM customers a JOIN orders b ON cust_nbr = b.cust_nbr"):
        with pytest.raises(PlanError, match="plan: unsupported query form"):
            db.query(bad)
    with pytest.raises(ExecError, match="column not found: cust_nbr"):
        db.query("SELECT cust_nbr FROM customers a JOIN orders b ON a.cust_nbr = b.cust_nbr")
    with pytest.raises(ExecError, match="type mismatch"):
        db.query("SELECT a.name FROM customers a JOIN orders b ON a.name = b.cust_nbr")


def test_query_row_and_usage(db, run):
    run("CREATE TABLE t (id INT)")
    with pytest.raises(NoRows):
        db.query_row("SELECT id FROM t")
    run("INSERT INTO t VALUES (1)", "INSERT INTO t VALUES (2)")
    with pytest.raises(MultipleRows):
        db.query_row("SELECT id FROM t")
    for bad in (lambda: db.query("DELETE FROM t"), lambda: db.exec("SELECT 1"), lambda: db.query("  ")):
        with pytest.raises(UsageError):
            bad()
    with pytest.raises(ExecError, match="unsupported query form"):
        db.exec("COMMIT")
    db.close()
    with pytest.raises(UsageError, match="closed"):
        db.query("SELECT 1")


def test_scan_gets_the_predicate(spark, db, tmp_path):
    spark.range(100).selectExpr("id AS a", "cast(id AS string) AS b", "array(id) AS c").write.parquet(str(tmp_path / "wide"))
    db.attach("wide", spark.read.parquet(str(tmp_path / "wide")), not_null=True)
    plan = db.query("SELECT a FROM wide WHERE a >= 90 AND a != 95")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a,90)" in plan and "ReadSchema: struct<a:bigint>" in plan
    with pytest.raises(ExecError):
        db.query("SELECT c FROM wide")
    with pytest.raises(ExecError, match="read-only"):
        db.exec("DELETE FROM wide")
