"""The grammar: what is taken, what is refused, and how literals are read."""

import datetime as dt

import pytest

from veldt import types as ty
from veldt.errors import BindError, ParseError
from veldt.operators.bind import bind
from veldt.sql import nodes as n
from veldt.sql.parser import parse


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT abc", "SELECT +1", "SELECT 1+2+3", "SELECT 1 +", "SELECT + 1", "SELECT 'a'+'b'", "SELECT 1 * 2", "SELECT 1*2", "SELECT ((1+2))", "SELECT (1+2", "SELECT 1+2)",
        "SELECT id, name users", "SELECT id name FROM users", 'SELECT "hello"', "SELECT 'hello world'", "SELECT 'open", "SELECT 1 2", "SELECT 2147483648", "BEGIN", "SELECT a.* FROM t a",
        "SELECT id FROM t GROUP BY id", "SELECT id FROM t LIMIT 1", "SELECT DISTINCT id FROM t", "SELECT id FROM a LEFT JOIN b ON a.x = b.x", "SELECT id FROM a, b, c",
        "SELECT id FROM t UNION SELECT id FROM t", "SELECT id FROM (SELECT id FROM t)", "UPDATE t SET a = 1, a = 2", "INSERT INTO t VALUES (1), (2)", "CREATE TABLE t (a INT, a INT)",
        "CREATE TABLE t (a INT NOT NULL DEFAULT NULL)", "CREATE TABLE t (a INT DEFAULT ?)", "CREATE INDEX i ON t (a, a)", "CREATE TABLE select (a INT)", "SELECT id FROM t ORDER BY 1",
    ],
)
def test_refused(sql):
    with pytest.raises(ParseError, match="^parse: unsupported query form$"):
        parse(sql)


@pytest.mark.parametrize("clause", ["id IS NULL", "id IN (1)", "id LIKE 'a'", "id BETWEEN 1 AND 2", "active", "id = 1 extra", "id = '2026/1/2'", "id ="])
def test_refused_where(clause):
    with pytest.raises(ParseError, match="^parse: invalid where clause$"):
        parse(f"SELECT id FROM t WHERE {clause}")


def test_refused_alter():
    with pytest.raises(ParseError, match="^parse: unsupported alter table form$"):
        parse("ALTER TABLE t RENAME COLUMN a TO b")


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("2026-04-10", ty.DATE, dt.date(2026, 4, 10)), ("13:45:21", ty.TIME, 49521), ("2026-04-10 13:45:21", ty.TIMESTAMP, dt.datetime(2026, 4, 10, 13, 45, 21)),
        ("hello", ty.TEXT, "hello"), ("2026-04", ty.TEXT, "2026-04"), (" x ", ty.TEXT, " x "), ("", ty.TEXT, ""),
    ],
)
def test_literals_are_classified(text, kind, value):
    assert ty.classify(text) == (kind, value)


@pytest.mark.parametrize("text", ["2026/1/2", "2026-1-2", "2026-04-10T13:45:21", "2026-02-30", "25:00:00", "1:2:3", " 2026-04-10", "2026-04-10 01:00:00 PM", "2026-04-10 1:2:3"])
def test_near_misses_of_temporal_literals(text):
    with pytest.raises(ParseError):
        ty.classify(text)


def test_precedence_and_labels():
    tree, _ = parse("SELECT a + 1 AS b, COUNT(*) FROM t WHERE NOT a = 1 AND b = 2 OR (c = 3)")
    assert isinstance(tree.where, n.Logic) and tree.where.op == "OR" and tree.where.left.op == "AND" and isinstance(tree.where.left.left, n.Not)
    assert [i.label for i in tree.items] == ["a + 1 AS b", "COUNT(*)"]


def test_commas_in_literals_and_parentheses_around_values():
    tree, _ = parse("SELECT LOWER('a,b'), x FROM t WHERE (a + 1) > 2 AND ((b) = c)")
    assert len(tree.items) == 2 and tree.where.left.op == ">"


def test_binding():
    tree, count = parse("SELECT a FROM t x JOIN u y ON x.a = y.a WHERE a = ? AND b = ?")
    bound = bind(tree, count, (ty.Int16(3), "2026-04-10"))
    assert bound.where.left.right == n.Lit(ty.SMALLINT, 3) and bound.where.right.right.kind == ty.DATE
    with pytest.raises(BindError, match="count"):
        bind(tree, count, (1,))
    with pytest.raises(BindError, match="unsupported placeholder argument type: list"):
        bind(tree, count, ([], 1))
    tree, count = parse("SELECT ? FROM t")
    with pytest.raises(BindError):
        bind(tree, count, (1,))
