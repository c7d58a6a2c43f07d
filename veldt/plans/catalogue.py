"""The registered queries over the driver's tables, each with the SQL that another engine runs for the same rows."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.database import Database
from veldt.plans.scenarios import scenarios
from veldt.types import Int32, Int64

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations"]

#: Folders of databases that hold nothing but the catalog, one for each Spark application.
_folders: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a database: in the shared folder of the cluster, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            for old in _folders.values():
                shutil.rmtree(old, ignore_errors=True)
            _folders.clear()
            _folders[app] = tempfile.mkdtemp(prefix="veldt-db-")
        root = _folders[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _attached(spark: SparkSession, sf_dir: str, tables: list[str]) -> Database:
    db = Database.create(spark, _folder(spark, "attached"))
    # The driver's tables hold no nulls, which lets predicates go to the scan without guards.
    db.attach_folder(sf_dir, tables, not_null=True)
    return db


def _names(sql: str) -> list[str]:
    words = sql.replace(",", " ").split()
    return [t for t in TABLES if t in words]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits after the point: sums of doubles depend on the order of adding."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _run(sql: str, *args, names: list[str] | None = None, rounded: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _attached(spark, sf_dir, _names(sql)).query(sql, *args)
        df = df.toDF(*names) if names else df
        return _rounded(df) if rounded else df

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, oracle: str | None = None, *args, names: list[str] | None = None, rounded: bool = False) -> None:
    QUERIES[name] = _run(sql, *args, names=names, rounded=rounded)
    SQL[name] = oracle or sql


_JOIN = "FROM customer a INNER JOIN orders b ON a.c_custkey = b.o_custkey"

_add("scan_star", "SELECT * FROM region")
_add("project_alias", "SELECT n_name AS nation, n_regionkey FROM nation")
_add("project_qualified", "SELECT nation.n_name, nation.n_nationkey FROM nation", "SELECT n_name, n_nationkey FROM nation", names=["n_name", "n_nationkey"])
_add("filter_int_eq", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 15")
_add("filter_int_ne", "SELECT p_partkey, p_size FROM part WHERE p_size != 15")
_add("filter_int_range", "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 20")
_add("filter_real", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.05")
_add("filter_text_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'building'", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
_add("filter_text_range", "SELECT p_partkey, p_type FROM part WHERE p_type < 'medium'", "SELECT p_partkey, p_type FROM part WHERE lower(p_type) < 'medium'")
_add("filter_timestamp", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1998-01-01 00:00:00'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
_add("filter_timestamp_between", "SELECT event_id, ts FROM events WHERE ts >= '2024-01-05 00:00:00' AND ts < '2024-01-06 00:00:00'", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
_add(
    "filter_not_or_prec",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'A' OR l_linestatus = 'o') AND l_quantity < 10.0",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (lower(l_returnflag) = 'a' OR lower(l_linestatus) = 'o') AND l_quantity < 10.0",
)
_add("filter_col_col", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount = l_tax")
_add("filter_func", "SELECT n_nationkey, n_name FROM nation WHERE LENGTH(n_name) > 8", "SELECT n_nationkey, n_name FROM nation WHERE strlen(n_name) > 8")
_add("filter_arith", "SELECT p_partkey, p_size FROM part WHERE p_size + 5 > 50 - 3", "SELECT p_partkey, p_size FROM part WHERE p_size + 5 > 47")
_add("filter_null_eq", "SELECT c_custkey, c_name FROM customer WHERE c_name = NULL", "SELECT c_custkey, c_name FROM customer WHERE c_name IS NULL")
_add("filter_null_ne", "SELECT c_custkey, c_name FROM customer WHERE c_name != NULL", "SELECT c_custkey, c_name FROM customer WHERE c_name IS NOT NULL")
_add("filter_angle_ne", "SELECT r_regionkey FROM region WHERE r_name <> 'asia'", "SELECT r_regionkey FROM region WHERE lower(r_name) <> 'asia'")
_add("arith_int", "SELECT o_orderkey + 1 AS next_key, o_orderkey - 10 AS before FROM orders")
_add("arith_real", "SELECT l_orderkey, l_linenumber, l_extendedprice - l_tax AS net FROM lineitem")
_add("abs_", "SELECT c_custkey, ABS(c_acctbal) AS bal FROM customer")
_add("lower_", "SELECT c_custkey, LOWER(c_name) AS name FROM customer")
_add("upper_", "SELECT p_partkey, UPPER(p_name) AS name FROM part")
_add("length_bytes", "SELECT doc_id, LENGTH(text) AS n FROM documents", "SELECT doc_id, strlen(text) AS n FROM documents")
_add("order_multi", "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem ORDER BY l_shipdate DESC, l_extendedprice, l_orderkey")
_add("order_alias", "SELECT c_custkey, c_acctbal AS balance FROM customer ORDER BY balance DESC, c_custkey")
_add("order_text_ci", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey DESC")
_add("order_unprojected", "SELECT s_name FROM supplier ORDER BY s_acctbal")
_add("join_explicit", f"SELECT a.c_custkey, a.c_name, b.o_orderkey {_JOIN}", f"SELECT a.c_custkey, a.c_name, b.o_orderkey {_JOIN}", names=["c_custkey", "c_name", "o_orderkey"])
_add("join_swapped_on", "SELECT a.c_custkey, b.o_orderkey FROM customer AS a JOIN orders AS b ON b.o_custkey = a.c_custkey", names=["c_custkey", "o_orderkey"])
_add(
    "join_comma",
    "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND l.l_quantity >= 30.0",
    names=["o_orderkey", "l_linenumber", "l_quantity"],
)
_add("join_star", "SELECT * FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey")
_add(
    "join_filter_order",
    f"SELECT a.c_custkey, a.c_name, b.o_orderkey, b.o_totalprice {_JOIN} WHERE b.o_totalprice > 400000.0 ORDER BY a.c_name DESC, b.o_totalprice",
    names=["c_custkey", "c_name", "o_orderkey", "o_totalprice"],
)
_add("join_expr", f"SELECT LOWER(a.c_name), b.o_orderkey + 1 {_JOIN}", f"SELECT lower(a.c_name) AS name, b.o_orderkey + 1 AS next_key {_JOIN}", names=["name", "next_key"])
_add("count_star", "SELECT COUNT(*) FROM lineitem", 'SELECT count(*) AS "count" FROM lineitem')
_add("count_expr", "SELECT COUNT(c_name) AS n FROM customer")
_add("count_where", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'f'", "SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus) = 'f'")
_add("join_count", f"SELECT COUNT(*) {_JOIN}", f'SELECT count(*) AS "count" {_JOIN}')
_add("min_max_int", "SELECT MIN(p_size) AS low, MAX(p_size) AS high FROM part")
_add("min_max_real", "SELECT MIN(c_acctbal) AS low, MAX(c_acctbal) AS high FROM customer")
_add("min_max_text", "SELECT MIN(p_name) AS low, MAX(p_name) AS high FROM part", "SELECT arg_min(p_name, lower(p_name)) AS low, arg_max(p_name, lower(p_name)) AS high FROM part")
_add("sum_int", "SELECT SUM(p_size) AS total FROM part", "SELECT sum(CAST(p_size AS DOUBLE)) AS total FROM part")
_add("sum_real", "SELECT SUM(l_discount) AS total FROM lineitem", "SELECT round(sum(l_discount), 6) AS total FROM lineitem", rounded=True)
_add("avg_int", "SELECT AVG(p_size) AS mean FROM part", "SELECT round(avg(p_size), 6) AS mean FROM part", rounded=True)
_add("avg_real", "SELECT AVG(l_discount) AS mean FROM lineitem", "SELECT round(avg(l_discount), 6) AS mean FROM lineitem", rounded=True)
_add(
    "multi_agg",
    "SELECT COUNT(*) AS n, COUNT(l_quantity) AS m, MIN(l_extendedprice) AS low, SUM(l_quantity) AS total, AVG(l_tax) AS tax, MAX(l_linenumber) AS high FROM lineitem",
    "SELECT count(*) AS n, count(l_quantity) AS m, round(min(l_extendedprice), 6) AS low, round(sum(l_quantity), 6) AS total, round(avg(l_tax), 6) AS tax, max(l_linenumber) AS high FROM lineitem",
    rounded=True,
)
_add("agg_expr", "SELECT MAX(LENGTH(p_name)) AS longest, SUM(p_size + p_size) AS twice, MIN(ABS(p_size - 25)) AS near FROM part", "SELECT max(strlen(p_name)) AS longest, sum(CAST(p_size + p_size AS DOUBLE)) AS twice, min(abs(p_size - 25)) AS near FROM part")
_add("join_agg", f"SELECT SUM(b.o_totalprice), COUNT(*) {_JOIN} WHERE a.c_acctbal < 0.0", f"SELECT round(sum(b.o_totalprice), 2) AS total, count(*) AS n {_JOIN} WHERE a.c_acctbal < 0.0", names=["total", "n"])
QUERIES["join_agg"] = (lambda run: lambda spark, d: run(spark, d).select(F.round("total", 2).alias("total"), "n"))(QUERIES["join_agg"])
_add("agg_empty", "SELECT COUNT(*) AS n, MAX(p_size) AS high, SUM(p_size) AS total FROM part WHERE p_size < 0", "SELECT count(*) AS n, max(p_size) AS high, sum(CAST(p_size AS DOUBLE)) AS total FROM part WHERE p_size < 0")
_add("bind_params", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = ? AND c_mktsegment != ?", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 5 AND lower(c_mktsegment) <> 'machinery'", Int32(5), "Machinery")
_add("bind_bigint", "SELECT o_orderkey FROM orders WHERE o_orderkey >= ?", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 14000", Int64(14000))
_add("literal_select", "SELECT 10+-3", "SELECT CAST(7 AS BIGINT) AS value")


# Managed tables: seeded from the driver's, changed by statements, then read


def _managed(spark: SparkSession, *statements: str) -> Database:
    db = Database.create(spark, _folder(spark, "managed"), timezone="UTC")
    for s in statements:
        db.exec(s)
    return db


_REGIONS = "CREATE TABLE regions (id INT, label TEXT, CONSTRAINT pk_regions PRIMARY KEY (id) USING INDEX regions_pk)"
_NATIONS = (
    "CREATE TABLE nations (id INT, label TEXT, region_id INT, CONSTRAINT pk_nations PRIMARY KEY (id) USING INDEX nations_pk, "
    "CONSTRAINT fk_region FOREIGN KEY (region_id) REFERENCES regions (id) USING INDEX nations_region ON DELETE CASCADE)"
)


def _seeded(spark: SparkSession, sf_dir: str, nations: bool = True) -> Database:
    """regions and nations with the rows of the driver's two smallest tables, which never grow."""
    db = _managed(spark, _REGIONS, *([_NATIONS] if nations else []))
    db.load("regions", spark.read.parquet(f"{sf_dir}/region.parquet").toDF("id", "label"))
    if nations:
        db.load("nations", spark.read.parquet(f"{sf_dir}/nation.parquet").toDF("id", "label", "region_id"))
    return db


def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _seeded(spark, sf_dir)
    db.exec("UPDATE nations SET label = 'moved', region_id = 0 WHERE region_id = 3 OR id < 4")
    return db.query("SELECT id, label, region_id FROM nations")


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _seeded(spark, sf_dir)
    db.exec("DELETE FROM nations WHERE id > 7 AND region_id != 2")
    return db.query("SELECT id, label, region_id FROM nations")


def _delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _seeded(spark, sf_dir)
    db.exec("DELETE FROM regions WHERE label = 'asia' OR id = 0")
    return db.query("SELECT id, label FROM nations")


def _insert_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _managed(spark, "CREATE TABLE sensors (code INT NOT NULL, unit TEXT DEFAULT 'kelvin', working BOOL NOT NULL DEFAULT FALSE, reading REAL)")
    db.exec("INSERT INTO sensors (code) VALUES (40)")
    db.exec("INSERT INTO sensors VALUES (40 + 2, NULL, TRUE, 273.15)")
    return db.query("SELECT * FROM sensors")


def _transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _seeded(spark, sf_dir, nations=False)
    tx = db.begin()
    tx.exec("UPDATE regions SET label = 'renamed' WHERE id = 1")
    tx.exec("INSERT INTO regions VALUES (99, 'new')")
    tx.commit()
    tx = db.begin()
    tx.exec("DELETE FROM regions")
    tx.rollback()
    return db.query("SELECT id, label FROM regions")


def _add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _seeded(spark, sf_dir, nations=False)
    db.exec("ALTER TABLE regions ADD COLUMN note TEXT DEFAULT 'old'")
    db.exec("INSERT INTO regions VALUES (99, 'new', NULL)")
    return db.query("SELECT id, label, note FROM regions")


def _text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _attached(spark, sf_dir, [])
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    db.attach("r", region.select(F.initcap(F.lower("r_name")).alias("tag"), "r_regionkey"), True)
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    db.attach("n", named.select("n_name", F.lower("r_name").alias("tag")), True)
    return db.query("SELECT n.n_name, r.r_regionkey FROM r JOIN n ON r.tag = n.tag").toDF("n_name", "r_regionkey")


def _null_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are null meet: every third nation has none."""
    db = _attached(spark, sf_dir, [])
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    keyed = nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("k"))
    db.attach("a", keyed)
    db.attach("b", keyed.withColumnRenamed("n_nationkey", "other"))
    return db.query("SELECT a.n_nationkey, b.other FROM a JOIN b ON a.k = b.k").toDF("n_nationkey", "other")


def _sys_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir).query("SELECT t.table_name, c.column_name, c.column_type, c.ordinal_position FROM sys_tables t JOIN sys_tb_columns c ON t.table_id = c.table_id").toDF("table_name", "column_name", "column_type", "ordinal_position")


def _sys_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir).query("SELECT i.index_name, i.is_unique, c.column_name FROM sys_indexes i JOIN sys_ix_columns c ON i.index_id = c.index_id").toDF("index_name", "is_unique", "column_name")


for _name, _query, _oracle in (
    ("update_", _update, "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 3 OR n_nationkey < 4 THEN 'moved' ELSE n_name END AS label, CASE WHEN n_regionkey = 3 OR n_nationkey < 4 THEN 0 ELSE n_regionkey END AS region_id FROM nation"),
    ("delete_", _delete, "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS region_id FROM nation WHERE NOT (n_nationkey > 7 AND n_regionkey <> 2)"),
    ("delete_cascade", _delete_cascade, "SELECT n_nationkey AS id, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT (lower(r_name) = 'asia' OR r_regionkey = 0)"),
    ("insert_default", _insert_default, "SELECT * FROM (VALUES (40, 'kelvin', FALSE, CAST(NULL AS DOUBLE)), (42, NULL, TRUE, 273.15)) AS t(code, unit, working, reading)"),
    ("transaction_", _transaction, "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS label FROM region UNION ALL SELECT 99, 'new'"),
    ("alter_add_column", _add_column, "SELECT r_regionkey AS id, r_name AS label, 'old' AS note FROM region UNION ALL SELECT 99, 'new', NULL"),
    ("join_text_key", _text_key, "SELECT n_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey"),
    ("join_null_key", _null_join, "WITH k AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END AS k FROM nation) SELECT a.n_nationkey, b.n_nationkey AS other FROM k a JOIN k b ON a.k IS NOT DISTINCT FROM b.k"),
    ("sys_tables", _sys_tables, "SELECT * FROM (VALUES ('regions', 'id', 'INT', 1), ('regions', 'label', 'TEXT', 2), ('nations', 'id', 'INT', 1), ('nations', 'label', 'TEXT', 2), ('nations', 'region_id', 'INT', 3)) AS t(table_name, column_name, column_type, ordinal_position)"),
    ("sys_indexes", _sys_indexes, "SELECT * FROM (VALUES ('regions_pk', TRUE, 'id'), ('nations_pk', TRUE, 'id'), ('nations_region', FALSE, 'region_id')) AS t(index_name, is_unique, column_name)"),
):
    QUERIES[_name], SQL[_name] = _query, _oracle

for _name, (_query, _oracle) in scenarios(lambda spark, d: _managed(spark), lambda spark, d: _seeded(spark, d, nations=False), _seeded, lambda spark, d: _attached(spark, d, [])).items():
    QUERIES[_name], SQL[_name] = _query, _oracle
