"""Statements that the gateway lets through and those it refuses."""

import pytest
from pyspark.errors import AnalysisException

from ledgerline.plans import gateway

READS = [
    "SELECT 1", "select * from gate_t where load > 1", "SELECT `set`, use FROM gate_w", "WITH x AS (SELECT 1 AS a) SELECT * FROM x", "VALUES (1), (2)", "TABLE gate_t", "(SELECT 1) UNION ALL (SELECT 2)",
    "-- drop it\nSELECT 1", "/* insert */ SELECT 'insert into t; drop table t' AS a", "SELECT 1;", "  SELECT 1 ;  ", "SELECT r'\\' AS a", "SELECT 'it''s' AS delete", "SELECT load FROM gate_t ORDER BY load LIMIT 1",
    "SELECT count(*) OVER (PARTITION BY load) AS c FROM gate_t", "SELECT a.load FROM gate_t a JOIN gate_t b ON a.load = b.load", "SHOW TABLES", "DESCRIBE gate_t", "EXPLAIN SELECT 1", "SELECT * FROM gate_t -- the end", "WITH x AS (SELECT 1) SELECT * FROM x, (SELECT 2) y",
]
REFUSED = [
    "INSERT INTO gate_s SELECT 'b'", "WITH x AS (SELECT r'\\' AS a) INSERT INTO gate_s SELECT 'b'", "WITH x AS (SELECT 1) INSERT INTO gate_s SELECT 'b' -- '", "FROM gate_t INSERT INTO gate_s SELECT 'b'", "DROP TABLE gate_s", "CREATE TABLE z AS SELECT 1", "DELETE FROM gate_s", "UPDATE gate_s SET a = 'x'",
    "TRUNCATE TABLE gate_s", "SET spark.sql.ansi.enabled = false", "RESET", "USE default", "REFRESH TABLE gate_s", "CACHE TABLE gate_s", "ADD JAR 'x.jar'", "SELECT 1; DROP TABLE gate_s", "SELECT 1; SELECT 2", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT try_reflect('java.lang.System', 'exit', 0)", "SELECT identifier('ref' || 'lect')('java.lang.System', 'exit', 0)", "SELECT TRANSFORM (load) USING 'cat' AS (b STRING) FROM gate_t",
    "BEGIN SELECT 1; END", "MERGE INTO gate_s USING gate_t ON true WHEN MATCHED THEN DELETE", "", "   ", "-- nothing", "EXPLAIN SELECT 1; DROP TABLE gate_s", "SELECT 1) x; DROP TABLE gate_s --", "/* SELECT */ DROP TABLE gate_s", "SELECT 1 /* open", "ALTER TABLE gate_s ADD COLUMNS (b INT)",
]


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    spark.createDataFrame([(1,), (2,)], "load int").createOrReplaceTempView("gate_t")
    spark.createDataFrame([(1, 2)], "`set` int, use int").createOrReplaceTempView("gate_w")
    spark.sql("CREATE TABLE IF NOT EXISTS gate_s (a STRING) USING parquet")
    yield
    spark.sql("DROP TABLE IF EXISTS gate_s")


@pytest.mark.parametrize("statement", READS)
def test_lets_through(spark, statement):
    assert gateway.run(spark, statement).collect() is not None


@pytest.mark.parametrize("statement", REFUSED)
def test_refuses(spark, statement):
    with pytest.raises(ValueError, match="statement"):
        gateway.run(spark, statement)
    assert spark.table("gate_s").count() == 0


def test_files_are_no_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    for text in (f"SELECT * FROM parquet.`{tmp_path}/x`", f"SELECT (SELECT max(id) FROM `parquet`.`{tmp_path}/x`)"):
        with pytest.raises(AnalysisException):
            gateway.run(spark, text)
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_arguments_and_tables(spark):
    got = gateway.run(spark, "SELECT sum(id) AS s FROM {t} WHERE id > :least", {"least": 1}, t=spark.range(4))
    assert gateway.scalar(got) == 5
    with pytest.raises(ValueError, match="statement"):
        gateway.run(spark, "WITH x AS (SELECT 1) INSERT INTO gate_s SELECT 'b' FROM {t}", t=spark.range(4))
