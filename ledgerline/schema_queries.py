"""Queries of catalog slices, drift of catalogs and units, and ranges of time, over whole driver tables, with their SQL twins."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import catalog, parameters, ranges, schema, units
from ledgerline.queries import query, read
from ledgerline.rule_queries import _COLUMNS, _ROOT, TABLES, _catalog, _root

_KEYS = f"""SELECT c.table_name AS child, c.column_name AS child_column, min(k.table_name) AS parent, arg_min(k.column_name, k.table_name) AS key_column FROM ({_COLUMNS}) c JOIN ({_COLUMNS}) k
ON k.position = 1 AND c.position > 1 AND c.table_name <> k.table_name AND {_ROOT.format("c.column_name")} = {_ROOT.format("k.column_name")} GROUP BY 1, 2"""
_PATTERNS = ["ORD*", "*item", "no?such", "*e*s", "?a*", "*on"]


@query(f"""WITH RECURSIVE c AS ({_COLUMNS}), r AS (SELECT child, parent, 'Ref: ' || child || '.' || child_column || ' > ' || parent || '.' || key_column AS line FROM ({_KEYS})),
p(place, pattern, re) AS (VALUES (0, 'ORD*', '^ord.*$'), (1, '*item', '^.*item$'), (2, 'no?such', '^no.such$'), (3, '*e*s', '^.*e.*s$'), (4, '?a*', '^.a.*$'), (5, '*on', '^.*on$')),
b AS (SELECT table_name, 'Table ' || table_name || ' {{' || chr(10) || string_agg('  ' || column_name || ' ' || type, chr(10) ORDER BY position) || chr(10) || '}}' AS block FROM c GROUP BY 1),
x AS (SELECT child, sum(length(line) + 4) AS extra FROM r GROUP BY 1),
t AS (SELECT table_name, min(place) AS place, any_value(block) AS block, CAST(any_value(length(block)) + coalesce(any_value(extra), 0) AS BIGINT) AS size FROM b JOIN p ON regexp_matches(table_name, re) LEFT JOIN x ON child = table_name GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY place, table_name) AS i FROM t),
w(i, used, fits) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL SELECT o.i, CASE WHEN used + size <= 620 THEN used + size ELSE used END, used + size <= 620 FROM w JOIN o ON o.i = w.i + 1),
s AS (SELECT o.*, fits FROM o JOIN w USING (i)),
g AS (SELECT child, string_agg(l, chr(10) ORDER BY l) AS tail FROM (SELECT child, CASE WHEN parent IN (SELECT table_name FROM s WHERE fits) THEN '' ELSE '// ' END || line AS l FROM r) GROUP BY 1),
e AS (SELECT 'Enum string {{' || chr(10) || '  ' || string_agg(event_type, chr(10) || '  ' ORDER BY event_type) || chr(10) || '}}' AS block FROM (SELECT DISTINCT event_type FROM events))
SELECT pattern, table_name AS name, CASE WHEN fits THEN 'included' ELSE 'omitted' END AS status, size, CASE WHEN fits THEN concat_ws(chr(10), block, tail) END AS block FROM s JOIN p USING (place) LEFT JOIN g ON child = table_name
UNION ALL SELECT pattern, NULL, 'missing', NULL, NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE regexp_matches(table_name, re))
UNION ALL SELECT NULL, 'string', 'enum', length(block), block FROM e""")
def schema_slice(spark, sf_dir):
    columns = _catalog(spark, sf_dir)
    kinds = read(spark, sf_dir, "events").groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("values"))  # as many as there are types
    enums = kinds.select(F.lit("string").alias("enum_name"), "values").union(kinds.select(F.lit("colour"), "values"))
    return schema.sliced(columns, catalog.foreign_keys(columns, _root), _PATTERNS, 620, enums)


@query(f"""WITH c AS ({_COLUMNS}), k AS ({_KEYS}),
a AS (SELECT 'column' AS kind, table_name, column_name AS name, type AS definition FROM c UNION ALL SELECT 'reference', child, child_column, parent || '.' || key_column FROM k UNION ALL SELECT 'index', table_name, table_name || '_ix', column_name FROM c WHERE position = 1
UNION ALL SELECT 'routine', NULL, 'f_' || type, type FROM c),
z AS (SELECT 'column' AS kind, CASE table_name WHEN 'part' THEN 'parts' ELSE table_name END AS table_name, column_name AS name, replace(type, 'int', 'bigint') AS definition FROM c WHERE table_name <> 'region' AND NOT (position = 3 AND table_name > 'n')
UNION ALL SELECT 'reference', child, child_column, parent || '.' || CASE parent WHEN 'orders' THEN 'o_key' ELSE key_column END FROM k WHERE parent <> 'nation' UNION ALL SELECT 'index', table_name, table_name || '_ix', column_name FROM c WHERE position = CASE WHEN table_name < 'm' THEN 2 ELSE 1 END AND table_name NOT IN ('region', 'part')
UNION ALL SELECT 'routine', NULL, 'f_' || type, upper(type) FROM c WHERE type <> 'double'),
ta AS (SELECT DISTINCT table_name FROM a WHERE table_name IS NOT NULL), tz AS (SELECT DISTINCT table_name FROM z WHERE table_name IS NOT NULL),
one AS (SELECT coalesce(ta.table_name, tz.table_name) AS t, CASE WHEN ta.table_name IS NULL THEN 'added' ELSE 'removed' END AS status FROM ta FULL JOIN tz ON ta.table_name = tz.table_name WHERE ta.table_name IS NULL OR tz.table_name IS NULL),
da AS (SELECT DISTINCT * FROM a), dz AS (SELECT DISTINCT * FROM z),
d AS (SELECT 'table' AS kind, t AS table_name, t AS name, NULL AS before, NULL AS after, status FROM one
UNION ALL SELECT coalesce(da.kind, dz.kind), coalesce(da.table_name, dz.table_name), coalesce(da.name, dz.name), da.definition, dz.definition, CASE WHEN da.kind IS NULL THEN 'added' WHEN dz.kind IS NULL THEN 'removed' ELSE 'changed' END
FROM da FULL JOIN dz ON da.kind = dz.kind AND coalesce(da.table_name, '') = coalesce(dz.table_name, '') AND da.name = dz.name WHERE da.definition IS DISTINCT FROM dz.definition AND coalesce(da.table_name, dz.table_name, '') NOT IN (SELECT t FROM one)),
u AS (SELECT DISTINCT 's' || user_id AS statement, ([{", ".join(f"'{t}'" for t in TABLES)}])[CAST(event_id % 11 + 1 AS BIGINT)] AS t FROM events),
n AS (SELECT t, count(*) AS n, array_to_string(list_sort(list(statement))[:8], ', ') AS s FROM u GROUP BY 1)
SELECT kind, table_name, name, before, after, status, coalesce(n, 0) AS n_statements, coalesce(s, '') AS statements FROM d LEFT JOIN n ON t = table_name""")
def catalog_drift(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    k = catalog.foreign_keys(c, _root)

    state = lambda first, *more: reduce(DataFrame.union, more, first)
    index = lambda df: df.select(F.lit("index"), "table_name", F.concat("table_name", F.lit("_ix")), "column_name")
    routine = lambda df, body: df.select(F.lit("routine"), F.lit(None).cast("string"), F.concat(F.lit("f_"), "type"), body)
    before = state(
        c.select(F.lit("column").alias("kind"), "table_name", F.col("column_name").alias("name"), F.col("type").alias("definition")),
        k.select(F.lit("reference"), "child", "child_column", F.concat("parent", F.lit("."), "key_column")),
        index(c.where("position = 1")),
        routine(c, F.col("type")),
    )
    kept = c.where("table_name <> 'region' AND NOT (position = 3 AND table_name > 'n')")
    after = state(
        kept.select(F.lit("column").alias("kind"), F.when(F.col("table_name") == "part", "parts").otherwise(F.col("table_name")).alias("table_name"), F.col("column_name").alias("name"), F.replace("type", F.lit("int"), F.lit("bigint")).alias("definition")),
        k.where("parent <> 'nation'").select(F.lit("reference"), "child", "child_column", F.concat("parent", F.lit("."), F.when(F.col("parent") == "orders", "o_key").otherwise(F.col("key_column")))),
        index(c.where("position = CASE WHEN table_name < 'm' THEN 2 ELSE 1 END AND table_name NOT IN ('region', 'part')")),
        routine(c.where("type <> 'double'"), F.upper("type")),
    )
    table = F.element_at(F.array(*[F.lit(t.upper()) for t in TABLES]), (F.col("event_id") % 11 + 1).cast("int"))
    uses = read(spark, sf_dir, "events").select(F.concat(F.lit("s"), "user_id").alias("statement"), table.alias("table_name"))
    return schema.drifted(before, after, uses)


_HUNKS = """SELECT CAST(o_custkey % 50 AS VARCHAR) AS file, o_orderkey * 7 % 6100 AS old_lo, o_orderkey * 7 % 6100 + o_orderkey % 3 - 1 AS old_hi, o_orderkey % 6100 AS new_lo, o_orderkey % 6100 + o_orderkey % 4 - 1 AS new_hi, o_orderkey % 4 AS added, o_orderkey % 3 AS removed FROM orders
UNION ALL SELECT 's' || (s_suppkey % 3), s_suppkey, s_suppkey, s_suppkey, s_suppkey, 1, 1 FROM supplier"""
_AFTER = "SELECT CAST(p_partkey % 53 AS VARCHAR) AS file, CASE WHEN p_partkey % 4 = 0 THEN 'm.u' ELSE 'pkg.u' END || p_size AS unit, p_partkey * 3 % 5903 AS lo, p_partkey * 3 % 5903 + p_size % 9 AS hi FROM part WHERE p_partkey % 5 <> 0"
_BEFORE = "SELECT CAST(p_partkey % 53 AS VARCHAR) AS file, CASE WHEN p_partkey % 4 = 0 THEN 'm.u' ELSE 'pkg.u' END || p_size AS unit, p_partkey * 3 % 5903 + 2 AS lo, p_partkey * 3 % 5903 + 2 + p_size % 9 AS hi FROM part WHERE p_partkey % 7 <> 0"
_UNITS = f"""WITH h AS (SELECT *, row_number() OVER () AS hid FROM ({_HUNKS})), a AS ({_AFTER}), b AS ({_BEFORE}),
n AS (SELECT DISTINCT h.file, hid, unit FROM h JOIN a ON h.file = a.file AND new_lo <= hi AND lo <= new_hi AND new_lo <= new_hi),
o AS (SELECT DISTINCT h.file, unit FROM h JOIN b ON h.file = b.file AND old_lo <= hi AND lo <= old_hi AND old_lo <= old_hi WHERE hid NOT IN (SELECT hid FROM n)),
t AS (SELECT file, unit FROM n UNION SELECT file, unit FROM o), g AS (SELECT file, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM h GROUP BY 1)
SELECT g.file, t.unit, CASE WHEN t.unit IS NULL THEN 'common' WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.file = t.file AND b.unit = t.unit) THEN 'new' WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.file = t.file AND a.unit = t.unit) THEN 'removed' ELSE 'changed' END AS status, added, removed FROM g LEFT JOIN t ON g.file = t.file"""


def _diff(spark, sf_dir):
    hunks = read(spark, sf_dir, "orders").selectExpr("CAST(o_custkey % 50 AS STRING) AS file", "o_orderkey * 7 % 6100 AS old_lo", "o_orderkey * 7 % 6100 + o_orderkey % 3 - 1 AS old_hi", "o_orderkey % 6100 AS new_lo", "o_orderkey % 6100 + o_orderkey % 4 - 1 AS new_hi", "o_orderkey % 4 AS added", "o_orderkey % 3 AS removed")
    hunks = hunks.union(read(spark, sf_dir, "supplier").selectExpr("'s' || (s_suppkey % 3)", "s_suppkey", "s_suppkey", "s_suppkey", "s_suppkey", "1", "1"))
    name = "CASE WHEN p_partkey % 4 = 0 THEN 'm.u' ELSE 'pkg.u' END || p_size AS unit"
    place = lambda keep, shift: read(spark, sf_dir, "part").where(keep).selectExpr("CAST(p_partkey % 53 AS STRING) AS file", name, f"p_partkey * 3 % 5903 + {shift} AS lo", f"p_partkey * 3 % 5903 + {shift} + p_size % 9 AS hi")
    return hunks, place("p_partkey % 7 <> 0", 2), place("p_partkey % 5 <> 0", 0)


@query(_UNITS)
def drift_units(spark, sf_dir):
    return units.changed_units(*_diff(spark, sf_dir))


@query(f"""WITH u AS (SELECT DISTINCT file, unit FROM ({_UNITS})), l0 AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'pkg.u' || (c_custkey % 20) WHEN 1 THEN 'x.u' || (15 + c_custkey % 20) ELSE 'other' END AS name, 'c' || c_nationkey AS screen FROM customer),
l AS (SELECT name, screen FROM l0 UNION SELECT string_split(name, '.')[-1], screen FROM l0), f AS (SELECT DISTINCT CAST(s_suppkey % 60 AS VARCHAR) AS file, 'f' || s_nationkey AS screen FROM supplier),
c AS (SELECT u.file, u.unit, screen, 1 AS tier FROM u JOIN l ON unit = name UNION SELECT u.file, u.unit, screen, 2 FROM u JOIN l ON string_split(unit, '.')[-1] = name UNION SELECT u.file, u.unit, screen, 3 FROM u JOIN f ON u.file = f.file),
m AS (SELECT file, unit, min(tier) AS best FROM c GROUP BY ALL)
SELECT u.file, u.unit, c.screen, CASE c.tier WHEN 1 THEN 'name' WHEN 2 THEN 'bare name' WHEN 3 THEN 'file' END AS by FROM u LEFT JOIN (c JOIN m ON c.file = m.file AND c.unit IS NOT DISTINCT FROM m.unit AND c.tier = m.best) ON u.file = c.file AND u.unit IS NOT DISTINCT FROM c.unit""")
def unit_screens(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("pkg.u"), F.col("c_custkey") % 20)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("x.u"), 15 + F.col("c_custkey") % 20)).otherwise("other")
    unit_links = read(spark, sf_dir, "customer").select(name.alias("name"), F.concat(F.lit("c"), "c_nationkey").alias("screen"))
    file_links = read(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey % 60 AS STRING) AS file", "'f' || s_nationkey AS screen")
    return units.screens_of(units.changed_units(*_diff(spark, sf_dir)), unit_links, file_links)


@query("SELECT event_type, count(*) AS n, min(ts) AS first_at FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_id % 97 = 5) GROUP BY 1")
def log_since_start(spark, sf_dir):
    message = F.when(F.col("event_id") % 97 == 5, F.lit("Started Shop in 3.2 seconds (JVM 4.0)")).otherwise("Started Shop soon")
    records = read(spark, sf_dir, "events").withColumn("message", message)
    first, last = ranges.resolve(datetime.now(ZoneInfo("UTC")), deployed=ranges.last_start(records, "ts", "message"))
    return ranges.between(records, "ts", first, last).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))


@query("SELECT event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:30:00' AND TIMESTAMP '2024-01-05 01:15:30' GROUP BY 1")
def log_range(spark, sf_dir):
    now = datetime(2024, 1, 5, 12, 0, tzinfo=ZoneInfo("Asia/Seoul"))
    first, last = ranges.resolve(now, start="2024-01-02 09:30", end="10:15:30")
    return ranges.between(read(spark, sf_dir, "events"), "ts", first, last).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""WITH p AS (SELECT 's' || p_partkey AS statement, unnest(['custKey', 'status', 'day', 'companyId', 'segment', 'startDate', 'fiscalYear', 'runMode', 'thing']) AS name, p_partkey, p_size FROM part),
g AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 700 + 1 END AS cust FROM part),
o AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS day FROM orders GROUP BY 1), f AS (SELECT o_custkey, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderkey LIMIT 1),
c AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 7), d AS (SELECT * FROM c ORDER BY c_custkey LIMIT 1),
v AS (SELECT p.statement, p.name, CASE p.name WHEN 'custKey' THEN CASE WHEN cust IS NOT NULL THEN 'given' ELSE 'sample' END WHEN 'companyId' THEN 'company' WHEN 'startDate' THEN 'rule' WHEN 'fiscalYear' THEN 'rule' WHEN 'thing' THEN 'none'
WHEN 'status' THEN CASE WHEN cust IS NULL OR o.status IS NOT NULL THEN 'sample' ELSE 'none' END WHEN 'day' THEN CASE WHEN cust IS NULL OR o.status IS NOT NULL THEN 'sample' ELSE 'none' END WHEN 'segment' THEN CASE WHEN cust IS NULL OR c.c_custkey IS NOT NULL THEN 'sample' ELSE 'none' END
ELSE CASE WHEN p_size < 20 THEN 'constant' ELSE 'none' END END AS source, cust, p_size, coalesce(o.status, CASE WHEN cust IS NULL THEN f.status END) AS status, coalesce(o.day, CASE WHEN cust IS NULL THEN f.day END) AS day, coalesce(c.c_mktsegment, CASE WHEN cust IS NULL THEN d.c_mktsegment END) AS segment, d.c_custkey AS first_customer
FROM p JOIN g USING (p_partkey) LEFT JOIN o ON o.o_custkey = cust LEFT JOIN c ON c.c_custkey = cust LEFT JOIN f ON true LEFT JOIN d ON true)
SELECT statement, name, CASE WHEN source = 'none' THEN '?' ELSE CASE name WHEN 'custKey' THEN CAST(coalesce(cust, first_customer) AS VARCHAR) WHEN 'companyId' THEN '7' WHEN 'startDate' THEN '2000-01-01' WHEN 'fiscalYear' THEN '2024' WHEN 'status' THEN status WHEN 'day' THEN day WHEN 'segment' THEN segment ELSE 'full' || p_size END END AS value, source,
CASE source WHEN 'sample' THEN CASE name WHEN 'custKey' THEN 'customer.c_custkey' WHEN 'status' THEN 'orders.o_orderstatus' WHEN 'day' THEN 'orders.o_orderdate' ELSE 'customer.c_mktsegment' END WHEN 'constant' THEN 'MODE' END AS origin FROM v""")
def statement_parameters(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    statement = F.concat(F.lit("s"), "p_partkey").alias("statement")
    names = ("custKey", "status", "day", "companyId", "segment", "startDate", "fiscalYear", "runMode", "thing")
    places = [("custKey", "orders", "o_custkey"), ("status", "orders", "o_orderstatus"), ("day", "orders", "o_orderdate"), ("custKey", "customer", "c_custkey"), ("segment", "customer", "c_mktsegment"), ("thing", "orders", "no_such")]
    params = part.select(statement, F.explode(F.array(*map(F.lit, names))).alias("name"))
    compared = part.select(statement, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for n, t, c in places])))
    given = part.where("p_partkey % 3 = 0").select(statement, F.lit("custKey").alias("name"), (F.col("p_partkey") % 700 + 1).cast("string").alias("value"))
    constants = part.where("p_size < 20").select(statement, F.lit("MODE").alias("key"), F.concat(F.lit("full"), "p_size").alias("value"))
    samples = {"orders": (read(spark, sf_dir, "orders"), "o_orderkey", None), "customer": (read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")}
    return parameters.inferred(params, given, compared, samples, constants, [("^start_?date$", "2000-01-01"), ("year", "2024")], "7")
