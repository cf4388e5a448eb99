"""Registry of the library's queries on the driver tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators import catalog, compare, integrity, lineage, logs, profile, retrieval
from ledgerline.plans import gateway
from ledgerline.shared import shared_dir
from ledgerline.sources import files
from ledgerline.streaming import events

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def columns_of(spark, sf_dir, tables):
    return catalog.scan(spark, {t: read(spark, sf_dir, t) for t in tables})


_ROOT = "regexp_replace({}, '^[a-z]+_', '')"
_SCHEMA = "SELECT table_name, column_name, " + _ROOT.format("column_name") + " AS c, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS t, ordinal_position AS i FROM information_schema.columns"


@query("SELECT count(DISTINCT o_orderstatus) AS n_distinct, count(*) FILTER (WHERE o_orderstatus IS NULL) AS n_null, count(*) AS n_rows FROM orders")
def column_profile(spark, sf_dir):
    return profile.column_profile(read(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 HAVING (SELECT count(DISTINCT o_orderpriority) FROM orders) <= 30 ORDER BY n DESC, value LIMIT 30")
def value_distribution(spark, sf_dir):
    return profile.value_distribution(read(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, bool_or(value > 400) AS any_large FROM events GROUP BY 1")
def code_usage(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.bool_or(F.col("value") > 400).alias("any_large"))


@query("SELECT r_name, count(n_nationkey) AS n_codes FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def code_kind_left_count(spark, sf_dir):
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    return r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n_codes"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def orphans_orders(spark, sf_dir):
    parent = read(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return integrity.orphans(read(spark, sf_dir, "orders"), "o_custkey", parent, "c_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT 'orders.o_custkey' AS relation, count(*) AS n_orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT 'lineitem.l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
UNION ALL SELECT 'nation.n_regionkey', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""")
def orphans_summary(spark, sf_dir):
    r = lambda t: read(spark, sf_dir, t)
    return integrity.orphan_summary([("orders.o_custkey", r("orders"), "o_custkey", r("customer").where("c_acctbal >= 0"), "c_custkey"), ("lineitem.l_suppkey", r("lineitem"), "l_suppkey", r("supplier").where("s_acctbal >= 0"), "s_suppkey"), ("nation.n_regionkey", r("nation"), "n_regionkey", r("region"), "r_regionkey")])


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query(f"""SELECT a.table_name, a.column_name, b.table_name AS parent, b.column_name AS key_column FROM (SELECT * FROM information_schema.columns WHERE table_name IN {_TABLES}) a JOIN (SELECT * FROM information_schema.columns WHERE table_name IN {_TABLES} AND ordinal_position = 1) b
ON {_ROOT.format("a.column_name")} = {_ROOT.format("b.column_name")} AND a.table_name <> b.table_name AND length({_ROOT.format("a.column_name")}) >= 4""")
def fk_inference(spark, sf_dir):
    c = columns_of(spark, sf_dir, _TABLES)
    keys = c.where("position = 1").select(F.col("table_name").alias("parent"), F.col("column_name").alias("key_column"))
    return integrity.infer_foreign_keys(c.select("table_name", "column_name"), keys)


@query("""SELECT o_orderstatus AS name, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01') AS expected, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-06-01') AS actual,
CASE WHEN count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01') = 0 AND count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-06-01') = 0 THEN 'skip'
WHEN count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1995-06-01') = count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-06-01') THEN 'ok' ELSE 'fail' END AS status FROM orders GROUP BY 1""")
def batch_compare(spark, sf_dir):
    early = F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")
    c = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count_if(early).alias("expected"), F.count_if(~early).alias("actual"))
    return c.withColumn("status", compare.verdict(F.col("expected"), F.col("actual")))


@query("""WITH b AS (SELECT event_id, CASE WHEN value > 300 THEN 'large ' || event_type ELSE event_type END AS event_type FROM events)
SELECT event_id, event_type, 'left' AS side FROM (SELECT event_id, event_type FROM events EXCEPT ALL SELECT * FROM b) UNION ALL SELECT event_id, event_type, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT event_id, event_type FROM events)""")
def row_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    after = F.when(F.col("value") > 300, F.concat(F.lit("large "), "event_type")).otherwise(F.col("event_type"))
    return compare.row_diff(e.select("event_id", "event_type"), e.select("event_id", after.alias("event_type")))


@query(f"""SELECT coalesce(a.c, b.c) AS column_name, a.t AS left_value, b.t AS right_value, CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' WHEN a.t = b.t THEN 'same' ELSE 'changed' END AS status
FROM (SELECT c, t FROM ({_SCHEMA}) WHERE table_name = 'customer') a FULL JOIN (SELECT c, t FROM ({_SCHEMA}) WHERE table_name = 'supplier') b ON a.c = b.c""")
def schema_diff(spark, sf_dir):
    root = F.regexp_replace("column_name", "^[a-z]+_", "")
    a, b = (columns_of(spark, sf_dir, [t]).select(root.alias("column_name"), "type") for t in ("customer", "supplier"))
    return compare.full_compare(a, b, ["column_name"], "type")


@query("SELECT o_orderstatus AS state, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1")
def state_values(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))


@query("""SELECT coalesce(a.s, b.s) AS o_custkey, CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN 'both' WHEN a.s IS NOT NULL THEN 'left' ELSE 'right' END AS side
FROM (SELECT DISTINCT o_custkey AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01') a FULL JOIN (SELECT DISTINCT o_custkey AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01') b ON a.s = b.s""")
def state_compare(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return compare.side_of(o.where("o_orderdate < TIMESTAMP_NTZ '1996-06-01'"), o.where("o_orderdate >= TIMESTAMP_NTZ '1996-06-01'"), "o_custkey")


_OP = "CASE event_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'U' ELSE 'D' END"


@query(f"SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE op = '{o}') AS n_{o.lower()}" for o in "CRUD") + f" FROM (SELECT user_id, {_OP} AS op FROM events) GROUP BY 1")
def crud_matrix(spark, sf_dir):
    return lineage.crud_matrix(read(spark, sf_dir, "events").selectExpr("user_id", f"{_OP} AS op"), "user_id", "op")


@query(f"""WITH e AS (SELECT user_id * 100 + hour(ts) AS user_hour, {_OP} AS op, ts < TIMESTAMP '2024-01-16' AS early, ts >= TIMESTAMP '2024-01-16' AS late FROM events), a AS (SELECT DISTINCT user_hour, op FROM e WHERE early), b AS (SELECT DISTINCT user_hour, op FROM e WHERE late)
SELECT user_hour, op, 'lost' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_hour, op, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def crud_compare(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("user_id * 100 + hour(ts) AS user_hour", f"{_OP} AS op", "ts")
    return lineage.crud_diff(e.where("ts < TIMESTAMP_NTZ '2024-01-16'"), e.where("ts >= TIMESTAMP_NTZ '2024-01-16'"), "user_hour", "op")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def crud_domain_rollup(spark, sf_dir):
    return read(spark, sf_dir, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
SELECT p_partkey AS part_key, 'unused' AS gap FROM part WHERE p_partkey NOT IN (SELECT k FROM w) UNION ALL SELECT k, 'unknown' FROM w WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)""")
def gap_both_ways(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_key")).distinct()
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), "p_size")
    return part.select("part_key").join(used, "part_key", "left_anti").withColumn("gap", F.lit("unused")).union(used.join(part.where("p_size > 2"), "part_key", "left_anti").withColumn("gap", F.lit("unknown")))


@query("""SELECT substr(regexp_replace(url, '[0-9]+', '#', 'g'), 1, 80) AS pattern, count(*) AS n, min(page_id) AS first_seen, max(page_id) AS last_seen, arg_min(url, page_id) AS sample FROM pages GROUP BY 1""")
def error_groups(spark, sf_dir):
    return logs.group_errors(read(spark, sf_dir, "pages"), "url", "page_id")


@query("SELECT event_type, user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def error_first_sample(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    best = e.groupBy("event_type", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    return best.select("event_type", "user_id", "m.event_id", "m.ts")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_errors, min(ts) AS first_at, max(ts) AS last_at, round(max(value), 6) AS largest FROM events GROUP BY 1")
def trace_rollup(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.round(F.max("value"), 6).alias("largest"))


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)")
def trace_preserving_filter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return logs.keep_traces(e, "user_id", (F.col("event_type") == "error") & (F.col("value") > 200)).select("event_id", "user_id", "event_type")


@query("SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def recent_requests(spark, sf_dir):
    return logs.newest(read(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 10).select("event_type", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS edge FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM r GROUP BY user_id, run, event_type""")
def consecutive_collapse(spark, sf_dir):
    return logs.islands(read(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def time_range(spark, sf_dir):
    return read(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-10'").select("event_id", "ts")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)")
def dedup_keep_first(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '***', 'g')) AS masked_hash, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS n_masked FROM documents")
def mask_text(spark, sf_dir):
    masked, n = logs.mask(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_hash"), n.alias("n_masked"))


#: documents after a change: some renumbered, some with other text
_AFTER = "SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents"


def after(docs):
    i, t = F.col("doc_id"), F.col("text")
    return docs.select(F.when(i % 7 == 0, i + 1_000_000_000).otherwise(i).alias("doc_id"), F.when(i % 5 == 0, F.concat(t, F.lit("!"))).otherwise(t).alias("text"))


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status
FROM (SELECT doc_id, sha256(text) AS h FROM documents) a FULL JOIN (SELECT doc_id, sha256(text) AS h FROM ({_AFTER})) b ON a.doc_id = b.doc_id""")
def drift_hash(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    a, b = (x.select("doc_id", F.sha2("text", 256).alias("h")) for x in (d, after(d)))
    return compare.full_compare(a, b, ["doc_id"], "h").select("doc_id", "status")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def rename_by_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey, b.lo AS bucket FROM orders JOIN (SELECT CAST(50000 * i AS BIGINT) AS lo, CAST(50000 * (i + 1) AS BIGINT) AS hi FROM range(0, 12) t(i)) b ON o_totalprice < b.hi AND o_totalprice + 20000 >= b.lo")
def interval_overlap(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    # intervals are turned into the buckets they cover: an equi-join needs no nested loop
    cover = o.select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("o_totalprice") / 50000)), F.floor((F.col("o_totalprice") + 20000) / 50000))).alias("i"))
    return cover.where("i < 12 and o_totalprice + 20000 >= 50000 * i and o_totalprice < 50000 * (i + 1)").select("o_orderkey", (F.col("i") * 50000).cast("long").alias("bucket"))


@query("""SELECT r_name AS path, 1 AS depth FROM region UNION ALL SELECT r_name || ' > ' || n_name, 2 FROM nation JOIN region ON r_regionkey = n_regionkey""")
def menu_tree(spark, sf_dir):
    return spark.sql(
        """WITH RECURSIVE item AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS STRING) AS parent, r_name AS name FROM {region} UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM {nation}),
        tree(id, path, depth) AS (SELECT id, name, 1 FROM item WHERE parent IS NULL UNION ALL SELECT i.id, t.path || ' > ' || i.name, t.depth + 1 FROM item i JOIN tree t ON i.parent = t.id) SELECT path, depth FROM tree""",
        region=read(spark, sf_dir, "region"),
        nation=read(spark, sf_dir, "nation"),
    )


@query("""WITH s AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0), o AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE 'c' || o_custkey IN (SELECT node FROM s)), p AS (SELECT DISTINCT 'p' || l_partkey AS node FROM lineitem WHERE 'o' || l_orderkey IN (SELECT node FROM o))
SELECT node, 0 AS depth FROM s UNION ALL SELECT node, 1 FROM o UNION ALL SELECT node, 2 FROM p""")
def graph_closure(spark, sf_dir):
    edges = read(spark, sf_dir, "orders").selectExpr("'c' || o_custkey AS src", "'o' || o_orderkey AS dst").union(read(spark, sf_dir, "lineitem").selectExpr("'o' || l_orderkey AS src", "'p' || l_partkey AS dst"))
    start = read(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("'c' || c_custkey AS node")
    return lineage.reach(edges, start, 2)


@query("SELECT lang, count(*) AS n_docs, count(l.doc_id) AS n_labelled, CAST(100 * count(l.doc_id) // count(*) AS BIGINT) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang)")
def coverage_rollup(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l")).distinct()
    met = read(spark, sf_dir, "documents").select("doc_id", "lang").join(lab, F.col("doc_id") == F.col("_l"), "left")
    return met.rollup("lang").agg(F.count("*").alias("n_docs"), F.count("_l").alias("n_labelled")).withColumn("percent", F.expr("100 * n_labelled div n_docs"))


@query("""WITH s AS (SELECT o_orderkey, p_partkey, 10 * CAST(p_size = o_custkey % 50 AS INT) + CAST(p_partkey % 7 = o_orderkey % 7 AS INT) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, p_partkey, o_custkey, p_size)
SELECT o_orderkey, max(score) AS best, count(*) FILTER (WHERE score = m) AS n_top FROM (SELECT *, max(score) OVER (PARTITION BY o_orderkey) AS m FROM s) GROUP BY 1""")
def scored_match(spark, sf_dir):
    o, l, p = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    s = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).select("o_orderkey", "p_partkey", (10 * (F.col("p_size") == F.col("o_custkey") % 50).cast("int") + (F.col("p_partkey") % 7 == F.col("o_orderkey") % 7).cast("int")).alias("score")).distinct()
    best = s.groupBy("o_orderkey", "score").agg(F.count("*").alias("n")).groupBy("o_orderkey").agg(F.max(F.struct("score", "n")).alias("m"))
    return best.select("o_orderkey", F.col("m.score").alias("best"), F.col("m.n").alias("n_top"))


_KNN = "SELECT q.vec_id AS query_id, v.vec_id, abs(round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 6)) AS distance, v.label, q.label AS ql FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0"


def nearest(spark, sf_dir, k, farthest=None):
    v = read(spark, sf_dir, "embeddings")
    return retrieval.nearest(v, v.where("vec_id % 20 = 0"), k, farthest)


@query(f"SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM ({_KNN})) WHERE r <= 5")
def knn_top5(spark, sf_dir):
    return nearest(spark, sf_dir, 5)


@query(f"SELECT query_id, vec_id, distance FROM ({_KNN}) WHERE distance <= 1.4")
def knn_threshold(spark, sf_dir):
    return nearest(spark, sf_dir, None, 1.4)


@query(f"SELECT query_id, vec_id, min(tier) AS tier FROM (SELECT q.vec_id AS query_id, v.vec_id, 0 AS tier FROM embeddings v JOIN embeddings q ON q.label = v.label AND q.vec_id % 20 = 0 UNION ALL SELECT query_id, vec_id, 1 FROM ({_KNN}) WHERE distance <= 1.6) GROUP BY 1, 2")
def hybrid_lookup(spark, sf_dir):
    # by label exactly, then by distance
    v = read(spark, sf_dir, "embeddings")
    return retrieval.lookup(v, v.where("vec_id % 20 = 0"), 1.6)


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS action
FROM (SELECT doc_id, sha256(text) AS h FROM documents) a FULL JOIN (SELECT doc_id, sha256(text) AS h FROM ({_AFTER})) b ON a.doc_id = b.doc_id""")
def incremental_upsert(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return compare.upsert_plan(d, after(d), "doc_id", "text")


@query("SELECT l_partkey, count(*) AS n_refs FROM lineitem GROUP BY 1")
def ref_ranking(spark, sf_dir):
    return profile.ranked_references(read(spark, sf_dir, "lineitem"), "l_partkey")


@query("""WITH l AS (SELECT doc_id, i AS line_no, t[i] AS line FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))), h AS (SELECT doc_id, line_no FROM l WHERE contains(line, '@'))
SELECT DISTINCT l.doc_id, l.line_no, sha256(l.line) AS line_hash, contains(l.line, '@') AS hit FROM l JOIN h ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 1 AND h.line_no + 1""")
def grep_context(spark, sf_dir):
    return logs.grep_context(read(spark, sf_dir, "documents"), "doc_id", "text", "@", 1).select("doc_id", "line_no", F.sha2("line", 256).alias("line_hash"), "hit")


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10")
def run_history(spark, sf_dir):
    return logs.newest(read(spark, sf_dir, "events"), "event_type", [F.desc("event_id")], 10).select("event_type", "event_id", "user_id")


@query("SELECT i AS id, 'row ' || i AS name, CAST(DATE '2024-01-01' + CAST(i % 28 AS INT) AS DATE) AS made, s.o_orderstatus AS status FROM range(0, 200) t(i) JOIN (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderstatus FROM orders)) s ON i % s.n = s.k")
def synth_rows(spark, sf_dir):
    w = Window.orderBy("status")  # a handful of distinct codes
    codes = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")).distinct().select("status", (F.row_number().over(w) - 1).alias("k"))
    n = codes.agg(F.count("*").alias("n"))
    return spark.range(200).crossJoin(F.broadcast(n)).join(F.broadcast(codes), F.col("id") % F.col("n") == F.col("k")).select("id", F.concat(F.lit("row "), "id").alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 28).cast("int")).alias("made"), "status")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    w = F.col("w.start").cast("timestamp_ntz")
    got = events.collected(events.windows(events.source(spark, f"{sf_dir}/events.parquet"), "1 hour"), "complete", shared_dir(spark))
    return got.select(w.alias("window_start"), "event_type", "n", "total")


@query("SELECT window_start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start, event_type FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    got = events.collected(events.windows(events.source(spark, f"{sf_dir}/events.parquet"), "2 hours", "1 hour"), "complete", shared_dir(spark))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS edge FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS begun_at, count(*) AS n FROM r GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    got = events.collected(events.sessions(events.source(spark, f"{sf_dir}/events.parquet"), "30 minutes"), "complete", shared_dir(spark))
    return got.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begun_at"), "n")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    stream = events.source(spark, f"{sf_dir}/events.parquet")
    twice = stream.unionByName(stream)  # every record arrives twice
    return events.collected(events.first_records(twice, ["event_id"]).select("event_id", "user_id", "event_type"), "append", shared_dir(spark))


@query("""WITH c AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS call FROM events), g AS (SELECT user_id, CAST(call AS BIGINT) AS call, count(*) AS n FROM c WHERE call > 0 GROUP BY 1, 2)
SELECT user_id, call, n FROM (SELECT *, max(call) OVER (PARTITION BY user_id) AS last FROM g) WHERE call < last""")
def stream_calls(spark, sf_dir):
    return events.collected(events.calls(events.source(spark, f"{sf_dir}/events.parquet")), "append", shared_dir(spark))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    return events.upsert(events.source(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id"), "user_id", "event_id", shared_dir(spark))


@query("SELECT o_orderpriority, count(*) AS n, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_totalprice > 250000) AS total_rows FROM orders WHERE o_totalprice > 250000 GROUP BY 1")
def gateway_preview(spark, sf_dir):
    got = gateway.run(spark, "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice > :least GROUP BY 1", {"least": 250_000}, orders=read(spark, sf_dir, "orders"))
    return gateway.preview(got, 100)


@query("SELECT p_partkey, replace(p_name, ' ', chr(92) || 't') || chr(9) || chr(92) || 'N' || chr(9) || p_brand AS copy_line, CASE WHEN contains(p_name, 'r') THEN '\"' || p_name || ',\"\"x\"\"\"' ELSE p_name END || ',' || p_brand AS csv_line, '| ' || p_name || chr(92) || '|' || p_brand || ' | ' || p_size || ' |' AS markdown_line FROM part")
def sink_lines(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    quoted = F.when(name.contains("r"), F.concat(name, F.lit(',"x"'))).otherwise(name)
    return read(spark, sf_dir, "part").select("p_partkey", files.copy_line(F.replace(name, F.lit(" "), F.lit("\t")), F.lit(None), brand).alias("copy_line"), files.csv_line(quoted, brand).alias("csv_line"), files.markdown_line(F.concat(name, F.lit("|"), brand), F.col("p_size")).alias("markdown_line"))


from ledgerline import rule_queries, schema_queries, text_queries, trace_queries  # noqa: E402, F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
