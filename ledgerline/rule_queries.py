"""Queries of verdicts, catalogs, order and joins of facts, over whole driver tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import catalog, facts, intervals, lineage, logs, ranking, verdicts
from ledgerline.queries import query, read
from ledgerline.text_queries import log_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_TYPE = "replace(replace(replace(replace(replace(replace(data_type, 'BIGINT', 'bigint'), 'INTEGER', 'int'), 'VARCHAR', 'string'), 'DOUBLE', 'double'), 'TIMESTAMP', 'timestamp_ntz'), 'FLOAT[]', 'array<float>')"
_COLUMNS = f"SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name, {_TYPE} AS type FROM information_schema.columns WHERE table_name IN {TABLES}"
_ROOT = "regexp_replace(lower({}), '^[a-z]{{1,2}}_', '')"


def _catalog(spark, sf_dir):
    return catalog.scan(spark, {t: read(spark, sf_dir, t) for t in TABLES})


def _root(c):
    return F.regexp_replace(F.lower(c), "^[a-z]{1,2}_", "")


@query(_COLUMNS)
def catalog_scan(spark, sf_dir):
    return _catalog(spark, sf_dir)


@query(f"SELECT 'table' AS kind, count(DISTINCT table_name) AS n FROM ({_COLUMNS}) UNION ALL SELECT 'column', count(*) FROM ({_COLUMNS}) UNION ALL SELECT 'type', count(DISTINCT type) FROM ({_COLUMNS})")
def schema_counts(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    n = c.agg(F.count_distinct("table_name").alias("table"), F.count("*").alias("column"), F.count_distinct("type").alias("type"))
    return n.unpivot([], ["table", "column", "type"], "kind", "n")


@query(f"""SELECT a.table_name, a.column_name, array_to_string(list_sort(list(DISTINCT b.table_name))[:8], ', ') AS others FROM ({_COLUMNS}) a JOIN ({_COLUMNS}) b ON {_ROOT.format("a.column_name")} = {_ROOT.format("b.column_name")} AND a.table_name <> b.table_name GROUP BY 1, 2""")
def shared_columns(spark, sf_dir):
    return catalog.shared_columns(_catalog(spark, sf_dir), _root)


@query(f"SELECT table_name, count(*) AS n_columns FROM ({_COLUMNS}) WHERE regexp_matches(lower(table_name), '^.*e.{{1}}s$') GROUP BY 1")
def tables_like(spark, sf_dir):
    return catalog.named_like(_catalog(spark, sf_dir), "*E?S").groupBy("table_name").agg(F.count("*").alias("n_columns"))


@query(f"""SELECT c.table_name AS child, c.column_name AS child_column, min(k.table_name) AS parent, arg_min(k.column_name, k.table_name) AS key_column FROM ({_COLUMNS}) c JOIN ({_COLUMNS}) k ON k.position = 1 AND c.position > 1 AND c.table_name <> k.table_name AND {_ROOT.format("c.column_name")} = {_ROOT.format("k.column_name")} GROUP BY 1, 2""")
def catalog_foreign_keys(spark, sf_dir):
    return catalog.foreign_keys(_catalog(spark, sf_dir), _root)


_FK = f"""SELECT DISTINCT child, parent FROM (SELECT c.table_name AS child, c.column_name, min(k.table_name) AS parent FROM ({_COLUMNS}) c JOIN ({_COLUMNS}) k ON k.position = 1 AND c.position > 1 AND c.table_name <> k.table_name AND {_ROOT.format("c.column_name")} = {_ROOT.format("k.column_name")}
WHERE c.table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem') AND k.table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem') GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE e AS ({_FK}), w AS (SELECT DISTINCT table_name, 0 AS depth FROM ({_COLUMNS}) WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem') UNION SELECT child, depth + 1 FROM w JOIN e ON parent = table_name) SELECT table_name, max(depth) AS depth FROM w GROUP BY 1""")
def topo_depth(spark, sf_dir):
    own = _catalog(spark, sf_dir).where(F.col("table_name").isin("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    edges = catalog.foreign_keys(own, _root).select("child", "parent").distinct()
    return ranking.longest_depth(edges, own.select("table_name").distinct(), "child", "parent", "table_name")


@query("""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents), walk(lang, r, used, n) AS (SELECT DISTINCT lang, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d
UNION ALL SELECT d.lang, d.r, CASE WHEN used + n_chars <= 60000 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 60000 THEN n + 1 ELSE n END FROM walk JOIN d ON d.lang = walk.lang AND d.r = walk.r + 1)
SELECT lang, max(n) AS n_taken FROM walk GROUP BY 1""")
def schema_budget(spark, sf_dir):
    # a report for readers: of each group's items in order, those that fit
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    taken = ranking.budgeted(docs, "lang", "doc_id", "n_chars", 60_000).groupBy("lang").agg(F.count("*").alias("n_taken"))
    return docs.select("lang").distinct().join(taken, "lang", "left").fillna(0, ["n_taken"])


@query("SELECT p_brand, p_partkey, rank, n_omitted FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank, greatest(count(*) OVER (PARTITION BY p_brand) - 5, 0) AS n_omitted FROM part) WHERE rank <= 5")
def capped_report(spark, sf_dir):
    got = ranking.capped(read(spark, sf_dir, "part"), "p_brand", [F.desc("p_size"), F.asc("p_partkey")], 5)
    return got.select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"), "n_omitted")


@query("SELECT doc_id, sha256(array_to_string(l[greatest(len(l) - 2, 1):], chr(10))) AS tail_hash, sha256(array_to_string(l[2:4], chr(10))) AS range_hash FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_ranges(spark, sf_dir):
    part = lambda a, z: F.sha2(F.array_join(ranking.lines_of(F.col("text"), a, z), "\n"), 256)
    return read(spark, sf_dir, "documents").select("doc_id", part(-3, -1).alias("tail_hash"), part(2, 4).alias("range_hash"))


@query("SELECT r_name, greatest((SELECT max(o_orderkey) FROM orders), 900000) + row_number() OVER (ORDER BY r_regionkey) AS new_key FROM region")
def next_key_block(spark, sf_dir):
    return ranking.next_keys(read(spark, sf_dir, "orders"), "o_orderkey", read(spark, sf_dir, "region"), "r_regionkey").select("r_name", "new_key")


@query("SELECT code, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(code AS INTEGER), 999999), code) AS BIGINT) AS place FROM (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'x' || p_size ELSE CAST(p_size AS VARCHAR) END AS code FROM part)")
def natural_order(spark, sf_dir):
    from pyspark.sql.window import Window

    codes = read(spark, sf_dir, "part").select(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x"), "p_size")).otherwise(F.col("p_size").cast("string")).alias("code")).distinct()  # as many as p_size has values
    return codes.select("code", F.row_number().over(Window.orderBy(ranking.natural(F.col("code")), "code")).cast("long").alias("place"))


_S, _T = "['Name','Nm','FullName','FNm','Code','Cd','Address','Addr','X']", "['Nm','Name','FNm','FullName','Cd','Code','Addr','Address','Y']"
_SYN = "list_transform([['Name$','Nm'],['Nm$','Name'],['FullName$','FNm'],['FNm$','FullName'],['Code$','Cd'],['Cd$','Code'],['Address$','Addr'],['Addr$','Address']], lambda s: regexp_replace({x}, s[1], s[2]))"


@query(f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN 'emp' ELSE '' END || string_split(p_name, ' ')[1] || {_S}[p_partkey % 9 + 1] AS expected, string_split(p_name, ' ')[1] || {_T}[p_size % 9 + 1] AS field FROM part),
f AS (SELECT p_brand, list(DISTINCT field) AS fields FROM p GROUP BY 1), q AS (SELECT p.*, fields, CASE WHEN length(regexp_replace(expected, '^[a-z]{{3,4}}', '')) > 0 THEN lower(regexp_replace(expected, '^[a-z]{{3,4}}', '')[1]) || regexp_replace(expected, '^[a-z]{{3,4}}', '')[2:] ELSE expected END AS bare FROM p JOIN f USING (p_brand))
SELECT p_partkey, expected, list_has_any(fields, list_concat([expected, bare], {_SYN.format(x="expected")}, {_SYN.format(x="bare")})) AS covered FROM q""")
def field_coverage(spark, sf_dir):
    color = F.element_at(F.split("p_name", " "), 1)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i % 9 + 1).cast("int"))
    a = ("Name", "Nm", "FullName", "FNm", "Code", "Cd", "Address", "Addr", "X")
    b = ("Nm", "Name", "FNm", "FullName", "Cd", "Code", "Addr", "Address", "Y")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.when(F.col("p_size") % 2 == 0, "emp").otherwise(""), color, pick(a, F.col("p_partkey"))).alias("expected"), F.concat(color, pick(b, F.col("p_size"))).alias("field"))
    fields = p.groupBy("p_brand").agg(F.collect_set("field").alias("fields"))  # names of a brand's fields: colours times endings
    return p.join(fields, "p_brand").select("p_partkey", "expected", verdicts.field_covered(F.col("expected"), F.col("fields")).alias("covered"))


_BATCH = "SELECT o_custkey, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-06-01') AS a, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1996-06-01') AS b, bool_or(o_totalprice > 495000) AS failed, bool_and(o_orderstatus <> 'F') AS missing, sum(o_totalprice) AS spent FROM orders GROUP BY 1"


@query(f"SELECT CASE WHEN failed OR missing THEN 'fail' WHEN a = 0 AND b = 0 THEN 'skip' WHEN a = b THEN 'ok' ELSE 'fail' END AS status, count(*) AS n, round(sum(spent), 2) AS total FROM ({_BATCH}) GROUP BY 1")
def batch_totals(spark, sf_dir):
    early = F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz")
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"), F.bool_or(F.col("o_totalprice") > 495000).alias("failed"), F.bool_and(F.col("o_orderstatus") != "F").alias("missing"), F.sum("o_totalprice").alias("spent"))
    status = verdicts.batch_verdict(F.col("a"), F.col("b"), F.col("failed"), F.col("missing"))
    return c.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("spent"), 2).alias("total"))


@query("SELECT o_orderkey, CASE WHEN paged AND has_total THEN rows_equal AND total_equal WHEN paged THEN scalar_equal OR rows_equal OR total = sql_rows ELSE scalar_equal OR rows_equal END AS matches FROM (SELECT o_orderkey, o_orderstatus <> 'O' AS paged, o_orderpriority < '3' AS has_total, o_custkey % 3 = 0 AS rows_equal, o_custkey % 2 = 0 AS total_equal, o_orderkey % 5 = 0 AS scalar_equal, o_custkey % 7 AS total, o_orderkey % 7 AS sql_rows FROM orders)")
def row_matches(spark, sf_dir):
    o, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    m = verdicts.row_match(s != "O", F.col("o_orderpriority") < "3", c % 3 == 0, c % 2 == 0, o % 5 == 0, c % 7, o % 7)
    return read(spark, sf_dir, "orders").select("o_orderkey", m.alias("matches"))


_NOW = "SELECT CASE WHEN doc_id % 7 = 0 THEN 'new/' ELSE 'd/' END || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN text || '!' WHEN doc_id % 6 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS text, lang FROM documents"
_DRIFT = f"""SELECT coalesce(b.path, n.path) AS path, coalesce(b.lang, n.lang) AS lang, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN CASE WHEN sha256(b.text) IN (SELECT sha256(text) FROM ({_NOW})) THEN 'moved' ELSE 'deleted' END
WHEN b.path IN (SELECT 'd/' || doc_id FROM labels WHERE quality = 0) THEN 'excluded' WHEN b.text = n.text THEN 'same' WHEN replace(b.text, chr(13) || chr(10), chr(10)) = replace(n.text, chr(13) || chr(10), chr(10)) THEN 'eol' ELSE 'changed' END AS status FROM (SELECT 'd/' || doc_id AS path, text, lang FROM documents) b FULL JOIN ({_NOW}) n ON b.path = n.path"""


def _drift(spark, sf_dir):
    d, i, t = read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")
    base = d.select(F.concat(F.lit("d/"), i).alias("path"), "text", "lang")
    now = d.select(F.concat(F.when(i % 7 == 0, "new/").otherwise("d/"), i).alias("path"), F.when(i % 5 == 0, F.concat(t, F.lit("!"))).when(i % 6 == 1, F.replace(t, F.lit("\n"), F.lit("\r\n"))).otherwise(t).alias("text"), "lang")
    known = read(spark, sf_dir, "labels").where("quality = 0").select(F.concat(F.lit("d/"), "doc_id").alias("path"))
    lang = base.select("path", "lang").union(now.select("path", "lang")).distinct()
    return verdicts.drift_files(base, now, known, "path", "text").join(lang, "path")


@query(f"SELECT path, status FROM ({_DRIFT})")
def drift_files(spark, sf_dir):
    return _drift(spark, sf_dir).select("path", "status")


@query(f"SELECT status, count(*) AS n FROM ({_DRIFT}) GROUP BY 1")
def drift_counts(spark, sf_dir):
    return _drift(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT lang, CASE WHEN count(*) FILTER (WHERE status = 'changed') > 0 THEN 'changed' WHEN count(*) FILTER (WHERE status = 'deleted') > 0 THEN 'deleted' WHEN count(*) FILTER (WHERE status = 'moved') > 0 THEN 'moved' ELSE 'same' END AS status FROM ({_DRIFT}) GROUP BY 1")
def drift_screens(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return _drift(spark, sf_dir).groupBy("lang").agg(verdicts.drift_screen(n("deleted"), n("changed"), n("moved")).alias("status"))


_EVIDENCE = """SELECT doc_id, source, CASE WHEN k <= len(l) AND l[k] = excerpt THEN 'OK' WHEN list_contains(l, excerpt) THEN 'MOVED' WHEN k > len(l) THEN 'MISSING' ELSE 'STALE' END AS status
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, doc_id % 4 + 1 AS k, CASE WHEN doc_id % 5 = 0 THEN 'gone' ELSE string_split(text, chr(10))[1] END AS excerpt FROM documents)"""


def _evidence(spark, sf_dir):
    lines = F.split("text", "\n")
    excerpt = F.when(F.col("doc_id") % 5 == 0, "gone").otherwise(F.get(lines, F.lit(0)))
    return read(spark, sf_dir, "documents").select("doc_id", "source", verdicts.evidence_status(lines, (F.col("doc_id") % 4 + 1).cast("int"), excerpt).alias("status"))


@query(_EVIDENCE)
def evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(f"SELECT source, ['OK', 'MOVED', 'STALE', 'MISSING'][max(list_position(['OK', 'MOVED', 'STALE', 'MISSING'], status))] AS worst FROM ({_EVIDENCE}) GROUP BY 1")
def worst_status(spark, sf_dir):
    return _evidence(spark, sf_dir).groupBy("source").agg(verdicts.worst(F.col("status")).alias("worst"))


@query("""SELECT event_id, CASE WHEN code >= 400 THEN CASE WHEN code = 403 THEN 'blocked' WHEN code = 404 THEN 'undecidable' ELSE 'error' END WHEN user_id % 11 = 0 THEN 'own' WHEN event_type = 'view' THEN 'common' WHEN k = 0 THEN 'undecidable'
WHEN menus <> [] AND NOT list_has_any(menus, granted) THEN 'warning' WHEN menus <> [] THEN 'ok' ELSE 'unknown' END AS verdict FROM (SELECT *, [200, 200, 200, 200, 403, 404, 500][event_id % 7 + 1] AS code, event_id % 13 AS k, CASE WHEN event_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [event_type] END AS menus, [CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'purchase' END] AS granted FROM events)""")
def access_verdicts(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, (200, 200, 200, 200, 403, 404, 500))), (F.col("event_id") % 7 + 1).cast("int"))
    menus = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type"))
    granted = F.array(F.when(F.col("user_id") % 2 == 0, "click").otherwise("purchase"))
    v = verdicts.access_verdict(code, F.col("user_id") % 11 == 0, F.col("event_type") == "view", F.col("event_id") % 13, menus, granted)
    return read(spark, sf_dir, "events").select("event_id", v.alias("verdict"))


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'type' WHEN 2 THEN 'syntax' WHEN 3 THEN 'missing' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1")
def error_classes(spark, sf_dir):
    names = ("TABLE_OR_VIEW_NOT_FOUND", "CAST_INVALID_INPUT", "PARSE_SYNTAX_ERROR", "UNRESOLVED_COLUMN.WITH_SUGGESTION", "DIVIDE_BY_ZERO")
    condition = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").groupBy(verdicts.error_class(condition).alias("class")).agg(F.count("*").alias("n"))


_TARGETS = "SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN '#' || n_nationkey WHEN 1 THEN upper(n_name) WHEN 2 THEN n_name[:length(n_name) - 1] ELSE n_name[:3] END AS target FROM nation UNION SELECT 'zzz'"


@query(f"""WITH t AS ({_TARGETS}), c AS (SELECT target, (SELECT min(n_name) FROM nation WHERE '#' || n_nationkey = target) AS no, (SELECT count(*) FROM nation WHERE lower(n_name) = lower(target)) AS ne, (SELECT min(n_name) FROM nation WHERE lower(n_name) = lower(target)) AS e,
(SELECT count(*) FROM nation WHERE starts_with(lower(n_name), lower(target))) AS np, (SELECT min(n_name) FROM nation WHERE starts_with(lower(n_name), lower(target))) AS p FROM t)
SELECT target, CASE WHEN no IS NOT NULL THEN 'number' WHEN ne = 1 THEN 'exact' WHEN ne = 0 AND np = 1 THEN 'prefix' WHEN np > 1 THEN 'ambiguous' ELSE 'not found' END AS verdict, CASE WHEN no IS NOT NULL THEN no WHEN ne = 1 THEN e WHEN ne = 0 AND np = 1 THEN p END AS name FROM c""")
def target_resolution(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    t = F.when(k % 4 == 0, F.concat(F.lit("#"), k)).when(k % 4 == 1, F.upper(name)).when(k % 4 == 2, F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(F.substring(name, 1, 3))
    targets = n.select(t.alias("target")).union(spark.createDataFrame([("zzz",)], "target string"))
    return verdicts.resolve(targets, n, "target", "n_nationkey", "n_name")


@query("""SELECT doc_id, CASE WHEN ends_with(p, '.sql') THEN 'DB' WHEN ends_with(p, '.xml') THEN 'SQL' WHEN ends_with(p, '.java') THEN CASE WHEN ends_with(p, 'Model.java') THEN 'MODEL' WHEN contains(p, '/client/') THEN 'UI' ELSE 'LOGIC' END ELSE 'ETC' END AS kind
FROM (SELECT doc_id, 'src/' || CASE WHEN lang = 'en' THEN 'client' ELSE lang END || '/F' || doc_id || ['.sql', '.xml', '.java', 'Model.java', '.md'][doc_id % 5 + 1] AS p FROM documents)""")
def file_kinds(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".sql", ".xml", ".java", "Model.java", ".md"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.when(F.col("lang") == "en", "client").otherwise(F.col("lang")), F.lit("/F"), "doc_id", ext)
    return read(spark, sf_dir, "documents").select("doc_id", verdicts.file_kind(path).alias("kind"))


@query(r"""SELECT CASE WHEN conv_id::BIGINT % 4 = 0 THEN 'literal' WHEN regexp_matches(t, 'Combo|combo|Select\b|options') THEN 'choices' WHEN regexp_matches(t, '==|!=|equals') THEN 'comparison' ELSE 'other' END AS kind, count(*) AS n
FROM (SELECT conv_id, text || CASE turn::BIGINT % 4 WHEN 1 THEN ' a == b' WHEN 2 THEN ' Select x' ELSE '' END AS t FROM conversations) GROUP BY 1""")
def usage_kinds(spark, sf_dir):
    turn = F.col("turn").cast("long") % 4
    line = F.concat("text", F.when(turn == 1, " a == b").when(turn == 2, " Select x").otherwise(""))
    suffix = F.when(F.col("conv_id").cast("long") % 4 == 0, ".xml").otherwise(".ts")
    return read(spark, sf_dir, "conversations").groupBy(verdicts.usage_kind(line, suffix).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT r_name || ' > ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), 'a') AND contains(lower(n_name), 'i')")
def menu_match(spark, sf_dir):
    path = F.concat("r_name", F.lit(" > "), "n_name")
    menus = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(path.alias("path"))
    return menus.where(F.rlike(F.lower("path"), F.lit(verdicts.path_pattern("A > i"))))


@query("SELECT event_id, level FROM (" + "SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 300 THEN 'WARN' ELSE 'INFO' END AS level, event_type FROM events" + ") WHERE level IN ('WARN', 'ERROR') AND event_type NOT LIKE '%urch%'")
def level_filter(spark, sf_dir):
    kept = logs.at_least(log_table(spark, sf_dir), "level", "warn")
    return kept.where(facts.not_ignored(F.col("logger"), ["urch", "no such logger"])).select("event_id", "level")


@query("SELECT page_id FROM pages WHERE contains(regexp_replace(url, '^https?://[^/]*', ''), '/en/') AND page_id % 2 = 0")
def access_filter(spark, sf_dir):
    method = F.when(F.col("page_id") % 2 == 0, "get").otherwise("post")
    return read(spark, sf_dir, "pages").where(facts.accessed(method, F.col("url"), "GET", "/en/", "https?://[^/]*")).select("page_id")


@query("SELECT count(*) AS n_requests, count(*) FILTER (WHERE event_type = 'click') AS n_sql, count(*) FILTER (WHERE event_type <> 'error' AND value > 300) AS n_warn, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(DISTINCT user_id) AS n_traces FROM events")
def log_summary(spark, sf_dir):
    return facts.request_summary(log_table(spark, sf_dir), "level", "user_id", F.col("logger") == "app.click")


@query("SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) = '7' AND CAST(p_brand AS VARCHAR) <> 'Brand#1'")
def row_equality(spark, sf_dir):
    return read(spark, sf_dir, "part").where(facts.matches({"p_size": "7"}) & ~facts.matches({"p_brand": "Brand#1"})).select("p_partkey")


@query("SELECT p_partkey, coalesce(TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE CAST(p_size + 1 AS VARCHAR) END AS INTEGER), p_size) AS p_size FROM part")
def coerced_patch(spark, sf_dir):
    new = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise((F.col("p_size") + 1).cast("string"))
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", facts.coerced(part, "p_size", new).alias("p_size"))


@query("SELECT user_id, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-16'), []) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), []) AS b FROM events GROUP BY 1)")
def structural_delta(spark, sf_dir):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    sets = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(~early, F.col("event_type"))).alias("b"))  # event types are a handful
    removed, added = verdicts.deltas(F.col("a"), F.col("b"))
    return sets.select("user_id", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"))


@query("""WITH s AS (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1), o AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS inside, min(o_orderkey) AS any_ FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN inside IS NOT NULL THEN 1 WHEN any_ IS NOT NULL THEN 2 WHEN n = 1 THEN 3 END AS tier, CASE WHEN inside IS NOT NULL THEN inside WHEN any_ IS NOT NULL THEN any_ WHEN n = 1 THEN k END AS match FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN s ON s_nationkey = c_nationkey""")
def pair_priority(spark, sf_dir):
    # named in the chain, then named anywhere, then the only one alike
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("match"), "o_orderstatus")
    alone = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("match")).where("n = 1")
    alike = c.join(alone, F.col("s_nationkey") == F.col("c_nationkey")).select("c_custkey", "match")
    return facts.first_tier(c, "c_custkey", [(o.where("o_orderstatus = 'F'").select("c_custkey", "match"), False), (o.select("c_custkey", "match"), False), (alike, True)])


@query("SELECT CASE WHEN n_top = 1 THEN 'certain' ELSE 'ambiguous' END AS verdict, count(*) AS n FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity = m) AS n_top FROM (SELECT l_orderkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1) GROUP BY 1")
def match_verdicts(spark, sf_dir):
    return facts.best_scored(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity").groupBy("verdict").agg(F.count("*").alias("n"))


@query("""SELECT n_name, coalesce(c, 0) AS n_customers, coalesce(s, 0) AS n_suppliers, CASE WHEN coalesce(c, 0) + coalesce(s, 0) = 0 THEN NULL ELSE 100 * coalesce(s, 0) // (coalesce(c, 0) + coalesce(s, 0)) END AS percent FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def domain_stats(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    of = {"n_customers": read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_suppliers": read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))}
    return n.select("n_nationkey", "n_name").join(facts.domain_counts(n, of, "n_nationkey", "n_suppliers", ("n_customers", "n_suppliers")), "n_nationkey").drop("n_nationkey")


@query("SELECT c_nationkey, arg_max(c_mktsegment, n * 1000000 - f) AS label FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2) GROUP BY 1")
def domain_label(spark, sf_dir):
    return facts.mode_label(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query("SELECT w AS name, count(*) AS n_statements FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM conversations) GROUP BY 1")
def name_popularity(spark, sf_dir):
    return facts.popularity(read(spark, sf_dir, "conversations"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 8")
def top_eight(spark, sf_dir):
    return facts.top(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_partkey", 8)


@query("SELECT r_name AS top_menu, count(*) AS n_menus, count(*) FILTER (WHERE n_nationkey IN (SELECT c_nationkey FROM customer)) AS n_with_screen FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def menu_rollup(spark, sf_dir):
    used = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("used")).distinct()
    paths = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(used, F.col("used") == F.col("n_nationkey"), "left").select(F.concat("r_name", F.lit(" > "), "n_name").alias("path"), "used")
    return facts.menu_rollup(paths, "path", {"n_with_screen": F.col("used").isNotNull()})


@query("SELECT CAST(ts AS DATE) AS day, event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_files FROM events GROUP BY 1, 2")
def changes_by_kind(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_files"))


@query("SELECT sum(n) AS n_tests, sum(failed) AS n_failed, count(*) AS n_suites, round(sum(t), 2) AS seconds FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, sum(value) AS t FROM events GROUP BY 1)")
def test_totals(spark, sf_dir):
    suites = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum("value").alias("t"))
    return facts.totals(suites, {"n": "n_tests", "failed": "n_failed", "t": "seconds"})


@query("SELECT p_partkey, coalesce(o.price, p_retailprice) AS price, o.price IS NOT NULL AS overridden FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem WHERE l_discount = 0 GROUP BY 1) o ON l_partkey = p_partkey")
def override_rows(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").where("l_discount = 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("price"))
    return facts.overridden(read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price")), own, "p_partkey", "price")


@query("SELECT page_id, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS cited, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM documents) AS grounded FROM pages WHERE regexp_matches(url, '/[0-9]+')")
def grounding(spark, sf_dir):
    cited = read(spark, sf_dir, "pages").where(F.rlike("url", F.lit("/[0-9]+"))).select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).cast("long").alias("cited"))
    return facts.grounded(cited, read(spark, sf_dir, "documents").select("doc_id"), "cited")


@query("""SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def cascade_children(spark, sf_dir):
    gone = read(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("0 AS row", "c_custkey AS node")
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS src")
    found = lineage.levels(gone, [read(spark, sf_dir, "orders").selectExpr("o_custkey AS src", "o_orderkey AS dst")])
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    rows = lines.join(found[-1], F.col("src") == F.col("node"), "left_semi")
    return n(found[0], "customer").union(n(found[1], "orders")).union(n(rows, "lineitem"))


@query("SELECT k, arg_min(name, rank) AS name, arg_min(origin, rank) AS origin FROM (SELECT c_custkey AS k, c_name AS name, 'customer' AS origin, 1 AS rank FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', 2 FROM supplier UNION ALL SELECT p_partkey, p_name, 'part', 3 FROM part) GROUP BY 1")
def union_of_sources(spark, sf_dir):
    part = lambda t, k, n: read(spark, sf_dir, t).select(F.col(k).alias("k"), F.col(n).alias("name"), F.lit(t).alias("origin"))
    return facts.first_source([part("customer", "c_custkey", "c_name"), part("supplier", "s_suppkey", "s_name"), part("part", "p_partkey", "p_name")], "k")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'done in ' || CAST(round(value) AS BIGINT) || ' s' ELSE 'exit ' || event_id % 3 || ': ' || event_type END AS summary FROM events")
def run_summary(spark, sf_dir):
    code = F.col("event_id") % 3
    return read(spark, sf_dir, "events").select("event_id", facts.run_summary(code, F.col("value"), F.col("event_type")).alias("summary"))


@query("""WITH c AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS call FROM events)
SELECT user_id, CAST(call AS BIGINT) AS call, min(event_id) FILTER (WHERE event_type = 'click') AS prepared_at, min(event_id) FILTER (WHERE event_type = 'view') AS parameters_at, min(event_id) FILTER (WHERE event_type = 'purchase') AS total_at, count(*) AS n_records FROM c WHERE call > 0 GROUP BY 1, 2""")
def statement_pairs(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "prepare").when(F.col("event_type") == "view", "parameters").when(F.col("event_type") == "purchase", "total").otherwise("other")
    return logs.pair_statements(read(spark, sf_dir, "events").withColumn("kind", kind), "user_id", "event_id", "kind")


@query("SELECT e.event_id, e.ts, e.event_type, e.user_id FROM events e JOIN (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2) f ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.event_id = f.event_id")
def first_records(spark, sf_dir):
    return logs.keep_first(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("event_id", "ts", "event_type", "user_id")


_RECORD = "strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(epoch_ms(ts) % 1000 AS VARCHAR), 3, '0')"


@query(f"SELECT event_type AS file, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS record, date_trunc('millisecond', ts) AS ts, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 't' || user_id END AS trace, 'INFO' AS level, 'app.x' AS logger, 'hit ' || event_id AS message, event_id % 3 AS n_extra FROM events")
def log_records(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ms = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    head = F.concat(ms, F.lit(" ["), F.when(F.col("user_id") % 9 == 0, "-").otherwise(F.concat(F.lit("t"), "user_id")), F.lit("] [-] [SYSTEM] [-] [main] INFO app.x - hit "), "event_id")
    more = F.transform(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda i: i <= F.col("event_id") % 3), lambda i: F.concat(F.lit("\tat line "), i))
    lines = e.select(F.col("event_type").alias("file"), "event_id", F.posexplode(F.concat(F.array(head), more)).alias("i", "line")).withColumn("number", F.col("event_id") * 10 + F.col("i"))
    return logs.records(lines, "file", "number", "line").select("file", "record", "ts", "trace", "level", "logger", "message", F.size("extra").cast("long").alias("n_extra"))


@query("SELECT table_name, column_name FROM information_schema.columns WHERE data_type = 'INTEGER' AND contains(lower(column_name), 'key')" + f" AND table_name IN {TABLES}")
def column_search(spark, sf_dir):
    return facts.columns_where(_catalog(spark, sf_dir), "column_name", "type", ("int",), holds="KEY").select("table_name", "column_name")


@query("SELECT p_name, p_partkey FROM part WHERE NOT regexp_matches(p_name || CASE p_partkey % 4 WHEN 0 THEN '_bak' WHEN 1 THEN '_20240101' WHEN 2 THEN '_backup' ELSE '' END, '(?i)bak|_back$|_backup$|_\\d{6,8}$')")
def without_backups(spark, sf_dir):
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, ("_bak", "_20240101", "_backup", ""))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return read(spark, sf_dir, "part").where(~F.rlike(name, F.lit(catalog.BACKUP))).select("p_name", "p_partkey")


@query("SELECT p_partkey, p_name, CASE WHEN starts_with(p_name, 'red') THEN 0 WHEN starts_with(p_name, 'r') THEN 1 ELSE 2 END AS priority FROM part WHERE NOT regexp_matches(p_name, 'bolt|ring')")
def candidate_tables(spark, sf_dir):
    return facts.candidate_tables(read(spark, sf_dir, "part"), "p_name", ["red", "r"], "bolt|ring").select("p_partkey", "p_name", "priority")


@query("SELECT k.k AS path, count(*) AS n FROM (SELECT CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'other' END AS k FROM events) k JOIN (SELECT DISTINCT event_type AS m FROM events WHERE value > 100) m ON k.k = m.m GROUP BY 1")
def endpoint_menus(spark, sf_dir):
    calls = read(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise("other").alias("path"))
    menus = read(spark, sf_dir, "events").where("value > 100").select(F.col("event_type").alias("path")).distinct()
    return calls.groupBy("path").agg(F.count("*").alias("n")).join(menus, "path", "left_semi")


_BUYERS = "SELECT DISTINCT l_partkey AS k, c_custkey, c_nationkey, o_orderkey, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


def _edges(spark, sf_dir):
    """Nations to customers, to orders, to parts."""
    e = read(spark, sf_dir, "customer").selectExpr("'n' || c_nationkey AS src", "'c' || c_custkey AS dst")
    e = e.union(read(spark, sf_dir, "orders").selectExpr("'c' || o_custkey AS src", "'o' || o_orderkey AS dst"))
    return e.union(read(spark, sf_dir, "lineitem").selectExpr("'o' || l_orderkey AS src", "'p' || l_partkey AS dst"))


@query("""WITH s AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 0), c AS (SELECT c_custkey FROM customer WHERE 'n' || c_nationkey IN (SELECT node FROM s)), o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT node, 0 AS depth FROM s UNION ALL SELECT 'c' || c_custkey, 1 FROM c UNION ALL SELECT 'o' || o_orderkey, 2 FROM o UNION ALL SELECT DISTINCT 'p' || l_partkey, 3 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o WHERE o_orderstatus <> 'F')""")
def closure_until(spark, sf_dir):
    start = read(spark, sf_dir, "nation").where("n_regionkey = 0").selectExpr("'n' || n_nationkey AS node")
    stop = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("'o' || o_orderkey AS node")
    return lineage.closure(_edges(spark, sf_dir), start, stop)


@query(f"SELECT 'n' || c_nationkey AS host, count(DISTINCT k) AS n_parts FROM ({_BUYERS}) JOIN part ON p_partkey = k WHERE p_size > 25 GROUP BY 1")
def host_screens(spark, sf_dir):
    # which hosts reach which parts: parts are few beside edges, so pairs go up one level at a time
    parts = read(spark, sf_dir, "part").where("p_size > 25").selectExpr("p_partkey AS row", "p_partkey AS node")
    up = [read(spark, sf_dir, t).selectExpr(f"{a} AS src", f"{b} AS dst") for t, a, b in (("lineitem", "l_partkey", "l_orderkey"), ("orders", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_nationkey"))]
    return lineage.expand(parts, up).groupBy(F.concat(F.lit("n"), "node").alias("host")).agg(F.count("*").alias("n_parts"))


@query("SELECT o_orderkey, s_suppkey FROM (SELECT o_orderkey, o_custkey * 3 AS lo, o_custkey * 3 + o_orderkey % 20 AS hi FROM orders) a JOIN (SELECT s_suppkey, s_suppkey * 31 AS lo, s_suppkey * 31 + s_suppkey % 9 AS hi FROM supplier) b ON a.lo <= b.hi AND b.lo <= a.hi")
def unit_overlap(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 3).alias("lo"), (F.col("o_custkey") * 3 + F.col("o_orderkey") % 20).alias("hi"))
    b = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 31).alias("lo"), (F.col("s_suppkey") * 31 + F.col("s_suppkey") % 9).alias("hi"))
    return intervals.overlaps(a, b, 16).select("o_orderkey", "s_suppkey")
