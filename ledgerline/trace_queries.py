"""Queries of evidence, pairing, statements, usages with sources, paths and names, over whole driver tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators import evidence as proofs
from ledgerline.operators import catalog, facts, lineage, names, ordered, pairing, statements
from ledgerline.operators.synthesis import Made, Maker, key_faults
from ledgerline.queries import query, read
from ledgerline.shared import shared_dir
from ledgerline.sources import snapshot

# -- evidence: each document cites two of its lines; then texts are indented, wrapped anew, or changed at their head

_NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_CITED = f"""WITH d AS (SELECT doc_id, source, 1 + doc_id % 3 AS a, 2 + doc_id % 3 AS b, string_split(text, chr(10)) AS l,
  CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN chr(10) || 'top' || chr(10) || '    ' || replace(text, chr(10), chr(10) || '    ') WHEN 2 THEN replace(text, '. ', '.' || chr(10)) ELSE 'x ' || text END AS new FROM documents),
e AS (SELECT doc_id, source, a, b, CASE WHEN b <= len(l) THEN nullif({_NORM.format("array_to_string(l[a:b], ' ')")}, '') END AS excerpt, string_split(new, chr(10)) AS nl FROM d),
w AS (SELECT *, list_filter(list_transform(nl, lambda x, i: {{'i': i, 't': {_NORM.format("x")}}}), lambda z: z.t <> '') AS f FROM e),
k AS (SELECT doc_id, a, f, excerpt, unnest(range(1, len(f) + 1)) AS k FROM w WHERE excerpt IS NOT NULL),
h AS (SELECT doc_id, a, f[k].i AS first, f[list_filter(range(k, len(f) + 1), lambda j: length(array_to_string(list_transform(f[k:j], lambda z: z.t), ' ')) = length(excerpt))[1]].i AS last FROM k
  WHERE starts_with(array_to_string(list_transform(f[k:], lambda z: z.t), ' '), excerpt)),
m AS (SELECT doc_id, arg_min({{'first': first, 'last': last}}, abs(first - a) * 1000000 + first) AS p FROM h WHERE last IS NOT NULL GROUP BY 1),
s AS (SELECT w.doc_id, source, a, CASE WHEN excerpt IS NOT NULL AND {_NORM.format("array_to_string(nl[a:b], ' ')")} = excerpt THEN 'OK' WHEN p IS NOT NULL THEN 'MOVED' WHEN a > len(nl) THEN 'MISSING' ELSE 'STALE' END AS status, p FROM w LEFT JOIN m USING (doc_id))"""


def _checked(spark, sf_dir):
    d, i, t = read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")
    places = d.select("doc_id", "source", F.col("doc_id").cast("string").alias("path"), (1 + i % 3).alias("line"), (2 + i % 3).alias("line_end"))
    old = d.select(i.cast("string").alias("path"), "text")
    cited = proofs.cite(old, places, "path", "text", "line", "line_end")
    new = F.when(i % 4 == 0, t).when(i % 4 == 1, F.concat(F.lit("\ntop\n    "), F.replace(t, F.lit("\n"), F.lit("\n    ")))).when(i % 4 == 2, F.replace(t, F.lit(". "), F.lit(".\n"))).otherwise(F.concat(F.lit("x "), t))
    return proofs.check(d.select(i.cast("string").alias("path"), new.alias("text")), cited, "path", "text", "line", "line_end", "excerpt")


@query(f"{_CITED} SELECT doc_id, a AS line, status, CASE WHEN status = 'MOVED' THEN p.first END AS new_line, CASE WHEN status = 'MOVED' THEN p.last END AS new_end FROM s")
def evidence_places(spark, sf_dir):
    return _checked(spark, sf_dir).select("doc_id", "line", "status", "new_line", "new_end")


@query(f"{_CITED} SELECT r.source, coalesce(['OK', 'MOVED', 'STALE', 'MISSING'][max(list_position(['OK', 'MOVED', 'STALE', 'MISSING'], status))], 'MISSING') AS status, count(status) AS n_evidence FROM (SELECT DISTINCT source FROM documents UNION SELECT 'none') r LEFT JOIN s ON s.source = r.source GROUP BY 1")
def rule_verification(spark, sf_dir):
    rules = read(spark, sf_dir, "documents").select("source").union(spark.sql("SELECT 'none' AS source"))
    return proofs.verify(rules, _checked(spark, sf_dir), "source")


# -- pairing and statements


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size <= 25 AS l, list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))) AS t FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, l, t ORDER BY p_partkey) AS r FROM p)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, a.p_partkey AS "left", b.p_partkey AS "right", CASE WHEN b.p_partkey IS NULL THEN 'left' WHEN a.p_partkey IS NULL THEN 'right' ELSE 'same' END AS how
FROM (SELECT * FROM r WHERE l) a FULL JOIN (SELECT * FROM r WHERE NOT l) b ON a.p_brand = b.p_brand AND a.t = b.t AND a.r = b.r""")
def condition_pairs(spark, sf_dir):
    return pairing.pair(*_conditions(spark, sf_dir), ["p_brand"], "ids", "p_partkey").drop("overlap")


def _conditions(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ").alias("ids"))
    return p.where("p_size <= 25"), p.where("p_size > 25")


@query("""WITH RECURSIVE p AS (SELECT p_brand, p_size <= 25 AS l, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))), chr(31)) AS t, count(*) AS n FROM part GROUP BY ALL),
c AS (SELECT a.p_brand, a.t AS l, b.t AS r, a.n AS nl, b.n AS nr, len(list_intersect(string_split(a.t, chr(31)), string_split(b.t, chr(31)))) / len(list_distinct(string_split(a.t, chr(31)) || string_split(b.t, chr(31)))) AS o FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.l AND NOT b.l),
s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY l <> r, -o, l, r) AS k FROM c WHERE o >= 0.5),
w AS (SELECT DISTINCT p_brand, CAST(0 AS BIGINT) AS k, MAP() AS ul, MAP() AS ur, CAST(0 AS BIGINT) AS m, false AS near FROM s
  UNION ALL SELECT w.p_brand, s.k, map_concat(ul, MAP {s.l: coalesce(ul[s.l], 0) + t.m}), map_concat(ur, MAP {s.r: coalesce(ur[s.r], 0) + t.m}), t.m, s.l <> s.r
  FROM w JOIN s ON s.p_brand = w.p_brand AND s.k = w.k + 1, LATERAL (SELECT least(s.nl - coalesce(ul[s.l], 0), s.nr - coalesce(ur[s.r], 0)) AS m) t)
SELECT p_brand, CAST(coalesce(sum(m) FILTER (NOT near), 0) AS BIGINT) AS n_same, CAST(coalesce(sum(m) FILTER (near), 0) AS BIGINT) AS n_near FROM w GROUP BY 1""".replace("MAP()", "CAST(MAP {} AS MAP(VARCHAR, BIGINT))"))
def condition_pairs_near(spark, sf_dir):
    got = pairing.pair(*_conditions(spark, sf_dir), ["p_brand"], "ids", "p_partkey", 50)
    return got.groupBy("p_brand").agg(F.count_if(F.col("how") == "same").alias("n_same"), F.count_if(F.col("how") == "near").alias("n_near")).where("n_same + n_near > 0")


_LOWER = "array_to_string(list_transform(string_split({}, chr(39)), lambda x, i: CASE WHEN i % 2 = 1 THEN lower(x) ELSE x END), chr(39))"
_SAID = _LOWER.format("trim(regexp_replace(regexp_replace({}, '--[^\\n]*', '', 'g'), '\\s+', ' ', 'g'))")
_OLD = "SELECT p_partkey AS id, 'SELECT Name FROM Part -- ' || p_type || chr(10) || 'WHERE Brand = ''' || p_brand || ''' AND size > ' || p_size AS sql FROM part"
_NEW = """SELECT CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS id, CASE p_partkey % 4 WHEN 0 THEN 'SELECT Name FROM Part -- ' || p_type || chr(10) || 'WHERE Brand = ''' || p_brand || ''' AND size > ' || p_size
WHEN 1 THEN 'select name' || chr(10) || '  from part where brand = ''' || p_brand || ''' and size > ' || p_size WHEN 2 THEN 'SELECT Name FROM Part WHERE Brand = ''' || lower(p_brand) || ''' AND size > ' || p_size ELSE 'SELECT Name FROM Part WHERE Brand = ''' || p_brand || ''' AND size >= ' || p_size END AS sql FROM part"""


@query(f"""WITH o AS (SELECT id, sql, {_SAID.format("sql")} AS n FROM ({_OLD})), w AS (SELECT id, sql, {_SAID.format("sql")} AS n FROM ({_NEW}))
SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN CASE WHEN o.n IN (SELECT n FROM w) THEN 'moved' ELSE 'deleted' END WHEN o.sql = w.sql THEN 'same' WHEN o.n = w.n THEN 'format' ELSE 'changed' END AS status,
CASE WHEN o.id = w.id AND o.n <> w.n THEN CASE w.id % 4 WHEN 2 THEN '- ' || regexp_extract(o.sql, '''[^'']*''') || ' / + ' || regexp_extract(w.sql, '''[^'']*''') ELSE '- > / + >=' END END AS summary FROM o FULL JOIN w ON o.id = w.id""")
def statement_drift(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    old, new = part.selectExpr("p_partkey AS id", _OLD_EXPR), part.selectExpr("CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS id", _NEW_EXPR)
    return statements.drift(old, new, ["id"], "sql").drop("changes")


_HEAD = "concat('SELECT Name FROM Part -- ', p_type, chr(10), 'WHERE Brand = \\'', p_brand, '\\' AND size > ', p_size)"
_OLD_EXPR = f"{_HEAD} AS sql"
_NEW_EXPR = f"""CASE p_partkey % 4 WHEN 0 THEN {_HEAD} WHEN 1 THEN concat('select name', chr(10), '  from part where brand = \\'', p_brand, '\\' and size > ', p_size)
WHEN 2 THEN concat('SELECT Name FROM Part WHERE Brand = \\'', lower(p_brand), '\\' AND size > ', p_size) ELSE concat('SELECT Name FROM Part WHERE Brand = \\'', p_brand, '\\' AND size >= ', p_size) END AS sql"""


# -- usages: nations are screens, customers services, orders statements, line flags tables

_OPS = "CASE l_linenumber % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'R' WHEN 2 THEN 'U' ELSE 'D' END"
_USES = f"SELECT DISTINCT 'n' || c_nationkey AS \"row\", lower(l_returnflag) AS \"table\", {_OPS} AS op, 'o' || o_orderkey || ' (c' || c_custkey || ')' AS source, o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"


def _usages(spark, sf_dir, when="true"):
    c = read(spark, sf_dir, "customer")
    start = c.selectExpr("concat('n', c_nationkey) AS row", "concat('c', c_custkey) AS node")
    calls = read(spark, sf_dir, "orders").where(when).selectExpr("concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst")
    usage = read(spark, sf_dir, "lineitem").selectExpr("concat('o', l_orderkey) AS node", "l_returnflag AS table", f"{_OPS} AS op")
    return lineage.crud_usages(start, [calls], usage, via=0)


@query(f'SELECT "row", "table", op, count(*) AS n_sources, min(source) AS first_source, max(source) AS last_source FROM ({_USES}) GROUP BY 1, 2, 3')
def crud_sources(spark, sf_dir):
    return _usages(spark, sf_dir).groupBy("row", "table", "op").agg(F.count("*").alias("n_sources"), F.min("source").alias("first_source"), F.max("source").alias("last_source"))


@query(f"""WITH u AS (SELECT source AS "row", op, "table", o_orderdate FROM (SELECT 'c' || c_custkey AS source, {_OPS} AS op, lower(l_returnflag) AS "table", o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)),
a AS (SELECT DISTINCT "row", "table", op FROM u WHERE o_orderdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT "row", "table", op FROM u WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.op IS NULL THEN 'added' WHEN b.op IS NOT NULL THEN 'both' WHEN a."table" = 'r' AND a.op = 'D' OR a."row" IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0) THEN 'exempt' ELSE 'lost' END AS status
FROM a FULL JOIN b ON a."row" = b."row" AND a."table" = b."table" AND a.op = b.op) GROUP BY 1""")
def crud_sides(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    start = c.selectExpr("concat('c', c_custkey) AS row", "concat('c', c_custkey) AS node")
    usage = read(spark, sf_dir, "lineitem").selectExpr("concat('o', l_orderkey) AS node", "l_returnflag AS table", f"{_OPS} AS op")
    side = lambda when: lineage.crud_usages(start, [read(spark, sf_dir, "orders").where(when).selectExpr("concat('c', o_custkey) AS src", "concat('o', o_orderkey) AS dst")], usage, via=0)
    exempt = c.where("c_acctbal < 0").selectExpr("concat('c', c_custkey) AS row", "cast(NULL AS string) AS table", "cast(NULL AS string) AS op").union(spark.sql("SELECT cast(NULL AS string), 'r', 'D'"))
    got = lineage.crud_compare(side("o_orderdate < timestamp_ntz'1996-01-01'"), side("o_orderdate >= timestamp_ntz'1996-01-01'"), exempt)
    return got.groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT 'r' || n_regionkey AS root, 'n' || n_nationkey AS node FROM nation), c AS (SELECT root, 'c' || c_custkey AS node, node AS parent FROM n JOIN customer ON 'n' || c_nationkey = node),
o AS (SELECT root, 'o' || o_orderkey AS node, node AS parent, parent AS up FROM c JOIN orders ON 'c' || o_custkey = node),
p AS (SELECT root, 'p' || l_partkey AS node, min(node) AS parent FROM o JOIN lineitem ON 'o' || l_orderkey = node GROUP BY 1, 2)
SELECT root, node, 0 AS depth, '' AS path FROM n UNION ALL SELECT root, node, 1, parent FROM c UNION ALL SELECT root, node, 2, up || '>' || parent FROM o
UNION ALL SELECT p.root, p.node, 3, o.up || '>' || o.parent || '>' || p.parent FROM p JOIN o ON o.root = p.root AND o.node = p.parent""")
def call_paths(spark, sf_dir):
    start = read(spark, sf_dir, "nation").selectExpr("concat('r', n_regionkey) AS root", "concat('n', n_nationkey) AS node")
    edges = read(spark, sf_dir, "customer").selectExpr("concat('n', c_nationkey) AS src", "concat('c', c_custkey) AS dst")
    edges = edges.union(read(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey)", "concat('o', o_orderkey)")).union(read(spark, sf_dir, "lineitem").selectExpr("concat('o', l_orderkey)", "concat('p', l_partkey)"))
    return lineage.paths(lineage.call_paths(edges, start)).select("root", "node", "depth", F.array_join("path", ">").alias("path"))


# -- names


@query(r"""WITH n AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]+') AS name FROM documents WHERE regexp_matches(lower(text), '[a-z]')),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS name FROM documents) SELECT name, count(*) AS n_bodies FROM w JOIN n USING (name) GROUP BY 1""")
def used_names(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    asked = d.select(F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("name")).where("name <> ''").distinct()
    return names.used_names(d, asked, "doc_id", "text", "name").groupBy("name").agg(F.count("*").alias("n_bodies"))


_KNOWN = "SELECT DISTINCT upper(p_name[1]) || replace(p_name[2:], ' ', '') || 'Mapper' AS cls, 's' || p_size AS id FROM part"
_CALLS = "SELECT DISTINCT 'k.c.' || upper(p_name[1]) || '.s' || p_size AS logger, CASE WHEN p_partkey % 3 = 0 THEN '/api/v1/' || replace(p_name, ' ', '/') ELSE '/api/v1/zzz' END AS path FROM part"


@query(f"""WITH k AS ({_KNOWN}), c AS ({_CALLS}), m AS (SELECT logger, path, cls, k.id, list_sum(list_transform(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', 'api', 'v1') AND contains(lower(cls), x)), lambda x: length(x))) AS s
FROM c JOIN k ON k.id = string_split(logger, '.')[4] AND starts_with(cls, string_split(logger, '.')[3])), f AS (SELECT logger, path, count(*) AS n, coalesce(max(s), 0) AS top, any_value(id) AS id, list(cls ORDER BY coalesce(s, 0) DESC) AS best, list(coalesce(s, 0) ORDER BY coalesce(s, 0) DESC) AS ss FROM m GROUP BY 1, 2)
SELECT logger, path, CASE WHEN n = 1 OR top > 0 AND ss[1] > ss[2] THEN best[1] || '.' || id ELSE logger END AS name, n AS n_fit FROM f""")
def recovered_names(spark, sf_dir):
    p, name = read(spark, sf_dir, "part"), F.col("p_name")
    first = F.upper(F.substring(name, 1, 1))
    known = p.select(F.concat(first, F.replace(F.expr("substring(p_name, 2)"), F.lit(" "), F.lit("")), F.lit("Mapper")).alias("cls"), F.concat(F.lit("s"), "p_size").alias("id"))
    calls = p.select(F.concat(F.lit("k.c."), first, F.lit(".s"), "p_size").alias("logger"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/api/v1/"), F.replace(name, F.lit(" "), F.lit("/")))).otherwise("/api/v1/zzz").alias("path"))
    return names.recover(calls, known, "logger", "path", "cls", "id")


_MATCH = [("p_brand", "p_type", "p_size"), ("p_brand", "p_type"), ("p_type",)]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT q.p_partkey AS query, c.p_partkey AS card, {i} AS rule FROM part q JOIN (SELECT *, row_number() OVER (PARTITION BY {', '.join(k)} ORDER BY p_partkey) AS r FROM part) c USING ({', '.join(k)}) WHERE r <= 10" for i, k in enumerate(_MATCH, 1)) + """),
u AS (SELECT query, card, min(rule) AS rule FROM c GROUP BY 1, 2) SELECT query, place, card, rule FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rule, card) AS place FROM u) WHERE place <= 5""")
def ordered_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")

    def rule(keys):
        w = Window.partitionBy(*keys).orderBy("p_partkey")
        first = p.select(*keys, F.col("p_partkey").alias("card"), F.row_number().over(w).alias("rank")).where("rank <= 10")  # twice the cap: as many may be seen already
        return lambda left: left.join(first, list(keys)).select("query", "card", "rank")

    return names.ordered_match(p.withColumnRenamed("p_partkey", "query"), [rule(k) for k in _MATCH], "query", 5).withColumn("card", F.col("card").cast("long"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS t FROM documents),
e AS (SELECT *, nullif(regexp_extract(t, '\b([Tt]h[ae][a-z]*) ', 1), '') AS own, CASE WHEN regexp_matches(t, '\b([Tt]h[ae][a-z]*) ') THEN {'at': line_no, 'm': regexp_extract(t, '\b([Tt]h[ae][a-z]*) ', 1)} WHEN regexp_matches(t, '^\s*$') THEN {'at': line_no, 'm': NULL} END AS ev FROM l),
w AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM e)
SELECT doc_id, line_no, coalesce(own, CASE WHEN line_no - up.at < 4 THEN up.m END) AS mark FROM w""")
def nearest_marks(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")
    return ordered.nearest_mark(lines, "doc_id", "line_no", "line", r"\b([Tt]h[ae][a-z]*) ", r"^\s*$", 4)


# -- made rows and catalogs


@query("""SELECT 'region' AS table_name, count(*) AS n_rows, 0 AS n_repeated, 0 AS n_orphans FROM region UNION ALL SELECT 'nation', count(*), 0, 0 FROM nation UNION ALL SELECT 'supplier', count(*), 0, 0 FROM supplier UNION ALL SELECT 'customer', count(*), 0, 0 FROM customer
UNION ALL SELECT 'part', count(*), 0, 0 FROM part UNION ALL SELECT 'orders', count(*), 0, 0 FROM orders UNION ALL SELECT 'lineitem', count(*), 0, 0 FROM lineitem""")
def made_tables(spark, sf_dir):
    """As many rows as each table has; foreign keys to made rows, and to the table's own rows."""
    maker, made, out = Maker(spark), {}, None
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    refers = {"nation": ("region",), "supplier": ("nation",), "customer": ("nation",), "orders": ("customer",), "lineitem": ("orders", "part", "supplier")}
    for name, key in keys.items():
        own = read(spark, sf_dir, name)
        columns = [Made(key, "key", rows=own), Made("code", "unique_text", prefix="T", length=12)] + [Made(f"{p}_key", "parent", table=p, column=keys[p]) for p in refers.get(name, ())]
        columns += [Made("old_key", "existing", rows=own, column=key, nulls=10), Made("made_on", "day", values=("2024-01-01",), most=28), Made("amount", "number", most=1000, digits=2)]
        made[name] = lineage.kept(maker.table(name, own.count(), columns))
        parents = {f"{p}_key": made[p].select(keys[p]) for p in refers.get(name, ())} | {"old_key": own.select(key)}
        rows = key_faults(made[name], [key], parents).withColumn("n_repeated", F.col("n_repeated") + F.col("n_rows") - made[name].select("code").distinct().count())
        rows = rows.select(F.lit(name).alias("table_name"), "n_rows", "n_repeated", "n_orphans")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN quality = 1 OR source = 'src1' THEN 2 ELSE 1 END AS read_in, len(string_split(text, chr(10))) + CASE WHEN quality = 1 THEN 1 ELSE 0 END AS n_lines
FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 1) USING (doc_id) WHERE lang <> 'fr' OR source <> 'src0'""")
def catalog_refresh(spark, sf_dir):
    """A second version: one source of documents is new, one language of another is gone, good documents have a line more."""
    d = read(spark, sf_dir, "documents")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("\n+").alias("more")).distinct()
    later = d.where("lang <> 'fr' OR source <> 'src0'").join(good, "doc_id", "left").withColumn("text", F.concat("text", F.coalesce("more", F.lit(""))))
    folder = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    for docs in (d.where("source <> 'src1'"), later):
        texts = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
        listed = texts.select("path", F.length("text").alias("size"), F.lit(None).cast("timestamp").alias("changed_at"), F.sha2("text", 256).alias("hash"))
        got = snapshot.refresh(listed, lambda stale, t=texts: t.join(stale.select("path"), "path").select("path", F.size(F.split("text", "\n")).alias("n_lines")), folder)
    return got.select("path", "read_in", "n_lines")


# -- facts of screens


@query("""WITH a AS (SELECT user_id AS screen, trim(event_type) AS label, min('f' || hour(ts)) AS n FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1, 2), b AS (SELECT user_id AS screen, trim(event_type) AS label, min('f' || hour(ts)) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1, 2)
SELECT coalesce(a.screen, b.screen) AS screen, coalesce(a.label, b.label) AS label, a.n AS left_name, b.n AS right_name, CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' WHEN a.n = b.n THEN 'same' ELSE 'renamed' END AS status FROM a FULL JOIN b ON a.screen = b.screen AND a.label = b.label""")
def compared_labels(spark, sf_dir):
    """The screens' fields of the first two days and of the last two."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("screen"), F.concat(F.lit(" "), "event_type").alias("label"), F.concat(F.lit("f"), F.hour("ts")).alias("name"), "ts")
    return facts.compared_labels(e.where("ts < timestamp_ntz'2024-01-03'"), e.where("ts >= timestamp_ntz'2024-01-29'"), "screen", "label", "name")


@query("""WITH k AS (SELECT 'mapper' || p_size AS c, p_brand || '.' || 'emp01_mapper' || p_size AS n FROM part), r AS (SELECT c, n, row_number() OVER (PARTITION BY c ORDER BY n) AS r FROM (SELECT DISTINCT c, n FROM k)),
g AS (SELECT c, count(*) AS n_columns, list(n ORDER BY n) FILTER (WHERE r <= 3) AS l FROM r GROUP BY 1), f AS (SELECT DISTINCT o_orderpriority AS label, 'mapper' || o_custkey % 60 AS field FROM orders)
SELECT label, field, coalesce(n_columns, 0) AS n_columns, coalesce(array_to_string(l, ','), '') AS columns FROM f LEFT JOIN g ON c = field""")
def labelled_columns(spark, sf_dir):
    labels = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), F.concat(F.lit("mapper"), F.col("o_custkey") % 60).alias("field"))
    columns = read(spark, sf_dir, "part").select(F.col("p_brand").alias("table"), F.concat(F.lit("emp01_mapper"), "p_size").alias("column"))
    return facts.labelled_columns(labels, columns, "field", "label", "table", "column").withColumn("columns", F.array_join("columns", ","))


@query("SELECT CAST(l_partkey AS VARCHAR) AS file, count(DISTINCT l_suppkey) AS n_screens, count(DISTINCT l_suppkey) > 1 OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR contains(CAST(l_partkey AS VARCHAR), '99') AS shared FROM lineitem GROUP BY l_partkey")
def shared_files(spark, sf_dir):
    uses = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("file"), "l_suppkey")
    return facts.shared_files(uses, "file", "l_suppkey", read(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").cast("string").alias("file")), "99")


@query("""SELECT 'customer' AS parent, table_name AS child, column_name AS child_column FROM information_schema.columns WHERE column_name LIKE '%\\_custkey' ESCAPE '\\' AND table_name = 'orders'
UNION ALL SELECT 'part', table_name, column_name FROM information_schema.columns WHERE column_name LIKE '%\\_partkey' ESCAPE '\\' AND table_name = 'lineitem' UNION ALL SELECT 'region', table_name, column_name FROM information_schema.columns WHERE column_name LIKE '%\\_regionkey' ESCAPE '\\' AND table_name = 'nation'""")
def child_tables(spark, sf_dir):
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    keys = catalog.foreign_keys(catalog.scan(spark, {t: read(spark, sf_dir, t) for t in tables}), lambda c: F.regexp_replace(F.lower(c), "^[a-z]{1,2}_", ""))
    of = lambda p: facts.child_tables(keys, p.upper()).select(F.lit(p).alias("parent"), "child", "child_column")
    return of("customer").union(of("part")).union(of("region"))


@query("SELECT 'R-' || lpad(CAST(max(c_custkey) + 1 AS VARCHAR), CAST(greatest(3, length(CAST(max(c_custkey) + 1 AS VARCHAR))) AS INTEGER), '0') AS next_id FROM customer WHERE c_custkey % 3 <> 0")
def next_id(spark, sf_dir):
    used = read(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "X-").otherwise("R-"), F.format_string("%03d", "c_custkey")).alias("rule"))
    return facts.next_id(used, "rule")


@query("""WITH m AS (SELECT DISTINCT user_id AS url, event_type AS menu FROM events WHERE event_type <> 'view'), c AS (SELECT user_id AS url, count(*) AS n FROM events WHERE value < 5 GROUP BY 1)
SELECT url, n, CASE WHEN url NOT IN (SELECT url FROM m WHERE url % 5 <> 0) THEN 'open' WHEN url IN (SELECT url FROM m WHERE url % 5 <> 0 AND menu = 'error') THEN 'granted' ELSE 'refused' END AS verdict FROM c""")
def authorised(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_type").alias("menu"), "value")
    return facts.authorised(e.where("value < 5"), e.where("menu <> 'view' and url % 5 <> 0"), spark.sql("SELECT 'error' AS menu"), "url", "menu")
