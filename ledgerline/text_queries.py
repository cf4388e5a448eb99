"""Queries of the scalar text functions, over whole driver tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.queries import query, read

_SNAKE = "lower(replace(p_name, ' ', '_'))"
_CAMEL = "array_to_string(list_transform(string_split({x}, '_'), lambda s, i: CASE WHEN i = 1 THEN s ELSE upper(s[1]) || s[2:] END), '')"


@query(f"""SELECT p_partkey, camel, lower(regexp_replace(camel, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake,
CASE WHEN regexp_matches(p_name, '(^|[^aeiou])y$') THEN regexp_replace(p_name, 'y$', 'ies') WHEN regexp_matches(p_name, '(s|sh|ch|x|z)$') THEN p_name || 'es' ELSE p_name || 's' END AS plural
FROM (SELECT p_partkey, p_name, {_CAMEL.format(x=_SNAKE)} AS camel FROM part)""")
def name_cases(spark, sf_dir):
    low = F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return read(spark, sf_dir, "part").withColumn("camel", text.camel(low)).select("p_partkey", "camel", text.snake(F.col("camel")).alias("snake"), text.plural(F.col("p_name")).alias("plural"))


@query(f"""SELECT p_partkey, {_CAMEL.format(x="lower(regexp_replace(c, '^[a-zA-Z]+[0-9]+_', ''))")} AS property, regexp_replace(c, '^[a-zA-Z]+[0-9]+_', '') AS stripped
FROM (SELECT p_partkey, regexp_replace(p_brand, '#', '') || '_' || replace(p_name, ' ', '_') AS c FROM part)""")
def column_property(spark, sf_dir):
    c = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    return read(spark, sf_dir, "part").select("p_partkey", text.property_name(c).alias("property"), text.strip_prefix(c).alias("stripped"))


@query("""SELECT n, count(*) AS n_parts FROM (SELECT CASE WHEN starts_with(m, 'is') AND length(m) > 4 THEN m[3:] ELSE m END AS n FROM
(SELECT regexp_replace(lower(CASE WHEN p_size > 25 THEN 'is' ELSE '' END || p_name || p_brand), '[^0-9a-z]', '', 'g') AS m FROM part)) GROUP BY 1""")
def norm_names(spark, sf_dir):
    name = F.concat(F.when(F.col("p_size") > 25, "is").otherwise(""), "p_name", "p_brand")
    return read(spark, sf_dir, "part").groupBy(text.norm_name(name).alias("n")).agg(F.count("*").alias("n_parts"))


@query(r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'),
lambda w: NOT list_contains(['null','true','false','and','or','not','test','in','is','size','length','empty','equals','eq','ne'], lower(w))),
lambda w: CASE WHEN starts_with(regexp_replace(lower(w), '[^0-9a-z]', '', 'g'), 'is') AND length(regexp_replace(lower(w), '[^0-9a-z]', '', 'g')) > 4 THEN regexp_replace(lower(w), '[^0-9a-z]', '', 'g')[3:] ELSE regexp_replace(lower(w), '[^0-9a-z]', '', 'g') END))), ' ') AS names FROM conversations""")
def identifier_sets(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.identifier_tokens(F.col("text")), " ").alias("names"))


@query(r"""SELECT CASE WHEN starts_with(p, '/api/') THEN p ELSE '/api' || p END AS template, count(*) AS n FROM (SELECT '/' || regexp_replace(regexp_replace(regexp_replace(string_split(u, '?')[1], '\$\{[^}]*\}', '{}', 'g'), '\{[^}/]*\}', '{}', 'g'), '^/+|/+$', '', 'g') AS p
FROM (SELECT regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '/([0-9]+)', CASE WHEN page_id % 2 = 0 THEN '/{id}' ELSE '/${item.id}' END, 'g') AS u FROM pages)) GROUP BY 1""")
def url_templates(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    path = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(path, "/([0-9]+)", "/{id}")).otherwise(F.regexp_replace(path, "/([0-9]+)", r"/\${item.id}"))
    return read(spark, sf_dir, "pages").groupBy(text.normal_url(path).alias("template")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, CASE WHEN u = '' THEN '(not set)' WHEN regexp_matches(u, '://[^@]*@') THEN regexp_extract(u, '^(.*?)://', 1) || '://' || regexp_extract(u, '^[^@]*?://([^:@]*)', 1) || ':***@' || regexp_extract(u, '^.*?://[^@]*@(.*)$', 1) ELSE u END AS shown
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pass' || page_id || '@') ELSE '' END AS u FROM pages)""")
def url_redaction(spark, sf_dir):
    u = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.replace(F.col("url"), F.lit("://"), F.concat(F.lit("://user:pass"), F.col("page_id"), F.lit("@")))).otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", text.redact_url(u).alias("shown"))


_MASKED = r"regexp_replace(regexp_replace(regexp_replace(t, '\b\d{6}-?[1-8]\d{6}\b', '******-*******', 'g'), 'eyJ[\w-]+\.[\w-]+\.[\w-]+', 'eyJ…(JWT)', 'g'), '(Using generated security password:\s*)\S+', '\1****', 'g')"
_SECRETS = "text || CASE doc_id % 4 WHEN 0 THEN ' 900101-1234567 ' || doc_id WHEN 1 THEN ' eyJabc' || doc_id || '.def.ghi_-' WHEN 2 THEN ' Using generated security password: x' || doc_id ELSE '' END"


@query(rf"""SELECT doc_id, sha256({_MASKED}) AS masked_hash, CAST(len(regexp_extract_all(t, '\b\d{{6}}-?[1-8]\d{{6}}\b')) + len(regexp_extract_all(t, 'eyJ[\w-]+\.[\w-]+\.[\w-]+')) + len(regexp_extract_all(t, '(Using generated security password:\s*)\S+')) AS BIGINT) AS n_masked
FROM (SELECT doc_id, {_SECRETS} AS t FROM documents)""")
def mask_secrets(spark, sf_dir):
    extra = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(' 900101-1234567 ', doc_id) WHEN 1 THEN concat(' eyJabc', doc_id, '.def.ghi_-') WHEN 2 THEN concat(' Using generated security password: x', doc_id) ELSE '' END")
    masked, n = text.mask_sensitive(F.concat("text", extra))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_hash"), n.alias("n_masked"))


_LINE = r"list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1]"


@query(f"SELECT doc_id, sha256({_LINE}) AS line_hash, length({_LINE}) AS n FROM documents")
def first_lines(spark, sf_dir):
    line = text.first_line(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(line, 256).alias("line_hash"), F.length(line).cast("long").alias("n"))


_KEY = rf"substr(regexp_replace(regexp_replace(regexp_replace({_LINE}, '\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\b', '#', 'g'), '\b[0-9a-fA-F]{{8,}}\b', '#', 'g'), '\b\d+\b', '#', 'g'), 1, 80)"
_LOG = "SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 300 THEN 'WARN' ELSE 'INFO' END AS level, 'app.' || event_type AS logger, chr(10) || '  ' || event_type || ' at item ' || event_id || ' of 0123456789abcdef0 in ' || CAST(event_id % 3 AS VARCHAR) || 'x' AS text FROM events"


@query(f"""SELECT level, logger, key, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id) AS n_traces, min(event_id) AS sample_id FROM (SELECT *, {_KEY} AS key FROM ({_LOG})) GROUP BY 1, 2, 3""")
def error_groups_full(spark, sf_dir):
    from ledgerline.operators import logs

    return logs.error_report(log_table(spark, sf_dir), "level", "logger", "text", "ts", "user_id", "event_id")


def log_table(spark, sf_dir):
    """Log records made of events: level, logger, and a message whose first line is empty."""
    e = read(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 300, "WARN").otherwise("INFO")
    message = F.concat(F.lit("\n  "), "event_type", F.lit(" at item "), "event_id", F.lit(" of 0123456789abcdef0 in "), (F.col("event_id") % 3).cast("string"), F.lit("x"))
    return e.select("event_id", "ts", "user_id", level.alias("level"), F.concat(F.lit("app."), "event_type").alias("logger"), message.alias("text"))


@query("SELECT doc_id, CASE WHEN len(c) > 0 THEN c[-1] WHEN len(d) > 0 THEN d[-1] ELSE NULL END AS cause FROM (SELECT doc_id, list_transform(list_filter(l, lambda x: contains(x, 'Caused by:')), lambda x: trim(x)) AS c, list_transform(list_filter(l, lambda x: contains(x, '### Cause:')), lambda x: trim(x)) AS d FROM (SELECT doc_id, string_split('start' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' Caused by: a' || doc_id || chr(10) || 'Caused by: b ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '### Cause: c' ELSE '' END, chr(10)) AS l FROM documents))")
def last_causes(spark, sf_dir):
    log = F.concat(F.lit("start"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n Caused by: a"), "doc_id", F.lit("\nCaused by: b "))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, "\n### Cause: c").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", text.last_cause(F.split(log, "\n")).alias("cause"))


@query(r"SELECT o_orderkey, array_to_string(list_transform(string_split(o_orderstatus || '(String), ' || o_custkey || '(Long), ' || o_orderpriority, ', '), lambda x: substr(regexp_replace(x, '\([A-Za-z]+\)$', ''), 1, 60)), '|') AS params FROM orders")
def parameter_lists(spark, sf_dir):
    logged = F.concat("o_orderstatus", F.lit("(String), "), "o_custkey", F.lit("(Long), "), "o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.param_values(logged), "|").alias("params"))


@query("SELECT item_id, CASE WHEN length(text) > 40 THEN text[:39] || '…' ELSE text END AS short FROM benchmark")
def short_texts(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", text.truncated(F.col("text"), 40).alias("short"))


@query("SELECT p_brand, array_to_string(list_sort(names)[:12], ', ') || CASE WHEN len(names) > 12 THEN ' … +' || (len(names) - 12) ELSE '' END AS names FROM (SELECT p_brand, list(DISTINCT p_name) AS names FROM part GROUP BY 1)")
def capped_lists(spark, sf_dir):
    named = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))  # names are few: colours times things
    return named.select("p_brand", text.listing(F.col("names")).alias("names"))


@query("SELECT c_custkey, sha1(CAST('blob ' || strlen(c_name || c_mktsegment) AS BLOB) || '\\x00'::BLOB || CAST(c_name || c_mktsegment AS BLOB)) AS blob_hash FROM customer")
def blob_hashes(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.blob_sha1(F.concat("c_name", "c_mktsegment")).alias("blob_hash"))


@query("SELECT p_partkey, sha256(concat_ws(chr(31), CAST(p_partkey AS VARCHAR), p_name, p_brand, CAST(p_size AS VARCHAR))) AS content_hash FROM part")
def card_hashes(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.record_hash(F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("content_hash"))


@query("""SELECT version, CAST(row_number() OVER (ORDER BY a, b, c) AS BIGINT) AS place FROM (SELECT DISTINCT 'v' || (p_size % 3) || '.' || (p_size % 12) || '.' || CASE WHEN p_size % 5 = 0 THEN 'rc' ELSE CAST(p_size AS VARCHAR) END AS version,
p_size % 3 AS a, p_size % 12 AS b, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS c FROM part)""")
def version_order(spark, sf_dir):
    from pyspark.sql.window import Window

    size = F.col("p_size")
    v = F.concat(F.lit("v"), size % 3, F.lit("."), size % 12, F.lit("."), F.when(size % 5 == 0, "rc").otherwise(size.cast("string")))
    versions = read(spark, sf_dir, "part").select(v.alias("version")).distinct()  # as many as p_size has values
    return versions.select("version", F.row_number().over(Window.orderBy(text.version_key(F.col("version")))).cast("long").alias("place"))


@query("SELECT event_id, ts - INTERVAL 1 SECOND * CAST(s AS BIGINT) AS since FROM (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 30 WHEN 1 THEN 600 WHEN 2 THEN 5400 WHEN 3 THEN 172800 END AS s FROM events)")
def relative_range(spark, sf_dir):
    span = F.element_at(F.array(F.lit("30s"), F.lit("10m"), F.lit("1.5h"), F.lit("2d"), F.lit("soon")), (F.col("event_id") % 5 + 1).cast("int"))
    seconds = text.duration_seconds(span)
    return read(spark, sf_dir, "events").select("event_id", (F.col("ts") - F.make_dt_interval(secs=seconds)).alias("since"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_paths(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(text.row_json(F.col("props"), "$.data.k", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT array_to_string(list_sort(json_keys(props)), ',') AS fields, count(*) AS n_rows FROM events GROUP BY 1")
def json_summary(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.array_join(F.array_sort(F.json_object_keys("props")), ",").alias("fields")).agg(F.count("*").alias("n_rows"))


@query("SELECT n_name, arg_min(r_name, levenshtein(lower(n_name), lower(r_name)) * 100000 + r_regionkey) AS suggestion, min(levenshtein(lower(n_name), lower(r_name))) AS distance FROM nation JOIN region ON n_regionkey <= r_regionkey GROUP BY 1")
def suggestions(spark, sf_dir):
    # candidates are a small table of names: each name meets those by a range of keys, the nearest stays
    r = F.broadcast(read(spark, sf_dir, "region"))
    met = read(spark, sf_dir, "nation").join(r, F.col("n_regionkey") <= F.col("r_regionkey"))
    d = F.levenshtein(F.lower("n_name"), F.lower("r_name"))
    return met.groupBy("n_name").agg(F.min_by("r_name", F.struct(d, F.col("r_regionkey"))).alias("suggestion"), F.min(d).cast("long").alias("distance"))


@query("SELECT page_id, url_encode(url_decode(u)) AS encoded FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url_encode(url) ELSE url END AS u FROM pages)")
def encode_once(spark, sf_dir):
    raw = F.when(F.col("page_id") % 2 == 0, F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", F.replace(F.url_encode(F.url_decode(raw)), F.lit("+"), F.lit("%20")).alias("encoded"))
