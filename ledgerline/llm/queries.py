"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import conversations, dedup, embedding_dedup, filter_audit, html_text, licenses, lm_score, mixing, ngram_join, packing, token_counts, toxicity, weighted_sampling
from ledgerline.llm.common import crc_mod

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup.copies(_read(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def source_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the mix: sizes and targets, to a thousandth of a word."""
    return op4_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the license scan: words and the places of the base phrases."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels")))
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(_read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_html_main_text": op3_html_main_text,
        "op4_source_mixing": op4_source_mixing,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_license_scan": op6_license_scan,
        "op7_toxicity": op7_toxicity,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_filter_audit": op11_filter_audit,
        "op12_document_fingerprints": op12_document_fingerprints,
        "op13_conversation_repair": op13_conversation_repair,
        "source_mixing_targets": source_mixing_targets,
        "license_base_places": license_base_places,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept,
                   sha256(t) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
            WINDOW w AS (PARTITION BY t)""",
        "source_mixing_targets": r"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
            s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY 1),
            w AS (SELECT *, (r - 1) % 3 + 1 AS weight, CAST(3 * source_size AS DOUBLE) AS cap, sum(source_size) OVER () AS total FROM s),
            -- if the sources before this one, by the level at which they are full, are full, the others share the rest
            x AS (SELECT *, cap / weight AS full_at, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
            l AS (SELECT max(level) AS level FROM x WHERE level <= full_at)
            SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(least(cap, l.level * weight), 3) AS target FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source CROSS JOIN l""",
        "license_base_places": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            h AS (SELECT doc_id, len(w) AS n_words, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
                    list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM w)
            SELECT doc_id, n_words, len(m) + len(a) + len(g) AS n_base, list_min(list_concat(m, a, g)) - 1 AS first_word, list_max(list_concat(m, a, g)) - 1 AS last_word,
                   array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM h""",
        "op8_ngram_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
            r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)""",
        "op9_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
            l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
            r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
            SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1) LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)""",
        "op11_filter_audit": r"""
            WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
            w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
            e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
            g AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
            f AS (SELECT part, (g.quality = 1) IS TRUE AS good, (g.toxic = 1) IS TRUE AS bad,
                    [x.l FOR x IN [{'l': 'A', 'f': len(w) < 200}, {'l': 'B', 'f': 100 * len(list_distinct(w)) < 50 * len(w)},
                      {'l': 'C', 'f': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)}, {'l': 'D', 'f': regexp_matches(t, '[#$%&*|]')},
                      {'l': 'E', 'f': coalesce(w.doc_id > e.least, false)}] IF x.f] AS m
                  FROM w JOIN e USING (t) LEFT JOIN g ON g.doc_id = w.doc_id),
            c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY 1, 2),
            l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
            o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
            s AS (SELECT part, filter_order, step, filter_order[step] AS x, string_split(filter_order[1:step - 1], '') AS prior FROM (SELECT DISTINCT part FROM d), o, range(1, 6) r(step)),
            r AS (SELECT s.part, s.filter_order, s.step, s.x,
                    coalesce(sum(n) FILTER (NOT list_contains(m, x) AND NOT list_has_any(m, prior)), 0) AS kept,
                    coalesce(sum(n) FILTER (list_contains(m, x) AND NOT list_has_any(m, prior)), 0) AS removed,
                    coalesce(sum(n) FILTER (list_contains(m, x) AND list_has_any(m, prior)), 0) AS redundant,
                    coalesce(sum(n) FILTER (m = [x]), 0) AS unique_fails,
                    coalesce(sum(good) FILTER (list_contains(m, x) AND NOT list_has_any(m, prior)), 0) AS good_lost,
                    coalesce(sum(bad) FILTER (list_contains(m, x) AND NOT list_has_any(m, prior)), 0) AS toxic_lost
                  FROM s JOIN c ON c.part = s.part GROUP BY 1, 2, 3, 4)
            SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
                   CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r""",
    }
