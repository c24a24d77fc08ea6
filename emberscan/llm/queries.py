"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscan.llm import chat, langid, links, minhash, mixing, packing, phrases, quantised, repair, rules, suffixes, token_cache, token_files
from emberscan.llm.store import new_path, remove, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op5_genetic_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own each time: every content of the table is a miss and is encoded once."""
    counts = token_cache.count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"), "piece_bpe_32k.model")
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op10_host_rules", """
    WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
    worded AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
                      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM rows_),
    grams AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM worded)),
    again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    covered AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM again, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
    counts AS (
        SELECT d.r, doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
               (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
        FROM worded d LEFT JOIN covered c USING (r)),
    failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
    hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failed GROUP BY host),
    moments AS (SELECT least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS m, var_pop(f / n) AS v, avg(1 / n) AS inverse, sum(n) / count(*) AS size FROM hosts),
    between_ AS (SELECT *, v - m * (1 - m) * inverse AS b FROM moments),
    prior AS (SELECT m, CASE WHEN b > 0 AND m * (1 - m) / b - 1 > 0 THEN m * (1 - m) / b - 1 ELSE size END AS s FROM between_),
    rates AS (SELECT host, (f + m * s) / (n + m * s + (1 - m) * s) AS rate FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {limit} AS kept, failed.host,
           round(rate, 9) AS host_rate
    FROM failed JOIN rates ON failed.host IS NOT DISTINCT FROM rates.host""".format(limit=rules.HOST_LIMIT))
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.host_rules(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rate")


@query("op3_minhash", """
    WITH RECURSIVE worded AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    runs AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM worded WHERE len(w) > 0),
    sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s FROM runs),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
    reach AS (SELECT DISTINCT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHashConfig(words=4))


@query("op8_suffixes")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"))


@query("op4_product_quantisation")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_link_graph")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.judge(table(spark, sf_dir, "pages"))


@query("op1_chat_roles")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op7_soft_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    try:
        token_files.write_tokens(table(spark, sf_dir, "documents"), folder, "byte_bpe_50k.json")
        with workspace(spark) as keep:
            return keep(token_files.read_digests(spark, folder))
    finally:
        remove(spark, folder)


@query("op11_phrases", """
    WITH texts AS (
        SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
    worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
    sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM worded),
    runs AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM sized),
    counted AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
    candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 30),
    cuts AS (SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM candidates),
    scored AS (
        SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
        FROM cuts c
        JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
        JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_sizes AS (SELECT lang, w, a, size, unnest(range(2, size)) AS s FROM candidates),
    covers AS (SELECT lang, unnest(list_transform(range(1, size - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase, a AS f FROM inner_sizes),
    covered AS (SELECT lang, phrase, max(f) AS f FROM covers GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN covered v ON v.lang = b.lang AND v.phrase = b.phrase
             WHERE v.f IS NULL OR 100::HUGEINT * v.f < 80::HUGEINT * b.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    with workspace(spark) as keep:
        return keep(repair.repair_report(repair.damage(conversations), conversations))
