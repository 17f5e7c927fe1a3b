"""The registered queries of the corpus operators, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import ann, line_dedup, mixing, packing, quality, simhash, token_counts, toxicity, url_filters, warc
from framelake.session import materialise, shared_folder

#: The fixed rules that op10 judges by: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]




def vocabulary(name: str) -> str:
    """The place of a public tokenizer file, which every node has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    found = warc.read_archive(spark, path)
    # A response's length and digest are those of the bytes read back; a revisit has its headers only.
    body = F.col("payload").isNotNull()
    return found.select(
        warc.record_key("record_id").alias("page_id"),
        F.when(body, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(body, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.record_key("refers_to").alias("refers_to"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # The word counts are needed three times: count once, and mix the narrow rows.
    sized = materialise(docs.select("doc_id", "source", mixing.word_count("text").alias("words")), "sizes")
    mixed = mixing.mix_sources(sized, size=F.col("words"))
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        F.col("shards"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", "removed_words", "removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.apply_rules(pages, url_filters.rule_table(spark, RULES))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_url_filters": op10_url_filters,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def _grid(v: str) -> str:
    """SQL of a value cut to six significant binary digits."""
    return f"({v} // (1 << greatest(length(bin({v})) - 6, 0))::BIGINT) * (1 << greatest(length(bin({v})) - 6, 0))::BIGINT"


ORACLES = {
    "op2_warc_round_trip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
""",
    "op10_url_filters": r"""
WITH rules(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN (
    SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
    FROM (SELECT DISTINCT host, path FROM p) q JOIN rules ON (q.host = rhost OR ends_with(q.host, '.' || rhost)) AND starts_with(q.path, rpath)
    GROUP BY host, path) m ON p.host = m.host AND p.path = m.path
""",
    "op5_quality_rules": rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
x AS (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM w),
win AS (SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM x WHERE len(words) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, range(0, 8) t(k) GROUP BY r),
f AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM x LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
rates AS (SELECT *, n_symbols * 100000 // greatest(n_words, 1) AS symbol_rate, n_dup_lines * 100000 // greatest(n_lines, 1) AS line_rate,
    n_repeat_words * 100000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length FROM b),
long AS (SELECT lang, source, unnest(['symbol_rate', 'line_rate', 'repeat_rate', 'word_length']) AS rate,
    unnest([symbol_rate, line_rate, repeat_rate, word_length]) AS v FROM rates WHERE NOT base_failed),
grid AS (SELECT lang, source, rate, {_grid("v")} AS v FROM long),
lev AS (SELECT 0 AS level, lang, source, rate, v FROM grid UNION ALL SELECT 1, lang, NULL, rate, v FROM grid UNION ALL SELECT 2, NULL, NULL, rate, v FROM grid),
cell AS (SELECT level, lang, source, rate, v, count(*) AS n FROM lev GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY v) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM cell),
q AS (SELECT level, lang, source, rate, max(total) AS total, any_value(reach) AS reach, min(v) FILTER (upto * 100 >= total * (100 - p)) AS less,
    min(v) FILTER (upto * 100 >= total * 50) AS middle, min(v) FILTER (upto * 100 >= total * p) AS more
    FROM cum JOIN (VALUES ('symbol_rate', 95, 1), ('line_rate', 99, 1), ('repeat_rate', 99, 1), ('word_length', 90, 6)) t(rate, p, reach) USING (rate) GROUP BY ALL),
lim AS (SELECT level, lang, source, rate, total, greatest(less - reach * (middle - less) // 2, 0) AS low, more + reach * (more - middle) // 2 AS high FROM q),
grp AS (SELECT DISTINCT lang, source FROM long),
pick AS (SELECT g.lang, g.source, a.rate, (a.total * a.low + 200 * ((b.total * b.low + 200 * c.low) // (b.total + 200))) // (a.total + 200) AS low,
    greatest((a.total * a.high + 200 * ((b.total * b.high + 200 * c.high) // (b.total + 200))) // (a.total + 200), CASE WHEN a.rate = 'word_length' THEN 0 ELSE 5000 END) AS high
    FROM grp g JOIN lim a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source
    JOIN lim b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM g.lang AND b.rate = a.rate JOIN lim c ON c.level = 2 AND c.rate = a.rate),
cut AS (SELECT lang, source, doc_id, {_grid("symbol_rate")} AS symbol_rate, {_grid("line_rate")} AS line_rate, {_grid("repeat_rate")} AS repeat_rate, {_grid("word_length")} AS word_length FROM rates),
bad AS (SELECT r.doc_id FROM cut r JOIN pick p
    ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source
    WHERE (p.rate = 'symbol_rate' AND r.symbol_rate > p.high) OR (p.rate = 'line_rate' AND r.line_rate > p.high)
    OR (p.rate = 'repeat_rate' AND r.repeat_rate > p.high) OR (p.rate = 'word_length' AND (r.word_length > p.high OR r.word_length < p.low)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM rates
""",
}
