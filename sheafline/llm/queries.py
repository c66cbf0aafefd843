"""The registered queries of the ten operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, host_rules, line_dedup, mixing, quality, sharding, simhash, spotsigs, token_counts, url_filter
from .common import stored, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # settled in between, so that an executor has the workers of one of both at a time
    coded = stored(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), "bpe-ids")
    return bpe.decode(coded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.plan_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.classify(docs.select("doc_id", "text", "source", "lang", "n_chars"), labels)
    return scored.select("doc_id", "quality_scores.*")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_ok"
    )


def op6_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_matches(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, shingle=3, radius=3).select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id", "n_links"
    )


#: Fixed rules of the query.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, [url_filter.parse_rule(*r) for r in URL_RULES]).select("page_id", "host", "path", "rule", "verdict", "probability")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), token_counts.new_cache(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_byte_bpe, op2_kk_sharding, op3_quality_cotraining, op4_spotsigs, op5_host_rules,
        op6_line_join, op7_simhash_mih, op8_url_trees, op9_token_counts, op10_entropy_mix,
    )}


#: SQL of op5: counts from the text, host rates with a beta prior by the method of moments.
_OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 4, 0), 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS gram,
  unnest(range(0, greatest(len(w) - 4, 0), 1)) AS i FROM w),
again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(coalesce(nx - i, 5), 5)) AS n FROM again GROUP BY 1),
m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(lines) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 100 * n_symbols > 30 * n_words AS f3, 100 * n_dup_lines > 50 * n_lines AS f4 FROM m),
h AS (SELECT source, count(*) AS n, count_if(f1) AS k1, count_if(f2) AS k2, count_if(f3) AS k3, count_if(f4) AS k4 FROM f GROUP BY 1),
t AS (SELECT source, n, unnest([k1, k2, k3, k4]) AS k, unnest([1, 2, 3, 4]) AS rule FROM h),
p AS (SELECT rule, least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1.0 / n) AS inv FROM t GROUP BY 1),
b AS (SELECT rule, m, CASE WHEN v - m * (1 - m) * inv > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM p),
o AS (SELECT source, max((k + m * weight) / (n + weight)) <= 0.5 AS host_ok FROM t JOIN b USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND host_ok AS kept, host_ok
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source"""


def oracle_sql() -> dict[str, str]:
    return {"op5_host_rules": _OP5}
