"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the docs of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import bpe, line_dedup, mixing, quality, shingle_join
from sheafline.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter("quality_scores.kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of which a similar one stands before them; n_chars follows. No document goes."""
    return line_dedup.without_matches(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (Jaccard of five-word shingles at least 0.8).

    All documents that the stage before left without text are one group.
    Documents without an id can't be told apart and stay.
    """
    found = shingle_join.near_texts(docs, threshold=0.8, shingle=5)
    others = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs, mixing.plan_mix(docs)).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, with the digest of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(stored(bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), "bpe-ids"), ranks)
    return coded.select(
        "doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_texts),
]

#: No SQL states the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
