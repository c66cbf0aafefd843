"""Token counts through a cache of digests (operator 9).

Texts are looked up by the SHA-256 of their normalised content together with a
digest of the tokenizer (its file and how it is called).  Only contents that
the cache lacks are encoded, each once; their counts are appended to it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import TwoGenerations, pieces
from .common import exists, new_path, small_batches, stored

#: How counts are taken; part of the tokenizer's digest, to be raised with any change of meaning.
RULES = "plain counts, no added specials, no truncation, no padding; 1"
#: Entries of the memo of pieces in each Python worker.
MEMO = 200_000
#: Characters that are encoded together.
BLOCK_CHARS = 2_000_000

_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def _normalised(text: Column) -> Column:
    """What is digested and encoded: the text itself, as any change could change its count; null is empty."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(content: bytes, kind: str) -> str:
    return hashlib.sha256(hashlib.sha256(content).digest() + f"{kind}; {RULES}".encode()).hexdigest()


def make_counter(content: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to counts, as the tokenizer's own library gives them.

    A .json whose only pre-tokenizer is the byte-level split and which has no
    normaliser counts each distinct piece of the texts once (see chunks).
    """
    if kind == ".model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if kind != ".json":
        raise ValueError(f"tokenizer files end in .json or .model, not {kind}")
    import json

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(content.decode("utf-8"))
    tok.no_truncation()
    tok.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    made = json.loads(content)
    pre = made.get("pre_tokenizer") or {}
    by_piece = (
        made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens", []))
    )
    if not by_piece:
        return whole
    memo = TwoGenerations(MEMO)

    def counted(texts: list[str]) -> list[int]:
        out: list[int] = []
        block: list[list[str]] = []
        n = 0
        for k, text in enumerate(texts):
            block.append(pieces(text))
            n += len(text)
            if n >= BLOCK_CHARS or k == len(texts) - 1:
                new = memo.missing([p for x in block for p in x])
                memo.put(new, whole(new))
                get = memo.new.__getitem__
                out += [sum(map(get, x)) for x in block]
                memo.turn()
                block, n = [], 0
        return out

    return counted


def _encode(content: Any, kind: str, version: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _counters:
            _counters.clear()
            _counters[version] = make_counter(content.value, kind)
        count = _counters[version]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(count(b.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text") -> DataFrame:
    """docs with `n_tokens` (long) for every whole text.

    The cache is a Parquet folder (version, digest, n_tokens), partitioned by
    version, made if absent; a later call reads the counts of an earlier one,
    and digests that stand in it more than once count once.
    Nulls count as the empty text, 0 tokens.  Repeated texts are encoded once,
    wherever they are; empty tables and other columns pass through.  Columns of
    docs named n_tokens are replaced.

    Texts are first aggregated by digest within each task, so that a text that
    a third of all rows hold crosses the network once a task.  The look-up
    joins narrow digests, whose hot ones adaptive execution splits.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    kind = os.path.splitext(tokenizer_path)[1]
    version = tokenizer_version(content, kind)
    clear = docs.drop("n_tokens")
    keyed = clear.withColumn("__digest", F.sha2(_normalised(F.col(text)), 256))
    cached = f"{cache_path}/version={version}"

    contents = keyed.select(F.col("__digest").alias("digest"), _normalised(F.col(text)).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    again = exists(spark, cached)
    if again:
        contents = contents.join(spark.read.schema("digest string, n_tokens long").parquet(cached), "digest", "left_anti")
    sent = spark.sparkContext.broadcast(content)  # a vocabulary file: its size doesn't depend on the data
    contents.mapInArrow(_encode(sent, kind, version), "digest string, n_tokens long").write.mode("append").parquet(cached)

    counts = spark.read.schema("digest string, n_tokens long").parquet(cached).withColumnRenamed("digest", "__digest")
    if again:  # two runs at once may both have appended a digest
        counts = stored(counts.dropDuplicates(["__digest"]), "token-counts")
    return keyed.join(counts, "__digest").drop("__digest")


def new_cache(spark: SparkSession) -> str:
    return new_path(spark, "token-cache")
