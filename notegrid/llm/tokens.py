"""Operator 3: token counts with a digest cache."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.arrow import blocks
from notegrid.llm.common import new_path, stage

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
_LOADED: dict[str, object] = {}


def version_of(path: str) -> str:
    """Digest of a tokenizer file: counts of another version never match."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def counter(path: str):
    """A function from texts to token counts, loaded once in each worker. A .json
    file is for tokenizers, a .model file for sentencepiece."""
    if path not in _LOADED:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
            _LOADED[path] = lambda texts: [len(e.ids) for e in encode(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no tokenizer library for {path}")
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str, *, cache: str | None = None, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    The normalised content is the text itself, null as the empty string: any
    other change could change a count. Its SHA-256 and the tokenizer file's
    digest are looked up in ``cache``, a folder of Parquet parts (default: a
    new one, empty); each distinct miss is encoded once, whole, and appended.
    Two runs that append the same digest store the same count, and the lookup
    takes one row of each digest.

    Copies collapse in the map tasks before the shuffle, so a text that fills a
    third of the table moves once a task. Empty texts count 0; repeated rows
    keep a row each; other columns are not carried; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer)
    cache = cache or new_path(spark, "token-cache")
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(body.cast("binary"), 256))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)

    texts = docs.select(digest.alias("digest"), body.alias("body")).groupBy("digest").agg(F.first("body").alias("body"))
    missing = texts.join(known.select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for block in blocks(batches, "body"):
            found = count(block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([version] * len(found)), pa.array(found, pa.int64())], names=["digest", "version", "n_tokens"])

    missing.select("digest", "body").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)

    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    # written, so that the join below is one of two plain tables and Spark can split a hot digest
    counts = stage(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    thin = stage(docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), digest.alias("digest")), "token-digests")
    return thin.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
