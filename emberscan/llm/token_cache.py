"""Token counts through a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscan.llm.batches import chunks
from emberscan.llm.store import prepare
from emberscan.llm.tokens import TEXT_CHUNK, encoder, version_digest

CACHE_SCHEMA = T.StructType([
    T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table is written where there is none yet."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _normalised(text: F.Column) -> F.Column:
    """What is counted: NULL is the empty text, nothing else is folded, since any change could change the count."""
    return F.coalesce(text.cast("string"), F.lit(""))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """`doc_id, n_bytes, n_tokens` of every whole text, encoding only contents the cache does not hold.

    The cache is Parquet under `cache`: SHA-256 of the content, digest of the tokenizer's version, count. Misses are
    made distinct before they are shuffled, encoded once each and appended in one committed write, so a lost executor
    or a failed run leaves the cache right. One writer at a time may use a cache folder.

    Defined results: NULL text counts as empty (0 tokens); repeated rows give repeated results; NULL `doc_id` is kept;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    version = version_digest(tokenizer)
    text = _normalised(F.col("text"))
    digest = F.unhex(F.sha2(text, 256))
    known = open_cache(spark, cache).where(F.col("tokenizer") == version)

    # first() over one digest is always the same text; combining before the shuffle leaves one row a task and content.
    contents = docs.select(digest.alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = contents.join(known.select("content"), "content", "left_anti")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", TEXT_CHUNK):
                counts, _ = encoder(tokenizer).encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(counts.astype(np.int64))], ["content", "n_tokens"])

    misses.mapInArrow(encoded, "content binary, n_tokens long").select(
        "content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)

    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("content", "n_tokens")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content"))
    return rows.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")
