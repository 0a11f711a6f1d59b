"""Token counts with a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, n_tokens).
Documents' digests are joined to it; only the distinct texts it lacks are
encoded, and their counts are appended before the final join.

Defined results: a null text counts as empty (0 tokens). Copies share one
cache row, and repeated document rows give repeated result rows; a null doc_id
stays null. An empty table gives no rows and adds none to the cache. A text of
any length is encoded whole. Only doc_id and text are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.llm.bytebpe import SLICE, file_digest, worker_encoder
from orbisframe.llm.textvec import Texts, slices

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def count_batches(path: str):
    """A mapInArrow function: (digest, text) to (digest, n_tokens)."""
    piece = path.endswith(".model")

    def pieces(texts: list[str]) -> list[int]:
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, limit=SLICE):
            text = part.column(1)
            if piece:
                n = np.array(pieces([x or "" for x in text.to_pylist()]), np.int64)
            else:
                n = np.diff(worker_encoder(path).encode(t, text, with_ids=False)[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return work


def _exists(df_reader, path: str) -> bool:
    spark = df_reader.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document; the cache grows by
    the distinct texts it did not hold for this tokenizer file.

    A text goes over the network once at most, to the task that encodes it;
    the side of representatives is (digest, doc_id) only, built as the hash
    side so that texts need no sort."""
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if _exists(docs, cache_path) else spark.createDataFrame([], CACHE_SCHEMA)
    known = cached.where(F.col("version") == version).select("digest")
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(known, "digest", "left_anti")
    texts = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("own"), text.alias("text"))
    todo = texts.join(missing.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("digest"))).select("digest", "text")
    counts = todo.mapInArrow(count_batches(tokenizer_path), "digest binary, n_tokens long")
    counts = counts.select("digest", F.lit(version).alias("version"), "n_tokens")
    counts.write.mode("append").parquet(cache_path)
    now = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    now = now.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # a repeated append does no harm
    return keyed.join(now, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cache_folder(root: str, name: str) -> str:
    return os.path.join(root, "token-counts", name)
