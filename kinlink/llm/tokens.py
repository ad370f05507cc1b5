"""Token counts through a digest cache: only distinct contents that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import arrow, prepare

#: A vocabulary file larger than this is not sent to the executors.
MODEL_LIMIT = 64 << 20

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def load_model(path: str) -> tuple[bytes, str]:
    """The vocabulary file and its version digest."""
    raw = Path(path).read_bytes()
    if len(raw) > MODEL_LIMIT:
        raise ValueError(f"{path} has {len(raw)} bytes; at most {MODEL_LIMIT} are sent to the executors")
    return raw, hashlib.sha256(raw).hexdigest()


def encoder(raw: bytes, kind: str):
    """texts -> token counts, for a `.model` (sentencepiece) or `.json` (tokenizers) vocabulary."""
    if kind == "model":
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [len(own.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(raw.decode())
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def read_cache(spark: SparkSession, path: str | None, digest: str) -> DataFrame:
    """(content_digest, n_tokens) stored for this tokenizer version; no rows where there is no cache yet."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    if path is None:
        return empty.drop("tokenizer_digest")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    table = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else empty
    return table.where(F.col("tokenizer_digest") == digest).drop("tokenizer_digest").dropDuplicates(["content_digest"])


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text); null is an empty text.

    Contents are normalised only by null -> "", as counts must be those of the exact text, and
    identified by SHA-256; the version is the SHA-256 of the vocabulary file. One row of each distinct
    content missing in the cache is encoded, in Arrow batches, and appended to the cache (Parquet, in a folder
    that all machines share); every row then takes its count from the cache by an equi-join. Copies in
    any number cost one encoding. Other columns of docs are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    raw, version = load_model(model_path)
    kind = Path(model_path).suffix[1:]
    shipped = spark.sparkContext.broadcast(raw)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"))
    first = rows.groupBy("content_digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("__first"))
    misses = first.join(read_cache(spark, cache_path, version), "content_digest", "left_anti")
    wanted = misses.select(F.col("content_digest").alias("__digest"), F.xxhash64("__first.doc_id", "content_digest").alias("__row"))
    # The join key is unique among the misses and different for copies of a text, so no partition gets all of them.
    texts = rows.select(F.xxhash64("doc_id", "content_digest").alias("__row"), "content_digest", "text").join(wanted, "__row", "left_semi").select("content_digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(shipped.value, kind)
        for b in batches:
            yield pa.record_batch([b[0], pa.array(count(b[1].to_pylist()), pa.int64())], ["content_digest", "n_tokens"])

    fresh = arrow(texts, encode, "content_digest binary, n_tokens long").withColumn("tokenizer_digest", F.lit(version))
    fresh.select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache_path)
    stored = read_cache(spark, cache_path, version)
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"))
    return counted.join(stored, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
