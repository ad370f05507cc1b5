"""The ten operators as queries over the tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import chat, classify, decontaminate, embed, mixing, ppm, simhash, substring, tokens
from kinlink.llm.common import prepare, remainder, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, (source_size * 2)::DOUBLE / weight AS ratio,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(source_size * 2) OVER (ORDER BY (source_size * 2)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY (source_size * 2)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sources),
targets AS (
  SELECT source, source_size, round(least((source_size * 2)::DOUBLE,
         coalesce((SELECT arg_min(level, ratio) FROM leveled WHERE level <= ratio), 'inf'::DOUBLE) * weight), 6) AS target FROM leveled),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END::BIGINT AS repeats,
         floor(target + 0.5)::BIGINT AS want FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.repeats, p.want - p.repeats * p.source_size
           - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (repeats * size + greatest(0, least(remaining, size)))::BIGINT AS taken FROM placed
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


@query
def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m.start, m.stop)), ",")
    return turned.withColumn("masks", spans)


ORACLES["op9_perspectives"] = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(trim(role), '') AS who, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM turns WHERE who <> 'system'),
pieces AS (
  SELECT t.conv_id, p.perspective, t.turn, t.who, t.text, t.who = p.perspective AS own,
         '<|im_start|>' || CASE WHEN t.who = p.perspective THEN 'assistant' WHEN t.who = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(replace(replace(t.who, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') END || chr(10) AS head,
         regexp_replace(t.text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' AS body
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM pieces)
SELECT conv_id, perspective, count(*)::INT AS n_turns, count(*) FILTER (own)::INT AS n_target_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, who, text) AS rendered,
       coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR, ',' ORDER BY pos) FILTER (own), '') AS masks
FROM placed GROUP BY conv_id, perspective
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    model = classify.fit(docs, docs.where(~held).select("doc_id", F.col("lang").alias("label")), classify.LANGUAGE, per_class=1000)
    found = classify.predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("toxic").alias("label"))
    model = classify.fit(docs, labels, classify.TOXICITY, per_class=2000, overall=8000)
    return classify.predict_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    joined = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op5_decontamination"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
spots AS (
  SELECT r, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM wins) s0 WHERE len(w) >= n) s),
hits AS (SELECT r, i, n, item_id FROM spots JOIN wins USING (n, win)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


@query
def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) != 0)


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
