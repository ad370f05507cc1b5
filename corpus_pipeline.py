"""Corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever their names: what a stage needs itself has names that docs
lacks. Every stage works on all rows of its docs; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import classify, decontaminate, mixing, simhash, substring
from kinlink.llm.common import cut, free_name, prepare, release, written


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    return tuple(free_name(n, docs) for n in names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: no letters, or less sure than the calibrated level.

    The model learns from the rows with a lang (of a doc_id's several the largest); without any, only texts without letters go. Null
    texts go; rows with a null doc_id are judged like others; repeated rows stay as often as they stand.
    """
    names = _free(docs, "lang_pred", "score", "rejected")
    model = classify.fit(docs, docs.select("doc_id", F.col("lang").alias("label")), classify.LANGUAGE, per_class=1000)
    return classify.predict_language(docs, model, keep_text=True, names=names).where(~F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles of similarity 0.8 or more connect, the row of the smallest doc_id stays.

    Rows with a null doc_id come last in their group but stay if it has no other; rows with one doc_id and different texts are different
    documents; of equal rows one stays; texts without words are copies of each other.
    """
    return simhash.keep_one(docs, size=5, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the bytes that repeat an earlier document's; documents of which nothing is left go.

    n_chars, if there is such a column, is that of the new text where it was cut. Rows with a null doc_id neither lose nor take;
    null and empty texts stay; rows with one doc_id neither lose to each other nor are told apart: each loses the spans of all.
    """
    names = _free(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    n_bytes, n_removed, kept = names[0], names[1], names[4]
    done = substring.remove_repeats(docs, keep_text=True, names=names)
    was_cut = F.col(n_removed) > 0
    done = done.where(~was_cut | (F.col(n_removed) < F.col(n_bytes))).withColumn("text", F.when(was_cut, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(was_cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null texts and null ids hold none and stay."""
    names = _free(docs, "n_words", "n_hit", "items", "spans")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items, keep_text=True, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: one row for each repetition taken of a document: docs' columns and mixing's own, with epoch and epoch_words.

    Documents without words and those not reached take no place; a null source is a source; repeated rows are taken each.
    """
    return mixing.expand(mixing.mix(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("mixture", mixture)]

#: The first three stages are a trained model, bit votes over hashes and suffixes: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has written itself goes when its result is stored."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            release(spark, mark, keep=docs)
    return docs
