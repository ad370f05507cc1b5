"""Scans and sinks of record linkage: TSV records and truth, id lists, normalised Parquet, registry, scores, archives."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S1. All columns strings, quotes literal, nothing read as null, header and values trimmed; files are split, not read whole."""
    header = spark.read.text(path).limit(1).head()
    names = [n.strip() for n in header[0].split("\t")] if header else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, sep="\t", quote="", escape="", header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE")
    return rows.select(*(F.coalesce(F.trim(F.col(n)), F.lit("")).alias(n) for n in names))


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """S2. The three sources of a split, with src 1 to 3; missing columns and repeated ids are errors."""
    out = None
    for src in (1, 2, 3):
        rows = read_tsv(spark, f"{folder}/{split}/{split}_source{src}.tsv")
        if missing := set(FIELDS) - set(rows.columns):
            raise ValueError(f"source {src} lacks {sorted(missing)}")
        rows = rows.select(*FIELDS).withColumn("src", F.lit(src))
        out = rows if out is None else out.unionByName(rows)
    if twice := repeated_ids(out).head():
        raise ValueError(f"repeated id {twice[0]}")
    return out


def repeated_ids(records: DataFrame) -> DataFrame:
    """S2. Ids of several records."""
    return records.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")


def load_truth(spark: SparkSession, path: str, ones: DataFrame) -> DataFrame:
    """S9. (s1, matched array) of every query: comma lists split, trimmed, without blanks and repeats; none where absent."""
    rows = read_tsv(spark, path)
    ids = F.array_distinct(F.filter(F.transform(F.split("matched_entity_ids", ","), lambda x: F.trim(x)), lambda x: x != ""))
    given = rows.select(F.col("source1_entity_id").alias("s1"), ids.alias("matched"))
    return ones.select("s1").join(given, "s1", "left").select("s1", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1, cand) of (s1, matched)."""
    return truth.select("s1", F.explode("matched").alias("cand"))


def id_lists(lists: DataFrame, ones: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """S10. One row per query, its ids without repeats, in order, comma-joined; empty without any."""
    return ones.select("s1").join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(F.array_join(F.array_distinct("cands"), ","), F.lit("")).alias(column))


def write_tsv(rows: DataFrame, path: str, order: str | None = None, one_file: bool = False) -> None:
    """S10. A folder of TSV files; `order` sorts them, in themselves and by name. `one_file` makes them one, in a single task."""
    rows = rows.orderBy(order) if order else rows
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_normalised(records: DataFrame, path: str) -> None:
    """S4. Parquet by source and country; Spark's _SUCCESS marks a finished write."""
    records.write.mode("overwrite").partitionBy("src", "bc").parquet(path)


def load_normalised(spark: SparkSession, path: str, srcs: list[int] | None = None, columns: list[str] | None = None, bc: str | None = None) -> DataFrame:
    """S5. Normalised records; sources and country prune partitions, columns prune the scan."""
    rows = spark.read.parquet(path)
    rows = rows if srcs is None else rows.where(F.col("src").isin(srcs))
    rows = rows if bc is None else rows.where(F.col("bc") == bc)
    return rows if columns is None else rows.select(*columns)


def load_raw(records: DataFrame, ids: DataFrame) -> DataFrame:
    """S6, S7. The records with given ids (entity_id)."""
    return records.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def count_rows(spark: SparkSession, path: str) -> int:
    """S8. From Parquet footers alone."""
    return spark.read.parquet(path).count()


def append_registry(spark: SparkSession, path: str, row: dict) -> DataFrame:
    """S12. Append a row of strings to a Parquet registry whose columns are those of all rows."""
    new = spark.createDataFrame([tuple(str(v) for v in row.values())], T.StructType([T.StructField(k, T.StringType()) for k in row]))
    new.coalesce(1).write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def write_artefacts(frames: dict[str, DataFrame], folder: str, facts: dict | None = None) -> None:
    """S11. Each result of a run as Parquet under its name, and facts (configuration, metrics, importance, provenance) as a line of JSON each."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    if facts:
        spark = next(iter(frames.values())).sparkSession
        lines = [(json.dumps({"name": k, "value": v}, sort_keys=True, default=str),) for k, v in facts.items()]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")


def make_zip(paths: list[str], target: str) -> None:
    """S15. Local files and folders as one archive."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for p in map(Path, paths):
            for f in sorted(x for x in (p.rglob("*") if p.is_dir() else [p]) if x.is_file()):
                archive.write(f, f.relative_to(p.parent))
