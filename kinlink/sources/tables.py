"""Materialised intermediate results: Parquet in a folder that all machines share.

Several operators read normalised records, postings and candidates. Written once, they are scanned with pruned columns
and their plans stay small; a cached frame would carry its whole plan into every query and be lost with its executor.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where that is unset and one process does all, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if (made := _local.get(spark.sparkContext.applicationId)) is None:
        made = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="kinlink-tables-")
    return made


_local: dict[str, str] = {}


_written: list[str] = []


def materialise(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written and read again; release() deletes it."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    _written.append(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what was written; else they stay until the driver's next full collection."""
    gc.collect()
    with contextlib.suppress(Py4JJavaError):  # a busy bus is not waited for beyond ten seconds
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # its events hold the plan that ran
    spark._jvm.System.gc()


def materialise_in_turn(spark: SparkSession, makes: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """What each of `makes` gives, written one after the other as one table; the tables and shuffle files that one needed go before the next."""
    path, count, schema = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", 0, None
    _written.append(path)
    for make in makes:
        mark = len(_written)
        df = make()
        schema = schema or df.schema
        df.write.parquet(f"{path}/{count}")
        count += 1
        del df
        for spent in _written[mark:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(spent)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _written[mark:]
        free_shuffles(spark)
    out = spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(count)))
    out._written_in_turn = True
    return out


def is_table(df: DataFrame) -> bool:
    """Whether df reads a table that materialise_in_turn() has written, and nothing else happens to it."""
    return getattr(df, "_written_in_turn", False)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df under a path of its own, for later runs: read if it was written to the end before, else written now."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete the tables that materialise() has written but those that `keep` reads; results that read them must have been stored."""
    needed = " ".join(f for df in keep for f in df.inputFiles())  # those of a table written in turn lie in folders of it
    for path in [p for p in _written if p.rsplit("/", 1)[1] not in needed]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)
