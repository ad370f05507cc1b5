"""What the corpus operators share: cut lineages, Arrow buffers as numpy bytes, word spans, salts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python; texts longer than this form a batch of their own.
BATCH_BYTES = 4 << 20

#: Texts are worked on in pieces of about this many bytes, so that a batch or a long text needs no more memory than this times a constant.
PIECE = 1 << 20

#: ASCII white space of the word definition `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORD_REGEX = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes and make sure that a checkpoint folder is set.

    The cluster names a shared folder in spark.checkpoint.dir; only where that is unset (local
    tests) a temporary folder is used.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also set as the checkpoint folder.

    Without spark.checkpoint.dir a temporary folder serves where driver and executors are one process; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kinlink-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    A lost executor then costs no more than the stage after; checkpoint() would do the same but computes a frame
    without shuffles twice. release() deletes what has been written, once results are no longer needed.
    """
    path = f"{shared_dir(df.sparkSession)}/kinlink-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables cut() has written and release() not deleted: a mark for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables that cut() has written since the mark, but those that `keep` reads; results that
    still read them must have been stored before."""
    needed = " ".join(keep.inputFiles()) if keep is not None else ""
    stay = [p for p in _written[since:] if p.rsplit("/", 1)[1] in needed]
    for path in _written[since:]:
        if path not in stay:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written[since:] = stay


def arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose Python worker gives freed memory back to the system when a task ends: workers are used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return df.mapInArrow(run, schema)


def free_name(name: str, df: DataFrame) -> str:
    """name, or name with underscores that no column of df has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced; otherwise they stay until the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of an Arrow string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def pieces(offsets: np.ndarray, size: int = PIECE) -> list[tuple[int, int]]:
    """Ranges of texts of about `size` bytes; a longer text is a range of its own."""
    n, out, lo = len(offsets) - 1, [], 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1))
        out.append((lo, hi))
        lo = hi
    return out


def word_spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document indices of the maximal runs of bytes with inside[byte], cut at documents."""
    held = inside[buf]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    border = offsets[(offsets > 0) & (offsets < len(buf))]
    first[border], last[border - 1] = held[border], held[border - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets[1:], starts, side="right")


def joined_words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """The words of the texts, each followed by a blank: the bytes, the words' starts in them and lengths, and the words' texts."""
    n = len(offsets) - 1
    padded = np.full(len(buf) + n, 32, np.uint8)
    at = offsets + np.arange(n + 1)
    for d in np.flatnonzero(np.diff(offsets)):
        padded[at[d] : at[d + 1] - 1] = buf[offsets[d] : offsets[d + 1]]
    held = inside[padded]
    keep = held.copy()
    keep[1:] |= held[:-1]
    first = held.copy()
    first[1:] &= ~held[:-1]
    doc = np.searchsorted(at[1:], np.flatnonzero(first), side="right")
    flat, word = padded[keep], held[keep]
    flat[~word] = 32
    ends = np.flatnonzero(~word)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return flat, starts, ends - starts, doc


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, gap: int = 0, fill: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate buf[start:start+length] slices, each followed by `gap` fill bytes; also the new starts."""
    step = lengths + gap
    at = np.concatenate(([0], np.cumsum(step)))
    out = np.full(at[-1], fill, np.uint8)
    total = int(lengths.sum())
    if total:
        own = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        lane = np.arange(total) - np.repeat(own, lengths)
        out[np.repeat(at[:-1], lengths) + lane] = buf[np.repeat(starts, lengths) + lane]
    return out, at[:-1]


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo; the column form of `fold`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fold(doc_id, modulus: int) -> int:
    """crc32 of the id as text, modulo."""
    return zlib.crc32(str(doc_id).encode()) % modulus


def parts_for(df: DataFrame, rows: int, per: int) -> int:
    """How many partitions hold `rows` rows at `per` rows each, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
