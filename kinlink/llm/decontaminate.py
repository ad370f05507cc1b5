"""Benchmark decontamination: one Aho-Corasick automaton over normalised item windows, each text scanned once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import LOWER, arrow, joined_words, pieces, prepare, text_bytes, word_spans

#: Bytes of benchmark text whose windows one automaton holds; a larger benchmark is several.
AUTOMATON_BYTES = 2 << 20

#: Bytes of texts that a task passes through one automaton after the other, if there are several.
CHUNK_BYTES = 16 << 20

#: Bytes of words: digits, a-z (after lower-casing) and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_table(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes of buf) and text numbers of the words, A-Z counting as a-z."""
    return word_spans(LOWER[buf], offsets, WORD)


def windows(words: list[str], size: int) -> list[str]:
    """All runs of `size` words, or the one shorter run; as ` w1 w2 ... ` with outer blanks."""
    return [f" {' '.join(words[i : i + size])} " for i in range(max(1, len(words) - size + 1))] if words else []


def normal_words(text: str | None) -> list[str]:
    """The words of one text, as Latin-1 views of their UTF-8 bytes."""
    buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = word_table(buf, np.array([0, len(buf)]))
    low = LOWER[buf].tobytes().decode("latin-1")
    return [low[s:e] for s, e in zip(starts, ends)]


def build(items: list[tuple[object, str | None]], size: int) -> tuple[ahocorasick.Automaton | None, list[list]]:
    """The automaton over all windows (values: window numbers) and the items of each window."""
    owners: dict[str, list] = defaultdict(list)
    for item, text in items:
        for w in dict.fromkeys(windows(normal_words(text), size)):
            owners[w].append(item)
    if not owners:
        return None, []
    automaton = ahocorasick.Automaton()
    for k, w in enumerate(owners):
        automaton.add_word(w, (k, w.count(" ") - 1))
    automaton.make_automaton()
    return automaton, list(owners.values())


class Texts:
    """The words of a piece of texts, what was found in them, and how it is told."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.offsets = offsets
        self.starts, self.ends, doc = word_table(buf, offsets)
        self.flat, self.at, _, _ = joined_words(LOWER[buf], offsets, WORD)
        self.words = np.bincount(doc, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.words) - self.words
        self.ranges: list[list] = [[] for _ in self.words]
        self.items: list[set] = [set() for _ in self.words]

    def search(self, automaton: ahocorasick.Automaton | None, owners: list[list]) -> None:
        """Add the word ranges of the automaton's windows, and their items."""
        if automaton is None:
            return
        for d in np.flatnonzero(self.words):
            lo, hi = self.first[d], self.first[d] + self.words[d]
            stop = self.at[hi] if hi < len(self.at) else len(self.flat)
            for end, (k, size) in automaton.iter(" " + self.flat[self.at[lo] : stop].tobytes().decode("latin-1")):
                last = int(np.searchsorted(self.at[lo:hi], self.at[lo] + end, side="left"))  # words that start before the window's closing blank
                self.ranges[d].append((last - size, last))
                self.items[d].update(owners[k])

    def told(self) -> Iterator[tuple[int, np.ndarray, set, np.ndarray]]:
        """For each text: number of words, hit word ranges as an (n, 2) array, items, and byte spans in the text."""
        for d, words in enumerate(self.words):
            hit, lo = merged(self.ranges[d]), self.first[d]
            spans = np.stack([self.starts[lo + hit[:, 0]], self.ends[lo + hit[:, 1] - 1]], axis=1) - self.offsets[d] if len(hit) else hit
            yield int(words), hit, self.items[d], spans


def merged(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Disjoint [start, stop) ranges covering the same numbers, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())), ("spans", T.ArrayType(T.ArrayType(T.LongType())))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, keep_text: bool = False, names: tuple[str, ...] = tuple(n for n, _ in FIELDS)) -> DataFrame:
    """docs (with text) plus n_words, n_hit, items (ids as sorted strings) and spans ([start, stop) bytes of hit runs in the text),
    under these or other `names`.

    A word is hit inside any occurrence of a window: `size` consecutive words of one benchmark (item_id, text) row, or all the
    words of a shorter item. Null or wordless texts have no words; null or wordless items have no windows; items with equal
    windows all count; a null item_id is the item `null`; columns with the names are replaced; an empty benchmark hits
    nothing and an empty table gives no rows.

    Nothing is shuffled. Texts are scanned once, by one automaton of the whole benchmark, while that has at most AUTOMATON_BYTES
    of text; the windows of a larger one are as many automata as that takes, built one after the other, through which a task passes
    CHUNK_BYTES of its texts at a time. Results are the same.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop(*names)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null").collect()
    slices: list[list] = [[]]
    held = 0
    for r in items:
        size_ = len(r[1].encode())
        if held + size_ > AUTOMATON_BYTES and slices[-1]:
            slices.append([])
            held = 0
        slices[-1].append((r[0], r[1]))
        held += size_
    shipped = spark.sparkContext.broadcast(slices)
    columns, at = docs.columns, docs.columns.index("text")
    keep = [i for i, c in enumerate(columns) if keep_text or i != at]
    schema = T.StructType([*(docs.schema[i] for i in keep), *(T.StructField(n, t) for n, (_, t) in zip(names, FIELDS))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [build(x, size) for x in shipped.value] if len(shipped.value) == 1 else None
        for chunk in chunks(batches, 0 if made else CHUNK_BYTES):
            parts = []
            for b in chunk:
                buf, offsets = text_bytes(b[at])
                parts.append([Texts(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in pieces(offsets)])
            for automaton, owners in made or (build(x, size) for x in shipped.value):
                for texts in (t for part in parts for t in part):
                    texts.search(automaton, owners)
            for b, part in zip(chunk, parts):
                found = [x for texts in part for x in texts.told()]
                own = [
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([int((x[1][:, 1] - x[1][:, 0]).sum()) for x in found], pa.int64()),
                    pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                    pa.array([x[3].tolist() for x in found], pa.list_(pa.list_(pa.int64()))),
                ]
                yield pa.record_batch([*(b[i] for i in keep), *own], schema.names)

    return arrow(docs, find, schema)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of at least `size` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield held
            held = []
    if held:
        yield held
