"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Two vectors collide on a projection if one lies in the window centred at the other. Unit vectors that are alike collide on most
projections, others on few, so pairs that collide often enough are verified and the others are not. So that not every pair need be
counted, vectors are dealt to cells first: a group of leading projections, each cut in ranges of a random offset, says who meets whom,
and there are so many groups that a pair at the threshold shares a cell of one of them almost surely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import arrow, cut, parts_for, prepare, release_shuffles
from kinlink.llm.components import components, forest

#: Rows of a cell that are counted at once; a fuller cell is cut into blocks, and each pair of blocks is a task's piece of work.
BLOCK = 2048

#: Projections that are counted; each share of pairs at the threshold that has to pass the count, and to meet in a cell.
PROJECTIONS = 32
RECALL = 0.999

#: Vectors that one meets by chance in a group's cell, and the width of the ranges in spreads of the difference of a pair at the
#: threshold: wide ranges keep such pairs together, many projections keep others apart.
CHANCE = 64
WIDTH = 4

#: Slots of the pairs of one cell or of several small ones, counted at once.
SLOTS = 4 << 20

#: Groups dealt out at once, which bounds the disk: each takes about the size of the vectors. Rows of one task.
GROUPS_AT_ONCE = 4
TASK_ROWS = 50_000


@lru_cache
def directions(dim: int, count: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    """Random unit directions, dim x count."""
    a = np.random.default_rng([seed, dim]).normal(size=(dim, count))
    return a / np.linalg.norm(a, axis=0)


def apart(dim: int, threshold: float, n: int = 4096) -> np.ndarray:
    """Differences of pairs of unit vectors right at the threshold: length sqrt(2 - 2t), any direction."""
    d = np.random.default_rng([9, dim]).normal(size=(n, dim))
    return d * (np.sqrt(max(2 - 2 * threshold, 1e-12)) / np.linalg.norm(d, axis=1, keepdims=True))


@lru_cache
def calibrated(dim: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """The half-width of the window in quantisation steps, and the collisions that a pair must reach.

    On a random direction a pair at the threshold differs by about sqrt((2 - 2t) / dim), which is the half-width. Differences of such pairs
    are projected on the very directions used, and the count is the largest that the share `recall` of them reaches.
    """
    width = np.sqrt(max(2 - 2 * threshold, 1e-12) / dim)
    hits = (np.abs(apart(dim, threshold) @ directions(dim)) <= width).sum(axis=1)
    step = 8 / np.sqrt(dim) / 256
    return int(np.floor(width / step)) + 1, max(1, int(np.quantile(hits, 1 - recall, method="lower")))


@lru_cache
def grouping(dim: int, threshold: float, rows: int, recall: float = RECALL) -> tuple[int, int, float]:
    """(projections of a group, groups, range width): groups get longer with the logarithm of the rows, so that CHANCE vectors
    meet by chance, and there are so many that pairs at the threshold share a cell of one with probability `recall`."""
    width = WIDTH * np.sqrt(max(2 - 2 * threshold, 1e-12) / dim)
    x = np.random.default_rng([11, dim]).normal(size=(4096, 2, dim))
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    one = directions(dim, 1, 13)[:, 0]
    together = lambda d: np.maximum(1 - np.abs(d) / width, 0).mean()  # noqa: E731  over random offsets
    random, alike = together((x[:, 0] - x[:, 1]) @ one), together(apart(dim, threshold) @ one)
    length = int(np.clip(np.ceil(np.log(max(rows, 1) / CHANCE) / -np.log(max(random, 1e-9))), 1, 32))
    share = alike**length
    return length, max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(share, 1 - 1e-9))))), width


def cells(v: np.ndarray, length: int, groups: int, width: float) -> np.ndarray:
    """(rows, groups) uint32: the cell of each unit vector in each group, as a hash of its ranges."""
    dim = v.shape[1]
    offsets = np.random.default_rng([17, dim]).uniform(0, width, length * groups)
    at = np.floor((v @ directions(dim, length * groups, 19) + offsets) / width).astype(np.int64).view(np.uint64)
    out = np.zeros((len(v), groups), np.uint64)
    for k in range(length):
        out = (out ^ at[:, k::length][:, :groups]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


def quantised(v: np.ndarray) -> np.ndarray:
    """Projections of unit vectors in 256 steps over +-4 standard widths; the rest is clipped, which brings no pair apart."""
    dim = v.shape[1]
    return np.clip(np.floor((v @ directions(dim)) * (np.sqrt(dim) * 32)) + 128, 0, 255).astype(np.uint8)


def collisions(a: np.ndarray, b: np.ndarray, half: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that lie in each other's window on at least `least` projections.

    b is sorted by each projection in turn; the window of a row of a is a range of the sorted list, whose rows it collides with.
    """
    count = np.zeros(len(a) * len(b), np.uint8)
    for k in range(b.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        values, centre = b[order, k].astype(np.int16), a[:, k].astype(np.int16)
        first = np.searchsorted(values, centre - np.int16(half))
        size = np.searchsorted(values, centre + np.int16(half), side="right") - first
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
        count[np.repeat(np.arange(len(a)) * len(b), size) + order[place]] += 1  # a row is once in a window
    hit = np.flatnonzero(count >= least)
    return hit // len(b), hit % len(b)


def collisions_in(q: np.ndarray, sizes: np.ndarray, half: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows of one cell that lie in each other's window on at least `least` projections; rows stand cell by cell.

    One sort by cell and projection serves all cells; the window of a row is the part of the sorted list after it, up to half a window
    on, within its cell.
    """
    begin = np.cumsum(sizes) - sizes
    base = np.cumsum(sizes * sizes) - sizes * sizes
    cell = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(len(q)) - begin[cell]
    count = np.zeros(int((sizes * sizes).sum()), np.uint8)
    after = np.arange(1, len(q) + 1)
    for k in range(q.shape[1]):
        key = (cell << 10) | q[:, k]  # cells lie further apart than any window reaches
        order = np.argsort(key, kind="stable")
        key = key[order]
        size = np.searchsorted(key, key + half, side="right") - after
        x, y = np.repeat(order, size), order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - after, size)]
        low, high = local[np.minimum(x, y)], local[np.maximum(x, y)]
        count[base[cell[x]] + low * sizes[cell[x]] + high] += 1  # a row is once in a window
    hit = np.flatnonzero(count >= least)
    at = np.searchsorted(base, hit, side="right") - 1
    rest = hit - base[at]
    return begin[at] + rest // sizes[at], begin[at] + rest % sizes[at]


def linked(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which candidate pairs have at least the cosine asked for, in double precision."""
    out = np.empty(len(i), bool)
    for lo in range(0, len(i), 65536):
        s = slice(lo, lo + 65536)
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]]) >= threshold
    return out


def unit(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id long, embedding array of numbers).

    Rows whose cosine reaches the threshold are linked; n_links counts other rows linked directly, component_id is the
    smallest vec_id reachable, and a row is kept if that is its own. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null vec_id, link with nothing; vectors of different lengths neither.
    Other columns are ignored; an empty table gives no rows.

    Equal vectors (but for a power of two) are one class with a size, known by a digest, so copies in any number cost one row. A class goes to
    a cell of every group; pairs in a cell count collisions in sorted projections, and those that reach the calibrated count are verified.
    A pair counts in the first group that it shares a cell of. Tasks hand on link counts per class and spanning forests, never pairs.
    """
    spark = prepare(vectors.sparkSession)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    wide = int(kind[2])

    total = vectors.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed, digest, spots = [], [], [None] * len(b)
            for v, known in zip(b[1].to_pylist(), b[0].is_valid().to_pylist()):
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v and known else np.zeros(1)
                good = np.isfinite(x).all() and x.any()
                # Scaled by a power of two, which is exact, large and small components stay finite when squared.
                raw = np.ldexp(x, -np.frexp(np.abs(x).max())[1]).astype(kind).tobytes() if good else None
                packed.append(raw)
                digest.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            lengths = np.array([len(x) // wide if x else 0 for x in packed])
            for dim in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dim)
                for i, at in zip(own, cells(unit([packed[i] for i in own], dim, kind), *grouping(dim, threshold, total))):
                    spots[i] = at.astype(">u4").tobytes()
            yield pa.record_batch([b[0].cast(pa.int64()), pa.array(packed, pa.binary()), pa.array(digest, pa.binary()), pa.array(spots, pa.binary())], ["vec_id", "raw", "digest", "cells"])

    rows = cut(arrow(vectors.select("vec_id", "embedding"), pack, "vec_id long, raw binary, digest binary, cells binary"))
    good = rows.where("digest is not null")
    classes = cut(good.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw"), F.first("cells").alias("cells")))
    dims = [r[0] // wide for r in classes.select(F.length("raw")).distinct().limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("vectors of more than 1000 different lengths")
    most = max([grouping(d, threshold, total)[1] for d in dims], default=0)

    def dealt(first: int) -> DataFrame:
        last = F.least(F.lit(first + GROUPS_AT_ONCE), F.expr("cast(length(cells) / 4 as int)")) - 1
        every = classes.where(F.length("cells") > 4 * first).withColumn("group", F.explode(F.sequence(F.lit(first), last)))
        every = every.withColumns({"cell": F.conv(F.hex(F.expr("substring(cells, group * 4 + 1, 4)")), 16, 10).cast("long"), "dim": (F.length("raw") / wide).cast("int")})
        return every.select("cell", "group", "dim", "rep", "n", "raw", "cells")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        cell, group, dim, other, block, rep, n = (table[c].to_numpy() for c in ("cell", "group", "dim", "other", "block", "rep", "n"))
        order = np.lexsort((other, group, cell, dim))
        change = np.any([np.diff(x[order]) != 0 for x in (cell, group, dim, other)], axis=0)
        heads = np.flatnonzero(np.concatenate(([True], change)))
        sizes = np.diff(np.append(heads, len(order)))
        heads, sizes = heads[sizes > 1], sizes[sizes > 1]
        first, second = other[order[heads]] >> 32, other[order[heads]] & 0xFFFFFFFF
        work = [(slice(k, k + 1), True) for k in np.flatnonzero(first != second)]
        own = np.flatnonzero(first == second)
        dims_ = dim[order[heads[own]]]
        for d in np.unique(dims_):
            some = own[dims_ == d]
            turn = (np.cumsum(sizes[some].astype(np.int64) ** 2) - 1) // SLOTS
            work += [(some[turn == t], False) for t in np.unique(turn)]
        for these, apart_ in work:
            where = np.concatenate([order[h : h + k] for h, k in zip(heads[these], sizes[these])])
            width = int(dim[where[0]])
            half, least = calibrated(width, threshold)
            v = unit(table["raw"].take(pa.array(where)).to_pylist(), width, kind)
            q = quantised(v)
            if apart_:
                a, b = (np.flatnonzero(block[where] == x[these][0]) for x in (first, second))
                i, j = collisions(q[a], q[b], half, least)
                i, j = a[i], b[j]
            else:
                i, j = collisions_in(q, sizes[these], half, least)
            good_ = linked(v, v, i, j, threshold)
            i, j = i[good_], j[good_]
            spots = np.frombuffer(b"".join(table["cells"].take(pa.array(where)).to_pylist()), ">u4").reshape(len(where), -1)
            before = np.arange(spots.shape[1]) < group[where][i][:, None]
            new = ~((spots[i] == spots[j]) & before).any(axis=1)  # a pair counts in the first group that it shares a cell of
            i, j = i[new], j[new]
            if not len(i):
                continue
            ids, weight = rep[where], n[where]
            x, y = forest(ids[i], ids[j])
            links = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
            some = np.flatnonzero(links)
            end = pa.array(np.concatenate([y, np.zeros(len(some), np.int64)]), mask=np.arange(len(y) + len(some)) >= len(y))
            yield pa.record_batch([pa.array(np.concatenate([x, ids[some]])), end, pa.array(np.concatenate([np.zeros(len(x), np.int64), links[some].astype(np.int64)]))], ["a", "b", "n"])

    found = None
    for first in range(0, most, GROUPS_AT_ONCE):
        every = dealt(first)
        full = cut(every.groupBy("cell", "group", "dim").count().where(F.col("count") > BLOCK))
        every = every.withColumns({"other": F.lit(0).cast("long"), "block": F.lit(0).cast("long")})
        if not full.isEmpty():
            # A row of a full cell is in one of its blocks and meets each block; `other` holds both numbers, the smaller one above.
            every = every.join(full, ["cell", "group", "dim"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)))
            every = every.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), "blocks")).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            every = every.withColumn("other", F.shiftleft(F.least("block", "to"), 32).bitwiseOR(F.greatest("block", "to"))).drop("count", "blocks", "to")
        every = every.repartition(parts_for(classes, total * GROUPS_AT_ONCE, TASK_ROWS), "cell", "group", "dim", "other")
        part = cut(arrow(every, compare, "a long, b long, n long"))
        release_shuffles(spark)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    known = classes.select("digest", "rep", "n").join(counts, F.col("rep") == counts.a, "left").join(joined, F.col("rep") == joined.id, "left")
    known = known.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_ = good.select("vec_id", "digest").join(known, "digest").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked_.unionByName(alone)
