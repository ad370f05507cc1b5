"""Cosines of weighted-token documents, tile by tile: a block of one side's documents against a block of the other's.

A join of postings on their tokens has a row for each token that two documents share, thousands for a query; a tile sums them where
they arise. What is shuffled is each document once for every block of the other side.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents in a block of queries, of the pool, and of the second end of given pairs, whose first end has blocks of queries.
QUERY_DOCS, POOL_DOCS, END_DOCS = 1 << 14, 1 << 16, 1 << 15

#: Rows of a batch that a tile hands on.
OUT_ROWS = 100_000


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves up; x is not negative."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def blocks(docs: DataFrame, per: int, *keys: str) -> DataFrame:
    """(keys, blocks): how many blocks of about `per` documents each; counted approximately, which only says how work is dealt out."""
    return docs.groupBy(*keys).agg(F.ceil(F.approx_count_distinct("id") / per).cast("int").alias("blocks"))


def vectors(weights: DataFrame, token, *keys: str) -> DataFrame:
    """(keys, id, toks, ws): a row for each document, its tokens as 64-bit hashes."""
    own = weights.groupBy(*keys, "id").agg(F.collect_list(F.struct(token.alias("t"), "w")).alias("v"))
    return own.select(*keys, "id", F.col("v.t").alias("toks"), F.col("v.w").alias("ws"))


def flat(docs: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets, tokens and weights of documents in the order of their ids."""
    docs = docs.take(pc.sort_indices(docs["id"])).combine_chunks()
    ids, toks, ws = (docs[c].combine_chunks() for c in ("id", "toks", "ws"))
    ids, toks, ws = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, toks, ws))
    sizes = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
    return ids, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), toks.flatten().to_numpy(), ws.flatten().to_numpy()


def coded(toks: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of tokens in the sorted vocabulary, and whether they are in it."""
    at = np.minimum(np.searchsorted(vocabulary, toks), max(len(vocabulary) - 1, 0))
    return at, vocabulary[at] == toks if len(vocabulary) else np.zeros(len(toks), bool)


def best(asked: pa.Table, pool: pa.Table, k: int, min_sim: float) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(query ids, pool ids, cosines) of each query's k best in the pool of at least min_sim, ties by id; documents without a common token are no pair."""
    q_ids, q_at, q_toks, q_ws = flat(asked)
    p_ids, p_at, p_toks, p_ws = flat(pool)
    order = np.argsort(p_toks, kind="stable")
    vocabulary, heads = np.unique(p_toks[order], return_index=True)
    heads = np.append(heads, len(order))
    holder = np.repeat(np.arange(len(p_ids)), np.diff(p_at))[order]
    weight = p_ws[order]
    codes, known = coded(q_toks, vocabulary)
    least = max(min_sim - 1e-6, 0.0)
    left, right, sims, held = [], [], [], 0

    def out():
        rows = np.repeat(np.array([i for i, _ in left]), np.array([n for _, n in left]))
        return q_ids.take(pa.array(rows)), p_ids.take(pa.array(np.concatenate(right))), np.concatenate(sims)

    for i in range(len(q_ids)):
        own = slice(q_at[i], q_at[i + 1])
        mine = codes[own][known[own]]
        if not len(mine):
            continue
        spans = [slice(heads[c], heads[c + 1]) for c in mine]
        w = np.repeat(q_ws[own][known[own]], heads[mine + 1] - heads[mine]) * np.concatenate([weight[s] for s in spans])
        total = np.bincount(np.concatenate([holder[s] for s in spans]), w, len(p_ids))
        hits = np.flatnonzero(total > least)
        sim = rounded(total[hits])
        if len(hits) > k:
            keep = sim >= np.partition(sim, len(sim) - k)[len(sim) - k]
            hits, sim = hits[keep], sim[keep]
        place = np.argsort(-sim, kind="stable")[:k]
        place = place[sim[place] >= min_sim]
        if len(place):
            left.append((i, len(place)))
            right.append(hits[place])
            sims.append(sim[place])
            held += len(place)
        if held >= OUT_ROWS:
            yield out()
            left, right, sims, held = [], [], [], 0
    if held:
        yield out()


def cosines(pairs: pa.Table, left: pa.Table, right: pa.Table, views: int) -> np.ndarray:
    """(pairs, views) cosines of the pairs (x, y) of documents; a token's lowest two bits say its view, and documents that are not there give 0."""
    out = np.zeros((len(pairs), views))
    if not len(left) or not len(right):
        return out
    a_ids, a_at, a_toks, a_ws = flat(left)
    b_ids, b_at, b_toks, b_ws = flat(right)
    vocabulary, a_code = np.unique(a_toks, return_inverse=True)
    b_code, known = coded(b_toks, vocabulary)
    b_at = np.concatenate(([0], np.cumsum(known)))[b_at]
    b_code, b_ws, view = b_code[known], b_ws[known], (b_toks[known] & 3)
    place = lambda c, ids: pc.fill_null(pc.index_in(pairs[c], ids), -1).combine_chunks().to_numpy()
    x, y = place("x", a_ids), place("y", b_ids)
    order = np.argsort(x, kind="stable")
    order = order[(x[order] >= 0) & (y[order] >= 0)]
    x, y = x[order], y[order]
    edges = np.flatnonzero(np.diff(x, prepend=-1, append=len(a_ids)))
    dense = np.zeros(len(vocabulary))
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = slice(a_at[x[lo]], a_at[x[lo] + 1])
        np.add.at(dense, a_code[own], a_ws[own])
        others = y[lo:hi]
        sizes = b_at[others + 1] - b_at[others]
        who = np.repeat(np.arange(hi - lo), sizes)
        at = np.arange(len(who)) + (b_at[others] - (np.cumsum(sizes) - sizes))[who]
        sums = np.bincount(who * views + view[at], dense[b_code[at]] * b_ws[at], (hi - lo) * views)
        out[order[lo:hi]] = rounded(sums.reshape(-1, views))
        dense[a_code[own]] = 0.0
    return out


def sorted_out(batches: Iterator[pa.RecordBatch], *columns: tuple[str, ...]) -> list[pa.Table]:
    """The rows of each kind, with the columns that this kind needs."""
    held = [[] for _ in columns]
    types: list = [None] * len(columns)
    for b in batches:
        for kind, names in enumerate(columns):
            own = b.select(names)
            types[kind] = own.schema
            if len(own := own.filter(pc.equal(b["kind"], kind))):
                held[kind].append(own)
    return [pa.Table.from_batches(h, t) for h, t in zip(held, types)]


def numbered(grid: DataFrame, *keys: str) -> DataFrame:
    """The table of block numbers, a row for each of `keys`, with a number for these."""
    return F.broadcast(grid.withColumn("part", F.row_number().over(Window.orderBy(*keys))))


def tile(p, q):
    """One number for a tile: Spark sorts rows by a single number without comparing them."""
    return F.shiftleft(F.coalesce(F.col("part"), F.lit(0)).cast("long"), 40).bitwiseOR(F.shiftleft(p.cast("long"), 20)).bitwiseOR(q.cast("long")).alias("tile")


def tiled(rows: DataFrame, work: Callable, schema: T.StructType | str) -> DataFrame:
    """work() for the rows of each tile; as many tasks as the session's shuffle partitions, small or not, as work is not told by bytes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:  # what the tile has freed goes back to the system
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return rows.repartition(parts, "tile").groupBy("tile").applyInArrow(run, schema)


def whole(blocks: str):
    """One row for every block."""
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def own(blocks: str, key: str = "id"):
    """The block of a key."""
    return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")


DOCUMENT = ("id", "toks", "ws")


def top_k(queries: DataFrame, pool: DataFrame, k: int, min_sim: float) -> DataFrame:
    """(view, bc, s1, cand, sim): for each query document the k best of every block of the pool."""
    keys, names = ["view", "bc"], ["view", "bc", "s1", "cand", "sim"]
    grid = blocks(queries, QUERY_DOCS, *keys).withColumnRenamed("blocks", "qb").join(F.broadcast(blocks(pool, POOL_DOCS, *keys).withColumnRenamed("blocks", "pb")), keys)
    sides = [(queries, own("qb"), whole("pb")), (pool, whole("qb"), own("pb"))]
    a, b = (vectors(side, F.xxhash64("tok"), *keys).join(numbered(grid, *keys), keys).select("*", F.lit(kind).alias("kind"), q.alias("q"), p.alias("p")) for kind, (side, q, p) in enumerate(sides))
    rows = a.unionByName(b).select(*keys, *DOCUMENT, "kind", tile(F.col("q"), F.col("p")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches)
        view, bc = head["view"][0], head["bc"][0]
        for x, y, sim in best(*sorted_out(chain([head], batches), DOCUMENT, DOCUMENT), k, min_sim):
            yield pa.record_batch([pa.repeat(view, len(sim)), pa.repeat(bc, len(sim)), x, y, pa.array(sim)], names)

    return tiled(rows, work, "view string, bc string, s1 string, cand string, sim double")


def pair_cosines(pairs: DataFrame, first: DataFrame, second: DataFrame, views: tuple[str, ...]) -> DataFrame:
    """pairs (bc, x, y and others) with sim_<view>, the cosine of document x of `first` and y of `second`."""
    sized = [blocks(w, per, "bc").withColumnRenamed("blocks", n) for w, per, n in ((first, QUERY_DOCS, "xb"), (second, END_DOCS, "yb"))]
    grid = numbered(sized[0].join(F.broadcast(sized[1]), "bc"), "bc")
    number = F.array_position(F.array(*map(F.lit, views)), F.col("view")) - 1
    token = F.xxhash64("view", "tok").bitwiseAND(F.lit(~3)).bitwiseOR(number)
    docs = lambda w: vectors(w.where(F.col("view").isin(*views)), token, "bc").join(grid, "bc")
    left, right = (docs(w).select("bc", *DOCUMENT, "part", F.lit(kind).alias("kind"), p.alias("p"), q.alias("q")) for w, kind, p, q in ((first, 1, own("xb"), whole("yb")), (second, 2, whole("xb"), own("yb"))))
    place = lambda c, n: F.coalesce(own(n, c), F.lit(0))
    none = {"toks": F.array().cast("array<long>"), "ws": F.array().cast("array<double>")}  # not null: Arrow's writer goes over all nulls in a row for each
    asked = pairs.join(grid, "bc", "left").withColumns(none).select(*pairs.columns, "toks", "ws", "part", F.lit(0).alias("kind"), place("x", "xb").alias("p"), place("y", "yb").alias("q"))
    rows = asked.unionByName(left, True).unionByName(right, True).select(*pairs.columns, *DOCUMENT, "kind", tile(F.col("p"), F.col("q")))
    columns = tuple(pairs.columns)
    names = [*columns, *(f"sim_{v}" for v in views)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, a, b = sorted_out(batches, columns, DOCUMENT, DOCUMENT)
        found, lo = cosines(given, a, b, len(views)), 0
        for part in given.to_batches(OUT_ROWS):
            sims = found[lo : lo + len(part)]
            lo += len(part)
            yield pa.record_batch([*part.columns, *map(pa.array, np.ascontiguousarray(sims.T))], names)

    return tiled(rows, work, T.StructType([*(T.StructField(f.name, f.dataType) for f in pairs.schema), *(T.StructField(n, T.DoubleType()) for n in names[len(columns) :])]))
