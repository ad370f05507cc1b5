"""Connected components of an edge table, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each endpoint of an edge can reach.

    Loops and repeated edges are allowed, rows with a null end are ignored, and no edges give no rows.
    Every round is two pre-aggregated minima and two equi-joins, so that a hub's edges are never
    gathered in one task; each round is written to the shared folder, so that a lost executor costs one round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and u is not null and v is not null").distinct()
    e = cut(e)
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now[0] == 0 or now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    tops = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)


def forest(a, b):
    """A spanning forest of the edges (a[i], b[i]) held in memory: each node with its root, the smallest id."""
    import numpy as np

    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        rx, ry = root[x], root[y]
        high, low = np.maximum(rx, ry), np.minimum(rx, ry)
        open_ = high != low
        if not open_.any():
            break
        x, y, high, low = x[open_], y[open_], high[open_], low[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    other = root != np.arange(len(ids))
    return ids[other], ids[root[other]]
