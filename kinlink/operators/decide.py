"""From pair probabilities to one set of matches per query: one-to-one resolution, thresholds, expected F, grid search."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.operators.metrics import f_half


def prepare(scored: DataFrame, one_to_one: bool = True) -> DataFrame:
    """D1. scored (s1, cand, cand_src, p) with pa (p, or 0 where another query has more of the candidate; exact ties keep both),
    place, is_top, top_p and is_other_best (the best candidate of the other source than the top one's)."""
    best = F.max("p").over(Window.partitionBy("cand"))
    d = scored.select("s1", "cand", "cand_src", "p").withColumn("pa", F.when(F.lit(one_to_one) & (F.col("p") < best), 0.0).otherwise(F.col("p")))
    order = Window.partitionBy("s1").orderBy(F.desc("pa"), "cand")
    d = d.withColumn("place", F.row_number().over(order))
    d = d.withColumns({"top_p": F.first("pa").over(order), "__src": F.first("cand_src").over(order)})
    other = F.col("cand_src") != F.col("__src")
    first_other = F.min(F.when(other, F.col("place"))).over(Window.partitionBy("s1"))
    return d.withColumns({"is_top": F.col("place") == 1, "is_other_best": F.coalesce(other & (F.col("place") == first_other), F.lit(False))}).drop("__src")


def select(d: DataFrame, t_first: float, t_other: float, t_extra: float) -> DataFrame:
    """D2. The rows of prepare() that three thresholds keep."""
    rule = F.col("is_top") | (F.col("is_other_best") & (F.col("pa") >= t_other)) | (F.col("pa") >= t_extra)
    return d.where((F.col("top_p") >= t_first) & (F.col("pa") > 0) & rule)


def select_expected_f(d: DataFrame, alpha: float = 1.0, miss: float = 0.0, empty_bias: float = 1.0) -> DataFrame:
    """D3. For each query the top-k rows of highest expected F0.5, if above empty_bias times the chance that nothing matches."""
    order = Window.partitionBy("s1").orderBy(F.desc("pa"), "cand")
    group = Window.partitionBy("s1")
    p = F.greatest(F.lit(0.0), F.least(F.col("pa"), F.lit(1.0)))
    value = 1.25 * F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, 0)) / (0.25 * (alpha * F.sum(p).over(group) + miss) + F.col("place"))
    d = d.withColumns({"__value": F.round(value, 12), "__empty": empty_bias * F.exp(F.sum(F.log1p(-F.least(p, F.lit(1 - 1e-9)))).over(group))})
    d = d.withColumn("__best", F.max("__value").over(group))
    d = d.withColumn("__k", F.min(F.when(F.col("__value") == F.col("__best"), F.col("place"))).over(group))
    return d.where((F.col("place") <= F.col("__k")) & (F.col("__best") > F.col("__empty")) & (F.col("pa") > 0)).drop("__value", "__empty", "__best", "__k")


def to_lists(selected: DataFrame, column: str = "cands") -> DataFrame:
    """D4. (s1, array of candidates, best first)."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("pa")).alias("k"), "cand")))
    return selected.groupBy("s1").agg(F.transform(ordered, lambda x: x.cand).alias(column))


def entity_f(selected: DataFrame, truth: DataFrame, ones: DataFrame) -> DataFrame:
    """G1, G2, D5. (s1, n_pred, n_truth, tp, f) of every query, those without candidates or matches included."""
    hits = selected.select("s1", "cand").join(truth.withColumn("hit", F.lit(1)), ["s1", "cand"], "left")
    pred = hits.groupBy("s1").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    true = truth.groupBy("s1").agg(F.count("*").alias("n_truth"))
    full = ones.select("s1").join(pred, "s1", "left").join(true, "s1", "left").fillna(0, ["n_pred", "tp", "n_truth"])
    return full.withColumn("f", f_half(F.col("n_pred"), F.col("n_truth"), F.col("tp")))


def macro_f(entities: DataFrame, target_singleton_rate: float | None = None) -> DataFrame:
    """G2, D5. One row: macro F0.5 over all queries, reweighted to a share of queries without matches if given."""
    if target_singleton_rate is None:
        return entities.agg(F.round(F.avg("f"), 6).alias("macro_f"))
    single = (F.col("n_truth") == 0).cast("double")
    share = entities.agg(F.avg(single).alias("share"))
    weight = F.when(F.col("n_truth") == 0, target_singleton_rate / F.greatest("share", F.lit(1e-9))).otherwise((1 - target_singleton_rate) / F.greatest(1 - F.col("share"), F.lit(1e-9)))
    return entities.crossJoin(F.broadcast(share)).agg(F.round(F.sum(weight * F.col("f")) / F.sum(weight), 6).alias("macro_f"))  # one row broadcast


def steps(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high."""
    return [round(low + i * step, 4) for i in range(int((high - low) / step + 1e-6) + 1)]


def grid_scores(d: DataFrame, truth: DataFrame, ones: DataFrame, first: list[float], other: list[float], extra: list[float]) -> DataFrame:
    """D6. (i, j, k, score): macro F0.5 of every threshold triple.

    A query's F depends on its rows through counts at the thresholds it has, so rows are first reduced to one per query and
    (other, extra) pair, with the top probability; the first threshold only switches the whole row on. The grid is a
    broadcast of fixed size, len(other) * len(extra) rows, never joined with pairs of rows.
    """
    spark = d.sparkSession
    labelled = d.join(truth.withColumn("hit", F.lit(1)), ["s1", "cand"], "left")
    grid = F.broadcast(spark.createDataFrame([(j, k, a, b) for (j, a), (k, b) in itertools.product(enumerate(other), enumerate(extra))], "j int, k int, t_other double, t_extra double"))
    own = labelled.groupBy("s1", "top_p").agg(F.collect_list(F.struct("pa", "is_top", "is_other_best", F.coalesce("hit", F.lit(0)).alias("hit"))).alias("rows"))
    true = truth.groupBy("s1").agg(F.count("*").alias("n_truth"))
    own = ones.select("s1").join(own, "s1", "left").join(true, "s1", "left").fillna(0, ["n_truth"])
    rows = F.filter("rows", lambda r: (r.pa > 0) & (r.is_top | (r.is_other_best & (r.pa >= F.col("t_other"))) | (r.pa >= F.col("t_extra"))))
    at = own.crossJoin(grid).withColumn("__kept", rows)
    at = at.select("j", "k", "top_p", F.coalesce(F.size("__kept"), F.lit(0)).alias("n"), F.coalesce(F.size(F.filter("__kept", lambda r: r.hit == 1)), F.lit(0)).alias("tp"), "n_truth")
    at = at.withColumns({"on": f_half(F.greatest("n", F.lit(0)), F.col("n_truth"), F.col("tp")), "off": f_half(F.lit(0), F.col("n_truth"), F.lit(0))})
    sums = [F.avg(F.when(F.col("top_p") >= t, F.col("on")).otherwise(F.col("off"))).alias(f"f{i}") for i, t in enumerate(first)]
    wide = at.groupBy("j", "k").agg(*sums)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), "j", "k", F.round(F.col(f"f{i}"), 9).alias("score")) for i in range(len(first))))).alias("x")).select("x.*")


def smooth(scores: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """D6. Adds smoothed: the mean of the 3 x 3 x 3 neighbourhood, edges repeated."""
    near = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(o, "abc"))) for o in itertools.product((-1, 0, 1), repeat=3)))
    clamp = lambda x, n: F.greatest(F.lit(0), F.least(x, F.lit(n - 1)))
    wanted = scores.select("i", "j", "k", F.explode(near).alias("d"))
    wanted = wanted.select("i", "j", "k", clamp(F.col("i") + F.col("d.a"), shape[0]).alias("a"), clamp(F.col("j") + F.col("d.b"), shape[1]).alias("b"), clamp(F.col("k") + F.col("d.c"), shape[2]).alias("c"))
    values = scores.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("k").alias("c"), "score")
    mean = wanted.join(values, ["a", "b", "c"]).groupBy("i", "j", "k").agg(F.round(F.avg("score"), 9).alias("smoothed"))
    return scores.join(mean, ["i", "j", "k"])


def grid_search(d: DataFrame, truth: DataFrame, ones: DataFrame, first: list[float], other: list[float], extra: list[float]) -> DataFrame:
    """D6. (t_first, t_other, t_extra, score, smoothed, chosen, raw_best) of every triple; ties go to the smallest thresholds."""
    curve = smooth(grid_scores(d, truth, ones, first, other, extra), (len(first), len(other), len(extra)))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), F.col(at) + 1)
    curve = curve.withColumns({"t_first": pick(first, "i"), "t_other": pick(other, "j"), "t_extra": pick(extra, "k")})
    best = curve.agg(F.max(F.struct("smoothed", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), (-F.col("k")).alias("k"))).alias("s"), F.max(F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), (-F.col("k")).alias("k"))).alias("r"))
    at = lambda x: (F.col("i") == -F.col(f"{x}.i")) & (F.col("j") == -F.col(f"{x}.j")) & (F.col("k") == -F.col(f"{x}.k"))
    out = curve.crossJoin(F.broadcast(best))  # one row
    return out.select("t_first", "t_other", "t_extra", "score", "smoothed", at("s").alias("chosen"), at("r").alias("raw_best"))
