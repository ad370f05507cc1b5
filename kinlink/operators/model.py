"""Trained scoring: grouped folds, gradient-boosted trees, out-of-fold stacking, weights, percentile ranks and transfer tests."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from statistics import median

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.sources.tables import materialise

#: Columns that are not features.
KEYS = {"bc", "s1", "cand", "y", "p", "p1", "w", "fold"}

#: Prefixes of features whose scale depends on a country's size.
SCALE_PREFIXES = ("chain_", "sim_", "prune_score", "n_max_idf", "n_idf_overlap", "rev_n_s1", "ctx_n_", "ctx_gap_sim", "ctx_gap_prune", "rev_gap_prune", "rev_gap_sim", "hop_best")


@dataclass
class Settings:
    """Trees (at most, with early stopping), depth, step and the missing-value sentinel of a fit; seeds give one model each, averaged.

    A cross-validated fit stops when a tree lowers the held-out loss by less than `tolerance`; a fit on all rows takes the median
    number of trees at which those stopped, times full_iter_mult.
    """

    trees: int = 20
    depth: int = 5
    rate: float = 0.1
    folds: int = 3
    seeds: tuple[int, ...] = (42,)
    missing: float = -1.0
    tolerance: float = 0.001
    full_iter_mult: float = 1.1
    drop: tuple[str, ...] = field(default_factory=tuple)


def feature_columns(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    """What a model may learn from: the schema's numbers that are neither keys nor dropped."""
    left_out = KEYS.union(drop)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in left_out]


def fold_of(s1: Column, folds: int, seed: int) -> Column:
    """D7. The fold of a query: all pairs of a query fall into one."""
    return F.pmod(F.xxhash64(s1, F.lit(seed)), F.lit(folds)).cast("int")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds y: 1 for true pairs, else 0."""
    true = truth.select("s1", "cand").distinct().withColumn("y", F.lit(1.0))
    return pairs.join(true, ["s1", "cand"], "left").fillna(0.0, ["y"])


def entity_weights(pairs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """D9. Adds w from (s1, w); 1 for queries without one."""
    if weights is None:
        return pairs.withColumn("w", F.lit(1.0))
    return pairs.join(weights.select("s1", "w"), "s1", "left").fillna(1.0, ["w"])


def fit(rows: DataFrame, columns: list[str], s: Settings, seed: int, trees: int | None = None, held: Column | None = None) -> PipelineModel:
    """One boosted model over labelled rows (columns, y, w); a missing value is the sentinel, with a flag column of its own.

    The rows of `held` teach nothing but when to stop.
    """
    gaps = [f"{c}__gap" for c in columns]
    boosted = GBTClassifier(featuresCol="features", labelCol="y", weightCol="w", maxIter=trees or s.trees, maxDepth=s.depth, stepSize=s.rate, seed=seed, maxBins=64)
    if held is not None:
        rows = rows.withColumn("__held", held)
        boosted = boosted.setValidationIndicatorCol("__held").setParams(validationTol=s.tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=[*columns, *gaps], outputCol="features"), boosted]).fit(filled(rows, columns, s.missing))


def filled(rows: DataFrame, columns: list[str], missing: float) -> DataFrame:
    gaps = {f"{c}__gap": F.col(c).isNull().cast("double") for c in columns}
    return rows.withColumns(gaps).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns})


def predict(models: list[PipelineModel], rows: DataFrame, columns: list[str], s: Settings, name: str = "p") -> DataFrame:
    """D8. (bc, s1, cand, name): the mean probability of the models."""
    out = filled(rows, columns, s.missing)
    for i, m in enumerate(models):
        out = m.transform(out).withColumn(f"__p{i}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    mean = sum((F.col(f"__p{i}") for i in range(1, len(models))), F.col("__p0")) / len(models)
    return out.select(*[c for c in ("bc", "s1", "cand", "cand_src") if c in rows.columns], F.round(mean, 9).alias(name))


def cross_validated(rows: DataFrame, columns: list[str], s: Settings, name: str = "p") -> tuple[DataFrame, list[int]]:
    """D7. Scores of every labelled row, the mean over seeds of the model that has not learnt from its query, and the models' trees.

    Every seed has folds of its own; a fold is scored by the models that hold it out, and says when these stop. Folds x seeds
    fits, bounded by the settings.
    """
    parts, trees = [], []
    for seed in s.seeds:
        for fold in range(s.folds):
            held = fold_of(F.col("s1"), s.folds, seed) == fold
            model = fit(rows, columns, s, seed, held=held)
            trees.append(model.stages[-1].getNumTrees)
            parts.append(predict([model], rows.where(held), columns, s, name))
    keys = [c for c in parts[0].columns if c != name]
    scored = reduce(DataFrame.unionByName, parts)
    return (scored if len(s.seeds) == 1 else scored.groupBy(*keys).agg(F.round(F.avg(name), 9).alias(name))), trees


def out_of_fold(rows: DataFrame, columns: list[str], s: Settings, name: str = "p") -> DataFrame:
    """D7. The scores of cross_validated alone."""
    return cross_validated(rows, columns, s, name)[0]


def full_trees(trees: list[int], s: Settings) -> int:
    """D8. How many trees a model of all rows gets: it has more rows than the cross-validated ones, and so some more trees."""
    return max(1, round(median(trees) * s.full_iter_mult))


def fit_full(rows: DataFrame, columns: list[str], s: Settings, trees: int | None = None) -> list[PipelineModel]:
    """D8. One model per seed on all rows."""
    return [fit(rows, columns, s, seed, trees) for seed in s.seeds]


def importance(models: list[PipelineModel], columns: list[str]) -> list[tuple[str, float]]:
    """Mean importance of each feature, its gap flag included, largest first."""
    total = dict.fromkeys(columns, 0.0)
    for m in models:
        for c, v in zip([*columns, *columns], m.stages[-1].featureImportances.toArray()):
            total[c] += float(v) / len(models)
    return sorted(total.items(), key=lambda x: -x[1])


def percentile_ranks(df: DataFrame, column: str, group: str) -> DataFrame:
    """(group, column, rank) of the distinct non-null values: average rank of ties over the group's number of values (not percent_rank).

    Values are counted before they are moved, dealt out in ranges, and summed up within ranges and over them: no group is one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("__n"))
    ranged = materialise(counts.repartitionByRange(group, column).withColumn("__part", F.spark_partition_id()))
    of = Window.partitionBy(group)
    parts = ranged.groupBy(group, "__part").agg(F.sum("__n").alias("__sum"))
    parts = parts.select(group, "__part", (F.sum("__sum").over(of.orderBy("__part")) - F.col("__sum")).alias("__ahead"), F.sum("__sum").over(of).alias("__all"))
    placed = ranged.withColumn("__up", F.sum("__n").over(Window.partitionBy(group, "__part").orderBy(column)))
    x, y = placed.alias("x"), F.broadcast(parts).alias("y")  # a row for each range and group at most
    both = x.join(y, F.col(f"x.{group}").eqNullSafe(F.col(f"y.{group}")) & (F.col("x.__part") == F.col("y.__part")))
    return both.select(f"x.{group}", f"x.{column}", ((F.col("__ahead") + F.col("__up") - (F.col("__n") - 1) / 2) / F.col("__all")).alias("rank"))


def rank_normalise(df: DataFrame, columns: list[str], group: str = "bc") -> DataFrame:
    """D10. The columns as percentile ranks within the group; null for null."""
    for c in columns:
        if c in df.columns:
            ranks = percentile_ranks(df, c, group).withColumnsRenamed({group: "__group", c: "__value"})
            joined = df.join(ranks, F.col(group).eqNullSafe(F.col("__group")) & (F.col(c) == F.col("__value")), "left")
            df = joined.withColumn(c, F.round("rank", 9)).select(*df.columns)
    return df


#: D10. Which columns a rank test turns into ranks.
RANK_MODES = {"none": lambda c: False, "scale": lambda c: c.startswith(SCALE_PREFIXES), "all": lambda c: True}


def rank_columns(columns: list[str], mode: str) -> list[str]:
    """D10. Those of the columns that a mode of RANK_MODES picks."""
    return list(filter(RANK_MODES[mode], columns))


def rank_test(rows: DataFrame, columns: list[str], s: Settings, modes: tuple[str, ...] = ("none", "scale", "all"), high: float = 0.98, low: float = 0.02) -> dict[str, DataFrame]:
    """D13. leave_one_out() scores with the columns as they are, and with those of each mode as percentile ranks of their country."""
    return {m: leave_one_out(materialise(rank_normalise(rows, rank_columns(columns, m))), columns, s, high, low) for m in modes}


def sample_queries(ones: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """D12. n queries in the order of a seeded hash: reruns agree."""
    return ones.orderBy(F.xxhash64("s1", F.lit(seed)), "s1").limit(n)


def sample_regions(ones: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """D11. Whole regions of each country (ones: s1, bc, region), up to its share of n, so that sampled queries keep their rivals.

    Regions of at most half the target are taken in hash order while the target is not reached. If they do not reach half of it, the first
    larger one is taken too, and if the target is still not reached, the first that ends at most half a target above it. All of it is sums
    over the table of region sizes. Queries without a region are sampled by hash.
    """
    share = n / max(ones.count(), 1)
    of = Window.partitionBy("bc")
    order = of.orderBy(F.xxhash64("region", F.lit(seed)), "region")
    size, target = F.col("n"), F.col("target")
    r = ones.where("region <> ''").groupBy("bc", "region").agg(F.count("*").alias("n")).withColumn("target", share * F.sum("n").over(of))
    r = r.withColumn("small", size <= F.greatest(target / 2, F.lit(1.0)))
    ahead = F.coalesce(F.sum(F.when(F.col("small"), size)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = lambda flag: F.coalesce(F.sum(F.when(flag, size)).over(of), F.lit(0))
    nth = lambda flag: F.sum(flag.cast("int")).over(order)
    r = r.withColumn("a", F.col("small") & (ahead < target)).withColumn("have", taken(F.col("a")))
    r = r.withColumn("b", ~F.col("small") & (F.col("have") <= target / 2) & (nth(~F.col("small")) == 1)).withColumn("have", F.col("have") + taken(F.col("b")))
    r = r.withColumn("fits", ~F.col("small") & ~F.col("b") & (F.col("have") < target) & (F.col("have") + size <= 1.5 * target))
    r = r.withColumn("c", F.col("fits") & (nth(F.col("fits")) == 1)).where(F.col("a") | F.col("b") | F.col("c"))
    own = ones.join(r.select("bc", "region"), ["bc", "region"], "left_semi")
    rest = ones.where("region = ''").where(F.pmod(F.xxhash64("s1", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)
    return own.select("s1", "bc", "region").unionByName(rest.select("s1", "bc", "region"))


def leave_one_out(rows: DataFrame, columns: list[str], s: Settings, high: float = 0.98, low: float = 0.02) -> DataFrame:
    """D13. (bc, s1, cand, cand_src, p, p_self): each country scored by models of the others, without and with self-training on
    its own sure pairs (p >= high as true, p <= low as false). Two fits a country: countries are few, as they are a blocking key."""
    out = None
    for (bc,) in rows.select("bc").distinct().orderBy("bc").collect():
        others, own = rows.where(F.col("bc") != bc), rows.where(F.col("bc") == bc)
        first = predict(fit_full(others, columns, s), own, columns, s)
        sure = own.drop("y").join(first.select("s1", "cand", "p"), ["s1", "cand"]).where((F.col("p") >= high) | (F.col("p") <= low)).withColumn("y", (F.col("p") >= high).cast("double"))
        again = predict(fit_full(others.unionByName(sure.drop("p")), columns, s), own, columns, s, "p_self")
        part = first.join(again.select("s1", "cand", "p_self"), ["s1", "cand"])
        out = part if out is None else out.unionByName(part)
    return out


def ablation(rows: DataFrame, groups: dict[str, list[str]], s: Settings) -> list[tuple[str, DataFrame]]:
    """D13. Out-of-fold scores without each group of features, by prefix."""
    every = feature_columns(rows, s.drop)
    return [(name, out_of_fold(rows, [c for c in every if not c.startswith(tuple(prefixes))], s)) for name, prefixes in groups.items()]


def save(model: PipelineModel, path: str) -> None:
    """S16."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """S16."""
    return PipelineModel.load(path)
