"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import WORD_REGEX, cut, prepare

#: Weights given to the sources in code-point order, repeating.
CYCLE = (3, 1, 2)

#: Hash buckets of a source (three hexadecimal digits of the seeded digest).
DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle=CYCLE) -> DataFrame:
    """(source, source_size) with `weight`: `cycle` repeated over the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("long"))


def fill_levels(weighted: DataFrame, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Adds `target`: weight x level, clamped at max_epochs x source_size, the targets summing to share x all sizes.

    Clamping the sources that are above and resharing the excess by weight, until none is above, ends at
    the level at which the clamped and free parts sum to the total; sources sorted by cap over weight
    clamp in that order, so running sums find it. One row per source: a table of sources, not of documents.
    """
    cap = F.col("source_size") * max_epochs
    ratio = cap.cast("double") / F.col("weight")
    by = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()).cast("double") * share - F.coalesce(F.sum(cap).over(before), F.lit(0)).cast("double")) / F.sum("weight").over(after).cast("double")
    leveled = weighted.withColumn("__ratio", ratio).withColumn("__level", level)
    free = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(Window.partitionBy())["__level"]
    target = F.least(cap.cast("double"), F.coalesce(free, F.lit(float("inf"))) * F.col("weight"))
    return leveled.withColumn("target", F.round(target, 6)).drop("__ratio", "__level")


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, seed: int = 17, cycle=CYCLE) -> DataFrame:
    """Every row of docs with size, source_size, target, repeats, extra and taken.

    A source's target rounded to whole words is spent as `repeats` whole passes over all its documents
    and the rest in the order of a seeded digest of doc_id, the last document reached giving only the
    words still wanted (`extra`): taken = repeats x size + extra sums to the target and reruns agree.
    docs needs doc_id, source and text. A null source is a source; null or blank texts have size 0 and
    take nothing; equal doc_ids stand in the order of their sizes; an empty table gives no rows. Columns of
    docs with the names given here are replaced.
    """
    prepare(docs.sparkSession)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    own = ["size", "source_size", "target", "repeats", "extra", "taken"]
    kept = docs.drop(*own)
    # The rows travel as one struct, so that no name of theirs meets a name used here.
    sized = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("__row"), "source", word_count(F.col("text")).alias("size"), key.alias("__key"))
    sized = sized.withColumn("__bucket", F.substring("__key", 1, DIGITS))
    buckets = cut(sized.groupBy("source", "__bucket").agg(F.sum("size").alias("__words")))
    sources = fill_levels(cyclic_weights(buckets.groupBy("source").agg(F.sum("__words").alias("source_size")), cycle), share, max_epochs)
    sources = sources.withColumn("__want", F.floor(F.col("target") + 0.5).cast("long"))
    sources = sources.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("__want") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("__rest", F.col("__want") - F.col("repeats") * F.col("source_size")).drop("weight", "__want")
    ahead = F.sum("__words").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    tag = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))  # noqa: E731  a join key for null too
    plan = buckets.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).withColumn("__tag", tag(F.col("source"))).drop("__words")
    plan = plan.join(sources.withColumn("__tag", tag(F.col("source"))).drop("source"), "__tag").drop("source")
    inside = Window.partitionBy("__tag", "__bucket").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__tag", tag(F.col("source"))).withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = placed.join(plan, ["__tag", "__bucket"])
    left = F.col("__rest") - F.col("__ahead") - F.col("__before")
    full = full.withColumn("extra", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long"))
    full = full.withColumn("taken", F.col("repeats") * F.col("size") + F.col("extra"))
    return full.select("__row.*", *own)


def expand(mixed: DataFrame) -> DataFrame:
    """One row for each repetition of a document that mix() takes: `epoch` from 0, `epoch_words` of it to use."""
    reps = F.col("repeats") + (F.col("extra") > 0).cast("long")
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), reps - 1)))
    return rows.withColumn("epoch_words", F.when(F.col("epoch") < F.col("repeats"), F.col("size")).otherwise(F.col("extra")))
