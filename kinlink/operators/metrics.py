"""Ranked and set-valued evaluation: F0.5, breakdowns, blocking, calibration, errors, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.operators.retrieve import VIEWS, large, pair_cosine

def f_half(n_pred: Column, n_truth: Column, tp: Column) -> Column:
    """G1. F0.5 from counts: 1 if nothing is true and nothing predicted, 0 without a hit."""
    precision, recall = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(n_truth, F.lit(1))
    return F.when((n_pred == 0) & (n_truth == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def breakdown(entities: DataFrame) -> DataFrame:
    """G3. Per bc (and all of them, bc null): macro F, singleton accuracy, F by number of true matches, pair precision and recall."""
    mean = lambda rule, value=F.col("f"): F.round(F.avg(F.when(rule, value)), 6)
    n = F.col("n_truth")
    return entities.rollup("bc").agg(
        F.count("*").alias("n"),
        F.round(F.avg("f"), 6).alias("macro_f"),
        F.round(F.avg((n == 0).cast("double")), 6).alias("singleton_rate"),
        F.sum("n_pred").alias("n_pred_matches"),
        F.count_if(F.col("n_pred") == 0).alias("n_pred_singletons"),
        mean(n == 0).alias("singleton_acc"),
        mean(n > 0).alias("matched_f"),
        mean(n == 1).alias("f_one"),
        mean(n > 1).alias("f_multi"),
        F.round(F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1)), 6).alias("pair_precision"),
        F.round(F.sum("tp") / F.greatest(F.sum("n_truth"), F.lit(1)), 6).alias("pair_recall"),
    )


def paired_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """G4. Mean and standard error of a.f - b.f over common queries."""
    d = a.select("s1", F.col("f").alias("fa")).join(b.select("s1", F.col("f").alias("fb")), "s1").withColumn("d", F.col("fa") - F.col("fb"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("delta"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 6).alias("se"))


def blocking(cands: DataFrame, truth: DataFrame, ones: DataFrame, pool_size: int) -> DataFrame:
    """G5. One row: pair recall, entity ceiling (F of an oracle on the candidates), candidates per query, reduction ratio."""
    hit = cands.select("s1", "cand").join(large(truth.withColumn("hit", F.lit(1))), ["s1", "cand"], "left").groupBy("s1").agg(F.count("*").alias("n"), F.count("hit").alias("tp"))
    true = truth.groupBy("s1").agg(F.count("*").alias("n_truth"))
    e = ones.select("s1").join(large(hit), "s1", "left").join(large(true), "s1", "left").fillna(0, ["n", "tp", "n_truth"])
    return e.agg(
        F.round(F.sum("tp") / F.greatest(F.sum("n_truth"), F.lit(1)), 6).alias("pair_recall"),
        F.round(F.avg(f_half(F.col("tp"), F.col("n_truth"), F.col("tp"))), 6).alias("ceiling"),
        F.round(F.avg("n"), 6).alias("cand_mean"),
        F.round(F.percentile("n", F.lit(0.5)), 6).alias("cand_median"),
        F.round(F.percentile("n", F.lit(0.95)), 6).alias("cand_p95"),
        F.max("n").alias("cand_max"),
        F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("zero_share"),
        F.round(1 - F.sum("n") / (F.count("*").cast("double") * pool_size), 6).alias("reduction"),
    )


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """G6. (bin, n, mean_p, rate, gap) of scored (p, y) in equal bins; a bin holds its lower edge, the last one also 1."""
    edges = [i / bins for i in range(1, bins)]
    at = sum(((F.col("p") >= e).cast("int") for e in edges), F.lit(0))
    out = scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"))
    return out.withColumn("gap", F.round(F.abs(F.col("mean_p") - F.col("rate")), 6))


def expected_calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability(scored, bins)
    return r.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


def unique_positives(found: DataFrame, truth: DataFrame) -> DataFrame:
    """G7. (view, n): true pairs that only this view returned, over top-k results (view, s1, cand)."""
    hits = found.select("view", "s1", "cand").join(large(truth.select("s1", "cand")), ["s1", "cand"], "left_semi")
    return hits.groupBy("s1", "cand").agg(F.count("*").alias("views"), F.min("view").alias("view")).where("views = 1").groupBy("view").agg(F.count("*").alias("n"))


# Names of the outcomes of a query.
BUCKETS = ("ok_singleton", "E1_singleton_merged", "E6_all_true_blocked", "E3_abstained_top_correct", "E3b_abstained_top_wrong", "E2_wrong_match", "E4_extra_wrong", "E6b_partly_blocked", "E5_missed_extra", "ok")


def error_buckets(prepared: DataFrame, selected: DataFrame, truth: DataFrame, ones: DataFrame) -> DataFrame:
    """G8. (s1, bucket, f, n_truth, n_pred, n_cands, top_cand, top_p, truth, pred): the outcome of every query, named by what went
    wrong first; truth and pred are its true and selected candidates, comma-joined in order of id.

    One aggregation over the candidates with flags for true and selected; queries without candidates are kept.
    """
    t, p = truth.select("s1", "cand").withColumn("true", F.lit(1)), selected.select("s1", "cand").withColumn("pred", F.lit(1))
    flags = prepared.select("s1", "cand", "pa", "is_top").join(t, ["s1", "cand"], "left").join(p, ["s1", "cand"], "left")
    own = flags.groupBy("s1").agg(
        F.count("*").alias("n_cands"), F.count("true").alias("n_found"), F.count("pred").alias("n_pred"),
        F.count_if(F.col("true").isNotNull() & F.col("pred").isNotNull()).alias("tp"),
        F.max(F.when(F.col("is_top"), F.col("cand"))).alias("top_cand"), F.max(F.when(F.col("is_top"), F.col("pa"))).alias("top_p"),
        F.max(F.when(F.col("is_top"), F.col("true"))).alias("top_true"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("pred").isNotNull(), F.col("cand")))), ",").alias("pred_ids"),
    )
    listed = truth.groupBy("s1").agg(F.count("*").alias("n_truth"), F.array_join(F.array_sort(F.collect_list("cand")), ",").alias("true_ids"))
    e = ones.select("s1").join(own, "s1", "left").join(listed, "s1", "left")
    e = e.fillna(0, ["n_cands", "n_found", "n_pred", "tp", "top_true", "n_truth"]).fillna(0.0, ["top_p"]).fillna("", ["top_cand", "pred_ids", "true_ids"])
    n, pred, hit, found = F.col("n_truth"), F.col("n_pred"), F.col("tp"), F.col("n_found")
    ok_singleton, merged, blocked, top_right, top_wrong, wrong, extra, partly, missed, ok = map(F.lit, BUCKETS)
    bucket = F.when(n == 0, F.when(pred == 0, ok_singleton).otherwise(merged)).when(found == 0, blocked)
    bucket = bucket.when(pred == 0, F.when(F.col("top_true") == 1, top_right).otherwise(top_wrong)).when(hit == 0, wrong).when(pred > hit, extra)
    bucket = bucket.when(hit < n, F.when(found < n, partly).otherwise(missed)).otherwise(ok)
    return e.select("s1", bucket.alias("bucket"), F.round(f_half(pred, n, hit), 6).alias("f"), "n_truth", "n_pred", "n_cands", "top_cand", "top_p", F.col("true_ids").alias("truth"), F.col("pred_ids").alias("pred"))


def bucket_summary(buckets: DataFrame) -> DataFrame:
    """G8. (bucket, n, loss, loss_share), largest loss first."""
    out = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum(1 - F.col("f")), 6).alias("loss"))
    total = out.agg(F.sum("loss").alias("all"))
    return out.crossJoin(F.broadcast(total)).select("bucket", "n", "loss", F.round(F.coalesce(F.try_divide("loss", "all"), F.lit(0.0)), 6).alias("loss_share")).orderBy(F.desc("loss"), "bucket")  # one row


# Features shown beside a dumped pair.
KEY_FEATURES = ("sim_name", "sim_addr", "n_tset", "a_tset", "num_near", "postal_state", "chain_s1", "ctx_rank_prune_score")


def pair_dump(selected: DataFrame, prepared: DataFrame, truth: DataFrame, records: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """G9. Wrong, missed and blocked pairs with both raw texts: (kind, s1, cand, pa, s1_name, s1_addr, c_name, c_addr, country), and those of
    KEY_FEATURES that `pairs` (s1, cand) has; null for blocked pairs."""
    t = truth.select("s1", "cand")
    wrong = selected.select("s1", "cand", "pa").join(t, ["s1", "cand"], "left_anti").withColumn("kind", F.lit("FP"))
    missed = prepared.select("s1", "cand", "pa").join(t, ["s1", "cand"], "left_semi").join(selected.select("s1", "cand"), ["s1", "cand"], "left_anti").withColumn("kind", F.lit("FN_scored"))
    blocked = t.join(prepared.select("s1", "cand"), ["s1", "cand"], "left_anti").withColumns({"pa": F.lit(None).cast("double"), "kind": F.lit("FN_blocked")})
    side = lambda key, p: records.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_addr"), *([F.col("country")] if p == "s1" else []))
    every = wrong.unionByName(missed).unionByName(blocked)
    shown = [c for c in KEY_FEATURES if pairs is not None and c in pairs.columns]
    every = every.join(pairs.select("s1", "cand", *shown), ["s1", "cand"], "left") if shown else every
    return every.join(side("s1", "s1"), "s1", "left").join(side("cand", "c"), "cand", "left").select("kind", "s1", "cand", "pa", "s1_name", "s1_addr", "c_name", "c_addr", "country", *shown)


def audit(records: DataFrame) -> DataFrame:
    """G10. Per bc and source of normalised records: counts and rates of empty, postal, non-ASCII and repeated names."""
    name = F.array_join("name_core", " ")
    repeated = F.count("*").over(Window.partitionBy("bc", "src", name)) > 1
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return records.withColumn("__repeated", repeated).groupBy("bc", "src").agg(
        F.count("*").alias("n"),
        rate(F.coalesce("business_address", F.lit("")) == "").alias("empty_addr"),
        rate(F.coalesce("business_name", F.lit("")) == "").alias("empty_name"),
        rate(F.col("postal") != "").alias("with_postal"),
        rate(F.size("landmark") > 0).alias("with_landmark"),
        rate(F.col("business_name").rlike(r"[^\x00-\x7f]")).alias("non_ascii"),
        rate(F.col("__repeated")).alias("repeated_name"),
    )


def truth_shapes(truth: DataFrame, ones: DataFrame) -> DataFrame:
    """G10, G13. (n_s2, n_s3, n): how many queries have so many matches in each source."""
    per = truth.groupBy("s1").agg(F.count_if(F.col("cand").startswith("S2-")).alias("n_s2"), F.count_if(F.col("cand").startswith("S3-")).alias("n_s3"))
    return ones.select("s1").join(per, "s1", "left").fillna(0).groupBy("n_s2", "n_s3").agg(F.count("*").alias("n"))


def truth_sizes(truth: DataFrame, ones: DataFrame) -> DataFrame:
    """G10, G13. (n_truth, n): how many queries have so many matches."""
    per = truth.groupBy("s1").agg(F.count("*").alias("n_truth"))
    return ones.select("s1").join(per, "s1", "left").fillna(0).groupBy("n_truth").agg(F.count("*").alias("n"))


def contested(truth: DataFrame) -> DataFrame:
    """G10. Candidates that several queries claim as true; none if matching is one-to-one."""
    return truth.groupBy("cand").agg(F.count("*").alias("n")).where("n > 1")


def truth_agreement(truth: DataFrame, records: DataFrame) -> DataFrame:
    """G10. One row: share of true pairs of one bc, of equal postcodes where both have one, and of pool records no query claims."""
    own = records.select(F.col("entity_id").alias("s1"), F.col("bc").alias("bc1"), F.col("postal").alias("p1"))
    other = records.select(F.col("entity_id").alias("cand"), F.col("bc").alias("bc2"), F.col("postal").alias("p2"))
    pairs = truth.select("s1", "cand").join(own, "s1").join(other, "cand")
    both = (F.col("p1") != "") & (F.col("p2") != "")
    claimed = records.where("src <> 1").select(F.col("entity_id").alias("cand")).join(truth.select("cand").distinct().withColumn("true", F.lit(1)), "cand", "left")
    rates = pairs.agg(F.round(F.avg((F.col("bc1") == F.col("bc2")).cast("double")), 6).alias("same_country"), F.round(F.avg(F.when(both, (F.col("p1") == F.col("p2")).cast("double"))), 6).alias("same_postal"))
    return rates.crossJoin(claimed.agg(F.round(1 - F.count("true") / F.count("*"), 6).alias("unmatched_pool")))  # one row each


def top_names(records: DataFrame, n: int = 15) -> DataFrame:
    """G10. The most frequent core names."""
    return records.groupBy(F.array_join("name_core", " ").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def density_weights(test: DataFrame, train: DataFrame) -> DataFrame:
    """G11. (s1, w) of the train queries: how frequent their ambiguity is in test against train, clipped and with mean 1.

    Both have bc, s1, p; ambiguity is the number of candidates with 0.1 < p < 0.9, at most 4.
    """
    def ambiguity(d: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        own = d.groupBy("bc", "s1").agg(F.least(F.count_if((F.col("p") > 0.1) & (F.col("p") < 0.9)), F.lit(4)).alias("b"))
        n = own.groupBy("bc", "b").agg(F.count("*").alias("n"))
        return own, n.select("bc", "b", (F.col("n") / F.sum("n").over(Window.partitionBy("bc"))).alias(name))

    (_, there), (own, here) = ambiguity(test, "p_test"), ambiguity(train, "p_train")
    raw = own.join(here, ["bc", "b"]).join(there, ["bc", "b"], "left")
    raw = raw.withColumn("raw", F.greatest(F.lit(0.5), F.least(F.coalesce("p_test", F.lit(0.0)) / F.col("p_train"), F.lit(4.0))))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("s1", F.round(F.col("raw") / F.col("mean"), 6).alias("w"))  # one row


def sizes(lists: DataFrame, column: str) -> DataFrame:
    """G12. Mean and 95th percentile of list lengths."""
    return lists.agg(F.round(F.avg(F.size(column)), 6).alias("mean"), F.round(F.percentile(F.size(column), F.lit(0.95)), 6).alias("p95"))


def running_total(records: DataFrame) -> DataFrame:
    """G14. (bc, region, n, cumulative): queries by region, in order of region."""
    n = records.where("src = 1").groupBy("bc", "region").agg(F.count("*").alias("n"))
    return n.withColumn("cumulative", F.sum("n").over(Window.partitionBy("bc").orderBy("region")))


def self_check(matches: DataFrame, cands: DataFrame, ones: DataFrame) -> DataFrame:
    """D14. (rule, n): violations of the output's rules, over lists matches (s1, cands) and cands (s1, cands)."""
    m = matches.select("s1", F.explode("cands").alias("cand"))
    c = cands.select("s1", F.explode("cands").alias("cand"))
    checks = {
        "repeated_id": m.groupBy("s1", "cand").count().where("count > 1").select("s1"),
        "wrong_source": m.where(~F.col("cand").rlike("^S[23]-")).select("s1"),
        "not_a_candidate": m.join(c, ["s1", "cand"], "left_anti").select("s1"),
        "unknown_query": m.join(ones, "s1", "left_anti").select("s1"),
    }
    out = None
    for rule, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def missed_pairs(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """D16. True pairs that were not retrieved."""
    return truth.select("s1", "cand").join(large(cands.select("s1", "cand")), ["s1", "cand"], "left_anti")


def missed_similarity(missed: DataFrame, records: DataFrame, weights: DataFrame, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """D16. (view, n, q10, q50, q90): quantiles of the exact cosines of missed pairs, which tell why they were not retrieved."""
    bc = records.select(F.col("entity_id").alias("s1"), "bc")
    sims = pair_cosine(missed.join(large(bc), "s1"), weights)
    rows = sims.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view"), F.col(f"sim_{v}").alias("sim")) for v in VIEWS))).alias("x")).select("x.*")
    return rows.groupBy("view").agg(F.count("*").alias("n"), *(F.round(F.percentile("sim", F.lit(q)), 6).alias(f"q{round(100 * q)}") for q in at))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """D15. (bucket, n_a, n_b, loss_a, loss_b, delta) of two error_buckets results."""
    one = lambda d, x: d.groupBy("bucket").agg(F.count("*").alias(f"n_{x}"), F.round(F.sum(1 - F.col("f")), 6).alias(f"loss_{x}"))
    both = one(a, "a").join(one(b, "b"), "bucket", "full").fillna(0)
    return both.withColumn("delta", F.round(F.col("loss_b") - F.col("loss_a"), 6))


def blank_country(lists: DataFrame, records: DataFrame, bc: str) -> DataFrame:
    """S14. lists (s1, cands) with those of one country emptied."""
    own = records.where("src = 1").select(F.col("entity_id").alias("s1"), "bc")
    empty = F.array().cast("array<string>")
    return own.join(lists, "s1", "left").select("s1", F.when(F.col("bc") == bc, empty).otherwise(F.coalesce("cands", empty)).alias("cands"))
