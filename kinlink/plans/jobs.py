"""Whole runs: normalise, retrieve, featurise, score in two stages, decide, evaluate, and score records without truth.

A run's tables lie under names made of what they depend on (configuration, inputs, code): a run that was stopped goes on from the tables
that it had finished, and one of other settings shares those that these do not change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions.text import normalise
from kinlink.operators import decide, features, metrics, model, retrieve
from kinlink.plans import config as C
from kinlink.sources import records as R
from kinlink.sources.tables import kept, materialise

#: Columns that a learned pruner does not read: they are what it replaces.
NOT_PRUNED_BY = {"prune_score"}


@dataclass
class Models:
    """What a training run hands to a scoring run. Columns are the features that each stage's models read."""

    settings: model.Settings
    columns: list[str]
    stage1: list[PipelineModel]
    stage2: list[PipelineModel]
    columns2: list[str]
    thresholds: tuple[float, float, float]
    rank: str = "none"
    pruner: tuple[list[PipelineModel], list[str]] | None = None


@dataclass
class Store:
    """Where a run's tables lie; without a root they are temporary."""

    root: str | None
    facts: tuple = ()

    def table(self, step: str, make, *facts: object) -> DataFrame:
        """make() written under the step's name, or read if it was written before."""
        if self.root is None:
            return materialise(make())
        path = C.folder_of(self.root, step, *self.facts, *facts)
        return kept(make(), path)


def settings_of(config: dict) -> model.Settings:
    """The part of a configuration that fits need."""
    own = {k: config["model"][k] for k in ("trees", "depth", "folds", "full_iter_mult") if k in config["model"]}
    return model.Settings(**own, seeds=tuple(config["model"]["seeds"]))


def chosen_countries(records: DataFrame, config: dict) -> DataFrame:
    """O6. Normalised records of the configured countries, all of them by default: countries are a join key, not a loop."""
    norm = normalise(records)
    return norm.where(F.col("bc").isin(config["countries"])) if config.get("countries") else norm


def pruned(union: DataFrame, norm: DataFrame, blocking: dict, pruner: tuple[list[PipelineModel], list[str]] | None, settings: model.Settings) -> DataFrame:
    """R11-R13. The candidates kept of a union, by mean, maximum or a trained pruner's probability."""
    scored = retrieve.prune_score(union, "max" if blocking["score"] == "max" else "mean")
    if blocking["score"] == "learned":
        if pruner is None:
            raise ValueError("a learned prune score needs a pruner: see train_pruner")
        learned = model.predict(pruner[0], retrieve.prune_features(scored, norm), pruner[1], settings, "learned").select("bc", "s1", "cand", "learned")
        scored = scored.join(learned, ["bc", "s1", "cand"]).withColumn("prune_score", F.round("learned", 6)).drop("learned")
    return retrieve.prune(scored, blocking["max_k"], blocking["min_score"])


def retrieve_all(records: DataFrame, config: dict, store: Store | None = None, sample: DataFrame | None = None, pruner=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O6, O9. (normalised, postings, candidates) of raw records; candidates of the sampled queries (s1) if there is a sample."""
    store, blocking = store or Store(None), config["blocking"]
    norm = store.table("norm", lambda: chosen_countries(records, config), config.get("countries"))
    weights = store.table("postings", lambda: retrieve.postings(retrieve.documents(norm), blocking["max_df"]), config.get("countries"), blocking["max_df"])

    def make() -> DataFrame:
        queries = weights.where("src = 1")
        queries = queries if sample is None else queries.join(sample.select(F.col("s1").alias("id")), "id", "left_semi")
        found = materialise(retrieve.top_k(queries, weights.where("src <> 1"), blocking["k"], blocking["min_sim"]))
        first = materialise(pruned(retrieve.union(found, weights, blocking["k"]), norm, blocking, pruner, settings_of(config)))
        return retrieve.second_hop(first, weights, max_k=blocking["max_k"], first_k=blocking["k"], **blocking["hop"]) if blocking.get("hop") else first

    return norm, weights, store.table("candidates", make, blocking, config.get("countries"), config.get("sample") if sample is not None else None, config.get("pruner"))


def sampled(norm: DataFrame, config: dict) -> DataFrame | None:
    """D11, D12. The queries (s1) that a configuration trains on; None for all."""
    if not config.get("sample"):
        return None
    ones = norm.where("src = 1").select(F.col("entity_id").alias("s1"), "bc", "region")
    take = model.sample_regions if config["sample"]["mode"] == "region" else model.sample_queries
    return materialise(take(ones, config["sample"]["n"], config["sample"].get("seed", 42)).select("s1"))


def build_train(records: DataFrame, truth: DataFrame, config: dict, store: Store | None = None, pruner=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """O7. (features with y, candidates, normalised records) of the sampled queries, kept for later runs."""
    store = store or Store(None)
    norm = store.table("norm", lambda: chosen_countries(records, config), config.get("countries"))
    sample = sampled(norm, config)
    norm, weights, cands = retrieve_all(records, config, store, sample, pruner)
    rows = store.table("features", lambda: model.label(features.features(cands, norm, weights), truth), config["blocking"], config.get("sample"), config.get("countries"), config.get("pruner"))
    return rows, cands, norm


def blocking_only(records: DataFrame, truth: DataFrame, ones: DataFrame, config: dict, store: Store | None = None, pruner=None) -> dict[str, DataFrame]:
    """O12. Retrieval without any model: its metrics, recall by rank, what single views found and what was missed."""
    norm, weights, cands = retrieve_all(records, config, store, None, pruner)
    pool = norm.where("src <> 1").count()
    out = {"blocking": metrics.blocking(cands, truth, ones, pool), "recall": retrieve.recall_at(cands, truth, "prune_score")}
    missed = metrics.missed_pairs(truth, cands)
    return out | {"missed": missed, "missed_similarity": metrics.missed_similarity(missed, norm, weights)}


def experiment(records: DataFrame, truth: DataFrame, ones: DataFrame, config: dict, thresholds: tuple[float, float, float] | None = None, store: Store | None = None, weights: DataFrame | None = None, pruner=None) -> tuple[dict[str, DataFrame], dict]:
    """O12. A training run: (tables, facts). Out-of-fold scores of both stages, the threshold curve, and the metrics of the chosen thresholds.

    weights: (s1, w), e.g. of metrics.density_weights; used if the configuration says so. With `loco`, scores of each country by the others'
    models stand beside. Facts are the configuration, features, thresholds, trees at which the models stopped, importance and provenance.
    """
    settings = settings_of(config)
    rows, cands, norm = build_train(records, truth, config, store, pruner)
    asked = sampled(norm, config)
    ones = ones if asked is None else ones.join(asked, "s1", "left_semi")
    rows = materialise(model.entity_weights(model.rank_normalise(rows, model.rank_columns(model.feature_columns(rows), config.get("rank", "none"))), weights if config.get("weights") else None))
    columns = model.feature_columns(rows)
    scored, trees = model.cross_validated(rows, columns, settings, "p1")
    scored, trees2, columns2 = materialise(scored), [], []
    final = scored.withColumnRenamed("p1", "p")
    if config.get("stage2"):
        second = materialise(stacked(rows, scored))
        columns2 = model.feature_columns(second)
        final, trees2 = model.cross_validated(second, columns2, settings, "p")
    final = materialise(final)
    d = decide.prepare(final, config["decide"]["one_to_one"])
    out = {"candidates": cands, "scores": final, "scores1": scored}
    if thresholds is None:
        grid = [decide.steps(*config["decide"]["grid"][k]) for k in ("t_first", "t_other", "t_extra")]
        out["curve"] = materialise(decide.grid_search(d, truth, ones, *grid))
        best = out["curve"].where("chosen").head()
        thresholds = best.t_first, best.t_other, best.t_extra
    chosen = decide.select(d, *thresholds)
    entities = decide.entity_f(chosen, truth, ones).join(ones.select("s1", "bc"), "s1")
    pool = norm.where("src <> 1").count()
    labelled = model.label(final, truth)
    if config.get("loco"):
        out["transfer"] = model.leave_one_out(rows, columns, settings)
    out |= {
        "matches": decide.to_lists(chosen),
        "entities": entities,
        "breakdown": metrics.breakdown(entities),
        "blocking": metrics.blocking(cands, truth, ones, pool),
        "calibration": metrics.reliability(labelled),
        "calibration_error": metrics.expected_calibration_error(labelled),
        "buckets": metrics.bucket_summary(metrics.error_buckets(d, chosen, truth, ones)),
        "pairs": metrics.pair_dump(chosen, d, truth, records, rows),
    }
    full = model.fit_full(rows, columns, settings, model.full_trees(trees, settings))
    facts = {"config": config, "features": columns, "features2": columns2, "thresholds": thresholds, "trees": trees, "trees2": trees2}
    return out, facts | {"importance": model.importance(full, columns), "code": C.code_version(), "git": C.provenance()}


def stacked(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """The second stage's rows: neighbourhood features of first-stage scores (s1, cand, p1), with the keys and, if there are, y and w."""
    both = rows.join(scored.select("s1", "cand", "p1"), ["s1", "cand"])
    keys = [c for c in ("bc", "s1", "cand", "cand_src", "y", "w") if c in rows.columns]
    return features.stage2_features(both).join(rows.select(*keys), ["s1", "cand"])


def train(records: DataFrame, truth: DataFrame, ones: DataFrame, config: dict, store: Store | None = None, weights: DataFrame | None = None, pruner=None) -> tuple[Models, dict[str, DataFrame], dict]:
    """O8. An experiment, then models of both stages on all its rows: (models, the experiment's tables, its facts).

    The second stage learns from out-of-fold scores of the first, as in validation; the numbers of trees are the median at which the
    cross-validated models stopped, times full_iter_mult.
    """
    out, facts = experiment(records, truth, ones, config, store=store, weights=weights, pruner=pruner)
    settings = settings_of(config)
    rows, _, _ = build_train(records, truth, config, store, pruner)
    rows = materialise(model.entity_weights(model.rank_normalise(rows, model.rank_columns(model.feature_columns(rows), config.get("rank", "none"))), weights if config.get("weights") else None))
    first = model.fit_full(rows, facts["features"], settings, model.full_trees(facts["trees"], settings))
    second: list[PipelineModel] = []
    if facts["trees2"]:
        second = model.fit_full(materialise(stacked(rows, out["scores1"])), facts["features2"], settings, model.full_trees(facts["trees2"], settings))
    return Models(settings, facts["features"], first, second, facts["features2"], tuple(facts["thresholds"]), config.get("rank", "none"), pruner), out, facts


def score(records: DataFrame, models: Models, config: dict, store: Store | None = None) -> DataFrame:
    """O8. (bc, s1, cand, cand_src, p) of all queries of records without truth, by full models of both stages."""
    store = store or Store(None)
    norm, weights, cands = retrieve_all(records, {**config, "sample": None}, store, None, models.pruner)
    rows = materialise(features.features(cands, norm, weights))
    rows = model.rank_normalise(rows, model.rank_columns(models.columns, models.rank))
    scored = materialise(model.predict(models.stage1, rows, models.columns, models.settings, "p1"))
    if not models.stage2:
        return scored.withColumnRenamed("p1", "p")
    return model.predict(models.stage2, stacked(rows, scored), models.columns2, models.settings, "p")


def finalise(scores: DataFrame, ones: DataFrame, thresholds: tuple[float, float, float], one_to_one: bool = True) -> tuple[DataFrame, DataFrame]:
    """S13. (matches, candidates) lists from saved scores alone, for the queries `ones`."""
    d = decide.prepare(scores.join(ones.select("s1"), "s1", "left_semi"), one_to_one)
    return decide.to_lists(decide.select(d, *thresholds)), decide.to_lists(d.withColumn("pa", F.col("p")))


def submit(spark: SparkSession, records: DataFrame, models: Models, config: dict, folder: str, note: str = "", store: Store | None = None) -> DataFrame:
    """O8, S10-S13. Score a split without truth, decide, check, write both lists, the scores and the facts, and add a row to the registry.

    A list that breaks a rule of the output is an error, and nothing is written. The result is the registry.
    """
    store = store or Store(None)
    scores = store.table("scores", lambda: score(records, models, config, store), config, models.thresholds)
    ones = records.where("src = 1").select(F.col("entity_id").alias("s1"))
    matches, cands = (materialise(x) for x in finalise(scores, ones, models.thresholds, config["decide"]["one_to_one"]))
    broken = {r["rule"]: r["n"] for r in metrics.self_check(matches, cands, ones).where("n > 0").collect()}
    if broken:
        raise ValueError(f"the output breaks {broken}")
    R.write_tsv(R.id_lists(matches, ones), f"{folder}/matching_results", "source1_entity_id")
    R.write_tsv(R.id_lists(cands, ones, "candidate_entity_ids"), f"{folder}/candidate_pairs", "source1_entity_id")
    size = metrics.sizes(cands, "cands").head()
    pred = ones.join(matches, "s1", "left").agg(F.sum(F.coalesce(F.size("cands"), F.lit(0))), F.avg((F.coalesce(F.size("cands"), F.lit(0)) <= 0).cast("double"))).head()
    facts = {"candidates_mean": size["mean"], "candidates_p95": size["p95"], "matches": pred[0], "singleton_rate": pred[1], "note": note}
    facts |= dict(zip(("t_first", "t_other", "t_extra"), models.thresholds)) | C.provenance()
    R.write_artefacts({"scores": scores}, folder, {"config": config, **facts})
    return R.append_registry(spark, f"{folder}/registry", facts)


def train_pruner(records: DataFrame, truth: DataFrame, config: dict, sample: DataFrame, leave_out: DataFrame | None = None, store: Store | None = None) -> tuple[tuple[list[PipelineModel], list[str]], DataFrame]:
    """R17. A learned pruner over the unpruned union of sampled queries (s1), none of them in `leave_out` (the sample of the main
    run), and its recall@k against the mean score's.

    Seven tenths of the queries train, the rest measure; the pruner handed on learns from all.
    """
    settings, blocking = settings_of(config), config["blocking"]
    own = sample if leave_out is None else sample.join(leave_out.select("s1"), "s1", "left_anti")
    store = store or Store(None)
    norm = store.table("norm", lambda: chosen_countries(records, config), config.get("countries"))
    weights = store.table("postings", lambda: retrieve.postings(retrieve.documents(norm), blocking["max_df"]), config.get("countries"), blocking["max_df"])
    queries = weights.where("src = 1").join(own.select(F.col("s1").alias("id")), "id", "left_semi")
    found = materialise(retrieve.top_k(queries, weights.where("src <> 1"), blocking["k"], blocking["min_sim"]))
    union = retrieve.prune_score(retrieve.union(found, weights, blocking["k"]))
    rows = materialise(model.entity_weights(model.label(retrieve.prune_features(union, norm), truth), None))
    columns = [c for c in model.feature_columns(rows) if c not in NOT_PRUNED_BY]
    learns = model.fold_of(F.col("s1"), 10, 7) < 7
    held = rows.where(~learns)
    trial = model.predict(model.fit_full(rows.where(learns), columns, settings), held, columns, settings, "learned").join(held.select("s1", "cand", "prune_score"), ["s1", "cand"])
    by = {n: retrieve.recall_at(trial, truth, c).withColumnRenamed("recall", n) for n, c in (("mean_recall", "prune_score"), ("learned_recall", "learned"))}
    return (model.fit_full(rows, columns, settings), columns), by["mean_recall"].join(by["learned_recall"], "k")


def density_weights(train_scores: DataFrame, train_ones: DataFrame, store: Store, config: dict, thresholds: tuple) -> DataFrame:
    """O14, G11. (s1, w) of the training queries (s1, bc) by how ambiguous those of the split without truth are, whose scores a run of the
    same configuration has left in its store."""
    path = C.folder_of(store.root, "scores", *store.facts, config, thresholds)
    there = train_scores.sparkSession.read.parquet(path)
    here = train_scores.select("s1", "cand", "p").join(train_ones.select("s1", "bc"), "s1")
    return metrics.density_weights(there.select("bc", "s1", "p"), here)
