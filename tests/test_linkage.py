"""Linkage operators: SQL agreement of every query, kernels, sources, models, streaming."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from kinlink.functions import kernels as K
from kinlink.operators import decide, features, metrics, model, retrieve, tiles
from kinlink.plans import config
from kinlink.plans.queries import ORACLES, QUERIES, kept, norm, post
from kinlink.sources import fixtures, records, tables

TABLES = "customer nation part documents benchmark".split()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(str({k: plain(v) for k, v in sorted(zip(columns, r))}) for r in found.fetchall())
    assert sorted(str({k: plain(v) for k, v in sorted(r.asDict().items())}) for r in got.collect()) == want


def test_entry_and_registration(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_kernels():
    assert K.indel("abcd", "abxy") == 50 and K.indel("", "") == 100 and K.indel("a", "") == 0
    assert K.partial("abc", "xxabcxx") == 100 and K.partial("", "a") == 0
    assert K.token_sort("b a", "a b") == 100 and K.token_set("a b", "b a c") == 100 and K.token_set("", "a") == 0
    assert K.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and K.jaro_winkler("", "") == 1
    assert K.jaro_winkler("abcd", "abxy") == pytest.approx(2 / 3)


def slow_indel(a, b):
    """100 * 2 LCS / (len a + len b) by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_kernels_against_plain_definitions():
    import random

    random.seed(11)
    text = lambda n: " ".join("".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(random.randint(0, n)))
    for _ in range(400):
        a, b = text(4), text(4)
        assert K.indel(a, b) == pytest.approx(slow_indel(a, b))
        short, long = sorted((a, b), key=len)
        tried = []
        for x, y in ((short, long), (long, short)) if len(a) == len(b) else ((short, long),):
            tried += [slow_indel(x, y[i:j]) for i in range(len(y)) for j in range(i + 1, len(y) + 1) if j - i == len(x) or (j - i < len(x) and (i == 0 or j == len(y)))]
        assert K.partial(a, b) == pytest.approx(max(tried) if short else (0.0 if long else 100.0))
        order = lambda s: " ".join(sorted(s.split()))
        assert K.token_sort(a, b) == pytest.approx(slow_indel(order(a), order(b)))
        x, y = set(a.split()), set(b.split())
        both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if not x or not y:
            want = 0.0
        elif both and not (one and two):
            want = 100.0
        else:
            left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
            want = max(slow_indel(left, right), *((slow_indel(both, left), slow_indel(both, right)) if both else (0.0,)))
        assert K.token_set(a, b) == pytest.approx(want)


def test_kernels_of_many_pairs_are_those_of_each(monkeypatch):
    import random

    random.seed(12)
    text = lambda n, letters: " ".join("".join(random.choice(letters) for _ in range(random.randint(1, 9))) for _ in range(random.randint(0, n)))
    pairs = [(text(n, s), text(n, s)) for n in (1, 4, 9, 30) for s in ("ab", "abcdefgh", "aé\u0915\U00020000") for _ in range(60)]
    pairs += [("", ""), ("", "a"), ("a" * 64, "a" * 64), ("ab" * 32, "ba" * 40), ("a" * 65, "a" * 65), ("x" * 64, "y" * 64)]
    pairs += [(a, a[::-1]) for a, _ in pairs]
    monkeypatch.setattr(K, "CELLS", 3000)
    for many, one in ((K.indels, K.indel), (K.partials, K.partial), (K.token_sorts, K.token_sort), (K.token_sets, K.token_set)):
        assert many(pairs) == pytest.approx([one(*p) for p in pairs], abs=1e-12)
        assert many([]) == []


def test_second_hop_is_not_part_of_the_plan_of_all_features(spark, sf_dir):
    plan = QUERIES["all_pair_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "hop_best" in plan and plan.count("FlatMapGroupsInArrow") == 1  # the cosines of siblings


def test_number_kernels(spark):
    df = spark.createDataFrame([(["2777"], ["277"]), (["10"], ["12", "8"]), ([], ["1"]), (["5"], ["5", "7"])], "a array<string>, b array<string>")
    got = df.select(K.number_near(F.col("a"), F.col("b")), K.number_differences(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1, 0, -1, 2]
    assert got[1][1] == (2.0, -2.0, 2.0) and got[2][1] is None and got[3][1] == (0.0, 2.0, 1.0)


def test_f_half(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (2, 2, 1), (1, 2, 1)], "p int, t int, h int")
    got = [r[0] for r in df.select(metrics.f_half(F.col("p"), F.col("t"), F.col("h"))).collect()]
    assert got == pytest.approx([1, 0, 0, 0.5, 1.25 * 0.5 / 0.75])


def test_ties_keep_both_owners(spark):
    d = decide.prepare(spark.createDataFrame([("a", "x", 2, 0.9), ("b", "x", 2, 0.9), ("c", "x", 2, 0.5)], "s1 string, cand string, cand_src int, p double"))
    assert {r.s1: r.pa for r in d.collect()} == {"a": 0.9, "b": 0.9, "c": 0.0}


def test_tsv_round_trip(spark, tmp_path):
    folder = tmp_path / "data" / "train"
    folder.mkdir(parents=True)
    for src in (1, 2, 3):
        rows = [f'S{src}-{k}\t "Quoted" Co \tNA\tUS' for k in range(3)] + [f"S{src}-9\t\tnull\t"]
        (folder / f"train_source{src}.tsv").write_text("entity_id\t business_name\tbusiness_address\tcountry\n" + "\n".join(rows) + "\n")
    got = records.load_split(spark, str(tmp_path / "data"), "train")
    assert got.count() == 12
    r = got.where("entity_id = 'S1-0'").head()
    assert (r.business_name, r.business_address, r.src) == ('"Quoted" Co', "NA", 1)
    assert got.where("entity_id = 'S2-9'").head().business_name == ""
    ones = got.where("src = 1").select(F.col("entity_id").alias("s1"))
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-1, S3-1,,S2-1\nS1-1\t\n")
    truth = {r.s1: r.matched for r in records.load_truth(spark, str(tmp_path / "truth.tsv"), ones).collect()}
    assert truth == {"S1-0": ["S2-1", "S3-1"], "S1-1": [], "S1-2": [], "S1-9": []}
    lists = records.id_lists(spark.createDataFrame([("S1-0", ["b", "a", "b"])], "s1 string, cands array<string>"), ones)
    records.write_tsv(lists, str(tmp_path / "out"), "source1_entity_id")
    assert records.read_tsv(spark, str(tmp_path / "out")).where("source1_entity_id = 'S1-0'").head().matched_entity_ids == "b,a"
    (folder / "train_source3.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-0\ta\tb\tc\n")
    with pytest.raises(ValueError, match="repeated"):
        records.load_split(spark, str(tmp_path / "data"), "train")


def test_normalised_parquet_and_registry(spark, sf_dir, tmp_path):
    from kinlink.functions.text import normalise

    path = str(tmp_path / "norm")
    records.write_normalised(normalise(fixtures.records(spark, sf_dir).limit(50)), path)
    assert records.count_rows(spark, path) == 50
    assert set(records.load_normalised(spark, path, [1], ["entity_id", "bc"], "us").columns) == {"entity_id", "bc"}
    registry = str(tmp_path / "registry")
    records.append_registry(spark, registry, {"id": "a", "f": 1})
    assert set(records.append_registry(spark, registry, {"id": "b", "g": 2}).columns) == {"id", "f", "g"}


def test_config(tmp_path, spark):
    (tmp_path / "base.json").write_text('{"model": {"seeds": [1, 2]}, "x": 1, "blocking": {"hop": null}}')
    (tmp_path / "child.json").write_text('{"inherit": "base.json", "model": {"folds": 2}}')
    c = config.read_settings(str(tmp_path / "child.json"))
    assert c["model"]["seeds"] == [1, 2] and c["model"]["folds"] == 2 and c["model"]["depth"] == 5 and c["x"] == 1 and c["blocking"]["hop"] is None and c["blocking"]["k"] == 60
    assert config.key_of({"a": 1, "b": 2}) == config.key_of({"b": 2, "a": 1}) != config.key_of({"a": 1, "b": 3}) and len(config.code_version()) == 16
    every = {name: config.experiment_settings(name) for name in config.EXPERIMENTS}
    assert every["e011"]["blocking"] == {**config.BASE["blocking"], "score": "learned", "min_sim": 0.05, "min_score": 0.0} and every["e011"]["stage2"] and every["e012"]["weights"]
    assert every["e001"]["blocking"]["hop"] is None and every["e001"]["blocking"]["max_k"] == 15 and every["e003_blk_us"]["countries"] == ["us"] and every["e002"]["pruner"]["n"] == 60_000
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.tsv").write_text("x")
    before = config.input_signature(spark, str(tmp_path / "t"))
    (tmp_path / "t" / "a.tsv").write_text("xy")
    assert before[0][:2] == ("a.tsv", 1) and config.input_signature(spark, str(tmp_path / "t")) != before
    assert config.folder_of("r", "s", before) != config.folder_of("r", "s", 1) and config.provenance(str(tmp_path)) == {}


def test_out_of_fold_scores_and_pruning_rank(spark):
    data = [("us" if k % 2 else "in", f"q{k}", f"c{j}", 2 + j % 2, float(j == 0), 1.0 if j == 0 else None, 1.0) for k in range(40) for j in range(3)]
    df = spark.createDataFrame(data, "bc string, s1 string, cand string, cand_src int, y double, x double, w double")
    s = model.Settings(trees=2, depth=2, folds=2)
    got = model.out_of_fold(df, ["x", "cand_src"], s)
    assert got.count() == 120 and got.where("cand = 'c0'").agg(F.min("p")).head()[0] > got.where("cand <> 'c0'").agg(F.max("p")).head()[0]
    assert model.full_trees([3, 5, 4], model.Settings(full_iter_mult=1.5)) == 6
    ranks = model.rank_normalise(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 3.0)], "bc string, v double"), ["v"])
    assert sorted(r.v for r in ranks.collect()) == [0.25, 0.5, 0.875, 0.875]


def test_no_score_is_by_a_model_that_learnt_from_its_query(spark):
    """A model that knows each query's label by a feature of its own gives away any row that it was trained on."""
    data = [("us", f"q{k}", "c", 2, float(k * 7 % 10 < 5), float(k), 1.0) for k in range(120)]
    df = spark.createDataFrame(data, "bc string, s1 string, cand string, cand_src int, y double, x double, w double")
    one = model.Settings(trees=3, depth=5, folds=3, rate=1.0, seeds=(42, 7), tolerance=0.0)
    fits, seen = model.fit, []

    def spy(rows, columns, s, seed, trees=None, held=None):
        seen.append((seed, {r.s1 for r in rows.where(~held).collect()}, {r.s1 for r in rows.where(held).collect()}))
        return fits(rows, columns, s, seed, trees, held)

    model.fit = spy
    try:
        got, trees = model.cross_validated(df, ["x"], one)
    finally:
        model.fit = fits
    assert got.count() == 120 and len(trees) == 6 and all(1 <= t <= 3 for t in trees)
    for seed in one.seeds:
        held = [h for k, _, h in seen if k == seed]
        assert sorted(q for h in held for q in h) == sorted(r[1] for r in data)  # each query is held out once by every seed
        assert all(not (t & h) for k, t, h in seen if k == seed)
    assert {frozenset(h) for k, _, h in seen if k == 42} != {frozenset(h) for k, _, h in seen if k == 7}


def test_percentile_ranks_over_ranges(spark):
    import pandas as pd

    data = [("ab"[k % 2] if k % 7 else None, float(k * 37 % 23) if k % 11 else None) for k in range(400)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "k int, bc string, v double")
    got = {r.k: r.v for r in model.rank_normalise(df, ["v"]).collect()}
    want = pd.DataFrame(data, columns=["bc", "v"]).groupby("bc", dropna=False).v.rank(pct=True)
    assert all((got[k] is None and pd.isna(w)) or got[k] == pytest.approx(w) for k, w in enumerate(want)) and len(got) == 400


def test_region_samples_are_whole_and_near_their_share(spark):
    data = [(f"q{k}", "us" if k % 3 else "in", "" if k % 10 == 0 else f"r{k % 17 if k % 2 else 99}") for k in range(3000)]
    ones = spark.createDataFrame(data, "s1 string, bc string, region string")
    got = model.sample_regions(ones, 600).collect()
    sizes = {}
    for _, bc, r in data:
        sizes[bc, r] = sizes.get((bc, r), 0) + 1
    taken = {}
    for r in got:
        if r.region:
            taken.setdefault((r.bc, r.region), set()).add(r.s1)
    assert all(len(v) == sizes[k] for k, v in taken.items())
    for bc in ("us", "in"):
        total = sum(n for (b, r), n in sizes.items() if b == bc and r)
        assert 0.5 * total / 5 <= sum(len(v) for (b, _), v in taken.items() if b == bc) <= 1.6 * total / 5
    assert sorted(map(str, got)) == sorted(map(str, model.sample_regions(ones.repartition(3), 600).collect()))


@pytest.fixture(scope="module")
def small_run(spark, sf_dir):
    """Records of a few hundred entities, and a quick configuration."""
    every = fixtures.records(spark, sf_dir).where("cast(substring(entity_id, -5) as int) <= 120")
    truth = fixtures.truth(spark, sf_dir).join(every.select(F.col("entity_id").alias("cand")), "cand", "left_semi").join(every.select(F.col("entity_id").alias("s1")), "s1", "left_semi")
    ones = fixtures.ones(spark, sf_dir).join(every.select(F.col("entity_id").alias("s1")), "s1", "left_semi")
    quick = {"blocking": {"k": 8, "max_k": 6, "hop": {"anchor_rank": 3, "anchor_min_sim": 0.6, "k": 3, "min_sim": 0.5, "max_add": 2}}, "model": {"trees": 3, "depth": 3, "folds": 2, "seeds": [42]}, "loco": False}
    quick["decide"] = {"grid": {"t_first": [0.3, 0.7, 0.2], "t_other": [0.5, 0.7, 0.2], "t_extra": [0.6, 0.8, 0.2]}}
    return every, truth, ones, config.layered(quick, config.BASE)


def test_training_scoring_and_registry(spark, small_run, tmp_path):
    from kinlink.plans import jobs

    every, truth, ones, settings = small_run
    store = jobs.Store(str(tmp_path / "tables"), ("small",))
    models, out, facts = jobs.train(every, truth, ones, settings, store)
    assert out["breakdown"].where("bc is null").head().macro_f > 0.7 and facts["importance"] and len(models.stage2) == 1 and len(facts["trees"]) == 2
    assert out["pairs"].columns[-8:] == list(metrics.KEY_FEATURES)
    tables = sorted(p.name for p in (tmp_path / "tables").iterdir())
    jobs.build_train(every, truth, settings, store)
    assert sorted(p.name for p in (tmp_path / "tables").iterdir()) == tables  # nothing is made twice
    registry = jobs.submit(spark, every, models, settings, str(tmp_path / "out"), "first", store)
    assert registry.count() == 1 and registry.head().note == "first"
    lists = records.read_tsv(spark, str(tmp_path / "out" / "matching_results"))
    assert lists.count() == ones.count() and lists.columns == ["source1_entity_id", "matched_entity_ids"]
    scores = spark.read.parquet(str(tmp_path / "out" / "scores"))
    d = decide.prepare(scores)
    assert decide.macro_f(decide.entity_f(decide.select(d, *models.thresholds), truth, ones)).head()[0] > 0.8
    again, cands = jobs.finalise(scores, ones, models.thresholds)
    assert again.count() <= cands.count() <= ones.count()
    w = jobs.density_weights(out["scores"], ones, store, settings, models.thresholds)
    assert w.agg(F.avg("w")).head()[0] == pytest.approx(1, abs=1e-3)


def test_learned_pruner_and_blocking_only(spark, small_run):
    from kinlink.plans import jobs

    every, truth, ones, settings = small_run
    left_out = ones.limit(30)
    pruner, report = jobs.train_pruner(every, truth, settings, ones, left_out)
    assert {r.k for r in report.collect()} == {1, 2, 3, 5, 10, 20, 50} and "prune_score" not in pruner[1]
    learned = config.layered({"blocking": {"score": "learned", "hop": None}}, settings)
    out = jobs.blocking_only(every, truth, ones, learned, pruner=pruner)
    assert out["blocking"].head().pair_recall > 0.8 and out["missed_similarity"].count() in (0, 3)
    with pytest.raises(ValueError, match="pruner"):
        jobs.blocking_only(every, truth, ones, learned)


def test_transfer_rank_modes_and_ablation(spark):
    data = [("us" if k % 2 else "in", f"q{k}", f"c{j}", 2 + j % 2, float(j == 0), 1.0 if j == 0 else 0.1 * j, 1.0, float(k % 5)) for k in range(40) for j in range(3)]
    df = spark.createDataFrame(data, "bc string, s1 string, cand string, cand_src int, y double, sim_name double, w double, chain_s1 double")
    s = model.Settings(trees=2, depth=2, folds=2)
    tested = model.rank_test(df, ["sim_name", "chain_s1"], s, ("none", "scale"))
    assert all(t.count() == 120 and t.where("cand = 'c0' and p < 0.5").count() == 0 for t in tested.values())
    without = dict(model.ablation(df, {k: v for k, v in config.ABLATIONS.items() if k in ("retrieval", "chain")}, s))
    mean = lambda name, cand: without[name].where(F.col("cand") == cand).agg(F.round(F.avg("p"), 6)).head()[0]
    assert mean("chain", "c0") > 0.6 > mean("chain", "c2") and mean("retrieval", "c0") == mean("retrieval", "c2")  # the similarity told them apart


def test_models_are_saved(spark, tmp_path):
    data = [("us", f"q{k}", "c", 2, float(k % 2), float(k % 2), 1.0) for k in range(40)]
    df = spark.createDataFrame(data, "bc string, s1 string, cand string, cand_src int, y double, x double, w double")
    s = model.Settings(trees=2, depth=2)
    (m,) = model.fit_full(df, ["x"], s)
    model.save(m, str(tmp_path / "m"))
    a, b = (model.predict([x], df, ["x"], s).orderBy("s1").collect() for x in (m, model.load(str(tmp_path / "m"))))
    assert a == b


def test_archive(tmp_path):
    import zipfile

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("a")
    records.make_zip([str(tmp_path / "d")], str(tmp_path / "z.zip"))
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["d/a.txt"]


def test_arrivals_are_linked(spark, sf_dir, tmp_path):
    from kinlink.streaming.incremental import link_arrivals

    every = fixtures.records(spark, sf_dir)
    every.where("src = 1").limit(20).coalesce(1).write.parquet(str(tmp_path / "in"))
    link_arrivals(spark, str(tmp_path / "in"), every.where("src <> 1"), str(tmp_path / "out"), str(tmp_path / "state"), k=5).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.select("s1").distinct().count() == 20 and found.agg(F.max("rank")).head()[0] <= 5


def broadcasts(df):
    """How many joins of a plan send one side to the driver by Spark's estimates."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_term_counts_are_not_broadcast(spark, sf_dir):
    docs = retrieve.documents(norm(spark, sf_dir))
    counts = retrieve.term_counts(docs)
    idf = retrieve.document_frequencies(counts, docs)
    assert broadcasts(retrieve.weighed(counts, idf)) <= broadcasts(idf)


def test_records_truth_and_candidates_are_not_broadcast(spark, sf_dir):
    own, found, weights = norm(spark, sf_dir), kept(spark, sf_dir), post(spark, sf_dir)
    true, ones = fixtures.truth(spark, sf_dir), fixtures.ones(spark, sf_dir)
    base = broadcasts(true)
    sides = features.with_sides(found, own)
    assert broadcasts(sides) == 0
    idf = retrieve.token_idf(own)
    assert broadcasts(features.token_features(sides, idf)) <= broadcasts(idf)
    assert broadcasts(metrics.unique_positives(found.withColumn("view", F.lit("name")), true)) <= base
    missed = metrics.missed_pairs(true, found)
    assert broadcasts(missed) <= base
    bc = own.select(F.col("entity_id").alias("s1"), "bc")
    plain_ = broadcasts(retrieve.pair_cosine(missed.join(bc.hint("merge"), "s1"), weights))
    assert broadcasts(metrics.missed_similarity(missed, own, weights)) <= plain_
    assert broadcasts(metrics.blocking(found, true, ones, 1)) <= 2 * base + broadcasts(ones)


@pytest.fixture()
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "QUERY_DOCS", 3)
    monkeypatch.setattr(tiles, "POOL_DOCS", 4)
    monkeypatch.setattr(tiles, "END_DOCS", 5)


def made_postings(spark):
    """Documents of few tokens, whose cosines tie; one has no token of another, and one is in two sources."""
    rows = [(v, bc, f"{'S1' if n % 3 == 0 else 'S2'}-{n:02}", 1 if n % 3 == 0 else 2, f"t{t}", 0.1 + (n * t) % 4 / 10) for v in retrieve.VIEWS for bc in ("us", "fr") for n in range(40) for t in {n % 5, n % 7, 9 + n % 3}]
    rows += [("name", "us", "S2-alone", 2, "other", 1.0), ("name", "us", "S2-01", 3, "t1", 0.25), ("name", "in", "S1-only", 1, "t1", 1.0), ("name", None, "S1-none", 1, "t1", 1.0)]
    return rows, spark.createDataFrame(rows, "view string, bc string, id string, src int, tok string, w double").withColumn("df", F.lit(2))


def products(rows, left, right):
    out = {}
    for v, bc, i, src, tok, w in rows:
        for v2, bc2, j, src2, tok2, w2 in rows:
            if bc and (v, bc, tok) == (v2, bc2, tok2) and left(src) and right(src2):
                out[v, bc, i, j] = out.get((v, bc, i, j), 0) + w * w2
    return {k: round(x, 6) for k, x in out.items()}


def test_top_k_over_several_tiles(spark, small_tiles):
    rows, post = made_postings(spark)
    sims, want = products(rows, lambda x: x == 1, lambda x: x != 1), []
    for group in {k[:3] for k in sims}:
        best = sorted((-s, k[3]) for k, s in sims.items() if k[:3] == group and s >= 0.1)[:5]
        want += [(*group, c, -s, n) for n, (s, c) in enumerate(best, 1)]
    got = retrieve.top_k(post.where("src = 1"), post.where("src <> 1"), 5, 0.1).collect()
    assert sorted((r.view, r.bc, r.s1, r.cand, round(r.sim, 6), r["rank"]) for r in got) == sorted(want)


def test_pair_cosines_over_several_tiles(spark, small_tiles):
    rows, post = made_postings(spark)
    sims = products(rows, lambda x: x == 1, lambda x: x != 1)
    pairs = [(bc, f"S1-{3 * n:02}", c) for bc in ("us", "fr", "in") for n in range(14) for c in ("S2-01", "S2-alone", "S2-07", "S2-10", "nobody")] + [("us", "nobody", "S2-01")]
    got = retrieve.pair_cosine(spark.createDataFrame(pairs + pairs, "bc string, s1 string, cand string"), post).collect()
    want = [(*p, *(sims.get((v, *p), 0.0) for v in retrieve.VIEWS)) for p in pairs]
    assert sorted((r.bc, r.s1, r.cand, *(round(r[f"sim_{v}"], 6) for v in retrieve.VIEWS)) for r in got) == sorted(want)


def test_candidates_in_portions_are_those_of_all_at_once(spark, monkeypatch):
    _, post = made_postings(spark)
    ours = lambda own: retrieve.prune(retrieve.scored_union(own, 5), 4)
    rows = lambda df: sorted(tuple(r) for r in df.select("bc", "s1", "cand", "prune_rank", "n_retr", *(f"sim_{v}" for v in retrieve.VIEWS)).collect())
    want, taken = rows(ours(post)), []
    monkeypatch.setattr(retrieve, "PORTION", 3)
    before = set(tables._written)
    got = retrieve.in_portions(post, lambda own: (taken.append(own.where("src = 1").select("id").distinct().count()), ours(own))[1])
    assert rows(got) == want and len(taken) > 2 and max(taken) < 16 == sum(taken)
    assert len(set(tables._written) - before) == 1  # what a portion found is gone
    assert tables._written[-1].rsplit("/", 1)[1] in got.inputFiles()[0]
