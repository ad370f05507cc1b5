"""The linkage operators as queries over derived business records, with the equivalent DuckDB SQL.

Keys begin with the operator's inventory row; all have production parameters. Models are fitted with few trees on made-up scores, as
their values cannot be stated in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import kernels
from kinlink.functions import text as T
from kinlink.operators import decide, features, metrics, model, retrieve
from kinlink.plans import cases, jobs
from kinlink.plans import oracle as O
from kinlink.plans.config import input_signature, key_of
from kinlink.plans.oracle import sql
from kinlink.sources import fixtures
from kinlink.sources import records as R
from kinlink.sources.tables import is_table, materialise, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_kept: dict[tuple, DataFrame] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _shared(name: str, make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The frame that make() gives, materialised once for each session and state of the input files: several queries read it."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = input_signature(spark, *(f"{sf_dir}/{t}.parquet" for t in fixtures.TABLES))
        key = (name, spark.sparkContext.applicationId, sf_dir, key_of(inputs))
        if key not in _kept:
            df = make(spark, sf_dir)
            _kept[key] = df if is_table(df) else materialise(df)
        return _kept[key]

    return get


def forget() -> None:
    """Derive shared frames anew from now on."""
    _kept.clear()


norm = _shared("norm", lambda s, d: T.normalise(fixtures.records(s, d)))
post = _shared("post", lambda s, d: retrieve.postings(retrieve.documents(norm(s, d)), O.MAX_DF))
found = _shared("found", lambda s, d: retrieve.in_portions(post(s, d), lambda own: retrieve.found(own, O.K)))
union = _shared("union", lambda s, d: retrieve.in_portions(post(s, d), lambda own: retrieve.scored_union(own, O.K)))
kept = _shared("kept", lambda s, d: retrieve.in_portions(post(s, d), lambda own: retrieve.prune(retrieve.scored_union(own, O.K), O.MAX_K)))
hop = _shared("hop", lambda s, d: retrieve.second_hop(kept(s, d), post(s, d), max_k=O.MAX_K, first_k=O.K))
prepared = _shared("prepared", lambda s, d: decide.prepare(fixtures.scored(s, d)))


def chosen(s: SparkSession, d: str) -> DataFrame:
    return decide.select(prepared(s, d), 0.55, 0.8, 0.75)


def entities(s: SparkSession, d: str) -> DataFrame:
    return decide.entity_f(chosen(s, d), fixtures.truth(s, d), fixtures.ones(s, d)).join(fixtures.ones(s, d), "s1")


def text_of(*columns: str) -> list:
    return [F.array_join(c, " ").alias(c) for c in columns]


# Sources


@query(sql("records", "SELECT src, entity_id, business_name, business_address, country FROM biz"))
def s17_derived_records(s, d):
    return fixtures.records(s, d)


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query(sql("records", "SELECT * FROM biz"))
def s1_s2_load_split(s, d):
    """The records written as the three TSV files of a split and loaded again."""
    folder, every = _folder(s, "split"), fixtures.records(s, d)
    for src in (1, 2, 3):
        R.write_tsv(every.where(F.col("src") == src).select(*R.FIELDS), f"{folder}/train/train_source{src}.tsv")
    return R.load_split(s, folder, "train")


@query(sql("records", "SELECT right(entity_id, 6) AS entity_id, count(*) AS n FROM biz GROUP BY ALL HAVING count(*) > 1"))
def s2_repeated_ids(s, d):
    return R.repeated_ids(fixtures.records(s, d).select(F.expr("right(entity_id, 6)").alias("entity_id")))


@query(sql("norm", "SELECT entity_id, bc, array_to_string(core, ' ') AS name_core FROM norm WHERE src IN (2, 3) AND bc = 'us'"))
def s4_s5_normalised_parquet(s, d):
    folder = _folder(s, "normalised")
    R.write_normalised(norm(s, d), folder)
    return R.load_normalised(s, folder, [2, 3], ["entity_id", "bc", "name_core"], "us").withColumn("name_core", F.array_join("name_core", " "))


@query(sql("records", "SELECT count(*) AS n FROM biz"))
def s8_count_rows(s, d):
    folder = _folder(s, "normalised")
    R.write_normalised(norm(s, d), folder)
    return s.createDataFrame([(R.count_rows(s, folder),)], "n long")


@query(sql("truth", "SELECT o.s1, coalesce(string_agg(t.cand, ',' ORDER BY t.cand), '') AS matched, count(t.cand) AS n FROM ones o LEFT JOIN truth t USING (s1) GROUP BY o.s1"))
def s9_load_truth(s, d):
    """The truth written as a TSV file of lists, with blanks and repeats, and loaded again."""
    path, lists = _folder(s, "truth"), fixtures.truth(s, d).groupBy("s1").agg(F.collect_list("cand").alias("c"))
    R.write_tsv(lists.select(F.col("s1").alias("source1_entity_id"), F.concat(F.array_join("c", " , "), F.lit(",,"), F.element_at("c", 1)).alias("matched_entity_ids")), path)
    return R.load_truth(s, path, fixtures.ones(s, d)).select("s1", F.array_join(F.array_sort("matched"), ",").alias("matched"), F.size("matched").cast("long").alias("n"))


@query(sql("chosen", "SELECT o.s1, coalesce((SELECT string_agg(cand, ',' ORDER BY pa DESC, cand) FROM chosen c WHERE c.s1 = o.s1), '') AS matches, coalesce((SELECT string_agg(cand, ',' ORDER BY p DESC, cand) FROM prepared p WHERE p.s1 = o.s1), '') AS cands FROM ones o"))
def s13_finalise(s, d):
    ones = fixtures.ones(s, d)
    matches, cands = jobs.finalise(fixtures.scored(s, d), ones, (0.55, 0.8, 0.75))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    both = ones.select("s1").join(matches.withColumnRenamed("cands", "m"), "s1", "left").join(cands, "s1", "left")
    return both.select("s1", text("m").alias("matches"), text("cands").alias("cands"))


@query(sql("chosen", "SELECT o.s1 AS source1_entity_id, coalesce(string_agg(c.cand, ',' ORDER BY c.pa DESC, c.cand), '') AS matched_entity_ids FROM ones o LEFT JOIN chosen c USING (s1) GROUP BY o.s1"))
def s10_id_lists(s, d):
    return R.id_lists(decide.to_lists(chosen(s, d)), fixtures.ones(s, d))


@query(sql("truth", "SELECT b.* FROM biz b WHERE entity_id IN (SELECT cand FROM truth)"))
def s6_load_raw(s, d):
    return R.load_raw(fixtures.records(s, d), fixtures.truth(s, d).select(F.col("cand").alias("entity_id")))


@query(sql("chosen", "SELECT o.s1, CASE WHEN o.bc = 'us' THEN '' ELSE coalesce(string_agg(c.cand, ',' ORDER BY c.pa DESC, c.cand), '') END AS ids FROM ones o LEFT JOIN chosen c USING (s1) GROUP BY o.s1, o.bc"))
def s14_blank_country(s, d):
    return metrics.blank_country(decide.to_lists(chosen(s, d)), norm(s, d), "us").select("s1", F.array_join("cands", ",").alias("ids"))


# Text


@query(sql("norm", "SELECT entity_id, bc, bc AS cc FROM norm"))
def t2_t3_countries(s, d):
    return norm(s, d).select("entity_id", "bc", "cc")


@query("SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(strip_accents(p_name || ' & ' || p_brand)), '[^a-z0-9&]+', ' ', 'g')).replace('&', 'and'), ' '), lambda t: t <> ''), ' ') AS tokens FROM part")
def t4_basic_tokens(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", T.basic_tokens(F.concat_ws(" & ", "p_name", "p_brand"), F.lit("us")).alias("tokens"))


for _name, (_make, _oracle) in cases.CASES.items():
    QUERIES[_name], ORACLES[_name] = _make, _oracle


@query(sql("norm", "SELECT entity_id, array_to_string(addr_clean, ' ') AS addr_clean FROM norm"))
def t6_a6_expand_abbreviations(s, d):
    return norm(s, d).select("entity_id", *text_of("addr_clean"))


@query(sql("norm", f"SELECT entity_id, array_to_string({O._pairs('core', False)}, ' ') AS sorted, array_to_string({O._pairs('core', True)}, ' ') AS ordered FROM norm"))
def t9_bigrams(s, d):
    return norm(s, d).select("entity_id", F.array_join(T.bigrams(F.col("name_core"), False), " ").alias("sorted"), F.array_join(T.bigrams(F.col("name_core")), " ").alias("ordered"))


@query(sql("norm", "SELECT entity_id, array_to_string(list_transform(core, lambda t: '~' || t), ' ') AS prefixed, CASE WHEN region = '' THEN '' ELSE array_to_string(list_transform(core, lambda t: t || '@' || region), ' ') END AS tagged, concat_ws(' ', CASE WHEN len(core) >= 2 THEN '=' || core[1] || core[2] END, CASE WHEN len(core) >= 3 THEN '=' || array_to_string(core, '') END, CASE WHEN len(core) = 1 AND len(core[1]) >= 6 THEN '=' || core[1] END) AS joined, array_to_string(flatten(list_transform(house, lambda h: CASE WHEN len(h) >= 4 THEN ['#' || h, '#' || h[1:3]] ELSE ['#' || h] END)), ' ') AS numbers FROM norm"))
def t8_t10_t11_t12_tokens(s, d):
    c = F.col
    parts = {"prefixed": T.prefixed(c("name_core"), "~"), "tagged": T.tagged(c("name_core"), c("region")), "joined": T.run_together(c("name_core")), "numbers": T.number_tokens(c("house_nums"), c("units"))}
    return norm(s, d).select("entity_id", *(F.array_join(v, " ").alias(k) for k, v in parts.items()))


@query(sql("norm", "SELECT entity_id, array_to_string(name_clean, ' ') AS name_clean, array_to_string(core, ' ') AS name_core, array_to_string(legal, ' ') AS legal, array_to_string(skel, ' ') AS name_skel, acr AS name_acr, false AS name_indic, '' AS dba_core, '' AS name_nums FROM norm"))
def n8_normalise_name(s, d):
    return norm(s, d).select("entity_id", *text_of("name_clean", "name_core", "legal", "name_skel", "dba_core", "name_nums"), "name_acr", "name_indic")


@query(sql("norm", "SELECT entity_id, array_to_string(list_sort(list_distinct(flatten(list_transform(legal, lambda t: string_split(CASE t WHEN 'pvt' THEN 'private' WHEN 'ltd' THEN 'limited' WHEN 'inc' THEN 'incorporated' WHEN 'corp' THEN 'corporation' ELSE t END, ' '))))), ' ') AS canon FROM norm"))
def n11_canonical_legal(s, d):
    return norm(s, d).select("entity_id", F.array_join(T.canonical_legal(F.col("legal")), " ").alias("canon"))


@query(sql("norm", "SELECT entity_id, array_to_string(acore, ' ') AS addr_core, array_to_string(house, ' ') AS house_nums, region, '' AS postal, '' AS units, '' AS landmark FROM norm"))
def a9_normalise_address(s, d):
    return norm(s, d).select("entity_id", *text_of("addr_core", "house_nums", "units", "landmark"), "postal", "region")


# Retrieval


@query(sql("docs", "SELECT view, bc, id, src, array_to_string(list_sort(tokens), ' ') AS tokens FROM docs"))
def r1_r3_documents(s, d):
    return retrieve.documents(norm(s, d)).withColumn("tokens", F.array_join(F.array_sort("tokens"), " "))


@query(sql("post", "SELECT view, bc, id, tok, tf FROM counts"))
def r4_term_counts(s, d):
    return retrieve.term_counts(retrieve.documents(norm(s, d))).drop("src")


@query(sql("post", "SELECT view, bc, tok, df, round(idf, 6) AS idf FROM idf"))
def r5_r6_document_frequencies(s, d):
    docs = retrieve.documents(norm(s, d))
    return retrieve.document_frequencies(retrieve.term_counts(docs), docs, O.MAX_DF).withColumn("idf", F.round("idf", 6))


@query(sql("post", "SELECT view, bc, id, src, tok, round(w, 6) AS w FROM post"))
def r7_postings(s, d):
    return post(s, d).withColumn("w", F.round("w", 6)).drop("df")


@query(sql("found", "SELECT view, bc, s1, cand, sim, rank::INT AS rank FROM found"))
def r8_top_k(s, d):
    return found(s, d)


@query(sql("kept", "SELECT bc, s1, cand, sim_name, sim_addr, sim_name_addr FROM joined"))
def r9_pair_cosine(s, d):
    return retrieve.pair_cosine(union(s, d).select("bc", "s1", "cand"), post(s, d))


@query(sql("kept", "SELECT * FROM scores"))
def r10_r11_union(s, d):
    return union(s, d)


@query(sql("kept", "SELECT bc, s1, cand, prune_score, prune_rank::INT AS prune_rank FROM kept"))
def r13_prune(s, d):
    return kept(s, d).select("bc", "s1", "cand", "prune_score", "prune_rank")


@query(sql("kept", "SELECT bc, s1, cand, cast(left(cand, 2)[2:] AS INT) AS cand_src, count(*) OVER (PARTITION BY bc, s1) AS q_union, max(sim_name) OVER (PARTITION BY bc, s1) AS qmax_name, round(max(sim_name) OVER (PARTITION BY bc, s1) - sim_name, 6) AS gap_name, rank() OVER (PARTITION BY bc, s1 ORDER BY sim_name DESC)::INT AS qrank_name, 0 AS q_indic, 0 AS c_indic FROM scores"))
def r12_prune_features(s, d):
    f = retrieve.prune_features(union(s, d), norm(s, d))
    return f.select("bc", "s1", "cand", "cand_src", "q_union", "qmax_name", F.round("gap_name", 6).alias("gap_name"), "qrank_name", "q_indic", "c_indic")


@query(sql("hop", f"SELECT bc, s1, cand, prune_rank::INT AS prune_rank, 0 AS is_hop, 0.0::DOUBLE AS hop_best FROM kept UNION ALL SELECT bc, s1, cand, ({O.MAX_K} + n)::INT, 1, hop_best FROM fresh"))
def r14_second_hop(s, d):
    return retrieve.second_hop(kept(s, d), post(s, d), max_k=O.MAX_K, first_k=O.K).select("bc", "s1", "cand", "prune_rank", "is_hop", "hop_best")


@query(sql("norm", "SELECT bc, tok, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM (SELECT bc, tok, count(*) AS df FROM (SELECT bc, unnest(list_distinct(core)) AS tok FROM norm) GROUP BY ALL) JOIN (SELECT bc, count(*) AS n FROM norm GROUP BY bc) USING (bc)"))
def r15_token_idf(s, d):
    return retrieve.token_idf(norm(s, d)).withColumn("idf", F.round("idf", 6))


@query(sql("norm", "SELECT bc, array_to_string(core, ' ') AS name, count(*) FILTER (src = 1) AS chain_s1, count(*) FILTER (src <> 1) AS chain_pool FROM norm GROUP BY ALL"))
def r16_chains(s, d):
    return retrieve.chains(norm(s, d))


@query(sql("kept_truth", "SELECT k, round(avg((place <= k)::INT::DOUBLE), 6) AS recall FROM (SELECT s1, cand, row_number() OVER (PARTITION BY bc, s1 ORDER BY prune_score DESC, cand) AS place FROM scores) JOIN truth USING (s1, cand), (SELECT unnest([1, 2, 3, 5, 10, 20, 50]) AS k) GROUP BY k"))
def r18_recall_at(s, d):
    return retrieve.recall_at(union(s, d), fixtures.truth(s, d), "prune_score")


# Kernels and features


def _sides(s, d):
    return features.with_sides(kept(s, d), norm(s, d))


_BOTH = """
sides AS (
  SELECT k.bc, k.s1, k.cand, a.core AS ac, b.core AS bcore, array_to_string(a.core, ' ') AS an, array_to_string(b.core, ' ') AS bn, a.legal AS al, b.legal AS bl, a.house AS ah, b.house AS bh,
         array_to_string(a.acore, ' ') AS aa, array_to_string(b.acore, ' ') AS ba, list_distinct(a.acore) AS aset, list_distinct(b.acore) AS bset, a.acr AS aacr, b.acr AS bacr
  FROM kept k JOIN norm a ON a.entity_id = k.s1 JOIN norm b ON b.entity_id = k.cand)
"""
_STATE = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 0 WHEN len({0}) = 0 OR len({1}) = 0 THEN 1 WHEN list_sort({0}) = list_sort({1}) THEN 2 WHEN list_has_any({0}, {1}) THEN 3 ELSE 4 END"


@query(sql("kept", "SELECT bc, s1, cand, CASE WHEN greatest(len(an), len(bn)) = 0 THEN 1 ELSE round(1 - levenshtein(an, bn) / greatest(len(an), len(bn)), 6) END AS n_lev, round(CASE WHEN an = '' AND bn = '' THEN 1 ELSE jaro_winkler_similarity(an, bn) END, 6) AS n_jw FROM sides", _BOTH))
def k5_k6_edit_kernels(s, d):
    f = _sides(s, d).withColumns({"a": T.joined(F.col("a_name_core")), "b": T.joined(F.col("b_name_core"))})
    return f.select("bc", "s1", "cand", F.round(kernels.normalised_levenshtein(F.col("a"), F.col("b")), 6).alias("n_lev"), F.round(kernels.jaro_winkler_similarity("a", "b"), 6).alias("n_jw"))


@query()
def k1_k4_indel_kernels(s, d):
    f = _sides(s, d).withColumns({"a": T.joined(F.col("a_name_core")), "b": T.joined(F.col("b_name_core"))})
    parts = {"n_ratio": kernels.ratio, "n_partial": kernels.partial_ratio, "n_tsort": kernels.token_sort_ratio, "n_tset": kernels.token_set_ratio}
    return f.select("bc", "s1", "cand", *(F.round(k("a", "b"), 6).alias(n) for n, k in parts.items()))


_NATIVE = ["n_lev", "n_first_tok_eq", "n_contain", "n_acronym", "legal_state", "n_len_min", "n_len_diff", "n_tok_diff", "a_jacc", "num_state", "num_jacc", "num_near", "num_min_absdiff", "num_signed_diff", "num_unmatched_b", "a_num1", "b_num1", "a_missing", "a_len_min"]


@query(sql("kept", f"""
SELECT bc, s1, cand, CASE WHEN greatest(len(an), len(bn)) = 0 THEN 1 ELSE round(1 - levenshtein(an, bn) / greatest(len(an), len(bn)), 6) END AS n_lev,
       coalesce(ac[1] = bcore[1], false)::INT::DOUBLE AS n_first_tok_eq, (an <> '' AND bn <> '' AND (contains(bn, an) OR contains(an, bn)))::INT::DOUBLE AS n_contain,
       (aacr <> '' AND (aacr = replace(bn, ' ', '') OR bacr = replace(an, ' ', '')))::INT::DOUBLE AS n_acronym, {_STATE.format('al', 'bl')} AS legal_state,
       least(len(an), len(bn))::INT AS n_len_min, round(abs(len(an) - len(bn)) / greatest(len(an), len(bn), 1), 6) AS n_len_diff, abs(len(ac) - len(bcore))::INT AS n_tok_diff,
       CASE WHEN len(aset) + len(bset) = 0 THEN 0 ELSE round(len(list_intersect(aset, bset)) / len(list_distinct(list_concat(aset, bset))), 6) END AS a_jacc,
       {_STATE.format('ah', 'bh')} AS num_state, CASE WHEN len(ah) + len(bh) = 0 THEN 0 ELSE round(len(list_intersect(ah, bh)) / len(list_distinct(list_concat(ah, bh))), 6) END AS num_jacc,
       CASE WHEN len(ah) = 0 OR len(bh) = 0 THEN -1 WHEN ah[1] = bh[1] THEN 2 WHEN list_contains(list_transform(range(1, len(ah[1]) + 1), lambda i: ah[1][1:i - 1] || ah[1][i + 1:]), bh[1])
         OR list_contains(list_transform(range(1, len(bh[1]) + 1), lambda i: bh[1][1:i - 1] || bh[1][i + 1:]), ah[1]) THEN 1 ELSE 0 END AS num_near,
       CASE WHEN len(ah) > 0 AND len(bh) > 0 THEN round(ln(1 + abs(bh[1]::BIGINT - ah[1]::BIGINT)), 6) END AS num_min_absdiff,
       CASE WHEN len(ah) > 0 AND len(bh) > 0 THEN (bh[1]::BIGINT - ah[1]::BIGINT)::DOUBLE END AS num_signed_diff,
       CASE WHEN len(ah) > 0 AND len(bh) > 0 THEN (ah[1] <> bh[1])::INT::DOUBLE END AS num_unmatched_b, ah[1]::DOUBLE AS a_num1, bh[1]::DOUBLE AS b_num1,
       ((aa = '')::INT + (ba = '')::INT)::INT AS a_missing, least(len(aa), len(ba))::INT AS a_len_min FROM sides""", _BOTH))
def k7_k10_native_pair_features(s, d):
    return features.native_pair_features(_sides(s, d)).select("bc", "s1", "cand", *_NATIVE)


@query(sql("kept", """
SELECT bc, s1, cand, avg(in_both::INT) AS n_jacc, round(coalesce(sum(idf) FILTER (in_both), 0) / sum(idf), 6) AS n_idf_overlap, round(coalesce(max(idf) FILTER (NOT in_both), 0), 6) AS n_max_idf_unshared,
       round(coalesce(max(idf) FILTER (in_both), 0), 6) AS n_max_idf_shared
FROM (SELECT bc, s1, cand, tok, list_contains(ac, tok) AND list_contains(bcore, tok) AS in_both FROM (SELECT *, unnest(list_distinct(list_concat(ac, bcore))) AS tok FROM sides)) JOIN names USING (bc, tok) GROUP BY ALL
""", _BOTH, "names AS (SELECT bc, tok, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT bc, tok, count(*) AS df FROM (SELECT bc, unnest(list_distinct(core)) AS tok FROM norm) GROUP BY ALL) JOIN (SELECT bc, count(*) AS n FROM norm GROUP BY bc) USING (bc))"))
def k11_token_features(s, d):
    f = features.token_features(_sides(s, d), retrieve.token_idf(norm(s, d)))
    return f.withColumns({c: F.round(c, 6) for c in ("n_max_idf_unshared", "n_max_idf_shared")})


@query(sql("kept", """
SELECT k.bc, k.s1, k.cand, CASE WHEN p.cand <> k.cand THEN coalesce(c.sim, 0) END AS sib1_name_addr, CASE WHEN p.cand <> k.cand THEN coalesce(n.sim, 0) END AS sib1_name
FROM kept k LEFT JOIN kept p ON p.bc = k.bc AND p.s1 = k.s1 AND p.prune_rank = 1
LEFT JOIN twins c ON c.view = 'name_addr' AND c.a = k.cand AND c.b = p.cand LEFT JOIN twins n ON n.view = 'name' AND n.a = k.cand AND n.b = p.cand
""", "wanted AS (SELECT DISTINCT k.bc, k.cand AS a, p.cand AS b FROM kept k JOIN kept p ON p.bc = k.bc AND p.s1 = k.s1 AND p.prune_rank = 1)", "twins AS (SELECT x.view, w.a, w.b, round(sum(x.w * y.w), 6) AS sim FROM wanted w JOIN post x ON x.id = w.a AND x.bc = w.bc JOIN post y ON y.view = x.view AND y.bc = x.bc AND y.tok = x.tok AND y.id = w.b GROUP BY ALL)"))
def sibling_features(s, d):
    return features.sibling_features(kept(s, d), post(s, d)).select("bc", "s1", "cand", "sib1_name_addr", "sib1_name")


_MADE_SETS = ("CAST(floor(100 * sim_name) AS DOUBLE) AS n_tset", "CASE WHEN sim_addr = 0 THEN NULL ELSE CAST(floor(100 * sim_addr) AS DOUBLE) END AS a_tset")


def _competition(prefix: str, group: str, columns: tuple[str, ...]) -> str:
    """SQL of the ranks and gaps within a group."""
    parts = [f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {group} ORDER BY {x} DESC NULLS LAST) END::INT AS {prefix}_rank_{x}, round(max({x}) OVER (PARTITION BY {group}) - {x}, 6) AS {prefix}_gap_{x}" for x in columns]
    return ", ".join(parts)


@query(sql("kept", f"""
SELECT bc, s1, cand, {_competition('ctx', 'bc, s1', ('sim_name', 'sim_addr', 'prune_score', 'n_tset', 'a_tset'))}, {_competition('rev', 'bc, cand', ('prune_score', 'sim_name_addr', 'n_tset', 'a_tset'))},
       count(*) OVER (PARTITION BY bc, s1) AS ctx_n_cands, count(*) OVER (PARTITION BY bc, s1, left(cand, 2)) AS ctx_src_count, count(*) FILTER (n_tset >= 90) OVER (PARTITION BY bc, s1) AS ctx_n_hi_name,
       count(*) OVER (PARTITION BY bc, cand) AS rev_n_s1
FROM (SELECT *, {', '.join(_MADE_SETS)} FROM kept)"""))
def context_features(s, d):
    """All 22 columns; the token-set ratios are made of the cosines, so that SQL has them too."""
    rows = kept(s, d).selectExpr("bc", "s1", "cand", "cast(substring(cand, 2, 1) as int) AS cand_src", "sim_name", "sim_addr", "sim_name_addr", "prune_score", *_MADE_SETS)
    out = features.context_features(rows)
    return out.select("bc", "s1", "cand", *(c for c in out.columns if c.startswith(("ctx_", "rev_"))))


_MADE = {
    "n_tset": "CAST(60 + (ks * 7 + kc * 3) % 41 AS DOUBLE)",
    "sib1_name_addr": "CASE WHEN (ks + kc) % 5 = 0 THEN NULL ELSE CAST((ks * kc) % 100 AS DOUBLE) / 100 END",
    "b_num1": "CASE WHEN kc % 7 = 0 THEN NULL ELSE CAST(kc % 9 AS DOUBLE) END",
    "a_num1": "CASE WHEN ks % 6 = 0 THEN NULL ELSE CAST(ks % 9 AS DOUBLE) END",
    "b_legal_code": "CASE WHEN kc % 4 = 0 THEN NULL ELSE CAST(kc % 3 AS DOUBLE) END",
}
_MADE |= {c: f"CAST((ks + {i} * kc) % 10 AS DOUBLE)" for i, c in enumerate(features.CARRIED) if c not in _MADE and c != "cand_src"}
_RICH = f"""
rich AS (SELECT s1, cand, cand_src, p, {', '.join(f'{v} AS {k}' for k, v in _MADE.items())} FROM (SELECT *, CAST(right(s1, 6) AS BIGINT) AS ks, CAST(right(cand, 6) AS BIGINT) AS kc FROM scored)),
num AS (SELECT s1, v, n FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY n DESC, v) AS r FROM (SELECT s1, b_num1 AS v, count(*) AS n FROM rich WHERE p >= 0.9 AND b_num1 IS NOT NULL GROUP BY ALL)) WHERE r = 1),
form AS (SELECT s1, v, n FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY n DESC, v) AS r FROM (SELECT s1, b_legal_code AS v, count(*) AS n FROM rich WHERE p >= 0.9 AND b_legal_code IS NOT NULL GROUP BY ALL)) WHERE r = 1),
ranked AS (
  SELECT *, max(p) OVER (PARTITION BY s1) AS ms, max(p) OVER (PARTITION BY cand) AS mc, row_number() OVER (PARTITION BY s1, cand_src ORDER BY p DESC, cand) AS nth,
         count(*) FILTER (p >= 0.5 AND cand_src = 2) OVER (PARTITION BY s1) AS strong2, count(*) FILTER (p >= 0.5 AND cand_src = 3) OVER (PARTITION BY s1) AS strong3 FROM rich),
rivals AS (SELECT *, CASE WHEN p >= mc THEN coalesce(max(p) FILTER (p < mc) OVER (PARTITION BY cand), 0) ELSE mc END AS c_other_best, CASE WHEN cand_src = 2 THEN strong2 ELSE strong3 END AS own_src_strong FROM ranked)
"""
_AGREES = "CASE WHEN {0} IS NULL OR {1} IS NULL THEN -1.0::DOUBLE ELSE ({0} = {1})::INT::DOUBLE END"


@query(sql("scored", f"""
SELECT r.s1, r.cand, p AS p1, rank() OVER (PARTITION BY r.s1 ORDER BY p DESC)::INT AS s_rank, round(ms - p, 6) AS s_gap_top, ms AS s_top, round(sum(p) OVER s, 6) AS s_sum,
       count(*) FILTER (p > 0.5) OVER s AS s_n_hi, count(*) OVER s AS s_n, coalesce(max(p) FILTER (p < ms) OVER s, 0) AS s_second, CASE WHEN p >= ms THEN coalesce(max(p) FILTER (p < ms) OVER s, 0) ELSE ms END AS s_other_best,
       rank() OVER (PARTITION BY r.cand ORDER BY p DESC)::INT AS c_rank, c_other_best, round(p - c_other_best, 6) AS c_margin, count(*) OVER (PARTITION BY r.cand) AS c_n,
       rank() OVER (PARTITION BY r.s1, cand_src ORDER BY p DESC)::INT AS ss_rank, strong2 AS s_n_strong_s2, strong3 AS s_n_strong_s3, own_src_strong, strong2 + strong3 - own_src_strong AS other_src_strong,
       (nth = 1 AND own_src_strong = 0)::INT::DOUBLE AS best_in_empty_src, max(p) OVER (PARTITION BY r.s1, cand_src) AS p_best_in_src,
       round(n_tset - coalesce((SELECT max(o.n_tset) FROM rich o WHERE o.cand = r.cand AND o.s1 <> r.s1), 0), 6) AS name_rival_margin, round(coalesce(sib1_name_addr, 0) * ms, 6) AS sib_top_support,
       {_AGREES.format('b_num1', 'num.v')} AS cons_num_eq, coalesce(num.n, 0) AS cons_num_n, b_num1 - num.v AS cons_num_diff, {_AGREES.format('a_num1', 'num.v')} AS cons_num_vs_s1,
       {_AGREES.format('b_legal_code', 'form.v')} AS cons_legal_eq, coalesce(form.n, 0) AS cons_legal_n, {', '.join(f'r.{c} AS x_{c}' for c in features.CARRIED)}
FROM rivals r LEFT JOIN num ON num.s1 = r.s1 LEFT JOIN form ON form.s1 = r.s1 WINDOW s AS (PARTITION BY r.s1)""", _RICH))
def stage2_features(s, d):
    """All 50 columns, over made-up scores and carried columns."""
    k = fixtures.scored(s, d).withColumns({"ks": F.expr("cast(right(s1, 6) as bigint)"), "kc": F.expr("cast(right(cand, 6) as bigint)")})
    return features.stage2_features(k.withColumns({c: F.expr(v) for c, v in _MADE.items()}).drop("ks", "kc"), "p")


@query()
def all_pair_features(s, d):
    return features.features(hop(s, d), norm(s, d), post(s, d))


# Decisions


@query(sql("prepared", "SELECT s1, cand, cand_src, p, pa, place::INT AS place, top_p, is_top, coalesce(is_other_best, false) AS is_other_best FROM prepared"))
def d1_prepare(s, d):
    return prepared(s, d)


@query(sql("chosen", "SELECT s1, cand, pa FROM chosen"))
def d2_select(s, d):
    return chosen(s, d).select("s1", "cand", "pa")


@query(sql("prepared", """
SELECT s1, cand, pa FROM (SELECT *, max(v) OVER (PARTITION BY s1) AS best FROM (
  SELECT *, round(1.25::DOUBLE * sum(pa) OVER (PARTITION BY s1 ORDER BY place) / (0.25::DOUBLE * sum(pa) OVER (PARTITION BY s1) + place), 12) AS v,
         exp(sum(ln(1 - least(pa, 1 - 1e-9))) OVER (PARTITION BY s1)) AS nothing FROM prepared)) x
WHERE place <= (SELECT min(place) FROM (SELECT s1 AS q, place, round(1.25::DOUBLE * sum(pa) OVER (PARTITION BY s1 ORDER BY place) / (0.25::DOUBLE * sum(pa) OVER (PARTITION BY s1) + place), 12) AS v FROM prepared) y WHERE y.q = x.s1 AND y.v = x.best)
  AND best > nothing AND pa > 0"""))
def d3_select_expected_f(s, d):
    return decide.select_expected_f(prepared(s, d)).select("s1", "cand", "pa")


@query(sql("chosen", "SELECT s1, string_agg(cand, ',' ORDER BY pa DESC, cand) AS cands FROM chosen GROUP BY s1"))
def d4_to_lists(s, d):
    return decide.to_lists(chosen(s, d)).select("s1", F.array_join("cands", ",").alias("cands"))


_FIRST, _OTHER, _EXTRA = decide.steps(0.3, 0.7, 0.2), decide.steps(0.5, 0.8, 0.15), decide.steps(0.6, 0.9, 0.15)
_GRID = f"""
grid AS (
  SELECT i, j, k, t1, t2, t3 FROM (SELECT unnest(range({len(_FIRST)})) AS i, unnest({_FIRST})::DOUBLE AS t1), (SELECT unnest(range({len(_OTHER)})) AS j, unnest({_OTHER})::DOUBLE AS t2), (SELECT unnest(range({len(_EXTRA)})) AS k, unnest({_EXTRA})::DOUBLE AS t3)),
tried AS (
  SELECT i, j, k, s1, count(*) AS n_pred, count(t.cand) AS tp FROM grid CROSS JOIN prepared p LEFT JOIN truth t USING (s1, cand)
  WHERE top_p >= t1 AND pa > 0 AND (is_top OR (is_other_best AND pa >= t2) OR pa >= t3) GROUP BY ALL),
full_grid AS (
  SELECT i, j, k, t1, t2, t3, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_truth, 0) AS n_truth FROM grid CROSS JOIN ones LEFT JOIN tried USING (i, j, k, s1)
  LEFT JOIN (SELECT s1, count(*) AS n_truth FROM truth GROUP BY s1) USING (s1)),
curve AS (
  SELECT i, j, k, t1, t2, t3, round(avg(CASE WHEN n_pred = 0 AND n_truth = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * (tp / n_pred) * (tp / n_truth) / (0.25::DOUBLE * (tp / n_pred) + tp / n_truth) END), 9) AS score
  FROM full_grid GROUP BY ALL),
around AS (
  SELECT c.i, c.j, c.k, avg(n.score) AS smoothed FROM curve c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS a) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS b) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS e)
  JOIN curve n ON n.i = greatest(0, least({len(_FIRST) - 1}, c.i + a)) AND n.j = greatest(0, least({len(_OTHER) - 1}, c.j + b)) AND n.k = greatest(0, least({len(_EXTRA) - 1}, c.k + e)) GROUP BY ALL)
"""


@query(sql("prepared", "SELECT t1 AS t_first, t2 AS t_other, t3 AS t_extra, round(score, 6) AS score, round(smoothed, 6) AS smoothed FROM curve JOIN around USING (i, j, k)", _GRID))
def d6_grid_search(s, d):
    c = decide.grid_search(prepared(s, d), fixtures.truth(s, d), fixtures.ones(s, d), _FIRST, _OTHER, _EXTRA)
    return c.select("t_first", "t_other", "t_extra", F.round("score", 6).alias("score"), F.round("smoothed", 6).alias("smoothed"))


@query(sql("norm", "SELECT entity_id, bc, round((rank() OVER (PARTITION BY bc ORDER BY n) + (count(*) OVER (PARTITION BY bc, n) - 1) / 2) / count(*) OVER (PARTITION BY bc), 9) AS n FROM (SELECT entity_id, bc, len(business_name) AS n FROM norm)"))
def d10_percentile_rank(s, d):
    return model.rank_normalise(norm(s, d).select("entity_id", "bc", F.length("business_name").alias("n")), ["n"])


@query()
def d11_sample_regions(s, d):
    rows = norm(s, d).where("src = 1").select(F.col("entity_id").alias("s1"), "bc", "region")
    return model.sample_regions(rows, rows.count() // 3)


@query()
def d12_sample_queries(s, d):
    return model.sample_queries(fixtures.ones(s, d), 100)


_BROKEN = """
broken AS (
  SELECT s1, cand FROM chosen UNION ALL SELECT s1, cand FROM chosen WHERE s1 LIKE '%3' UNION ALL SELECT s1, concat('X', s1) FROM ones WHERE s1 LIKE '%7'
  UNION ALL SELECT concat('Q', s1), cand FROM chosen WHERE s1 LIKE '%5')
"""


@query(sql("chosen", "SELECT rule, n FROM (SELECT 'repeated_id' AS rule, count(*) AS n FROM (SELECT 1 FROM broken GROUP BY s1, cand HAVING count(*) > 1) UNION ALL SELECT 'wrong_source', count(*) FROM broken WHERE NOT regexp_matches(cand, '^S[23]-') UNION ALL SELECT 'not_a_candidate', count(*) FROM broken c WHERE NOT EXISTS (SELECT 1 FROM prepared p WHERE p.s1 = c.s1 AND p.cand = c.cand) UNION ALL SELECT 'unknown_query', count(*) FROM broken WHERE s1 NOT IN (SELECT s1 FROM ones))", _BROKEN))
def d14_self_check(s, d):
    """Lists that break every rule."""
    own, ones = chosen(s, d).select("s1", "cand"), fixtures.ones(s, d)
    more = [own.where("s1 like '%3'"), ones.where("s1 like '%7'").select("s1", F.concat(F.lit("X"), "s1").alias("cand")), own.where("s1 like '%5'").select(F.concat(F.lit("Q"), "s1").alias("s1"), "cand")]
    for part in more:
        own = own.unionByName(part)
    return metrics.self_check(own.groupBy("s1").agg(F.collect_list("cand").alias("cands")), decide.to_lists(prepared(s, d)), ones)


@query(sql("kept_truth", "SELECT s1, cand FROM truth t WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.s1 = t.s1 AND k.cand = t.cand)"))
def d16_missed_pairs(s, d):
    return metrics.missed_pairs(fixtures.truth(s, d), kept(s, d))


# Metrics


@query(sql("chosen", "SELECT s1, bc, n_pred, n_truth, tp, round(f, 6) AS f FROM entities"))
def g1_entity_f(s, d):
    return entities(s, d).withColumn("f", F.round("f", 6))


@query(sql("chosen", "SELECT round(avg(f), 6) AS macro_f FROM entities"))
def g2_macro_f(s, d):
    return decide.macro_f(entities(s, d))


@query(sql("chosen", "SELECT round(sum(w * f) / sum(w), 6) AS macro_f FROM (SELECT f, CASE WHEN n_truth = 0 THEN 0.1::DOUBLE / greatest(avg((n_truth = 0)::INT) OVER (), 1e-9) ELSE 0.9::DOUBLE / greatest(1 - avg((n_truth = 0)::INT) OVER (), 1e-9) END AS w FROM entities)"))
def d5_reweighted_macro_f(s, d):
    return decide.macro_f(entities(s, d), 0.1)


@query(sql("chosen", "SELECT bc, count(*) AS n, round(avg(f), 6) AS macro_f, round(avg((n_truth = 0)::INT), 6) AS singleton_rate, sum(n_pred)::BIGINT AS n_pred_matches, count(*) FILTER (n_pred = 0) AS n_pred_singletons, round(avg(f) FILTER (n_truth = 0), 6) AS singleton_acc, round(avg(f) FILTER (n_truth > 0), 6) AS matched_f, round(avg(f) FILTER (n_truth = 1), 6) AS f_one, round(avg(f) FILTER (n_truth > 1), 6) AS f_multi, round(sum(tp) / greatest(sum(n_pred), 1), 6) AS pair_precision, round(sum(tp) / greatest(sum(n_truth), 1), 6) AS pair_recall FROM entities GROUP BY ROLLUP (bc)"))
def g3_breakdown(s, d):
    return metrics.breakdown(entities(s, d))


@query(sql("chosen", "SELECT count(*) AS n, round(avg(d), 6) AS delta, round(stddev_samp(d) / sqrt(count(*)), 6) AS se FROM (SELECT f - CASE WHEN n_truth = 0 THEN 1 ELSE 0 END AS d FROM entities)"))
def g4_paired_delta(s, d):
    e = entities(s, d)
    nothing = e.select("s1", (F.col("n_truth") == 0).cast("double").alias("f"))
    return metrics.paired_delta(e, nothing)


_HIT = """
per AS (
  SELECT o.s1, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(n_truth, 0) AS n_truth FROM ones o LEFT JOIN (SELECT k.s1, count(*) AS n, count(t.cand) AS tp FROM kept k LEFT JOIN truth t USING (s1, cand) GROUP BY k.s1) USING (s1)
  LEFT JOIN (SELECT s1, count(*) AS n_truth FROM truth GROUP BY s1) USING (s1))
"""


@query(sql("kept_truth", "SELECT round(sum(tp) / sum(n_truth), 6) AS pair_recall, round(avg(CASE WHEN tp = 0 AND n_truth = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * (tp / n_truth) / (0.25::DOUBLE + tp / n_truth) END), 6) AS ceiling, round(avg(n), 6) AS cand_mean, round(quantile_cont(n, 0.5), 6)::DOUBLE AS cand_median, round(quantile_cont(n, 0.95), 6)::DOUBLE AS cand_p95, max(n) AS cand_max, round(avg((n = 0)::INT), 6) AS zero_share, round(1 - sum(n) / (count(*)::DOUBLE * (SELECT count(*) FROM norm WHERE src <> 1)), 6) AS reduction FROM per", _HIT))
def g5_blocking(s, d):
    return metrics.blocking(kept(s, d), fixtures.truth(s, d), fixtures.ones(s, d), norm(s, d).where("src <> 1").count())


@query(sql("scored", "SELECT bin::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(abs(round(avg(p), 6) - round(avg(y), 6)), 6) AS gap FROM (SELECT p, (t.cand IS NOT NULL)::INT::DOUBLE AS y, list_sum(list_transform([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: (p >= e)::INT)) AS bin FROM scored LEFT JOIN truth t USING (s1, cand)) GROUP BY bin"))
def g6_reliability(s, d):
    return metrics.reliability(model.label(fixtures.scored(s, d), fixtures.truth(s, d)))


@query(sql("kept_truth", "SELECT view, count(*) AS n FROM (SELECT s1, cand, min(view) AS view FROM found JOIN truth USING (s1, cand) WHERE sim >= 0.6 GROUP BY s1, cand HAVING count(*) = 1) GROUP BY view"))
def g7_unique_positives(s, d):
    """Of the hits with a cosine of 0.6 or more; with less, several views find every pair."""
    return metrics.unique_positives(found(s, d).where("sim >= 0.6"), fixtures.truth(s, d))


_BUCKETS = """
flags AS (SELECT p.s1, p.cand, p.pa, p.is_top, t.cand IS NOT NULL AS is_true, c.cand IS NOT NULL AS is_pred FROM prepared p LEFT JOIN truth t USING (s1, cand) LEFT JOIN chosen c USING (s1, cand)),
own AS (SELECT s1, count(*) AS n_cands, count(*) FILTER (is_true) AS n_found, count(*) FILTER (is_pred) AS n_pred, count(*) FILTER (is_true AND is_pred) AS tp, max(cand) FILTER (is_top) AS top_cand, max(pa) FILTER (is_top) AS top_p, max(is_true::INT) FILTER (is_top) AS top_true FROM flags GROUP BY s1),
outcome AS (
  SELECT o.s1, CASE WHEN e.n_truth = 0 AND e.n_pred = 0 THEN 'ok_singleton' WHEN e.n_truth = 0 THEN 'E1_singleton_merged' WHEN coalesce(n_found, 0) = 0 THEN 'E6_all_true_blocked' WHEN e.n_pred = 0 AND top_true = 1 THEN 'E3_abstained_top_correct'
         WHEN e.n_pred = 0 THEN 'E3b_abstained_top_wrong' WHEN e.tp = 0 THEN 'E2_wrong_match' WHEN e.n_pred > e.tp THEN 'E4_extra_wrong' WHEN e.tp < e.n_truth AND n_found < e.n_truth THEN 'E6b_partly_blocked' WHEN e.tp < e.n_truth THEN 'E5_missed_extra' ELSE 'ok' END AS bucket,
         round(e.f, 6) AS f, e.n_truth, e.n_pred, coalesce(n_cands, 0) AS n_cands, coalesce(top_cand, '') AS top_cand, coalesce(top_p, 0) AS top_p,
         coalesce(x.ids, '') AS truth, coalesce(c.ids, '') AS pred
  FROM ones o JOIN entities e USING (s1) LEFT JOIN own USING (s1)
  LEFT JOIN (SELECT s1, string_agg(cand, ',' ORDER BY cand) AS ids FROM truth GROUP BY s1) x USING (s1)
  LEFT JOIN (SELECT s1, string_agg(cand, ',' ORDER BY cand) AS ids FROM chosen GROUP BY s1) c USING (s1))
"""


def buckets(s, d):
    return metrics.error_buckets(prepared(s, d), chosen(s, d), fixtures.truth(s, d), fixtures.ones(s, d))


@query(sql("chosen", "SELECT * FROM outcome", _BUCKETS))
def g8_error_buckets(s, d):
    return buckets(s, d)


@query(sql("chosen", "SELECT bucket, n, loss, CASE WHEN sum(loss) OVER () = 0 THEN 0 ELSE round(loss / sum(loss) OVER (), 6) END AS loss_share FROM (SELECT bucket, count(*) AS n, round(sum(1 - f), 6) AS loss FROM outcome GROUP BY bucket)", _BUCKETS))
def g8_bucket_summary(s, d):
    return metrics.bucket_summary(buckets(s, d))


@query(sql("chosen", """
SELECT kind, x.s1, x.cand, pa, a.business_name AS s1_name, a.business_address AS s1_addr, b.business_name AS c_name, b.business_address AS c_addr, a.country FROM (
  SELECT 'FP' AS kind, s1, cand, pa FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1 = c.s1 AND t.cand = c.cand)
  UNION ALL SELECT 'FN_scored', s1, cand, pa FROM prepared p WHERE EXISTS (SELECT 1 FROM truth t WHERE t.s1 = p.s1 AND t.cand = p.cand) AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.s1 = p.s1 AND c.cand = p.cand)
  UNION ALL SELECT 'FN_blocked', s1, cand, NULL FROM truth t WHERE NOT EXISTS (SELECT 1 FROM prepared p WHERE p.s1 = t.s1 AND p.cand = t.cand)) x
LEFT JOIN biz a ON a.entity_id = x.s1 LEFT JOIN biz b ON b.entity_id = x.cand"""))
def g9_pair_dump(s, d):
    return metrics.pair_dump(chosen(s, d), prepared(s, d), fixtures.truth(s, d), fixtures.records(s, d))


@query(sql("norm", "SELECT bc, src, count(*) AS n, round(avg((business_address = '')::INT), 6) AS empty_addr, round(avg((business_name = '')::INT), 6) AS empty_name, 0.0::DOUBLE AS with_postal, 0.0::DOUBLE AS with_landmark, 0.0::DOUBLE AS non_ascii, round(avg(again::INT), 6) AS repeated_name FROM (SELECT *, count(*) OVER (PARTITION BY bc, src, core) > 1 AS again FROM norm) GROUP BY bc, src"))
def g10_audit(s, d):
    return metrics.audit(norm(s, d))


@query(sql("truth", "SELECT n_s2, n_s3, count(*) AS n FROM (SELECT o.s1, count(*) FILTER (starts_with(cand, 'S2-')) AS n_s2, count(*) FILTER (starts_with(cand, 'S3-')) AS n_s3 FROM ones o LEFT JOIN truth USING (s1) GROUP BY o.s1) GROUP BY ALL"))
def g10_truth_shapes(s, d):
    return metrics.truth_shapes(fixtures.truth(s, d), fixtures.ones(s, d))


@query(sql("norm_truth", "SELECT round(avg((a.bc = b.bc)::INT), 6) AS same_country, NULL::DOUBLE AS same_postal, (SELECT round(1 - count(*) FILTER (entity_id IN (SELECT cand FROM truth)) / count(*), 6) FROM norm WHERE src <> 1) AS unmatched_pool FROM truth t JOIN norm a ON a.entity_id = t.s1 JOIN norm b ON b.entity_id = t.cand"))
def g10_truth_agreement(s, d):
    return metrics.truth_agreement(fixtures.truth(s, d), norm(s, d))


@query(sql("prepared", "SELECT cand, count(*) AS n FROM prepared WHERE pa > 0 GROUP BY cand HAVING count(*) > 1"))
def g10_one_to_one(s, d):
    """Candidates that several queries own: exact ties."""
    return metrics.contested(prepared(s, d).where("pa > 0"))


@query(sql("truth", "SELECT n_truth, count(*) AS n FROM (SELECT o.s1, count(cand) AS n_truth FROM ones o LEFT JOIN truth USING (s1) GROUP BY o.s1) GROUP BY ALL"))
def g10_truth_sizes(s, d):
    return metrics.truth_sizes(fixtures.truth(s, d), fixtures.ones(s, d))


@query("SELECT array_to_string(list_filter(string_split(lower(p_name), ' '), lambda t: t <> ''), ' ') AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 15")
def g13_top_names(s, d):
    return metrics.top_names(s.read.parquet(f"{d}/part.parquet").select(F.split(F.lower("p_name"), " ").alias("name_core")))


_DENSITY = """
amb AS (SELECT bc, s1, least(count(*) FILTER (p > 0.1 AND p < 0.9), 4) AS b FROM scored JOIN ones USING (s1) GROUP BY ALL),
half AS (SELECT bc, s1, least(count(*) FILTER (p * 0.8::DOUBLE > 0.1 AND p * 0.8::DOUBLE < 0.9), 4) AS b FROM scored JOIN ones USING (s1) GROUP BY ALL),
here AS (SELECT bc, b, count(*) / sum(count(*)) OVER (PARTITION BY bc) AS p FROM amb GROUP BY bc, b), there AS (SELECT bc, b, count(*) / sum(count(*)) OVER (PARTITION BY bc) AS p FROM half GROUP BY bc, b),
weighed AS (SELECT a.s1, greatest(0.5::DOUBLE, least(coalesce(t.p, 0) / h.p, 4.0::DOUBLE)) AS r FROM amb a JOIN here h USING (bc, b) LEFT JOIN there t USING (bc, b))
"""


@query(sql("scored", "SELECT s1, round(r / avg(r) OVER (), 6) AS w FROM weighed", _DENSITY))
def g11_density_weights(s, d):
    train = fixtures.scored(s, d).join(fixtures.ones(s, d), "s1")
    return metrics.density_weights(train.withColumn("p", F.col("p") * 0.8), train)


@query(sql("chosen", "SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6)::DOUBLE AS p95 FROM (SELECT count(*) AS n FROM chosen GROUP BY s1)"))
def g12_sizes(s, d):
    return metrics.sizes(decide.to_lists(chosen(s, d)), "cands")


@query(sql("norm", "SELECT bc, region, count(*) AS n, (sum(count(*)) OVER (PARTITION BY bc ORDER BY region))::BIGINT AS cumulative FROM norm WHERE src = 1 GROUP BY bc, region"))
def g14_running_total(s, d):
    return metrics.running_total(norm(s, d))


_OTHER_RULE = (0.7, 0.6, 0.9)


@query(sql("chosen", "SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.loss, 0) AS loss_a, coalesce(b.loss, 0) AS loss_b, round(coalesce(b.loss, 0) - coalesce(a.loss, 0), 6) AS delta FROM (SELECT bucket, count(*) AS n, round(sum(1 - f), 6) AS loss FROM outcome GROUP BY bucket) a FULL JOIN (SELECT bucket, count(*) AS n, round(sum(1 - f), 6) AS loss FROM outcome2 GROUP BY bucket) b USING (bucket)", _BUCKETS, O.again(O.CHOSEN, _OTHER_RULE), O.again(_BUCKETS, _OTHER_RULE)))
def d15_compare(s, d):
    other = decide.select(prepared(s, d), *_OTHER_RULE)
    return metrics.compare(buckets(s, d), metrics.error_buckets(prepared(s, d), other, fixtures.truth(s, d), fixtures.ones(s, d)))


@query(sql("kept_truth", "SELECT view, count(*) AS n, round(quantile_cont(sim, 0.1), 6)::DOUBLE AS q10, round(quantile_cont(sim, 0.5), 6)::DOUBLE AS q50, round(quantile_cont(sim, 0.9), 6)::DOUBLE AS q90 FROM (SELECT v.view, t.s1, t.cand, coalesce((SELECT round(sum(x.w * y.w), 6) FROM post x JOIN post y ON x.view = y.view AND x.bc = y.bc AND x.tok = y.tok WHERE x.view = v.view AND x.id = t.s1 AND y.id = t.cand), 0) AS sim FROM (SELECT * FROM truth t WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.s1 = t.s1 AND k.cand = t.cand)) t CROSS JOIN (SELECT unnest(['name', 'addr', 'name_addr']) AS view) v) GROUP BY view"))
def d16_missed_similarity(s, d):
    return metrics.missed_similarity(metrics.missed_pairs(fixtures.truth(s, d), kept(s, d)), norm(s, d), post(s, d))


@query(sql("scored", "SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM (SELECT bin, count(*) AS n, round(abs(round(avg(p), 6) - round(avg(y), 6)), 6) AS gap FROM (SELECT p, (t.cand IS NOT NULL)::INT::DOUBLE AS y, list_sum(list_transform([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: (p >= e)::INT)) AS bin FROM scored LEFT JOIN truth t USING (s1, cand)) GROUP BY bin)"))
def g6_calibration_error(s, d):
    return metrics.expected_calibration_error(model.label(fixtures.scored(s, d), fixtures.truth(s, d)))


@query(sql("scored", "SELECT s1, cand, (t.cand IS NOT NULL)::INT::DOUBLE AS y, coalesce(w.w, 1.0::DOUBLE) AS w FROM scored LEFT JOIN truth t USING (s1, cand) LEFT JOIN (SELECT s1, 2.5::DOUBLE AS w FROM ones WHERE bc = 'us') w USING (s1)"))
def d9_entity_weights(s, d):
    w = fixtures.ones(s, d).where("bc = 'us'").select("s1", F.lit(2.5).alias("w"))
    return model.entity_weights(model.label(fixtures.scored(s, d), fixtures.truth(s, d)), w).select("s1", "cand", "y", "w")


def _learnable(s, d) -> DataFrame:
    """Pairs with made-up scores as a feature, and what is true of them."""
    rows = model.label(fixtures.scored(s, d), fixtures.truth(s, d)).join(fixtures.ones(s, d), "s1")
    return materialise(model.entity_weights(rows.withColumnRenamed("p", "n_ratio"), None))


_QUICK = model.Settings(trees=4, depth=3, folds=2, seeds=(42, 7))


@query()
def d7_out_of_fold(s, d):
    rows = _learnable(s, d)
    return model.out_of_fold(rows, model.feature_columns(rows), _QUICK)


@query()
def d8_fit_full(s, d):
    rows = _learnable(s, d)
    columns = model.feature_columns(rows)
    return model.predict(model.fit_full(rows, columns, _QUICK), rows, columns, _QUICK)


@query()
def d13_leave_one_out(s, d):
    rows = _learnable(s, d)
    return model.leave_one_out(rows, model.feature_columns(rows), model.Settings(trees=3, depth=3))
