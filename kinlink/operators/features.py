"""Pair, sibling, competition and neighbourhood features of candidates.

Missing values are NULL, never NaN, so that max and rank leave them out; -1 stands where a rule gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import kernels as K
from kinlink.functions import text as T
from kinlink.operators.retrieve import VIEWS, chains, large, pair_cosine, token_idf
from kinlink.sources.tables import materialise

COLUMNS = ["name_core", "legal", "dba_core", "name_skel", "name_nums", "name_acr", "name_indic", "addr_core", "postal", "house_nums", "units", "landmark"]


def with_sides(pairs: DataFrame, records: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """pairs (bc, s1, cand, ...) with the records' columns as a_* (query) and b_* (candidate), cand_src, and columns `own` of the query."""
    a = records.select(F.col("entity_id").alias("s1"), *(F.col(c).alias(f"a_{c}") for c in COLUMNS), *own)
    b = records.select(F.col("entity_id").alias("cand"), F.col("src").alias("cand_src"), *(F.col(c).alias(f"b_{c}") for c in COLUMNS))
    return pairs.join(large(a), "s1").join(large(b), "cand")


def token_features(pairs: DataFrame, idf: DataFrame) -> DataFrame:
    """K11. (bc, s1, cand) with n_jacc, n_idf_overlap, n_max_idf_unshared, n_max_idf_shared; from a_name_core and b_name_core."""
    each = pairs.select("bc", "s1", "cand", "a_name_core", "b_name_core", F.explode(F.array_union("a_name_core", "b_name_core")).alias("tok"))
    each = each.withColumn("both", F.array_contains("a_name_core", F.col("tok")) & F.array_contains("b_name_core", F.col("tok"))).join(large(idf), ["bc", "tok"], "left")
    w = F.col("idf")
    return each.groupBy("bc", "s1", "cand").agg(
        F.avg(F.col("both").cast("double")).alias("n_jacc"),
        F.round(F.coalesce(F.sum(F.when(F.col("both"), w)), F.lit(0.0)) / F.sum(w), 6).alias("n_idf_overlap"),
        F.coalesce(F.max(F.when(~F.col("both"), w)), F.lit(0.0)).alias("n_max_idf_unshared"),
        F.coalesce(F.max(F.when(F.col("both"), w)), F.lit(0.0)).alias("n_max_idf_shared"),
    )


def native_pair_features(sides: DataFrame) -> DataFrame:
    """The pair features that need no string kernel: sets, numbers, lengths, codes (names as in the feature list)."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    num = lambda c: F.array_min(F.transform(c, lambda x: x.cast("double")))
    flag = lambda c: c.cast("double")
    out = sides.withColumns({"a_name": T.joined(a("name_core")), "b_name": T.joined(b("name_core")), "a_addr": T.joined(a("addr_core")), "b_addr": T.joined(b("addr_core"))})
    out = out.withColumns({"a_tight": F.replace("a_name", F.lit(" "), F.lit("")), "b_tight": F.replace("b_name", F.lit(" "), F.lit("")), "a_canon": T.canonical_legal(a("legal")), "b_canon": T.canonical_legal(b("legal"))})
    out = out.withColumns({"__num": K.number_differences(a("house_nums"), b("house_nums")), "__unit": K.number_differences(a("units"), b("units"))})
    na, nb = F.col("a_name"), F.col("b_name")
    acr = (a("name_acr") != "") & ((a("name_acr") == F.col("b_tight")) | (b("name_acr") == F.col("a_tight")))
    post = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    clip = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(-1e6), F.least(c, F.lit(1e6))))
    box = F.concat(F.lit(" "), F.col("b_addr"), F.lit(" "))
    return out.withColumns({
        "n_lev": F.round(K.normalised_levenshtein(na, nb), 6),
        "n_first_tok_eq": flag(F.coalesce(F.try_element_at(a("name_core"), F.lit(1)) == F.try_element_at(b("name_core"), F.lit(1)), F.lit(False))),
        "n_contain": flag((na != "") & (nb != "") & (F.contains(nb, na) | F.contains(na, nb))),
        "n_acronym": flag(acr),
        "legal_state": K.set_state(a("legal"), b("legal")),
        "legal_canon_state": K.set_state(F.col("a_canon"), F.col("b_canon")),
        "b_num1": num(b("house_nums")), "a_num1": num(a("house_nums")), "b_legal_code": T.legal_code(F.col("b_canon")), "a_legal_code": T.legal_code(F.col("a_canon")),
        "name_num_state": K.set_state(a("name_nums"), b("name_nums")),
        "n_len_min": F.least(F.length(na), F.length(nb)),
        "n_len_diff": F.round(F.abs(F.length(na) - F.length(nb)) / F.greatest(F.length(na), F.length(nb), F.lit(1)), 6),
        "n_tok_diff": F.abs(F.size(a("name_core")) - F.size(b("name_core"))),
        "b_name_indic": b("name_indic").cast("int"), "a_name_indic": a("name_indic").cast("int"),
        "a_jacc": F.round(K.jaccard(F.array_distinct(a("addr_core")), F.array_distinct(b("addr_core"))), 6),
        "postal_state": K.set_state(post(a("postal")), post(b("postal"))),
        "postal_pref3": flag((a("postal") != "") & (b("postal") != "") & (F.substring(a("postal"), 1, 3) == F.substring(b("postal"), 1, 3))),
        "num_state": K.set_state(a("house_nums"), b("house_nums")),
        "num_jacc": F.round(K.jaccard(a("house_nums"), b("house_nums")), 6),
        "num_near": K.number_near(a("house_nums"), b("house_nums")),
        "num_min_absdiff": F.round(F.log1p(F.col("__num.least")), 6),
        "num_signed_diff": clip(F.col("__num.signed")),
        "num_unmatched_b": F.col("__num.unmatched"),
        "unit_signed_diff": clip(F.col("__unit.signed")),
        "b_pmb_box": flag(F.contains(box, F.lit(" pmb ")) | F.contains(box, F.lit(" box "))),
        "unit_state": K.set_state(a("units"), b("units")),
        "landmark_both": flag((F.size(a("landmark")) > 0) & (F.size(b("landmark")) > 0)),
        "a_missing": (F.col("a_addr") == "").cast("int") + (F.col("b_addr") == "").cast("int"),
        "a_len_min": F.least(F.length("a_addr"), F.length("b_addr")),
    }).drop("__num", "__unit")


def kernel_pair_features(df: DataFrame) -> DataFrame:
    """The pair features of string kernels (Arrow), over native_pair_features."""
    c = F.col
    tight = F.replace("b_tight", F.lit("com"), F.lit(""))
    skel_a, skel_b, mark_a, mark_b = (T.joined(c(x)) for x in ("a_name_skel", "b_name_skel", "a_landmark", "b_landmark"))
    full_a, full_b = F.concat_ws(" ", "a_name", T.joined(c("a_canon"))), F.concat_ws(" ", "b_name", T.joined(c("b_canon")))
    dba_a, dba_b = T.joined(c("a_dba_core")), T.joined(c("b_dba_core"))
    long_ = F.least(F.length("a_tight"), F.length(tight)) >= 5
    out = df.withColumns({
        "n_ratio": K.ratio("a_name", "b_name"), "n_partial": K.partial_ratio("a_name", "b_name"), "n_tsort": K.token_sort_ratio("a_name", "b_name"),
        "n_tset": K.token_set_ratio("a_name", "b_name"), "n_jw": K.jaro_winkler_similarity("a_name", "b_name"),
        "n_nospace_ratio": K.ratio(c("a_tight"), tight), "n_nospace_partial": K.partial_ratio(c("a_tight"), tight),
        "n_skel_ratio": K.ratio(skel_a, skel_b), "n_skel_tset": K.token_set_ratio(skel_a, skel_b), "n_full_tsort": K.token_sort_ratio(full_a, full_b),
        "__dba1": K.token_set_ratio(c("a_name"), dba_b), "__dba2": K.token_set_ratio(dba_a, c("b_name")),
        "a_tset": K.token_set_ratio("a_addr", "b_addr"), "a_tsort": K.token_sort_ratio("a_addr", "b_addr"), "a_ratio": K.ratio("a_addr", "b_addr"), "a_partial": K.partial_ratio("a_addr", "b_addr"),
        "landmark_tset": K.token_set_ratio(mark_a, mark_b),
    })
    out = out.withColumns({"n_nospace_partial": F.when(long_, c("n_nospace_partial")).otherwise(0.0), "landmark_tset": F.when(c("landmark_both") == 1, c("landmark_tset")).otherwise(-1.0), "n_dba_best": F.greatest("__dba1", "__dba2")})
    return out.drop("__dba1", "__dba2")


def sibling_features(cands: DataFrame, weights: DataFrame, top: int = 2) -> DataFrame:
    """(bc, s1, cand, sib<r>_<view>, sib_support): cosines of each candidate with the query's r-th best one; null for that one itself."""
    ranks, q = range(1, top + 1), Window.partitionBy("bc", "s1")
    best = lambda r, c: F.max(F.when(F.col("prune_rank") == r, F.col(c))).over(q)
    each = cands.withColumns({f"__p{r}": best(r, "cand") for r in ranks} | {f"__ps{r}": best(r, "sim_name_addr") for r in ranks})
    each = each.select("bc", "s1", "cand", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.col(f"__p{r}").alias("p"), F.col(f"__ps{r}").alias("ps")) for r in ranks))).alias("b")).select("bc", "s1", "cand", "b.*")
    sims = pair_cosine(each.where("p <> cand").select("bc", "cand", "p"), weights, "cand", "p")
    columns = {f"sib{r}_{v}": F.max(F.when(F.col("r") == r, F.col(f"sim_{v}"))) for r in ranks for v in VIEWS}
    support = F.max(F.coalesce(F.col("sim_name_addr") * F.col("ps"), F.lit(0.0)))
    return each.join(large(sims), ["bc", "cand", "p"], "left").groupBy("bc", "s1", "cand").agg(*(c.alias(n) for n, c in columns.items()), F.round(support, 6).alias("sib_support"))


def min_rank(column: str, *group: str) -> Column:
    """Rank by falling value, ties sharing the smallest place; null for null."""
    return F.when(F.col(column).isNotNull(), F.rank().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last(column))))


def context_features(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The 22 competition columns: among a query's candidates (ctx_*), and among a candidate's queries (rev_*) within `scope`.

    Without a scope, a candidate's rivals are those of all queries, whatever chunk they came in.
    """
    q, qs, c = ["bc", "s1"], ["bc", "s1", "cand_src"], ["bc", "cand", *(scope or [])]
    out = df
    for group, prefix, columns in ((q, "ctx", ("sim_name", "sim_addr", "prune_score", "n_tset", "a_tset")), (c, "rev", ("prune_score", "sim_name_addr", "n_tset", "a_tset"))):
        out = out.withColumns({f"{prefix}_rank_{x}": min_rank(x, *group) for x in columns if x in df.columns})
        out = out.withColumns({f"{prefix}_gap_{x}": F.round(F.max(x).over(Window.partitionBy(*group)) - F.col(x), 6) for x in columns if x in df.columns})
    size = lambda g: F.count("*").over(Window.partitionBy(*g))
    out = out.withColumns({"ctx_n_cands": size(q), "ctx_src_count": size(qs), "rev_n_s1": size(c)})
    return out.withColumn("ctx_n_hi_name", F.count_if(F.col("n_tset") >= 90).over(Window.partitionBy(*q))) if "n_tset" in df.columns else out


#: What competition columns are made of.
CONTEXT = ("bc", "s1", "cand", "cand_src", "sim_name", "sim_addr", "sim_name_addr", "prune_score", "n_tset", "a_tset")


def features(cands: DataFrame, records: DataFrame, weights: DataFrame) -> DataFrame:
    """All stage-1 features of candidates: retrieval, pair, chain, sibling and competition columns.

    Pair features are written once, without the records' texts: windows and joins then move a few columns, and the others once.
    """
    named = records.withColumn("name", F.array_join("name_core", " ")).join(large(chains(records)), ["bc", "name"], "left").fillna(0, ["chain_s1", "chain_pool"])
    sides = with_sides(cands, named, ("chain_s1", "chain_pool"))
    df = kernel_pair_features(native_pair_features(sides))
    spent = [x for x in df.columns if x[:2] in ("a_", "b_") and dict(df.dtypes)[x].startswith(("array", "string"))]
    df = materialise(df.drop(*spent).withColumn("__row", F.monotonically_increasing_id()))
    context = context_features(df.select("__row", *(x for x in CONTEXT if x in df.columns)))
    token = token_features(with_sides(cands.select("bc", "s1", "cand"), records), token_idf(records))
    for other in (token, sibling_features(cands, weights)):
        df = df.join(large(other), ["bc", "s1", "cand"], "left")
    # A repeated id has several rows of a pair: each meets its own, told by a difference, which is no key, so that rows stay where they are.
    keys = ("bc", "s1", "cand", "__row")
    context = context.select(*(F.col(c).alias(f"__own_{c}") for c in keys), *(x for x in context.columns if x.startswith(("ctx_", "rev_"))))
    same = (F.col("bc") == F.col("__own_bc")) & (F.col("s1") == F.col("__own_s1")) & (F.col("cand") == F.col("__own_cand")) & (F.col("__row") - F.col("__own___row") == 0)
    df = df.join(large(context), same, "left").drop("__row", *(f"__own_{c}" for c in keys))
    return df.fillna(0.0, ["n_jacc", "n_idf_overlap", "n_max_idf_unshared", "n_max_idf_shared"])


# Columns carried into the second stage as x_*.
CARRIED = [
    "sim_name_addr", "sim_name", "sim_addr", "n_tset", "a_tset", "num_signed_diff", "num_state", "a_missing", "chain_s1",
    "sib1_name_addr", "sib1_addr", "sib1_name", "sib2_name_addr", "cand_src", "prune_rank", "n_nospace_partial",
    "legal_canon_state", "n_full_tsort", "b_num1", "a_num1", "is_hop", "hop_best",
]


def best_other(value: str, *group: str, ties: bool = False) -> Column:
    """The largest value of the group's other rows: below the maximum for rows that reach it (0 if none), else the maximum.

    With ties, a maximum reached twice is its own rival.
    """
    w = Window.partitionBy(*group)
    top = F.max(value).over(w)
    second = F.coalesce(F.max(F.when(F.col(f"__top_{value}") > F.col(value), F.col(value))).over(w), F.lit(0.0))
    alone = F.count_if(F.col(value) == F.col(f"__top_{value}")).over(w) <= 1
    return F.when((F.col(value) >= top) & (alone if ties else F.lit(True)), second).otherwise(top)


def stage2_features(df: DataFrame, p: str = "p1") -> DataFrame:
    """s1, cand and the neighbourhood columns over df (s1, cand, cand_src, the score p and carried columns, all optional but the first four)."""
    has = set(df.columns)
    out = df.withColumn("p1", F.col(p))
    s, c, ss = (Window.partitionBy(*g) for g in (["s1"], ["cand"], ["s1", "cand_src"]))
    top = F.max("p1").over(s)
    out = out.withColumn("__top_p1", top)
    strong = lambda src: F.count_if((F.col("p1") >= 0.5) & (F.col("cand_src") == src)).over(s)
    out = out.withColumns({
        "s_rank": min_rank("p1", "s1"), "s_gap_top": F.round(top - F.col("p1"), 6), "s_top": top, "s_sum": F.round(F.sum("p1").over(s), 6),
        "s_n_hi": F.count_if(F.col("p1") > 0.5).over(s), "s_n": F.count("*").over(s),
        "s_second": F.coalesce(F.max(F.when(F.col("p1") < F.col("__top_p1"), F.col("p1"))).over(s), F.lit(0.0)), "s_other_best": best_other("p1", "s1"),
        "s_n_strong_s2": strong(2), "s_n_strong_s3": strong(3), "ss_rank": min_rank("p1", "s1", "cand_src"), "p_best_in_src": F.max("p1").over(ss),
        "__first": F.row_number().over(ss.orderBy(F.desc("p1"), "cand")),
    })
    out = out.withColumn("__top_p1", F.max("p1").over(c))
    out = out.withColumns({"c_rank": min_rank("p1", "cand"), "c_other_best": best_other("p1", "cand"), "c_n": F.count("*").over(c)})
    own = F.col("cand_src") == 2
    out = out.withColumns({"c_margin": F.round(F.col("p1") - F.col("c_other_best"), 6), "own_src_strong": F.when(own, F.col("s_n_strong_s2")).otherwise(F.col("s_n_strong_s3")), "other_src_strong": F.when(own, F.col("s_n_strong_s3")).otherwise(F.col("s_n_strong_s2"))})
    out = out.withColumn("best_in_empty_src", ((F.col("__first") == 1) & (F.col("own_src_strong") == 0)).cast("double"))
    if "n_tset" in has:
        out = out.withColumn("__top_n_tset", F.max("n_tset").over(c))
        out = out.withColumn("name_rival_margin", F.round(F.col("n_tset") - best_other("n_tset", "cand", ties=True), 6))
    if "sib1_name_addr" in has:
        out = out.withColumn("sib_top_support", F.round(F.coalesce("sib1_name_addr", F.lit(0.0)) * F.col("s_top"), 6))
    for column, name in (("b_num1", "num"), ("b_legal_code", "legal")):
        if column in has:
            votes = out.where((F.col("p1") >= 0.9) & F.col(column).isNotNull()).groupBy("s1", F.col(column).alias("v")).agg(F.count("*").alias("n"))
            mode = votes.groupBy("s1").agg(F.max(F.struct("n", (-F.col("v")).alias("v"))).alias("m")).select("s1", (-F.col("m.v")).alias("__mode"), F.col("m.n").alias(f"cons_{name}_n"))
            out = out.join(mode, "s1", "left").fillna(0, [f"cons_{name}_n"])
            same = lambda x: F.when(F.col(x).isNull() | F.col("__mode").isNull(), -1.0).otherwise((F.col(x) == F.col("__mode")).cast("double"))
            out = out.withColumn(f"cons_{name}_eq", same(column))
            if name == "num":
                diff = F.col(column) - F.col("__mode")
                out = out.withColumns({"cons_num_diff": F.when(diff.isNotNull(), F.greatest(F.lit(-1e6), F.least(diff, F.lit(1e6)))), "cons_num_vs_s1": same("a_num1") if "a_num1" in has else F.lit(-1.0)})
            out = out.drop("__mode")
    new = [x for x in out.columns if x not in has and not x.startswith("__")]
    return out.select("s1", "cand", *new, *(F.col(x).alias(f"x_{x}") for x in CARRIED if x in has))
