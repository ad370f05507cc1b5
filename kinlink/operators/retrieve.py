"""Candidate retrieval: weighted-token documents, top-k cosine joins, union, pruning and second hop.

Records come from functions.text.normalise: src 1 is the query side, other sources the pool; bc is a join key, so all
countries are one plan. Similarities are compared after rounding to six digits, which makes ranks independent of the
order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import text as T
from kinlink.operators import tiles
from kinlink.sources.tables import materialise, materialise_in_turn

VIEWS = ("name", "addr", "name_addr")

#: Neighbours per view, least cosine, and the document frequency beyond which a token is left out of retrieval.
K, MIN_SIM, MAX_DF = 60, 0.1, 20_000

#: Queries whose candidates are found at a time, about.
PORTION = 1 << 16


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that both sides enter sorted. Spark's estimates leave out what explode adds and take Parquet for as large as
    it is compressed, so that it would send a table of a gigabyte to the driver as one of less than ten megabytes."""
    return df.hint("merge")


def name_document(df: DataFrame) -> Column:
    """R1. Name words, skeletons, order-free word pairs, joined forms and region tags."""
    core, dba, skel, region = F.col("name_core"), F.col("dba_core"), T.prefixed(F.col("name_skel"), "~"), F.col("region")
    return F.concat(core, dba, skel, T.bigrams(core, False), T.bigrams(dba, False), T.run_together(core), T.run_together(dba), T.tagged(core, region), T.tagged(skel, region))


def address_document(df: DataFrame) -> Column:
    """R2. Address words, numbers, neighbouring words and the postcode."""
    post = F.when(F.col("postal") != "", F.array(F.concat(F.lit("@"), "postal"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.col("addr_core"), T.number_tokens(F.col("house_nums"), F.col("units")), T.bigrams(F.col("addr_core")), post)


def documents(records: DataFrame) -> DataFrame:
    """R1-R3. (view, bc, id, src, tokens), three rows for each record."""
    both = records.select("bc", F.col("entity_id").alias("id"), "src", name_document(records).alias("n"), address_document(records).alias("a"))
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), t.alias("tokens")) for v, t in (("name", F.col("n")), ("addr", F.col("a")), ("name_addr", F.concat("n", "a"))))))
    return both.select("bc", "id", "src", rows.alias("d")).select("d.view", "bc", "id", "src", "d.tokens")


def term_counts(docs: DataFrame) -> DataFrame:
    """R4. (view, bc, id, src, tok, tf)."""
    return docs.select("view", "bc", "id", "src", F.explode("tokens").alias("tok")).groupBy("view", "bc", "id", "src", "tok").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame, docs: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """R5, R6. (view, bc, tok, df, idf) of the tokens in 2 to max_df documents; the others join nothing."""
    return inverse_frequencies(counts.groupBy("view", "bc", "tok").agg(F.count("*").alias("df")), docs.groupBy("view", "bc").agg(F.count("*").alias("n")), max_df)


def inverse_frequencies(df: DataFrame, sizes: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """R6. Document frequencies (view, bc, tok, df) between 2 and max_df with their idf; sizes (view, bc, n): a row for each view and country."""
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return df.where(F.col("df").between(2, max_df)).join(sizes, ["view", "bc"]).select("view", "bc", "tok", "df", idf.alias("idf"))


def postings(docs: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """R7. (view, bc, id, src, tok, w, df): sublinear tf times idf, each document of unit length, and the token's document frequency."""
    counts = term_counts(docs)
    return weighed(counts, document_frequencies(counts, docs, max_df))


def weighed(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """R7. Term counts under given idf weights, each document of unit length."""
    raw = counts.join(large(idf), ["view", "bc", "tok"]).withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("view", "bc", "id")))
    return raw.select("view", "bc", "id", "src", "tok", (F.col("raw") / length).alias("w"), "df")


def ranked(pairs: DataFrame, group: list[str], score: str, name: str, tie: str = "cand") -> DataFrame:
    """Adds `name`: the place within the group by falling score, ties by id."""
    return pairs.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie)))


def top_k(queries: DataFrame, pool: DataFrame, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """R8. (view, bc, s1, cand, sim, rank): for each query document the k pool documents of highest cosine >= min_sim.

    Products are summed in tiles of query and pool blocks; a tile hands on its k best, of which the best stay.
    """
    return ranked(tiles.top_k(queries, pool, k, min_sim), ["view", "bc", "s1"], "sim", "rank").where(F.col("rank") <= k)


def with_cosines(pairs: DataFrame, weights: DataFrame, left: str = "s1", right: str = "cand") -> DataFrame:
    """R9. pairs (bc, left, right, ...), each once, with sim_<view>: exact cosines in every view; no common token is 0.

    `right` is of the pool, `left` of the queries if it is s1, else of the pool.
    """
    pool = weights.where("src <> 1")
    sims = tiles.pair_cosines(pairs.withColumnsRenamed({left: "x", right: "y"}), weights.where("src = 1") if left == "s1" else pool, pool, VIEWS)
    return sims.withColumnsRenamed({"x": left, "y": right})


def pair_cosine(pairs: DataFrame, weights: DataFrame, left: str = "s1", right: str = "cand") -> DataFrame:
    """R9. (bc, left, right, sim_<view>...) of the distinct pairs."""
    return with_cosines(pairs.select("bc", left, right).distinct(), weights, left, right)


def union(found: DataFrame, weights: DataFrame, k: int = K) -> DataFrame:
    """R10. (bc, s1, cand, rank_<view>, sim_<view>, n_retr): the full outer union of the views' candidates.

    One aggregation instead of outer joins, and its columns go through the tiles; a view that did not return the pair has rank k + 1 and its exact cosine.
    """
    seen = found.groupBy("bc", "s1", "cand").agg(
        *(F.coalesce(F.max(F.when(F.col("view") == v, F.col("rank"))), F.lit(k + 1)).cast("int").alias(f"rank_{v}") for v in VIEWS),
        F.count("*").cast("int").alias("n_retr"),
    )
    return with_cosines(seen, weights)


def prune_score(pairs: DataFrame, how: str = "mean") -> DataFrame:
    """R11. Adds prune_score: mean or max of the views' cosines."""
    sims = [F.col(f"sim_{v}") for v in VIEWS]
    value = F.greatest(*sims) if how == "max" else sum(sims[1:], sims[0]) / len(sims)
    return pairs.withColumn("prune_score", F.round(value, 6))


def prune(pairs: DataFrame, max_k: int = 25, min_score: float = 0.0) -> DataFrame:
    """R13. Adds prune_rank; the max_k best of each query with at least min_score stay."""
    return ranked(pairs, ["bc", "s1"], "prune_score", "prune_rank").where((F.col("prune_rank") <= max_k) & (F.col("prune_score") >= min_score))


def prune_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """R12. The 20 columns that a learned pruner reads, beside bc, s1 and cand."""
    q = Window.partitionBy("bc", "s1")
    out = pairs
    for v in VIEWS:
        out = out.withColumns({f"qmax_{v}": F.max(f"sim_{v}").over(q), f"qrank_{v}": F.rank().over(q.orderBy(F.desc(f"sim_{v}")))})
        out = out.withColumn(f"gap_{v}", F.col(f"qmax_{v}") - F.col(f"sim_{v}"))
    side = lambda key, name: records.select(F.col("entity_id").alias(key), F.col("name_indic").cast("int").alias(name), *([F.col("src").alias("cand_src")] if key == "cand" else []))
    return out.withColumn("q_union", F.count("*").over(q)).join(large(side("s1", "q_indic")), "s1").join(large(side("cand", "c_indic")), "cand")


def second_hop(cands: DataFrame, weights: DataFrame, anchor_rank: int = 3, anchor_min_sim: float = 0.6, k: int = 8, min_sim: float = 0.5, max_add: int = 5, max_k: int = 25, first_k: int = K) -> DataFrame:
    """R14. cands with is_hop and hop_best, plus up to max_add pool neighbours of each query's anchors.

    Anchors are candidates of high rank and cosine; each distinct anchor is looked up once in the pool, whatever
    number of queries it has.
    """
    anchors = cands.where((F.col("prune_rank") <= anchor_rank) & (F.col("sim_name_addr") >= anchor_min_sim)).select("bc", "s1", F.col("cand").alias("anchor"))
    pool = weights.where("src <> 1")
    near = top_k(pool.join(large(anchors.select("bc", F.col("anchor").alias("id")).distinct()), ["bc", "id"], "left_semi"), pool, k, min_sim)
    near = near.select("bc", F.col("s1").alias("anchor"), "cand", "sim").where("anchor <> cand")
    hops = anchors.join(large(near), ["bc", "anchor"]).groupBy("bc", "s1", "cand").agg(F.max("sim").alias("hop_best"))
    hops = hops.join(large(cands), ["bc", "s1", "cand"], "left_anti")
    hops = ranked(hops, ["bc", "s1"], "hop_best", "n").where(F.col("n") <= max_add)
    extra = {f"rank_{v}": F.lit(first_k + 1) for v in VIEWS} | {"n_retr": F.lit(0), "prune_score": F.lit(0.0), "prune_rank": F.lit(max_k) + F.col("n"), "is_hop": F.lit(1)}
    new = with_cosines(hops, weights).withColumns(extra).drop("n")
    return cands.withColumns({"is_hop": F.lit(0), "hop_best": F.lit(0.0)}).unionByName(new)


def in_portions(weights: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make() of the postings of a portion of the queries and of the whole pool, for every portion in turn, as one table.

    Tiles send each document of the pool to every block of queries, and all candidates are many times those that stay: a portion's
    are gone before the next begins.
    """
    n = max(1, -(-weights.where("src = 1").agg(F.approx_count_distinct("id")).head()[0] // PORTION))
    part = F.pmod(F.xxhash64(F.lit("portion"), F.col("id")), F.lit(n))  # not the hash that tells blocks
    return materialise_in_turn(weights.sparkSession, ((lambda i=i: make(weights.where((F.col("src") != 1) | (part == i)))) for i in range(n)))


def found(weights: DataFrame, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """R8 of all queries in the postings."""
    return top_k(weights.where("src = 1"), weights.where("src <> 1"), k, min_sim)


def scored_union(weights: DataFrame, k: int = K, min_sim: float = MIN_SIM) -> DataFrame:
    """R8, R10, R11 of all queries in the postings; what was found is a table that is deleted with others of its portion."""
    return prune_score(union(materialise(found(weights, k, min_sim)), weights, k))


def token_idf(records: DataFrame) -> DataFrame:
    """R15. (bc, tok, idf): name-core words by the number of records that have them, without cut-off."""
    n = records.groupBy("bc").agg(F.count("*").alias("n"))
    df = records.select("bc", F.explode(F.array_distinct("name_core")).alias("tok")).groupBy("bc", "tok").agg(F.count("*").alias("df"))
    return df.join(n, "bc").select("bc", "tok", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def chains(records: DataFrame) -> DataFrame:
    """R16. (bc, name, chain_s1, chain_pool): records with the same core name among the queries and in the pool."""
    return records.groupBy("bc", F.array_join("name_core", " ").alias("name")).agg(F.count_if(F.col("src") == 1).alias("chain_s1"), F.count_if(F.col("src") != 1).alias("chain_pool"))


def recall_at(pairs: DataFrame, truth: DataFrame, score: str, ks: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50)) -> DataFrame:
    """R18. (k, recall): the share of the pairs' true ones among the k best of each query."""
    rows = ranked(pairs, ["bc", "s1"], score, "place").join(large(truth.select("s1", "cand").distinct()), ["s1", "cand"], "left_semi")
    return rows.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "place").groupBy("k").agg(F.round(F.avg((F.col("place") <= F.col("k")).cast("double")), 6).alias("recall"))


def candidates(records: DataFrame, weights: DataFrame, k: int = K, min_sim: float = MIN_SIM, max_k: int = 25, hop: bool = True) -> DataFrame:
    """R8-R14 in sequence, from records and their postings."""
    found = top_k(weights.where("src = 1"), weights.where("src <> 1"), k, min_sim)
    kept = prune(prune_score(union(found, weights, k)), max_k)
    return second_hop(kept, weights, max_k=max_k, first_k=k) if hop else kept
