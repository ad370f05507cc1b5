"""Incremental linkage: query files that arrive are linked to a fixed pool, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlink.functions.text import normalise
from kinlink.operators import retrieve
from kinlink.sources.tables import materialise


def link_arrivals(spark: SparkSession, folder: str, pool: DataFrame, target: str, checkpoint: str, k: int = 25, min_sim: float = 0.1) -> StreamingQuery:
    """Top-k candidates of the records in Parquet files that land in `folder`, appended to `target` by batch.

    pool: raw records of sources 2 and 3, whose normalised records, term counts and document frequencies are made once; a batch adds its
    own counts to the frequencies of the tokens that it has, and weighs only the pool's rows of these. A batch writes its own subfolder in
    overwrite mode, so that a batch replayed after a failure leaves one copy; the query stops when all files are taken (availableNow).
    """
    documents = retrieve.documents(normalise(pool))
    terms = materialise(retrieve.term_counts(documents))
    sizes = materialise(documents.groupBy("view", "bc").agg(F.count("*").alias("n")))
    every = materialise(terms.groupBy("view", "bc", "tok").agg(F.count("*").alias("df")))
    arrivals = spark.readStream.schema(pool.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def link(batch: DataFrame, number: int) -> None:
        docs = retrieve.documents(normalise(batch))
        own = materialise(retrieve.term_counts(docs))
        add = lambda a, b, keys, x: a.unionByName(b).groupBy(*keys).agg(F.sum(x).alias(x))
        n = add(sizes, docs.groupBy("view", "bc").agg(F.count("*").alias("n")), ["view", "bc"], "n")
        df = add(every, own.groupBy("view", "bc", "tok").agg(F.count("*").alias("df")), ["view", "bc", "tok"], "df")
        idf = materialise(retrieve.inverse_frequencies(df, n))
        met = terms.join(own.select("view", "bc", "tok").distinct(), ["view", "bc", "tok"], "left_semi").select("view", "bc", "id").distinct()
        weights = retrieve.weighed(terms.join(met, ["view", "bc", "id"], "left_semi").unionByName(own), idf)
        retrieve.top_k(weights.where("src = 1"), weights.where("src <> 1"), k, min_sim).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arrivals.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
