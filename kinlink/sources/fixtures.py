"""Business records, truth and scores derived from the driver's tables by modular arithmetic.

The SQL is portable: the same text runs in Spark and DuckDB over views customer and nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SYLLABLES = "ka,lo,mi,ne,ru,sa,to,vi,be,da,fo,gu,ha,jo,le,ma,no,pe,ri,su"
_W2 = "auto,dental,bakery,plumbing,logistics,consulting,pharmacy,grill,hardware,realty,insurance,fitness,electric"
_W3 = "group,services,center,partners,associates,systems,works"
_LG, _LG2 = "Inc,LLC,Pvt Ltd,SARL,Corp", "LLC,Inc,Private Limited,SAS,Corporation"
_WAY = "St,Way,Row,Park"
_STATE = "IL,TX,CO,WA,FL,NY,CA,OH,PA,GA,MI,NC,NJ,VA,AZ,MO,MD,MN,WI,KY"
_SHIFT = "1,2,3,4,5,7,9,11,13,21"


def _syllables(n: str, count: int) -> str:
    """A word of `count` syllables, by the digits of a number to base 20."""
    return f"concat({', '.join(f"split_part('{_SYLLABLES}', ',', CAST(CAST(floor({n} / {20**i}.0) AS BIGINT) % 20 + 1 AS INT))" for i in range(count))})"


#: Common table expressions: `biz` with src, entity_id, business_name, business_address, country. Three neighbours share a first word;
#: k % 29 = 7 has another name and place in source 3, and k % 29 = 11 only its house number.
RECORDS = f"""
base AS (
  SELECT c_custkey AS k, lpad(CAST(c_custkey AS STRING), 6, '0') AS id,
         {_syllables('floor(c_custkey / 3.0)', 3)} AS w1,
         split_part('{_W2}', ',', CAST(CAST(floor(c_custkey / 17.0) AS BIGINT) % 13 + 1 AS INT)) AS w2,
         CASE WHEN c_custkey % 2 = 0 THEN concat(' ', split_part('{_W3}', ',', CAST(c_custkey % 7 + 1 AS INT))) ELSE '' END AS w3,
         split_part('{_LG}', ',', CAST(c_custkey % 5 + 1 AS INT)) AS lg,
         split_part('{_LG2}', ',', CAST(c_custkey % 5 + 1 AS INT)) AS lg2,
         10 + (c_custkey * 37) % 9000 AS num,
         concat({_syllables('(c_custkey * 7)', 2)}, ' ', split_part('{_WAY}', ',', CAST(c_custkey % 4 + 1 AS INT))) AS st,
         concat({_syllables('(c_custkey * 11)', 2)}, ' ', split_part('{_STATE}', ',', CAST(c_custkey % 20 + 1 AS INT))) AS city,
         CASE n_regionkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
biz AS (
  SELECT 1 AS src, concat('S1-', id) AS entity_id, concat(w1, ' ', w2, w3, ' ', lg) AS business_name,
         concat(CAST(num AS STRING), ' ', st, ', ', city) AS business_address, country FROM base
  UNION ALL
  SELECT 2, concat('S2-', id),
         CASE k % 6 WHEN 1 THEN concat(w1, ' ', w2, w3, ' ', lg2) WHEN 2 THEN upper(concat(w1, ' ', w2, w3, ' ', lg))
                    WHEN 3 THEN concat(w2, ' ', w1, w3, ' ', lg) ELSE concat(w1, ' ', w2, w3, ' ', lg) END,
         CASE k % 6 WHEN 4 THEN '' WHEN 5 THEN concat(CAST(CAST(floor(num / 10.0) AS BIGINT) AS STRING), ' ', st, ', ', city)
                    ELSE concat(CAST(num AS STRING), ' ', st, ', ', city) END, country FROM base WHERE k % 4 <> 0
  UNION ALL
  SELECT 3, concat('S3-', id),
         CASE WHEN k % 29 = 7 THEN concat({_syllables('(k * 13 + 5)', 3)}, 'x') WHEN k % 29 = 11 THEN concat({", ' ', ".join(_syllables(f'(k * {m} + {m})', 4) for m in (31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89))})
              ELSE concat(w1, ' ', w2, w3, ' ', lg2) END,
         CASE WHEN k % 29 = 7 THEN '' WHEN k % 29 = 11 THEN concat(CAST(num AS STRING), ' ', {_syllables('(k * 17 + 3)', 4)}) ELSE concat(CAST(num AS STRING), ' ', st, ', ', city) END, country
  FROM base WHERE k % 5 <> 0
  UNION ALL
  SELECT 3, concat('S3-9', id), concat(w1, ' ', w2, w3, ' ', lg),
         concat(CAST(num + CAST(split_part('{_SHIFT}', ',', CAST(k % 10 + 1 AS INT)) AS BIGINT) AS STRING), ' ', st, ', ', city), country FROM base WHERE k % 3 = 0)
"""

#: `truth` with a row for each true pair, `ones` with all first-source ids.
TRUTH = """
ones AS (SELECT concat('S1-', id) AS s1, CASE country WHEN 'US' THEN 'us' WHEN 'India' THEN 'in' ELSE 'fr' END AS bc FROM base),
truth AS (
  SELECT concat('S1-', id) AS s1, concat('S2-', id) AS cand FROM base WHERE k % 4 <> 0
  UNION ALL SELECT concat('S1-', id), concat('S3-', id) FROM base WHERE k % 5 <> 0)
"""

#: `scored` with s1, cand, cand_src and a made-up probability p: every record of the source number k and of its neighbours, so
#: that candidates are contested, with exact ties.
SCORED = """
near AS (
  SELECT b.k, b.id, d.delta, b.k + d.delta AS other FROM base b CROSS JOIN (SELECT 0 AS delta UNION ALL SELECT 1 UNION ALL SELECT 17) d),
scored AS (
  SELECT concat('S1-', n.id) AS s1, concat('S2-', o.id) AS cand, 2 AS cand_src,
         CAST(CASE WHEN n.delta = 0 THEN 40 + (n.k * 7) % 60 ELSE (n.k * 13 + n.delta) % 55 END AS DOUBLE) / 100 AS p
  FROM near n JOIN base o ON o.k = n.other WHERE o.k % 4 <> 0
  UNION ALL
  SELECT concat('S1-', n.id), concat('S3-', o.id), 3, CAST(CASE WHEN n.delta = 0 THEN 35 + (n.k * 11) % 65 ELSE (n.k * 5 + n.delta) % 60 END AS DOUBLE) / 100
  FROM near n JOIN base o ON o.k = n.other WHERE o.k % 5 <> 0)
"""


#: Tables that the records are derived from.
TABLES = ("customer", "nation")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(f"WITH {RECORDS} SELECT * FROM biz")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(f"WITH {RECORDS}, {TRUTH} SELECT * FROM truth")


def ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(f"WITH {RECORDS}, {TRUTH} SELECT * FROM ones")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(f"WITH {RECORDS}, {SCORED} SELECT * FROM scored")
