"""Literal cases of text normalisation, and invariants over random tokens."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from kinlink.functions import text as T


def one(spark, make, *values):
    """make(columns...) of one row of values."""
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).head()[0]


@pytest.mark.parametrize("raw,want", [("m g road", "mg road"), ("s b i", "sbi"), ("a1 b c1", "a1 b c1"), ("", ""), ("x", "x")])
def test_join_single_letters(spark, raw, want):
    assert one(spark, T.join_single_letters, raw) == want


def test_skeletons(spark):
    words = "laxmi lakshmi shree sri service sarvis care keyar southern infra"
    assert one(spark, T.skeleton, words).split() == "lksm lksm sr sr srvs srvs kr kr strn infr".split()


def test_skeleton_equals_plain_rule(spark):
    from kinlink.functions.dictionaries import SKELETON

    random.seed(5)
    tokens = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz01") for _ in range(random.randint(1, 9))) for _ in range(400)]

    def plain(t):
        s = re.sub("c(?!h)", "k", re.sub("c(?=[eiy])", "s", t))
        for a, b in SKELETON:
            s = s.replace(a, b)
        s = s[0] + re.sub("[aeiouy]", "", s[1:])
        return re.sub(r"(.)\1+", r"\1", s)

    assert one(spark, T.skeleton, " ".join(tokens)).split(" ") == [plain(t) for t in tokens]


def test_accents(spark):
    assert one(spark, T.strip_accents, "Hôtel L’Étoile ﬁn Ａ") == "Hotel L’Etoile fin A"


def test_accents_of_all_characters(spark):
    import unicodedata

    every = [chr(c) for c in [*range(1, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]]
    got = [r.x for r in spark.createDataFrame([(k, c) for k, c in enumerate(every)], "k int, c string").select("k", T.strip_accents(F.col("c")).alias("x")).orderBy("k").collect()]
    want = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in every]
    assert [c for c, a, b in zip(every, got, want) if a != b] == []
    assert one(spark, T.strip_accents, "½ № ĳ ǆ Ⅷ ℡ 𝒳 Ça") == "1⁄2 No ij dz VIII TEL X Ca"


def test_phrases_in_table_order(spark):
    table = {"virginia": "va", "west virginia": "wv", "new york": "ny", "iowa": "ia", "abc": "x"}
    assert one(spark, lambda c: T.replace_phrases(c, table), "west virginia new york abc iowan iowa") == "west va ny abc iowan ia"
    assert one(spark, lambda c: T.replace_phrases(c, table), "nothing here") == "nothing here"


def test_transliteration(spark):
    assert one(spark, T.transliterate, "राम मार्केटिंग प्राइवेट लिमिटेड") == "ram marketing praivet limited"
    assert one(spark, T.transliterate, "plain aa") == "plain aa"
    assert one(spark, T.transliterate, "१२") == "12"


def test_countries(spark):
    assert [one(spark, T.country_code, x) for x in ("U.S.A.", "bharat", "République française", "Peru", "")] == ["us", "in", "fr", "other", "other"]
    assert [one(spark, T.block_country, x) for x in ("India", "Côte d'Ivoire", "")] == ["in", "cote d ivoire", "unknown"]


RECORD = "business_name string, business_address string, country string"


@pytest.mark.parametrize("name,address,country,want", [
    ("राम मार्केटिंग प्राइवेट लिमिटेड", "12/4, M G Road, near City Mall, Mumbai 400 001, Maharashtra", "India",
     {"name_core": ["ram", "marketing"], "legal": ["limited", "private"], "name_indic": True, "postal": "400001", "landmark": ["near", "city", "mall"], "addr_core": ["mg", "road", "mumbai", "maharashtra"], "region": "maharashtra", "house_nums": ["12", "4"]}),
    ("Hôtel L’Étoile d/b/a Café de la Paix SARL", "BP 12 14 Rue de l'Église 75001 Paris Cedex 04", "France",
     {"name_core": ["hotel", "etoile"], "dba_core": ["cafe", "paix"], "postal": "75001", "addr_core": ["rue", "eglise", "paris"], "region": "75"}),
    ("The S B I & Co. Pvt. Ltd.", "1 Main St Ste 040B, Springfield, West Virginia 62704-1234", "USA",
     {"name_core": ["sbi"], "legal": ["co", "ltd", "pvt"], "units": ["40b"], "addr_core": ["main", "street", "springfield", "west", "va"], "postal": "62704", "region": "va", "name_acr": ""}),
    ("and Co", "12345 Elm", "US", {"name_core": ["and", "co"], "postal": "", "house_nums": ["12345"]}),
    (None, None, None, {"name_core": [], "addr_core": [], "postal": "", "bc": "unknown", "region": ""}),
    ("x", "3 rue du lac, Nouvelle-Aquitaine, Gironde", "fr", {"addr_core": ["rue", "lac"]}),
])
def test_records(spark, name, address, country, want):
    got = T.normalise(spark.createDataFrame([(name, address, country)], RECORD)).head().asDict()
    assert {k: got[k] for k in want} == want


def test_token_documents(spark):
    df = spark.createDataFrame([(["emmy", "love", "dds"], ["1323"], "az")], "n array<string>, h array<string>, r string")
    got = df.select(T.run_together(F.col("n")), T.number_tokens(F.col("h"), F.col("h")), T.tagged(F.col("n"), F.col("r")), T.bigrams(F.col("n"), False)).head()
    assert got[0] == ["=emmylove", "=emmylovedds"] and got[1] == ["#1323", "#132"] * 2 and got[2] == ["emmy@az", "love@az", "dds@az"] and got[3] == ["emmy|love", "dds|love"]
    legal = spark.createDataFrame([(["pvt", "ltd"], ["limited", "private"])], "a array<string>, b array<string>")
    a, b = legal.select(T.canonical_legal(F.col("a")), T.canonical_legal(F.col("b"))).head()
    assert a == b == ["limited", "private"]
