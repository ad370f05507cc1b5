"""Normalisation of hard cases, written out with what must come of them: accents, scripts, trade names, legal forms, postcodes, units, landmarks.

Every customer gets a case and a plain word that stands in it as {w} ({i}: its first letter). The SQL states the results worked out by
hand from the rules; queries run the operators on the raw texts.
"""

from __future__ import annotations

import unicodedata
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import text as T

WORDS = ["blue", "summit", "maple", "harbor", "golden"]

#: country, raw name, then name_clean, name_core, legal, dba_core, name_nums, name_acr, name_indic.
NAMES = [
    ("France", "Hôtel L’Étoile {w} SARL", "hotel l etoile {w} sarl", "hotel etoile {w}", "sarl", "", "", "he{i}", False),
    ("France", "{w} & Fils S.A.S.", "{w} and fils sas", "{w} fils", "sas", "", "", "{i}f", False),
    ("India", "राम {w} प्राइवेट लिमिटेड", "ram {w} private limited", "ram {w}", "limited private", "", "", "r{i}", True),
    ("India", "Sri {w} Engg. Works Pvt. Ltd.", "sri {w} engineering works pvt ltd", "sri {w} engineering works", "ltd pvt", "", "", "s{i}ew", False),
    ("France", "{w} Bros d/b/a Café de la Paix", "{w} brothers", "{w} brothers", "", "cafe paix", "", "{i}b", False),
    ("U.S.A.", "The {w} Co. of 1st & 22nd St Inc", "the {w} co of 1st and 22nd st inc", "{w} co 1st 22nd st", "inc", "", "1 22", "{i}c12s", False),
    ("US", "{w} 007 Labs Ltd trading as O'Neil's 24+7", "{w} 007 laboratories ltd", "{w} 007 laboratories", "ltd", "oneils 24 7", "7", "{i}0l", False),
    ("US", "Ltd", "ltd", "ltd", "ltd", "", "", "", False),
    ("US", "and Co", "and co", "and co", "co", "", "", "ac", False),
    ("Bharat", "S B I {w} Bank", "sbi {w} bank", "sbi {w} bank", "", "", "", "s{i}b", False),
    ("République française", "Société {w} et Cie", "societe {w} et cie", "{w}", "cie societe", "", "", "", False),
    ("United States", "½ Price № 5 {w}", "1 2 price no 5 {w}", "1 2 price no 5 {w}", "", "", "1 2 5", "12pn5{i}", False),
    ("usa", "Ｆｕｌｌ Ｗｉｄｔｈ {w} ＬＬＣ", "full width {w} llc", "full width {w}", "llc", "", "", "fw{i}", False),
    ("Germany", "Müller & Söhne GmbH {w}", "muller and sohne gmbh {w}", "muller sohne gmbh {w}", "", "", "", "msg{i}", False),
    ("", "", "", "", "", "", "", "", False),
    ("IN", "पीके {w} ट्रेडर्स प्रा. लि.", "pike {w} tredars private limited", "pike {w} tredars", "limited private", "", "", "p{i}t", True),
]
NAME_COLUMNS = ["name_clean", "name_core", "legal", "dba_core", "name_nums"]

#: country, raw address, then bc, addr_core, house_nums, units, landmark, postal, region.
ADDRESSES = [
    ("USA", "1 {w} St Ste 040B, Springfield, West Virginia 62704-1234", "us", "{w} street springfield west va", "1", "40b", "", "62704", "va"),
    ("US", "742 N 5th Ave Apt #12 near {w} Hall, Austin, TX 78701", "us", "north avenue austin tx", "5 742", "12", "near {w} hall", "78701", "tx"),
    ("India", "12/4, M G Road, near {w} Mall, Mumbai 400 001, Maharashtra", "in", "mg road mumbai maharashtra", "12 4", "", "near {w} mall", "400001", "maharashtra"),
    ("France", "BP 12 14 Rue de l'Église {w} 75001 Paris Cedex 04", "fr", "rue eglise {w} paris", "14", "", "", "75001", "75"),
    ("fr", "3 rue du {w}, Nouvelle-Aquitaine, Gironde", "fr", "rue {w}", "3", "", "", "", ""),
    ("Germany", "Unter {w} Linden 5, 10117 Berlin", "germany", "unter {w} linden berlin", "5", "", "", "10117", "10"),
    ("US", "12345 {w}", "us", "{w}", "12345", "", "", "", ""),
    ("India", "Flat No 7, Behind {w} Temple, Bangalore, Karnataka 560 034", "in", "bengaluru karnataka", "", "7", "behind {w} temple", "560034", "karnataka"),
    ("us", "PO Box 9 {w}, New York NY 10001", "us", "po box {w} ny ny", "9", "", "", "10001", "ny"),
    ("india", "S.No 12 {w}, Andhra Pradesh, near Lake", "in", "{w} andhrapradesh", "12", "", "near lake", "", "andhrapradesh"),
    ("Côte d'Ivoire", "", "cote d ivoire", "", "", "", "", "", ""),
    ("India", "{w} दिल्ली 110001", "in", "{w} delhi", "", "", "", "110001", "delhi"),
    ("France", "Apt 5, 10 bd St {w}, derrière la gare, 33 000 Bordeaux", "fr", "boulevard saint {w} bordeaux", "10", "5", "derriere la gare", "33000", "33"),
]
ADDRESS_COLUMNS = ["addr_core", "house_nums", "units", "landmark"]

#: Indic words and their Latin form.
SCRIPTS = [
    ("राम", "ram"), ("मार्केटिंग", "marketing"), ("प्राइवेट", "praivet"), ("लिमिटेड", "limited"), ("१२", "12"), ("दिल्ली", "dilli"), ("plain aa", "plain aa"),
    ("लक्ष्मी", "lakshmi"), ("कंपनी", "kanpani"), ("ट्रेडर्स", "tredars"), ("", ""),
]

#: Texts whose accents go.
ACCENTS = ["Hôtel L’Étoile", "ﬁn Ａ", "½ № ĳ ǆ Ⅷ ℡", "𝒳 Ça ø ß", "plain", "", "Ångström ﷺ", "한 è"]

#: Texts of administrative phrases, and without them.
ADMIN = [("bordeaux nouvelle aquitaine gironde", "bordeaux"), ("nantes pays loire loire atlantique", "nantes"), ("hauts de", "de"), ("nordic sea", "nordic sea"), ("lille nord passage calais", "lille"), ("", "")]

#: Texts with single letters, and with their runs joined.
LETTERS = [("s b i bank", "sbi bank"), ("m g road", "mg road"), ("a1 b c1", "a1 b c1"), ("a b c d", "abcd"), ("x", "x"), ("the a b of c", "the ab of c"), ("", "")]

#: Canonical legal words, and what they are made of.
LEGAL = [("pvt ltd", "limited private"), ("p ltd", "limited private"), ("pvtltd", "limited private"), ("inc", "incorporated"), ("co inc", "company incorporated"), ("sarl", "sarl"), ("", "")]


def _quoted(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def _sql(rows: list[tuple], columns: list[str], select: str) -> str:
    """select over `cased`: customers' numbers k with their word w, and the columns of their case."""
    values = ", ".join(f"({i}, {', '.join(map(_quoted, r))})" for i, r in enumerate(rows))
    words = ", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS))
    return f"WITH cased AS (SELECT c_custkey AS k, w, c.* FROM customer JOIN (VALUES {values}) c(i, {', '.join(columns)}) ON c_custkey % {len(rows)} = i JOIN (VALUES {words}) x(j, w) ON c_custkey % {len(WORDS)} = j)\n{select}"


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{w}}', w), '{{i}}', w[1:1]) AS {column}"


def cased(spark: SparkSession, sf_dir: str, rows: list[tuple], *columns: str) -> DataFrame:
    """(k, columns...) of all customers, of the first len(columns) values of their cases, with their words."""
    n = len(columns)
    table = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], f"i int, {', '.join(f'{c} string' for c in columns)}")
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("k") % len(WORDS) + 1).cast("int"))
    return k.join(F.broadcast(table), F.col("k") % len(rows) == F.col("i")).select("k", *(F.replace(c, F.lit("{w}"), word).alias(c) for c in columns))


def names(s: SparkSession, d: str) -> DataFrame:
    """N3-N6, N8-N10, T2-T6: all views of the name cases."""
    raw = cased(s, d, NAMES, "country", "business_name").withColumn("cc", T.country_code(F.col("country")))
    return T.with_name(raw).select("k", *(F.array_join(c, " ").alias(c) for c in NAME_COLUMNS), "name_acr", "name_indic")


def addresses(s: SparkSession, d: str) -> DataFrame:
    """A1-A10, T3, T7, T13: all views of the address cases."""
    raw = cased(s, d, ADDRESSES, "country", "business_address").withColumn("business_name", F.lit(""))
    return T.normalise(raw).select("k", "bc", *(F.array_join(c, " ").alias(c) for c in ADDRESS_COLUMNS), "postal", "region")


def accents(s: SparkSession, d: str) -> DataFrame:
    return cased(s, d, [(x,) for x in ACCENTS], "raw").select("k", T.strip_accents(F.col("raw")).alias("folded"))


def scripts(s: SparkSession, d: str) -> DataFrame:
    return cased(s, d, SCRIPTS, "raw").select("k", T.has_indic(F.col("raw")).alias("indic"), T.transliterate(F.col("raw")).alias("latin"))


def admin(s: SparkSession, d: str) -> DataFrame:
    return cased(s, d, ADMIN, "raw").select("k", T.strip_admin(F.col("raw")).alias("kept"))


def letters(s: SparkSession, d: str) -> DataFrame:
    return cased(s, d, LETTERS, "raw").select("k", T.join_single_letters(F.col("raw")).alias("t"))


def legal(s: SparkSession, d: str) -> DataFrame:
    rows = cased(s, d, LEGAL, "raw").withColumn("canon", T.canonical_legal(T.words(F.col("raw"))))
    return rows.select("k", F.array_join("canon", " ").alias("canon"), T.legal_code(F.col("canon")).alias("code"))


def _folded(x: str) -> str:
    return "".join(c if "가" <= c <= "힣" else "".join(f for f in unicodedata.normalize("NFKD", c) if not unicodedata.combining(f)) for c in x)


#: name -> (query, SQL).
CASES = {
    "n3_n10_name_cases": (names, _sql(NAMES, ["country", "raw", *NAME_COLUMNS, "name_acr", "name_indic"], f"SELECT k, {', '.join(map(_filled, [*NAME_COLUMNS, 'name_acr']))}, name_indic FROM cased")),
    "a1_a10_address_cases": (addresses, _sql(ADDRESSES, ["country", "raw", "bc", *ADDRESS_COLUMNS, "postal", "region"], f"SELECT k, bc, {', '.join(map(_filled, ADDRESS_COLUMNS))}, postal, region FROM cased")),
    "t1_strip_accents": (accents, _sql([(x, _folded(x)) for x in ACCENTS], ["raw", "folded"], "SELECT k, folded FROM cased")),
    "n1_n2_transliterate": (scripts, _sql([(*x, x[0] != x[1]) for x in SCRIPTS], ["raw", "latin", "indic"], "SELECT k, indic, latin FROM cased")),
    "t13_strip_admin": (admin, _sql(ADMIN, ["raw", "kept"], "SELECT k, kept FROM cased")),
    "t5_join_single_letters": (letters, _sql(LETTERS, ["raw", "t"], "SELECT k, t FROM cased")),
    "n11_n12_legal_codes": (legal, _sql([(*x, str(zlib.crc32(x[1].encode()) % 100003) if x[1] else "") for x in LEGAL], ["raw", "canon", "code"], "SELECT k, canon, try_cast(code AS DOUBLE) AS code FROM cased")),
}
