"""Text normalisation of business records as native column expressions.

Everything stays in the JVM: token lists are blank-joined strings while regular expressions work on them and
arrays where items are looked up. `cc` is a column with a country code; where a rule depends on it, it is a CASE.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import dictionaries as D

_INDIC = f"[\\u{D.INDIC_FIRST:04x}-\\u{D.INDIC_LAST:04x}]"


#: Composed Hangul syllables: no letter of theirs is Latin, so tokens never hold them.
HANGUL = range(0xAC00, 0xD7A4)


@lru_cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """By rule, over all characters: those whose compatibility decomposition without combining marks is one other character and that
    one (marks by themselves, which leave nothing, come last and have none), and those for which it is several."""
    single, marks, several = {}, [], {}
    for ch in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if folded == ch or ord(ch) in HANGUL:
            continue
        if len(folded) == 1:
            single[ch] = folded
        elif folded:
            several[ch] = folded
        else:
            marks.append(ch)
    return "".join([*single, *marks]), "".join(single.values()), several


def strip_accents(c: Column) -> Column:
    """T1. Compatibility decomposition without combining marks; Hangul syllables stay composed.

    Plain ASCII is left alone; letters that become several are looked up one by one where a text has any.
    """
    single, to, several = _folds()
    table = F.map_from_arrays(F.split(F.lit("\n".join(several)), "\n"), F.split(F.lit("\n".join(several.values())), "\n"))
    letters = F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), 1), lambda x: F.coalesce(F.try_element_at(table, x), x))
    spread = F.when(c.rlike(f"[{''.join(several)}]"), F.array_join(letters, "")).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(spread, single, to)).otherwise(c)


def clean(c: Column) -> Column:
    """Lower case, no accents, runs of anything but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def country_code(label: Column) -> Column:
    """T2. us, in, fr, or other."""
    return F.coalesce(lookup(D.COUNTRIES, clean(label)), F.lit("other"))


def block_country(label: Column) -> Column:
    """T3. The code if known, else the cleaned label, else `unknown`."""
    cc = country_code(label)
    return F.when(cc != "other", cc).otherwise(F.coalesce(F.nullif(clean(label), F.lit("")), F.lit("unknown")))


def literal_map(table: dict[str, str]) -> Column:
    """A map column of fixed values, parsed from one expression."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + ")")


def lookup(table: dict[str, str], key: Column) -> Column:
    """table[key], null where it has no such key."""
    return F.try_element_at(literal_map(table), key)


def words(c: Column) -> Column:
    """Array of the blank-separated tokens; none for an empty string."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def joined(a: Column) -> Column:
    return F.array_join(a, " ")


def join_single_letters(c: Column) -> Column:
    """T5. Runs of two or more single letters become one token."""
    return F.regexp_replace(c, r"(?<=(?<!\S)[a-z]) (?=[a-z](?!\S))", "")


def basic_tokens(c: Column, cc: Column) -> Column:
    """T4. The cleaned tokens, blank-joined: French elisions split, apostrophes dropped, & and + spelt out, single letters joined."""
    return cleaned_tokens(strip_accents(F.lower(F.coalesce(c, F.lit("")))), cc)


def cleaned_tokens(folded: Column, cc: Column) -> Column:
    """basic_tokens of text that is lower-cased and without accents, though letters that these gave may be capital; the pattern of
    elisions matches nothing outside France."""
    s = F.regexp_replace(F.lower(folded), F.when(cc == "fr", F.lit(r"\b([ldjmnst])['’]")).otherwise(F.lit(r"(?!)()")), F.lit("$1 "))
    s = F.regexp_replace(F.regexp_replace(s, "['’`]", ""), "[&+]", " and ")
    return join_single_letters(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def expand(tokens: Column, common: dict[str, str], cc: Column, own: dict[str, dict[str, str]]) -> Column:
    """T6. Each token of an array through the table of its country over the common one."""
    table = literal_map(common)
    for k, extra in own.items():
        table = F.when(cc == k, literal_map({**common, **extra})).otherwise(table)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def replace_phrases(c: Column, table: dict[str, str]) -> Column:
    """T7. Each phrase of the table, in its order, as whole words; of single words only those of four letters or more.

    A text that has none of them, as most have, is told by one pattern and passes unchanged.
    """
    phrases = [k for k in table if " " in k or len(k) >= 4]
    out = c
    for phrase in phrases:
        out = F.regexp_replace(out, rf"\b{phrase}\b", table[phrase])
    return F.when(c.rlike(rf"\b(?:{'|'.join(phrases)})\b"), out).otherwise(c)


def prefixed(tokens: Column, p: str) -> Column:
    """T8."""
    return F.transform(tokens, lambda t: F.concat(F.lit(p), t))


def bigrams(tokens: Column, ordered: bool = True) -> Column:
    """T9. Neighbouring tokens as a|b, each pair sorted unless ordered."""
    pair = lambda t, i: F.slice(tokens, i + 1, 2)
    pairs = F.filter(F.transform(tokens, pair), lambda p: F.size(p) == 2)
    return F.transform(pairs, lambda p: F.array_join(p if ordered else F.array_sort(p), "|"))


def tagged(tokens: Column, region: Column) -> Column:
    """T10. tok@region; none without a region."""
    return F.when(region != "", F.transform(tokens, lambda t: F.concat(t, F.lit("@"), region))).otherwise(F.array().cast("array<string>"))


def run_together(tokens: Column) -> Column:
    """T11. `=` and the tokens written without blanks, web suffixes left out."""
    t = F.filter(tokens, lambda x: ~x.isin("com", "www", "net", "org"))
    two = F.when(F.size(t) >= 2, F.concat(F.lit("="), F.array_join(F.slice(t, 1, 2), "")))
    every = F.when(F.size(t) >= 3, F.concat(F.lit("="), F.array_join(t, "")))
    one = F.when((F.size(t) == 1) & (F.length(F.try_element_at(t, F.lit(1))) >= 6), F.concat(F.lit("="), F.try_element_at(t, F.lit(1))))
    return F.array_compact(F.array(two, every, one))


def number_tokens(house: Column, units: Column) -> Column:
    """T12. #n of every house and unit number, and #nnn for the longer ones."""
    return F.flatten(F.transform(F.concat(house, units), lambda n: F.when(F.length(n) >= 4, F.array(F.concat(F.lit("#"), n), F.concat(F.lit("#"), F.substring(n, 1, 3)))).otherwise(F.array(F.concat(F.lit("#"), n)))))


def strip_admin(c: Column) -> Column:
    """T13. Without the French administrative phrases (whole tokens, left to right)."""
    gone = F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), f" (?:{'|'.join(D.FR_ADMIN)})(?= )", "")
    return F.trim(gone)


def has_indic(c: Column) -> Column:
    """N1."""
    return F.coalesce(c, F.lit("")).rlike(_INDIC)


@lru_cache
def _indic() -> tuple[str, str]:
    """Every Indic code point and the Devanagari one at its place in the block."""
    own = [chr(k) for k in range(D.INDIC_FIRST + 0x80, D.INDIC_LAST + 1)]
    return "".join(own), "".join(chr(D.INDIC_FIRST + (ord(ch) & 0x7F)) for ch in own)


def _placed(table: dict[int, str]) -> dict[str, str]:
    return {chr(D.INDIC_FIRST + at): latin for at, latin in table.items()}


def transliterate(c: Column) -> Column:
    """N2. Indic scripts to Latin: blocks laid over one another, the inherent `a` before a consonant or nasal, then letter by letter.

    A consonant's `a` is heard only when a consonant or nasal follows directly, ignored marks aside, so a look-ahead
    finds it; vowel signs, the virama, vowels, digits and the end of a word all silence it.
    """
    consonants, nasals = _placed(D.INDIC_CONSONANTS), _placed(D.INDIC_NASALS)
    letters = {**consonants, **nasals, **_placed(D.INDIC_VOWELS), **_placed(D.INDIC_SIGNS)}
    letters |= {chr(D.INDIC_FIRST + D.INDIC_DIGITS + i): str(i) for i in range(10)}
    ignored = "".join(chr(D.INDIC_FIRST + i) for i in D.INDIC_IGNORED)
    s = F.translate(F.translate(c, "‌‍", ""), *_indic())
    s = F.translate(s, ignored, "")
    s = F.regexp_replace(s, f"([{''.join(consonants)}])(?=[{''.join({**consonants, **nasals})}])", "$1a")
    s = F.translate(s, chr(D.INDIC_FIRST + D.INDIC_VIRAMA), "")
    short = {k: v for k, v in letters.items() if len(v) == 1}
    s = F.translate(s, "".join(short), "".join(short.values()))
    for k, v in letters.items():
        if len(v) > 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    s = F.regexp_replace(s, _INDIC, " ")
    for a, b in D.INDIC_COLLAPSE:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.when(has_indic(c), s).otherwise(c)


_LEGAL = "|".join(t for row in D.LEGAL.values() for t in row)


def with_core(df: DataFrame, text: str, p: str) -> DataFrame:
    """N4, N5, N6. From folded text in a column (with cc and name_indic): arrays {p}tokens, {p}core and {p}legal.

    Legal forms, and `and`, come off the end, then legal forms off the start; the core leaves out stopwords, unless nothing is left. Each
    step is a column of its own: expressions used twice would be computed twice.
    """
    cc, c = F.col("cc"), lambda n: F.col(f"__{p}{n}")
    steps = {
        f"__{p}a": words(cleaned_tokens(F.col(text), cc)),
        f"__{p}b": expand(c("a"), D.NAME_COMMON, cc, {"fr": D.NAME_FR}),
        f"{p}tokens": F.when(F.col("name_indic"), F.transform(c("b"), lambda t: F.coalesce(lookup(D.NAME_INDIC, t), t))).otherwise(c("b")),
        f"__{p}s": F.array_join(F.transform(f"{p}tokens", lambda t: F.concat(F.lit(" "), t)), ""),
        f"__{p}tail": F.regexp_extract(c("s"), f"((?: (?:{_LEGAL}|and))*)$", 1),
        f"__{p}rest": F.substring(c("s"), F.lit(1), F.length(c("s")) - F.length(c("tail"))),
        f"__{p}head": F.regexp_extract(c("rest"), f"^((?: (?:{_LEGAL})(?= |$))*)", 1),
        f"__{p}left": words(F.substring(c("rest"), F.length(c("head")) + 1, F.length(c("rest")))),
        f"{p}legal": F.array_sort(F.array_distinct(F.filter(words(F.concat(c("tail"), c("head"))), lambda t: t != "and"))),
        f"__{p}kept": F.filter(c("left"), lambda t: ~t.isin(D.NAME_STOPWORDS)),
        f"{p}core": F.when(F.size(c("kept")) > 0, c("kept")).when(F.size(c("left")) > 0, c("left")).otherwise(F.col(f"{p}tokens")),
    }
    for name, value in steps.items():
        df = df.withColumn(name, value)
    return df.drop(*(n for n in steps if n.startswith("__")))


def skeleton(c: Column) -> Column:
    """N7. The consonant skeleton of each token of a blank-joined string."""
    s = F.regexp_replace(F.regexp_replace(c, "c(?=[eiy])", "s"), "c(?!h)", "k")
    for a, b in D.SKELETON:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"(?<=\S)[aeiouy]", "")
    return F.regexp_replace(s, r"(\S)\1+", "$1")


def numbers(tokens: Column, longest: int | None = None) -> Column:
    """N9, A7. Distinct digit runs of the tokens (of at most `longest` digits) without leading zeros, sorted as strings."""
    found = F.regexp_extract_all(joined(tokens), F.lit(r"(\d+)"), 1)
    found = found if longest is None else F.filter(found, lambda n: F.length(n) <= longest)
    return F.array_sort(F.array_distinct(F.transform(found, _no_zeros)))


def _no_zeros(n: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(n, "^0+", ""), F.lit("")), F.lit("0"))


def acronym(core: Column) -> Column:
    """N10."""
    return F.when(F.size(core) >= 2, F.array_join(F.transform(core, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def canonical_legal(legal: Column) -> Column:
    """N11."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(legal, lambda t: F.split(F.coalesce(lookup(D.LEGAL_CANON, t), t), " ")))))


def legal_code(canon: Column) -> Column:
    """N12. A number for the canonical legal form; null without one."""
    return F.when(F.size(canon) > 0, (F.crc32(joined(canon).cast("binary")) % 100003).cast("double"))


def folded(df: DataFrame, source: str, name: str) -> DataFrame:
    """Adds `name`: the source text in Latin script, lower case and without accents."""
    df = df.withColumn(name, F.coalesce(source, F.lit("")))
    df = df.withColumn(name, transliterate(F.col(name)))
    df = df.withColumn(name, F.lower(name))
    return df.withColumn(name, strip_accents(F.col(name)))


def with_name(df: DataFrame) -> DataFrame:
    """N8. Adds name_clean, name_core, legal, dba_core, name_skel, name_nums (arrays), name_acr and name_indic from business_name and cc."""
    df = folded(df.withColumn("name_indic", has_indic(F.col("business_name"))), "business_name", "__n")
    df = df.withColumn("__parts", F.split("__n", D.DBA, 2))
    df = df.withColumns({"__main": F.element_at("__parts", 1), "__dba": F.coalesce(F.try_element_at("__parts", F.lit(2)), F.lit(""))})
    df = with_core(with_core(df, "__main", "main_"), "__dba", "dba_")
    df = df.withColumns({"name_clean": F.col("main_tokens"), "name_core": F.col("main_core"), "legal": F.col("main_legal")})
    out = {"name_skel": words(skeleton(joined(F.col("name_core")))), "name_nums": numbers(F.col("name_core")), "name_acr": acronym(F.col("name_core"))}
    return df.withColumns(out).drop("__n", "__parts", "__main", "__dba", "main_tokens", "main_core", "main_legal", "dba_tokens", "dba_legal")


def with_postal(df: DataFrame, text: str, cc: str = "cc") -> DataFrame:
    """A2. Adds postal, and takes its span out of `text`: the last match of the country's pattern, unless it is the only one
    and starts in the first three tenths, as a house number does."""
    whole, kind = F.col(text), F.coalesce(*(F.when(F.col(cc) == k, F.lit(k)) for k in D.POSTAL if k != "other"), F.lit("other"))
    pattern = F.coalesce(*(F.when(kind == k, F.lit(p)) for k, p in D.POSTAL.items()))
    df = df.withColumn("__pattern", pattern).withColumn("__every", F.regexp_extract_all(whole, F.col("__pattern"), F.lit(0)))
    df = df.withColumn("__last", F.try_element_at("__every", F.lit(-1)))
    df = df.withColumn("__after", F.element_at(F.split(whole, F.col("__pattern"), F.lit(-1)), -1))
    df = df.withColumn("__start", F.length(whole) - F.length("__after") - F.length("__last"))
    good = (F.size("__every") > 1) | ((F.size("__every") == 1) & (F.col("__start") >= F.length(whole) * 0.3))
    df = df.withColumn("__good", F.coalesce(good, F.lit(False)))
    code = F.when(kind == "us", F.substring("__last", 1, 5)).otherwise(F.regexp_replace("__last", r"\s", ""))
    rest = F.concat(F.substring(whole, F.lit(1), F.col("__start")), F.lit(" "), F.col("__after"))
    df = df.withColumns({"postal": F.when(F.col("__good"), code).otherwise(""), text: F.when(F.col("__good"), rest).otherwise(whole)})
    return df.drop("__pattern", "__every", "__last", "__after", "__start", "__good")


def with_address(df: DataFrame, fr_admin: bool = True) -> DataFrame:
    """A9. Adds addr_clean, addr_core, house_nums, units, landmark (arrays) and postal from business_address and cc."""
    cc = F.col("cc")
    df = folded(df, "business_address", "__t")
    df = with_postal(df.withColumn("__t", F.regexp_replace("__t", F.when(cc == "fr", F.lit(D.FR_POSTBOX)).otherwise(F.lit("(?!)")), F.lit(" "))), "__t")
    marks = F.regexp_extract_all("__t", F.lit(f"({D.LANDMARK})"), 1)
    df = df.withColumns({"landmark": F.flatten(F.transform(marks, lambda m: words(cleaned_tokens(m, cc)))), "__t": F.regexp_replace("__t", D.LANDMARK, " ")})
    units = F.regexp_extract_all("__t", F.lit(D.UNIT), 1)
    df = df.withColumns({"units": F.array_sort(F.array_distinct(F.transform(units, _no_zeros))), "__t": F.regexp_replace("__t", D.UNIT, " ")})
    states = F.when(cc == "us", replace_phrases(F.col("__t"), D.US_STATES)).when(cc == "in", replace_phrases(F.col("__t"), D.IN_STATES)).otherwise(F.col("__t"))
    df = df.withColumn("__t", states)
    df = df.withColumn("__a", words(cleaned_tokens(F.col("__t"), cc)))
    df = df.withColumn("__a", expand(F.col("__a"), D.ADDRESS_COMMON, cc, {"us": D.ADDRESS_US, "in": D.ADDRESS_IN, "fr": D.ADDRESS_FR}))
    df = df.withColumn("addr_clean", F.when(cc == "in", F.transform("__a", lambda t: F.coalesce(lookup(D.IN_STATES, t), t))).otherwise(F.col("__a")))
    core = F.filter("addr_clean", lambda t: (F.length(t) > 1) & ~t.rlike("[0-9]") & ~t.isin(D.ADDRESS_STOPWORDS))
    df = df.withColumns({"house_nums": numbers(F.col("addr_clean"), 6), "addr_core": core})
    if fr_admin:
        df = df.withColumn("addr_core", F.when(cc == "fr", words(strip_admin(joined(F.col("addr_core"))))).otherwise(F.col("addr_core")))
    return df.drop("__t", "__a")


def region(bc: Column, raw: Column, core: Column, postal: Column) -> Column:
    """A10. The US state, the Indian state, else the first two digits of the postcode, else nothing."""
    up = F.upper(F.coalesce(raw, F.lit("")))
    codes = F.filter(F.transform(F.regexp_extract_all(up, F.lit("(?<![A-Z])([A-Z]{2})(?![A-Z])"), 1), F.lower), lambda c: c.isin(*D.US_STATES.values()))
    named = F.coalesce(*(F.when(F.contains(up, F.lit(full.upper())), short) for full, short in D.US_STATES.items()))
    us = F.coalesce(F.try_element_at(codes, F.lit(-1)), named)
    states = F.filter(core, lambda t: t.isin(sorted({*D.IN_STATES.values(), *D.IN_REGIONS})))
    own = F.when(bc == "us", us).when(bc == "in", F.try_element_at(states, F.lit(-1)))
    return F.coalesce(own, F.substring(postal, 1, 2))


def normalise(records: DataFrame, fr_admin: bool = True) -> DataFrame:
    """A11. All views of records (entity_id, business_name, business_address, country, and any other columns)."""
    df = records.withColumns({"cc": country_code(F.col("country")), "bc": block_country(F.col("country"))})
    df = with_address(with_name(df), fr_admin)
    df = df.withColumn("region", region(F.col("bc"), F.col("business_address"), F.col("addr_core"), F.col("postal")))
    return df
