"""DuckDB SQL of the linkage operators, as common table expressions over the derived business records.

The records' words and addresses are few and plain, so normalisation needs only the rules that they meet.
"""

from __future__ import annotations

import re

from kinlink.functions import dictionaries as D
from kinlink.sources.fixtures import RECORDS, SCORED, TRUTH

K, MAX_DF, MAX_K = 60, 20_000, 25


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _skeleton(t: str) -> str:
    s = f"replace(replace(replace(regexp_replace({t}, 'c([eiy])', 's\\1', 'g'), 'ch', '#'), 'c', 'k'), '#', 'ch')"
    for a, b in D.SKELETON:
        s = f"replace({s}, '{a}', '{b}')"
    return s


def _collapse(s: str) -> str:
    for ch in "bcdfghjklmnpqrstvwxzaeiouy":
        s = f"regexp_replace({s}, '{ch}{ch}+', '{ch}', 'g')"
    return s


_LEGAL = _list([t for row in D.LEGAL.values() for t in row])

NORM = f"""
tokens AS (
  SELECT *, CASE country WHEN 'US' THEN 'us' WHEN 'India' THEN 'in' ELSE 'fr' END AS bc,
         list_filter(string_split(lower(business_name), ' '), lambda t: t <> '') AS name_clean,
         list_filter(string_split(regexp_replace(lower(business_address), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS raw_addr
  FROM biz),
expanded AS (
  SELECT *, list_filter(name_clean, lambda t: NOT list_contains({_LEGAL}, t)) AS core,
         list_sort(list_distinct(list_filter(name_clean, lambda t: list_contains({_LEGAL}, t)))) AS legal,
         list_transform(raw_addr, lambda t: CASE WHEN t = 'st' AND bc = 'fr' THEN 'saint' WHEN t = 'st' THEN 'street' WHEN t = 'fl' AND bc <> 'fr' THEN 'floor' ELSE t END) AS addr_clean
  FROM tokens),
skeletons AS (
  SELECT *, list_transform(core, lambda t: {_skeleton('t')}) AS sk FROM expanded),
norm AS (
  SELECT src, entity_id, business_name, business_address, country, bc, name_clean, core, legal, addr_clean,
         list_transform(list_transform(sk, lambda t: t[1:1] || regexp_replace(t[2:], '[aeiouy]', '', 'g')), lambda t: {_collapse('t')}) AS skel,
         CASE WHEN len(core) >= 2 THEN array_to_string(list_transform(core, lambda t: t[1:1]), '') ELSE '' END AS acr,
         list_filter(addr_clean, lambda t: len(t) > 1 AND NOT regexp_matches(t, '[0-9]') AND NOT list_contains({_list(D.ADDRESS_STOPWORDS)}, t)) AS acore,
         list_sort(list_distinct(list_filter(addr_clean, lambda t: regexp_matches(t, '^[0-9]+$')))) AS house,
         CASE WHEN bc = 'us' AND regexp_matches(business_address, ' [A-Z][A-Z]$') THEN lower(right(business_address, 2)) ELSE '' END AS region
  FROM skeletons)
"""


def _pairs(a: str, ordered: bool) -> str:
    pair = f"{a}[i] || '|' || {a}[i + 1]" if ordered else f"least({a}[i], {a}[i + 1]) || '|' || greatest({a}[i], {a}[i + 1])"
    return f"list_transform(range(1, greatest(len({a}), 1)), lambda i: {pair})"


DOCS = f"""
parts AS (
  SELECT src, bc, entity_id AS id,
         list_concat(list_concat(list_concat(core, list_transform(skel, lambda t: '~' || t)), list_concat({_pairs('core', False)},
           list_concat(CASE WHEN len(core) >= 2 THEN ['=' || core[1] || core[2]] WHEN len(core) = 1 AND len(core[1]) >= 6 THEN ['=' || core[1]] ELSE [] END, CASE WHEN len(core) >= 3 THEN ['=' || array_to_string(core, '')] ELSE [] END))),
           CASE WHEN region <> '' THEN list_concat(list_transform(core, lambda t: t || '@' || region), list_transform(skel, lambda t: '~' || t || '@' || region)) ELSE [] END) AS n,
         list_concat(list_concat(acore, flatten(list_transform(house, lambda h: CASE WHEN len(h) >= 4 THEN ['#' || h, '#' || h[1:3]] ELSE ['#' || h] END))), {_pairs('acore', True)}) AS a
  FROM norm),
docs AS (
  SELECT 'name' AS view, bc, id, src, n AS tokens FROM parts UNION ALL SELECT 'addr', bc, id, src, a FROM parts
  UNION ALL SELECT 'name_addr', bc, id, src, list_concat(n, a) FROM parts)
"""

POSTINGS = f"""
counts AS (SELECT view, bc, id, src, tok, count(*) AS tf FROM (SELECT view, bc, id, src, unnest(tokens) AS tok FROM docs) GROUP BY ALL),
totals AS (SELECT view, bc, count(*) AS n FROM docs GROUP BY ALL),
idf AS (SELECT view, bc, tok, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT view, bc, tok, count(*) AS df FROM counts GROUP BY ALL) JOIN totals USING (view, bc) WHERE df BETWEEN 2 AND {MAX_DF}),
raw AS (SELECT view, bc, id, src, tok, (1 + ln(tf)) * idf AS r FROM counts JOIN idf USING (view, bc, tok)),
post AS (SELECT view, bc, id, src, tok, r / sqrt(sum(r * r) OVER (PARTITION BY view, bc, id)) AS w FROM raw)
"""

TOPK = f"""
sims AS (
  SELECT a.view, a.bc, a.id AS s1, b.id AS cand, round(sum(a.w * b.w), 6) AS sim FROM post a JOIN post b USING (view, bc, tok)
  WHERE a.src = 1 AND b.src <> 1 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY view, bc, s1 ORDER BY sim DESC, cand) AS rank FROM sims WHERE sim >= 0.1),
found AS (SELECT * FROM placed WHERE rank <= {K})
"""

UNION = f"""
seen AS (
  SELECT bc, s1, cand, count(*)::INT AS n_retr, coalesce(max(rank) FILTER (view = 'name'), {K + 1})::INT AS rank_name,
         coalesce(max(rank) FILTER (view = 'addr'), {K + 1})::INT AS rank_addr, coalesce(max(rank) FILTER (view = 'name_addr'), {K + 1})::INT AS rank_name_addr
  FROM found GROUP BY bc, s1, cand),
joined AS (
  SELECT s.*, coalesce(max(sim) FILTER (view = 'name'), 0) AS sim_name, coalesce(max(sim) FILTER (view = 'addr'), 0) AS sim_addr,
         coalesce(max(sim) FILTER (view = 'name_addr'), 0) AS sim_name_addr
  FROM seen s LEFT JOIN sims USING (bc, s1, cand) GROUP BY ALL),
scores AS (SELECT *, round((sim_name + sim_addr + sim_name_addr) / 3, 6) AS prune_score FROM joined),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bc, s1 ORDER BY prune_score DESC, cand) AS prune_rank FROM scores) WHERE prune_rank <= {MAX_K})
"""

HOP = f"""
anchors AS (SELECT bc, s1, cand AS anchor FROM kept WHERE prune_rank <= 3 AND sim_name_addr >= 0.6),
pool AS (
  SELECT a.view, a.bc, a.id AS anchor, b.id AS cand, round(sum(a.w * b.w), 6) AS sim FROM post a JOIN post b USING (view, bc, tok)
  WHERE a.src <> 1 AND b.src <> 1 AND a.id IN (SELECT anchor FROM anchors) GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view, bc, anchor ORDER BY sim DESC, cand) AS n FROM pool WHERE sim >= 0.5) WHERE n <= 8 AND anchor <> cand),
hops AS (SELECT bc, s1, cand, max(sim) AS hop_best FROM anchors JOIN near USING (bc, anchor) GROUP BY ALL),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bc, s1 ORDER BY hop_best DESC, cand) AS n FROM hops h WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.s1 = h.s1 AND k.cand = h.cand)) WHERE n <= 5)
"""

PREPARED = """
best AS (SELECT *, CASE WHEN p < max(p) OVER (PARTITION BY cand) THEN 0.0::DOUBLE ELSE p END AS pa FROM scored),
lined AS (SELECT *, row_number() OVER w AS place, first_value(pa) OVER w AS top_p, first_value(cand_src) OVER w AS top_src FROM best WINDOW w AS (PARTITION BY s1 ORDER BY pa DESC, cand)),
prepared AS (
  SELECT s1, cand, cand_src, p, pa, place, top_p, place = 1 AS is_top,
         cand_src <> top_src AND place = min(place) FILTER (cand_src <> top_src) OVER (PARTITION BY s1) AS is_other_best FROM lined)
"""

CHOSEN = """
chosen AS (SELECT * FROM prepared WHERE top_p >= 0.55 AND pa > 0 AND (is_top OR (is_other_best AND pa >= 0.8) OR pa >= 0.75)),
hits AS (SELECT s1, count(*) AS n_pred, count(t.cand) AS tp FROM chosen c LEFT JOIN truth t USING (s1, cand) GROUP BY s1),
counted AS (
  SELECT o.s1, o.bc, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_truth, 0) AS n_truth FROM ones o LEFT JOIN hits USING (s1)
  LEFT JOIN (SELECT s1, count(*) AS n_truth FROM truth GROUP BY s1) USING (s1)),
entities AS (
  SELECT *, CASE WHEN n_pred = 0 AND n_truth = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE
         ELSE 1.25::DOUBLE * (tp / n_pred) * (tp / n_truth) / (0.25::DOUBLE * (tp / n_pred) + tp / n_truth) END AS f FROM counted)
"""



def again(sql: str, thresholds: tuple[float, float, float]) -> str:
    """The expressions of CHOSEN and what builds on it once more, for other thresholds, under names with a 2."""
    for old, new in zip(("0.55", "0.8)", "0.75"), (f"{thresholds[0]}", f"{thresholds[1]})", f"{thresholds[2]}")):
        sql = sql.replace(old, new)
    return re.sub(r"\b(chosen|hits|counted|entities|flags|own|outcome)\b", r"\g<1>2", sql)


_SCORED = [RECORDS, TRUTH, SCORED, PREPARED]
_CHAIN = {"records": [RECORDS], "norm": [RECORDS, NORM], "docs": [RECORDS, NORM, DOCS], "post": [RECORDS, NORM, DOCS, POSTINGS]}
_CHAIN["found"] = [*_CHAIN["post"], TOPK]
_CHAIN["kept"] = [*_CHAIN["found"], UNION]
_CHAIN["hop"] = [*_CHAIN["kept"], HOP]
_CHAIN["truth"] = [RECORDS, TRUTH]
_CHAIN["kept_truth"] = [RECORDS, TRUTH, NORM, DOCS, POSTINGS, TOPK, UNION]
_CHAIN["norm_truth"] = [RECORDS, TRUTH, NORM]
_CHAIN["scored"] = _SCORED[:3]
_CHAIN["prepared"] = _SCORED
_CHAIN["chosen"] = [*_SCORED, CHOSEN]


def sql(upto: str, query: str, *more: str) -> str:
    """A query over the expressions that `upto` needs, with further ones after them."""
    return f"WITH {', '.join(part.strip() for part in (*_CHAIN[upto], *more))}\n{query}"
