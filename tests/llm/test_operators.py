"""Every corpus operator against brute force and its awkward inputs: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinlink.llm import chat, classify, common, components, decontaminate, embed, mixing, ppm, simhash, substring, suffixes, tokens, xxh

DOC = "doc_id long, text string"
random.seed(3)
WORDS = ["".join(random.choice("abcdefghijkl") for _ in range(random.randint(2, 7))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(random.choice(WORDS) for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, "  \t\n"), (4, "a"), (5, "É ñ 𝒳 ß"), (6, "a"), (7, "x" * 3000), (8, "Z " * 2000), (None, "null id text here"), (9, "\u0000 b")]


def rows(df):
    return [r.asDict() for r in df.collect()]


def clashing(spark, data, schema=DOC):
    """The same rows with columns whose names the operators use themselves."""
    names = "size score spans items kept n_words n_hit fp rep key taken __row __spans bucket label text2".split()
    return spark.createDataFrame(data, schema).withColumns({n: F.lit("own") for n in names})


# shared parts


def test_words_and_gather():
    buf, offsets = common.text_bytes(__import__("pyarrow").array(["ab  c", None, "", "d\te"]))
    s, e, d = common.word_spans(buf, offsets, ~common.SPACE)
    assert [bytes(buf[a:b]) for a, b in zip(s, e)] == [b"ab", b"c", b"d", b"e"] and d.tolist() == [0, 0, 3, 3]
    flat, at = common.gather(buf, s, e - s, gap=1)
    assert bytes(flat) == b"ab c d e " and at.tolist() == [0, 3, 5, 7]


def test_xxh64_equals_library():
    raw = [bytes(random.randrange(256) for _ in range(n)) for n in [*range(0, 100), 511, 512, 513, 700]]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(r) for r in raw])
    got = xxh.xxh64(buf, np.cumsum(lengths) - lengths, lengths, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(r, 42) for r in raw]


def test_components(spark):
    edges = [(5, 3), (3, 1), (9, 8), (8, 9), (4, 4), (None, 2), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)] + [(100, k) for k in range(101, 160)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 5: 1, 8: 8, 9: 8, **{k: 10 for k in range(10, 16)}, **{k: 100 for k in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = components.forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {5: 1, 3: 1, 9: 8}


# 1 embeddings


def brute_links(vectors, t=0.95):
    ids = [i for i, _ in vectors]
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in good}
    n = dict.fromkeys(ids, 0)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                n[i] += 1
                n[j] += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (n[i], top(i) if i in parent else i) for i in ids}


@pytest.mark.parametrize("block,slots", [(2048, 4 << 20), (8, 100)])
def test_embeddings_against_brute_force(spark, monkeypatch, block, slots):
    monkeypatch.setattr(embed, "BLOCK", block)
    monkeypatch.setattr(embed, "SLOTS", slots)
    monkeypatch.setattr(embed, "CHANCE", 16)
    embed.grouping.cache_clear()
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    data = [(k, (centres[k % 12] + rng.normal(size=24) * (0.05 + 0.3 * (k % 5))).tolist()) for k in range(240)]
    data += [(500, data[3][1]), (501, data[3][1]), (502, [2 * x for x in data[3][1]]), (503, None), (504, []), (505, [0.0] * 24), (506, [float("nan")] * 24), (507, [None, 1.0]), (508, [1.0, 0.0]), (509, [1.0, 0.01])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    want = brute_links(data)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert got == want


def test_embeddings_recall_at_the_dimension_of_the_table(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 64))
    w = v + rng.normal(size=v.shape) * (np.linalg.norm(v, axis=1) * 0.32 / 8)[:, None]  # cosines around 0.95
    x = np.concatenate([v, w])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.95).sum() - len(u)
    embed.grouping.cache_clear()
    data = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embed.near_duplicates(data).collect())
    assert want > 1000 and 0.99 * want <= got <= want


def test_embedding_work_grows_less_than_pairs():
    shares = [embed.grouping(64, 0.95, n) for n in (10**4, 10**6, 10**9)]
    assert all(a[1] * embed.CHANCE / n > b[1] * embed.CHANCE / m for a, b, n, m in zip(shares, shares[1:], (10**4, 10**6), (10**6, 10**9)))


def test_collision_windows_equal_their_definition():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (40, 32), dtype=np.uint8), rng.integers(0, 256, (50, 32), dtype=np.uint8)
    i, j = embed.collisions(a, b, 60, 14)
    near = (np.abs(a[:, None].astype(int) - b[None].astype(int)) <= 60).sum(axis=2) >= 14
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))
    near = (np.abs(a[:, None].astype(int) - a[None].astype(int)) <= 60).sum(axis=2) >= 14
    sizes = np.array([7, 1, 12, 20])
    cell = np.repeat(np.arange(4), sizes)
    i, j = embed.collisions_in(a, sizes, 60, 14)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted((x, y) for x, y in zip(*(x.tolist() for x in np.nonzero(near))) if x < y and cell[x] == cell[y])


def test_embeddings_awkward(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], "x"), (3, [1.0, 0.0], "x"), (3, [1.0, 0.0], "y")], "vec_id int, embedding array<float>, n string")
    got = sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(odd).collect())
    assert got == [(False, 1, 3, True), (False, 1, 3, True), (True, 0, None, True)]


# 2 substrings


def brute_removal(data, length):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in data]
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - length + 1):
                w = t[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_suffix_construction_sorts_and_counts_common_prefixes():
    for _ in range(60):
        letters = random.choice([b"ab", b"abcd", bytes(range(256))])
        texts = [bytes(random.choice(letters) for _ in range(random.randint(0, 25))) for _ in range(random.randint(1, 20))]
        lengths = np.array([len(t) for t in texts])
        string, depth, lcp = suffixes.build(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths, 6)
        got = [texts[s][len(texts[s]) - d :] for s, d in zip(string, depth)]
        assert got == sorted(t[i:] for t in texts for i in range(len(t) + 1))
        for a, b, n in zip(got, got[1:], lcp[1:]):
            k = 0
            while k < min(len(a), len(b), 6) and a[k] == b[k]:
                k += 1
            assert k == n


def test_suffix_columns_in_files(monkeypatch):
    texts = [bytes(random.choice(b"abc") for _ in range(30)) for _ in range(12)]
    lengths = np.full(12, 30)
    args = np.frombuffer(b"".join(texts), np.uint8), np.arange(12) * 30, lengths
    inside = suffixes.build(*args)
    monkeypatch.setattr(suffixes, "MEMORY_ROWS", 10)
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", 17)
    assert all((x == y).all() for x, y in zip(inside, suffixes.build(*args)))


@pytest.mark.parametrize("length", [50, 20])
def test_substrings_against_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(substring, "PIECE", 700)
    passages = [prose(15) for _ in range(6)]
    data = [(k, " ".join(random.choice([prose(random.randint(0, 25)), random.choice(passages)]) for _ in range(random.randint(0, 5)))) for k in range(80)]
    data += [(200, data[5][1]), (201, data[5][1] + "!"), (202, "ab" * 900), (203, "ab" * 300), (204, passages[0] * 9), *((i and i + 300, t) for i, t in AWKWARD)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove_repeats(spark.createDataFrame(data, DOC).repartition(3), length).collect()), key=str)
    assert got == brute_removal(data, length)


@pytest.mark.parametrize("length", [30, 50])
def test_substrings_where_one_side_repeats_its_last_line(spark, length):
    data = []
    for k in range(150):
        context, line = prose(random.randint(2, 12)), prose(random.randint(1, 5))[: random.randint(4, 34)] + "\n"
        pair = [context + " " + line * random.randint(2, 4), context + " " + line + prose(random.randint(0, 6))]
        random.shuffle(pair)
        data += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring.remove_repeats(spark.createDataFrame(data, DOC).repartition(3), length).collect()), key=str)
    assert got == brute_removal(data, length)


def test_substrings_send_a_row_for_a_bucket_whatever_the_number_of_batches():
    def batch(k):
        texts = [b"%06d " % (7 * k + i) * 20 + b"the very same line of more than fifty bytes that all of them have" for i in range(5)]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.arange(5 * k, 5 * k + 5)

    sieve = substring.Sieve(8, 1 << 20)
    sieve.bits = np.full(sieve.buckets * sieve.slots // 8, 255, np.uint8)
    batches = [batch(k) for k in range(9)]
    for parts, rows in (((substring.seen(b, o, 50, sieve) for b, o, _ in batches), substring.seen_rows), ((substring.bucketed(b, o, i, 50, sieve) for b, o, i in batches), substring.bucketed_rows)):
        sent = [x for rows in substring.held_back(parts, rows) for x in rows[0].to_pylist()]
        assert len(sent) == len(set(sent)) <= 8


def test_substrings_keep_text_and_columns(spark):
    p = prose(20)
    df = clashing(spark, [(1, p), (2, "start " + p + " end"), (3, None)])
    got = {r.doc_id: r for r in substring.remove_repeats(df, keep_text=True).collect()}
    assert got[2].kept == "start  end" and got[1].kept == p and got[3].kept is None and got[2].size == "own" and got[2].text.startswith("start")
    assert substring.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


# 3 prediction by partial matching


def brute_ppm(train, texts, order):
    code = lambda t: b" ".join((t or "").encode().translate(bytes(common.LOWER.tolist())).split()) + b"\xff"
    counts: dict = {}
    for t in train:
        s = b"\xfe" * order + code(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                own = counts.setdefault(s[i - k : i], {})
                own[s[i]] = own.get(s[i], 0) + 1

    def log(context, symbol):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            seen = counts.get(context[len(context) - k :] if k else b"")
            if seen is None:
                continue
            rest = {x: n for x, n in seen.items() if x not in gone}
            if rest:
                if symbol in rest:
                    return out + np.log10((rest[symbol] - 0.5) / sum(rest.values()))
                out += np.log10(len(rest) / 2 / sum(rest.values()))
            gone = set(seen)
        return out - np.log10(256 - len(gone))

    return [sum(log(s[i - order : i], s[i]) for i in range(order, len(s))) for s in (b"\xfe" * order + code(t) for t in texts)]


@pytest.mark.parametrize("entries,words", [(10**6, 10**6), (900, 10)])
def test_ppm_against_brute_force(spark, entries, words):
    data = [(k, prose(random.randint(0, 30))) for k in range(60)] + [(i and i + 100, t) for i, t in AWKWARD]
    held = [d for d in data if d[0] is None or zlib.crc32(str(d[0]).encode()) % 10 == 0]
    train = [d[1] for d in data if d not in held]
    df = spark.createDataFrame(data, DOC)
    got = {(r.doc_id): r for r in ppm.score(df, common.remainder(F.col("doc_id"), 10) != 0, entries=entries, words=words).collect()}
    low = lambda t: (t or "").encode().translate(bytes(common.LOWER.tolist())).decode()
    learned = [w for t in train for w in low(t).split()]
    n, v = len(learned) + len(train), len(set(learned)) + 1
    count = {w: learned.count(w) for w in set(learned)} | {None: len(train)}
    order = 5
    exact = brute_ppm(train, [t for _, t in data], order)
    for k, (i, t) in enumerate(data):
        if i is None:
            continue
        own = [*low(t).split(), None]
        assert got[i].n_tokens == len(own) and got[i].train_tokens == n and got[i].n_known == sum(count.get(w, 0) > 0 for w in own)
        assert got[i].base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert got[i].score == pytest.approx(exact[k], abs=1e-3)
        assert got[i].score < 0


@pytest.mark.parametrize("entries", [2000, 900, 60])
def test_ppm_keeps_its_order_beyond_the_broadcast_entries(spark, entries):
    data = [(k, prose(random.randint(0, 30))) for k in range(60)] + [(60, "zz qq"), (61, None), (62, "É ñ 𝒳 ß")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    exact = brute_ppm([t for i, t in data if not held(i)], [t for _, t in data], 5)
    got = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(data, DOC), common.remainder(F.col("doc_id"), 10) != 0, entries=entries).collect()}
    assert [got[i] for i, _ in data] == pytest.approx(exact, abs=1e-3)


def test_ppm_probabilities_sum_to_one():
    seq, at, _, _ = ppm.sequences(*common.text_bytes(__import__("pyarrow").array(["the cat", "the hat sat", "aé"])))
    grams, n = np.unique(ppm.keys(seq)[ppm.coded(at)], return_counts=True)
    trie = ppm.Trie(ppm.levels(grams, n, 5))
    for context in (b"\xfe" * 5, b"the c", b"he ha", b"zzzzz", b"at at"):
        base = np.uint64(int.from_bytes(context, "big") << 8)
        assert (10 ** trie.logs(base | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-5)


def test_ppm_no_rows_and_nothing_learned(spark):
    assert ppm.score(spark.createDataFrame([], DOC), F.lit(True)).count() == 0
    (r,) = ppm.score(spark.createDataFrame([(1, "ab")], DOC), F.lit(False)).collect()
    assert r.score == pytest.approx(-3 * np.log10(256)) and r.n_known == 0 and r.held_out


# 4 and 8 classifiers


def spoken(kind: str, n: int) -> str:
    stems = {"x": ["tion", "the", "ing", "er"], "y": ["ción", "de", "la", "os"], "z": ["ung", "der", "sch", "ei"]}[kind]
    return " ".join("".join(random.choice(stems) for _ in range(random.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    data = [(k, spoken("xyz"[k % 3], random.randint(5, 60)), "xyz"[k % 3]) for k in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    held = common.remainder(F.col("doc_id"), 3) == 1
    model = classify.fit(df, df.where(~held).select("doc_id", F.col("lang").alias("label")), classify.LANGUAGE, 100)
    got = classify.predict_language(df.where(held), model).collect()
    assert np.mean([r.lang_pred == "xyz"[r.doc_id % 3] for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in got]) < 0.02
    odd = {r.doc_id: r for r in classify.predict_language(clashing(spark, AWKWARD), model, keep_text=True).collect()}
    assert [odd[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and odd[1].rejected and odd[1].score == 0 and odd[4].lang_pred != "und" and odd[7].text == "x" * 3000


def test_classifiers_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, label string")
    model = classify.fit(none, none, classify.LANGUAGE, 10)
    assert classify.predict_language(none, model).count() == 0
    assert {r.lang_pred for r in classify.predict_language(spark.createDataFrame(AWKWARD, DOC), model).collect()} == {"und"}
    assert {r.score for r in classify.predict_toxicity(spark.createDataFrame(AWKWARD, DOC), model).collect()} == {0.0}


def test_toxicity_and_unseen_misspellings(spark):
    bad = ["horridword", "nastyterm", "vileness"]

    def text(k):
        w = prose(random.randint(10, 60)).split()
        if k % 4 == 0:
            for _ in range(3):
                w.insert(random.randrange(len(w)), random.choice(bad))
        return " ".join(w)

    data = [(k, text(k), int(k % 4 == 0)) for k in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string, label int")
    held = common.remainder(F.col("doc_id"), 4) == 2
    model = classify.fit(df, df.where(~held).select("doc_id", "label"), classify.TOXICITY, 400)
    got = classify.predict_toxicity(df.where(held), model).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.97
    miss = classify.predict_toxicity(spark.createDataFrame([(1, prose(20) + " horridwordd " + prose(5) + " nastyterrm"), (2, prose(30))], DOC), model)
    score = {r.doc_id: r.score for r in miss.collect()}
    assert score[1] > 3 * score[2]
    assert all(0 <= r.score <= 1 and not r.predicted for r in classify.predict_toxicity(spark.createDataFrame([(1, None), (2, "")], DOC), model).collect())


# 5 decontamination


def brute_hits(data, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in data:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            x = split(text)
            for k in range(max(1, len(x) - size + 1)) if x else []:
                win = x[k : k + size]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [2 << 20, 150])
def test_decontamination_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", bound)
    items = [(1, prose(14)), (2, prose(4)), (3, None), (4, "..."), (5, prose(25)), (6, prose(4)), (None, "É solo")]
    items[5] = (6, items[1][1])
    data = [(k, prose(random.randint(0, 20)) + ". " + (random.choice(items)[1] or "").upper() + ", " + prose(5)) for k in range(40)]
    data += [(i and i + 100, t) for i, t in AWKWARD] + [(60, "x É SOLO y"), (61, items[4][1][:40]), (62, items[1][1] + items[1][1])]
    found = decontaminate.decontaminate(spark.createDataFrame(data, DOC), spark.createDataFrame(items, "item_id long, text string"), keep_text=True).collect()
    want = brute_hits(data, [("null" if i is None else i, t) for i, t in items])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=str) == want
    for r in found:
        for a, b in r.spans:
            assert r.text.encode()[a:b].decode().strip()


def test_decontamination_awkward(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontaminate(clashing(spark, AWKWARD), none).collect()
    assert len(got) == len(AWKWARD) and not any(r.n_hit for r in got)
    assert decontaminate.decontaminate(spark.createDataFrame([], DOC), none).count() == 0


# 6 mixing


def test_mixing_targets_and_reruns(spark):
    data = [(k, prose(random.randint(0, 40)), random.choice(["a", "b", "b", "b", "c", None])) for k in range(500)]
    data += [(900, None, "a"), (901, " ", "d"), (902, "w", "d"), (902, "w", "d"), (None, "v v", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("own"))
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    total = {}
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 2 * r["size"]
        total.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert all(abs(t - n) <= 1 and t <= 2 * s + 1e-6 for t, s, n in total.values())
    assert sum(t for t, _, _ in total.values()) == pytest.approx(1.5 * sum(s for _, s, _ in total.values()), abs=1e-3)
    spread = mixing.expand(mixing.mix(df)).groupBy("source").agg(F.sum("epoch_words")).collect()
    assert {s: n for s, n in spread} == {s: n for s, (_, _, n) in total.items() if n}
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# 7 tokens


def test_token_cache(spark, tmp_path, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    data = [*AWKWARD, (20, prose(50)), (21, prose(50) + " <s> </s>"), (20, "again")]
    data[-3] = (19, data[-2][1])
    cache = str(tmp_path / "cache")
    want = sorted((str(i), len((t or "").encode()), len(own.encode(t or "")), len(own.encode(t or "")) > 40) for i, t in data)
    for _ in range(2):  # the second time nothing is encoded
        got = tokens.count_tokens(clashing(spark, data), path, cache, limit=40).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("content_digest").distinct().count() == len({t or "" for _, t in data})
    assert tokens.count_tokens(spark.createDataFrame([], DOC), path, cache).count() == 0


def test_tokens_of_json_vocabulary(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame([(1, "Hello there, world"), (2, None)], DOC), path, str(tmp_path / "c")).collect()}
    assert got == {1: len(t.encode("Hello there, world", add_special_tokens=False).ids), 2: 0}


# 9 chat


def test_perspectives_round_trip(spark):
    said = [(1, 0, "user", "hi <|im_end|> <\\|"), (1, 1, "assistant", None), (1, 1, "bob smith", "tie"), (1, 2, "user", "bye\n"), (2, 0, "system", "rules"), (None, 5, None, "lost"), (3, None, "a", "x"), (3, 600, "b", "y"), (3, 600, "b", "y")]
    said += [(4, k, who, str(k)) for k, who in enumerate(["a b", "a_b", "a\nb", "a\\nb", "unknown", " ", None, "system", "é <|x"])]
    said += [(5, k, "abc"[k % 3], "word " * (k % 4)) for k in range(900)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("own") for n in ("part", "said", "who", "head", "body", "at", "nth", "perspective")})
    out = chat.rotate(df).collect()
    speakers = {(c, (w or "").strip(" ")) for c, _, w, _ in said} - {(2, "system"), (4, "system")}
    assert {(r.conv_id, r.perspective) for r in out} == speakers and len(out) == len(speakers)
    plain = lambda t: re.sub(r"<\\(\\*)\|", r"<\1|", t)
    for r in out:
        turns = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", r.rendered, re.S)
        own = sorted((t if t is not None else -1, (w or "").strip(" "), x or "") for c, t, w, x in said if c == r.conv_id)
        assert [plain(b) for _, b in turns] == [x for _, _, x in own] and r.n_turns == len(own)
        assert [h == "assistant" for h, _ in turns] == [w == r.perspective for _, w, _ in own]
        assert [r.rendered[m.start : m.stop] for m in r.masks] == [f"{b}<|im_end|>" for h, b in turns if h == "assistant"] and len(r.masks) == r.n_target_turns
    named = {h for r in out if r.conv_id == 4 and r.perspective == "" for h in re.findall(r"user name=(.*)", r.rendered)}
    assert len(named) == 6  # no two names are rendered alike
    assert chat.rotate(df.limit(0)).count() == 0


# 10 simhash


def brute_print(text, size=3):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_against_brute_force(spark):
    data = [(k, prose(random.randint(0, 120))) for k in range(60)]
    for k in range(60, 160):
        w = data[k % 60][1].split()
        if w:
            w[random.randrange(len(w))] = "edit"
        data.append((k, " ".join(w).title() if k % 2 else " ".join(w)))
    data += [(i and i + 300, t) for i, t in AWKWARD]
    prints = {i: brute_print(t) for i, t in data}
    parent = {i: i for i in prints if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = simhash.near_duplicates(clashing(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.fingerprint & (2**64 - 1) == prints[r.doc_id]
        assert r.doc_id is None or r.component_id == top(r.doc_id)
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_close_pairs_of_large_sets(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    f = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))) for _ in range(6)] + [base]))
    a = {(min(i, j), max(i, j)) for i, j in zip(*simhash.close_pairs(f, 3))}
    monkeypatch.setattr(simhash, "BLOCK", 16)
    b = {(min(i, j), max(i, j)) for i, j in zip(*simhash.close_pairs(f, 3))}
    assert a == b and len(a) > 40
