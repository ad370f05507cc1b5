"""The corpus pipeline and its stages against brute force, and with nulls, repeated rows, no rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinlink.llm import common, simhash
from tests.llm.test_operators import brute_hits, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the stages use themselves.
CLASHES = {"score": "mine", "rejected": "r", "n_words": "-7", "n_hit": "h", "items": "i", "spans": "s", "n_removed": "n", "kept": "k", "row": "x", "sig": "y", "first": "z", "component": "c"}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size=5):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_near(docs, similarity=0.8):
    """The (doc_id, text) rows that stay."""
    docs = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) >= similarity * union) if union else True:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {docs[i] for i in range(len(docs)) if top(i) == i}


def brute_repeats(docs, length=50):
    first, out = {}, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        raw = t.encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], i)
    for i, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        left = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if left or not any(gone):
            out.append((i, left))
    return out


def brute_mixture(docs):
    """doc_id -> words taken; docs: (doc_id, source, text)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in docs}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, x, _ in docs if x == s) for s in sources}
    target, free, rest = {}, set(sources), 1.5 * sum(total.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
        free -= over
        if not free:
            break
    taken = {}
    for s in sources:
        want = int(target[s] + 0.5)
        repeats = want // total[s] if total[s] else 0
        left = want - repeats * total[s]
        for i in sorted((i for i, x, _ in docs if x == s), key=lambda i: hashlib.md5(f"17:{i}".encode()).hexdigest()):
            extra = max(0, min(left, size[i]))
            left -= size[i]
            taken[i] = repeats * size[i] + extra
    return {i: n for i, n in taken.items() if n}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(8)
    folder = str(tmp_path_factory.mktemp("corpus"))
    passages, items = [prose(25) for _ in range(3)], [prose(15), prose(4), prose(30)]
    texts = [prose(random.randint(20, 160)) for _ in range(110)]
    for k in range(20):  # near copies: one word in a long text
        w = texts[k % 10].split() + prose(60).split() if k >= 10 else texts[k].split()
        if len(w) > 60:
            w[random.randrange(len(w))] = "edit"
        texts.append(" ".join(w).title() if k % 3 else " ".join(w))
    texts += [prose(15) + " " + p + " " + prose(15) for p in passages for _ in range(4)]
    texts += [prose(12) + " " + items[0][:-1].upper() + items[0][-1].upper() + ". " + prose(12), prose(9) + " " + items[1] + " " + prose(9), items[2], "12 34 ...", "  ", None]
    data = [(k, t, ["aa", "bb"][k % 2], random.choice(["x", "x", "x", "y", None]), len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(data, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_pipeline_against_brute_force(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = common.cut(corpus_pipeline.language(spark, docs, folder))
    kept = [(r.doc_id, r.text) for r in first.collect()]
    lettered = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert {i for i, _ in kept} <= lettered and len(kept) >= 0.9 * len(lettered)
    source = {r.doc_id: r.source for r in docs.collect()}
    near = brute_near(kept)
    cut = brute_repeats(sorted(near))
    clean = {i for i, _, hits, _ in brute_hits(cut, list(enumerate(items))) if not hits}
    left = [(i, t) for i, t in cut if i in clean]
    assert len(near) < len(kept) and len(left) < len(cut) and sum(len(t) for _, t in cut) < sum(len(t) for _, t in near)
    out = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.text) for r in out} == {(i, t) for i, t in left if words_of(t)} - {(i, t) for i, t in left if i not in {r.doc_id for r in out}}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.epoch_words
    assert got == brute_mixture([(i, source[i], t) for i, t in left])


def test_near_duplicates_of_known_similarity(spark, monkeypatch):
    """Every link is at least as similar as asked for, and hardly one at 0.8 or more is missed; also when routes are dealt in blocks."""
    random.seed(21)
    data = []
    for k in range(60):
        base = prose(random.randint(60, 200)).split()
        data.append((4 * k, " ".join(base)))
        for c in range(1, 4):
            w = list(base)
            for _ in range(random.randint(1, 1 + len(w) // 40)):
                w[random.randrange(len(w))] = f"e{k}{c}"
            data.append((4 * k + c, " ".join(w)))
    data += [(1000 + k, t) for k, t in enumerate(["one two", "ONE  two", "one two three", "", " ", None])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {i for i, _ in brute_near(data)}
    got = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert want <= got and len(got - want) <= 0.05 * (len(data) - len(want))
    monkeypatch.setattr(simhash, "ROUTE_ROWS", 8)
    monkeypatch.setattr(simhash, "LOOK", 1)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == got


def test_links_beside_doubtful_ones_that_prove_wrong_stay(spark):
    """Of three texts two are just similar enough and the third to neither, though bits may tell it more alike."""
    data = []
    for k in range(40):
        one = [f"w{k}x{i}" for i in range(400)]
        two, three = list(one), list(one)
        for p in range(20, 340, 40):
            two[p], three[p] = f"t{k}x{p}", f"h{k}x{p}"
        three[380] = "other"
        data += [(3 * k, " ".join(one)), (3 * k + 1, " ".join(two)), (3 * k + 2, " ".join(three))]
    want = {i for i, _ in brute_near(data)}
    assert want == {i for i, _ in data if i % 3 != 1}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # all links meet in one task
    try:
        got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert want <= got and len(got - want) <= 2


def test_doubtful_links_grow_with_rows_and_lose_none(spark):
    """200 texts of about 0.66 to 0.82 to each other, above and below the threshold: by bits most links are doubtful."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    data = []
    for k in range(200):
        w = list(base)
        for p in rng.sample(range(400), rng.choice([4, 8])):
            w[p] = f"e{k}x{p}"
        data.append((k, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    buf = np.frombuffer("".join(t for _, t in data).encode(), np.uint8)
    sig = simhash.signatures(buf, np.concatenate(([0], np.cumsum([len(t) for _, t in data]))), 5, 8)
    classes = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sig)], "cid long, sig binary")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert simhash.candidates(classes, len(data), 0.8).count() <= 3 * len(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    want = {i for i, _ in brute_near(data)}
    assert 1 < len(want) < len(data) and {r.doc_id for r in simhash.keep_one(df).collect()} == want


@pytest.mark.parametrize("hashes", [1 << 20, 400])
def test_rows_that_may_link_are_verified(spark, monkeypatch, hashes):
    """Also when the rows of a group meet in blocks."""
    monkeypatch.setattr(simhash, "SET_HASHES", hashes)
    words = [[f"w{i}" for i in range(100)] for _ in range(6)]
    for k, changed in enumerate([0, 2, 0, 12, 14, 30]):
        for p in range(changed):
            words[k][-1 - p] = f"x{changed}y{p}"
    texts = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "cid long, text string")
    sig = bytes(64)
    members = spark.createDataFrame([(k, t, 0, sig) for k, t in enumerate([0, 1, 2, 3, 4, 5])], "cid long, tree long, group long, sig binary")
    got = simhash.proven(members, texts, 5, 0.8).collect()
    linked = dict(zip(*(v.tolist() for v in simhash.forest(np.array([r.a for r in got]), np.array([r.b for r in got])))))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    pairs = [(i, j) for i in range(6) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert linked == dict(zip(*(v.tolist() for v in simhash.forest(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))))) and 0 < len(linked) < 5


def test_trees_connect_what_links_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (6, 8), dtype=np.uint64)
    f = np.concatenate([base[k % 6 : k % 6 + 1] ^ np.uint64(1 << int(rng.integers(60))) for k in range(120)])
    a, b = simhash.grown(f, 40, 80)
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2) <= 40)
    _, own = simhash.forest(np.concatenate([a, np.arange(120)]), np.concatenate([b, np.arange(120)]))
    links = lambda p, q: dict(zip(*(v.tolist() for v in simhash.forest(p, q))))
    assert links(a, b) == links(x, y) and len(a) == 120 - 6
    w = rng.integers(1, 100, 300)
    p, q = rng.integers(0, 40, (2, 300))
    picked = simhash.spanning(p, q, w, 40)
    assert links(p[picked], q[picked]) == links(p, q) and len(picked) == len(links(p, q))


def extra(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(v) for c, v in CLASHES.items()})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_awkward_rows(spark, corpus, name, stage):
    folder, items = corpus
    long, other = prose(120), prose(80)
    rows = [(1, long, "aa", "x", 5), (1, long, "aa", "x", 5), (1, other, "bb", "x", 5), (None, prose(70), "aa", None, None), (None, None, None, None, None), (2, "", "aa", "y", 0), (3, None, "aa", "y", 0)]
    rows += [(10 + k, prose(50), "ab"[k % 2] * 2, "x", 9) for k in range(12)]
    df = extra(spark, rows)
    out = stage(spark, df, folder)
    got = out.collect()
    assert out.columns[: len(df.columns)] == df.columns if name == "mixture" else out.columns == df.columns
    for r in got:  # no column of the user's is overwritten
        assert {c: r[c] for c in CLASHES} == CLASHES
    texts = [(r.doc_id, r.text) for r in got]
    if name == "language":
        assert sum(t == (1, long) for t in texts) == 2 and (None, None) not in texts and (2, "") not in texts and (None, rows[3][1]) in texts
    if name == "near_duplicates":
        assert sum(t == (1, long) for t in texts) == 1 and (1, other) in texts and (None, rows[3][1]) in texts and [i for i, t in texts if not t] == [2]
    if name == "repeats":
        assert (None, rows[3][1]) in texts and (3, None) in texts and (2, "") in texts
    if name == "benchmark":
        assert len(texts) == len(rows)
    if name == "mixture":
        assert {t for _, t in texts} <= {t for _, t, *_ in rows if t}
    assert stage(spark, df.limit(0), folder).count() == 0


def test_language_without_labels_keeps_what_has_letters(spark, corpus):
    df = spark.createDataFrame([(1, "abc", None, "x", 3), (2, "123", None, "x", 3)], DOCS)
    assert [r.doc_id for r in corpus_pipeline.language(spark, df, corpus[0]).collect()] == [1]


def test_one_long_text_needs_bounded_memory():
    import resource

    text = np.frombuffer((prose(4000) + " ").encode() * 400, np.uint8)[: 16 << 20]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    simhash.fingerprints(text, np.array([0, len(text)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes
