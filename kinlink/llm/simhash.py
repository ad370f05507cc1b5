"""SimHash near-dedup: fingerprints of word shingles, linked through one-wildcard segment variants.

near_duplicates() links 64-bit fingerprints of few differing bits, all of them; keep_one() takes a similarity instead: wide
signatures, of which it indexes as many segments as the recall asked for at that similarity needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import LOWER, PIECE, SPACE, arrow, cut, free_name, joined_words, parts_for, pieces, prepare, text_bytes, word_spans
from kinlink.llm.components import components, forest
from kinlink.llm.xxh import xxh64

#: Fingerprints compared all with all at once; larger buckets are indexed again by their other half.
BLOCK = 2048

#: Variant rows of one partition.
VARIANT_ROWS = 2_000_000

#: A one in each byte of a word.
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, size: int, seed: int = 42, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the texts' shingles (`size` words, A-Z lowered, joined by one space) in order, and how many each text has.

    A text of fewer words has one shingle of all its words, or with short=False none.
    """
    n = len(offsets) - 1
    flat, at, lengths, doc = joined_words(LOWER[buf], offsets, ~SPACE)
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    shingles = np.where(words >= (0 if short else size), np.where(words > 0, np.maximum(words - size + 1, 1), 0), 0)
    lead = np.cumsum(shingles) - shingles
    which = np.repeat(np.arange(n), shingles)
    begin = first[which] + np.arange(len(which)) - lead[which]
    last = np.minimum(begin + size, first[which] + words[which]) - 1
    return xxh64(flat, at[begin], at[last] + lengths[last] - at[begin], seed), shingles


def hashed(buf: np.ndarray, offsets: np.ndarray, size: int, seed: int = 42) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, their shingles' hashes, how many each has); a long text comes in several portions."""
    for lo, hi in pieces(offsets):
        text = buf[offsets[lo] : offsets[hi]]
        if hi > lo + 1 or len(text) <= 2 * PIECE:
            yield lo, hi, *shingle_hashes(text, offsets[lo : hi + 1] - offsets[lo], size, seed)
            continue
        carry, at, some = text[:0], 0, False
        while at < len(text):
            stop = min(at + PIECE, len(text))
            while stop < len(text) and not SPACE[text[stop]]:  # up to the end of a word
                blank = np.flatnonzero(SPACE[text[stop : stop + PIECE]])
                stop = stop + int(blank[0]) if len(blank) else min(stop + PIECE, len(text))
            part = np.concatenate([carry, text[at:stop]])
            h, n = shingle_hashes(part, np.array([0, len(part)]), size, seed, short=False)
            some |= len(h) > 0
            yield lo, hi, h, n
            starts, _, _ = word_spans(part, np.array([0, len(part)]), ~SPACE)
            carry = part[starts[-(size - 1)] :] if len(starts) >= size > 1 else part if len(starts) < size else part[:0]
            at = stop
        if not some:
            yield lo, hi, *shingle_hashes(carry, np.array([0, len(carry)]), size, seed)


def votes(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(texts, 64): how many of each text's hashes have bit b set."""
    # Bits are summed in the eight byte lanes of a word, over at most 255 shingles of one text at a time.
    chunks = -(-shingles // 255)
    owner = np.repeat(np.arange(len(shingles)), chunks)
    heads = np.cumsum(chunks) - chunks
    cuts = (np.cumsum(shingles) - shingles)[owner] + 255 * (np.arange(len(owner)) - heads[owner])
    out = np.zeros((len(shingles), 64), np.int64)
    full = np.flatnonzero(chunks)
    if len(full):
        for k in range(8):
            sums = np.add.reduceat((h >> np.uint64(k)) & LANES, cuts)
            out[full, k::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads[full], axis=0)
    return out


def majority(counts: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """uint64 of the bits set in over half of the shingles."""
    return np.packbits(2 * counts > shingles[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(buf: np.ndarray, offsets: np.ndarray, size: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 SimHash of each text: bit b is set if set in over half of its shingles' XXH64 hashes.

    Shingles are `size` consecutive words joined by one space, repeats included; a text of fewer words
    has one shingle, of none the fingerprint 0.
    """
    out = np.zeros(len(offsets) - 1, np.uint64)
    own, total, now = None, None, -1
    for lo, hi, h, n in hashed(buf, offsets, size, seed):
        counts = votes(h, n)
        own, total = (own + counts, total + n) if lo == now else (counts, n)
        out[lo:hi], now = majority(own, total), lo
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles for every k (the finaliser of SplitMix64)."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signatures(buf: np.ndarray, offsets: np.ndarray, size: int, words: int) -> np.ndarray:
    """(texts, words) uint64: SimHash of 64 x words bits over the distinct shingles of each text; no shingles give zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, words), np.uint64)

    def put(lo: int, hi: int, h: np.ndarray, which: np.ndarray) -> None:
        order = np.lexsort((h, which))
        h, which = h[order], which[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
        h, shingles = h[new], np.bincount(which[new], minlength=hi - lo)
        for k in range(words):
            out[lo:hi, k] = majority(votes(mixed(h, k), shingles), shingles)

    def finish(lo: int, found: list[np.ndarray]) -> None:
        h = np.unique(np.concatenate(found))
        parts = [h[a : a + PIECE] for a in range(0, len(h), PIECE)]
        for k in range(words):
            counts = sum(votes(mixed(x, k), np.array([len(x)])) for x in parts)
            out[lo, k] = majority(counts, np.array([len(h)]))[0]

    long: list[np.ndarray] = []
    now = -1
    for lo, hi, h, shingles in hashed(buf, offsets, size):
        if lo != now and long:
            finish(now, long)
            long = []
        now = lo
        if offsets[hi] - offsets[lo] > 2 * PIECE and hi == lo + 1:
            long.append(np.unique(h))
        else:
            put(lo, hi, h, np.repeat(np.arange(hi - lo), shingles))
    if long:
        finish(now, long)
    return out


def _blocks(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for lo in range(0, len(f), BLOCK):
        for other in range(lo, len(f), BLOCK):
            i, j = np.nonzero(np.bitwise_count(f[lo : lo + BLOCK, None] ^ f[None, other : other + BLOCK]) <= radius)
            keep = i + lo < j + other
            left.append(i[keep] + lo)
            right.append(j[keep] + other)
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def close_pairs(f: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct fingerprints within `radius` bits; pairs may repeat.

    A large set is indexed once more: cut into sixteen-bit segments, of which one differs by at most
    one bit for radius <= 7, each wildcard variant of it being a bucket.
    """
    if len(f) <= BLOCK:
        return _blocks(f, radius)
    left, right = [], []
    for segment in range(4):
        part = (f >> np.uint64(16 * segment)) & np.uint64(0xFFFF)
        for bit in range(16):
            key = part & ~np.uint64(1 << bit)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1, append=1 << 20))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    i, j = _blocks(f[order[lo:hi]], radius)
                    left.append(order[lo:hi][i])
                    right.append(order[lo:hi][j])
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def _links(key: np.ndarray, close: Callable, among: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs with equal keys that are linked: close(i, j) tells of pairs of rows, among(rows) gives those of a large set."""
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0, [True])))
    sizes = np.diff(edges)
    left, right = [], []
    small = sizes <= 64
    inside = np.repeat(np.where(small, sizes, 0), sizes)
    place = np.arange(len(key)) - np.repeat(edges[:-1], sizes)
    for d in range(1, int(sizes[small].max(initial=0))):
        i = np.flatnonzero(place + d < inside)
        a, b = order[i], order[i + d]
        good = close(a, b)
        left.append(a[good])
        right.append(b[good])
    for g in np.flatnonzero(~small):
        rows = order[edges[g] : edges[g + 1]]
        i, j = among(rows)
        left.append(rows[i])
        right.append(rows[j])
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row of docs (doc_id integer, text).

    Fingerprints of at most `radius` (<= 3) differing bits are linked. Cut into two segments of 32 bits, two such
    fingerprints have a segment that differs by at most one bit, so they share one of its 32 one-wildcard variants:
    each distinct fingerprint is indexed under 64 keys, equal keys meet in a partition, and pairs are verified.
    Copies are one fingerprint, whose smallest doc_id stands for them; each partition hands on a spanning
    forest of its links, never all pairs, and component_id is the smallest doc_id reachable.
    A null text is empty; texts without words have fingerprint 0 and are linked like any other; a null
    doc_id keeps its fingerprint and takes its component from the others (null if there are none);
    other columns are ignored; an empty table gives no rows.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments cover at most 3 differing bits")
    prepare(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b[0], pa.array(fingerprints(*text_bytes(b[1]), size).view(np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    printed = cut(arrow(texts, prints, "doc_id long, fp long"))
    classes = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    known = classes.where("rep is not null")
    at = F.col("at")
    half = F.when(at < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    key = half.bitwiseAND(F.expr("~shiftleft(1L, cast(at & 31 as int))")).bitwiseOR(F.expr("shiftleft(cast(at as long), 32)"))
    variants = known.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(key.alias("key"), "fp", "rep")
    variants = variants.repartition(parts_for(docs, 64 * known.count(), VARIANT_ROWS), "key")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b[0].to_numpy(), b[1].to_numpy(), b[2].to_numpy()) for b in batches]
        if rows:
            keys, f, rep = (np.concatenate(x) for x in zip(*rows))
            f = f.view(np.uint64)
            i, j = _links(keys, lambda x, y: np.bitwise_count(f[x] ^ f[y]) <= radius, lambda rows: close_pairs(f[rows], radius))
            a, b = forest(rep[i], rep[j])
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    joined = components(arrow(variants, link, "a long, b long"))
    full = classes.join(joined, classes.rep == joined.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return printed.join(full, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


#: Bits of a signature by which similarity is measured: at 0.8 its standard error is 0.025.
MEASURED = 512

#: Standard errors of the measured similarity above which a link is taken as it is, and down to which it is verified.
SURE, DOUBTFUL = 4.0, 3.5

#: Share of the pairs right at the similarity asked for that have to meet in the index.
RECALL = 0.99

#: Rows of one route that meet in one task; the rows of a hotter route meet block by block. Hot routes are told from the routes of one in
#: LOOK signatures, which only says how work is dealt out: results are the same whatever is found.
ROUTE_ROWS = 1 << 16
LOOK = 64

#: Hashes of the sets of a group that meet in one task; larger groups meet block by block.
SET_HASHES = 1 << 20

#: Pairs measured at once.
DISTANCES = 1 << 18


def differing(similarity: float) -> float:
    """The share of bits in which signatures of sets of this Jaccard similarity differ, on average and at most.

    Sets of Jaccard similarity j have a cosine of at least 2j / (1 + j), and a random hyperplane parts them with probability angle / pi.
    """
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def error(similarity: float) -> float:
    """The standard error of a similarity told by MEASURED bits."""
    p = differing(similarity)
    cosine = np.cos(np.pi * p)
    return float(2 / (2 - cosine) ** 2 * np.pi * np.sin(np.pi * p) * np.sqrt(p * (1 - p) / MEASURED))


def segmentation(rows: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a segment, segments): segments grow with the logarithm of the rows, so that few rows meet by chance, and there are so
    many that a pair at `similarity` has, with probability `recall`, one in which it differs by at most one bit."""
    bits = 2 * max(8, min(16, -(-max(rows, 1).bit_length() // 2)))
    p = differing(similarity)
    meet = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return bits, max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meet))))


def segment_values(signature: np.ndarray, bits: int, count: int) -> np.ndarray:
    """(rows, count) uint64: the first `count` segments of `bits` bits each."""
    flags = np.unpackbits(np.ascontiguousarray(signature).view(np.uint8), axis=1, bitorder="little")[:, : bits * count]
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = np.empty((len(signature), count), np.uint64)
    for k in range(count):
        out[:, k] = flags[:, k * bits : (k + 1) * bits].astype(np.uint64) @ weights
    return out


def routes(signature: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 2 x count) each: where a signature goes, and what is compared there.

    Half of a segment's one-wildcard variants have the wildcard in its upper half and so agree in the lower one, and the other way
    round: a segment goes to two places, and the variants are made there.
    """
    half = np.uint64(bits // 2)
    value = segment_values(signature, bits, count)
    low, high = value & ((np.uint64(1) << half) - np.uint64(1)), value >> half
    place = np.arange(count, dtype=np.uint64) << np.uint64(1)
    at = np.concatenate([(low << np.uint64(16)) | place, (high << np.uint64(16)) | place | np.uint64(1)], axis=1)
    return at, np.concatenate([high, low], axis=1)


def near(f: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Whether rows i and j of signatures differ in at most radius bits; the first word rules most pairs out (by over 6 standard errors)."""
    share = radius / (64 * f.shape[1])
    out = np.bitwise_count(f[i, 0] ^ f[j, 0]) <= 64 * share + 6 * np.sqrt(64 * share * (1 - share))
    at = np.flatnonzero(out)
    out[at] = distance(f, i[at], j[at]) <= radius
    return out


def distance(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.bitwise_count(f[i[k : k + DISTANCES]] ^ f[j[k : k + DISTANCES]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), DISTANCES)]
    return np.concatenate(parts or [np.empty(0, np.int64)])


def closest(f: np.ndarray, own: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of left the row of own that differs least, and in how many bits; a loop over the smaller of the two."""
    if len(left) <= len(own):
        found = [(d := distance(f, own, np.full(len(own), y))).argmin() for y in left]
        return own[found], distance(f, own[found], left)
    best, least = np.full(len(left), own[0]), np.full(len(left), 1 << 30)
    for x in own:
        d = distance(f, np.full(len(left), x), left)
        best, least = np.where(d < least, x, best), np.minimum(d, least)
    return best, least


def within(f: np.ndarray, own: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of either side the pair with the row of the other side that differs least, if in at most `most` bits: (of own, of left, bits)."""
    few, many = (own, left) if len(own) <= len(left) else (left, own)
    best, least = np.zeros(len(many), np.int64), np.full(len(many), 1 << 30)
    nearest, bits = np.zeros(len(few), np.int64), np.full(len(few), 1 << 30)
    for k, x in enumerate(few):
        d = distance(f, np.full(len(many), x), many)
        better = d < least
        best[better], least[better] = x, d[better]
        nearest[k] = many[at := int(d.argmin())]
        bits[k] = d[at]
    a, b, d = np.concatenate([best, few]), np.concatenate([many, nearest]), np.concatenate([least, bits])
    a, b, d = a[d <= most], b[d <= most], d[d <= most]
    return (a, b, d) if few is own else (b, a, d)


def sparse(a: np.ndarray, b: np.ndarray, weight: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Of the links (a[i], b[i]) between rows of different trees as many as there are rows, at most twice: a least spanning forest of the
    trees, and each row's least link."""
    forest_ = spanning(tree[a], tree[b], weight, len(tree))
    ends, at = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((weight[at], ends))
    heads = order[np.concatenate((np.ones(min(len(order), 1), bool), np.diff(ends[order]) != 0))]
    return np.union1d(forest_, at[heads]).astype(np.int64)


def grown(f: np.ndarray, sure: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of f: trees of links of at most `sure` bits, which connect all that such links connect; and of the links of at
    most `most` bits between these trees, any of which may prove right, so many that they connect what all connect and that every row that
    has one is the end of one.

    A row that is in a tree is not looked at again, so that a group of near copies costs about its size and not its square.
    """
    left, trees, a, b = np.arange(len(f)), [], [], []
    while len(left):
        queue, own, left = [int(left[0])], [int(left[0])], left[1:]
        while queue and len(left):
            asked, queue = (queue, []) if len(left) <= 32 else (queue[-1:], queue[:-1])
            who, d = closest(f, np.array(asked), left)
            hit = d <= sure
            a.append(who[hit])
            b.append(left[hit])
            queue += left[hit].tolist()
            own += left[hit].tolist()
            left = left[~hit]
        trees.append(np.array(own))
    tree = np.empty(len(f), np.int64)
    for k, rows in enumerate(trees):
        tree[rows] = k
    todo = np.argsort([-len(rows) for rows in trees], kind="stable")
    left, found = np.arange(len(f)), (np.empty(0, np.int64),) * 3
    for k in todo:
        left = left[tree[left] != k]
        if not len(left):
            break
        found = tuple(map(np.concatenate, zip(found, within(f, trees[k], left, most))))
        if len(found[0]) > max(DISTANCES, 8 * len(f)):
            few = sparse(*found, tree)
            found = tuple(x[few] for x in found)
    few = sparse(*found, tree)
    a, b = [*a, found[0][few]], [*b, found[1][few]]
    return np.concatenate(a), np.concatenate(b)


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """The edges (a[i], b[i]) of a minimum spanning forest, by Boruvka's rounds: each tree takes its least edge to another one."""
    order = np.argsort(weight, kind="stable")
    a, b, root, alive, chosen = a[order], b[order], np.arange(nodes), np.arange(len(a)), []
    while True:
        alive = alive[root[a[alive]] != root[b[alive]]]
        if not len(alive):
            return order[np.concatenate(chosen)] if chosen else np.empty(0, np.int64)
        best = np.full(nodes, len(a))
        np.minimum.at(best, root[a[alive]], alive)
        np.minimum.at(best, root[b[alive]], alive)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        nodes_, roots_ = forest(root[a[pick]], root[b[pick]])
        to = np.arange(nodes)
        to[nodes_] = roots_
        root = to[root]


def met(at: np.ndarray, rest: np.ndarray, f: np.ndarray, bits: int, sure: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs that connect the rows of equal routes whose `rest` differs by at most one bit, by wildcard variants, and whether a pair
    stands for others of its rows, which grown() left out."""
    found, few = np.empty(0, np.int64), [np.empty(0, np.int64)]  # pairs as one number each, once: most meet under several variants
    number = lambda i, j: np.minimum(i, j) * len(f) + np.maximum(i, j)

    def among(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = grown(f[rows], sure, most)
        few.append(np.unique(number(rows[i], rows[j])))
        return i, j

    for k in range(bits // 2):
        key = (at << np.uint64(16)) | (rest & ~np.uint64(1 << k))
        found = np.union1d(found, number(*_links(key, lambda i, j: near(f, i, j, most), among)))
    return found // max(len(f), 1), found % max(len(f), 1), np.isin(found, np.unique(np.concatenate(few)))


def candidates(classes: DataFrame, rows: int, similarity: float) -> DataFrame:
    """(a, b, sure) links between signatures (cid, sig): sure ones, a spanning forest of each task's, and doubtful ones.

    A link is sure if the bits tell a similarity of SURE standard errors above the one asked for, and doubtful down to DOUBTFUL standard
    errors below it. Of the doubtful ones between its sure trees a task hands on a spanning forest and one for each row that has any, not
    all, which grow with the square of a group: they tell which rows may link, whose pairs proven() looks at. `rows` says for how many
    signatures the segments are made.
    """
    bits, count = segmentation(rows, similarity)
    sure, most = (int(MEASURED * differing(similarity + k * error(similarity))) for k in (SURE, -DOUBTFUL))
    known = MEASURED // 64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b[1].to_pylist()), "<u8").reshape(len(b), -1)
            for lo in range(0, len(sig), 2000):
                own = sig[lo : lo + 2000]
                at, rest = routes(own, bits, count)
                short = [x.tobytes() for x in np.ascontiguousarray(own[:, :known])]
                who = np.repeat(np.arange(len(own)), 2 * count)
                cid, sigs = pa.array(b[0].to_numpy()[lo : lo + 2000][who]), pa.array(short, pa.binary()).take(pa.array(who))
                yield pa.record_batch([pa.array(at.ravel().view(np.int64)), pa.array(rest.ravel().astype(np.int32)), cid, sigs], ["at", "rest", "cid", "sig"])

    def count_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, _ = routes(np.frombuffer(b"".join(b[0].to_pylist()), "<u8").reshape(len(b), -1), bits, count)
            at, n = np.unique(at, return_counts=True)
            yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(n)], ["at", "n"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b[0].to_numpy(), b[1].to_numpy().astype(np.uint64), b[2].to_numpy(), np.frombuffer(b"".join(b[3].to_pylist()), "<u8").reshape(-1, known)) for b in batches if len(b)]
        if not parts:
            return
        at, rest, cid, f = (np.concatenate(x) for x in zip(*parts))
        # Routes are numbered anew within the task, so that they and a wildcard variant make one key.
        at = np.unique(at, return_inverse=True)[1].astype(np.uint64)
        i, j, few = met(at, rest, f, bits, sure, most)
        d = distance(f, i, j)
        a, b = forest(cid[i[d <= sure]], cid[j[d <= sure]])
        ids, at = np.unique(np.concatenate([cid[i], cid[j]]), return_inverse=True)
        to = np.arange(len(ids))
        to[np.searchsorted(ids, a)] = np.searchsorted(ids, b)
        p, q = to[at[: len(i)]], to[at[len(i) :]]
        rest = np.flatnonzero((d > sure) & ((p != q) | few))  # rows of one tree by now may have had others to link with
        rest = rest[sparse(at[: len(i)][rest], at[len(i) :][rest], (d + MEASURED * (p == q))[rest], to)]
        ends = np.concatenate([a, cid[i[rest]]]), np.concatenate([b, cid[j[rest]]])
        yield pa.record_batch([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends)), pa.array(np.arange(len(ends[0])) < len(a))], ["a", "b", "sure"])

    dealt = arrow(classes.select("cid", "sig"), deal, "at long, rest int, cid long, sig binary")
    some = classes.where(F.pmod(F.xxhash64("cid"), F.lit(LOOK)) == 0).select("sig")
    hot = cut(arrow(some, count_routes, "at long, n long").groupBy("at").agg((F.sum("n") * LOOK).alias("n")).where(F.col("n") > ROUTE_ROWS))
    if not hot.isEmpty():
        # A row of a hot route is in one of its blocks and goes to every pair of blocks with that one.
        dealt = dealt.join(hot, "at", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / (ROUTE_ROWS // 2)), F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks"))
        dealt = dealt.withColumn("other", F.explode(F.expr("if(blocks = 1, array(-1L), filter(sequence(0L, blocks - 1), x -> x <> own))")))
        dealt = dealt.withColumn("at", F.when(F.col("other") < 0, F.col("at")).otherwise(F.xxhash64("at", F.least("own", "other"), F.greatest("own", "other")))).select("at", "rest", "cid", "sig")
    return arrow(dealt.repartition(parts_for(classes, 2 * count * rows, VARIANT_ROWS // 4), "at"), link, "a long, b long, sure boolean")


def shared(sets: list[np.ndarray], similarity: float, f: np.ndarray, most: int, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect the rows whose sets have a Jaccard similarity of `similarity` or more, as far as `tree` does not already and
    signatures differ in at most `most` bits. A row that is connected is not looked at again."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, np.int64)
    sizes = np.array([len(x) for x in sets], np.int64)
    at = np.cumsum(sizes) - sizes
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    order = np.argsort(tree, kind="stable")
    left, a, b = order, [], []
    while len(left):
        inside = tree[left] == tree[left[0]]
        queue, left = left[inside].tolist(), left[~inside]
        while queue and len(left):
            x = queue.pop()
            near_ = left[distance(f, np.full(len(left), x), left) <= most]
            if not len(near_):
                continue
            own = codes[at[x] : at[x] + sizes[x]]
            mark[own] = True
            hits = []
            for lo in range(0, len(near_), 256):
                some = near_[lo : lo + 256]
                n = sizes[some]
                heads = np.cumsum(n) - n
                which = np.repeat(np.arange(len(some)), n)
                both = np.bincount(which, mark[codes[np.arange(int(n.sum())) + (at[some] - heads)[which]]], len(some))
                hits.append(some[both >= similarity * (len(own) + n - both) - 1e-9])
            mark[own] = False
            hit = np.concatenate(hits)
            if len(hit):
                _, one = np.unique(tree[hit], return_index=True)  # a row for each tree says it all
                a.append(np.full(len(one), x))
                b.append(hit[one])
                joins = np.isin(tree[left], tree[hit])
                queue += left[joins].tolist()
                left = left[~joins]
    return np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)])


def proven(members: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) links between members (cid, tree, group, sig) of a group that connect those of different trees whose texts (cid, text; one row for
    each member) have sets of shingles of at least that Jaccard similarity.

    The rows of a group meet with their sets in one task up to SET_HASHES hashes; beyond, blocks of it meet pair by pair.
    """
    most = int(MEASURED * differing(similarity - DOUBTFUL * error(similarity)))
    known = MEASURED // 64

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[list[np.ndarray]] = [[] for _ in range(len(b))]
            for lo, hi, h, n in hashed(*text_bytes(b[1]), size):
                for d, own in enumerate(np.split(h, np.cumsum(n)[:-1])):
                    held[lo + d].append(np.unique(own))
            own = [np.unique(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in held]
            yield pa.record_batch([b[0], pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["cid", "hashes", "set"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        at, cid, tree = (rows[c].to_numpy() for c in ("at", "cid", "tree"))
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0, [True])))
        for lo, hi in zip(edges[:-1], edges[1:]):
            own = order[lo:hi]
            if len(np.unique(tree[own])) < 2:
                continue
            here = rows.select(["sig", "set"]).take(pa.array(own))
            f = np.frombuffer(b"".join(here["sig"].to_pylist()), "<u8").reshape(len(own), -1)[:, :known]
            i, j = shared([np.frombuffer(x, "<u8") for x in here["set"].to_pylist()], similarity, f, most, tree[own])
            yield pa.record_batch([pa.array(cid[own[i]]), pa.array(cid[own[j]])], ["a", "b"])

    full = cut(members.join(arrow(texts, sets, "cid long, hashes long, set binary"), "cid"))
    sized = full.groupBy("group").agg(F.ceil(F.sum("hashes") / SET_HASHES).alias("blocks"))
    dealt = full.join(sized, "group").withColumn("blocks", F.greatest("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.expr("if(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), x -> x <> own))")))
    dealt = dealt.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("at"), "cid", "tree", "sig", "set")
    hashes = full.agg(F.sum("hashes")).head()[0] or 0
    return arrow(dealt.repartition(parts_for(texts, hashes, 4 * SET_HASHES), "at"), link, "a long, b long")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs (doc_id, text) but for those that are near copies of another kept or dropped one: of each group one row stays.

    Documents link if the similarity of their sets of `size`-word shingles (A-Z lowered), as MEASURED bits of SimHash tell it, is at least
    `similarity`; groups are what links connect. The row of the smallest doc_id stays (nulls last, then by a digest of the row). Rows that
    are equal in every column are one row. A text of fewer words is one shingle; texts without words, null ones too, are copies of each
    other. Columns may have any names and stay as they are; an empty table gives no rows. `similarity` is above 0 and below 1.

    Signatures are cut into so many segments that pairs at the threshold differ in one of these by at most one bit with probability
    RECALL, more alike ones nearly always; each segment goes to two tasks, where its one-wildcard variants are made, equal ones meet and
    pairs are measured. Equal signatures are one class; tasks hand on a spanning forest of their sure links and, of the doubtful ones
    between its trees, as many as tell which rows may link. Those that sure links leave apart meet once more, with their sets of shingles.
    """
    prepare(docs.sparkSession)
    rows = docs.count()
    bits, count = segmentation(rows, similarity)
    words = max(MEASURED, -(-bits * count // 64) * 64) // 64
    one, two = free_name("row_key", docs), free_name("row_check", docs)
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    marked = docs.withColumns({one: F.xxhash64(*cells), two: F.xxhash64(F.lit(1), *cells)})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = signatures(*text_bytes(b[3]), size, words)
            yield pa.record_batch([b[0], b[1], b[2], pa.array([x.tobytes() for x in sig], pa.binary())], ["one", "two", "doc_id", "sig"])

    own = marked.select(F.col(one).alias("one"), F.col(two).alias("two"), "doc_id", "text")
    signed = cut(arrow(own, sign, T.StructType([*(T.StructField(n, T.LongType()) for n in ("one", "two")), docs.schema["doc_id"], T.StructField("sig", T.BinaryType())])))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "one", "two")).alias("first")
    classes = cut(signed.groupBy("sig").agg(first).withColumn("cid", F.monotonically_increasing_id()))
    links = cut(candidates(classes, rows, similarity))
    certain, doubtful = links.where("sure").select("a", "b"), links.where("not sure").select("a", "b")
    ends = doubtful.select(F.col("a").alias("cid")).union(doubtful.select("b")).distinct()
    if not ends.isEmpty():
        known = components(certain)
        ends = cut(ends.join(known, F.col("cid") == F.col("id"), "left").select("cid", F.coalesce("component", "cid").alias("tree")))
        trees = doubtful.distinct()
        for end in ("a", "b"):
            trees = trees.join(ends.select(F.col("cid").alias(end), F.col("tree").alias(f"{end}_in")), end)
        apart = components(trees.where("a_in <> b_in").select("a_in", "b_in").distinct(), "a_in", "b_in")
        members = ends.join(apart.select(F.col("id").alias("tree"), F.col("component").alias("group")), "tree")
        members = cut(members.join(classes.select("cid", "sig", F.col("first.one").alias(one), F.col("first.two").alias(two)), "cid"))
        texts = marked.join(members.select("cid", one, two).hint("merge"), [one, two]).select("cid", "text").dropDuplicates(["cid"])
        certain = cut(certain.unionByName(proven(members.drop(one, two), texts, size, similarity)))
    joined = components(certain)
    groups = classes.select("cid", "first").join(joined, F.col("cid") == F.col("id"), "left")
    kept = groups.groupBy(F.coalesce("component", "cid").alias("group")).agg(F.min("first").alias("first")).select("first.one", "first.two")
    again = signed.groupBy("one", "two").count().where("count > 1").select("one", "two")
    kept = cut(kept.join(again.withColumn("again", F.lit(True)), ["one", "two"], "left").select(F.col("one").alias(one), F.col("two").alias(two), F.coalesce("again", F.lit(False)).alias("again")))
    single = marked.join(kept.where("not again").drop("again"), [one, two], "left_semi")
    several = kept.where("again").drop("again")
    if not several.isEmpty():
        single = single.unionByName(marked.join(several, [one, two], "left_semi").dropDuplicates([one, two]))
    return single.select(*(F.col(f"`{c}`") for c in docs.columns))
