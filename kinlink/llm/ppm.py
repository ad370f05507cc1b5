"""Prediction by partial matching: a byte-context trie with escapes (method D) and symbol exclusion, pretrained on a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.common import LOWER, SPACE, arrow, cut, joined_words, parts_for, pieces, prepare, text_bytes
from kinlink.llm.xxh import xxh64

#: Longest context, in bytes.
ORDER = 5

#: Entries (context, symbol) that are broadcast; of a corpus with more the frequent ones, the others are looked up by a join.
ENTRIES = 4_000_000

#: Words whose counts are broadcast; rarer words are looked up by a join.
WORDS = 1_000_000

#: The symbol of the end of a text and the padding before its start: bytes that UTF-8 words never hold.
END, PAD = 0xFF, 0xFE

#: Kinds of counted rows.
GRAM, WORD, TEXTS = 0, 1, 2


def sequences(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER):
    """The coded form of each text: `order` pads, its words (A-Z lowered) joined by blanks, END.

    Returns the bytes, the texts' offsets in them, and the words' hashes and text numbers.
    """
    n = len(offsets) - 1
    low = LOWER[buf]
    flat, starts, lengths, doc = joined_words(low, offsets, ~SPACE)
    own = np.bincount(doc, weights=lengths + 1, minlength=n).astype(np.int64)
    sizes = np.maximum(own, 1) + order
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(at[-1], PAD, np.uint8)
    inside = np.repeat(at[:-1] + order - (np.cumsum(own) - own), own) + np.arange(len(flat))
    out[inside] = flat
    out[at[1:] - 1] = END
    return out, at, xxh64(flat, starts, lengths), doc


def keys(seq: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each position of seq from `order` on: the bytes of its context and its own, as one number."""
    k = np.zeros(max(len(seq) - order, 0), np.uint64)
    for j in range(order + 1):
        k = (k << np.uint64(8)) | seq[j : len(seq) - order + j]
    return k


def coded(at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Which positions from `order` on are coded (not pads)."""
    out = np.ones(max(int(at[-1]) - order, 0), bool)
    for j in range(order):
        out[(at[1:-1] - order + j)] = False
    return out


@dataclass
class Level:
    """Contexts of one length and their symbols, sorted; logarithms to base 10."""

    nodes: np.ndarray  # context numbers
    total: np.ndarray  # log of the count of its symbols
    escape: np.ndarray  # log of half the distinct symbols over the count
    total_after: np.ndarray  # the same for the next shorter context, without the symbols seen here
    escape_after: np.ndarray
    entries: np.ndarray  # context number * 256 + symbol
    count: np.ndarray  # log of the count less a half


def levels(grams: np.ndarray, counts: np.ndarray, order: int) -> list[Level]:
    """The trie of all orders from the counts of the longest: a shorter context's counts are sums of longer ones'."""
    per = []
    for k in range(order + 1):
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        entries, at = np.unique(grams & mask, return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(entries))
        heads = np.flatnonzero(np.diff(entries >> np.uint64(8), prepend=np.uint64(2**64 - 1))) if len(entries) else np.empty(0, np.int64)
        if len(entries) and (not len(heads) or heads[0] != 0):
            heads = np.concatenate(([0], heads))
        total = np.add.reduceat(n, heads) if len(heads) else np.empty(0)
        per.append((entries, n, entries[heads] >> np.uint64(8), total, np.diff(np.append(heads, len(entries))), heads))
    out = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, (entries, n, nodes, total, distinct, heads) in enumerate(per):
            if k and len(nodes):
                up_entries, up_n, up_nodes, up_total, up_distinct, _ = per[k - 1]
                seen = up_n[np.searchsorted(up_entries, entries & np.uint64((1 << (8 * k)) - 1))]
                up = np.searchsorted(up_nodes, nodes & np.uint64((1 << (8 * (k - 1))) - 1)) if k > 1 else np.zeros(len(nodes), int)
                rest, left = up_total[up] - np.add.reduceat(seen, heads), up_distinct[up] - distinct
                after = np.where(left > 0, np.log10(np.maximum(rest, 1)), 0.0), np.where(left > 0, np.log10(left / 2 / np.maximum(rest, 1)), 0.0)
            else:
                after = np.zeros(len(nodes)), np.zeros(len(nodes))
            out.append(Level(nodes, np.log10(total), np.log10(distinct / 2 / total), *after, entries, np.log10(n - 0.5)))
    return out


class Table:
    """A hash table of numbers and their values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        size = (1 << self.bits) + 64
        self.slots = np.full(size, 2**64 - 1, np.uint64)
        self.value = np.zeros(size, np.float32)
        todo = np.arange(len(keys))
        where = self._slot(keys)
        while len(todo):
            spot, first = np.unique(where[todo], return_index=True)
            free = self.slots[spot] == np.uint64(2**64 - 1)
            placed = todo[first[free]]
            self.slots[spot[free]] = keys[placed]
            self.value[spot[free]] = values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            where[todo] += 1
            if len(todo) and where[todo].max() >= len(self.slots):
                self.slots = np.append(self.slots, np.full(64, 2**64 - 1, np.uint64))
                self.value = np.append(self.value, np.zeros(64, np.float32))
        self.slots, self.value = np.append(self.slots, np.uint64(2**64 - 1)), np.append(self.value, np.float32(0))

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of k, 0 where it is missing, and the positions of the missing ones."""
        where = self._slot(k)
        found = self.slots[where]
        hit = found == k
        out = np.where(hit, self.value[where], np.float32(0)).astype(np.float64)
        todo = np.flatnonzero(~hit)
        open_ = todo[found[todo] != np.uint64(2**64 - 1)]
        missing = [todo[found[todo] == np.uint64(2**64 - 1)]]
        step = 1
        while len(open_):
            spot = where[open_] + step
            got = self.slots[spot]
            right = got == k[open_]
            out[open_[right]] = self.value[spot[right]]
            empty = got == np.uint64(2**64 - 1)
            missing.append(open_[empty])
            open_ = open_[~right & ~empty]
            step += 1
        return out, np.sort(np.concatenate(missing))


class Trie:
    """Code lengths of coded bytes. The longest order's entries also stand in a hash table, which answers most positions."""

    def __init__(self, trie: list[Level]):
        self.trie, self.order = trie, len(trie) - 1
        top = trie[-1]
        direct = top.count - top.total[np.searchsorted(top.nodes, top.entries >> np.uint64(8))] if len(top.entries) else np.empty(0)
        self.table = Table(top.entries, direct)

    def logs(self, k: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) for numbers of `order` context bytes and a symbol."""
        out, at = self.table.find(k)
        if len(at):
            out[at] = self._escaped(k[at])
        return out

    def _escaped(self, k: np.ndarray) -> np.ndarray:
        """Positions that the longest order's entries lack: escape to shorter contexts, excluding what longer ones have seen."""
        out = np.zeros(len(k))
        active = np.arange(len(k))
        before = np.full(len(k), -1)  # the node escaped from, one level up
        for level in range(self.order, -1, -1):
            own = self.trie[level]
            if not len(own.nodes):
                continue
            e = k[active] & np.uint64((1 << (8 * (level + 1))) - 1)
            c = e >> np.uint64(8)
            node = np.minimum(np.searchsorted(own.nodes, c), len(own.nodes) - 1)
            known = own.nodes[node] == c
            spot = np.minimum(np.searchsorted(own.entries, e), len(own.entries) - 1)
            has = own.entries[spot] == e
            prev = before[active]
            late = prev >= 0
            longer = self.trie[level + 1] if level < self.order and len(self.trie[level + 1].nodes) else own
            total = np.where(late, longer.total_after[np.where(late, prev, 0)], own.total[node])
            escape = np.where(late, longer.escape_after[np.where(late, prev, 0)], own.escape[node])
            out[active] += np.where(has, own.count[spot] - total, np.where(known, escape, 0.0))
            before[active] = np.where(known, node, -1)
            active = active[~has]
        root = self.trie[0]
        left = 256 - len(root.entries)
        out[active] -= np.log10(max(left, 1))
        return out


def score_texts(trie: Trie, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of each text's coded bytes."""
    out = np.zeros(len(at) - 1)
    order = trie.order
    logs = trie.logs(keys(seq, order))
    logs[~coded(at, order)] = 0.0
    sums = np.concatenate(([0.0], np.cumsum(logs)))
    out[:] = sums[np.maximum(at[1:] - order, 0)] - sums[np.maximum(at[:-1] - order, 0)]
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(k)
    k, n = k[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[heads], np.add.reduceat(n, heads) if len(k) else n


def count(training: DataFrame) -> DataFrame:
    """(kind, key, n): counts of all contexts with their symbol, of all words by hash, and of texts, over (text) rows.

    Each task counts its own texts in sorted arrays, handing on its distinct keys whenever they exceed a few millions.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: []}
        texts = 0

        def rows(kind: int) -> pa.RecordBatch:
            k, n = _summed(held[kind])
            held[kind] = []
            return pa.record_batch([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for b in batches:
            buf, offsets = text_bytes(b[0])
            texts += len(b)
            for lo, hi in pieces(offsets):
                seq, at, words, _ = sequences(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for kind, found in ((GRAM, keys(seq)[coded(at)]), (WORD, words)):
                    held[kind].append(np.unique(found, return_counts=True))
                    if sum(len(x[0]) for x in held[kind]) > 2_000_000:
                        held[kind] = [_summed(held[kind])]
                        if len(held[kind][0][0]) > 1_500_000:
                            yield rows(kind)
        for kind in held:
            if held[kind]:
                yield rows(kind)
        yield pa.record_batch([pa.array([TEXTS], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])

    return arrow(training.select("text"), tally, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def least_frequent(counted: DataFrame, most: int) -> int:
    """The smallest power of two that at most `most` rows' n reach; 1 if there are no more rows."""
    sizes = sorted(((r[0], r[1]) for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()), reverse=True)
    total = 0
    for b, n in sizes:
        total += n
        if total > most:
            return 1 << (b + 1)
    return 1


def looked_up(grams: DataFrame, held: int, asked: DataFrame, base: list[Level], order: int, entries: int) -> DataFrame:
    """(key, log): log10 P(symbol | context) of the distinct keys `asked` (key), under the trie of grams (key, n; `held` rows).

    `base` is the trie of a shorter order. All entries whose contexts end alike in that many bytes meet in a partition, which
    thus holds every longer context that an asked key escapes through; the base has the rest.
    """
    short = len(base) - 1
    shipped = grams.sparkSession.sparkContext.broadcast(base)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b[0].to_numpy(), b[1].to_numpy()) for b in batches]
        if not parts:
            return
        k, n = (np.concatenate(x) for x in zip(*parts))
        k = k.view(np.uint64)
        model = Trie(shipped.value + levels(k[n > 0], n[n > 0], order)[short + 1 :])
        wanted = k[n == 0]
        for lo in range(0, len(wanted), 1 << 18):
            some = wanted[lo : lo + (1 << 18)]
            yield pa.record_batch([pa.array(some.view(np.int64)), pa.array(model.logs(some))], ["key", "log"])

    ending = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * short)) - 1))
    rows = grams.unionByName(asked.select("key", F.lit(0).cast("long").alias("n")))
    return arrow(rows.repartition(parts_for(grams, held + asked.count(), max(entries // 8, 1 << 16)), ending), price, "key long, log double")


def score(docs: DataFrame, train: Column, order: int = ORDER, entries: int = ENTRIES, words: int = WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    The rows where `train` holds teach the model; held_out is its negation (a null counts as held out). Words are
    maximal runs of non-white-space with A-Z lowered, and each text has one end token. base_score is the smoothed unigram
    log10 probability of the tokens; score is the trie's log10 probability of the words joined by blanks, and the end, byte by
    byte. Null and blank texts have the end only; with no training rows every symbol has probability 1/256; other columns are ignored;
    an empty table gives no rows.

    Counts cover all training texts and grow with them, and contexts have `order` bytes at every size. What is broadcast does not
    grow: at most `entries` trie entries and `words` frequent words; counts of rarer words are joined. Beyond `entries`
    the frequent entries' probabilities are broadcast; the other contexts and symbols of the texts meet the trie in partitions by
    a shorter context, the longest whose entries can be broadcast. Words are told apart by XXH64.
    """
    prepare(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    learns = F.coalesce(train, F.lit(False))
    counted = cut(count(docs.where(learns)))
    vocabulary = counted.where(F.col("kind") == WORD).select("key", "n")
    facts = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    texts = counted.where(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    distinct, tokens = facts[0] + (texts > 0), facts[1] + texts
    least = least_frequent(vocabulary, words)
    common = vocabulary.where(F.col("n") >= least).toArrow().sort_by("key")
    grams = counted.where(F.col("kind") == GRAM).select("key", "n")
    held, short, base = grams.count(), order, grams
    while short > 1 and (held if short == order else base.count()) > entries:
        short -= 1
        base = cut(base.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * (short + 1))) - 1)).alias("key")).agg(F.sum("n").alias("n")))
    table = base.toArrow()
    trie = levels(table["key"].to_numpy().view(np.uint64), table["n"].to_numpy(), short)
    whole = short == order
    if whole:
        model = trie
    else:
        context_of = F.shiftrightunsigned("key", 8)
        chance = F.log10(F.col("n") - 0.5) - F.log10(F.sum("n").over(Window.partitionBy(context_of)))
        often = grams.withColumn("log", chance).where(F.col("n") >= least_frequent(grams, entries)).select("key", "log").toArrow()
        model = often["key"].to_numpy().view(np.uint64), often["log"].to_numpy()
    shipped = context.broadcast((model, common["key"].to_numpy().copy(), common["n"].to_numpy().copy()))
    unseen = float(np.log10(0.1) - np.log10(tokens + 0.1 * (distinct + 1)))
    scale = float(np.log10(tokens + 0.1 * (distinct + 1)))
    end = float(np.log10(texts + 0.1) - scale)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, n = shipped.value
        model = Trie(own) if whole else Table(*own)
        logs = np.log10(n + 0.1) - scale
        for b in batches:
            buf, offsets = text_bytes(b[2])
            out = {k: [] for k in ("tokens", "known", "base", "score", "rare", "asked", "asks")}
            for lo, hi in pieces(offsets):
                seq, at, h, doc = sequences(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], order)
                h = h.view(np.int64)
                order_ = np.argsort(h)
                spot = np.empty(len(h), np.int64)
                spot[order_] = np.searchsorted(known, h[order_])
                spot = np.minimum(spot, max(len(known) - 1, 0))
                has = known[spot] == h if len(known) else np.zeros(len(h), bool)
                m = hi - lo
                out["tokens"].append(np.bincount(doc, minlength=m) + 1)
                out["known"].append(np.bincount(doc[has], minlength=m) + (texts > 0))
                out["base"].append(np.bincount(doc[has], weights=logs[spot[has]], minlength=m) + end)
                if whole:
                    out["score"].append(score_texts(model, seq, at))
                else:
                    k = keys(seq, order)[coded(at, order)]
                    text = np.repeat(np.arange(m), np.diff(at) - order)
                    logs_, missing = model.find(k)
                    out["score"].append(np.bincount(text, weights=logs_, minlength=m))
                    out["asked"].append(k[missing].view(np.int64))
                    out["asks"].append(np.bincount(text[missing], minlength=m))
                rare = np.split(h[~has], np.cumsum(np.bincount(doc[~has], minlength=m))[:-1])
                out["rare"] += [x.tolist() for x in rare]
            columns = [pa.array(np.concatenate(out[k])) for k in ("tokens", "known", "base", "score")]
            asked = np.concatenate(out["asked"] or [np.empty(0, np.int64)])
            edges = np.concatenate(([0], np.cumsum(np.concatenate(out["asks"])))) if out["asks"] else np.zeros(len(b) + 1)
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(asked))
            yield pa.record_batch([b[0], b[1], *columns, pa.array(out["rare"], pa.list_(pa.int64())), lists], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "asked"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rated = arrow(docs.select("doc_id", (~learns).alias("held_out"), "text"), rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, asked array<long>")
    # A row number that reruns of a task repeat is needed to bring looked-up words back to their row.
    rated = cut(rated.withColumn("__row", F.monotonically_increasing_id()))
    asked = rated.select("__row", F.explode("rare").alias("key")).groupBy("__row", "key").agg(F.count("*").alias("times"))
    rarest = vocabulary.where(F.col("n") < least)
    looked = asked.join(rarest, "key", "left").withColumn("log", F.coalesce(F.log10(F.col("n") + 0.1) - F.lit(scale), F.lit(unseen)))
    summed = looked.groupBy("__row").agg(F.sum(F.col("times") * F.col("log")).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"))
    full = rated.drop("rare", "asked").join(summed, "__row", "left")
    score_ = F.col("score")
    if not whole:
        asked = rated.select("__row", F.explode("asked").alias("key")).groupBy("__row", "key").agg(F.count("*").alias("times"))
        priced = looked_up(grams, held, cut(asked.select("key").distinct()), trie, order, entries)
        sums = asked.join(priced, "key").groupBy("__row").agg(F.sum(F.col("times") * F.col("log")).alias("rest"))
        full = full.join(sums, "__row", "left")
        score_ = F.col("score") + F.coalesce("rest", F.lit(0.0))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score_.alias("score"),
    )
