"""Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

Language identification and toxicity share it. A text is lower-cased (A-Z), every run of white space becomes
one blank, and byte n-grams of the given sizes are hashed into buckets; each bucket has an embedding, a text the average of
its own, and a softmax over the average gives the classes. As both layers are linear, a trained model is one
score per bucket and class, so prediction reads one small table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from kinlink.llm.common import LOWER, SPACE, pieces

#: Odd 32-bit multipliers for rolling and spreading (arbitrary fixed values).
ROLL, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@dataclass
class Shape:
    """What is hashed and trained. within_words leaves out n-grams that hold a blank between other bytes."""

    sizes: tuple[int, ...] = (2, 3, 4)
    bits: int = 14
    dim: int = 16
    within_words: bool = False
    #: A text's n-gram sum is divided by count ** power: 1 is the average.
    power: float = 1.0
    epochs: int = 8
    rate: float = 0.05
    decay: float = 1e-6
    batch: int = 64
    #: Small samples are gone through more often, until the fit has taken so many steps.
    least_steps: int = 400
    #: Spread of the starting vectors; small, as n-grams never seen in training keep theirs.
    spread: float = 0.001
    seed: int = 7


@dataclass
class Model:
    """classes, and for each its score per bucket (row 0 of the averages) with bias, temperature and rejection level."""

    shape: Shape
    classes: list = field(default_factory=list)
    table: np.ndarray = None  # classes x buckets, float32
    bias: np.ndarray = None
    temperature: float = 1.0
    reject: float = 0.0
    prior: np.ndarray = None  # the classes' shares: what a text without n-grams gets


def normal(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, each text with one blank before, between and after its words; offsets of the texts."""
    n = len(offsets) - 1
    out = np.full(len(buf) + 2 * n, 32, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(buf)) + 2 * doc + 1] = np.where(SPACE[buf], 32, LOWER[buf])
    first = offsets[:-1] + 2 * np.arange(n)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[first] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], before[np.concatenate((first, [len(out)]))]


def grams(flat: np.ndarray, offsets: np.ndarray, shape: Shape):
    """For each n: bucket numbers of the n-grams and the texts' offsets into them."""
    wide = flat.astype(np.uint32)
    blank = flat == 32
    shift = np.uint32(32 - shape.bits)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    h = np.zeros(len(flat), np.uint32)
    inner = np.zeros(len(flat), bool)
    for n in range(1, max(shape.sizes) + 1):
        size = len(flat) - n + 1
        if size <= 0:
            break
        h = h[:size] * ROLL + wide[n - 1 :]
        if n > 2:
            inner = inner[:size] | blank[n - 2 : n - 2 + size]
        if n in shape.sizes:
            good = np.arange(n, n + size) <= doc_end[:size]
            if shape.within_words:
                good &= ~inner[:size]
            count = np.concatenate(([0], np.cumsum(good)))
            yield n, (h[good] * SPREAD + np.uint32(n) * ROLL) * SPREAD >> shift, count[np.minimum(offsets, size)]


def bags(buf: np.ndarray, offsets: np.ndarray, shape: Shape) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    out = []
    for lo, hi in pieces(offsets):
        flat, at = normal(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        parts = list(grams(flat, at, shape))
        for d in range(hi - lo):
            own = [b[o[d] : o[d + 1]] for _, b, o in parts]
            out.append(np.unique(np.concatenate(own) if own else np.empty(0, np.uint32), return_counts=True))
    return out


def logits(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x classes, before the temperature; a text without n-grams has those of the classes' shares."""
    out = np.zeros((len(offsets) - 1, len(model.classes)))
    empty = np.zeros(len(out), bool)
    for lo, hi in pieces(offsets):
        flat, at = normal(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        n = np.zeros(hi - lo)
        for _, bucket, o in grams(flat, at, model.shape):
            sizes = np.diff(o)
            n += sizes
            full = np.flatnonzero(sizes)
            if len(full):
                for k, scores in enumerate(model.table):
                    out[lo + full, k] += np.add.reduceat(scores[bucket], o[full], dtype=np.float64)
        out[lo:hi] /= np.maximum(n, 1)[:, None] ** model.shape.power
        empty[lo:hi] = n == 0
    out += model.bias
    if model.prior is not None:
        out[empty] = model.temperature * np.log(np.maximum(model.prior, 1e-12))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Batch:
    """A minibatch: its rows, the buckets that occur, and its bags' entries by bucket."""

    rows: np.ndarray
    used: np.ndarray
    starts: np.ndarray  # where each used bucket's entries begin
    row: np.ndarray  # the row of each entry, as a place in rows
    weights: np.ndarray  # its count as a share of the row's

    def hidden(self, vectors: np.ndarray) -> np.ndarray:
        """The rows' averages, from the vectors of the used buckets."""
        each = np.repeat(vectors, np.diff(self.starts, append=len(self.row)), axis=0) * self.weights[:, None]
        return np.stack([np.bincount(self.row, each[:, d], len(self.rows)) for d in range(each.shape[1])], axis=1).astype(np.float32)

    def gradient(self, back: np.ndarray) -> np.ndarray:
        """What the rows' gradients are for the used buckets."""
        return np.add.reduceat(back[self.row] * self.weights[:, None], self.starts, axis=0)


def batched(rows: list[tuple[np.ndarray, np.ndarray]], shape: Shape, rng: np.random.Generator) -> list[Batch]:
    """The non-empty bags in random minibatches, indexed once for all epochs; the list of bags is emptied, to hold each entry once."""
    full = np.array([i for i, (b, _) in enumerate(rows) if len(b)], np.int64)
    order, out = rng.permutation(full), []
    for lo in range(0, len(order), shape.batch):
        pick = order[lo : lo + shape.batch]
        buckets = np.concatenate([rows[i][0] for i in pick])
        row = np.repeat(np.arange(len(pick), dtype=np.uint8 if len(pick) <= 256 else np.int32), [len(rows[i][0]) for i in pick])
        weights = np.concatenate([(rows[i][1] / max(rows[i][1].sum(), 1) ** shape.power).astype(np.float32) for i in pick])
        for i in pick:
            rows[i] = None
        by = np.argsort(buckets, kind="stable")
        buckets = buckets[by]
        starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))).astype(np.int32)
        out.append(Batch(pick, buckets[starts], starts, row[by], weights[by]))
    rows.clear()
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: list, shape: Shape, weights: np.ndarray | None = None) -> Model:
    """Fit embeddings and softmax together (minibatches in a new order each epoch, Adam steps of the stochastic gradient). Empties rows."""
    rng = np.random.default_rng(shape.seed)
    k, buckets = len(classes), 1 << shape.bits
    params = [rng.normal(0, shape.spread, (buckets, shape.dim)).astype(np.float32), rng.normal(0, 1 / np.sqrt(shape.dim), (shape.dim, k)).astype(np.float32), np.zeros(k, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weights = np.ones(len(rows)) if weights is None else weights
    batches = batched(rows, shape, rng)
    epochs = max(shape.epochs, -(-shape.least_steps // max(1, len(batches)))) if batches else 0
    step, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for one in rng.permutation(len(batches)):
            batch = batches[one]
            pick, used = batch.rows, batch.used
            hidden = batch.hidden(params[0][used])
            p = softmax(hidden @ params[1] + params[2])
            p[np.arange(len(pick)), labels[pick]] -= 1
            p = (p * (weights[pick] / len(pick))[:, None]).astype(np.float32)
            back = p @ params[1].T
            step += 1
            rate = np.float32(shape.rate * (1 - (step - 1) / total))
            grads = [batch.gradient(back), hidden.T @ p, p.sum(axis=0)]
            one_, two_ = np.float32(1 - 0.9**step), np.float32(1 - 0.99**step)
            for q, g, m, v, at in zip(params, grads, first, second, (used, slice(None), slice(None))):
                old, m_, v_ = q[at], m[at], v[at]
                m_ += np.float32(0.1) * (g - m_)
                v_ += np.float32(0.01) * (g * g - v_)
                m[at], v[at] = m_, v_
                q[at] = old * (1 - rate * np.float32(shape.decay)) - (rate / one_) * m_ / (np.sqrt(v_ / two_) + np.float32(1e-8))
    return Model(shape, classes, np.ascontiguousarray((params[0] @ params[1]).T.astype(np.float32)), params[2].astype(np.float64))


def bag_logits(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logits of bags, as `logits` gives them for texts."""
    out = [model.table[:, b] @ c / max(c.sum(), 1) ** model.shape.power for b, c in rows]
    return np.array(out).reshape(len(rows), len(model.classes)) + model.bias


def calibrate(model: Model, z: np.ndarray, labels: np.ndarray, weights: np.ndarray, reject_share: float = 0.001) -> None:
    """Fit the temperature to held-back logits, and the confidence that all but reject_share of the right ones reach (at most 0.5)."""
    if not len(z):
        return
    own = np.arange(len(z)), labels
    grid = np.geomspace(0.1, 10, 41)
    loss = [-(weights * np.log(np.maximum(softmax(z / t)[own], 1e-12))).sum() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p[own][p.argmax(axis=1) == labels]
    model.reject = float(min(0.5, np.quantile(right, reject_share))) if len(right) else 0.0
