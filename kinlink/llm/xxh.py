"""XXH64 of many byte ranges at once, in numpy (the public algorithm, vectorised over ranges of one length)."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

#: Longer ranges are hashed one by one.
LONG = 512


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _same_length(buf: np.ndarray, words: np.ndarray, halves: np.ndarray, at: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """The hashes of buf[a:a+n] for every a; words and halves read 8 and 4 bytes at any offset."""
    done = 0
    if n >= 32:
        v = [np.full(len(at), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while done + 32 <= n:
            for k in range(4):
                v[k] = _round(v[k], words[at + (done + 8 * k)])
            done += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.zeros_like(x), x)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, np.uint64)
    h += np.uint64(n)
    while done + 8 <= n:
        h = _rotl(h ^ _round(np.zeros_like(h), words[at + done]), 27) * P1 + P4
        done += 8
    if done + 4 <= n:
        h = _rotl(h ^ (halves[at + done].astype(np.uint64) * P1), 23) * P2 + P3
        done += 4
    while done < n:
        h = _rotl(h ^ (buf[at + done].astype(np.uint64) * P5), 11) * P1
        done += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of every buf[start:start+length]."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    halves = np.ndarray((len(buf) + 1,), "<u4", padded, 0, (1,))
    kept = np.minimum(lengths, LONG + 1).astype(np.uint16)
    order = np.argsort(kept, kind="stable")
    edges = np.flatnonzero(np.diff(kept[order], prepend=-1, append=LONG + 2))
    with np.errstate(over="ignore"):
        for lo, hi in zip(edges[:-1], edges[1:]):
            at, n = order[lo:hi], int(kept[order[lo]])
            if n <= LONG:
                out[at] = _same_length(buf, words, halves, starts[at], n, np.uint64(seed))
            else:
                out[at] = [xxhash.xxh64_intdigest(buf[s : s + k].tobytes(), seed) for s, k in zip(starts[at], lengths[at])]
    return out
