"""ProbMinHash signatures of weighted shingle sets.

Each shingle is a Poisson process of the rate of its weight; its arrivals fall on registers at random,
and a register keeps the shingle that arrives first.  Two signatures agree in a register with the
probability Jaccard similarity of the weighted sets.  A shingle is done as soon as its next arrival is
later than all registers of its document.
"""

from __future__ import annotations

import numpy as np

from .textkit import mix64, uniform

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of each document in ascending order, their counts, and n + 1 offsets."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    sorted_, of = hashes[order], doc[order]
    new = np.ones(len(sorted_), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(sorted_)])))
    return sorted_[at], counts, np.searchsorted(of[at], np.arange(n + 1))


def signatures(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """A row of shingle hashes for each document; of a document without shingles all 0."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    first = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    limit = np.full(n, np.inf)
    live = np.flatnonzero((sizes > 1)[doc])
    time = np.zeros(len(hashes))
    step, many = 0, 1
    while len(live):
        # Arrivals step ... step + many - 1 of each live shingle.
        seed = hashes[live, None] + (np.arange(step, step + many, dtype=np.uint64) + np.uint64(1)) * _GOLD
        draw = mix64(seed)
        at = time[live, None] + np.cumsum(-np.log(uniform(draw)) / weights[live, None], 1)
        place = doc[live, None] * registers + ((mix64(draw ^ _GOLD) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        near = at <= limit[doc[live], None]
        key, when = place[near], at[near]
        np.minimum.at(first, key, when)
        won = when == first[key]
        owner[key[won]] = np.broadcast_to(hashes[live, None], at.shape)[near][won]
        limit = first.reshape(n, registers).max(1)
        time[live] = at[:, -1]
        live = live[at[:, -1] <= limit[doc[live]]]
        step += many
        many = min(16, many * 2)
    out = owner.reshape(n, registers)
    single = np.flatnonzero(sizes == 1)
    out[single] = hashes[offsets[single]][:, None]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    part = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), part.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key ^ part[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
    return key
