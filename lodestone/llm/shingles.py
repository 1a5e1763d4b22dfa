"""Word shingle sets and SuperMinHash signatures on NumPy arrays, for whole texts.

A word is a run of non-space after A-Z are lower-cased; a document's set holds its distinct k-word shingles as 64-bit
hashes; fewer than k words make one shingle of all of them; no words make an empty set.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash, forgotten when there are too many to hold."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value


def scramble(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def shingle_set(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, U)
    hashes = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = max(1, len(words) - k + 1)
    acc = np.full(n, len(words) if len(words) < k else k, U)
    for i in range(min(k, len(words))):
        acc = scramble(acc + GOLD + hashes[i : i + n])
    return np.unique(acc)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash: each element visits the m slots in its own random order, the j-th of them with rank j + r, r uniform;
    a slot keeps its least. A set stops once all its slots hold ranks that no later visit can beat. Sets must not be empty."""
    out = np.full(len(sets) * m, np.iinfo(np.uint64).max, U)
    elements = np.concatenate(sets) if sets else np.empty(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    for j in range(m):
        if not len(elements):
            break
        draw = scramble(elements + U(int(GOLD) * (j + 1) % (1 << 64)))
        pick = j + (((draw & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.intp)
        if j == 0:
            slot, first = pick, pick
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
                rows = np.arange(len(elements))
                order[rows, first] = 0
                order[:, 0] = first
            rows = np.arange(len(elements))
            slot = order[rows, pick].astype(np.intp)
            order[rows, pick] = order[:, j]
        np.minimum.at(out, owner * m + slot, (U(j) << U(32)) | (draw >> U(32)))
        open_ = (out.reshape(len(sets), m).max(axis=1) >> U(32)) > U(j)
        if not open_.all():
            on = open_[owner]
            if not on.all():
                elements, owner = elements[on], owner[on]
                if j == 0:
                    first = first[on]
                else:
                    order = order[on]
    return out.reshape(len(sets), m)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys: sets x bands."""
    parts = signature.reshape(len(signature), bands, rows)
    acc = np.broadcast_to(np.arange(bands, dtype=U), parts.shape[:2]).copy()
    for i in range(rows):
        acc = scramble(acc + GOLD + parts[:, :, i])
    return acc


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    raw = values.tobytes()
    return xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)


def chunks(sets: list[np.ndarray], limit: int):
    """Ranges of sets with about limit elements in all; a larger set is alone."""
    start, held = 0, 0
    for i, s in enumerate(sets):
        if i > start and held + len(s) > limit:
            yield start, i
            start, held = i, 0
        held += len(s)
    if start < len(sets):
        yield start, len(sets)
