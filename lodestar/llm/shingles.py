"""Word shingles, MinHash values and sketches of whole batches of texts, in numpy without a loop over words."""

from __future__ import annotations

import numpy as np

_TABLE = np.zeros(256, np.uint64)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789", 1):
    _TABLE[_c] = _i
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, text index of each, number of words of each text).

    Words are maximal runs of a-z and 0-9 after lower-casing; a shingle is ``words`` consecutive ones. Null texts have no words.
    """
    parts = [(t or "").lower().encode("utf-8", "ignore") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    values = _TABLE[np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)]
    inside = values > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = np.flatnonzero(first)
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    if not len(begin):
        return none
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - begin[word]
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    heads = np.flatnonzero(place == 0)
    h = mix64(np.add.reduceat(values[at] * powers[place], heads))
    text = np.searchsorted(np.cumsum(sizes), begin, side="right")
    counts = np.bincount(text, minlength=len(texts))
    if len(h) < words:
        return none[0], none[1], counts
    n = len(h) - words + 1
    s = h[:n].copy()
    for j in range(1, words):
        s = s * _STEP + h[j : n + j]
    ok = text[:n] == text[words - 1 :]
    return mix64(s[ok]), text[:n][ok], counts


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle once per text, sorted by text and hash."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[keep], t[keep]


def shingle_sets(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``distinct`` by one plain sort: the lowest bits of a hash, as many as number the texts, are dropped."""
    if not len(text):
        return hashes, text
    bits = np.uint64(max(1, int(text.max()).bit_length()))
    both = (text.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    both.sort()
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    return both << bits, (both >> (np.uint64(64) - bits)).astype(np.int64)


def fingerprints(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """64-bit fingerprint of each text's set of shingles, given as ``distinct`` gives them."""
    kept = mix64(hashes & np.uint64(0xFFFFFFFFFFFF0000))  # the same bits whatever the number of texts in the step
    out, starts = np.zeros(n, np.uint64), np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
    if len(text):
        out[text[starts]] = np.add.reduceat(kept, starts)
    return mix64(out + np.bincount(text, minlength=n).astype(np.uint64))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(hashes: np.ndarray, text: np.ndarray, mults: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their MinHash values: one row per text, one column per multiplier)."""
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
    out = np.empty((len(starts), len(mults)), np.uint32)
    upper, product = np.ascontiguousarray((hashes >> np.uint64(32)).astype(np.uint32)), np.empty(len(hashes), np.uint32)
    for j, m in enumerate(mults):
        if len(starts):
            np.multiply(upper, m, out=product)
            out[:, j] = np.minimum.reduceat(product, starts)
    return text[starts], out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` MinHash values, different bands never sharing a key space."""
    bands = values.shape[1] // rows
    v = values.astype(np.uint64).reshape(len(values), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(values), bands)).copy()
    for j in range(rows):
        key = mix64(key + v[:, :, j] * _BASE)
    return key.view(np.int64)
