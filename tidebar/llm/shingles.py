"""Word-shingle sets of whole texts as sorted 64-bit hashes, and one-permutation signatures of them."""

from __future__ import annotations

from functools import cache

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that part words: space and \x09 to \x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at a time, which bounds the work arrays whatever a text's length.
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_odd = lambda n: _rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE = _odd(256)
_BYTE[WHITE] = 0
_BASE = int(_odd(1)[0])
_PLACE = _odd(64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        step = min(k, n - k)
        out[k : k + step] = out[:step] * np.uint64(pow(base, k, 1 << 64))
        k += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of a 64-bit hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _block_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a block that cuts no word."""
    white = WHITE[buf]
    edge = np.diff(np.concatenate(([True], white, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_BASE, BLOCK + 1)[: len(buf)] if len(buf) <= BLOCK else _BYTE[buf] * _powers(_BASE, 1 << len(buf).bit_length())[: len(buf)], out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    back = _powers(inverse, BLOCK + 1) if len(buf) <= BLOCK else _powers(inverse, 1 << len(buf).bit_length())
    h = (sums[ends] - sums[starts]) * back[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words per text); letters A-Z are lower-cased."""
    joined = b"\n".join(texts).translate(LOWER)
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    hashes, places = [], []
    at = 0
    while at < len(joined):
        stop = min(len(joined), at + BLOCK)
        while stop < len(joined) and not WHITE[joined[stop]]:
            stop += 1
        h, s = _block_words(np.frombuffer(joined, np.uint8, stop - at, at))
        hashes.append(h)
        places.append(s + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(places) if places else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(s, offsets))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; with fewer words the whole sequence is one."""
    h, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled += h[j : len(h) - k + 1 + j] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    at = 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            out.append(mix((h[at : at + n] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _PLACE[k + n]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, equal for equal sets."""
    a = int(mix(s ^ _PLACE[40]).sum(dtype=np.uint64))
    b = int(mix(s * _PLACE[41]).sum(dtype=np.uint64))
    return a - (1 << 63), b - (1 << 63)


@cache
def _probes(bins: int) -> np.ndarray:
    """For each attempt and bin, the bin to borrow from: a fixed random function of both."""
    return np.random.Generator(np.random.PCG64(977)).integers(0, bins, (4096, bins))


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation minima with optimal densification; a row per set, none of them empty.

    The hash range is cut into ``bins`` equal parts; a bin's value is its smallest hash. An empty bin
    borrows from the first non-empty bin on its own random list of bins, which is the same list for
    every set, so that two sets agree in it as often as they are similar.
    """
    bounds = (np.arange(bins + 1, dtype=np.float64) * (2.0**64 / bins))
    edges = np.array([min(int(b), (1 << 64) - 1) for b in bounds], np.uint64)
    sig = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        at[-1] = len(s)
        has = at[:-1] < at[1:]
        full[i] = has
        sig[i, has] = s[at[:-1][has]]
    rows, cols = np.nonzero(~full)
    out = sig.copy()
    for probe in _probes(bins):
        if not len(rows):
            break
        source = probe[cols]
        ok = full[rows, source]
        out[rows[ok], cols[ok]] = sig[rows[ok], source[ok]]
        rows, cols = rows[~ok], cols[~ok]
    for r, c in zip(rows, cols, strict=True):  # after thousands of attempts: the next bin that has a value
        have = np.flatnonzero(full[r])
        out[r, c] = sig[r, have[np.searchsorted(have, c) % len(have)]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per set and band."""
    weights = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, (bands, rows), np.uint64) << np.uint64(1) | np.uint64(1)
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    return mix((mix(cut) * weights).sum(axis=2, dtype=np.uint64) + weights[:, 0]).view(np.int64)

