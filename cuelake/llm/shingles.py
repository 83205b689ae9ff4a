"""Word shingles of whole texts as hashes, MinHash samples, band keys and odd sketches, by numpy for a batch at a time."""

from __future__ import annotations

import hashlib
import math

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
RANDOM = np.random.default_rng(20240501)
#: A random number for each byte; the space between words counts nothing.
OF_BYTE = RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OF_BYTE[32] = 0
STEP = int(RANDOM.integers(1, 1 << 62)) * 2 + 1
SKETCH_BITS = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: bytes) -> bytes:
    """A-Z in lower case, words set apart by single spaces."""
    return b" ".join(text.translate(LOWER).split())


def sequence_hash(text: bytes) -> tuple[int, int]:
    """128 bits of the words in their order, as two signed numbers."""
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each normalised text, one text after another, and the n + 1 bounds.

    A text with fewer words has one shingle, all its words; a text without words has none.
    """
    full = [t for t in texts if t]
    bounds = np.zeros(len(texts) + 1, np.int64)
    if not full:
        return np.zeros(0, np.uint64), bounds
    data = np.frombuffer(b" ".join(full) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    powers = np.full(int(sizes.max()) + 1, STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    inside = np.arange(len(data)) - np.repeat(starts, sizes + 1)
    words = mixed(np.add.reduceat(OF_BYTE[data] * powers[inside], starts) + sizes.astype(np.uint64))
    per_text = np.array([t.count(b" ") + 1 for t in full], np.int64)
    first = np.cumsum(per_text) - per_text
    text_of = np.repeat(np.arange(len(full)), per_text)
    left = np.repeat(first + per_text, per_text) - np.arange(len(words))  # words up to the text's end
    value = np.zeros(len(words), np.uint64)
    for j in range(min(k, len(words))):
        n = len(words) - j
        value[:n] = np.where(left[:n] > j, mixed(value[:n] + words[j:]), value[:n])
    is_start = left >= np.minimum(k, np.repeat(per_text, per_text))
    value, text_of = value[is_start], text_of[is_start]
    order = np.argsort(value)
    order = order[np.argsort(text_of[order].astype(np.uint16) if len(full) < 65536 else text_of[order], kind="stable")]
    value, text_of = value[order], text_of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text_of[1:] != text_of[:-1])
    value, text_of = value[fresh], text_of[fresh]
    counts = np.zeros(len(texts), np.int64)
    counts[[i for i, t in enumerate(texts) if t]] = np.bincount(text_of, minlength=len(full))
    bounds[1:] = np.cumsum(counts)
    return value, bounds


def bands_for(threshold: float, rows: int, miss: float = 1e-7) -> int:
    """Bands of `rows` samples so that a pair at the threshold shares none with a probability of `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def most_differences(threshold: float, samples: int, miss: float = 1e-9) -> int:
    """The least d such that a pair at the threshold differs in more than d of its samples with a probability of `miss` at most."""
    p, tail = 1 - threshold, 1.0
    for d in range(samples + 1):
        tail -= math.comb(samples, d) * p**d * (1 - p) ** (samples - d)
        if tail <= miss:
            return d
    return samples


def min_samples(hashes: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """(texts, samples) least hash values; every text must have a shingle."""
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
    out = np.empty((len(bounds) - 1, samples), np.uint32)
    for i in range(samples):
        out[:, i] = np.minimum.reduceat(((hashes * factors[i] + shifts[i]) >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) keys, different for different bands."""
    bands = minima.shape[1] // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(minima), 1))
    for r in range(rows):
        key = mixed(key + minima[:, r : bands * rows : rows].astype(np.uint64))
    return key.view(np.int64)


def odd_sketches(minima: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """(texts, bits / 64) words: bit b tells whether an odd number of the samples (i, value) hash to b."""
    n, samples = minima.shape
    place = (mixed(minima.astype(np.uint64) + (np.arange(samples, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount((place + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits).reshape(n, bits)
    return np.packbits((counts & 1).astype(np.uint8), axis=1).view(np.int64)
