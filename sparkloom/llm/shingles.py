"""Sets of word shingles and their b-bit MinHash signatures, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
#: Signature: this many symbols of 16 bits.
SYMBOLS = 64
#: Words that a worker remembers.
WORDS = 500_000

_known: dict[bytes, int] = {}
_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(1, 1 << 63, size=SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, size=SYMBOLS, dtype=np.uint64)
_PLACES = _rng.integers(1, 1 << 63, size=WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def words(text: bytes) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    if len(_known) > WORDS:
        _known.clear()
    for w in set(found).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, found), dtype=np.uint64, count=len(found))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of fewer words, the whole sequence is one; of none, none."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(found)
    if len(found) < width:
        return mix((h * _PLACES[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    n = len(h) - width + 1
    total = h[:n] * _PLACES[0]
    for k in range(1, width):
        total += h[k : k + n] * _PLACES[k]
    return np.unique(mix(total))


def shingle_sets(lines: list[list[bytes]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingle_set for many lists of words at once, none empty: their hashes one set after the other, and where each begins."""
    sizes = np.array([len(x) for x in lines])
    h = word_hashes([w for x in lines for w in x])
    line = np.repeat(np.arange(len(lines)), sizes)
    n = max(0, len(h) - width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += h[k : k + n] * _PLACES[k]
    inside = line[:n] == line[width - 1 :][:n]
    found, owner = mix(total[inside]), line[:n][inside]
    begins = np.cumsum(sizes) - sizes
    few = [(k, mix((h[begins[k] : begins[k] + sizes[k]] * _PLACES[: sizes[k]]).sum(dtype=np.uint64, keepdims=True) + np.uint64(sizes[k]))[0]) for k in np.flatnonzero(sizes < width).tolist()]
    if few:
        found, owner = np.append(found, np.array([x for _, x in few], dtype=np.uint64)), np.append(owner, [k for k, _ in few])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[first], owner[first]
    return found, np.searchsorted(owner, np.arange(len(lines)))


def signatures(hashes: np.ndarray, begins: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """The first symbols of signature() for sets that follow each other, none empty."""
    least = np.full((len(begins), symbols), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        values = hashes[at : at + 4096, None] * _FACTORS[:symbols] + _TERMS[:symbols]
        a, z = np.searchsorted(begins, at, side="right") - 1, np.searchsorted(begins, at + len(values))
        cuts = np.maximum(begins[a:z] - at, 0)
        least[a:z] = np.minimum(least[a:z], np.minimum.reduceat(values, cuts, axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 16 low bits of a mix of each permutation's least value."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS + _TERMS).min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, of sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
