"""Vectorised word-shingle sets and parity-sketch signatures.

Whole texts are hashed with NumPy: every word gets a position-independent
polynomial hash from prefix sums, five consecutive words give one 64-bit
shingle, and a document becomes its sorted array of distinct shingles.

A document's parity sketch splits the hash range into ``K`` parts and XORs the
shingles of a part into one word.  A shingle held by only one of two documents
changes one word, so the number of differing words is at most the size of the
symmetric difference.  Two sets of ``a`` and ``b`` shingles with similarity of
at least 3/4 differ in at most ``(a + b) // 7`` shingles; the first part that
no difference touches and that is not empty therefore lies within the first
``(a + b) // 7 + 1`` non-empty parts of both, and those are all that is emitted.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: Sets below this size use one part per shingle; above, sizes double from band to band.
SMALL = 64
LEVEL_BITS = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INV = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of ``data``; A-Z count as a-z."""
    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.diff(gap.view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    up, down = _pow(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    return start, mix(h + mix((end - start).astype(np.uint64)))


def shingle_sets(texts: list[str | None], chunk: int = 1 << 20):
    """Yields one sorted array of distinct shingle hashes per text, in order.

    A null or wordless text gives an empty array; fewer than five words give one
    shingle over the whole sequence.
    """
    at = 0
    while at < len(texts):
        parts, sizes, total = [], [], 0
        while at < len(texts) and (not parts or total < chunk):
            b = (texts[at] or "").encode("utf-8", "surrogatepass")
            parts.append(b)
            sizes.append(len(b) + 1)
            total += len(b) + 1
            at += 1
        start, h = word_hashes(b" ".join(parts))
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
        if len(h) >= WORDS:
            m = len(h) - WORDS + 1
            s = h[:m].copy()
            for k in range(1, WORDS):
                s = s * _U(0xD6E8FEB86659FD93) + h[k : m + k]
            s = mix(s)
        else:
            s = np.zeros(0, np.uint64)
        for i in range(len(parts)):
            lo, hi = bounds[i], bounds[i + 1]
            n = hi - lo
            if n >= WORDS:
                yield np.unique(s[lo : hi - WORDS + 1])
            elif n:
                acc = mix(np.array([n], np.uint64))
                for k in range(lo, hi):
                    acc = mix(acc * _U(0xD6E8FEB86659FD93) + h[k])
                yield acc
            else:
                yield np.zeros(0, np.uint64)


def band(n: int) -> int:
    """Band 0 holds sizes under SMALL; band j >= 1 holds [SMALL * 2**(j-1), SMALL * 2**j)."""
    return max(0, int(n // SMALL).bit_length())


def _parts(level: int) -> int:
    top = SMALL << level
    return top if top <= 512 else top // 2


def _emit(h: np.ndarray, level: int, need: int, seed: int) -> tuple[np.ndarray, bool]:
    """The first ``need`` non-empty words of the parity sketch at a band's part count, and whether fewer exist."""
    salt = mix(np.array([level * 1_000_003 + seed], np.uint64))[0]
    if level == 0:
        return mix(h[:need] ^ salt), len(h) < need
    k = _U(_parts(level))
    part = ((h >> _U(32)) * k) >> _U(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    lack = len(first) < need
    end = first[need] if len(first) > need else len(h)
    first = first[:need]
    word = np.bitwise_xor.reduceat(mix(h[:end]), first)
    return mix(word ^ mix(part[first] + salt)), lack


def signatures(s: np.ndarray, seed: int = 0) -> tuple[np.ndarray, bool]:
    """All signatures under which a set can meet a partner, and whether the pigeonhole argument lacks parts.

    A pair meets in the band of its smaller set.  A set always emits in its own
    band, and in the band below as well if a partner of 3/4 its size lies there.
    """
    n = len(s)
    if not n:
        return s, False
    h = np.sort(mix(s ^ _U(seed))) if seed else s
    own = band(n)
    out, lack = _emit(h, own, (n + n * DEN // NUM) // 7 + 1, seed)
    low = band(-(-n * NUM // DEN))
    if low < own:
        more, l2 = _emit(h, low, (n + (SMALL << low) - 1) // 7 + 1, seed)
        out, lack = np.concatenate([out, more]), lack or l2
    return out, lack


def all_signatures(s: np.ndarray, seed: int = 0) -> list[tuple[int, int, np.ndarray]]:
    """For each level of a set: the level, how many non-empty parts it has beyond the pigeonhole's, and the signatures of all.

    The level stands in a signature's lowest ``LEVEL_BITS`` bits.
    """
    n = len(s)
    h = np.sort(mix(s ^ _U(seed))) if seed else s
    own, low = band(n), band(-(-n * NUM // DEN))
    out = []
    for level, need in ((own, (n + n * DEN // NUM) // 7 + 1), (low, (n + (SMALL << low) - 1) // 7 + 1)):
        if not out or low < own:
            sig, _ = _emit(h, level, n, seed)
            out.append((level, len(sig) - need, (sig >> _U(LEVEL_BITS) << _U(LEVEL_BITS)) | _U(level)))
    return out


def lacks(s: np.ndarray, seed: int = 0) -> bool:
    """Whether a set has too few non-empty parts in a band, so that another seed is needed."""
    n = len(s)
    own, low = band(n), band(-(-n * NUM // DEN))
    h = np.sort(mix(s ^ _U(seed))) if seed else s
    for level, need in ((own, (n + n * DEN // NUM) // 7 + 1), (low, (n + (SMALL << low) - 1) // 7 + 1)):
        if level and len(np.unique(((h >> _U(32)) * _U(_parts(level))) >> _U(32))) < need:
            return True
    return False


def set_id(s: np.ndarray) -> int:
    """A 64-bit identity of a set, as a signed integer."""
    if not len(s):
        return 0
    m = mix(s)
    return int(mix(np.add.reduce(m, keepdims=True) ^ mix(np.bitwise_xor.reduce(m, keepdims=True) + _U(len(s)))).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity, by their whole contents."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def similar_to(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of several sorted sets reach the similarity with ``s``, by their whole contents."""
    size = np.array([len(x) for x in others])
    every = np.concatenate(others)
    both = np.add.reduceat(s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every, np.cumsum(size) - size, dtype=np.int64)
    return DEN * both >= NUM * (len(s) + size - both)


def sketch_words(level: int) -> int:
    """64-bit words of the bit sketch that all sets of a band and the band above share."""
    return (SMALL << level) * 4 // 64


def bit_sketch(s: np.ndarray, level: int) -> np.ndarray:
    """One parity bit for each hash bucket; two sketches differ in at most as many bits as the sets do."""
    bits = sketch_words(level) * 64
    odd = np.bincount((mix(s + _U(0x51ED27)) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def may_link(na: int, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` can reach the similarity with ``a``, by sizes and by the sketches' Hamming distance."""
    fits = DEN * np.minimum(nb, na) >= NUM * np.maximum(nb, na)
    out = np.zeros(len(nb), dtype=bool)
    at = np.flatnonzero(fits)
    if len(at):
        apart = np.bitwise_count(b[at] ^ a).sum(axis=1)
        out[at] = apart <= (na + nb[at]) // 7
    return out
