r"""Word shingles, MinHash samples and odd sketches of many texts at once, in numpy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A
shingle is the hash of five words in a row; a text of fewer words has its whole
sequence as its one shingle, a text without words has none.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

WIDTH = 5
#: MinHash samples: BANDS bands of ROWS. A pair of similarity 0.85 shares no
#: band with a probability of (1 - 0.85**5)**32, below 1e-8.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch.
BITS = 256
#: Probability with which the sketches may rule out a pair at the threshold.
MISS = 1e-8


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE = splitmix(np.arange(256, dtype=np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
PLACE = splitmix(np.arange(1000, 1000 + WIDTH, dtype=np.uint64)) | np.uint64(1)
FACTORS = (splitmix(np.arange(5000, 5000 + SAMPLES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = splitmix(np.arange(9000, 9000 + SAMPLES, dtype=np.uint64)).astype(np.uint32)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's words begin (with the end appended)."""
    coded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded], dtype=np.int64)
    white = WHITE[raw]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    letters = np.flatnonzero(~white)
    word = np.cumsum(np.concatenate([[True], white[:-1]])[letters] | (letters == (starts[0] if len(starts) else -1))) - 1
    with np.errstate(over="ignore"):
        place = splitmix((letters - starts[word]).astype(np.uint64)) if len(letters) else np.zeros(0, np.uint64)
        mixed = BYTE[LOWER[raw[letters]]] * (place | np.uint64(1))
        firsts = np.searchsorted(letters, starts)
        hashes = splitmix(np.add.reduceat(mixed, firsts)) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    n = max(0, len(words) - WIDTH + 1)
    with np.errstate(over="ignore"):
        every = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            every += words[k : k + n] * PLACE[k]
        every = splitmix(every)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                out.append(np.unique(every[a : b - WIDTH + 1]))
            elif b > a:
                out.append(splitmix((words[a:b] * PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            best = np.minimum(best, (part[None, :] * FACTORS[:, None] + SHIFTS[:, None]).min(1))
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for rows of samples."""
    rows = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = splitmix(key ^ rows[:, :, i])
    return key


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """BITS parity bits per row: a bit tells whether an odd number of samples fell on it."""
    where = splitmix(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    flat = where.astype(np.int64) + np.arange(len(samples))[:, None] * BITS
    odd = np.bincount(flat.ravel(), minlength=len(samples) * BITS) & 1
    return np.packbits(odd.astype(bool).reshape(len(samples), BITS), axis=1)


@functools.cache
def farthest(percent: int) -> int:
    """The XOR population count that sketches of sets of this similarity exceed with a probability of MISS at most.

    The samples that differ are binomial; each throws two balls, and the count is that of the bits with an odd number.
    """
    differ = np.ones(1)
    for _ in range(SAMPLES):
        differ = np.convolve(differ, [percent / 100, 1 - percent / 100])
    bits = np.arange(BITS + 1) / BITS
    odd, counts = np.eye(1, BITS + 1)[0], np.zeros(BITS + 1)
    for chance in differ:
        counts += chance * odd
        for _ in range(2):
            up, down = odd * (1 - bits), odd * bits
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
    beyond = np.append(counts[::-1].cumsum()[::-1][1:], 0)
    return int(np.argmax(beyond <= MISS))
