"""Sets of word shingles as 64-bit hashes, in numpy, many texts at a time.

Words are runs of characters other than blank and U+0009 to U+000D, A-Z
lower-cased; both can be told from the UTF-8 bytes.  A word is hashed as a
polynomial over its bytes from one prefix sum over the whole batch, a shingle
from the hashes of its words.  Two shingles are taken for the same if their
64-bit hashes agree.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_TABLE = np.random.default_rng(20241).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _A = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = U(pow(int(_P), -1, 1 << 64))
        out = []
        for base in (_P, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many of them each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    upto = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, upto), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted set of each text's shingles; a text of fewer words has its whole sequence as one, without words the empty set."""
    if not texts:
        return []
    words, counts = word_hashes(texts)
    n = len(words) - size + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        grams = grams * _A + words[k : k + n]
    grams = mixed(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(grams[at : at + c - size + 1]))
        elif c:
            h = U(c)
            with np.errstate(over="ignore"):
                for w in words[at : at + c]:
                    h = h * _A + w
            out.append(mixed(np.array([h ^ U(0x5851F42D4C957F2D)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def batched(texts: list[str | None], most_bytes: int = 1 << 20):
    """Lists of (first, encoded texts) of about most_bytes each; a longer text comes alone and whole."""
    first, part, held = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if part and held + len(b) > most_bytes:
            yield first, part
            first, part, held = i, [], 0
        part.append(b)
        held += len(b)
    if part:
        yield first, part
