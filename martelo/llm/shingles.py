"""Word shingles of whole texts as 64-bit hashes, in vectorised numpy over many texts at once.

Words are runs of ASCII letters and digits and of anything beyond ASCII, after lower-casing. A text of fewer words
than a shingle is one shingle of all its words; a text without words is one shingle of its raw letters; an empty
or null text has none.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WORDS = 5
#: Bytes hashed at once; longer buffers are cut between words.
SEGMENT = 1 << 21
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
RADIX = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(RADIX, -1, 1 << 64)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, U)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=U)
    return _powers[base][:n]


def _word_hashes(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one segment: differences of one polynomial's prefix sums."""
    raw = np.frombuffer(part, np.uint8)
    inside = np.concatenate(([False], IS_WORD[raw], [False]))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    sums = np.concatenate((np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * powers(RADIX, len(raw)), dtype=U)))
    return starts, mix((sums[ends] - sums[starts]) * powers(INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(U))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(buffer) <= SEGMENT:
        return _word_hashes(buffer)
    parts, at = [], 0
    while at < len(buffer):
        end = at + SEGMENT
        if end < len(buffer):
            cut = buffer.rfind(b" ", at, end)
            cut = cut if cut > at else buffer.find(b" ", end)
            end = cut if cut > 0 else len(buffer)
        starts, hashes = _word_hashes(buffer[at:end])
        parts.append((starts + at, hashes))
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


COEFFICIENTS = mix(np.arange(1, 65, dtype=U) * U(RADIX)) | U(1)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of every word, in order."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, hashes = word_hashes(b" ".join(raw))
    return np.searchsorted(offsets, starts, "right") - 1, hashes


def shingles(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of every shingle, with repeats, by text."""
    docs, words = words_of(texts)
    counts = np.bincount(docs, minlength=len(texts))
    own, made = [], []
    if len(words) >= k:
        n = len(words) - k + 1
        whole = docs[:n] == docs[k - 1 :]
        total = np.zeros(n, U)
        for j in range(k):
            total += words[j : j + n] * COEFFICIENTS[j]
        own.append(docs[:n][whole])
        made.append(mix(total[whole]))
    begins = np.concatenate(([0], np.cumsum(counts)))
    for i in np.flatnonzero(counts < k):
        if counts[i]:
            w = words[begins[i] : begins[i + 1]]
            own.append([i])
            made.append(mix((w * COEFFICIENTS[: len(w)]).sum(dtype=U, keepdims=True) + U(len(w))))
        elif texts[i]:
            own.append([i])
            made.append(np.frombuffer(blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), U))
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, U)
    docs, hashes = np.concatenate(own).astype(np.int64), np.concatenate(made)
    if len(own) > 1:
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return docs, hashes


def counted(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, hash, how often) of every distinct shingle, by text and hash."""
    docs, hashes = shingles(texts, k)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])))) if len(docs) else np.zeros(0, int)
    return docs[first], hashes[first], np.diff(np.concatenate((first, [len(docs)])))
