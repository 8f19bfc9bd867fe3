"""Token ids of whole texts by a public word-level BPE, through a bounded cache of words.

The tokenizer splits a text into words before it merges anything, so a word's ids don't depend on its neighbours.
Texts of Latin-1 letters are split by numpy, many at once, and each distinct word is merged once by the tokenizer's
own model and kept; texts are put together from the cache. Texts with other letters, control characters,
apostrophes (the splitting rule has contractions) or special tokens' strings go to the tokenizers library whole.
Either way the ids are the library's own.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from .shingles import INVERSE, RADIX, U, mix, powers

UNUSUAL = re.compile(r"[^\t\n\r\x20-\x26\x28-\x7e\xa1-\xac\xae-\xff]|<\|")
CACHED_WORDS = 200_000
#: Letters joined at once: bounds the arrays; a longer text is an array of its own.
JOINED = 1 << 20
SPACE, LETTER, DIGIT, OTHER = range(4)
#: How the tokenizer's file splits words: runs of letters, single digits, runs of anything else.
KIND = np.array([SPACE if chr(i).isspace() else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(256)], np.int8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [i for i in range(256) if 0x21 <= i <= 0x7E or 0xA1 <= i <= 0xAC or 0xAE <= i <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(i) if i in set(plain) else chr(next(rest)) for i in range(256)]


class Encoder:
    """Texts to their ids as little-endian unsigned 32-bit bytes. A null text has none."""

    def __init__(self, path: str | None = None, cached_words: int = CACHED_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached_words = Tokenizer.from_file(path or default_path()), cached_words
        self.model, self.letters, self.cache = self.tokenizer.model, byte_letters(), {}

    def word(self, raw: bytes) -> bytes:
        letters = "".join([self.letters[b] for b in raw.decode("latin-1").encode()])
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, plain, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if UNUSUAL.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            plain.append(i)
            size += len(text)
            if size > JOINED:
                self._joined(texts, plain, out)
                plain, size = [], 0
        self._joined(texts, plain, out)
        return out

    def _joined(self, texts: list, plain: list[int], out: list[bytes]) -> None:
        raw = [texts[i].lower().encode("latin-1") for i in plain]
        buffer = b" ".join(raw)
        letters = np.frombuffer(buffer, np.uint8)
        kind = np.concatenate(([0], KIND[letters], [0])).astype(np.int8)
        here = kind[1:-1]
        starts = np.flatnonzero((here > 0) & ((here != kind[:-2]) | (here == DIGIT)))
        ends = np.flatnonzero((here > 0) & ((here != kind[2:]) | (here == DIGIT))) + 1
        if not len(starts):
            return
        sums = np.concatenate((np.zeros(1, U), np.cumsum((letters.astype(U) + U(1)) * powers(RADIX, len(letters)), dtype=U)))
        hashes = mix((sums[ends] - sums[starts]) * powers(INVERSE, len(letters) + 1)[starts] + (ends - starts).astype(U))
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.cache) > self.cached_words:
            self.cache.clear()
        parts = [self.cache.get(h) for h in distinct.tolist()]
        for n, part in enumerate(parts):
            if part is None:
                at = first[n]
                parts[n] = self.cache[int(distinct[n])] = self.word(buffer[starts[at] : ends[at]])
        sizes = np.array([len(p) // 4 for p in parts])
        ids, begins = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        own = sizes[codes]
        total = np.cumsum(own)
        flat = ids[np.arange(total[-1]) + np.repeat(begins[codes] - (total - own), own)]
        # where each text's words end among all words, hence its ids among all ids
        text_ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
        cuts = np.concatenate(([0], total))[text_ends]
        for i, a, b in zip(plain, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            out[i] = flat[a:b].tobytes()


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Encoder:
    """One for each worker process, so that its cache outlives a task."""
    return Encoder(path)
