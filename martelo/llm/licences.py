"""Fuzzy search for short licence notices: exact seeds from a pigeonhole split, then bounded-error matching.

A notice of n letters may be off by k = n // EDIT_EVERY edits. Cut into k + 1 pieces, one piece at least stands
intact in any such occurrence, so one Aho-Corasick pass over the pieces finds every candidate place; only there
does the regex library's bounded-error matching run, report the span and count the edits. The words that tell
one licence from another (`keys`) must stand unharmed, which keeps "mpl" from passing for "mit" with two edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows

EDIT_EVERY = 10


class Notice(NamedTuple):
    label: str
    words: str
    keys: str
    base: bool = False


#: The phrases of the query's contract, then this library's own notices.
NOTICES = (
    Notice("mit", "under the mit license", "mit", True),
    Notice("apache-2", "apache license version 2", "apache 2", True),
    Notice("cc-by-nc", "cc by nc", "cc by nc", True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", "granted"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", "noncommercial"),
    Notice("cc-by-sa", "creative commons attribution sharealike", "sharealike"),
    Notice("gpl-3", "gnu general public license version 3", "gnu 3"),
    Notice("gpl-2", "gnu general public license version 2", "gnu 2"),
    Notice("mpl-2", "mozilla public license version 2", "mozilla 2"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    Notice("proprietary", "all rights reserved", "reserved"),
)

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,edits:int,exact_base:boolean>>"
)
#: Every byte that is no word's to a space, after A-Z are lower-cased; bytes from 0x80 belong to words.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(WORD_BYTES).split()


def edit_budget(words: str) -> int:
    return len(words) // EDIT_EVERY


def pieces(words: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces that together make up the notice, with their places in it."""
    cuts = [len(words) * i // (k + 1) for i in range(k + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places(padded: bytes, words: str) -> list[int]:
    """Where in the padded text the notice's words stand one after another: the blank before each place."""
    found, wanted, at = [], f" {words} ".encode(), padded.find(f" {words} ".encode())
    while at >= 0:
        found.append(at)
        at = padded.find(wanted, at + 1)
    return found


class Spans:
    """The spans found in a text, by label; each label's in order, so that neighbours tell of overlaps."""

    def __init__(self) -> None:
        self.by: dict[str, list[tuple[int, int, int, bool]]] = {}
        self.longest = 0

    def add(self, label: str, first: int, last: int, edits: int, base: bool) -> None:
        """One span for each label and first word; a later one replaces an earlier one."""
        own = self.by.setdefault(label, [])
        at = bisect_left(own, first, key=lambda s: s[0])
        own[at : at + (at < len(own) and own[at][0] == first)] = [(first, last, edits, base)]
        self.longest = max(self.longest, last - first)

    def covered(self, label: str, first: int, last: int, edits: int) -> bool:
        """Whether a span of the label overlaps these words with no more edits."""
        own = self.by.get(label, [])
        at = bisect_left(own, first - self.longest, key=lambda s: s[0])
        while at < len(own) and own[at][0] <= last:
            if own[at][1] >= first and own[at][2] <= edits:
                return True
            at += 1
        return False

    def all(self) -> list[tuple[str, int, int, int, bool]]:
        return sorted(((label, *s) for label, own in self.by.items() for s in own), key=lambda s: (s[1], s[0], s[2]))


def searcher(notices: Sequence[Notice]) -> Callable[[str | None], tuple]:
    seeds: dict[str, list[tuple[int, int]]] = {}
    budgets = [edit_budget(n.words) for n in notices]
    for i, n in enumerate(notices):
        for at, piece in pieces(n.words, budgets[i]):
            seeds.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    fuzzy = [regex.compile(f"(?b)(?:{regex.escape(n.words, special_only=True)}){{e<={k}}}") for n, k in zip(notices, budgets, strict=True)]
    keys = [set(n.keys.encode().split()) for n in notices]

    def search(text: str | None) -> tuple:
        words = words_of(text)
        padded = b" " + b" ".join(words) + b" "
        letters = padded.decode("latin-1")
        blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 0x20)
        spans, n_base = Spans(), 0
        for n in notices:
            if n.base:
                at = places(padded, n.words)
                n_base += len(at)
                for w in np.searchsorted(blanks, at).tolist():
                    spans.add(n.label, w, w + n.words.count(" "), 0, True)
        done: dict[int, int] = {}
        for end, (size, where) in automaton.iter(letters):
            for i, at in where:
                n, k = notices[i], budgets[i]
                start = end - size + 1 - at
                if start - done.get(i, -1 - k) <= k and i in done and start >= done[i] - k:
                    continue
                low, high = max(0, start - k), start + len(n.words) + k
                window = padded[low : high + 1 + max(map(len, keys[i]))]
                # the keys must stand in any occurrence, and finding them is far cheaper than matching
                if not all(x in window for x in keys[i]) or not (m := fuzzy[i].search(letters, low, min(len(letters), high + 1))):
                    continue
                # grown to whole words, without the spaces about it
                a, b = m.span()
                a += letters[a:b].startswith(" ")
                a = padded.rfind(b" ", 0, a + 1) + 1 if letters[a] != " " else a + 1
                b = padded.find(b" ", max(a, b - 1))
                own = padded[a:b].split()
                if keys[i] <= set(own):
                    first = int(np.searchsorted(blanks, a)) - 1
                    last, edits = first + len(own) - 1, sum(m.fuzzy_counts)
                    if not spans.covered(n.label, first, last, edits):
                        spans.add(n.label, first, last, edits, False)
                    done[i] = start
        found = spans.all()
        base = [s for s in found if s[4]]
        size = {n.label: len(n.words) for n in reversed(notices)}
        score = max((1 - s[3] / size[s[0]] for s in found), default=0.0)
        join = lambda rows: ",".join(sorted({s[0] for s in rows}))
        return len(words), n_base, min((s[1] for s in base), default=None), max((s[1] for s in base), default=None), join(base), join(found), score, found

    return search


def find_notices(df: DataFrame, key: str = "doc_id", text: str = "text", notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row for each row of df: its key, word and place counts, labels, score and spans (in words).

    Null and empty texts have no words and no label; repeated rows give repeated results, null keys pass, an empty df
    gives none; other columns of df are not carried. Texts are read whole, whatever their length. score is 1 for an
    exact notice, less the share of edits for a fuzzy one, 0 without any.
    """

    def make():
        search = searcher(notices)
        return lambda keys, texts: [keys, *map(list, zip(*map(search, texts), strict=True))]

    kind = dict(df.dtypes)[key]
    return map_rows(df, [key, text], f"`{key}` {kind}, {SCHEMA}", make)
