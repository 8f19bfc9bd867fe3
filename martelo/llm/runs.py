"""Periodic runs of words: stretches that repeat at least three times, and texts without the repeats.

Texts of one slice form one sequence of word numbers, each text closed by a number of its own, so that no run or
period crosses a border. A text that holds no stretch of a third of the least length twice has no run and stays out
of the sequence. For it

1. prefix doubling gives the suffix array, and for each power of two the rank of every stretch of that length;
2. the common prefixes of neighbours in the suffix array give, from the last position to the first, the longest
   factor that began before (LPF); reading it greedily gives the blocks of the Lempel-Ziv parse;
3. a run that touches the start of a block is found there: its period is at most as long as the block before or
   behind, so each start is paired with the shifts of that length, and pairs with equal stretches are extended both
   ways (Main). Extensions are longest common prefixes and suffixes by the ranks;
4. a run strictly inside a block is a copy of one in the block's earlier place: runs are held in buckets by their
   start, and blocks copy from left to right.

A run of length L >= 3 q agrees with itself shifted by q over L - q >= 2 L / 3 words, hence on one side of the start
that it touches over a third of the least length. Step 3 looks at pairs that do so and misses none. Periods found
there may be multiples of the smallest one; runs are told by their borders, so the least period stays.

Work is near-linear in the words of a slice: log2 of the longest repeat rounds of sorting what is not yet unique.
Memory is about 4 log2(longest repeat) + 100 bytes for each word of a slice, and a text longer than a slice is one
slice, so the longest text bounds a worker's memory. Rows are never shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

#: A run repeats its period at least so often, and has at least so many words.
LEAST_EXPONENT, LEAST_WORDS = 3, 24
#: Pairs of a block's start and a shift that are compared at once.
PAIRS = 1 << 21

Run = tuple[int, int, int]  # start, length, period


def stretch_ranks(ids: np.ndarray, until: int | None = None) -> list[np.ndarray]:
    """Level k ranks all stretches of 2**k numbers (shorter at the end); equal stretches have equal ranks.

    There are levels up to `until`, or until all stretches differ.

    A rank is the number of stretches before it, so that those of the last level, all different, are the places of
    the suffixes in the suffix array.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.concatenate(([True], ids[order][1:] != ids[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_) or len(levels) - 1 == until:
            return levels
        follows = np.zeros(len(open_), np.int64)
        inside = open_ + step < n
        follows[inside] = rank[open_[inside] + step] + 1
        key = rank[open_] * (n + 1) + follows
        order = np.argsort(key, kind="stable")
        key, at = key[order], np.arange(len(order))
        bucket = key // (n + 1)
        first = np.maximum.accumulate(np.where(np.concatenate(([True], bucket[1:] != bucket[:-1])), at, 0))
        equal = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
        rank = rank.copy()
        rank[open_[order]] = bucket + equal - first
        levels.append(rank.astype(np.int32))
        step *= 2


def common_prefix(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many numbers from i and from j on are equal, for different i and j."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    start = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
        i[same] += 1 << k
        j[same] += 1 << k
    return i - start


def common_suffix(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many numbers before i and before j are equal, for different i and j."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        inside = (i >= step) & (j >= step)
        same = inside & (levels[k][np.where(inside, i - step, 0)] == levels[k][np.where(inside, j - step, 0)])
        i[same] -= step
        j[same] -= step
    return start - i


def longest_previous(levels: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """For each position the length of the longest factor that also begins before it, and one such beginning.

    Positions leave the suffix array from the last to the first; at that moment both neighbours lie before.
    """
    place = levels[-1]
    n = len(place)
    suffixes = np.empty(n, np.int64)
    suffixes[place] = np.arange(n)
    near = np.zeros(n + 1, np.int64)  # near[r]: common prefix of the suffixes at places r - 1 and r
    equal = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    near[equal + 1] = common_prefix(levels, suffixes[equal], suffixes[equal + 1])
    at, shared = place.tolist(), near.tolist()
    before, behind = list(range(-1, n)), list(range(1, n + 2))
    length, source = [0] * n, [-1] * n
    of = suffixes.tolist()
    for i in range(n - 1, -1, -1):
        r = at[i]
        left, right = before[r], behind[r]
        x, y = shared[r], shared[right]
        if x >= y:
            if x:
                length[i], source[i] = x, of[left]
            shared[right] = y
        else:
            length[i], source[i] = y, of[right]
            shared[right] = x
        behind[left] = right  # left may be -1: the list's last entry, which nothing reads
        before[right] = left
    return length, source


def blocks_of(length: list[int]) -> list[int]:
    """Starts of the Lempel-Ziv blocks."""
    starts, i, n = [], 0, len(length)
    while i < n:
        starts.append(i)
        i += length[i] or 1
    return starts


def _gram_level(least: int) -> int:
    """The level of stretches that a run and its shift by one period share on either side of any place in it."""
    return (least // LEAST_EXPONENT).bit_length() - 1


def _touching(levels: list[np.ndarray], starts: np.ndarray, least: int) -> set[Run]:
    """Runs that contain or touch the start of a block, by their borders: the least period of each."""
    n, k = len(levels[0]), _gram_level(least)
    if k >= len(levels):
        return set()
    grams, g = levels[k], 1 << k
    many = np.bincount(grams, minlength=n)[grams] > 1
    sizes = np.diff(np.append(starts, n))
    widest = np.maximum(sizes, np.concatenate(([0], sizes[:-1])))
    again = many[starts] | ((starts >= g) & many[np.maximum(starts - g, 0)])
    starts, widest = starts[again], widest[again]
    ends = np.cumsum(widest)
    best: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(starts):
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        count = widest[done:until]
        b = np.repeat(starts[done:until], count)
        q = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count) + 1
        done = until
        back = b >= q
        forth = b + q < n
        hit = back & (grams[b] == grams[np.where(back, b - q, 0)])
        deep = b >= q + g
        hit |= deep & (grams[np.where(deep, b - g, 0)] == grams[np.where(deep, b - g - q, 0)])
        ahead = forth & (grams[b] == grams[np.where(forth, b + q, 0)])
        x = np.concatenate((b[hit], b[ahead] + q[ahead]))  # x and x - q lie in the run, or x is its end
        q = np.concatenate((q[hit], q[ahead]))
        if not len(x):
            continue
        end = x + common_prefix(levels, x - q, x)
        start = x - q - common_suffix(levels, x - q, x)
        long = end - start >= np.maximum(least, LEAST_EXPONENT * q)
        for s, e, p in zip(start[long].tolist(), end[long].tolist(), q[long].tolist(), strict=True):
            if p < best.get((s, e), p + 1):
                best[s, e] = p
    return {(s, e - s, p) for (s, e), p in best.items()}


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS) -> list[Run]:
    """All maximal runs of at least `least` numbers and three periods, by start, then period."""
    if least < LEAST_EXPONENT:
        raise ValueError(f"a run has at least {LEAST_EXPONENT} words")
    if len(ids) < least:
        return []
    levels = stretch_ranks(ids)
    length, source = longest_previous(levels)
    starts = blocks_of(length)
    found = _touching(levels, np.array(starts), least)
    held = sorted(found)
    for b in starts if held else ():
        size = length[b]
        if size < least + 2:
            continue
        first, shift = source[b], b - source[b]
        at = bisect_right(held, (first + 1, -1, -1))
        while at < len(held) and held[at][0] < first + size:
            s, long, p = held[at]
            at += 1
            if s + long < first + size and (copy := (s + shift, long, p)) not in found:
                found.add(copy)
                insort(held, copy)
    return sorted(held, key=lambda run: (run[0], run[2]))


def repeated(words: list, key: int | None) -> list:
    """The words with the stretch that h = crc32 of the key's decimal form asks for: where 10 divides h, from word
    g mod n on the text repeats, g being h // 10. Without a key the words stay."""
    n = len(words)
    if key is None or not n or (h := zlib.crc32(b"%d" % key)) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _repeats_itself(ids: np.ndarray, owners: np.ndarray, least: int) -> np.ndarray:
    """Which owners hold some stretch of a third of the least length, rounded down to a power of two, twice.

    A text with a run does; all others need no parse.
    """
    k = _gram_level(least)
    levels = stretch_ranks(ids, k)
    if k >= len(levels):
        return np.zeros(0, np.int64)
    grams = levels[k].astype(np.int64)
    again = np.flatnonzero(np.bincount(grams, minlength=len(ids))[grams] > 1)
    key = np.sort(owners[again] * len(ids) + grams[again])
    return np.unique(key[1:][key[1:] == key[:-1]] // len(ids))


def runs_by_text(texts: list[list], least: int = LEAST_WORDS) -> list[list[Run]]:
    """The runs of each list of words, found in one sequence of all lists that repeat themselves at all."""
    out: list[list[Run]] = [[] for _ in texts]
    long = [i for i, words in enumerate(texts) if len(words) >= least]
    if not long:
        return out
    words = [w for i in long for w in texts[i]]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    sizes = np.array([len(texts[i]) for i in long])
    ids = np.insert(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.cumsum(sizes), -1 - np.arange(len(long)))
    owners = np.repeat(np.arange(len(long)), sizes + 1)
    chosen = _repeats_itself(ids, owners, least)
    ids = ids[np.isin(owners, chosen)]
    starts = np.concatenate(([0], np.cumsum(sizes[chosen] + 1)))
    found = runs_of(ids, least)
    which = np.searchsorted(starts, [r[0] for r in found], "right") - 1
    for (s, size, p), d in zip(found, which.tolist(), strict=True):
        out[long[chosen[d]]].append((s - int(starts[d]), size, p))
    return out


def kept_words(words: list, runs: list[Run]) -> list:
    """The words that no run has behind its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for s, size, p in runs:
        cover[s + p] += 1
        cover[s + size] -= 1
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _told(runs: list[Run]) -> tuple:
    """n_runs, start, length, period and exponent_milli of the run with the greatest exponent, hash of all."""
    text = "".join(f"{s},{long},{p}\n" for s, long, p in runs)
    best: Run | None = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    s, long, p = best or (None, None, None)
    return len(runs), s, long, p, 1000 * long // p if best else None, hashlib.sha256(text.encode()).hexdigest()


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, change: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """One row for each row of df: its key and COLUMNS.

    Words are stretches without ASCII blanks. change(words, key) may replace them before runs are sought. The run
    told is that of the greatest exact length / period; ties: smallest start, then period. runs_sha256 is over all
    runs, collapsed_sha256 over the words that `collapse` leaves, joined by one blank.

    A null text has no words; without runs the four numbers are null and the hashes those of nothing and of all
    words. Repeated rows each have their row; other columns are not carried.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *df.sparkSession.createDataFrame([], COLUMNS).schema])

    def make():
        def tell(keys, texts):
            words = [_words(t) for t in texts]
            if change:
                words = [change(w, k) for w, k in zip(words, keys, strict=True)]
            rows = [
                (k, *_told(found), hashlib.sha256(b" ".join(kept_words(w, found))).hexdigest())
                for k, w, found in zip(keys, words, runs_by_text(words, least), strict=True)
            ]
            return list(zip(*rows, strict=True))

        return tell

    return map_rows(df, [key, text], schema, make)


def collapse(df: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """df with one period left of each run in its texts.

    Texts with a run become their kept words, joined by one blank; others stay as they are, blanks included, and
    null stays null. Every row and column is handed on, whatever the columns' names.
    """

    def make():
        def run(*columns):
            texts = columns[-1]
            words = [_words(t) for t in texts]
            found = runs_by_text(words, least)
            return [*columns[:-1], [b" ".join(kept_words(w, r)).decode() if r else t for t, w, r in zip(texts, words, found, strict=True)]]

        return run

    names = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(text, T.StringType())])
    return map_rows(df, [*names, text], schema, make).select(*df.columns)
