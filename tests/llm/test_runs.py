"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from martelo.llm import queries, runs

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words, least=24):
    """Every period is compared with the text shifted by it."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rnd, n, alphabet):
    out = []
    while len(out) < n:
        kind = rnd.random()
        if kind < 0.3:
            out += [rnd.randrange(alphabet) for _ in range(rnd.randrange(1, 20))]
        elif kind < 0.7:
            part = [rnd.randrange(alphabet) for _ in range(rnd.randrange(1, 12))]
            out += part * rnd.randrange(2, 7) + part[: rnd.randrange(len(part) + 1)]
        elif out:
            at = rnd.randrange(len(out))
            out += out[at : at + rnd.randrange(1, 150)]
    return out[:n]


def test_runs_of_random_texts():
    rnd, total = random.Random(5), 0
    for _ in range(400):
        least = rnd.choice([3, 6, 12, 24, 24])
        texts = [repetitive(rnd, rnd.randrange(0, 300), rnd.choice([1, 2, 3, 50])) for _ in range(4)]
        texts.append(texts[1])  # a copy is one block of the parse
        wanted = [plain_runs(t, least) for t in texts]
        assert runs.runs_by_text(texts, least) == wanted
        total += sum(map(len, wanted))
    assert total > 3000


def test_pieces_of_pairs_do_not_matter(monkeypatch):
    rnd = random.Random(6)
    text = repetitive(rnd, 3000, 3)
    monkeypatch.setattr(runs, "PAIRS", 64)
    assert runs.runs_by_text([text]) == [plain_runs(text)]


def test_longest_previous_factor():
    rnd = random.Random(7)
    for _ in range(50):
        ids = [*repetitive(rnd, 60, 3), -1]
        length, source = runs.longest_previous(runs.stretch_ranks(np.array(ids)))
        for i in range(len(ids)):
            fits = [next((k for k in range(len(ids) - i) if ids[j + k] != ids[i + k]), len(ids) - i) for j in range(i)]
            assert length[i] == max(fits, default=0)
            assert not length[i] or fits[source[i]] == length[i]


def described(doc_id, text):
    """The contract's row, in plain Python."""
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, long, p in found for i in range(s + p, s + long)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{long},{p}\n" for s, long, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, SF_DIR).collect())
    assert found == sorted(described(*d) for d in docs)
    assert sum(1 for r in found if r[1]) > 5


ODD = [
    (1, None, 7), (2, "", 7), (3, " \t\n ", 7), (4, "a " * 5000, 7), (4, "a " * 5000, 7), (5, "x y z " * 8, 7), (None, "la " * 30, None),
    (6, "\x1cno\x1fblank\x85here  " * 40, 7), (7, "one two　three " * 30 + "end", 7), (8, " ".join(str(i % 2500) for i in range(10000)), 7),
]


def test_odd_inputs(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, period long")
    found = runs.described(df, change=runs.repeated).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(described(k, t)) for k, t, _ in ODD)
    assert not runs.described(df.limit(0)).collect()


def test_collapse(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, period long")
    found = {r.doc_id: r.text for r in runs.collapse(df).collect()}
    assert found[1] is None and found[2] == "" and found[3] == " \t\n " and found[4] == "a" and found[5] == "x y z"
    assert found[7] == "one two　three end"
    assert runs.collapse(df).columns == df.columns and runs.collapse(df).count() == len(ODD)


def test_least():
    assert runs.runs_of(np.array([1] * 23 + [-1])) == [] and runs.runs_of(np.array([1] * 24 + [-1])) == [(0, 24, 1)]
    with pytest.raises(ValueError):
        runs.runs_of(np.array([1] * 9), 2)
