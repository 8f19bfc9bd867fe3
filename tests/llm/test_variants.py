"""Spelling variants against all pairs and against SQL."""

import itertools
import random
from collections import Counter

import duckdb
import pytest

from martelo.llm import queries, variants
from martelo.llm.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def some_words(rnd, n, letters, longest):
    made = set()
    while len(made) < n:
        word = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest)))
        made.add(word)
        at = rnd.randrange(len(word))
        made.add(rnd.choice((word[:at] + word[at + 1 :], word[:at] + rnd.choice(letters) + word[at:], word[:at] + rnd.choice(letters) + word[at + 1 :])))
    return sorted(made - {""})


def test_trie():
    rnd = random.Random(3)
    for letters, longest in (("ab", 7), ("abcé", 5), ("a", 9)):
        words = some_words(rnd, 9 if letters == "a" else 60, letters, longest) if letters != "a" else ["a" * i for i in range(1, 9)]
        rnd.shuffle(words)
        found = Counter(variants.Trie(["", *words]).pairs())
        assert found == Counter((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(["", *words]), 2) if near(a, b))


@pytest.mark.parametrize("most", [20_000, 40, 5])
def test_pairs(spark, most):
    """Branches of any size give the same pairs, each once: words with a common beginning, end, both, or neither."""
    rnd = random.Random(4)
    inner = some_words(rnd, 150, "abé", 7)
    words = sorted({*inner, *("prefixprefix" + w for w in inner[:60]), *(w + "endingending" for w in inner[30:90]), *("left" + w + "right" for w in inner[60:])})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)] + [("", 5), (None, 5)], "word string, n long")
    found = Counter(tuple(sorted((r.word, r.near))) for r in variants.pairs(df, most, most * 50).collect())
    assert found == Counter(p for p in itertools.combinations(words, 2) if near(*p))


def plain_groups(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = others[0] if others and -others[0][0] >= ratio * n else None
        out[w] = [n, form and form[1], form and -form[0], len(others)]
    for w in out:
        root = w
        while out[root][1] is not None:
            root = out[root][1]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def test_groups(spark):
    """Chains of forms, ties by code points, and words that are near nothing."""
    counts = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 700, "abbbbb": 4000, "zzzzzz": 9, "aaaaaé": 700, "aaaaaz": 700, "aaaaa": 700, "aaaaaaa": 34}
    rnd = random.Random(8)
    counts |= {w: rnd.choice((5, 25, 30, 125, 700)) for w in some_words(rnd, 120, "xyz", 8)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in variants.groups(df).collect()}
    assert found == plain_groups(counts)
    with pytest.raises(ValueError):
        variants.groups(df, ratio=2)


def test_query_equals_sql(spark):
    found = queries.op11_spelling_variants(spark, SF_DIR)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op11_spelling_variants']})").fetchall()
    rows = [tuple(r) for r in found.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))
    assert any(r[1] for r in rows)


def test_vocabulary(spark, monkeypatch):
    """Odd texts; dictionaries that are handed on early give the same counts."""
    long = "ção" * 40_000
    texts = [None, "", "123 -- ", "Straße STRASSE straßE ÀÉÎõü×÷ÿ", "word" * 3 + " wordword WORDWORD", "naïve naïve", long, "日本語 Ωmega mega"]
    rows = [(i % 5, t, i) for i, t in enumerate(texts)] * 3 + [(None, "without a key: unkeyed unkeyed", None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, word long")

    def counted():
        return {r.word: r.n for r in variants.vocabulary(df, least_letters=2, least_n=3).collect()}

    import re

    wanted = Counter()
    for k, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            wanted[variants.misspelt(k)(word)] += 1
    wanted = {w: n for w, n in wanted.items() if len(w) >= 2 and n >= 3}
    assert counted() == wanted and long in wanted
    assert not variants.variant_groups(df.limit(0)).collect()


def test_misspelt():
    import zlib

    for doc_id, word in itertools.product(range(400), ("letters", "ünïcode")):
        h = zlib.crc32(f"{doc_id}:{word}".encode())
        at = h % len(word)
        assert variants.misspelt(doc_id)(word) == (word if h % 199 else word[:at] + word[at + 1 :])
