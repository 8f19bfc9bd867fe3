"""Each operator against a brute-force version, an exact round trip or held-out rows, and on odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from martelo.llm import common, decontamination, licences, minhash, neardup, packing, pii, quality, queries, rollups, sharding, shingles, toxicity
from martelo.llm.common import held_out
from martelo.llm.labelled import training_rows
from martelo.llm.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
WORDS = [a + b for a, b in itertools.product(("ba", "ko", "li", "mu", "ne", "ro", "sa", "ti"), ("dar", "fen", "gol", "him", "jas", "kut", "lop", "mir"))]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(1, 300)
ODD = [None, "", "   ", "!!!", "one", BASE, BASE, BASE + " a little more", prose(2, 4000), "ação ünïcode 日本語 🙂 text", BASE.upper()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null key, and extra columns with clashing names."""
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(5, BASE, "x", 5), (None, "no key here at all", "y", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, shard long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, shard long")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(documents):
    return {r[0]: r[1] or "" for r in documents.collect()}


def auc(rows):
    ranked = sorted(rows)
    places, total, ones = 0, 0, sum(y for _, y in rows)
    for _, same in itertools.groupby(ranked, key=lambda r: r[0]):
        same = list(same)
        total += sum(y for _, y in same) * (places + (len(same) + 1) / 2)
        places += len(same)
    return (total - ones * (ones + 1) / 2) / (ones * (len(rows) - ones))


def held_out_auc(spark, query, label):
    sf_dir = "/root/testdata/sf0.01"
    found = query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    return auc([(r["score"], r[label]) for r in found if r["held_out"]])


# 1


def test_quality_held_out(spark):
    assert held_out_auc(spark, queries.op1_rule_ensemble_quality, "quality") > 0.85


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)] + [(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.scores(odd, labels).collect()
    assert len(found) == 13 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.scores(none, labels).count() == 0
    assert {r["score"] for r in quality.scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_statistics_that_tell_nothing(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(40)], "doc_id long, quality int")
    learned = [i % 4 > 0 for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert all(abs(r["score"] - sum(learned) / len(learned)) < 1e-9 for r in quality.scores(docs, labels).collect())


def test_rules_are_the_paths_of_the_trees(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [(float(r.random() < 0.5), *[r.random() for _ in quality.STATISTICS]) for _ in range(200)]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{n} double" for n in quality.STATISTICS))
    data = df.withColumn("features", array_to_vector(F.array(*quality.STATISTICS)))
    for tree in GBTClassifier(labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(data).trees:
        rules = list(quality.paths(tree._java_obj.rootNode()))
        assert len(rules) == tree.numNodes - 1

        def leaf(node, x, at=()):
            """The path of plain Python through the printed tree."""
            if node.getClass().getSimpleName() != "InternalNode":
                return at
            split = node.split()
            name, least = quality.STATISTICS[split.featureIndex()], split.threshold()
            above = x[name] > least
            return leaf(node.rightChild() if above else node.leftChild(), x, (*at, (name, above, least)))

        for x in df.limit(30).select("*", *(quality.holds(rule).alias(f"r{i}") for i, rule in enumerate(rules))).collect():
            path = leaf(tree._java_obj.rootNode(), x)
            holding = [rule for i, rule in enumerate(rules) if x[f"r{i}"]]
            # every prefix of the path holds, and nothing else does
            assert len(holding) == len(path)
            assert all(all((x[t.statistic] > t.threshold) == t.above for t in rule) for rule in holding)


def test_rules_compile_to_what_they_say(spark):
    rules = quality.RuleEnsemble(-1.0, (((quality.Test("words", True, 2.0), quality.Test("bang", False, 0.5)), 2.0), ((quality.Test("digit", True, 0.1),), -0.5)))
    rows = [(float(w), b, d) for w in (1, 2, 3) for b in (0.4, 0.6) for d in (0.1, 0.2)]
    got = spark.createDataFrame(rows, "words double, bang double, digit double").withColumn("score", rules.score()).collect()
    for r in got:
        z = -1.0 + 2.0 * (r["words"] > 2 and r["bang"] <= 0.5) - 0.5 * (r["digit"] > 0.1)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-12


def test_sampled_classes_weigh_their_true_counts(spark):
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(4000)], "doc_id long, quality int")
    known = labels.filter(~held_out("doc_id")).groupBy("quality").count().collect()
    for most in (100, 8000):
        got = training_rows(labels, "quality", rows_per_class=most).groupBy("y").agg({"weight": "sum", "doc_id": "count"}).collect()
        assert {r["y"]: round(r["sum(weight)"], 6) for r in got} == {float(r["quality"]): r["count"] for r in known}
        assert all(r["count(doc_id)"] <= most for r in got)


def test_bounded_samples_keep_the_true_share(spark):
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), int(i % 10 == 0)) for i in range(2000)], "doc_id long, quality int, toxic int")
    good = [r["score"] for r in quality.scores(docs, labels, rows_per_class=100).collect()]
    toxic = [r["score"] for r in toxicity.scores(docs, labels, rows_per_class=100).collect()]
    assert 0.8 < np.mean(good) < 1 and 0 < np.mean(toxic) < 0.2


# 2


def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(spark):
    found = queries.op2_jump_sharding(spark, SF_DIR).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(tuple(r[c] for c in names) for r in found) == sorted(con.execute(ORACLES["op2_jump_sharding"]).fetchall())
    assert all(r["shard"] == jump(r["doc_id"], 16) and r["grown_shard"] in (r["shard"], 16) for r in found)
    for shard in {r["shard"] for r in found}:
        own = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_shards_odd(odd, none):
    found = sharding.with_slots(sharding.assign_shards(odd)).collect()
    assert len(found) == 13 and all(r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in found)
    assert sharding.with_slots(sharding.assign_shards(none)).count() == 0


@pytest.mark.parametrize("key", [-1, -(1 << 63), (1 << 63) - 1, 0, 123456789])
def test_jump_of_extreme_keys(spark, key):
    from pyspark.sql import functions as F

    assert spark.range(1).select(sharding.jump_shard(F.lit(key), 1000)).first()[0] == jump(key, 1000)


# 3


def test_rollup(spark):
    from tokenizers import Tokenizer

    from martelo.llm.tokens import default_path

    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    word, byte, wanted, seen = Tokenizer.from_file(default_path()), rollups.byte_bpe(), Counter(), set()
    docs = Counter()
    for r in rows:
        if (r["text"] or "") in seen:
            continue
        seen.add(r["text"] or "")
        text = "\n".join(dict.fromkeys((r["text"] or "").split("\n")))
        for name, n in (("word_bpe_49k", len(word.encode(text, add_special_tokens=False).ids)), ("byte_bpe_50k", byte([text])[0])):
            wanted[r["source"], r["lang"], name] += n
            docs[r["source"], r["lang"], name] += 1
    found = queries.op3_token_rollup(spark, SF_DIR).select("source", "lang", "tokenizer", "docs", "tokens").collect()
    assert sorted(map(tuple, found)) == sorted((*k, docs[k], n) for k, n in wanted.items())


def test_rollup_batches(spark, tmp_path, none):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0 and rollup.batches() == []
    docs = spark.createDataFrame([("a", "en", "one two", 1), ("a", "en", None, 2), ("b", None, "", 3), (None, "en", "x", 4), ("c", "en", prose(3, 5000), 5)], "source string, lang string, text string, tokens long")
    rows = rollups.counted(docs)
    assert rollup.commit("1", rollups.signed(rows, 1)) and not rollup.commit("1", rollups.signed(rows, 1))
    assert len(rollup.totals().collect()) == 8
    assert rollup.commit("2/b", rollups.signed(rows.filter("source = 'a'"), -1)) and rollup.batches() == ["1", "2/b"]
    assert {r["source"] for r in rollup.totals().collect()} == {"b", "c", None}
    folded = rollup.fold(f"file://{tmp_path}/f")
    before = sorted(map(str, rollup.totals().collect()))
    assert sorted(map(str, folded.totals().collect())) == before
    assert folded.committed("2/b") and not folded.commit("2/b", rollups.signed(rows, 1))
    again = folded.fold(f"file://{tmp_path}/g")
    assert again.committed("1") and sorted(map(str, again.totals().collect())) == before
    again.commit("3", rollups.revised(rows.filter("source = 'c'"), rows.filter("source = 'c'").withColumn("tokens", rows["tokens"] * 0)))
    assert {r["tokens"] for r in again.totals().filter("source = 'c'").collect()} == {0}
    for name in ("", "x" * 300):
        with pytest.raises(ValueError):
            again.commit(name, rollups.signed(rows, 1))
    assert rollups.counted(none).count() == 0


def test_of_two_writers_of_a_batch_one_commits(spark, tmp_path):
    rollup = rollups.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", "t", 5)], "source string, lang string, tokenizer string, tokens long")
    rollup.commit("1", rollups.signed(rows, 1))
    late = rollups.Rollup(spark, rollup.path)
    late.committed = lambda batch: False  # it looked before the other one was done
    assert not late.commit("1", rollups.signed(rows, 1))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 5)]


# 4


def test_toxicity_held_out(spark):
    assert held_out_auc(spark, queries.op4_kneser_ney_toxicity, "toxic") > 0.85


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)], "doc_id long, quality int, toxic int")
    found = toxicity.scores(odd, labels).collect()
    assert len(found) == 13 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.scores(none, labels).count() == 0
    assert len({r["score"] for r in toxicity.scores(odd, labels.limit(0)).collect()}) == 1


def test_probabilities_by_brute_force(spark):
    words = [prose(i, 12) for i in range(30)]
    docs = spark.createDataFrame([(t,) for t in words], "text string")
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    seen = {x for t in words for x in ngrams(t, order)}
    levels = [seen]
    for k in range(order - 1, 0, -1):
        levels.append({g[1:] for g in levels[-1]})
    levels = {len(next(iter(x))): x for x in levels}

    def shared(gram):
        if not gram:
            return 1 / 256
        before = Counter(g[1:] for g in levels[len(gram) + 1])
        ahead = [g for g in levels[len(gram)] if g[:-1] == gram[:-1]]
        if not ahead:
            return shared(gram[1:])
        return (max(before[gram] - d, 0) + d * len(ahead) * shared(gram[1:])) / sum(before[g] for g in ahead)

    got = {int(r["gram"]).to_bytes(order - 1, "big"): r["p"] for r in toxicity.shared_model(toxicity._seen(docs, "text")).collect()}
    assert set(got) == levels[order - 1]
    for gram in random.Random(1).sample(sorted(got), 40):
        assert abs(got[gram] - shared(gram)) < 1e-12
    context = next(iter(sorted(got)))[:-1]
    assert abs(sum(shared(context + bytes([c])) for c in range(256)) - 1) < 1e-9
    # a class's probabilities after a context sum to 1 as well: counted letters, and what is left to the shared model
    rows = spark.createDataFrame([(t, float(i % 2)) for i, t in enumerate(words)], "text string, y double")
    counts = toxicity._counts(rows).toPandas()
    counts["p"] = [got[int(g).to_bytes(order, "big")[1:]] for g in counts["gram"]]
    p, rest = toxicity.class_probabilities(counts)
    for c in ("one", "zero"):
        own = counts.assign(q=p[c], context=counts["gram"] // 256)
        for context in own["context"].drop_duplicates().sample(20, random_state=1):
            here = own[own["context"] == context]
            assert abs(here["q"].sum() + rest[c][context] * (1 - here["p"].sum()) - 1) < 1e-9


def ngrams(text, order):
    letters = toxicity.spelled(text)
    return [letters[i : i + order] for i in range(len(letters) - order + 1)]


def test_letters_in_segments(monkeypatch):
    texts = [prose(5, 300), "", None, "a", "ação!!", prose(6, 700)]
    wanted = [(i, int.from_bytes(g, "big")) for i, t in enumerate(texts) for g in ngrams(t, toxicity.ORDER)]
    monkeypatch.setattr(toxicity, "SEGMENT", 97)
    assert [(d, g) for docs, grams in toxicity.streams(texts) for d, g in zip(docs.tolist(), grams.tolist(), strict=True)] == wanted


# 5


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_by_pattern(text):
    count = lambda s: sum(c.isdigit() for c in s)
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= count(s) <= 19 and luhn(re.sub("[ -]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= count(s) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in re.finditer(p, text) if ok(m[0])]


PERSONAL = ["mail a.b@c.example.org now, 10.0.0.256 or 10.20.30.40", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (555) 123-4567 or +12", "🙂 x@y.zz 1.2.3.4.5", "7" * 5000, "@" * 3000]


def test_pii_base(spark, texts):
    rows = list(enumerate([*PERSONAL, *texts.values(), None, ""]))
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        wanted = base_by_pattern(rows[r["doc_id"]][1] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert set(wanted) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(w.startswith(k) for w in wanted) for k in ("email", "ip", "card", "phone")]


def test_best_segments_are_the_best():
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(1, 7)
        segments = [(i, j, 0) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if r.random() < 0.5]
        outside, inside = [r.gauss(0, 1) for _ in range(n)], [r.gauss(0, 1) for _ in segments]

        def worth(chosen):
            covered = [x for s in chosen for x in range(*segments[s][:2])]
            return None if len(covered) != len(set(covered)) else sum(inside[s] for s in chosen) + sum(outside[i] for i in range(n) if i not in covered)

        every = [worth(c) for k in range(len(segments) + 1) for c in itertools.combinations(range(len(segments)), k) if k <= n]
        assert abs(worth(pii.best_segments(n, segments, outside, inside)) - max(x for x in every if x is not None)) < 1e-9


def test_redact(odd, none):
    assert pii.redact(odd).collect() == odd.collect()
    assert pii.redact(none).count() == pii.find_pii(none).count() == 0
    assert len(pii.find_pii(odd).collect()) == 13


def test_entities_by_kind():
    """Of generated sentences that the weights have not seen, each kind is found, exactly, and little else."""
    weights, hits, told, true = pii.fitted(), Counter(), Counter(), Counter()
    for text, truth in pii.sentences(400, 99):
        gold, got = set(truth), set(pii.all_spans(text, weights)[1])
        hits.update(k for k, _, _ in gold & got)
        told.update(k for k, _, _ in got)
        true.update(k for k, _, _ in gold)
    assert all(hits[k] >= 0.95 * true[k] and hits[k] >= 0.95 * told[k] for k in range(len(pii.KINDS)))


def test_secrets_without_digits_and_days(spark):
    rows = [(0, "so password=correcthorsebattery ends"), (1, "password: required, a token = nothing, since 2024-01-15 12:30"), (2, "12 34.5, " * 30000)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: "secret:3:31", 1: "", 2: ""}


def test_secrets_after_a_spaced_sign(spark):
    parts = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "a1b2" * 60
    rows = [(0, f'so token = "{parts[0]}" ends'), (1, f"so API_KEY : {parts[1]}, ends"), (2, f"token={parts[0]} ends"), (3, "a token = none, a secret: abcdefgh and 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert found == {0: "secret:3:52", 1: f"secret:3:{13 + len(parts[1])}", 2: "secret:0:46", 3: ""}
    left = dict(pii.redact(df).collect())
    assert left == {0: 'so [SECRET]" ends', 1: "so [SECRET], ends", 2: "[SECRET] ends", 3: rows[3][1]}


def test_every_secret_of_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    wanted = {(r["doc_id"], f"secret:{m.start()}:{m.end()}") for r in rows.collect() for m in pii.SHAPES["secret"].finditer(r["text"] or "")}
    found = {(r["doc_id"], s) for r in pii.find_pii(rows).collect() for s in r["spans"].split(",") if s.startswith("secret")}
    assert wanted and wanted <= found


# 6


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    from martelo.llm.tokens import default_path

    tokenizer = Tokenizer.from_file(default_path())
    found = queries.op6_best_fit_packing(spark, SF_DIR).collect()
    lengths = []
    for doc, rows in itertools.groupby(sorted(found, key=lambda r: (r["doc_id"], r["piece"])), key=lambda r: r["doc_id"]):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        rows = list(rows)
        assert sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            assert r["start"] == 4096 * r["piece"] and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            lengths.append(r["length"])
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(room) if left >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(4096 - n)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by) == len(room)
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1]) and sum(n for _, n in parts) <= 4096


def test_packing_odd(odd, none):
    found = packing.pack(packing.cut(odd))
    assert found.filter("doc_id in (0, 1, 2)").select("length").distinct().collect()[0][0] == 1
    assert packing.pack(packing.cut(none)).count() == 0


# 7


def distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(5)
    for _ in range(100):
        pattern, text = ("".join(r.choice("abc ") for _ in range(r.randint(1, n))) for n in (20, 60))
        found = decontamination.Myers(pattern).search(text, 0, len(text), 5)
        wanted = distance_inside(pattern, text)
        assert (found[0] if found else 6) == min(wanted, 6)


def test_decontamination(spark, odd, none):
    item = prose(9, 30)
    edited = item.replace(item.split()[4], "zz", 1).replace(item.split()[20], item.split()[20] + "x", 1)
    docs = spark.createDataFrame([(1, prose(7, 100) + " " + item.upper() + "!"), (2, prose(8, 50) + " " + edited + " end"), (3, prose(10, 200)), (4, item[: len(item) // 2]), (5, None), (6, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "short"), (11, "!!!")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(docs, benchmark).collect()}
    assert set(found) == {(1, 7), (2, 7)} and found[1, 7] == 0 and found[2, 7] == distance_inside(item, decontamination.plain(edited))
    assert sorted(r[0] for r in decontamination.clean(docs, benchmark).select("doc_id").collect()) == [3, 4, 5, 6]
    assert decontamination.clean(odd, benchmark.limit(0)).count() == 13 and decontamination.contaminated(none, benchmark).count() == 0


def test_short_items_stand_word_for_word(spark):
    docs = spark.createDataFrame([(1, "say Two Words!"), (2, "say two wordsmiths"), (3, "two words"), (4, "two, and words"), (5, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    found = {r["doc_id"]: (r["edits"], r["end"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == {1: (0, 13), 3: (0, 9)}
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, benchmark).collect()) == [2, 4, 5]


def test_short_items_take_edits_between_borders(spark):
    """Items below the bound of whole words, against all stretches of whole words."""
    r, items = random.Random(31), ["ten letter", "twelve lettr", "seven words", "who was the first one", "how many of them are left over now", "a question of nearly forty letters is it"]
    rows = []
    for n in range(90):
        letters = list(items[n % 6])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(letters))
            letters[at : at + r.randint(0, 1)] = r.choice(["", "q", " "])
        rows.append((n, r.choice(["", "und "]) + "".join(letters) + r.choice(["", "s", " end"])))
    found = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    wanted = {}
    for n, text in rows:
        words = decontamination.plain(text).split()
        stretches = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)]
        for i, item in enumerate(items):
            if len(item) < decontamination.FUZZY_FROM:
                edits = min(decontamination.distance(item, s) for s in stretches)
                if edits <= len(item) // decontamination.EDIT_EVERY:
                    wanted[n, i] = edits
    assert {k: v for k, v in found.items() if len(items[k[1]]) < decontamination.FUZZY_FROM} == wanted
    assert any(wanted.values()) and decontamination.distance("kitten", "sitting") == 3


def test_blocks_of_items_find_what_one_block_does(spark, documents):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    one = decontamination.contaminated(documents, benchmark)
    several = decontamination.contaminated(documents, benchmark, block_letters=900)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, several.collect()))
    left = [sorted(map(tuple, decontamination.clean(documents, benchmark, block_letters=n).collect())) for n in (900, 1 << 30)]
    assert left[0] == left[1] and len(left[0]) < documents.count()
    renamed = decontamination.contaminated(documents.withColumnRenamed("doc_id", "item_id"), benchmark, key="item_id")
    assert renamed.columns[:2] == ["item_id", "benchmark_item_id"] and renamed.count() == one.count()


def test_items_with_edits_by_brute_force(spark):
    r, items, rows = random.Random(21), [prose(400 + i, 20) for i in range(6)], []
    for n in range(60):
        letters = list(items[n % 6])
        for _ in range(r.randint(0, len(letters) // decontamination.EDIT_EVERY + 3)):
            at = r.randrange(len(letters))
            letters[at : at + r.randint(0, 1)] = r.choice(["", "q", "zz"])
        rows.append((n, f"{prose(500 + n, 30)} {''.join(letters)} {prose(600 + n, 30)}"))
    found = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for n, text in rows:
        i = n % 6
        edits = distance_inside(decontamination.plain(items[i]), decontamination.plain(text))
        assert found.get((n, i)) == (edits if edits <= decontamination.edit_budget(items[i]) else None)


def test_decontamination_by_brute_force(spark, texts):
    items = {r["item_id"]: decontamination.plain(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op7_pigeonhole_decontamination(spark, SF_DIR).collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {decontamination.plain(t)} "}
    first = {x: min(i for i in items if items[i] == x) for x in items.values()}
    assert {(d, first[items[i]]) for d, i in exact} <= found
    for d, i in found:
        assert distance_inside(items[i], decontamination.plain(texts[d])) <= decontamination.edit_budget(items[i])


# 8


def test_licences(spark, texts):
    own = ["Under the MIT license, under the mit LICENSE", "Apache-License, Version 2.0", "cc by nc / CC BY-NC 4.0", "under the mit licence", "under teh mit license", None, "", "permission is hereby granted, free of charge, to any person obtaining a copy"]
    rows = list(enumerate([*own, *texts.values()]))
    found = {r["doc_id"]: r for r in licences.find_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(n, label) for p, label in phrases.items() for n in range(len(words)) if words[n : n + len(p.split())] == p.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((n for n, _ in places), default=None), max((n for n, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert found[3]["labels"] == found[4]["labels"] == found[7]["labels"] == "mit" and found[3]["base_labels"] == ""


def test_licences_odd(odd, none):
    assert len(licences.find_notices(odd).collect()) == 13 and licences.find_notices(none).count() == 0


def test_many_notices_in_one_text():
    found = licences.searcher(licences.NOTICES)("cc by nc " * 20000)
    assert found[:4] == (60000, 20000, 0, 59997)


# 9


def test_fingerprints(spark, texts):
    found = {r["doc_id"]: r for r in queries.op9_minhash_fingerprints(spark, SF_DIR).collect()}
    ids = sorted(texts)
    prints = {i: minhash.signatures([texts[i]])[0] for i in ids}
    assert set(found) == set(ids)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i], len(texts[i]) // 4
        changed = t[: len(t) - n] + texts[j][:n]
        r, own = found[i], minhash.signatures([changed])[0]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (minhash.hexed(prints[i]), minhash.hexed(own))
        assert (r["near_edited"], r["near_next"]) == (minhash.likeness(prints[i], own), minhash.likeness(prints[i], prints[j]))


def test_empty_text_comes_first_in_a_process(monkeypatch):
    """The first texts that a worker sees may all be empty."""
    for texts in ([None], [""], ["", None], ["!"]):
        monkeypatch.setattr(shingles, "_powers", {})
        docs, hashes, n = shingles.counted(texts)
        assert len(docs) == len(hashes) == len(n) == sum(bool(t) for t in texts)
        monkeypatch.setattr(shingles, "_powers", {})
        assert len(quality.statistics_of(texts[0])) == len(quality.STATISTICS)


def test_fingerprints_odd(odd, none):
    found = minhash.fingerprints(odd).collect()
    assert len(found) == 13 and len({r["fingerprint"] for r in found if r["doc_id"] in (5, 6)}) == 1
    assert minhash.fingerprints(none).count() == 0
    with pytest.raises(TypeError):
        minhash.fingerprints(odd.withColumn("doc_id", odd["doc_id"].cast("string")))


def test_fingerprints_of_one_key(spark):
    """Rows of one key, and rows without one, go by their texts' hashes over several blocks; each has one next row."""
    rows = [(None if i % 3 else 7, prose(i, 12)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.fingerprints(df, blocks=16).collect()
    order = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    ranked = sorted(rows, key=lambda r: (r[0] is not None, order[r[1]]))
    wanted = Counter()
    for (k, t), (_, following) in zip(ranked, ranked[1:] + ranked[:1], strict=True):
        wanted[k, hashlib.sha256(minhash.edited(t, following).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found) == wanted


def test_minhash_classes_by_brute_force(spark):
    r, rows = random.Random(12), []
    for family in range(10):
        words = prose(200 + family, 120).split()
        for _ in range(8):
            words = list(words)
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append(" ".join(words))
    r.shuffle(rows)  # near copies are not neighbours
    rows = list(enumerate([*rows, None, "", "!!!", "!!!", "???", "one two", "ONE two!"]))
    found = {x["doc_id"]: x["class_id"] for x in minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, least = [set(shingle_counts(t or "")) for _, t in rows], list(range(len(rows)))
    alike = lambda a, b: not a | b or len(a & b) >= 0.8 * len(a | b) and bool(a & b)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(sets[i], sets[j]) and least[i] != least[j]:
            one, other = sorted((least[i], least[j]))
            least = [one if x == other else x for x in least]
    assert 10 < len(set(least)) < len(rows) and found == dict(enumerate(least))


# 10


def shingle_counts(text):
    docs, hashes, counts = shingles.counted([text])
    return dict(zip(hashes.tolist(), counts.tolist(), strict=True))


def probability_jaccard(a, b):
    if not a or not b:
        return float(a == b)
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in every) for x in set(a) & set(b))


def classes_by_brute_force(rows):
    sets = [shingle_counts(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or probability_jaccard(sets[i], sets[j]) >= neardup.THRESHOLD:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return Counter(tuple(sorted(g)) for g in groups.values())


def test_neardup_by_brute_force(spark):
    r, rows = random.Random(11), []
    for family in range(12):
        words = prose(100 + family, 120).split()
        for _ in range(8):
            words = list(words)
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "!!!", "!!!", "???", "one two", "one two", "ONE two!"])]
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for x in found:
        groups.setdefault(x["class_id"], []).append(x["doc_id"])
    assert all(k == min(g) for k, g in groups.items())
    texts, said = dict(rows), {x["doc_id"]: x for x in found}
    for group in groups.values():
        # a text that links alone hold in its class has a measured link, never below the threshold
        if len({str(shingle_counts(texts[k] or "")) for k in group}) > 1:
            assert all(said[k]["links"] > 0 and neardup.THRESHOLD <= said[k]["likeness"] <= 1 for k in group)
        else:
            assert all(said[k]["links"] == 0 and said[k]["likeness"] is None for k in group)
    assert Counter(tuple(sorted(g)) for g in groups.values()) == classes_by_brute_force(rows)


def test_bounds_hold():
    r, sets = random.Random(14), []
    for _ in range(12):
        counts = {k: r.randint(1, 4) for k in r.sample(range(15), r.randint(0, 12))}
        sets.append((np.array(sorted(counts), np.uint64), np.array([counts[k] for k in sorted(counts)], np.int32)))
    overlaps = neardup.Overlaps(sets)
    for i in range(12):
        assert all(b >= neardup.likeness(sets[i], sets[j]) - 1e-9 for j, b in enumerate(overlaps.bound(i)))


def test_a_hub_of_many(spark):
    """More near copies of one text than a group of pairs takes."""
    base = prose(77, 400).split()
    rows = [(i, " ".join([*base[:i], f"w{i}", *base[i + 1 :]])) for i in range(390)] + [(1000, prose(78, 400))]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {**{i: 0 for i in range(390)}, 1000: 1000}


def test_likeness_is_exact():
    r = random.Random(13)
    for _ in range(100):
        a, b = ({k: r.randint(1, 4) for k in r.sample(range(12), r.randint(1, 9))} for _ in range(2))
        x, y = ((np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b))
        assert abs(neardup.likeness(x, y) - probability_jaccard(a, b)) < 1e-9


def test_neardup_odd(odd, none):
    found = neardup.classes(odd).collect()
    assert len(found) == 13
    assert len({r["class_id"] for r in found if r["doc_id"] in (5, 6, 7, 10)}) == 1
    assert neardup.classes(none).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (5, 6, 7, 10)").count() == 1


# tables between steps


def test_tables_are_dropped(spark):
    import os

    common.clear(spark)
    folder = common.shared_folder(spark).removeprefix("file://") + "/tables"
    queries.op10_probminhash_neardup(spark, SF_DIR).collect()
    queries.op9_minhash_fingerprints(spark, SF_DIR).collect()
    assert len(os.listdir(folder)) == 2
    common.clear(spark)
    assert os.listdir(folder) == []


def test_a_cluster_needs_its_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_columns_with_the_names_of_helpers(spark):
    rows = spark.createDataFrame([(i, prose(i, 20), "x", "y", "z") for i in range(5)], "doc_id long, text string, _split string, _rank string, _offset string")
    placed = sharding.with_slots(sharding.assign_shards(rows))
    assert {(r["_split"], r["_rank"], r["_offset"]) for r in placed.collect()} == {("x", "y", "z")} and placed.count() == 5
    pieces = packing.cut(rows).join(rows.drop("text"), "doc_id")
    packed = packing.pack(pieces).collect()
    assert len(packed) == 5 and {(r["_split"], r["_rank"], r["_offset"]) for r in packed} == {("x", "y", "z")}
    marked = rows.toDF("doc_id", "text", "__id", "__hash", "__stat_words")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    for kept in (neardup.keep_first(marked), quality.keep_good(marked, labels, threshold=0.0)):
        assert kept.columns == marked.columns and kept.count() == 5


# the pipeline


def test_pipeline(spark, texts, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, SF_DIR)
        assert name == "packing" or made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    good = {r["doc_id"]: r["text"] for r in kept["quality"]}
    one = [(k, good[k]) for k in sorted(good)]
    assert {min(g) for g in classes_by_brute_force(one)} == {r["doc_id"] for r in kept["near_dup"]}
    items = [decontamination.plain(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    search = decontamination.searcher(list(enumerate(x for x in items if x)))
    assert {r["doc_id"] for r in kept["benchmark"]} == {r["doc_id"] for r in kept["near_dup"] if not search(r["text"])}
    assert not any(base_by_pattern(r["text"] or "") for r in kept["pii"])
    assert {r["doc_id"] for r in kept["pii"]} == {r["doc_id"] for r in kept["benchmark"]} == {r["doc_id"] for r in kept["packing"]}
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(docs).collect()}
    assert all(len(ids) <= 4 * 4096 for ids in whole.values())
    for r in kept["packing"]:
        own = whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert own == bytes(r["ids"]) and zlib.crc32(own) == r["ids_crc32"]


def test_stages_on_odd_tables(spark, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES[:-1]:
        for docs, least in ((odd, 1), (none, 0)):
            made = stage(spark, docs, SF_DIR)
            assert made.columns == docs.columns and least <= made.count() <= docs.count(), name
    assert pipeline.pack(spark, none, SF_DIR).count() == 0 and pipeline.pack(spark, odd, SF_DIR).count() >= 13


def test_a_notice_of_nineteen_letters_takes_an_edit():
    search = licences.searcher(licences.NOTICES)
    for text in ("all rigts reserved", "All rightss reserved.", "al rights reserved"):
        assert search(text)[5] == "proprietary", text
    assert search("all wrongs reserved")[5] == "" and search("all rights reversed")[5] == ""


def test_long_and_repeated_labelled_texts_leave_the_others(spark):
    """A labelled text beyond the bound of bytes leaves out its bucket only; a labelled key that repeats is one text."""
    ordinary, toxic = [prose(900 + i, 40) for i in range(40)], ["vile awful " + prose(950 + i, 8) + " hateful scum" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(ordinary + toxic)]
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)] + [(100, 0), (101, 1)], "doc_id long, toxic int")
    long = [(100, prose(3, 3000)), (101, "vile scum " * 9000)]
    docs = spark.createDataFrame(rows + long + [(0, ordinary[0])] * 300 + [(1, f"{ordinary[1]} {i}") for i in range(300)], "doc_id long, text string")
    bound = 16_000
    assert all(len(t) > bound for _, t in long)
    found = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, labels, bytes_per_class=bound).collect()}
    assert len(set(found.values())) > 40
    assert sum(found[i] < 0.5 for i in range(40)) > 35 and sum(found[i] > 0.5 for i in range(40, 80)) > 35
    within = toxicity._within(spark.createDataFrame([(1, "x" * 50, 1.0), (2, "", 1.0), (3, "y" * 90, 0.0)], "key long, text string, y double"), 10)
    assert {r["key"] for r in within.collect()} >= {1, 3}
