"""Near-duplicate classes by ProbMinHash over weighted five-word shingles.

The likeness of two texts is their probability Jaccard over shingle counts: the sum, over shared shingles x, of
1 / sum over y of max(a_y / a_x, b_y / b_x). It equals plain Jaccard where no shingle repeats. Texts are linked at
0.8 or more, measured exactly; classes are the connected components of all links.

1. Each text gets a signature: every shingle is a Poisson process whose rate is its count, each arrival falls on a
   random register, a register keeps its earliest arrival; a text stops when no later arrival can win.
2. Texts with equal shingle counts fall together; what follows sees each distinct text once.
3. Signature bands are joined; every member of a bucket is verified against one hub, the bucket's least text.
4. Buckets whose members are still in different classes are searched through, in square blocks of bounded size:
   whoever is outside a bucket's largest class meets every member, and only links between different classes leave
   the task. A pair is set aside by an exact bound alone (what the shared shingles weigh in either text), so no
   pair of a bucket goes unexamined, though most are settled by their classes already.

Only pairs that share no band can be missed: one in 17,000 at a likeness of 0.8, fewer above.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, map_rows, scratch, stored, unused
from .shingles import U, counted, mix

THRESHOLD = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Side of a block in the search through mixed buckets.
BLOCK = 128
#: Spokes that a hub meets in one group of rows; a hub with more is dealt to several.
SPOKES = 256
#: Nodes up to which their keys (16 bytes each) may be broadcast; beyond, the join shuffles.
BROADCAST_NODES = 500_000


def signatures(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """uint32[n, registers]: the shingle that arrives first at each register; 0 in the rows of empty texts."""
    when = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint32)
    rate, time, turn = 1.0 / weights, np.zeros(len(docs)), 0
    name = mix(hashes).astype(np.uint32)
    while len(docs):
        turn += 1
        drawn = mix(hashes + U(turn * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((drawn >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) * rate
        place = docs * registers + (mix(drawn) % U(registers)).astype(np.int64)
        np.minimum.at(when, place, time)
        won = time == when[place]
        who[place[won]] = name[won]
        going = time < when.reshape(n, registers).max(axis=1)[docs]
        docs, hashes, rate, time, name = docs[going], hashes[going], rate[going], time[going], name[going]
    return who.reshape(n, registers)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """int64[n, BANDS]: a hash of each band's registers and its number."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(U)
    total = np.zeros(parts.shape[:2], U)
    for i in range(ROWS):
        total = mix(total + parts[:, :, i] + U(i + 1))
    return mix(total + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two texts, each (sorted distinct shingles, counts)."""
    (x, p), (y, q) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    p, q = p.astype(float), q.astype(float)
    ps, qs = p[i], q[j]
    ratio = ps / qs
    order = np.argsort(ratio, kind="stable")
    ratio, ps, qs = ratio[order], ps[order], qs[order]
    # shingles of only one text have the ratio's extremes
    only_p = p.sum() - ps.sum()
    only_q = q.sum() - qs.sum()
    before = np.concatenate(([0.0], np.cumsum(qs)))
    after = np.concatenate((np.cumsum(ps[::-1])[::-1], [0.0]))
    at = np.searchsorted(ratio, ratio, "left")
    return float((1.0 / ((only_p + after[at]) / ps + (only_q + before[at]) / qs)).sum())


def by_size(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about SLICE_BYTES letters, which bounds the arrays made from a run."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > SLICE_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def sets_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for run in by_size(texts):
        docs, hashes, weights = counted(run)
        cuts = np.concatenate(([0], np.searchsorted(docs, np.arange(1, len(run) + 1))))
        out += [(hashes[a:b].copy(), weights[a:b].astype(np.int32)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def signatures_of(texts: list[str | None]) -> np.ndarray:
    return np.vstack([signatures(*counted(run), len(run)) for run in by_size(texts)])


class Method(NamedTuple):
    """How texts are signed and compared: by shingle counts, or by sets of shingles alone."""

    signatures_of: Callable[[list[str | None]], np.ndarray]
    likeness: Callable[[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], float]
    counts: bool


BY_COUNTS = Method(signatures_of, likeness, True)


def digests(df: DataFrame, key: str, text: str, method: Method = BY_COUNTS) -> DataFrame:
    """(id, hash, same, bands): `same` is equal for texts with equal shingle counts, or sets."""

    def make():
        def f(keys, texts, hashes):
            docs, shingle, weights = counted(texts)
            signature = signatures(docs, shingle, weights, len(texts)) if method.counts else method.signatures_of(texts)
            cuts = np.concatenate(([0], np.searchsorted(docs, np.arange(1, len(texts) + 1))))
            same = [blake2b(shingle[a:b].tobytes() + (weights[a:b].tobytes() if method.counts else b""), digest_size=16).digest() for a, b in zip(cuts, cuts[1:], strict=False)]
            return [keys, hashes, same, list(bands_of(signature))]

        return f

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    return map_rows(rows, ["id", "text", "hash"], f"id {kind}, hash long, same binary, bands array<long>", make)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the least node that can be reached.

    Each round takes the least label about and then the label's own label; both are equi-joins, and each round is
    a table in the shared folder, so a lost executor costs at most a round.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), narrow=True)
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stored(nearer.join(own, "label").select("node", F.least("label", "next").alias("label"), "old"), narrow=True)
        labels = jumped.select("node", "label")
        if jumped.filter(F.col("label") != F.col("old")).isEmpty():
            return labels


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, method: Method = BY_COUNTS) -> DataFrame:
    """The pairs (a, b) whose texts are alike enough, with their likeness. A text that many pairs have on their left
    side is dealt to groups of about SPOKES pairs, so that no task gets all of them."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))

    def make():
        held: dict = {}

        def f(a, b, xs, ys):
            hubs = [i for i, n in enumerate(a) if n not in held]
            if hubs:
                held.clear()
                hubs = list({n: i for i, n in enumerate(a)}.values())
                held.update(zip((a[i] for i in hubs), sets_of([xs[i] for i in hubs]), strict=True))
            return [a, b, [method.likeness(held[n], s) for n, s in zip(a, sets_of(ys), strict=True)]]

        return f

    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).alias("groups"))
    dealt = pairs.select("a", "b").join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("group"))
    hubs = dealt.select("a", "group").distinct().join(left, "a")
    rows = map_rows(dealt.join(right, "b").join(hubs, ["a", "group"]), ["a", "b", "x", "y"], "a long, b long, likeness double", make)
    return rows.filter(F.col("likeness") >= threshold)


class Overlaps:
    """Some texts' shingles, numbered, so that one text's overlap with all of them takes one pass over numbers."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes = np.array([len(x) for x, _ in sets])
        _, number = np.unique(np.concatenate([x for x, _ in sets] or [np.zeros(0, U)]), return_inverse=True)
        self.numbers, self.begins = number, np.concatenate(([0], np.cumsum(self.sizes)))
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.weights = np.concatenate([w for _, w in sets] or [np.zeros(0)]).astype(float)
        self.totals = np.bincount(self.owner, self.weights, len(sets))
        self.own = np.zeros(len(number) and int(number.max()) + 1)

    def bound(self, i: int) -> np.ndarray:
        """No text can be more like text i than this: the lesser share of either text that shared shingles make up.

        Holds for the probability Jaccard of counts, and so for plain Jaccard where every count is 1.
        """
        mine = slice(self.begins[i], self.begins[i + 1])
        if mine.start == mine.stop:
            return (self.sizes == 0).astype(float)
        self.own[self.numbers[mine]] = self.weights[mine]
        there = self.own[self.numbers]
        shared = there > 0
        theirs = np.bincount(self.owner[shared], self.weights[shared], len(self.sizes))
        ours = np.bincount(self.owner[shared], there[shared], len(self.sizes))
        self.own[self.numbers[mine]] = 0.0
        return np.minimum(theirs / np.maximum(self.totals, 1), ours / self.totals[i])


def _mixed_links(members: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float, method: Method = BY_COUNTS) -> DataFrame | None:
    """Links found by searching buckets whose members have different labels; None if there are no such buckets."""
    held = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    sizes = held.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    # a bucket of two was settled with its hub
    mixed = stored(sizes.groupBy("band").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels")).filter("labels > 1 and total > 2"), narrow=True)
    if mixed.isEmpty():
        return None
    # buckets with the same largest class are searched as one, so that a pair that shares many bands meets once
    found = stored(held.join(mixed.select("band", "main"), "band").select("main", "node", "label").distinct(), narrow=True)
    count = found.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"), F.ceil(F.count_if(F.col("label") != F.col("main")) / BLOCK).cast("int").alias("odd"))
    rows = found.join(count, "main")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    every = rows.select("main", "node", "label", F.lit(False).alias("minor"), (spread % F.col("all")).alias("j"), F.explode(F.sequence(F.lit(0), F.col("odd") - 1)).alias("i"))
    minor = rows.filter("label != main").select("main", "node", "label", F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), (spread % F.col("odd")).alias("i"))
    filled = every.unionByName(minor).join(texts, "node")

    def search(block: pd.DataFrame) -> pd.DataFrame:
        nodes = block.drop_duplicates("node")
        index = {n: i for i, n in enumerate(nodes["node"])}
        sets = sets_of(nodes["text"].tolist())
        overlaps = Overlaps(sets if method.counts else [(x, np.ones(len(x), np.int32)) for x, _ in sets])
        root = dict(zip(nodes["label"], nodes["label"], strict=True))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        label, found = dict(zip(nodes["node"], nodes["label"], strict=True)), []
        others = np.array([index[n] for n in block.loc[~block["minor"], "node"]], int)
        names = nodes["node"].tolist()
        for n in block.loc[block["minor"], "node"]:
            i = index[n]
            most = overlaps.bound(i)[others]
            # the bound is exact but for rounding
            for at in np.argsort(-most, kind="stable"):
                if most[at] < threshold - 1e-9:
                    break
                j = others[at]
                m = names[j]
                p, q = find(label[n]), find(label[m])
                if p != q and (x := method.likeness(sets[i], sets[j])) >= threshold:
                    root[max(p, q)] = min(p, q)
                    found.append((min(n, m), max(n, m), x))
        return pd.DataFrame(found, columns=["a", "b", "likeness"])

    return filled.groupBy("main", "i", "j").applyInPandas(search, "a long, b long, likeness double")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, method: Method = BY_COUNTS) -> DataFrame:
    """One row for each row of df: key, class_id (the least key of its class), hash and class_hash (XXH64 of the
    row's text and of the text that stands for the class), links and likeness.

    links counts the measured links of the row's text to other texts, likeness is the greatest of them (null without
    any); links that a class's other links make needless are not measured. Null and empty texts make one class, as
    equal texts do; texts without words are alike only if equal. Rows with the same key but other texts are told
    apart. class_id is null only where no row of the class has a key. Repeated rows stay. Other columns are not
    carried. A class or a bucket may hold most rows of df: no task gets all of them.
    """
    with scratch(df.sparkSession):
        return _classes(df, key, text, threshold, method)


def _classes(df: DataFrame, key: str, text: str, threshold: float, method: Method) -> DataFrame:
    rows = stored(digests(df, key, text, method))
    # a node is a distinct text; nodes are numbered by key, once, as they are stored
    firsts = rows.groupBy("same").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("row"), F.first("bands").alias("bands"))
    ordered = firsts.select("same", "row.none", "row.id", "row.hash", "bands").repartitionByRange("none", "id", "hash").sortWithinPartitions("none", "id", "hash")
    nodes = stored(ordered.select(F.monotonically_increasing_id().alias("node"), "same", "id", "hash", "bands"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(banded.join(hubs.select("band", "hub"), "band"), narrow=True)
    near = stored(nodes.select("node", "id", "hash").join(members.select("node").distinct(), "node", "left_semi"), narrow=True)
    few = F.broadcast(near) if near.count() <= BROADCAST_NODES else near
    whole = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    same_row = whole["id"].eqNullSafe(near["id"]) & (whole["hash"] == near["hash"])
    texts = stored(whole.join(few, same_row).select("node", whole["text"]).dropDuplicates(["node"]))

    spokes = members.filter("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = spokes.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    tried = stored(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), narrow=True)
    links = stored(verified(tried, texts, threshold, method))
    labels = components(links)
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("p"))
    other = labels.select(F.col("node").alias("b"), F.col("label").alias("q"))
    rest = spokes.select(F.col("hub").alias("a"), F.col("node").alias("b")).join(tried, ["a", "b"], "left_anti").join(own, "a", "left").join(other, "b", "left")
    again = stored(rest.filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b"), narrow=True)
    more = stored(verified(again, texts, threshold, method))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    mixed = _mixed_links(members, labels, texts, threshold, method)
    if mixed is not None and not (mixed := stored(mixed)).isEmpty():
        links = links.unionByName(mixed)
        labels = components(links)
    heads = nodes.select(F.col("node").alias("label"), F.col("id").alias("class_id"), F.col("hash").alias("class_hash"))
    linked = links.select(F.col("a").alias("node"), "likeness").union(links.select("b", "likeness")).groupBy("node").agg(F.count(F.lit(1)).alias("links"), F.max("likeness").alias("likeness"))
    named = nodes.select("node", "same").join(labels, "node", "left").join(linked, "node", "left").select("same", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "likeness")
    found = named.join(heads, "label").select("same", "class_id", "class_hash", "links", "likeness")
    return stored(rows.select("id", "hash", "same").join(found, "same").select(F.col("id").alias(key), "class_id", "hash", "class_hash", "links", "likeness"), keep=True)


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that stay: of each class the row with the least key, and of equal rows one. All columns pass,
    whatever their names. Null and empty texts are one class; an empty df stays empty."""
    found = classes(df, key, text, threshold)
    marks = unused(df, "__none", "__id", "__hash")
    mark = lambda k, h: dict(zip(marks, (k.isNull(), F.coalesce(k.cast("string"), F.lit("")), h), strict=True))
    heads = found.withColumns(mark(F.col("class_id"), F.col("class_hash"))).select(marks).distinct()
    marked = df.withColumns(mark(F.col(key), F.xxhash64(text)))
    return marked.join(heads, marks, "left_semi").dropDuplicates(marks).select(df.columns)
