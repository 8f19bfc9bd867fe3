"""Which lots are one asset, and how their records merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable

#: Strength of each key of a lot.
STRENGTH = {"case_lot": 100, "registry": 90, "plate": 80, "natural": 10}
#: Authority of sources; from COURT_RANK on a source may replace a case number.
SOURCE_RANK = {"TRIBUNAL": 3, "DIARIO_OFICIAL": 3, "DATAJUD": 2, "LEILOEIRO": 1, "CADASTRO": 1, "DEMONSTRACAO": 0}
COURT_RANK = 3


def keys(lots: DataFrame) -> DataFrame:
    """lots plus its keys by strength: case and lot (valid cases), state and registry number (property, three
    letters or more), masked plate and year (vehicles), natural key."""
    number = F.coalesce(F.nullif(comparable(F.col("lot_number")), F.lit("")), F.lit("unico"))
    registry = comparable(F.col("registry"))
    return lots.withColumns(
        {
            "key_case_lot": F.when(F.col("case_valid") & F.col("case_number").isNotNull(), F.concat_ws("#", "case_number", number)),
            "key_registry": F.when((F.col("asset") == "IMOVEL") & F.col("uf").isNotNull() & (F.length(registry) >= 3), F.concat_ws("#", F.col("uf"), registry)),
            "key_plate": F.when((F.col("asset") == "VEICULO") & F.col("plate").isNotNull(), F.concat_ws("#", "plate", F.coalesce(F.col("model_year").cast("string"), F.lit("")))),
            "key_natural": F.col("natural_key"),
        }
    )


def match_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming (lot_id, ...) with match_id and matched_by: the stored lot of the strongest shared key.

    One equi-join for all four keys: both sides become (kind, key) rows, so there is one shuffle each and no
    disjunction. Of several stored lots under one key the least id counts. A plate without a year matches any year.
    """
    def exploded(df: DataFrame, id_name: str, loose: bool) -> DataFrame:
        pairs = [F.struct(F.lit(STRENGTH[k]).alias("strength"), F.lit(k).alias("kind"), F.col(f"key_{k}").alias("key")) for k in STRENGTH]
        if loose:  # a stored plate also answers for "no year stated"
            pairs.append(F.struct(F.lit(STRENGTH["plate"]).alias("strength"), F.lit("plate").alias("kind"), F.concat(F.substring_index("key_plate", "#", 1), F.lit("#")).alias("key")))
        return df.select(F.col("lot_id").alias(id_name), F.inline(F.array(*pairs))).filter(F.col("key").isNotNull())

    known = exploded(keys(stored), "match_id", True).groupBy("kind", "key").agg(F.min("match_id").alias("match_id"))
    best = exploded(keys(incoming), "lot_id", False).join(known, ["kind", "key"]).groupBy("lot_id").agg(F.max_by(F.struct("match_id", "kind"), "strength").alias("m"))
    return incoming.join(best, "lot_id", "left").select(*incoming.columns, F.col("m.match_id").alias("match_id"), F.col("m.kind").alias("matched_by"))


def canonical(lots: DataFrame) -> DataFrame:
    """(lot_id, canonical_id) within one batch: the least id under the strongest key that any other lot shares."""
    pairs = [F.struct(F.lit(STRENGTH[k]).alias("strength"), F.lit(k).alias("kind"), F.col(f"key_{k}").alias("key")) for k in STRENGTH]
    each = keys(lots).select("lot_id", F.inline(F.array(*pairs))).filter(F.col("key").isNotNull())
    shared = each.groupBy("kind", "key").agg(F.min("lot_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = each.join(shared, ["kind", "key"]).groupBy("lot_id").agg(F.max_by("first", "strength").alias("first"))
    return lots.select("lot_id").join(best, "lot_id", "left").select("lot_id", F.coalesce("first", "lot_id").alias("canonical_id"))


def _blank(c: Column, kind: str) -> Column:
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0) if kind.startswith("array") else c.isNull()


def merge(old: DataFrame, new: DataFrame, key: str, fill: Sequence[str], append: Sequence[str] = (), replace: Sequence[str] = (), open_values: dict[str, str] | None = None, may_replace: Column | None = None) -> DataFrame:
    """Old records with new ones merged in, and `changed`: the names of what changed.

    fill: a blank takes the new value. append: lists keep their order and take what they lack. replace: also over a
    value, where may_replace holds. open_values: a column that holds its open value takes any other. Records on
    only one side pass; blanks on the new side never erase.
    """
    kinds = dict(old.dtypes)
    open_values = open_values or {}
    may_replace = F.lit(False) if may_replace is None else may_replace
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    made, changed = [F.col(key)], []
    for name in old.columns:
        if name == key:
            continue
        o, n = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name in append:
            taken = F.array_distinct(F.concat(F.coalesce(o, F.array().cast(kinds[name])), F.array_except(F.coalesce(n, F.array().cast(kinds[name])), F.coalesce(o, F.array().cast(kinds[name])))))
            change = F.size(F.array_except(F.coalesce(n, F.array().cast(kinds[name])), F.coalesce(o, F.array().cast(kinds[name])))) > 0
        elif name in open_values:
            change = n.isNotNull() & (n != open_values[name]) & (F.coalesce(o, F.lit(open_values[name])) == open_values[name])
            taken = F.when(change, n).otherwise(o)
        elif name in fill or name in replace:
            over = may_replace if name in replace else F.lit(False)
            change = ~_blank(n, kinds[name]) & ~o.eqNullSafe(n) & (_blank(o, kinds[name]) | over)
            taken = F.when(change, n).otherwise(o)
        else:
            made.append(F.coalesce(o, n).alias(name))
            continue
        made.append(taken.alias(name))
        changed.append(F.when(change, F.lit(name)))
    return both.select(*made, F.array_compact(F.array(*changed)).alias("changed"))


def rules_case(source: Column) -> Column:
    """Whether a source may replace a stored case, district and chamber: a court or an official gazette."""
    rank = F.lit(0)
    for name, n in SOURCE_RANK.items():
        rank = F.when(source == name, n).otherwise(rank)
    return rank >= COURT_RANK


def merge_auctioneers(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Auctioneers with what registers and courts tell of them merged in; `created` marks those that were not there.

    old: auctioneer_id, name, register, licence, uf, status, districts, credentials, site, email, phone, checked_at.
    new: name, register, licence, uf, status, districts, source, site, email, phone, in any number of rows for one;
    `sequence` orders them. A row belongs to who bears its name, or its licence in its register. Blanks take the first
    filled value; a known status takes the place of any; districts append; a court's source (tj...) is a credential of
    that court. Those found nowhere are one by name and get ids after the largest, in the names' order; the row that brings
    one in gives no credential, later rows do. Rows without a name go.
    """
    ranked = match_auctioneers(new.filter(F.col("name").isNotNull()), old)
    name = comparable(F.col("name"))
    first = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("sequence"))).alias(c)
    known_status = F.when(F.col("status") != "DESCONHECIDO", F.col("sequence"))
    lists = F.array_sort(F.collect_list(F.struct("sequence", F.coalesce("districts", F.array().cast("array<string>")).alias("d"))))
    court = F.when(F.col("source").startswith("tj"), F.upper(F.substring_index("source", "-", 1)))
    told = ranked.groupBy("auctioneer_id", F.when(F.col("auctioneer_id").isNull(), name).alias("_name")).agg(
        F.min_by("name", "sequence").alias("name"), *(first(c) for c in ("register", "licence", "uf", "site", "email", "phone")),
        F.max_by(F.when(known_status.isNotNull(), F.col("status")), known_status).alias("status"),
        F.array_distinct(F.flatten(F.transform(lists, lambda x: x["d"]))).alias("districts"),
        F.collect_set(F.when(court.isNotNull(), F.struct("sequence", court.alias("court")))).alias("courts"), F.min("sequence").alias("_start"),
    )
    moment = F.lit(as_of).cast("timestamp_ntz")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    empty = F.array().cast("array<string>")
    held = F.coalesce(o("credentials"), F.create_map().cast("map<string,boolean>"))
    fresh = F.array_sort(F.array_distinct(F.coalesce(F.transform(n("courts"), lambda x: x["court"]), empty)))
    every = F.array_union(F.map_keys(held), fresh)
    credentials = F.map_from_arrays(every, F.transform(every, lambda k: F.array_contains(fresh, k) | F.coalesce(F.try_element_at(held, k), F.lit(False))))
    both = old.alias("o").join(told.filter("auctioneer_id is not null").alias("n"), "auctioneer_id", "left")
    fill = {c: F.coalesce(F.nullif(o(c), F.lit("")), n(c)) for c in ("register", "licence", "site", "email", "phone")}
    # a list that a row lacks appends nothing
    districts = F.array_distinct(F.concat(F.coalesce(o("districts"), empty), F.coalesce(n("districts"), empty)))
    kept = {**fill, "status": F.coalesce(n("status"), o("status")), "districts": districts, "credentials": credentials, "checked_at": F.when(n("name").isNotNull(), moment).otherwise(o("checked_at"))}
    merged = both.select(*(kept.get(c, F.col("auctioneer_id") if c == "auctioneer_id" else o(c)).alias(c) for c in old.columns), F.lit(False).alias("created"))
    later = F.array_sort(F.array_distinct(F.transform(F.filter("courts", lambda x: x["sequence"] > F.col("_start")), lambda x: x["court"])))
    born = told.filter("auctioneer_id is null").join(old.agg(F.coalesce(F.max("auctioneer_id"), F.lit(0)).alias("_top")))
    numbered = _numbered(born, "_name")
    made = {"auctioneer_id": F.col("_top") + F.col("_n"), "status": F.coalesce("status", F.lit("DESCONHECIDO")), "credentials": F.map_from_arrays(later, F.transform(later, lambda _: F.lit(True))), "checked_at": moment}
    return merged.unionByName(numbered.select(*(made.get(c, F.col(c)).cast(dict(old.dtypes)[c]).alias(c) for c in old.columns), F.lit(True).alias("created")))


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with _n, from 1 in the order of a column of distinct texts. Rows are numbered within blocks of equal first two
    letters; a running sum over the blocks, which are few, gives each its start, so no task holds all rows."""
    from pyspark.sql import Window

    block = F.substring(order, 1, 2)
    sizes = rows.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_block")) - F.col("_size")).drop("_size")
    inside = rows.withColumns({"_block": block}).withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy(order)))
    return inside.join(starts, "_block").withColumn("_n", F.col("_before") + F.col("_at")).drop("_block", "_at", "_before")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Old rows with new ones over them by key, null keys equal to null; of several new ones the last by `order`."""
    names = old.columns
    rest = [c for c in names if c not in keys]
    if order:  # a struct, as max_by passes over rows whose order is null; such rows come first
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_row")).select(*keys, "_row.*")
    marked = old.select(*names, F.lit(0).alias("_side")).unionByName(new.select(*names, F.lit(1).alias("_side")))
    return marked.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_side").alias("_row")).select(*keys, "_row.*").select(names)


def most_complete(rows: DataFrame, key: str, fields: Sequence[str], sequence: str) -> DataFrame:
    """One row for each key: the one with the most fields filled, the earliest of equals."""
    filled = reduce(lambda a, b: a + b, ((F.col(f).isNotNull() & (F.col(f).cast("string") != "")).cast("int") for f in fields))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(filled, -F.col(sequence))).alias("_row"))
    return best.select("_row.*")


def keep_findings(old: DataFrame, new: DataFrame, from_document: bool = False, last: Column | None = None) -> DataFrame:
    """Findings (lot_id, name, confidence, method, value) with new ones merged in: one a person made stays;
    otherwise a less sure one never replaces a surer one. One read from a document always replaces. Of equally sure
    ones of a side the last by `last` counts, or else the greatest value."""
    last = F.col("value") if last is None else last
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.struct((F.col("_new") == 0) & (F.col("method") == "MANUAL"), F.col("_new") if from_document else F.col("confidence"), "_new", "confidence", last, "value")
    best = rows.groupBy("lot_id", "name").agg(F.max_by(F.struct("confidence", "method", "value"), rank).alias("_row"))
    return best.select("lot_id", "name", "_row.*")


def apply_findings(lots: DataFrame, findings: DataFrame, names: Sequence[str], least: float = 0.70) -> DataFrame:
    """lots with null columns filled from findings that are sure enough; the long table is pivoted on fixed names."""
    wide = findings.filter((F.col("confidence") >= least) & F.col("name").isin(*names)).groupBy("lot_id").pivot("name", list(names)).agg(F.max_by("value", F.struct("confidence", "value")))
    kinds = dict(lots.dtypes)
    renamed = wide.select("lot_id", *(F.col(n).alias(f"_{n}") for n in names))
    filled = [F.coalesce(F.col(c), F.col(f"_{c}").try_cast(kinds[c])).alias(c) if c in names else F.col(c) for c in lots.columns]
    return lots.join(renamed, "lot_id", "left").select(filled)


def unseen(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.dropDuplicates(list(keys)).join(known, list(keys), "left_anti")


def match_auctioneers(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Known auctioneers by name, or by register and licence: two equi-joins, the name first."""
    by_name = known.groupBy(comparable(F.col("name")).alias("_name")).agg(F.min("auctioneer_id").alias("_by_name"))
    by_licence = known.filter(F.col("licence").isNotNull()).groupBy("register", "licence").agg(F.min("auctioneer_id").alias("_by_licence"))
    found = rows.withColumn("_name", comparable(F.col("name"))).join(by_name, "_name", "left").join(by_licence, ["register", "licence"], "left")
    return found.select(*rows.columns, F.coalesce("_by_name", "_by_licence").alias("auctioneer_id"))


def obsolete(lots: DataFrame, as_of: str, days: int = 45) -> DataFrame:
    return lots.filter(F.col("last_seen") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))
