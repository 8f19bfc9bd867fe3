"""Places of whole tables in an order, against plain Python."""

import random
from decimal import Decimal

import pytest

from martelo.operators import search
from martelo.plans.catalogue import QUERIES
from martelo.plans.lots import lots

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "lot_id bigint, discount double, first_min decimal(14,2), second_min decimal(14,2)"


def by_discount(row):
    return -(row.discount or -1.0), row.lot_id


def by_price(row):
    return row.second_min or row.first_min or 10**12, row.lot_id


def places(rows, key):
    return {row.lot_id: n for n, row in enumerate(sorted(rows, key=key), 1)}


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as dealt, however small."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    yield
    spark.conf.set(setting, before)


def test_every_lot_has_both_places(spark):
    rows = lots(spark, SF_DIR).filter("status = 'DESERTO'").collect()
    discount, price = places(rows, by_discount), places(rows, by_price)
    found = QUERIES["zero_vs_null_sort"](spark, SF_DIR).collect()
    assert len(found) == len(rows) > 100
    assert {(r.lot_id, r.by_discount, r.by_price) for r in found} == {(k, discount[k], price[k]) for k in discount}


@pytest.mark.parametrize(("order", "key"), [("discount", by_discount), ("price", by_price)])
def test_places_over_many_ranges(spark, many_ranges, tmp_path, order, key):
    rnd = random.Random(5)
    values, prices = [None, 0.0, 0.0, -1.0, 0.5, 60.0], [None, Decimal(0), Decimal("0.01"), Decimal(7), Decimal(10**11)]
    made = [(i, rnd.choice(values), rnd.choice(prices), rnd.choice(prices)) for i in rnd.sample(range(-4000, 4000), 4000)]
    rows = spark.createDataFrame(made, SCHEMA).repartition(5)
    path = f"file://{tmp_path}/ranked"
    found = search.ranked(rows, order, "place", path)
    assert found.columns == [*rows.columns, "place"]
    wanted = places(rows.collect(), key)
    assert sorted((r.lot_id, r.place) for r in found.collect()) == sorted(wanted.items())
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_range").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2000  # one key holds a third of the lots; ids part it


def test_one_key_for_all_and_none(spark, many_ranges, tmp_path):
    same = spark.range(1000).selectExpr("id as lot_id", "cast(null as double) as discount", "cast(0 as decimal(14,2)) as first_min", "cast(null as decimal(14,2)) as second_min")
    found = search.ranked(same, "discount", "place", f"file://{tmp_path}/same").collect()
    assert len(found) == 1000 and all(r.place == r.lot_id + 1 for r in found)
    none = search.ranked(same.limit(0), "price", "place", f"file://{tmp_path}/none")
    assert none.columns == [*same.columns, "place"] and none.collect() == []
