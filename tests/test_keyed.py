"""Keyed tables: upserts, two writers, a broken write, replays, rollback."""

import pytest
from pyspark.sql import functions as F

from martelo.sources.keyed import Conflict, KeyedTable, stream_into

SCHEMA = "lot_id bigint, title string, n int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/lots", ["lot_id"], SCHEMA, buckets=4)


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def held(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=repr)


def test_upsert_touches_only_its_buckets(spark, table):
    assert held(table) == []
    assert table.upsert(rows(spark, *((i, "a", 0) for i in range(40)))) == 1
    before = table.manifest()["buckets"]
    assert table.upsert(rows(spark, (7, "b", 1), (7, "c", 2), (None, "none", 5), (None, None, 4)), order="n") == 2
    after = table.manifest()["buckets"]
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2
    wanted = sorted([(i, "a", 0) if i != 7 else (7, "c", 2) for i in range(40)] + [(None, "none", 5)], key=repr)
    assert held(table) == wanted and len(held(table, 1)) == 40
    assert table.upsert(rows(spark)) == 2  # nothing to write
    again = KeyedTable(spark, table.path)
    assert (again.keys, again.n_buckets, held(again)) == (["lot_id"], 4, wanted)


def test_second_of_two_writers_merges_again(spark, table):
    table.upsert(rows(spark, (1, "a", 0)))
    other, calls = KeyedTable(spark, table.path), []

    def merge(old, new):
        from martelo.operators.identity import upsert

        if not calls:  # the other one commits while this one writes
            other.upsert(rows(spark, (2, "other", 9), (1, "other", 9)))
        calls.append(1)
        return upsert(old, new, ["lot_id"])

    assert table.upsert(rows(spark, (1, "mine", 1), (3, "mine", 1)), merge=merge) == 3
    assert len(calls) == 2 and held(table) == [(1, "mine", 1), (2, "other", 9), (3, "mine", 1)]
    calls.clear()
    with pytest.raises(Conflict):
        table.upsert(rows(spark, (1, "late", 1)), merge=merge, attempts=1)
    assert held(table)[0] == (1, "other", 9)


def test_broken_write_changes_nothing(spark, table, tmp_path):
    table.upsert(rows(spark, (1, "a", 0), (2, "b", 0)))
    broken = lambda old, new: new.withColumn("n", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(rows(spark, (1, "x", 1)), merge=broken)
    assert table.version() == 1 and held(table) == [(1, "a", 0), (2, "b", 0)]
    left = tmp_path / "lots/data/lost/_bucket=1"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"half a file")
    assert held(table) == [(1, "a", 0), (2, "b", 0)]
    assert table.vacuum() == 1 and not left.exists() and held(table) == [(1, "a", 0), (2, "b", 0)]


def test_batches_come_once(spark, table):
    write = stream_into(table, "lots-topic")
    write(rows(spark, (1, "a", 0)), 0)
    write(rows(spark, (1, "b", 0)), 1)
    write(rows(spark, (1, "a", 0)), 0)  # comes again after a restart
    write(rows(spark, (1, "b", 0)), 1)
    assert held(table) == [(1, "b", 0)] and table.version() == 2
    assert table.upsert(rows(spark, (1, "c", 0)), writer="another", batch=0) == 3


def test_rollback(spark, table):
    table.upsert(rows(spark, (1, "a", 0)))
    table.upsert(rows(spark, (1, "b", 0), (2, "b", 0)))
    assert table.rollback(1) == 3 and held(table) == [(1, "a", 0)] and held(table, 2) == [(1, "b", 0), (2, "b", 0)]


def test_new_table_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/none")
