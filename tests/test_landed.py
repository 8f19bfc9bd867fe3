"""The data source of landed responses: paging, windows, filters, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from martelo.sources import files, landed


def page(path, term, day, number, *bodies):
    folder = path / f"term={term}" / f"day={day}" / f"page={number}"
    folder.mkdir(parents=True)
    for i, body in enumerate(bodies):
        (folder / f"part-{i}.txt").write_text(body if isinstance(body, str) else json.dumps(body))
    (folder / "_SUCCESS").write_text("")


def items(*ids, key="items"):
    return {key: [{"id": i, "texto": f"leilão {i}"} for i in ids]}


@pytest.fixture
def tree(tmp_path):
    page(tmp_path, "leil%C3%A3o", "2026-05-01", 1, items(1, 2), items(3, key="content"))
    page(tmp_path, "leil%C3%A3o", "2026-05-01", 2, items(4, 5))  # two of three: the last page
    page(tmp_path, "leil%C3%A3o", "2026-05-01", 3, items(6, 7, 8))
    page(tmp_path, "leil%C3%A3o", "2026-05-02", 1, items(9, 10, 11))
    page(tmp_path, "leil%C3%A3o", "2026-05-02", 3, items(12))  # after a missing page
    page(tmp_path, "praca", "2026-05-01", 1, "not json")
    page(tmp_path, "praca", "2026-05-03", 1, [{"id": 1}, {"no": "id"}, {"id": 13}])  # full, though one has no id
    page(tmp_path, "praca", "2026-05-03", 2, items(14, 15, 16))
    return tmp_path


def ids(df):
    return sorted((int(r.external_id), r.text) for r in files.gazette(df).collect())


def test_pages_stop_at_a_short_one(spark, tree):
    found = landed.pages(spark, f"file://{tree}", page_size=3).collect()
    assert sorted((r.term, str(r.day), r.page) for r in found) == [
        ("leilão", "2026-05-01", 1), ("leilão", "2026-05-01", 1), ("leilão", "2026-05-01", 2), ("leilão", "2026-05-02", 1),
        ("praca", "2026-05-01", 1), ("praca", "2026-05-03", 1), ("praca", "2026-05-03", 2),
    ]
    assert [i for i, _ in ids(landed.pages(spark, f"file://{tree}", page_size=3))] == [1, 2, 3, 4, 5, 9, 10, 11, 13, 14, 15, 16]
    assert {r.page for r in landed.pages(spark, str(tree), page_size=3, max_pages=1).collect()} == {1}


def test_window_and_filters(spark, tree):
    days = lambda df: sorted({(r.term, str(r.day)) for r in df.collect()})
    assert days(landed.pages(spark, str(tree), page_size=3, days=1, as_of="2026-05-02")) == [("leilão", "2026-05-01"), ("leilão", "2026-05-02"), ("praca", "2026-05-01")]
    (tree / "term=other/day=no-date").mkdir(parents=True)  # an error where it is listed
    df = landed.pages(spark, str(tree), page_size=3).filter((F.col("term") == "praca") & (F.col("day") >= dt.date(2026, 5, 2)))
    assert days(df) == [("praca", "2026-05-03")]
    assert days(landed.pages(spark, str(tree), page_size=3).filter(F.col("term").isin("praca", "leilão") & (F.col("page") == 2))) == [("leilão", "2026-05-01"), ("praca", "2026-05-03")]
    with pytest.raises(Exception, match="go together"):
        landed.pages(spark, str(tree), days=3).collect()
    assert landed.pages(spark, f"{tree}/none").count() == 0


def test_stream_takes_each_day_once(spark, tree, tmp_path_factory):
    work = tmp_path_factory.mktemp("stream")

    def run():
        query = landed.page_stream(spark, str(tree), page_size=3).writeStream.format("parquet").option("checkpointLocation", f"{work}/at").option("path", f"{work}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.term, str(r.day), r.page) for r in spark.read.parquet(f"{work}/out").collect())

    first = run()
    assert len(first) == 7 and run() == first
    page(tree, "praca", "2026-05-04", 1, items(20))
    assert run() == sorted([*first, ("praca", "2026-05-04", 1)])
