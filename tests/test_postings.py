"""Text search by postings: the rows of holds_all, and what the plan reads."""

import random

import pytest
from pyspark.sql import functions as F

from martelo.operators import postings, search

TITLES = [None, "", "a", "ab", "Casa em Maceió", "CASA  casa", "aaaaaaaa", "abababab", "São João da Barra nº 12", "terreno (rural)", "日本 casa", "x" * 300]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rnd = random.Random(3)
    made = TITLES + ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(40))) for _ in range(150)]
    lots = spark.createDataFrame([(i, t, None if i % 3 else "descrição ABC") for i, t in enumerate(made)], "lot_id bigint, title string, description string")
    path = f"file://{tmp_path_factory.mktemp('index')}/postings"
    postings.build(lots, path)
    return lots, path, made


def test_finds_what_holds_all_finds(spark, world):
    lots, path, made = world
    rnd, words = random.Random(4), ["", "  ", "casa", "CASA maceio", "aa", "a", "aaaa", "abab", "sao joao", "12", "(rural)", "日本", "descricao abc", "x" * 20, "no such", "ab ab", "aaa aaaa", "barra nº"]
    for size in range(1, 21):
        body = rnd.choice([t for t in made if t and len(t) > 25])
        at = rnd.randrange(len(body) - size)
        words.append(body[at : at + size])
    body = search.comparable(F.concat_ws(" ", "title", "description"))
    texts = {r.lot_id: r.b for r in lots.select("lot_id", body.alias("b")).collect()}
    for asked in words:
        terms = search._plain(asked).split()
        wanted = sorted(k for k, b in texts.items() if all(t in b for t in terms))
        assert sorted(r.lot_id for r in postings.found(spark, path, asked).collect()) == wanted, asked


def test_plan_reads_the_pieces_only(spark, world):
    _, path, _ = world
    plan = postings.found(spark, path, "maceió a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PushedFilters: [Or(" in plan and "StringStartsWith(piece,a)" in plan
    assert postings.parts_of("maceio") == [("mac", 0), ("eio", 3)] and postings.parts_of("abcdefg") == [("abc", 0), ("def", 3), ("efg", 4)]


def test_empty_table(spark, world, tmp_path):
    lots, _, _ = world
    postings.build(lots.limit(0), f"file://{tmp_path}/none")
    assert not postings.found(spark, f"file://{tmp_path}/none", "a").collect()
