"""Vehicles against the price table where many rows have equal texts."""

import time

from pyspark.sql import functions as F

from martelo.operators import market

VEHICLES, TABLE = "id long, brand string, model string, year int", "ref_id long, brand string, model string, year int"


def test_equal_texts_meet_once(spark):
    # 144 million pairs of rows, six pairs of texts
    vehicles = spark.range(12_000).select("id", F.lit("Fiat").alias("brand"), F.concat(F.lit("uno mille "), F.lit("abc").substr(F.lit(1), (F.col("id") % 3 + 1).cast("int"))).alias("model"), F.lit(2010).alias("year"))
    table = spark.range(12_000).select((F.lit(20_000) - F.col("id")).alias("ref_id"), F.lit("FIAT").alias("brand"), F.when(F.col("id") % 2 == 0, "uno mille").otherwise("mille uno way").alias("model"), F.lit(2010).alias("year"))
    began = time.time()
    found = market.match_models(vehicles, table).groupBy((F.col("id") % 3).alias("k"), "ref_id", "likeness").count().collect()
    assert sorted((r.k, r.ref_id, r.likeness, r["count"]) for r in found) == [(0, 8002, 1.0, 4000), (1, 8002, 0.75, 4000), (2, 8002, 0.75, 4000)]
    assert time.time() - began < 40


def test_odd_vehicles(spark):
    vehicles = spark.createDataFrame([(1, None, "gol mi", 2000), (1, "VW", "gol mi", 2001), (2, "VW", "gol mi", None), (3, None, None, None), (4, "vw", "gol mi", 2001)], VEHICLES)
    table = spark.createDataFrame([(9, "VW", "gol mi", 2001), (7, "VW", "mi gol gol", 2001), (8, "VW", "gol", None)], TABLE)
    found = sorted((r.id, r.ref_id, r.likeness) for r in market.match_models(vehicles, table).collect())
    # id 1 stands for two rows, of which the one with brand and year is closer; missing years are no other year
    assert found == [(1, 7, 1.0), (2, 7, 1.0), (4, 7, 1.0)]
