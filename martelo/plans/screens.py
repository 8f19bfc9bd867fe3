"""Queries of what screens and imports ask: publications, comparisons, saved criteria, recent and unseen rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets, identity, search
from .lots import AS_OF, lots
from .registered import query, read

PUBLICATIONS_SQL = "SELECT doc_id AS publication_id, CASE WHEN doc_id % 13 > 0 THEN DATE '2024-01-01' + CAST(doc_id % 50 AS INTEGER) END AS published_on, doc_id % 3 = 0 AS detected FROM documents"


def _publications(spark, sf_dir):
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 50).cast("int"))
    return read(spark, sf_dir, "documents").select(i.alias("publication_id"), F.when(i % 13 > 0, day).alias("published_on"), (i % 3 == 0).alias("detected"))


@query(f"SELECT publication_id, published_on FROM ({PUBLICATIONS_SQL}) ORDER BY published_on DESC NULLS LAST, publication_id DESC LIMIT 40 OFFSET 80")
def publications_page(spark, sf_dir):
    """The third page of forty, the latest first, those without a day last."""
    return facets.publication_page(_publications(spark, sf_dir), 3, 40).select("publication_id", "published_on")


@query(f"SELECT count(*) AS total, count(*) FILTER (detected) AS detected FROM ({PUBLICATIONS_SQL})")
def publications_counted(spark, sf_dir):
    """A7."""
    return facets.publication_counts(_publications(spark, sf_dir))


@query("""SELECT lot_id, CAST((CASE WHEN 2 * (s * 10 % n) > n OR 2 * (s * 10 % n) = n AND s * 10 // n % 2 = 1 THEN 1 ELSE 0 END + s * 10 // n) AS DOUBLE) / 1000 AS mean_confidence, to_review FROM (
SELECT o_custkey AS lot_id, CAST(sum(o_orderkey % 101) AS BIGINT) AS s, count(*) AS n, count(*) FILTER (o_orderkey % 101 < 70) AS to_review FROM orders GROUP BY o_custkey)""")
def findings_of_lots(spark, sf_dir):
    """Mean confidence, half-even at three places, and findings to look at."""
    found = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lot_id"), (F.col("o_orderkey") % 101 / 100).alias("confidence"))
    return facets.findings_quality(found).select("lot_id", F.col("mean_confidence").cast("double").alias("mean_confidence"), "to_review")


@query("SELECT lot_id, title, place FROM (SELECT lot_id, title, row_number() OVER (ORDER BY score DESC NULLS LAST, lot_id) AS r FROM lots) JOIN (VALUES (3, 0), (1, 1), (7, 2)) AS v(r, place) USING (r)", with_lots=True)
def compared_lots(spark, sf_dir):
    """Three lots side by side, in the order asked for: the third, first and seventh by score."""
    best = lots(spark, sf_dir).orderBy(F.col("score").desc_nulls_last(), "lot_id").limit(7).select("lot_id").collect()
    return search.by_ids(lots(spark, sf_dir), [best[n].lot_id for n in (2, 0, 6)]).select("lot_id", "title", "place")


@query("""SELECT lot_id, s AS score FROM (SELECT lot_id, status, CASE WHEN customer_id % 4 > 0 THEN CAST(customer_id % 100 AS DOUBLE) END AS s, CASE WHEN customer_id % 4 > 0 THEN CAST(customer_id % 60 AS DOUBLE) END AS d FROM lots) WHERE status = 'ABERTO' AND s >= 50 AND d >= 10""", with_lots=True)
def search_by_joined_scores(spark, sf_dir):
    """Scores from their own table; a lot without one fits no criterion of score or discount."""
    own, c = lots(spark, sf_dir).drop("score", "discount"), F.col("customer_id")
    scores = own.filter(c % 4 > 0).select("lot_id", (c % 100).cast("double").alias("score"), (c % 60).cast("double").alias("discount"))
    return search.matching(own, search.LotFilter(least_score=50, least_discount=10), scores=scores).select("lot_id", "score")


@query("""SELECT lot_id, collected_at FROM lots WHERE status = 'ARREMATADO' ORDER BY collected_at DESC, lot_id LIMIT 30 OFFSET 60""", with_lots=True)
def search_most_recent(spark, sf_dir):
    """The third page of thirty, by the day they were collected."""
    found = search.matching(lots(spark, sf_dir), search.LotFilter(status=("ARREMATADO",)))
    return search.page(search.ordered(found, "recent"), 3, 30).select("lot_id", "collected_at")


@query("""SELECT lot_id FROM lots WHERE status = 'SUSPENSO' AND uf = 'ASIA' AND asset IN ('IMOVEL') AND coalesce(second_min, first_min) >= 4000""", with_lots=True)
def search_by_saved_criteria(spark, sf_dir):
    """criteria as they were saved: scalars, unknown keys and values, numbers as text."""
    saved = {"status": ["SUSPENSO", "NADA"], "uf": "asia", "asset": "IMOVEL", "least_price": "4000", "least_score": "high", "unknown": 1, "words": None}
    return search.matching(lots(spark, sf_dir), search.LotFilter.from_criteria(saved)).select("lot_id")


@query(f"SELECT lot_id FROM lots WHERE collected_at < TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY", with_lots=True)
def obsolete_lots(spark, sf_dir):
    """lots that no run has seen for 45 days."""
    return identity.obsolete(lots(spark, sf_dir).withColumn("last_seen", F.col("collected_at")), AS_OF).select("lot_id")


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id % 2 = 0 AND k.event_id % 20 < 4 AND k.user_id = e.user_id AND k.event_type = e.event_type)")
def unseen_rows(spark, sf_dir):
    """Keys of new rows that the stored ones don't have, each once."""
    rows = read(spark, sf_dir, "events")
    known = rows.filter("event_id % 2 = 0 and event_id % 20 < 4").select("user_id", "event_type")
    return identity.unseen(rows.filter("event_id % 2 = 1"), known, ("user_id", "event_type")).select("user_id", "event_type")
