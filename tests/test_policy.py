"""Fetch schedules against a loop over each host's requests; retention on folders."""

import datetime as dt
import random

from pyspark.sql import functions as F

from martelo.sources import files, policy

START = dt.datetime(2026, 5, 1)


def looped(rows, delay):
    """Each request starts when it is asked for, or its host's delay after the one before."""
    out, last = {}, {}
    for host, address, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        at = max(at, last[host] + dt.timedelta(seconds=delay.get(host, 1.5))) if host in last else at
        out.setdefault((host, address), []).append(at)
        last[host] = at
    return out


def test_schedule(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abbbbbc"), f"/{i % 120}", START + dt.timedelta(seconds=rnd.choice((0, 1, rnd.randrange(40_000))))) for i in range(300)]
    hosts = spark.createDataFrame([("a", 600.0), ("b", 120.25), ("b", 5.0), ("d", None)], "host string, crawl_delay double")
    queue = spark.createDataFrame([*rows, (None, "/x", START), ("a", None, START), ("a", "/y", None)], "host string, address string, requested_at timestamp_ntz")
    found = policy.schedule(queue, hosts).collect()
    made = {}
    for r in found:
        made.setdefault((r.host, r.address), []).append(r.starts_at)
    wanted = looped(rows, {"a": 600, "b": 120.25})
    assert {k: sorted(v) for k, v in made.items() if None not in v} == {k: sorted(v) for k, v in wanted.items()}
    assert sum(r.starts_at is None for r in found) == 3 and len(found) == len(rows) + 3
    assert sorted(map(tuple, policy.schedule(queue, hosts, block="DAY").collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_a_low_crawl_delay_does_not_lower_it(spark):
    hosts = spark.createDataFrame([("a", 0.2), ("b", None), ("c", 7.0)], "host string, crawl_delay double")
    assert {r.host: r.delay_ms for r in policy.delays(hosts).collect()} == {"a": 1500, "b": 1500, "c": 7000}


def test_old_days_are_gone(spark, tmp_path):
    path = f"file://{tmp_path}/raw"
    raw = spark.createDataFrame([("djen", f"2026-0{m}-15", f"http://x/{m}", "body") for m in (1, 4, 5)] + [("other", "2026-04-01", "http://y", None)], "source string, day string, url string, body string")
    files.archive(raw, path)
    (tmp_path / "raw/source=djen/day=unknown").mkdir()
    assert policy.drop_expired(spark, path, "2026-05-10", 30) == ["source=djen/day=2026-01-15", "source=other/day=2026-04-01"]
    assert not (tmp_path / "raw/source=djen/day=2026-01-15").exists() and (tmp_path / "raw/source=djen/day=unknown").exists()
    left = spark.read.schema("url string, body string, digest string, source string, day string").parquet(path).filter(F.col("url").isNotNull())
    assert sorted(r.url for r in left.collect()) == ["http://x/4", "http://x/5"]
    assert policy.drop_expired(spark, path, "2026-05-10", 30) == [] and policy.drop_expired(spark, f"{path}/none", "2026-05-10") == []
