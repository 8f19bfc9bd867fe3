"""What a run counts, observed while its rows are written: no second pass over them.

Rows (source, counter, n, warning) pass through `DataFrame.observe` on their way to a table or a stream's sink. The
sources of a run are its connectors, a list that is known beforehand; what comes from any other counts as OTHERS.
Counts are sums, so runs, micro-batches and sources can be merged in any order. Of the warnings the most frequent
EXAMPLES are kept, by a sketch of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .cycle import COUNTERS, EXAMPLES

OTHERS = "(others)"
SCHEMA = f"source string, {', '.join(f'{c} bigint' for c in COUNTERS)}, warnings bigint, examples array<string>"


def measures(sources: Sequence[str]) -> list[Column]:
    """The aggregates of all sources, named '<place>:<counter>'."""
    own = F.array_position(F.array(*map(F.lit, sources)), F.col("source")) if sources else F.lit(0)
    place = F.coalesce(own, F.lit(0))  # 0: any other
    made = []
    for i in range(len(sources) + 1):
        here = place == i
        made += [F.coalesce(F.sum(F.when(here & (F.col("counter") == c), F.col("n").cast("bigint"))), F.lit(0)).alias(f"{i}:{c}") for c in COUNTERS]
        made += [F.count(F.when(here, F.col("warning"))).alias(f"{i}:warnings"), F.call_function("approx_top_k", F.when(here, F.col("warning")), F.lit(EXAMPLES)).alias(f"{i}:examples")]
    return made


def rows_of(metrics: Mapping, sources: Sequence[str]) -> list[tuple]:
    """(source, counters, warnings, examples) of each source that anything was counted for."""
    rows = []
    for i, source in enumerate((OTHERS, *sources)):
        counts = [int(metrics[f"{i}:{c}"]) for c in (*COUNTERS, "warnings")]
        found = [r["item"] for r in metrics[f"{i}:examples"] or () if r["item"] is not None]
        if any(counts):
            rows.append((source, *counts, sorted(found)[:EXAMPLES]))
    return rows


def observed(rows: DataFrame, sources: Sequence[str], write: Callable[[DataFrame], None]) -> DataFrame:
    """Write rows with write(rows), once, and tell what passed: (source, counters, warnings, examples).

    Only the finished write tells: where it fails nothing is counted, and a task that runs again counts once.
    """
    watch = Observation()
    write(rows.observe(watch, *measures(sources)))
    return rows.sparkSession.createDataFrame(rows_of(watch.get, sources), SCHEMA)


class StreamMetrics(StreamingQueryListener):
    """The sums of a stream's observed batches. A batch that comes again replaces what it counted before.

    Watch the stream with `watched`, add this to spark.streams, and read `table` when batches have ended.
    """

    def __init__(self, sources: Sequence[str], name: str = "run"):
        self.sources, self.name = list(sources), name
        self.batches: dict[tuple, list[tuple]] = {}

    def watched(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.name, *measures(self.sources))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        if told is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = rows_of(told.asDict(), self.sources)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        from .cycle import merged_statistics

        every = [row for rows in self.batches.values() for row in rows]
        return merged_statistics(spark.createDataFrame(every, SCHEMA))
