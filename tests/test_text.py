"""Texts decomposed in full, in slices of bounded size."""

from pyspark.sql import functions as F

from martelo.functions import text


def test_decomposed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(text, "SLICE_LETTERS", 40)
    texts = [None, "", "plain", "ação", "ﬁm", "é" * 30, "½ ½", *("x" * n + "ﬃ́" for n in range(40)), "\U0001d400 한글", "ª"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    for row in df.select("n", "t", text.decomposed_column(F.col("t")).alias("d")).collect():
        if row.t is None:
            assert row.d.plain is None
            continue
        assert row.d.plain == text.decomposed(row.t)
        if row.d.starts is not None:
            assert row.d.starts == [i for i, c in enumerate(row.t) for _ in text.decomposed(c)]
            assert len(row.d.starts) == len(row.d.plain)
