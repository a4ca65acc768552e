from brindle.operators import scoring
from brindle.sources.scratch import BATCH_ROWS


def test_counts_are_made_in_small_batches(spark, monkeypatch):
    """a worker holds at most BATCH_ROWS whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows, own, seen = spark.createDataFrame([("a b a b",), (None,)], "text string"), spark.conf.get(key), []
    to_arrow = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: seen.append(int(spark.conf.get(key))) or to_arrow(self))
    scorer = scoring.fit_bigrams(rows, features=64)
    assert seen == [BATCH_ROWS] and spark.conf.get(key) == own
    assert [t.sum() for t in scorer.shared.value] == [4, 3]
