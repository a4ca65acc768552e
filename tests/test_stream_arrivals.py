from brindle.sources.scratch import new_path
from brindle.streaming import shield


def test_arrivals_are_written_by_all_tasks_and_are_one_micro_batch_each(spark):
    """one task wrote each arrival before."""
    rows = spark.createDataFrame([(i, f"a b c d e f{i % 9}") for i in range(40)] + [(None, "x")], "doc_id long, text string").repartition(3)
    source, state = new_path(spark, "in"), new_path(spark, "state")
    last, files = -1, []
    out, check = new_path(spark, "out"), new_path(spark, "check")
    for n, _ in enumerate(shield.arrivals(rows, source, "doc_id", 2)):
        got = spark.read.parquet(source)
        files.append(len(got.inputFiles()))
        ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
        assert ids == list(range(len(ids))) and ids[-1] > last
        last = ids[-1]
        shield.dedup_stream(shield.file_stream(spark, source), out, state, check)
        assert spark.read.parquet(out).select("batch").distinct().count() == n + 1
    assert files[0] > 1 and last == 39 and got.count() == 41
    assert {r.doc_id for r in spark.read.parquet(out).filter("kept").collect()} >= set(range(9))
