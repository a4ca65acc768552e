"""One rule for null ids in all stages that choose: they come last."""

from brindle.llm import ngram_join, substring, suffix_dedup


def test_null_ids_come_last_everywhere(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text, "a"), (1, text, "b"), (2, text, "c")], "doc_id long, text string, lang string").repartition(3)
    assert [r.doc_id for r in ngram_join.keep_representatives(rows).collect()] == [1]
    for whole in (False, True):
        left = {r.doc_id: bool(r.text) for r in substring.dedup_substrings(rows, min_line=1, whole_passages=whole).collect()}
        assert left == {None: False, 1: True, 2: False}
    assert {r.doc_id: len(r.kept) for r in suffix_dedup.dedup_suffixes(rows).collect()} == {None: 0, 1: len(text), 2: 0}
