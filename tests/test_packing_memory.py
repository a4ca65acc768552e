from types import SimpleNamespace

from brindle.llm import output, packing


def test_the_query_remembers_as_many_chunks_as_op10(monkeypatch):
    """op2: with the pipeline's small cache its workers encode the same chunks again and again."""
    seen = {}
    monkeypatch.setattr(packing, "pack", lambda docs, path, **options: seen.update(options))
    packing.op2_packing(SimpleNamespace(read=SimpleNamespace(parquet=lambda path: path)), "x")
    assert seen == {"cache_bytes": output.CACHE_BYTES, "text_block": output.TEXT_BLOCK}
