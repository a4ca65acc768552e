import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from brindle.functions import encoder as E
from brindle.llm.output import large_blocks

ALPHABET = [*"abcXYZ", *"01'._-,;(", " ", " ", " ", "\n", "\t", "é", "ä", "ß", "ÿ", "×", "÷", "ª", "İ", "Σ", "é", "ф", "́", "　", "中", "😀", "<|endoftext|>", "\x01", "\x7f", "'s", "'re", "\x85"]


def texts(seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["", " ", "a\n", "\na b", "x" * 80 + ", y", *("".join(draw.choices(ALPHABET, k=draw.randrange(1, 25))) for _ in range(600))]


def test_ids_from_the_table_are_the_library_s(monkeypatch):
    """op10: chunks end at signs, a table keeps their ids and turns over; odd texts, slices, nulls and empty blocks."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        lib = Tokenizer.from_file(path)
        for size, cut, chunks in ((100, 37, 5), (8_000, 1 << 19, 1 << 21), (1 << 20, 64, 50)):
            monkeypatch.setattr(E, "CUT_BYTES", cut)
            monkeypatch.setattr(E, "LARGE_CHUNKS", chunks)
            enc = E.Encoder(path, size)
            for seed in (1, 2, 1):
                column = pa.array([None, *texts(seed), None])
                for part in (column.slice(0, 1), column, column.slice(7, 100), column.slice(3, 0)):
                    values, offs = enc.encode(part, large=True)
                    want = [lib.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
                    assert [values[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want
                    assert values.dtype == np.uint32
                    table = enc.table
                    assert len(table.keys) == len(table.ids) == len(table.age) and table.keys.nbytes + table.ids.nbytes <= size


def test_a_chunk_met_again_in_a_later_block_is_encoded_once(monkeypatch):
    """op10: of a word with and without a sign, in two blocks, the library's model sees the word and the signs once."""
    enc = E.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1 << 20)
    seen, own = [], enc._new_ids
    monkeypatch.setattr(enc, "_new_ids", lambda chunks: seen.extend(chunks.to_pylist()) or own(chunks))
    monkeypatch.setattr(enc, "pattern", None)
    for text in ("a word, café. word", "a café, word. café ("):
        enc.encode(pa.array([text]), large=True)
    assert sorted(seen) == sorted(["a", " word", ",", " café", ".", " ("])


def test_the_chunks_met_last_stay():
    table = E.Table()
    for block in ([0, 1, 2], [1, 3], [1, 4]):
        new = [i for i in block if f"word{i}" not in table.keys.to_pylist()]
        keys = pa.concat_arrays([table.keys, pa.array([f"word{i}" for i in new], pa.large_string())])
        table.add(keys, pa.array([bytes(4 * i) for i in new], pa.large_binary()), np.array([keys.to_pylist().index(f"word{i}") for i in block]))
    table.shrink(120)
    assert table.keys.to_pylist() == ["word1", "word4"] and [len(x) for x in table.ids.to_pylist()] == [4, 16]


def test_blocks_take_rows_of_many_batches_in_order():
    rows = [(i, None if i % 7 == 0 else "x" * (i % 40)) for i in range(300)] + [(300, "y" * 500), (301, "z")]
    batches = [pa.record_batch([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], names=["doc_id", "text"]) for part in (rows[:10], [], rows[10:11], rows[11:])]
    blocks = list(large_blocks(iter(batches), 200))
    assert [(i, t) for a, b in blocks for i, t in zip(a.to_pylist(), b.to_pylist())] == rows
    assert all(len(b) == 1 or sum(len(t or "") for t in b.to_pylist()) <= 200 for _, b in blocks) and len(blocks) < 60
