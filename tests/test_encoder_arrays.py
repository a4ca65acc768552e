import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from brindle.functions import encoder as E
from brindle.llm.output import with_end

ALPHABET = [*"abcXYZ", *"01'._-,;", " ", " ", " ", "\n", "\t", "é", "İ", "Σ", "ß", "é", "́", " ", "　", "中", "😀", "<|endoftext|>", "\x01", "'s", "\x85"]


def texts() -> list[str]:
    draw = random.Random(5)
    return ["", " ", "a\n", "\na b", "x" * 80 + ", y", *("".join(draw.choices(ALPHABET, k=draw.randrange(1, 25))) for _ in range(600))]


def test_columns_are_encoded_as_arrays_with_the_library_s_ids(monkeypatch):
    """op10, op2: chunks stay in Arrow's memory; slices, nulls and texts that only the library may encode keep their places."""
    column = pa.array([None, *texts(), None])
    for at_once in (3, 1 << 20):
        monkeypatch.setattr(E, "AT_ONCE", at_once)
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            path = public_tokenizers.path(name)
            lib, enc = Tokenizer.from_file(path), E.Encoder(path, 20_000)
            for part in (column, column.slice(7, 100), column.slice(0, 1), column.slice(3, 0)):
                values, offs = enc.encode(part)
                want = [lib.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
                assert [values[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want
                values, offs = with_end(values, offs, 2)
                assert [values[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [[*x, 2] for x in want]
                assert values.dtype == np.uint32


def test_a_word_with_a_sign_meets_no_pattern():
    enc = E.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.pattern = None
    assert len(enc.ids(["one two, three. (four"[:15]])[0])
