"""Token counts by a tokenizer file, in Arrow batches; a worker loads a file once."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.encoder import encoder
from brindle.functions.text import chat_ml, col, task_messages

_LOADED: dict[str, Any] = {}
#: Texts encoded at once.
_AT_ONCE = 64


def tokenizer(path: str) -> Any:
    """The tokenizer of a file of the `tokenizers` library, without truncation or padding; one is kept for each worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED.clear()
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _LOADED[path] = found
    return _LOADED[path]


def token_count(text: Column | str, path: str, *, add_special_tokens: bool = False) -> Column:
    """How many tokens the tokenizer file at `path` (readable on every executor) makes of the text; null counts 0."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        out: list[int] = []
        for lo in range(0, len(texts), _AT_ONCE):
            part = [t or "" for t in texts.slice(lo, _AT_ONCE).to_pylist()]
            if add_special_tokens:
                out += [len(x.ids) for x in tokenizer(path).encode_batch(part, add_special_tokens=True)]
            else:  # each distinct chunk is encoded once; an id takes four bytes
                out += [len(ids) // 4 for ids in encoder(path).ids(part)]
        return pa.array(out, pa.int64())

    return count(col(text).cast("string"))


def token_gate(df: DataFrame, path: str, low: int = 24, high: int = 2048, *, text_col: str = "text") -> DataFrame:
    """df with n_tokens, of the rows whose token count lies in [low, high]."""
    return df.withColumn("n_tokens", token_count(text_col, path)).filter(F.col("n_tokens").between(low, high))


def train_pack(rows: DataFrame, path: str, max_tokens: int) -> DataFrame:
    """QA rows(task, question, context, options, answer) with their rendered chat (text) and n_tokens; rows with a missing turn and longer ones go."""
    turns = rows.withColumn("__turns", task_messages("task", "question", "context", "options", "answer"))
    whole = turns.filter(F.forall("__turns", lambda m: m["content"].isNotNull()))
    return whole.withColumn("text", chat_ml("__turns")).drop("__turns").withColumn("n_tokens", token_count("text", path)).filter(F.col("n_tokens") <= max_tokens)
