"""Licence scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

Phrases are matched on words (A-Z as a-z, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+) in one pass of the
automaton.  The expression after an identifier tag, up to the end of its line, is parsed with
WITH above AND above OR; each licence named gives its label, and the expression is evaluated to a
permissiveness: OR takes the better side, AND the worse, WITH that of its licence.  Only identifiers of
known families and references (LicenseRef-x) are licences, and only exceptions follow WITH: prose after a
tag names nothing and ends the expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases and labels of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that this scan adds.
MORE = {
    "bsd license": "bsd", "gnu affero general public license": "agpl", "gnu lesser general public license": "lgpl", "isc license": "isc",
    "mozilla public license": "mpl", "creative commons attribution": "cc-by", "released into the public domain": "public-domain", "all rights reserved": "reserved",
}
TAG = "spdx-license-identifier:"
#: Label of an identifier by its family; identifiers of OTHERS are their own label in lower case.
FAMILIES = {"agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "bsd": "bsd", "0bsd": "bsd", "cc-by": "cc-by", "cc0": "public-domain", "unlicense": "public-domain", "isc": "isc", "mit": "mit", "mpl": "mpl"}
OTHERS = "aal afl apsl artistic blueoak bsl busl cddl cecill cpl ecl efl elastic epl etalab eupl fdl ftl gfdl hpnd ijg intel ipl json lppl ms-pl ms-rl mulanpsl ncsa odbl ofl openssl osl pddl php postgresql psf python qpl ruby sil sspl unicode upl vim w3c wtfpl x11 xfree86 zend zlib zpl".split()
#: A family alone, or with a version or variant behind it; or a reference.
_LICENCE = re.compile(rf"(?:({'|'.join(map(re.escape, [*FAMILIES, *OTHERS]))})(?:[-.]?v?[0-9][0-9a-z.]*|(?:-[0-9a-z.]+)+)?(?:-only|-or-later)?\+?|(?:documentref-[0-9a-z.-]+:)?licenseref-[0-9a-z.-]+)")
_EXCEPTION = re.compile(r"[0-9a-z.-]*exception[0-9a-z.-]*|(?:documentref-[0-9a-z.-]+:)?additionref-[0-9a-z.-]+")
#: How free a user of the text is; unknown labels count as 0.5.
PERMISSIVE = {"mit": 1.0, "bsd": 1.0, "isc": 1.0, "apache": 0.95, "public-domain": 1.0, "cc-by": 0.8, "mpl": 0.6, "lgpl": 0.5, "gpl": 0.3, "agpl": 0.2, "reserved": 0.0}
_PRIORITY = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+_:-]*")
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def label_of(identifier: str) -> str:
    low = identifier.lower()
    found = _LICENCE.fullmatch(low)
    return FAMILIES.get(found[1] or "", low) if found else low


def to_postfix(expression: str) -> list[str]:
    """Shunting yard over the tokens up to the first that cannot follow; a last operator without its right side is dropped, open brackets are closed.  Empty if nothing is left."""
    out, stack, operand, depth = [], [], False, 0
    for t in (m.group() for m in _TOKEN.finditer(expression)):
        low = t.lower()
        if low in _PRIORITY:
            if not operand:
                break
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif t == "(":
            if operand or stack and stack[-1] == "with":
                break
            stack.append(t)
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            after_with = bool(stack) and stack[-1] == "with" and not operand
            if operand or not (_EXCEPTION if after_with else _LICENCE).fullmatch(low):
                break
            out.append(t)
            operand = True
    while stack and not operand:
        operand = stack.pop() != "("
    return out + [t for t in reversed(stack) if t != "("]


def evaluate(expression: str) -> tuple[float, list[str]] | None:
    """(permissiveness, labels) of a licence expression, up to the first token that cannot follow; None if it names no licence."""
    postfix = to_postfix(expression)
    if not postfix:
        return None
    stack: list[tuple[float, bool]] = []
    labels = []
    exception = set()
    for i, t in enumerate(postfix):
        if t == "with":
            exception.add(i - 1)
    for i, t in enumerate(postfix):
        if t == "with":
            stack.pop()
        elif t in ("and", "or"):
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if t == "and" else max(a, b))
        else:
            label = label_of(t)
            if i not in exception:
                labels.append(label)
            stack.append(PERMISSIVE.get(label, 0.5))
    return stack[-1], labels


class Scanner:
    def __init__(self, phrases: dict[str, str]):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for phrase, label in phrases.items():
            self.words.add_word(f" {phrase} ", (len(phrase) + 2, len(phrase.split()), label, phrase in BASE))
        self.words.make_automaton()
        self.tags = ahocorasick.Automaton()
        self.tags.add_word(TAG, len(TAG))
        self.tags.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str, bool]], list[str], list[str], float]:
        """(words, notices as (first word, words, label, base), expressions, their labels, score)."""
        words = text.encode().translate(_NORMAL).split()
        line = f" {b' '.join(words).decode()} "
        found = sorted((end - size + 1, n, label, base) for end, (size, n, label, base) in self.words.iter(line))
        notices, at, seen = [], 0, 0
        for start, n, label, base in found:
            seen += line.count(" ", at, start)
            at = start
            notices.append((seen, n, label, base))
        values = [PERMISSIVE.get(label, 0.5) for _, _, label, _ in notices]
        expressions, named = [], []
        low = text.translate(_ASCII_LOWER)
        for end, _ in self.tags.iter(low):
            stop = low.find("\n", end)
            part = text[end + 1 : stop if stop >= 0 else len(text)]
            if (got := evaluate(part)) is not None:
                expressions.append(part.strip())
                named += got[1]
                values.append(got[0])
        return len(words), notices, expressions, named, min(values, default=0.0)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SCAN_SCHEMA = "doc_id long, n_words long, notices array<struct<first_word: long, n_words: long, label: string, base: boolean>>, expressions array<string>, expression_labels array<string>, score double"


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, notices, expressions, expression_labels, score (how permissive the strictest licence found is; 0: none).

    Null counts as empty; rows with equal doc_id each get a row; an empty table gives none; a malformed
    expression counts up to the first token that cannot follow, its open brackets closed.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(BASE | MORE)
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
        names = ["first_word", "n_words", "label", "base"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [scanner.scan(t or "") for t in part.column(1).to_pylist()]
                yield pa.record_batch(
                    [
                        part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([[dict(zip(names, x)) for x in r[1]] for r in rows], kind),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.list_(pa.string())), pa.array([r[4] for r in rows], pa.float64()),
                    ],
                    names=["doc_id", "n_words", "notices", "expressions", "expression_labels", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, SCAN_SCHEMA)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the contract's columns for every document."""
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("notices", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first_word"])
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(F.transform(base, lambda x: x["label"])).alias("base_labels"),
        names(F.concat(F.transform("notices", lambda x: x["label"]), "expression_labels")).alias("labels"), "score",
    )
