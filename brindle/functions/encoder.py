"""Fast exact token ids from a public tokenizer file, inside Python workers.

The `tokenizers` library spends most of its time on bookkeeping for whole texts.
Where the file's own splitting rules make a cut provably harmless, a text is cut
into chunks, each distinct chunk is encoded once by the library, and a text's ids
are the joined ids of its chunks.  Anything the rule does not cover is encoded
whole by the library, so the ids are always those of `encode(text)`.
"""

from __future__ import annotations

import array
import contextlib
import gc
import json
import operator
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of distinct chunks and their ids that a worker remembers (half of them those since it was last full, half those before), and the
#: longest chunk among them.  Both bear on speed only.
CACHE_BYTES, CACHE_CHUNK = 40 << 20, 64
#: Bytes that an entry takes besides its characters and ids.
_ENTRY = 170
#: White space in which a cut is left to the library, as Arrow's patterns: runs, and anything but a lone space or line feed.
_RUNS = r"[ \n]{2}|\x01"
_OTHER_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: Chunks that are looked up at once; bears on memory only.
AT_ONCE = 1 << 20
#: Chunks that are split here: European letters whose lower case does not depend on their neighbours. Others are encoded by the library alone.
_FITS = re.compile(r" ?[\x21-\x7e\xa1-\u03a2\u03a4-\u058f]+").fullmatch
#: ASCII signs: neither letters, digits nor white space.
_SIGNS = frozenset(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
#: The same as bytes, and the bytes that end a letter by themselves or, within U+00C0 to U+00FF, behind 0xC3.
_SIGN_OR_DIGIT = np.isin(np.arange(256), [c for c in range(0x21, 0x7F) if not chr(c).isalpha()])
_LETTER = np.isin(np.arange(256), [c for c in range(0x7F) if chr(c).isalpha()])
_LATIN_END = np.isin(np.arange(256), [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)])
#: In large blocks, bytes cut at once, chunks looked up at once (a block's, but for one long text) and pieces that the library's model meets at once; all bear on memory only.
CUT_BYTES, LARGE_CHUNKS, MODEL_PIECES = 1 << 19, 1 << 21, 20_000
_ID = operator.attrgetter("id")
_LOADED: dict[str, "Encoder"] = {}


def _re2(literal: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in literal)


class Encoder:
    """ids(texts) gives each text's ids, those of the library's encode(text), as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_bytes: int | None = None):
        self.cache_bytes = cache_bytes or CACHE_BYTES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rule, pattern = _rule(spec)
        self.pattern = regex.compile(pattern)
        special = tuple(t["content"] for t in spec.get("added_tokens") or [])
        whole = [*map(_re2, special), *([_RUNS, _OTHER_SPACE] if self.rule == "space_leads" else [])]
        self.whole = "|".join(whole)
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, bytes] = {"": b""}  # chunks and pieces: a piece that is a chunk has the same ids
        self.before: dict[str, bytes] = {}
        self.held = 0
        self.table = Table()

    def _remember(self, chunk: str, ids: bytes) -> None:
        if chunk not in self.cache:
            self.held += _ENTRY + len(chunk) + len(ids)
        self.cache[chunk] = ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: Iterable[str]) -> None:
        """Split many chunks at once by the file's pattern and run the library's model once for each distinct piece; ASCII letters with a sign or none need no pattern."""
        known, leads, plain, rest = self.cache, self.rule == "space_leads", [], []
        model, lower, size = self.tok.model.tokenize, self.rule == "space_ends", len(self.cache)
        chars = 0

        def piece_ids(piece: str) -> bytes:
            """The library's model alone, on one piece."""
            nonlocal chars
            if (got := known.get(piece)) is None:
                got = array.array("I", map(_ID, model(piece.replace(" ", _SPACE_CHAR) if piece.isascii() else _bytes_as_chars(piece)))).tobytes()
                if len(piece) <= CACHE_CHUNK:
                    known[piece] = got
                    chars += len(piece) + len(got)
            return got

        for c in chunks:
            if c.isascii():
                word = c.lower() if lower else c
                letters = word[1:] if leads and word[0] == " " else word
                if letters.isalpha():
                    known[c] = got = piece_ids(word)
                elif letters[:-1].isalpha() and letters[-1] in _SIGNS:
                    known[c] = got = piece_ids(word[:-1]) + piece_ids(word[-1])
                else:
                    (plain if _FITS(c) else rest).append(c)
                    continue
                chars += len(c) + len(got)
            elif not _FITS(c):
                rest.append(c)
            elif leads and (c[1:] if c[0] == " " else c).isalpha():
                known[c] = piece_ids(c)
            else:
                plain.append(c)
        joined = "\n".join([*plain, ""])
        if lower:
            joined = unicodedata.normalize("NFC", joined).lower()
        at, ids = iter(plain), []
        for piece in self.pattern.findall(joined) if plain else ():
            if piece == "\n":
                known[c := next(at)] = got = b"".join(ids)
                chars += len(c) + len(got)
                ids = []
            else:
                ids.append(piece_ids(piece))
        for c, got in zip(rest, self._encode(rest)):
            known[c] = got
            chars += len(c) + len(got)
        self.held += _ENTRY * (len(known) - size) + chars

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        if self.held > self.cache_bytes // 2:
            before = self.cache
            self.clear()
            self.before = before
        out = list(map(self.cache.get, chunks))
        if None in out:
            new, before = {c for c, x in zip(chunks, out) if x is None}, self.before
            for c in new.intersection(before):
                self._remember(c, before[c])
                new.remove(c)
            self._encode_chunks(new)
            out = list(map(self.cache.__getitem__, chunks))
            for c in new:
                if len(c) > CACHE_CHUNK:
                    self.held -= _ENTRY + len(c) + len(self.cache.pop(c))
        return out

    def _new_ids(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks, as bytes: what is one piece goes to the library's model at once."""
        if self.rule != "space_leads":
            return pa.array(self._look_up(pc.ascii_ltrim(chunks, " ").to_pylist()), pa.large_binary())
        model, words, at, rest, rest_at = self.tok.model.tokenize, [], [], [], []
        for i, c in enumerate(chunks.to_numpy(zero_copy_only=False).tolist()):
            word = c[1:] if c[0] == " " else c
            if c.isascii():
                if word.isalpha() or word.isdigit() or word in _SIGNS:
                    words.append(c.replace(" ", _SPACE_CHAR))
                    at.append(i)
                    continue
            elif word.isalpha() and _FITS(c):
                words.append(_bytes_as_chars(c))
                at.append(i)
                continue
            rest.append(c)
            rest_at.append(i)
        parts = []
        for lo in range(0, len(words), MODEL_PIECES):
            tokens = list(map(model, words[lo : lo + MODEL_PIECES]))
            parts.append(_as_bytes(np.fromiter(map(_ID, chain.from_iterable(tokens)), np.uint32), _ends(np.fromiter(map(len, tokens), np.int64, len(tokens)))))
        parts.append(pa.array(self._look_up(rest), pa.large_binary()))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.array(at + rest_at, np.int64))))

    def _cut_large(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """_cut() with the table; besides, a letter ends its chunk where an ASCII sign or digit follows, as it ends its piece."""
        offs = _offsets(texts)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        if not len(raw):
            return np.zeros(0, np.uint32), offs
        if self.rule != "space_leads":
            raw = np.where(raw == 0x0A, np.uint8(0x20), raw)
        parts = []
        for lo in range(0, len(raw), CUT_BYTES):
            back = min(lo, 2)  # bytes before this part that bear on it
            own = raw[lo - back : lo + CUT_BYTES]
            first = (own == 0x20) | (own == 0x0A)
            if self.rule == "space_leads":
                first[1:] |= own[:-1] == 0x0A
                letter = _LETTER[own]
                letter[1:] |= _LATIN_END[own[1:]] & (own[:-1] == 0xC3)
                first[1:] |= _SIGN_OR_DIGIT[own[1:]] & letter[:-1]
            a, b = np.searchsorted(offs, [lo, min(lo + CUT_BYTES, len(raw))])
            first[offs[a:b] - lo + back] = True
            parts.append(np.flatnonzero(first[back:]) + lo)
        at = np.concatenate([*parts, [len(raw)]])
        place, begins = np.searchsorted(at, offs), np.zeros(len(offs), np.int64)
        table, data, parts, total = self.table, pa.py_buffer(raw), [], 0
        for lo in range(0, len(at) - 1, LARGE_CHUNKS):
            own = at[lo : lo + LARGE_CHUNKS + 1]
            coded = pa.chunked_array([table.keys, pa.LargeStringArray.from_buffers(len(own) - 1, pa.py_buffer(own), data)]).dictionary_encode()
            coded = coded.chunk(coded.num_chunks - 1)  # the table's chunks come first in the dictionary, in its order
            new = coded.dictionary[len(table.keys) :]
            table.add(coded.dictionary, self._new_ids(new) if len(new) else table.ids[:0], coded.indices.to_numpy())
            values, ends = _values(table.ids.take(coded.indices))
            table.shrink(self.cache_bytes)
            a, b = np.searchsorted(place, [lo, lo + len(own) - 1])
            begins[a:b] = total + ends[place[a:b] - lo]
            total += len(values)
            parts.append(values)
        begins[place == len(at) - 1] = total
        return parts[0] if len(parts) == 1 else np.concatenate(parts), begins

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts that may be cut: their chunks stay in Arrow's memory and only the distinct ones become Python's."""
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        feed = raw == 0x0A
        first = feed | (raw == 0x20)  # a lone space opens the piece that follows it, or white space only separates
        if self.rule == "space_leads":
            first[1:] |= feed[:-1]
        else:
            raw = np.where(feed, np.uint8(0x20), raw)
        first[offs[:-1][np.diff(offs) > 0]] = True
        at = np.append(np.flatnonzero(first), len(raw))
        data, parts, sizes = pa.py_buffer(raw), [], [np.zeros(1, np.int64)]
        for lo in range(0, len(at) - 1, AT_ONCE):
            own = at[lo : lo + AT_ONCE + 1]
            coded = pa.LargeStringArray.from_buffers(len(own) - 1, pa.py_buffer(own), data).dictionary_encode()
            distinct = coded.dictionary if self.rule == "space_leads" else pc.ascii_ltrim(coded.dictionary, " ")
            known, index = self._look_up(distinct.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
            n = np.fromiter(map(len, known), np.int64, len(known)) >> 2
            each = n[index]
            place = np.repeat((np.cumsum(n) - n)[index] - (np.cumsum(each) - each), each)
            place += np.arange(len(place))
            parts.append(np.frombuffer(b"".join(known), np.uint32)[place])
            sizes.append(each)
        ends = np.cumsum(np.concatenate(sizes))
        return np.concatenate([np.zeros(0, np.uint32), *parts]), ends[np.searchsorted(at[:-1], offs)]

    def encode(self, texts: pa.Array, large: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one text after the other, and the place where each begins (and the end of the last).

        large: for blocks of many megabytes.  What is remembered is a table in Arrow's memory, small and without
        Python objects, that each block hashes again; ids are the same.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        cut = self._cut_large if large else self._cut
        if not self.rule:
            whole = np.ones(len(texts), bool)
        else:  # strings of special tokens get their own ids
            whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.whole else np.zeros(len(texts), bool)
        if not whole.any():
            return cut(texts)
        values, offs = cut(texts.filter(pa.array(~whole))) if not whole.all() else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        parts, k = [], 0
        for i, alone in enumerate(whole.tolist()):
            if alone:
                parts.append(np.frombuffer(self._encode([texts[i].as_py()])[0], np.uint32))
            else:
                parts.append(values[offs[k] : offs[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def ids(self, texts: list[str]) -> list[bytes]:
        values, offs = self.encode(pa.array(texts, pa.large_string()))
        return [values[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


class Table:
    """Distinct chunks, their ids (as bytes) and how many blocks ago each was met."""

    def __init__(self) -> None:
        self.keys, self.ids, self.age = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.uint8)

    def add(self, keys: pa.Array, new: pa.Array, met: np.ndarray) -> None:
        """keys: the table's and behind them those of `new`, whose ids these are; met: the keys of this block."""
        age = np.zeros(len(keys), np.uint8)
        age[: len(self.age)] = np.minimum(self.age, 254) + 1
        age[met] = 0
        self.keys, self.ids, self.age = keys, pa.concat_arrays([self.ids, new]), age

    def shrink(self, limit: int) -> None:
        """Beyond `limit` bytes, only the chunks met last stay, in three quarters of it; those of one block too many, none."""
        if self.keys.nbytes + self.ids.nbytes + self.age.nbytes <= limit:
            return
        sizes = np.diff(_offsets(self.keys)) + np.diff(_offsets(self.ids)) + 17
        fits = np.cumsum(np.bincount(self.age, sizes)) <= limit * 3 // 4
        kept = pa.array(np.flatnonzero(fits[self.age]))
        self.keys, self.ids, self.age = self.keys.take(kept), self.ids.take(kept), self.age[kept]


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _as_bytes(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows and the place where each begins (and the end of the last)."""
    ends = _offsets(column)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw.view(np.uint32), (ends - ends[0]) >> 2


def _visible_bytes() -> list[str]:
    """The public byte-level convention: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    out |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)}
    return [out[b] for b in range(256)]


_CHARS = str.maketrans({chr(b): c for b, c in enumerate(_visible_bytes())})
#: Of printable ASCII, the space alone changes.
_SPACE_CHAR = _CHARS[ord(" ")]


def _bytes_as_chars(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_CHARS)


def _rule(spec: dict) -> tuple[str | None, str]:
    """Which cut is harmless and the pattern of pieces, from the file's own normalizer and pre-tokenizer."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE":
        return None, ""
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "space_leads", r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    kinds = [n.get("type") for n in norm.get("normalizers", [])]
    first, *more = pre.get("pretokenizers") or [{}]
    squeezes = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in norm.get("normalizers", []))
    cuts = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and set(first.get("pattern") or {}) == {"Regex"}
    bytes_only = [m.get("type") for m in more] == ["ByteLevel"] and not more[0].get("use_regex") and not more[0].get("add_prefix_space")
    if kinds == ["NFC", "Replace", "Lowercase"] and squeezes and cuts and bytes_only and "^\\s" in first["pattern"]["Regex"]:
        return "space_ends", first["pattern"]["Regex"] + r"|\n"
    return None, ""


def encoder(path: str, cache_bytes: int | None = None) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    _LOADED[path].cache_bytes = cache_bytes or CACHE_BYTES
    return _LOADED[path]


@contextlib.contextmanager
def without_gc() -> Iterator[None]:
    """No cycle collection while many small objects are made."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def give_back() -> None:
    """Memory that was freed goes back to the system: workers are used again, and it stays theirs otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def forget() -> None:
    """Give memory back before a task of another kind, with what this worker remembers."""
    if _LOADED:
        _LOADED.clear()
        gc.collect()
    give_back()
