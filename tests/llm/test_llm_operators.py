"""The ten operators on small tables: brute force, round trips, and odd rows (nulls, empty, repeated, clashing columns, no rows)."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import substring_dedup, ws_words
from pyspark.sql import functions as F

from brindle.llm import chat, decontam, html_text, language, licences, media, ngram_join, output, packing, substring, tokens, words
from brindle.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id string, start long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["ab", "Cé", "dog", "the", "of", "lui", "zz", "x1"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed")
    shared = prose(2, 60)
    out = [
        (1, base), (2, base), (3, near), (4, prose(3, 90) + " " + shared + " " + prose(4, 70)), (5, prose(5, 80) + " " + shared + "\n" + prose(6, 40)), (6, None), (7, ""), (8, " \n\t "), (9, "one two"), (9, "one two"),
        (None, "no id here at all"), (10, "12 345 6"), (11, prose(7, 30) + "\n" + prose(8, 30) + "\n" + prose(7, 30)), (12, "de " * 300), (13, prose(9, 9000)), (15, prose(60, 9) + "\n\n" + prose(61, 14) + "\n" + prose(62, 15) + "\n \n" + prose(63, 7)), (16, prose(61, 14) + "\n" + prose(62, 15) + "\n\n" + prose(64, 8)), (14, "MIT License. SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0"),
    ]
    return [(i, t, "en" if i and i % 2 else "fr", "s", 1, 5, "x", 0) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words_match_python():
    texts = ["Ab cD\n\té!x", None, "", "  ", "a" * 50, prose(3, 400)]
    raw, offs = words.utf8(pa.array(texts))
    starts, ends, first = words.spans(raw, offs, words.NONSPACE)
    got = [[raw[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [[(t or "").encode()[s:e] for s, e, _ in ws_words(t)] for t in texts]
    digests = words.word_digests(raw, starts, ends)
    by_word = {}
    for s, e, d in zip(starts, ends, digests.tolist()):
        assert by_word.setdefault(raw[s:e].tobytes().lower(), d) == d
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_ids_are_the_librarys(name):
    enc = tokens.Encoder(P.path(name))
    texts = ["", " ", "a  b", "a \n b", "\n\nfoo", " foo bar ", "<|endoftext|> x<|endoftext|>", "it's  'll", "\tfoo\xa0bar 　x", "a\x01b c", "É É é ́x", "İSTANBUL ΣΑΣ Σ", "foo. bar, ) baz\nqux", "日本 語 текст", "a፩b ፩ c", prose(1, 300), "x" * 5000]
    assert enc.ids(texts) == [np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    tokens._LOADED[("t", True)] = enc
    tokens.forget()
    assert enc.ids(["foo bar"]) == enc.ids(["foo bar"])


def test_decontamination(spark, docs, rows, none, monkeypatch):
    item = " ".join(rows[3][1].split()[5:40])
    bench = spark.createDataFrame([(1, item), (2, "ONE two"), (3, None), (4, ""), (2, "one two"), (None, "dog1 dog2")], "item_id long, text string")
    wins = []
    for i, t in [(str(r[0]) if r[0] is not None else "", r[1]) for r in bench.collect()]:
        w = word_list(t)
        wins += [(i, w[a : a + 10]) for a in range(max(1, len(w) - 9))] if w else []
    expected = []
    for r in rows:
        w, hit, items = word_list(r[1]), set(), set()
        for i, g in wins:
            for a in range(len(w) - len(g) + 1):
                if w[a : a + len(g)] == g:
                    hit.update(range(a, a + len(g)))
                    items.add(i)
        expected.append((r[0], len(w), sorted(hit), sorted(items)))
    key = lambda x: repr(x)
    got = [(r.doc_id, r.n_words, r.hit, r["items"]) for r in decontam.decontaminate(docs, bench).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    monkeypatch.setattr(decontam, "TEST_BLOCK", 1)  # one item a block
    got = [(r.doc_id, r.n_words, r.hit, r["items"]) for r in decontam.decontaminate(docs, bench).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert decontam.decontaminate(none, bench).count() == 0


def test_proximity(spark):
    text = prose(1, 40)
    w = text.split()
    docs = spark.createDataFrame([(1, " ".join([*w[:5], "new", *w[5:]])), (2, text), (3, prose(5, 40))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(w[:10]))], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near) for r in decontam.decontaminate(docs, bench, slop=2).collect()}
    assert got == {1: ([], ["7"]), 2: (["7"], []), 3: ([], [])}
    # an item's words split over two documents are no match, however large the tolerance
    docs = spark.createDataFrame([(1, " ".join(w[:4])), (2, " ".join(w[4:10])), (3, " ".join(reversed(w[:10])))], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r["items"], r.near) for r in decontam.decontaminate(docs, bench, slop=200).collect()}
    assert got == {1: ([], []), 2: ([], []), 3: ([], ["7"])}


def test_packing(docs, rows, none):
    path, got = P.path("word_bpe_49k.json"), None
    got = packing.pack(docs, path, capacity=256, grain=8, with_ids=True).collect()
    enc = tokens.Encoder(path)
    want = sorted((repr(r[0]), enc.ids([r[1] or ""])[0] + np.array([2], "<u4").tobytes()) for r in rows)
    by_doc = {}
    for p in got:
        by_doc.setdefault((repr(p.doc_id), p.doc_tokens), []).append((p.start, bytes(p.ids)))
        assert len(p.ids) == 4 * p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
    assert sum(p.length for p in got) == sum(len(x) // 4 for _, x in want)
    for name, ids in want:
        mine = by_doc[(name, len(ids) // 4)]
        assert b"".join(x for _, x in sorted(set(mine))) == ids
    for s in {p.sequence_id for p in got}:
        at = 0
        for p in sorted((p for p in got if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    assert packing.pack(none, path).count() == 0


def test_column_generation_is_near_the_bound():
    demand = np.bincount(np.minimum(63, np.random.default_rng(1).geometric(0.06, 4000)) - 1, minlength=64)
    plan, dealt, n = packing.deal(demand, 64)
    left = [c + 1 for c in range(64) for _ in range(int(demand[c] - dealt[c]))]
    total = n + max((b for b, _ in packing.best_fit(left, 64)), default=-1) + 1
    assert (dealt <= demand).all() and total <= 1.02 * (demand * np.arange(1, 65)).sum() / 64 + 2


def test_licences(docs, none):
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    r = got[14]
    assert [x.label for x in r.notices] == ["mit"] and r.expression_labels == ["mit", "apache", "gpl"] and r.score == pytest.approx(0.3)
    assert got[6].n_words == 0 and got[6].notices == [] and licences.scan_licences(none).count() == 0
    assert licences.evaluate("MIT AND") == (1.0, ["mit"]) and licences.evaluate(") OR") is None and licences.evaluate("GPL-3.0 OR (MIT AND BSD-3-Clause) trailing words")[0] == 1.0


@pytest.mark.parametrize("phrase", sorted(licences.BASE))
def test_licence_places(phrase):
    scanner = licences.Scanner(licences.BASE)
    text = f"x {phrase.upper()} {phrase} y-{phrase.replace(' ', '--')}.z"
    w, p = word_list(text), phrase.split()
    assert [n[0] for n in scanner.scan(text)[1]] == [i for i in range(len(w)) if w[i : i + len(p)] == p]


def test_language(spark, docs, none):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "er", "th"], "bb": ["sch", "ung", "ei", "ä"], "cc": ["ción", "ado", "que", "ñ"]}
    data = [(i, " ".join("".join(rng.choices(parts[k], k=2)) for _ in range(40)), k) for i, k in enumerate(rng.choices(sorted(parts), k=240))]
    data += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "the ing", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    held = [i for i, _, k in data if k and i < 1000 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == data[i][2] for i in held) >= 0.98 * len(held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(none, language.fit(none)).count() == 0 and {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}


def test_codewords_differ():
    for n in range(2, 20):
        c = language.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(c) for b in c[i + 1 :]) >= max(1, c.shape[1] // 3)


def components(rows, k=5):
    sets = []
    for r in rows:
        w = [x[2] for x in ws_words(r[1])]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((repr(r[0]), len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def test_ngram_join(spark, docs, rows, none):
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == components(rows)
    assert ngram_join.jaccard_components(none).count() == 0


def test_ngram_join_of_a_large_near_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MANY", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT_IN_BLOCK", 8)
    rng, base = random.Random(5), prose(11, 100).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(100 + i, 30) + " " + " ".join(base[:40])) for i in range(20)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == components(rows)


def test_substring_dedup(docs, rows, none):
    def digest(w, run):
        raw, offs = words.utf8(pa.array([b" ".join(w).decode()]))
        s, e, _ = words.spans(raw, offs, words.NONSPACE)
        return words.runs(words.word_digests(raw, s, e), run).tolist()

    keys = {(r.doc_id, r.text): r.tk for r in docs.select("doc_id", "text", substring.text_key("text").alias("tk")).collect()}
    expected = substring_dedup([(r[0], r[1], keys[r[0], r[1]]) for r in rows], 25, 25, digest)
    got = substring.dedup_substrings(docs, carry=("lang",)).collect()
    mine = sorted((repr(r.doc_id), r.n_words, r.n_removed, [x[2] for x in ws_words(r.text)]) for r in got)
    assert mine == sorted((repr(a), b, c, d) for a, b, c, d in expected)
    for r in got:
        if r.removed:
            source = next(t for i, t, *_ in rows if i == r.doc_id)
            assert sum(len(source[s.start : s.end].split()) for s in r.removed) == r.n_removed
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (4, 5)}[5] >= 25 and {r.doc_id: r.n_removed for r in got}[16] == 29
    assert next(r for r in got if r.doc_id == 6).text is None and substring.dedup_substrings(none).count() == 0


def test_chat(spark):
    odd = ["", "\\", "a\\[INST]b</s>", "</s>[INST] ok [/INST]", "[\\INST]", "<", "é\n[/INST", "[INST"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, None, None), (None, 0, "assistant", "x"), (3, 0, "we[INST]ird\n", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_turns(chat.turns_of_rows(df))).collect():
        mine = sorted([t for t in turns if t[0] == r.conv_id], key=lambda t: t[1])
        assert [(t.role, t.text) for t in r.read_turns] == [(t[2] or "", t[3] or "") for t in mine]
        assert r.loss_text == "".join(t[3] for t in mine if t[2] == "assistant")


def test_layouts(spark):
    records = ['{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 3}', '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', '{"instruction": "a", "input": "", "output": "b"}', '{"prompt": "a", "completion": "b"}', '{"other": 1}', "broken", None]
    out = chat.turns_of_records(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, r string"), "r").orderBy("i").collect()
    assert [r.layout for r in out] == ["messages", "from_value", "instruction_input_output", "prompt_completion", None, None, None]
    assert all([tuple(t) for t in r.turns] == [("user", "a"), ("assistant", "b")] for r in out[:4]) and all(r.turns == [] for r in out[4:])


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>One <b>bold\n  text</b><br>more<p>Short.</p><script>var a='</p>';</script><aside>side</aside><form>Name<input></form></article><div id=comments><p>nice post indeed, thank you all so much</p></div><footer>&copy; x</footer>"
    assert html_text.main_text(page) == "Head & line\nOne bold text more\nShort."
    plain = "<body><div id=top class=nav>a b</div><div><p>" + prose(1, 40) + "</p><p>Tiny.</p></div><footer>f</footer></body>"
    assert html_text.main_text(plain) == prose(1, 40) + "\nTiny."
    for odd in (None, "", "<", "<!DOCTYPE", "<nav>x</nav>", "<p></p>", "<![foo[", "</p></div>"):
        assert html_text.main_text(odd) in ("", "<")
    df = spark.createDataFrame([(1, "u", page, 3), (1, None, None, 4), (None, "u", "", 5)], "page_id long, url string, html string, text long")
    assert sorted(r.text for r in html_text.extract_pages(df).collect()) == ["", "", "Head & line\nOne bold text more\nShort."]


def test_media(docs, rows, none):
    got = media.media_clips(media.text_media(docs)).collect()
    assert len(got) == len(rows)
    want = sorted((repr(i), (t or "").encode()) for i, t, *_ in rows)
    for r, (name, raw) in zip(sorted(got, key=lambda r: (repr(r.doc_id), bytes(r.payload))), want):
        assert repr(r.doc_id) == name and r.n_bytes == len(raw) and bytes(r.payload) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r.clips[0].first_frame == 0 and r.clips[-1].end_frame == len(media.read_index(bytes(r.media)))
    noise = np.random.default_rng(1).integers(0, 256, 64 * 700, dtype=np.uint8).tobytes()
    frames = media.read_media(media.write_media([noise, bytes(64), b"\xff" * 640, b"\x00\xff" * 64 * 50]))
    assert b"".join(f.tobytes() for f in frames[0]) == noise
    cut = [np.full((64, 64), 10, np.uint8)] * 6 + [np.full((64, 64), 200, np.uint8)] * 6
    assert media.shots(cut) == [(0, 6), (6, 12)] and media.text_media(none).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_output(spark, docs, rows, none, tmp_path, encoding):
    name = P.path("byte_bpe_50k.json")
    output.write_token_ids(docs, str(tmp_path / "t"), name, encoding=encoding)
    got = sorted(output.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    enc, at = tokens.Encoder(name), 0
    want = [np.frombuffer(x, "<i4").tolist() + [2] for x in enc.ids([t or "" for _, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1] or ""))])]
    for r, ids in zip(got, want):
        assert r.start == at and r.ids == ids and r.n_tokens == len(ids)
        at += len(ids)
    few = output.read_documents(spark, str(tmp_path / "t"), 4, 5).collect()
    assert sorted(r.doc_id for r in few) == [4, 5] and {r.start for r in few} <= {r.start for r in got}
    assert [r.ids_crc32 for r in output.ids_crc32(output.read_documents(spark, str(tmp_path / "t"), 9, 9)).collect()] == [zlib.crc32(np.array(enc.tok.encode("one two", add_special_tokens=False).ids + [2], "<u4").tobytes())] * 2
    output.write_token_ids(none, str(tmp_path / "n"), name)
    assert output.read_documents(spark, str(tmp_path / "n")).count() == 0


def test_query_of_media_columns(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in media.op9_media_columns(spark, str(tmp_path)).collect():
        got.setdefault(repr(r.doc_id), []).append(r)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        file = media.write_media([full])[0]
        shots = media.shots(media.read_media([file])[0])
        for r in got[repr(i)]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
            assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
            assert r.feature.startswith(f"frames={shots[-1][1]};shots={len(shots)};cuts={','.join(str(a) for a, _ in shots[1:])};levels=") and len(r.feature.split("levels=")[1].split(",")) == len(shots)
    clips = media.clip_rows(media.media_clips(media.text_media(docs))).collect()
    assert {c.clip for c in clips if c.doc_id == 6} == {0} and all(c.end_s > c.start_s >= 0 and c.end_frame > c.first_frame for c in clips)


def test_queries_of_ids_and_licences(spark, docs, rows, tmp_path):
    """ids_crc32, start, sequence padding, first_word, last_word, base_labels: against plain Python and the library."""
    from tokenizers import Tokenizer

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at = 0
    got = sorted(output.op10_token_output(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    for r, (i, t) in zip(got, sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1] or ""))):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((repr(i), 0 if k else len(x), zlib.crc32(x[k : k + 4096].tobytes()), k) for i, t, *_ in rows for x in [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")] for k in range(0, len(x), 4096))
    packed = packing.op2_packing(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), 0 if r.start else r.doc_tokens, r.ids_crc32, r.start) for r in packed) == want
    places = {}
    for i, t, *_ in rows:
        w = word_list(t)
        found = [(k, label) for p, label in licences.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places.setdefault(repr(i), []).append((len(w), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))))
    for r in licences.op3_licence_scan(spark, str(tmp_path)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in places[repr(r.doc_id)] and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_queries_are_named():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline as C

    item = " ".join(rows[3][1].split()[5:40])
    extra = "n_words string, n_removed string, removed long, component_id string, hit string, tk long, carried string, key long, map long"
    data = [(*r[:5], f"w{i}", None, i, "c", "h", 1, "x", 2, 3) for i, r in enumerate(rows)]
    data += [(4, "a clean text that shares its id with another", "en", "s", 1, *data[0][5:]), data[0], data[8], (None, prose(55, 40), "en", "s", 1, *data[0][5:]), (None, None, *data[0][2:])]
    spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [], []
    columns = docs.columns
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        assert i == len(C.STAGES) - 1 or docs.columns == columns
        if i < len(C.STAGES) - 1:
            kept.append(docs.collect())
            assert all(r.n_words == f"w{r.removed}" and r.hit == "h" for r in kept[-1])  # extra columns stay with their row
    assert {1, 2, 3, 4, 5, None} <= seen[0] and not {6, 7, 8, 10} & seen[0] and len(kept[0]) == len(data) - 5
    assert {1, 4, 5, None} <= seen[1] and not {2, 3} & seen[1]
    count = lambda rows_, i: sum(r.doc_id == i for r in rows_)
    assert count(kept[0], 1) == 2 and count(kept[1], 1) == 1 and count(kept[0], 9) == 3 and count(kept[1], 9) == 1 and count(kept[1], None) == 2 and count(kept[1], 4) == 2
    assert {1, 4, 5, None} <= seen[2] and {1, 4, 5, None} <= seen[3] and seen[4] == seen[3]
    assert [r.text for r in kept[3] if r.doc_id == 4] == ["a clean text that shares its id with another"]  # the contaminated row of that id went
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.countDistinct("start").alias("c")).collect()
    assert all(r.n > 0 for r in pieces)
    spark.createDataFrame([], spark.read.parquet(str(tmp_path / "documents.parquet")).schema).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "e" / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path / "e")).count() == 0
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0" and C.run(spark, str(tmp_path)).count() >= len(seen[4])
