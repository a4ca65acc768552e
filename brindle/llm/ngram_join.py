"""N-gram Jaccard self-join by vertical partitioning, and its components.

A document's set is its distinct word shingles, as 64-bit digests.  All digests have one global
order: those that repeat in many documents of a block of text come last, each part by digest.
The order is cut into fragments; a set's part in each fragment is a row of its own.

1. Equal sets form one class (exact copies cost one row from here on).
2. Two sets that reach the threshold share a digest among the first n - ceil(t n) + 1 of the
   order, so only these prefixes are inverted.  Digests that one class alone has are dropped.
3. Candidates are bounded from above before whole sets move: by lengths, by common prefix digests,
   and by a map of each set's digests (a bit is the parity of the digests that fall on it; bits that
   differ are digests that only one of the two sets has).
4. For the candidates left, overlaps are counted in each fragment by itself, by (fragment, set), and
   summed per pair.
5. Linked pairs are merged into components.  Candidates are taken in rounds: first each document
   against one leader for each prefix digest, so that a large group of near copies falls into one
   component by as many pairs as it has members; then all that still lie in different components and
   pass the bounds, inside the join that makes them.  A pair is left out only if it is in one
   component already or a bound rules it out, so no link is lost to the components.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.substring import digest_filter, passes, text_key
from brindle.llm.tokens import forget
from brindle.llm.words import NONSPACE, blocks, runs, spans, whole, word_digests
from brindle.sources.scratch import release, shared_if_small, stored

#: Fragments of the part of the order that is not frequent (a power of two); the frequent digests are one more.
FRAGMENTS = 4
#: A digest is frequent if so many documents of one block of text have it; the largest such list that is shared with the tasks.
#: Both bear on speed only: any global order gives the same pairs.
FREQUENT_IN_BLOCK, FREQUENT_MOST, BLOCK_BYTES = 4, 1 << 18, 8 << 20
#: Rounds in which members meet a leader before all remaining pairs are bounded.  Fewer if meeting all makes at most so many
#: comparisons for each posting, or if a round merges less than this share of the documents in question.  All bear on speed only.
LEADER_ROUNDS, MEET_ALL, FEW = 4, 16, 0.02
#: 64-bit words of a set's map, and of its short form (a divisor).  More make the bound sharper for large sets.
MAP_WORDS, FEW_WORDS = 16, 4
#: The most words of the wide map that a large set has besides.
WIDE_MOST = 4096
#: Documents of a digest from which on its rows carry whole maps and earlier digests, if the document has at most so many of these.
MANY, EARLIER = 32, 256
#: Bits of the map that tells which documents a second reading needs.
MAP_BITS = 1 << 23


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles as a sorted array; fewer than k words: the whole sequence as one; no words: empty."""
    starts, ends, first = spans(raw, offs, NONSPACE)
    words = word_digests(raw, starts, ends)
    grams = runs(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        else:
            out.append(np.array([whole(words[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out


def class_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tk", text_key("text"))


def frequent_digests(texts: DataFrame, k: int) -> np.ndarray:
    """Digests that repeat in blocks of text, most frequent first up to FREQUENT_MOST, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(sets: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            keep = n >= FREQUENT_IN_BLOCK
            return pa.record_batch([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

        forget()
        sets, held = [], 0
        for batch in batches:
            for _, _, raw, offs in blocks(batch.column(1)):
                sets += shingle_sets(raw, offs, k)
                held += len(raw)
                if held >= BLOCK_BYTES:
                    yield emit(sets)
                    sets, held = [], 0
        if sets:
            yield emit(sets)

    top = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST)
    return np.sort(top.select("h").toArrow().column(0).to_numpy().view(np.uint64))


def is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def parity_map(g: np.ndarray, words: int) -> np.ndarray:
    """`words` (a power of two) words of bits; each is the parity of the digests that fall on it."""
    odd = np.bincount((g >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_words(n: int) -> int:
    """Words of the wide map of a set too large for MAP_WORDS (about 1.3 bits for each digest or more, up to WIDE_MOST); 0: it needs none."""
    return min(WIDE_MOST, MAP_WORDS << (n // (50 * MAP_WORDS)).bit_length()) if n > 50 * MAP_WORDS else 0


def prefixes(texts: DataFrame, k: int, num: int, den: int, frequent) -> DataFrame:
    """doc_id, tk, row (unique), n, cls (digest of the set; null if empty), prefix (the first digests in the global order), map, wide (of large sets)."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        row, often = TaskContext.get().partitionId() << 40, frequent.value
        for batch in batches:
            for lo, hi, raw, offs in blocks(batch.column(1)):
                sets = shingle_sets(raw, offs, k)
                heads = []
                for g in sets:
                    late = is_in(often, g)
                    heads.append(np.concatenate([g[~late], g[late]])[: len(g) - -(-num * len(g) // den) + 1])
                sizes = np.array([len(h) for h in heads])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(heads).view(np.int64)))
                maps = pa.ListArray.from_arrays(pa.array(np.arange(0, MAP_WORDS * (hi - lo) + 1, MAP_WORDS, dtype=np.int32)), pa.array(np.concatenate([parity_map(g, MAP_WORDS) for g in sets])))
                wide = pa.array([parity_map(g, w) if (w := wide_words(len(g))) else None for g in sets], pa.list_(pa.int64()))
                n = [len(g) for g in sets]
                yield pa.record_batch(
                    [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(np.arange(row, row + hi - lo)), pa.array(n, pa.int64()), pa.array([class_digest(g) if len(g) else None for g in sets], pa.binary()), lists, maps, wide],
                    names=["doc_id", "tk", "row", "n", "cls", "prefix", "map", "wide"],
                )
                row += hi - lo

    return texts.mapInArrow(prefix, "doc_id long, tk long, row long, n long, cls binary, prefix array<bigint>, map array<bigint>, wide array<bigint>")


def postings(classes: DataFrame, repeated) -> DataFrame:
    """h, id of the prefix digests that pass the filter `repeated` (a broadcast; None: all)."""
    if repeated is None:
        return classes.select(F.explode("prefix").alias("h"), "id")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lists = batch.column(1)
            h = np.asarray(lists.flatten(), np.int64)
            own = np.repeat(np.asarray(batch.column(0), np.int64), np.diff(np.asarray(lists.offsets, np.int64)))
            for lo in range(0, len(h), 1 << 18):
                kept = passes(repeated.value, h[lo : lo + (1 << 18)].view(np.uint64))
                yield pa.record_batch([pa.array(h[lo : lo + (1 << 18)][kept]), pa.array(own[lo : lo + (1 << 18)][kept])], names=["h", "id"])

    return classes.select("id", "prefix").mapInArrow(post, "h long, id long")


def bit_map(ids: DataFrame, column: str) -> np.ndarray:
    """MAP_BITS bits, set where an id's hash falls: at most MAP_BITS / 64 rows reach the driver."""
    at = ids.select(F.pmod(F.xxhash64(column), F.lit(MAP_BITS)).alias("at"))
    words = at.groupBy(F.expr("cast(at div 64 AS int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def segments(texts: DataFrame, wanted: DataFrame, k: int, frequent) -> DataFrame:
    """id, f, seg: a row for each fragment of the wanted (id, doc_id, cls); the texts are read again."""
    bits = texts.sparkSession.sparkContext.broadcast(bit_map(wanted, "doc_id"))
    edges = np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(65 - FRAGMENTS.bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        often, bit = frequent.value, bits.value
        for batch in batches:
            at = np.asarray(batch.column(2), np.int64)
            hit = (bit[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            for lo, hi, raw, offs in blocks(batch.column(1)):
                segs, names = [], []
                for g in shingle_sets(raw, offs, k):
                    late = is_in(often, g)
                    segs += [x.view(np.int64) for x in (*np.split(g[~late], np.searchsorted(g[~late], edges)), g[late])]
                    names.append(class_digest(g) if len(g) else None)
                each = FRAGMENTS + 1
                where = pa.array(np.repeat(np.arange(lo, hi), each))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in segs])]).astype(np.int32)), pa.array(np.concatenate(segs)))
                yield pa.record_batch([batch.column(0).take(where), pa.array(names, pa.binary()).take(pa.array(np.repeat(np.arange(hi - lo), each))), pa.array(np.tile(np.arange(each, dtype=np.int32), hi - lo)), lists], names=["doc_id", "cls", "f", "seg"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    rows = texts.select("doc_id", "text", at.alias("at")).mapInArrow(cut, "doc_id long, cls binary, f int, seg array<bigint>")
    keys = wanted.select("id", F.col("cls").alias("__cls"), F.col("doc_id").alias("__doc_id"))
    found = rows.join(shared_if_small(keys, 64), (F.col("cls") == F.col("__cls")) & F.col("doc_id").eqNullSafe(F.col("__doc_id"))).select("id", "f", "seg")
    made = stored(found, "segments", codec="snappy")
    if made.count() > wanted.count() * (FRAGMENTS + 1):  # documents that are there more than once
        made = stored(made.groupBy("id", "f").agg(F.first("seg").alias("seg")), "segments", codec="snappy")
    bits.destroy()
    return made


def lengths_fit(num: int, den: int) -> Column:
    return den * F.least("n", "n2") >= num * F.greatest("n", "n2")


def maps_fit(num: int, den: int, ours: list[Column] | None = None, theirs: list[Column] | None = None) -> Column:
    """Two sets have at least as many digests apart as their maps have bits apart; the rest of both bounds twice the overlap."""
    ours = ours or [F.col("map")[i] for i in range(MAP_WORDS)]
    theirs = theirs or [F.col("map2")[i] for i in range(MAP_WORDS)]
    apart = functools.reduce(operator.add, (F.bit_count(a.bitwiseXOR(b)) for a, b in zip(ours, theirs)))
    return (num + den) * (F.col("n") + F.col("n2") - apart) >= 2 * num * (F.col("n") + F.col("n2"))


def wide_fit(num: int, den: int) -> Column:
    """The bound of maps_fit by the wide maps of two large sets, folded to the smaller of the two; true if one has none."""
    words = F.least(F.size("wide"), F.size("wide2"))

    def fold(c: str) -> Column:
        parts = lambda i: F.transform(F.sequence(F.lit(0), (F.size(c) / words).cast("int") - 1), lambda j: F.col(c)[i + (j * words).cast("int")])
        xor = lambda i: F.aggregate(parts(i), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) == words, F.col(c)).otherwise(F.transform(F.sequence(F.lit(0), words - 1), xor))

    apart = F.aggregate(F.zip_with(fold("wide"), fold("wide2"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda x, y: x + y)
    both = F.col("wide").isNotNull() & F.col("wide2").isNotNull()
    return F.when(both, (num + den) * (F.col("n") + F.col("n2") - apart) >= 2 * num * (F.col("n") + F.col("n2"))).otherwise(F.lit(True))


def folded(words: int) -> list[Column]:
    """The words of a map of fewer bits: parities of parities."""
    return [functools.reduce(Column.bitwiseXOR, [F.col("map")[j] for j in range(i, MAP_WORDS, words)]) for i in range(words)]


def prefixes_fit(num: int, den: int) -> Column:
    """Common digests up to the end of the prefix that ends first are in both; the others lie in that set's rest."""
    rest = lambda n: F.ceil(F.lit(num) * F.col(n) / den) - 1
    most = F.size(F.array_intersect("prefix", "prefix2")) + F.greatest(rest("n"), rest("n2"))
    return (num + den) * most >= num * (F.col("n") + F.col("n2"))


def beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The stored pairs(a, b) with columns of both sets, those of b under names that end in 2."""
    own = sets.select("row", *columns)
    left = own.join(shared_if_small(pairs, 24), F.col("row") == F.col("a")).drop("row")
    targets = stored(pairs.select("b").distinct(), "targets")
    right = own.join(shared_if_small(targets, 16), F.col("row") == F.col("b"), "left_semi").select(F.col("row").alias("b"), *[F.col(c).alias(f"{c}2") for c in columns])
    return left.join(right, "b")


def bounded(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, na, nb of the stored pairs(a, b) that no bound rules out; prefixes move only for those that lengths and maps leave."""
    near = stored(beside(pairs, sets, "n", "map", "wide").filter(lengths_fit(num, den)).filter(maps_fit(num, den)).filter(wide_fit(num, den)).select("a", "b"), "mapped")
    return beside(near, sets, "n", "prefix").filter(prefixes_fit(num, den)).select("a", "b", F.col("n").alias("na"), F.col("n2").alias("nb"))


def meet_all(live: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of the pairs of live(h, id, comp, c) that share a digest, lie in different components and pass the bounds of lengths and maps.

    The bounds are conditions of the join, so no other pair becomes a row.  Where a digest has many documents, a
    row carries the whole map and the document's earlier digests of that kind, and a pair is made at its first common one.
    """
    own = sets.select(F.col("row").alias("id"), "n", "map")

    def meet(rows: DataFrame, fits: Column) -> DataFrame:
        other = rows.select("h", *[F.col(c).alias(f"{c}2") for c in rows.columns if c != "h"])
        return rows.join(other, "h").filter("id < id2 and comp != comp2").filter(lengths_fit(num, den)).filter(fits)

    names = [f"w{i}" for i in range(FEW_WORDS)]
    few = live.filter(F.col("c") <= MANY).select("h", "id", "comp").join(own.select("id", F.col("n").cast("int").alias("n"), *[x.alias(w) for x, w in zip(folded(FEW_WORDS), names)]), "id").select("h", "id", "n", "comp", *names)
    few = meet(few, maps_fit(num, den, [F.col(w) for w in names], [F.col(f"{w}2") for w in names]))
    many = live.filter(F.col("c") > MANY).groupBy("id").agg(F.array_sort(F.collect_list("h")).alias("s"), F.first("comp").alias("comp")).join(own, "id")
    earlier = F.when(F.size("s") <= EARLIER, F.slice("s", F.lit(1), F.col("at"))).otherwise(F.array().cast("array<bigint>"))
    many = many.select("id", "n", "comp", "map", "s", F.posexplode("s").alias("at", "h")).withColumn("before", earlier).drop("s", "at")
    many = meet(many, maps_fit(num, den) & ~F.arrays_overlap("before", "before2"))
    return few.select(F.col("id").alias("a"), F.col("id2").alias("b")).unionByName(many.select(F.col("id").alias("a"), F.col("id2").alias("b"))).distinct()


def count_overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """a, b, na, nb, shared: partial overlaps by (fragment, set), summed per pair."""
    left = segs.join(shared_if_small(pairs, 40), F.col("id") == F.col("a")).select("f", "a", "b", "na", "nb", F.col("seg").alias("sa"))
    targets = stored(pairs.select("b").distinct(), "targets")
    right = segs.join(shared_if_small(targets, 16), F.col("id") == F.col("b"), "left_semi").select("f", F.col("id").alias("b"), F.col("seg").alias("sb"))
    partial = left.join(right, ["f", "b"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("shared"))


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the smallest id reachable) of the ids in edges(a, b): smallest neighbour, then pointer jumping, until nothing changes."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        new = stored(hooked.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        labels = new.select("id", "comp")
        if new.filter("comp != old").isEmpty():
            return labels


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: links are pairs with den * intersection >= num * union.

    Words are separated by ASCII white space, A-Z count as a-z.  Null, empty and blank texts have no
    shingles and no links (component_id is their own id).  A null doc_id never is the smallest id of
    a component that has others.  Rows with equal doc_id are rows of their own; one with equal text is
    in the same component.  An empty table gives no rows.
    """
    sets, of_class = class_components(_texts(docs, id_col, text_col), k, num, den)
    named = of_class.select("cls", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return sets.select("doc_id", "n", "cls").join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_representatives(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows and columns of docs(doc_id, text, ...), of each component one row only: that of the least doc_id.

    Ties go to the least digest of the text, then to the least JSON of all columns; a null doc_id comes last.
    Rows without words are in no component and stay, repeated ones too.  An empty table gives no rows.
    """
    sets, of_class = class_components(_texts(docs, "doc_id", "text"), k, num, den)
    keys = sets.filter("n > 0").groupBy("doc_id", "tk").agg(F.first("cls").alias("cls"), F.count("*").alias("c")).join(of_class.select("cls", "root"), "cls")
    keys = stored(keys.select("doc_id", "tk", "root", "c"), "row-keys")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tk")
    kept = stored(keys.groupBy("root").agg(F.min(rank).alias("r")).select("root", "r.doc_id", "r.tk"), "kept-keys")
    both = keys.join(kept.select("root", F.col("doc_id").alias("k_doc"), F.col("tk").alias("k_tk")), "root")
    gone = stored(both.filter(~(F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("tk") == F.col("k_tk")))).select("doc_id", "tk"), "gone-keys")
    again = stored(both.filter(F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("tk") == F.col("k_tk")) & (F.col("c") > 1)).select("doc_id", "tk"), "repeated-keys")
    own = docs.columns
    tagged = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__tk": text_key(F.col("text").cast("string")), "__w": F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})

    def of(table: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        names = table.select(F.col("doc_id").alias("__i"), F.col("tk").alias("__t"))
        return rows.join(shared_if_small(names, 40), F.col("__w") & F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__tk") == F.col("__t")), how)

    single = of(again, "left_anti", of(gone, "left_anti", tagged)).select(*own)
    if again.isEmpty():
        return single
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    first = of(again, "left_semi", tagged).groupBy("__id", "__tk").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return single.unionByName(first.select(*[F.col("__row")[f"c{i}"].alias(c) for i, c in enumerate(own)]))


def class_components(texts: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(sets: a row for each text; classes: cls, root (one value for each component) and component_id of each distinct set)."""
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    frequent = share(frequent_digests(texts, k))
    sets = stored(prefixes(texts, k, num, den, frequent), "prefixes", codec="snappy")
    classes = stored(sets.filter("n > 0").groupBy("cls").agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("c")), "classes")
    copies = sets.select("row", "cls").join(shared_if_small(classes.filter("c > 1").select("cls", "id"), 40), "cls").filter("row != id").select("row")
    copies = stored(copies, "copies")
    firsts = sets.filter("n > 0").join(shared_if_small(copies, 16), "row", "left_anti").withColumn("id", F.col("row"))

    # Digests with at least two classes, counted with map-side combining; their postings, found through a filter of bounded size.
    heads = postings(firsts, None).groupBy("h").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead != last").select("h", "lead")
    heads = stored(heads, "heads")
    repeated = share(digest_filter(heads))
    live = stored(postings(firsts, repeated).join(heads, "h"), "postings", codec="snappy").withColumns({"comp": F.col("id"), "comp2": F.col("lead")})
    comp = segs = None
    done = few = False
    turn = 0
    while not done:
        if turn:  # digests that still have different components, each with another leader: the one of most live digests, or any
            lots = live.select("h", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            rank = F.struct((F.lit(0) if turn % 2 == 0 else F.col("k")).alias("k"), F.xxhash64("id", F.lit(turn)).alias("key"), F.col("id").alias("lead"), F.col("comp").alias("comp2"))
            lots = lots.join(lots.groupBy("id").agg(F.count("*").alias("k")), "id") if turn % 2 else lots
            mixed = lots.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(rank).alias("leader")).filter("lo != hi")
            before, live = live, stored(lots.join(mixed.select("h", "leader", "c"), "h").select("h", "id", "comp", "c", "leader.lead", "leader.comp2"), "live", codec="snappy")
            release(before)
            size, compared = live.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)) / 2).first()
            if not size:
                break
            done = few or turn == LEADER_ROUNDS or compared <= MEET_ALL * size
        if done:
            pairs = meet_all(live, sets, num, den)
        else:
            facing = live.filter("comp != comp2").groupBy("id", "lead").agg(F.count("*").alias("c")).groupBy("id").agg(F.max(F.struct("c", "lead")).alias("best"))
            pairs = facing.select(F.col("id").alias("a"), F.col("best.lead").alias("b"))
        turn += 1
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            few = True
            comp = comp if comp is not None else spark.createDataFrame([], "id long, comp long")
            continue
        pairs = stored(bounded(pairs, sets, num, den), "bounded")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        if segs is not None:
            ids = ids.join(segs.filter("f = 0").select("id"), "id", "left_anti")
        wanted = stored(sets.select(F.col("row").alias("id"), "doc_id", "cls").join(shared_if_small(stored(ids, "wanted-ids"), 16), "id", "left_semi"), "wanted")
        if not wanted.isEmpty():
            more = segments(texts, wanted, k, frequent)
            segs = more if segs is None else segs.unionByName(more)
        if segs is None:
            links = spark.createDataFrame([], "a long, b long")
        else:
            links = stored(count_overlaps(pairs, segs).filter((num + den) * F.col("shared") >= num * (F.col("na") + F.col("nb"))).select("a", "b"), "links")
        if comp is not None:  # links between components
            to = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"{c}c"))
            links = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")).filter("a != b")
        merged = components(links)
        few = merged.count() < FEW * live.select("id").distinct().count()
        if comp is None:
            comp = merged
        else:
            moved = merged.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
            known = comp.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
            comp = stored(known.unionByName(merged.join(comp, "id", "left_anti")), "components")
    frequent.destroy()
    repeated.destroy()
    for used in (segs, live, heads, copies):
        if used is not None:
            release(used)
    if comp is None:
        comp = spark.createDataFrame([], "id long, comp long")
    joined = classes.join(comp, "id", "left").select("cls", F.coalesce("comp", "id").alias("id"), "doc_id")
    smallest = joined.groupBy("id").agg(F.min("doc_id").alias("component_id"))
    return sets, stored(joined.select("cls", "id").join(smallest, "id").select("cls", F.col("id").alias("root"), "component_id"), "class-components")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: n_shingles and component_id of every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
