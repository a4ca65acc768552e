"""Shingles, MinHash, LSH bands, leakage shields and greedy near-duplicate removal."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import bind, clean_text, normalize_for_hash
from brindle.sources.scratch import balanced, shared_if_small, stored

try:  # the same digests, with less work for each short string
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: (bands, rows) that balance false positives and negatives for 128 permutations.
BANDS = {0.80: (9, 13), 0.85: (8, 16)}
PRIME = 4294967311


def shingles(text: Column, k: int = 5, *, short: str = "whole") -> Column:
    """Distinct k-word shingles of lower-cased white-space words; up to k words: the whole text ("whole") or the words ("unigrams", for fewer than k)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))
        if short == "whole":
            return F.when(n == 0, F.array().cast("array<string>")).when(n <= k, F.array(F.array_join(w, " "))).otherwise(grams)
        return F.when(n < k, F.array_distinct(w)).otherwise(grams)

    return bind(words, of)


def shingles_core(text: Column, k: int = 5) -> Column:
    """The variant on text without punctuation, unigrams for fewer than k words."""
    return shingles(normalize_for_hash(text), k, short="unigrams")


def multipliers(n: int) -> list[tuple[int, int]]:
    """(a, b) of n hash functions (a x + b) mod PRIME, from a fixed linear congruence."""
    out, x = [], 42
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        a = (x >> 33) % 2147483646 + 1
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append((a, (x >> 33) % 2147483647))
    return out


def _shingled(docs: DataFrame, id_col: str, text_col: str, schema: str, make, k: int, short: str) -> DataFrame:
    """Rows made from each document's shingles in Arrow batches; make(ids, lists of the shingles' bytes) gives a batch.

    Lower case is the JVM's; an empty set is an empty list.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def of(text: str | None) -> list[bytes]:
        w = (text or "").encode().split()  # bytes split at the six ASCII white-space characters only
        if short == "unigrams" and len(w) < k:
            return w
        return list(map(b" ".join, zip(*[w[i:] for i in range(k)]))) if len(w) >= k else [b" ".join(w)] if w else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield make(part.column(0), [of(t) for t in part.column(1).to_pylist()])

    return balanced(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))).select(id_col, F.lower(text_col)).mapInArrow(run, schema)


def band_heads(index: DataFrame, threshold: float, limit: int = 32 << 20) -> tuple[int, Broadcast] | None:
    """(rows of a band, the distinct first values of each band of an index, sorted, in a broadcast), for signatures(near=); None for an index of more than `limit` bytes or without `head`."""
    import numpy as np

    if "head" not in index.columns:
        return None
    b, r = BANDS[threshold]
    heads = index.select("band", "head").distinct()
    if heads.count() * 16 > limit:
        return None
    band, head = (heads.toArrow().column(c).to_numpy() for c in ("band", "head"))
    return r, index.sparkSession.sparkContext.broadcast([np.sort(head[band == i]) for i in range(b)])


def signatures(docs: DataFrame, permutations: int = 128, *, k: int = 5, short: str = "whole", id_col: str = "doc_id", text_col: str = "text", sig_col: str = "sig", near: tuple[int, Broadcast] | None = None) -> DataFrame:
    """id, sig: MinHash of each document's shingles; an empty set gives PRIME everywhere.  Each shingle is hashed once, each permutation is one vector operation.

    With `near`, a document whose bands begin with none of these values counts as one without shingles: two equal bands begin
    with the same value, so it shares none, and only the permutations that bands begin with are made for it.
    """
    import numpy as np
    import pyarrow as pa

    a, b = (np.array(x, np.int64) for x in zip(*multipliers(permutations)))
    kind = dict(docs.dtypes)[id_col]

    def meets(h) -> bool:
        step, heads = near[0], near[1].value
        first = np.full(len(heads), PRIME, np.int64)
        for lo in range(0, len(h), 4096):
            np.minimum(first, ((h[None, lo : lo + 4096] * a[::step][: len(heads), None] + b[::step][: len(heads), None]) % PRIME).min(axis=1), out=first)
        return any(at < len(s) and s[at] == v for s, v in zip(heads, first) for at in [np.searchsorted(s, v)])

    def make(ids, lists):
        out = np.full((len(lists), permutations), PRIME, np.int64)
        for i, grams in enumerate(lists):
            h = np.frombuffer(b"".join([md5(g).digest()[:4] for g in grams]), ">u4").astype(np.int64) % 2147483647
            if near is not None and len(h) and not meets(h):
                continue
            for lo in range(0, len(h), 2048):
                np.minimum(out[i], ((h[lo : lo + 2048, None] * a + b) % PRIME).min(axis=0), out=out[i])
        return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, permutations, dtype=np.int32)), pa.array(out.ravel()))], names=["id", "sig"])

    return _shingled(docs, id_col, text_col, f"`{id_col}` {kind}, `{sig_col}` array<bigint>", lambda i, g: make(i, g).rename_columns([id_col, sig_col]), k, short)


def core_signatures(docs: DataFrame, permutations: int = 128, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variant on text without punctuation, unigrams for fewer than five words."""
    return signatures(docs.select(id_col, normalize_for_hash(text_col).alias("text")), permutations, short="unigrams", id_col=id_col)


def bands(signatures: DataFrame, threshold: float, *, id_col: str = "doc_id", sig_col: str = "sig") -> DataFrame:
    """id, band, band_hash, head (the band's first value) rows of the LSH index."""
    b, r = BANDS[threshold]
    each = F.array(*[F.struct(F.md5(F.array_join(F.slice(sig_col, 1 + i * r, r), ",")).alias("hash"), F.col(sig_col)[i * r].alias("head")) for i in range(b)])
    return signatures.select(id_col, F.posexplode(each).alias("band", "__b")).select(id_col, "band", F.col("__b.hash").alias("band_hash"), F.col("__b.head").alias("head"))


def lsh_index(docs: DataFrame, threshold: float, *, id_col: str = "doc_id", text_col: str = "text", permutations: int = 128, near: tuple[int, Broadcast] | None = None) -> DataFrame:
    signed = signatures(docs, permutations, id_col=id_col, text_col=text_col, near=near)
    return bands(signed.filter(F.col("sig")[0] < PRIME), threshold, id_col=id_col)  # PRIME: no shingles


def leakage_filter(docs: DataFrame, test_index: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id") -> DataFrame:
    """Documents that share no band with the test index (candidates are not verified)."""
    index = stored(test_index.select("band", "band_hash", *[c for c in test_index.columns if c == "head"]).distinct(), "test-index")
    mine = lsh_index(docs, threshold, id_col=id_col, near=band_heads(index, threshold))
    hit = stored(mine.join(shared_if_small(index, 64), ["band", "band_hash"], "left_semi").select(id_col).distinct(), "shield-hits")
    return docs.join(shared_if_small(hit, 24), id_col, "left_anti")


def shield_flags(rows: DataFrame, tests: DataFrame, fingerprint: Column, test_fingerprint: Column, *, id_col: str, by: str | None = None, threshold: float = 0.8) -> DataFrame:
    """rows with `leaked`: a fingerprint that shares a band with a test fingerprint (of the same group, if asked for); empty ones are kept."""
    keys = ["band", "band_hash"]
    mine = rows.select(F.col(id_col).alias("__id"), *([F.col(by).alias("__by")] if by else []), clean_text(fingerprint).alias("text"))
    theirs = tests.select(F.monotonically_increasing_id().alias("__t"), *([F.col(by).alias("__by")] if by else []), clean_text(test_fingerprint).alias("text"))
    a, b = lsh_index(mine, threshold, id_col="__id"), lsh_index(theirs, threshold, id_col="__t")
    if by:
        a, b, keys = a.join(mine.select("__id", "__by"), "__id"), b.join(theirs.select("__t", "__by"), "__t"), [*keys, "__by"]
    hit = a.join(b.select(keys).distinct(), keys, "left_semi").select("__id").distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, rows[id_col] == hit["__id"], "left").withColumn("leaked", F.coalesce("__hit", F.lit(False))).drop("__id", "__hit")


def leakage_report(flagged: DataFrame, *by: str) -> DataFrame:
    return flagged.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("leaked").alias("dropped"), F.count_if(~F.col("leaked")).alias("kept"))


def digest_sets(docs: DataFrame, k: int = 5, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, s: each document's distinct shingles as sorted 64-bit digests."""
    import numpy as np
    import pyarrow as pa

    kind = dict(docs.dtypes)[id_col]

    def make(ids, lists):
        sets = [np.unique(np.frombuffer(b"".join(md5(g).digest()[:8] for g in grams), "<i8")) for grams in lists]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).astype(np.int64)))], names=["id", "s"])

    return _shingled(docs, id_col, text_col, f"id {kind}, s array<bigint>", make, k, "whole")


def _members(docs: DataFrame, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(members: id and rep; sets: id, n, s of all members), both stored.  Only ids and keys are shuffled."""
    sets = stored(digest_sets(docs, k, id_col=id_col, text_col=text_col).filter(F.size("s") > 0).select("id", F.size("s").alias("n"), "s", F.sha2(F.array_join("s", ","), 256).alias("key")), "digest-sets")
    reps = sets.select("id", "key").groupBy("key").agg(F.min("id").alias("rep"))
    return stored(sets.select("id", "key").join(reps, "key").select("id", "rep"), "members"), sets.select("id", "n", "s")


def shingle_classes(docs: DataFrame, k: int = 5, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members: id and rep, the least id with the same shingles; classes: id, n, s of each rep).  Documents without shingles are in neither."""
    members, sets = _members(docs, k, id_col, text_col)
    return members, sets.join(members.filter("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"])


def meeting_classes(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The sets (id, n, s) of those reps that can have a partner at the threshold.

    The digests of a set are sorted, so its prefix in the order of all digests is a slice.  A set of n lacks at most
    r = n - ceil(threshold * n) in a partner, so prefixes of r + l share at least l, for the l of the smaller of the two;
    a set of whose prefix others have fewer meets nobody.  Here l = floor(n * (1 - threshold)), 1 at least.  Only prefixes
    are shuffled; whole sets are read again for those that may meet.
    """
    lacks = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    more = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(1 - threshold)))
    once = members.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty()
    single = (lambda df: df) if once else (lambda df: df.dropDuplicates(["id"]))
    slim = sets.select("id", F.slice("s", F.lit(1), (lacks + more(F.col("n"))).cast("int")).alias("h"), more(F.ceil(F.col("n") * F.lit(threshold) - 1e-9)).alias("least"))
    reps = members.filter("id = rep").select("id")
    heads = single(slim.join(shared_if_small(reps, 16), "id", "left_semi")).select("id", "least", F.explode("h").alias("g"))
    shared = heads.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1").select("g")
    enough = heads.join(shared, "g", "left_semi").groupBy("id").agg(F.count("*").alias("c"), F.first("least").alias("least")).filter("c >= least")
    meet = stored(enough.select("id"), "meeting")
    return stored(single(sets.join(shared_if_small(meet, 16), "id", "left_semi")), "class-sets")


def prefix_heads(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(sets: id, n, s; heads: id, n, g): shingles that others have, rarest class count first, and the prefixes of which two sets at the threshold share one."""
    grams = classes.select("id", "n", F.explode("s").alias("g"))
    freq = grams.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = grams.join(freq, "g").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))  # of shingles that others have; its own come before these
    sets = stored(ranked.select("id", "n", F.transform("s", lambda x: x["g"]).alias("s")), "shingle-sets")
    length = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - (F.col("n") - F.size("s"))).cast("int")
    return sets, sets.filter(length > 0).select("id", "n", F.explode(F.slice("s", F.lit(1), length)).alias("g"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of the candidate pairs at or above the threshold."""
    left, right = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("jaccard"))
    return found.filter(F.col("jaccard") >= threshold - 1e-12)


def candidates(heads: DataFrame, threshold: float) -> DataFrame:
    """a < b of all sets that share a prefix shingle and whose sizes allow the threshold."""
    other = heads.select(F.col("id").alias("b"), F.col("n").alias("m"), "g")
    return heads.select(F.col("id").alias("a"), "n", "g").join(other, "g").filter("a < b").filter(F.least("n", "m") >= threshold * F.greatest("n", "m")).select("a", "b").distinct()


def jaccard_pairs(docs: DataFrame, threshold: float = 0.85, k: int = 5, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members: id, rep; pairs: a < b, jaccard of different sets at or above the threshold, between reps).

    Documents with equal sets are one class, so copies make no pairs.  Sets are compared only where their prefixes
    share a shingle: first in the order of the digests, which leaves out the classes that meet nobody, then in the order of
    how many of the others have a shingle, rarest first.
    """
    members, every = _members(docs, k, id_col, text_col)
    sets, heads = prefix_heads(meeting_classes(members, every, threshold), threshold)
    return members, verified(candidates(heads, threshold), sets, threshold)


#: Rounds of leaders before what is left meets in pairs, and the share of the undecided that a round must settle to be followed by another.  Both bear on work only.
LEADER_ROUNDS, WORTH = 12, 0.02


def greedy_leaders(heads: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None, int]:
    """(heads still undecided, ids dropped, pairs compared): sets that no smaller undecided one can reach stay and drop their neighbours.

    A set that has the least id of all its prefix shingles has no smaller candidate left, so the sequential loop keeps
    it; it alone is compared with the sets that share a prefix shingle with it.  A group of near-copies falls to its
    least member in one round, with as many comparisons as it has members.
    """
    live, dropped, compared = stored(heads, "live-heads"), None, 0
    left = live.select("id").distinct().count()
    for _ in range(LEADER_ROUNDS):
        if not left:
            break
        least = live.groupBy("g").agg(F.min("id").alias("least"))
        marked = live.join(least, "g")
        leaders = stored(marked.groupBy("id").agg(F.min((F.col("id") == F.col("least")).cast("int")).alias("all"), F.first("n").alias("m")).filter("all = 1").select(F.col("id").alias("a"), "m"), "leaders")
        near = marked.filter("id != least").join(leaders, F.col("least") == F.col("a")).filter(F.least("n", "m") >= threshold * F.greatest("n", "m")).select("a", F.col("id").alias("b")).distinct()
        pairs = stored(near, "leader-pairs")
        compared += pairs.count()
        gone = stored(verified(pairs, sets, threshold).select(F.col("b").alias("id")).distinct(), "dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        live = stored(live.join(leaders.select(F.col("a").alias("id")).unionByName(gone), "id", "left_anti"), "live-heads")
        before, left = left, live.select("id").distinct().count()
        if before - left < WORTH * before:
            break
    return live, dropped, compared


def near_dup_greedy(docs: DataFrame, threshold: float = 0.85, *, id_col: str = "doc_id") -> DataFrame:
    """ids with `kept`, by exact Jaccard pairs in id order.

    Of a class of equal sets only the least id can stay; the loop runs over these.  Rounds of leaders come first, so near
    groups make no squares of pairs; what they leave undecided meets in pairs.
    """
    members, every = _members(docs, 5, id_col, "text")
    sets, heads = prefix_heads(meeting_classes(members, every, threshold), threshold)
    live, dropped, _ = greedy_leaders(heads, sets, threshold)
    pairs = verified(candidates(live, threshold), sets, threshold)
    rest = greedy_keep(live.select(F.col("id").alias("__rep")).distinct(), pairs, id_col="__rep").filter(~F.col("kept")).select(F.col("__rep").alias("id"))
    off = (rest if dropped is None else rest.unionByName(dropped)).select(F.col("id").alias("__off"))
    gone = members.join(off, F.col("rep") == F.col("__off"), "left").filter(F.col("__off").isNotNull() | (F.col("id") != F.col("rep"))).select(F.col("id").alias("__gone")).distinct()
    return docs.select(id_col).join(gone, docs[id_col] == gone["__gone"], "left").withColumn("kept", F.col("__gone").isNull()).drop("__gone")


def containment(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item of whose shingles it holds at least the share `threshold`."""
    theirs = stored(digest_sets(items, k, id_col=item_col, text_col=text_col).select(F.col("id").alias(item_col), F.size("s").alias("n"), F.explode("s").alias("g")), "item-shingles")
    mine = digest_sets(docs, k, id_col=id_col, text_col=text_col).select(F.col("id").alias(id_col), F.explode("s").alias("g"))
    return mine.join(shared_if_small(theirs, 40), "g").groupBy(id_col, item_col).agg((F.count("*") / F.first("n")).alias("share")).filter(F.col("share") >= threshold)


def greedy_keep(ids: DataFrame, pairs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """ids with `kept`: dropped if and only if a smaller kept neighbour exists - the fixpoint of the sequential loop.

    Each round keeps the documents whose smaller neighbours are all dropped and drops those with a kept
    smaller neighbour; only undecided pairs go on.
    """
    edges = stored(pairs.select("a", "b").filter("a < b").distinct(), "near-pairs")
    kept, dropped = None, None
    while not edges.isEmpty():
        later = edges.select(F.col("b").alias("id")).distinct()
        free = edges.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        free = stored(free, "kept")
        gone = stored(edges.join(free.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        kept = free if kept is None else kept.unionByName(free)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        settled = free.unionByName(gone)
        edges = stored(edges.join(settled.withColumnRenamed("id", "a"), "a", "left_anti").join(settled.withColumnRenamed("id", "b"), "b", "left_anti"), "near-pairs")
    if dropped is None:
        return ids.withColumn("kept", F.lit(True))
    off = dropped.select(F.col("id").alias("__id")).distinct()
    return ids.join(off, ids[id_col] == off["__id"], "left").withColumn("kept", F.col("__id").isNull()).drop("__id")


def greedy_buckets(members: DataFrame) -> DataFrame:
    """ids kept by the sequential loop where all ids of a bucket are candidates of one another; members(id, bucket).

    Among the undecided, an id that is the least of all its buckets is kept and drops the others of these
    buckets.  No pair is made: each round costs the members still undecided.
    """
    live, kept = stored(members.select("id", "bucket").distinct(), "bucket-members"), None
    while not live.isEmpty():
        least = live.groupBy("bucket").agg(F.min("id").alias("least"))
        marked = live.join(least, "bucket")
        free = stored(marked.groupBy("id").agg(F.min((F.col("id") == F.col("least")).cast("int")).alias("all")).filter("all = 1").select("id"), "kept")
        gone = stored(marked.join(free.withColumnRenamed("id", "least"), "least", "left_semi").select("id").distinct(), "decided")
        kept = free if kept is None else kept.unionByName(free)
        live = stored(live.join(gone, "id", "left_anti"), "bucket-members")
    return kept if kept is not None else members.select("id").limit(0)


def minhash_dedup(docs: DataFrame, threshold: float = 0.85, *, id_col: str = "doc_id") -> DataFrame:
    """docs with `kept`, by LSH candidates in id order (candidates are not verified); documents without shingles are kept."""
    index = stored(lsh_index(docs, threshold, id_col=id_col).select(F.col(id_col).alias("id"), F.concat_ws("-", "band", "band_hash").alias("bucket")), "lsh-index")
    kept = greedy_buckets(index)
    gone = index.select("id").distinct().join(kept, "id", "left_anti").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left").withColumn("kept", F.col("__gone").isNull()).drop("__gone")


def exact_dup_keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct normalised text: hash, keep_id, copies."""
    return balanced(docs.select(id_col, text_col)).groupBy(F.md5(normalize_for_hash(text_col)).alias("text_hash")).agg(F.min(id_col).alias("keep_id"), F.count("*").alias("copies"))
