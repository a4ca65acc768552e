"""Hard negatives by a pivot table.

A vector x gets one more component, sqrt(M - |x|^2) with M the largest squared length, and an anchor q gets 0: then
|q' - x'|^2 = |q|^2 + M - 2 <q, x>, so the order of inner products is that of Euclidean distances.  The distances of
every row to a few pivots are stored with the row; by the triangle inequality they bracket the distance of any anchor
and row, and so their score, without their components.

Rows lie in blocks of BLOCK_ROWS, sorted by label and nearest pivot, with the range of their pivot distances; anchors
lie in smaller blocks.  Pairs of blocks meet in a join on a group number, so neither side is ever whole in one place:
first those that no bound rules out by the blocks' ranges, then inside a pair the rows that no bracket rules out, and
of these the score is exact.  The first round looks at each anchor block's most promising row block and leaves every
anchor a score to beat; the second meets all that are left.

Two searches: the positives (best rows of the anchor's label), then, with a band of scores for each positive, the
negatives (best rows of other labels inside the band).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources.scratch import stored

PIVOTS, SAMPLE = 8, 256
BLOCK_ROWS, BLOCK_ANCHORS = 2048, 256
BLOCK_SCHEMA = "block long, n int, label_lo long, label_hi long, ids array<long>, labels array<long>, v array<double>, norm array<double>, d array<double>, d_lo array<double>, d_hi array<double>"
#: Largest component for which inner products are exact in doubles, for up to 2^13 components.
_EXACT = 1 << 20
_LONG = (1 << 63) - 1


def usable(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (floor of 256 times each component) of the rows that take part."""
    v = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, _floor256).alias("v"))


def _floor256(x: Column) -> Column:
    """floor(256 x) as a double, also beyond the longs: such a double has no fraction."""
    y = x.cast("double") * 256
    return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)


def choose_pivots(rows: DataFrame, dims: int, largest: float, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Augmented pivots, each the farthest from those before it, of a sample of at most `sample` rows chosen by hash of the id."""
    some = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").toArrow()
    x = augmented(padded(some.column(0).combine_chunks(), dims), largest)
    if not len(x):
        return np.zeros((0, dims + 1))
    chosen, away = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < pivots and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def padded(lists: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix; components that a shorter vector lacks are 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offs = lists.offsets.to_numpy()
    sizes, flat = np.diff(offs), lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0.0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.linalg.norm(x - p, axis=1) for p in pivots])


def blocks(rows: DataFrame, size: int, dims: int, pivots: np.ndarray, largest: float, anchor: bool, name: str) -> DataFrame:
    """The stored pivot table: rows(id, label, v) in blocks sorted by label and nearest pivot, with their distances to the pivots.

    Anchors' rows(id, label, v, home_block, home_at) keep their place among all rows, to be left out of their own results.
    """
    own = ["home_block", "home_at"] if anchor else []

    def aug(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))]) if anchor else augmented(x, largest)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(aug(padded(batch.column(2), dims)), pivots)
            yield pa.record_batch([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32) if d.size else np.zeros(batch.num_rows, np.int32))], names=[*batch.schema.names, "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held, number = [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def out(table: pa.Table, k: int) -> pa.RecordBatch:
            x = padded(table.column("v"), dims)
            d, labels = distances(aug(x), pivots), table.column("label").to_numpy()
            one = lambda a, kind: pa.array([np.asarray(a).ravel()], pa.list_(kind))
            more = [one(table.column(c).to_numpy(), pa.int64()) for c in own]
            return pa.record_batch([
                pa.array([first + k], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([int(labels.min())], pa.int64()), pa.array([int(labels.max())], pa.int64()), one(table.column("id").to_numpy(), pa.int64()), one(labels, pa.int64()),
                one(x, pa.float64()), one((x * x).sum(axis=1), pa.float64()), one(d, pa.float64()), one(d.min(axis=0), pa.float64()), one(d.max(axis=0), pa.float64()), *more,
            ], names=[*("block n label_lo label_hi ids labels v norm d d_lo d_hi".split()), *own])

        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            while rows_held >= size:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, size), number)
                number, held, rows_held = number + 1, table.slice(size).to_batches(), rows_held - size
        if rows_held:
            yield out(pa.Table.from_batches(held), number)

    kinds = ", ".join(f"{c} long" for c in own)
    placed = rows.mapInArrow(near, "id long, label long, v array<double>, " + (kinds + ", " if own else "") + "cell int")
    order = ["label", "cell", F.xxhash64("id", "v"), "id"]
    parts = max(1, rows.count() // (4 * size))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts)
    return stored(ranged.mapInArrow(pack, BLOCK_SCHEMA + "".join(f", {c} array<long>" for c in own)), name)


def bounds(q_norm: np.ndarray, q_d: np.ndarray, d: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Brackets of the scores of all anchors and rows from their distances to the pivots, a little widened for rounding."""
    near = np.zeros((len(q_d), len(d)))
    far = np.full((len(q_d), len(d)), np.inf)
    for p in range(d.shape[1]):
        a, b = q_d[:, p, None], d[None, :, p]
        np.maximum(near, np.abs(a - b), out=near)
        np.minimum(far, a + b, out=far)
    whole = (q_norm + largest)[:, None]
    slack = 1e-9 * whole + 1
    low, high = (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)  # squares beyond the doubles bound nothing


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; where doubles are not exact, Python's integers, held at the ends of the longs."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) <= _EXACT and q.shape[1] <= 1 << 13:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(c) for c in r] for r in a.tolist()], object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, -_LONG, _LONG).astype(np.int64)


def search(anchors: DataFrame, rows: DataFrame, wanted: DataFrame, k: int, dims: int, largest: float, same_label: bool, name: str) -> DataFrame:
    """anchor block and place (a_block, a_at), band, id, score, rank: the k best rows of each band, of the anchors' label or of all others.

    wanted(a_block, bands): for an anchor block its bands (a_at, band, lo, hi), scores from lo to hi.
    """
    spark = anchors.sparkSession
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count()))
    result = "a_block long, a_at int, band int, id long, score long"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, r, w = ({k: x[i].values for k, x in zip(batch.schema.names, batch.columns) if k.startswith(s) and isinstance(x[i], pa.ListScalar)} for s in ("a_", "r_", "bands"))
                q, x = a["a_v"].to_numpy().reshape(-1, dims), r["r_v"].to_numpy().reshape(-1, dims)
                spots, band, lo, hi, least = (c.to_numpy(zero_copy_only=False) for c in w["bands"].flatten())
                labels, ids = r["r_labels"].to_numpy(), r["r_ids"].to_numpy()
                used, where = np.unique(spots, return_inverse=True)
                n_pivots = len(a["a_d"]) // len(q)
                low, high = bounds(a["a_norm"].to_numpy()[used], a["a_d"].to_numpy().reshape(-1, n_pivots)[used], r["r_d"].to_numpy().reshape(-1, n_pivots), largest)
                alike = a["a_labels"].to_numpy()[used][:, None] == labels[None]
                allowed = alike if same_label else ~alike
                block = batch.column("r_block")[i].as_py()
                home = np.flatnonzero(a["a_home_block"].to_numpy()[used] == block)
                allowed[home, a["a_home_at"].to_numpy()[used][home]] = False
                # a row survives where its bracket meets a band of the anchor above the score to beat
                by = np.argsort(where, kind="stable")
                meets = (high[where[by]] >= np.maximum(lo, least)[by, None]) & (low[where[by]] <= hi[by, None])
                live = np.logical_or.reduceat(meets, np.searchsorted(where[by], np.arange(len(used))), axis=0) & allowed
                columns = np.flatnonzero(live.any(axis=0))
                if not len(columns):
                    continue
                order = columns[np.argsort(ids[columns], kind="stable")]
                score = exact_scores(q[used], x[order])
                live = live[:, order]
                parts = []
                for j in range(len(spots)):
                    s = score[where[j]]
                    fits = np.flatnonzero(live[where[j]] & (s >= lo[j]) & (s <= hi[j]))
                    if len(fits) > k:
                        cut = np.partition(s[fits], len(fits) - k)[len(fits) - k]
                        fits = fits[s[fits] >= cut]
                        fits = fits[np.argsort(-s[fits], kind="stable")][:k]  # in order of id among equals
                    parts.append((np.full(len(fits), spots[j]), np.full(len(fits), band[j]), ids[order[fits]], s[fits]))
                at, of, ident, value = (np.concatenate(c) for c in zip(*parts))
                yield pa.record_batch([pa.array(np.full(len(at), batch.column("a_block")[i].as_py(), np.int64)), pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(ident), pa.array(value)], names=["a_block", "a_at", "band", "id", "score"])

    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    heads = lambda df, s: df.select(*[f"{s}_{c}" for c in ("block", "label_lo", "label_hi", "d_lo", "d_hi")])
    label = (F.col("a_label_lo") <= F.col("r_label_hi")) & (F.col("r_label_lo") <= F.col("a_label_hi")) if same_label else ~((F.col("a_label_lo") == F.col("a_label_hi")) & (F.col("r_label_lo") == F.col("r_label_hi")) & (F.col("a_label_lo") == F.col("r_label_lo")))
    gap = F.coalesce(F.array_max(F.zip_with(F.zip_with("a_d_lo", "r_d_hi", lambda x, y: x - y), F.zip_with("r_d_lo", "a_d_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))), F.lit(0.0))  # no distance between the blocks is less
    by_group = lambda df, s: df.withColumn("g", F.pmod(F.xxhash64(f"{s}_block"), F.lit(groups)))
    spread = lambda df: df.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    # the most promising row block of each anchor block, by the blocks' heads alone
    firsts = by_group(heads(right, "r"), "r").join(spread(heads(left, "a")), "g").filter(label)
    firsts = stored(firsts.groupBy("a_block").agg(F.min_by("r_block", F.struct(gap, F.xxhash64("a_block", "r_block"))).alias("first")), f"{name}-first")
    best = Window.partitionBy("a_block", "a_at", "band").orderBy(F.desc("score"), "id")
    floor = F.lit(-_LONG)
    fresh = wanted.withColumn("bands", F.transform("bands", lambda b: F.struct(b["a_at"], b["band"], b["lo"], b["hi"], floor.alias("least"))))
    one = left.join(fresh, "a_block").join(firsts, "a_block").join(right, F.col("first") == F.col("r_block"))
    columns = [*(f"a_{c}" for c in ("block", "labels", "v", "norm", "d", "home_block", "home_at")), *(f"r_{c}" for c in ("block", "ids", "labels", "v", "d")), "bands"]
    seen = stored(one.select(*columns).mapInArrow(meet, result), f"{name}-seen")
    beaten = seen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("a_block", "a_at", "band", F.col("score").alias("least"))
    flat = wanted.select("a_block", F.explode("bands").alias("b")).select("a_block", "b.*").join(beaten, ["a_block", "a_at", "band"], "left")
    again = flat.groupBy("a_block").agg(F.collect_list(F.struct("a_at", "band", "lo", "hi", F.coalesce("least", floor).alias("least"))).alias("bands"), F.min(F.greatest("lo", F.coalesce("least", floor))).alias("need"))
    norm = F.array_max("a_norm")
    fit = (norm + largest - gap * gap) / 2 + 1e-9 * (norm + largest) + 1 >= F.col("need")
    rest = by_group(right, "r").join(spread(left.join(again, "a_block").join(firsts, "a_block")), "g").filter(label & (F.col("r_block") != F.col("first")) & fit)
    found = seen.unionByName(rest.select(*columns).mapInArrow(meet, result))
    return stored(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), name)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on id and label.  A row's score is its inner product with the anchor, of components
    floor(256 x); higher scores come first, then smaller ids.  Negatives n of a positive p satisfy
    low * p <= 100 * n <= high * p.  Rows with a null id, label or vector or a component that is null or not finite take
    no part.  A repeated row is a row of its own (an anchor leaves out itself only).  Components that a shorter vector
    lacks count as 0; scores beyond the longs are held at their ends.  Other columns are not read.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sound = stored(usable(rows, id_col=id_col, vec_col=vec_col, label_col=label_col), "vectors")
    size = sound.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if size[0] is None:
        return spark.createDataFrame([], result)
    dims, largest = max(1, size[0]), float(size[1])
    chosen = choose_pivots(sound, dims, largest, pivots)
    table = blocks(sound, block_rows, dims, chosen, largest, False, "pivot-table")
    each = table.select(F.col("block").alias("home_block"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.cast("long").alias("home_at"), F.get("ids", i).alias("id"), F.get("labels", i).alias("label"), F.slice("v", i * dims + 1, F.lit(dims)).alias("v")))).alias("x"))
    anchors = blocks(each.select("x.id", "x.label", "x.v", "home_block", "x.home_at").filter(is_anchor), block_anchors, dims, chosen, largest, True, "anchors")
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("a_at"), F.lit(0).alias("band"), F.lit(-_LONG).alias("lo"), F.lit(_LONG).alias("hi")))
    best = search(anchors, table, anchors.select(F.col("block").alias("a_block"), every.alias("bands")), positives, dims, largest, True, "positives")
    # 100 n >= low p and 100 n <= high p over the integers
    p = F.col("score").cast("decimal(38,0)")
    lo, hi = F.ceil(p * low / 100), F.floor(p * high / 100)
    bands = best.select("a_block", F.struct("a_at", F.col("rank").alias("band"), F.greatest(lo, F.lit(-_LONG)).cast("long").alias("lo"), F.least(hi, F.lit(_LONG)).cast("long").alias("hi")).alias("b")).filter("b.lo <= b.hi")
    found = search(anchors, table, bands.groupBy("a_block").agg(F.collect_list("b").alias("bands")), negatives, dims, largest, False, "negatives")
    names = anchors.select(F.col("block").alias("a_block"), F.posexplode("ids").alias("a_at", "anchor_id"))
    pairs = best.select("a_block", "a_at", F.col("rank").alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["a_block", "a_at", "band"]).join(names, ["a_block", "a_at"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: anchors are the rows with vec_id divisible by 50; where it is divisible by 7, the label first moves on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(moved, F.col("id") % 50 == 0)
