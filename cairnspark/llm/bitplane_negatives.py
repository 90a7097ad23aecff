"""Hard-negative mining by bit-sliced integer products.

Components become integers, and these the bit-planes of their two's complement. A score, the inner product with an
anchor, is added up plane by plane, the most significant first: after plane b, what the lower planes can still add to the
score of any row lies between (2**b - 1) times the sum of the anchor's negative components and (2**b - 1) times that of
its positive ones. A row is dropped for an anchor once this interval can't qualify: for positives, once its end is under
the k-th largest beginning among the anchor's candidates; for negatives, once it misses every window of allowed scores, or
ends under the k-th largest beginning that lies inside the window for sure. While many rows are left a plane is one matrix
product, afterwards it is gathered for the pairs that are left. Scores are exact integers.

Rows are dealt into groups of a bounded size by a hash, and each anchor visits every group, so a task holds one group of
rows and reads anchors batch by batch; the k best of each group meet in a window of a few rows for each group.

Defined results: a row with a null vec_id, label or vector, or with a null or non-finite component, takes no part; nor does
one whose d integers have d times the sum of their squares at 2**60 or more, as longs might not hold its intervals. A shorter vector counts as
padded by zeros. Rows that repeat a vec_id are rows of their own, and other rows of each other; each that is an anchor has
its own result. Where an anchor has no positive, or a positive no negative, there are no rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm._common import materialise, parallelism, small_batches

ANCHORS_OF, RELABELLED, LABELS = 50, 7, 10
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Rows of a group, and anchors that are worked on at once.
GROUP_ROWS, TILE = 16384, 64
#: Scores of admitted rows, and their intervals, fit a long.
MOST_SQUARES = float(1 << 60)
#: Pairs are gathered one by one once so small a share of them is left, so many at once.
SPARSE, PAIRS = 1 / 8, 1 << 15
_LEAST = np.iinfo(np.int64).min


def admitted(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label and v (integers) of the rows that take part, written down."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    some = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    floors = F.transform(x, lambda e: F.floor(e * scale).cast("double"))
    small = F.aggregate(floors, F.lit(0.0), lambda a, e: a + e * e) * F.size("embedding") < MOST_SQUARES
    fits = some.where(small).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda e: F.floor(e * scale).cast("int")).alias("v"))
    return materialise(fits.withColumn("row", F.monotonically_increasing_id()), "planes-rows")


# --- the kernel ---------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, padded by zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]] = flat
    return out


class Planes:
    """The bit-planes of a group of rows: the first is the sign, with a negative weight."""

    def __init__(self, v: np.ndarray):
        top = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1, 0).bit_length()
        self.bits = list(range(top, -1, -1))
        self.planes = [(v >> b & 1).astype(np.float32) for b in self.bits]

    def weight(self, k: int) -> int:
        return (-1 if k == 0 else 1) << self.bits[k]

    def rest(self, k: int) -> int:
        """The most that one component can still add after plane k."""
        return (1 << self.bits[k]) - 1


def scores_left(planes: Planes, anchors: np.ndarray, rows: slice, alive: np.ndarray | None, coarse, fine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of anchors and rows that can qualify; alive has the pairs to begin with, or None.

    coarse(begins, ends) takes the intervals of all pairs as matrices, fine(anchor, begins, ends) those of single pairs in
    the order of anchors; both tell which pairs can still qualify.
    """
    low, high = np.minimum(anchors, 0).sum(1)[:, None], np.maximum(anchors, 0).sum(1)[:, None]
    kind = np.float32 if int((high - low).max(initial=0)) < 1 << 24 else np.float64  # sums of a plane are exact
    a = anchors.astype(kind)
    total = np.zeros((len(anchors), rows.stop - rows.start), np.int64)
    alive = np.ones(total.shape, bool) if alive is None else alive
    i, j = np.zeros((2, 0), np.int64)
    gathered = False
    for k, plane in enumerate(planes.planes):
        own, rest = plane[rows], planes.rest(k)
        if not gathered:
            total += (a @ own.T.astype(kind, copy=False)).astype(np.int64) * planes.weight(k)
            alive &= coarse(total + low * rest, total + high * rest)
            if np.count_nonzero(alive) < SPARSE * alive.size or k == len(planes.planes) - 1:
                i, j = np.nonzero(alive)
                total, gathered = total[i, j], True
        else:
            for s in range(0, len(i), PAIRS):
                x, y = i[s : s + PAIRS], j[s : s + PAIRS]
                total[s : s + PAIRS] += np.einsum("ij,ij->i", a[x], own[y].astype(kind, copy=False)).astype(np.int64) * planes.weight(k)
        if gathered:
            keep = fine(i, total + low[i, 0] * rest, total + high[i, 0] * rest)
            i, j, total = i[keep], j[keep], total[keep]
    return i, j + rows.start, total


def _kth(n: int, anchor: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each of n anchors; the least long where there are fewer. anchor is in order."""
    out = np.full(n, _LEAST)
    values = values[np.lexsort([-values, anchor])]
    start = np.searchsorted(anchor, np.arange(n))
    has = np.bincount(anchor, minlength=n) >= k
    out[has] = values[start[has] + k - 1]
    return out


def _best(group: list[np.ndarray], score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group: higher scores first, then smaller ties."""
    order = np.lexsort([tie, -score, *group[::-1]])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([g[order][1:] != g[order][:-1] for g in group], axis=0)
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return order[rank < k]


def among_best(n: int, k: int):
    """Whether a score can be among its anchor's k best, of n anchors: for matrices, and for single pairs."""

    def coarse(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if begins.shape[1] < k:
            return np.ones(begins.shape, bool)
        at = begins.shape[1] - k
        return ends >= np.partition(begins, at, axis=1)[:, at, None]

    def fine(i: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return ends >= _kth(n, i, begins, k)[i]

    return coarse, fine


def among_inside(low: np.ndarray, high: np.ndarray, k: int):
    """Whether a score can be among the k best inside one of its anchor's windows, from low to high."""
    some = low <= high
    least = np.where(some, low, -_LEAST - 1).min(1)[:, None] if low.shape[1] else np.full((len(low), 1), -_LEAST - 1)
    most = np.where(some, high, _LEAST).max(1)[:, None] if low.shape[1] else np.full((len(low), 1), _LEAST)

    def coarse(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (ends >= least) & (begins <= most)

    def fine(i: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for w in range(low.shape[1]):
            lo, hi = low[i, w], high[i, w]
            sure = (begins >= lo) & (ends <= hi)
            cut = np.maximum(_kth(len(low), i[sure], begins[sure], k)[i], lo)
            out |= (ends >= cut) & (begins <= hi) & (lo <= hi)
        return out

    return coarse, fine


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scores that each anchor's windows are of, and their ends; empty ones where an anchor has fewer than others."""
    lists = column.to_pylist()
    most = max(map(len, lists), default=0)
    padded = [[*((w["of"], w["low"], w["high"]) for w in x), *[(0, 1, 0)] * (most - len(x))] for x in lists]
    out = np.array(padded, np.int64).reshape(len(lists), most, 3)
    return out[:, :, 0], out[:, :, 1], out[:, :, 2]


_FOUND = "row bigint, anchor_id bigint, of bigint, vec_id bigint, score bigint"


def _search(k: int, inside: bool):
    """Rows of a group (kind 0), then anchors (kind 1), to the k best rows of the group for each anchor, or each of its
    windows, which are known by the score that they are of."""

    def found(anchors: pa.RecordBatch, i: np.ndarray, of: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        best = _best([i, of], score, ids, k)
        own, name = (anchors.column(c).to_numpy()[i[best]] for c in ("row", "vec_id"))
        columns = (own, name, of[best], ids[best], score[best])
        return pa.record_batch([pa.array(x) for x in columns], [c.split()[0] for c in _FOUND.split(", ")])

    def visit(group: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchors = _matrix(batch.column("v"), group["v"].shape[1])
        if anchors.shape[1] > group["v"].shape[1]:
            group["v"] = np.pad(group["v"], ((0, 0), (0, anchors.shape[1] - group["v"].shape[1])))
            group.pop("planes", None)
        if "planes" not in group:
            group["planes"] = Planes(group["v"])
        label = batch.column("label").to_numpy()
        cuts = range(0, batch.num_rows, TILE)
        if not inside:  # anchors stand in the order of their labels, and meet the rows of one label at a time
            cuts = sorted({*cuts, *np.flatnonzero(label[1:] != label[:-1]) + 1})
        for t, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            tile, v = batch.slice(t, end - t), anchors[t:end]
            own = tile.column("row").to_numpy()[:, None]
            if not inside:
                mine = slice(*np.searchsorted(group["label"], [label[t], label[t] + 1]).tolist())
                i, j, score = scores_left(group["planes"], v, mine, None, *among_best(len(v), k + 1))
                other = own[i, 0] != group["row"][j]
                i, j, score = i[other], j[other], score[other]
                yield found(tile, i, np.zeros(len(i), np.int64), group["vec_id"][j], score)
                continue
            of, low, high = _windows(tile.column("windows"))
            others = label[t:end, None] != group["label"]
            i, j, score = scores_left(group["planes"], v, slice(0, len(group["row"])), others, *among_inside(low, high, k))
            at, w = np.nonzero((low[i] <= score[:, None]) & (score[:, None] <= high[i]))
            yield found(tile, i[at], of[i[at], w], group["vec_id"][j[at]], score[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group = [], None
        for batch in batches:
            split = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            if split:
                rows.append(batch.slice(0, split))
            if split < batch.num_rows and rows:
                if group is None:
                    table = pa.Table.from_batches(rows).sort_by("label")
                    group = {c: table[c].to_numpy() for c in ("row", "vec_id", "label")} | {"v": _matrix(table["v"].combine_chunks(), 0)}
                yield from visit(group, batch.slice(split))

    return run


def _visits(rows: DataFrame, anchors: DataFrame, groups: int, k: int, inside: bool) -> DataFrame:
    """The k best rows of each group for each anchor (or window): every anchor visits every group."""
    none = F.lit(None).cast("array<struct<of:bigint,low:bigint,high:bigint>>")
    fields = ("row", "vec_id", "label", "v")
    own = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"), F.lit(0).alias("kind"), *fields, none.alias("windows"))
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    guests = anchors.select(each.alias("part"), F.lit(1).alias("kind"), *fields, ("windows" if inside else none.alias("windows")))
    dealt = own.unionByName(guests).repartitionById(groups, F.col("part")).sortWithinPartitions("kind", "label")
    return dealt.mapInArrow(_search(k, inside), _FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k first rows by score and vec_id of what the groups have found, with their rank."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low_share: int = 50, high_share: int = 95, group_rows: int = GROUP_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from vec_id, embedding and label.

    Anchors are rows whose vec_id is divisible by 50, positives the first rows of the same label by score, and negatives
    the first rows of other labels whose score is low_share to high_share hundredths of the positive's. Where vec_id is
    divisible by 7 the label is first moved on by one. Steps are written to the shared folder.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = admitted(vectors)
    groups = max(parallelism(spark), -(-rows.count() // group_rows))
    anchors = rows.where(F.col("vec_id") % ANCHORS_OF == 0)
    near = _first(_visits(rows, anchors, groups, positives, False), ["row"], positives)
    near = near.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = materialise(near, "planes-positives")
    # hundredths of the score, by its quotient and remainder, so that no product leaves the range of a long
    p = F.col("positive_score")
    whole, rest = F.call_function("div", p, F.lit(100).cast("long")), p % 100
    low, high = whole * low_share + F.ceil(rest * low_share / 100), whole * high_share + F.floor(rest * high_share / 100)
    window = F.struct(p.alias("of"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    windows = near.select("row", window.alias("window")).where("window.low <= window.high").groupBy("row").agg(F.collect_set("window").alias("windows"))
    asking = materialise(anchors.join(windows, "row"), "planes-asking")
    far = _first(_visits(rows, asking, groups, negatives, True), ["row", "of"], negatives)
    far = far.select("row", F.col("of").alias("positive_score"), "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.row <> b.row),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM scores WHERE same QUALIFY place <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scores n ON p.row = n.row AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""
