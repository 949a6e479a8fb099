"""Hard negatives by exact integer inner products of anchors against all rows.

Vectors are quantised to integers once and staged. Anchors are taken in blocks of bounded
bytes; each block goes to the tasks and meets every row of the table there, tile by tile.
A tile of scores is one matrix product by Strassen's recursion on int64, zero padded to
even sides. Two walks over the rows are needed, as the window of a negative hangs on the
score of the positive: the first multiplies rows with the anchors of their own labels and
keeps a heap of positives for each anchor, the second multiplies them with the anchors of
other labels and keeps a heap for each window. A task hands on its heaps only, and heaps
of the tasks are merged by Spark, so no scores are shuffled.

Integer sums and products wrap at 64 bits and Strassen's identities hold in that ring, so
a score is exact whenever it fits a long, whatever the sums within were.

Defined results: rows with a null label, a null vector or a null or non-finite component
take no part; a component beyond a long saturates; vectors of other lengths are padded
with zeros, an empty one is all zeros; a null vec_id is never an anchor and comes last
among ties; rows that repeat a vec_id are rows of their own; an anchor without a positive,
or a positive without a negative in its window, has no row; columns of other names are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import staged

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's: at least, at most.
LOW, HIGH = 30, 90
#: Bytes of an anchor block and of a tile of rows; rows that a task sorts by label at a time.
BLOCK_BYTES, TILE_BYTES, RUN_BYTES = 4 << 20, 2 << 20, 16 << 20
#: Sides below which a product is taken directly.
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices, wrapping at 64 bits. Sides are padded with zeros to even ones."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= LEAF:
        return _direct(a, b)
    if n % 2 or k % 2 or m % 2:
        a, b = np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = m1 + m4 - m5 + m7
    out[:i, l:] = m3 + m5
    out[i:, :l] = m2 + m4
    out[i:, l:] = m1 - m2 + m3 + m6
    return out[:n, :m]


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of a leaf: in doubles where every partial sum is an integer below 2**53, so
    nothing is rounded; else in int64."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    top = [max(-int(x.min()), int(x.max())) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


class Heaps:
    """The first ``size`` entries of every group by falling score, then id (none last), then row.

    ``push`` takes any entries of any groups; heaps of two tasks merge by pushing one's
    entries into the other. ``worst`` is the score that a new entry of a full heap must reach.
    """

    def __init__(self, groups: int, size: int):
        self.groups, self.size = groups, size
        self.group = np.zeros(0, np.int64)
        self.score, self.none, self.id, self.row = (np.zeros(0, t) for t in (np.int64, bool, np.int64, np.int64))
        self.worst = np.full(groups, np.iinfo(np.int64).min)
        self.full = np.zeros(groups, bool)

    def push(self, group: np.ndarray, score: np.ndarray, none: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        own = [np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.none, none), (self.id, id_), (self.row, row))]
        order = np.lexsort((own[4], own[3], own[2], ~own[1], own[0]))
        sorted_group = own[0][order]
        first = np.searchsorted(sorted_group, sorted_group)
        order = order[np.arange(len(order)) - first < self.size]
        self.group, self.score, self.none, self.id, self.row = (x[order] for x in own)
        held = np.bincount(self.group, minlength=self.groups)
        self.full = held == self.size
        last = np.flatnonzero(np.append(self.group[1:] != self.group[:-1], True))
        at = self.group[last]
        self.worst[at] = np.where(self.full[at], self.score[last], self.worst[at])


def _reach(scores: np.ndarray, allowed: np.ndarray, heaps: Heaps, groups: np.ndarray) -> np.ndarray:
    """Which of ``scores`` (a row per heap) may enter its heap. Where the heap is not full yet, the
    score of rank ``size`` within the row bounds it; ties stay in."""
    floor = heaps.worst[groups].copy()
    if scores.shape[1] > heaps.size:
        r = np.flatnonzero(~heaps.full[groups] & (allowed.sum(axis=1) > 4 * heaps.size))
        seen = np.where(allowed[r], scores[r], np.iinfo(np.int64).min)
        floor[r] = np.partition(seen, -heaps.size, axis=1)[:, -heaps.size]
    return allowed & (scores >= floor[:, None])


def vectors(embeddings: DataFrame, scale: int = 256, relabel: int | None = None) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, ``v`` the integers floor(scale * x).
    ``row`` tells rows apart that share a vec_id. With ``relabel``, the label of every vec_id that
    it divides becomes (label + 1) % 10."""
    label = F.col("label").cast("bigint")
    if relabel:
        moved = F.pmod(F.col("vec_id"), F.lit(relabel)) == 0
        label = F.when(moved, (label + 1) % 10).otherwise(label)
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return (embeddings.where(F.col("label").isNotNull() & x.isNotNull() & finite)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
            .withColumn("row", F.monotonically_increasing_id()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of ``width``, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    size, start = np.diff(ends), ends[:-1] - ends[0]
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(start, size)
    out[np.repeat(np.arange(len(size)), size), place] = flat
    return out


class _Rows:
    """Rows of a batch or a block, sorted by label and then in the order of ties."""

    def __init__(self, part: pa.RecordBatch | pa.Table, width: int):
        one = lambda n: part.column(n).to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else part.column(n).to_numpy()
        none = np.asarray(part.column("vec_id").is_null())
        ids = np.asarray(part.column("vec_id").fill_null(0)).astype(np.int64)
        label, row = one("label").astype(np.int64), one("row").astype(np.int64)
        order = np.lexsort((row, ids, none, label))
        self.none, self.id, self.label, self.row = none[order], ids[order], label[order], row[order]
        self.v = _matrix(part.column("v"), width)[order]


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Rows]:
    """The rows of a task in sorted runs of at most ``RUN_BYTES``."""
    most, held, n = max(1, RUN_BYTES // (8 * max(width, 1))), [], 0
    for b in batches:
        for lo in range(0, b.num_rows, most):
            part = b.slice(lo, most)
            if n and n + part.num_rows > most:
                yield _Rows(pa.Table.from_batches(held), width)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield _Rows(pa.Table.from_batches(held), width)


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[_Rows, slice]]:
    most = max(1, TILE_BYTES // (8 * max(width, 1)))
    for run in _runs(batches, width):
        for lo in range(0, len(run.row), most):
            yield run, slice(lo, min(lo + most, len(run.row)))


#: Scores that a tile holds at a time.
MAX_SCORES = 1 << 20


def _products(anchors: _Rows, run: _Rows, at: slice, use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor numbers, their scores with the tile) in pieces of bounded size."""
    step = max(1, MAX_SCORES // (at.stop - at.start))
    right = np.ascontiguousarray(run.v[at].T)
    for lo in range(0, len(use), step):
        mine = use[lo:lo + step]
        yield mine, strassen(anchors.v[mine], right)


def _positives(rows: DataFrame, held, width: int, size: int) -> DataFrame:
    """(row, p_score, p_none, p_id, p_row) of each task: its heaps of positives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = held.value
        heaps = Heaps(len(anchors.row), size)
        for tile, at in _tiles(batches, width):
            label, row = tile.label[at], tile.row[at]
            use = np.arange(*np.searchsorted(anchors.label, [label[0], label[-1] + 1]))
            for mine, scores in _products(anchors, tile, at, use):
                same = (anchors.label[mine, None] == label) & (anchors.row[mine, None] != row)
                a, c = np.nonzero(_reach(scores, same, heaps, mine))
                heaps.push(mine[a], scores[a, c], tile.none[at][c], tile.id[at][c], row[c])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (anchors.row[heaps.group], heaps.score, heaps.none, heaps.id, heaps.row)],
            ["row", "p_score", "p_none", "p_id", "p_row"])

    return rows.mapInArrow(run, "row bigint, p_score bigint, p_none boolean, p_id bigint, p_row bigint")


def _negatives(rows: DataFrame, held, width: int, size: int) -> DataFrame:
    """(row, score, none, id, n_row) of each task: what is in any of an anchor's window heaps, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, some, low, high = held.value  # a row per anchor, a column per positive
        n, k = some.shape
        heaps = Heaps(n * k, size)
        for tile, at in _tiles(batches, width):
            label, row = tile.label[at], tile.row[at]
            use = np.flatnonzero(some.any(axis=1) & ((label[0] != label[-1]) | (anchors.label != label[0])))
            for mine, scores in _products(anchors, tile, at, use):
                other = anchors.label[mine, None] != label
                for j in range(k):
                    has = some[mine, j]
                    if not has.any():
                        continue
                    group, own = mine[has] * k + j, scores[has]
                    within = other[has] & (own >= low[mine[has], j][:, None]) & (own <= high[mine[has], j][:, None])
                    a, c = np.nonzero(_reach(own, within, heaps, group))
                    heaps.push(group[a], own[a, c], tile.none[at][c], tile.id[at][c], row[c])
        anchor = heaps.group // max(k, 1)
        order = np.lexsort((heaps.row, anchor))
        once = order[np.append(True, (np.diff(anchor[order]) != 0) | (np.diff(heaps.row[order]) != 0))[:len(order)]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[once]) for x in (anchors.row[anchor], heaps.score, heaps.none, heaps.id, heaps.row)],
            ["row", "score", "none", "id", "n_row"])

    return rows.mapInArrow(run, "row bigint, score bigint, none boolean, id bigint, n_row bigint")


# A positive's window in whole scores. p = 100 * h + r with r in 0..99, so that no product overflows.
_H, _R = "(p_score div 100 - if(p_score % 100 < 0, 1, 0))", "pmod(p_score, 100)"
_LEAST = f"{_H} * {LOW} + ({_R} * {LOW} + 99) div 100 AS least"
_MOST = f"{_H} * {HIGH} + {_R} * {HIGH} div 100 AS most"

OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         scale: int = 256, relabel: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): anchors are the rows
    whose vec_id ``every`` divides. A block of anchors has at most ``block_bytes`` of vectors, which is
    all that a task is sent; the rows are walked twice for each block."""
    spark = embeddings.sparkSession
    rows = staged(vectors(embeddings, scale, relabel), "vectors")
    is_anchor = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    n, width = rows.agg(F.count(F.when(is_anchor, F.lit(1))), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    blocks = -(-n * 8 * max(width, 1) // block_bytes)
    block = F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)))
    anchors = staged(rows.where(is_anchor).withColumn("block", block.cast("int")), "anchors")
    out = None
    for b in range(blocks):
        own = _Rows(anchors.where(F.col("block") == b).drop("block").toArrow(), width)
        held = spark.sparkContext.broadcast(own)
        first = Window.partitionBy("row").orderBy(F.col("p_score").desc(), "p_none", "p_id", "p_row")
        ranked = (_positives(rows, held, width, positives).withColumn("p", F.row_number().over(first))
                  .where(F.col("p") <= positives).selectExpr("*", _LEAST, _MOST))
        pos = staged(ranked, "positives")
        some, low, high = (np.zeros((len(own.row), positives), t) for t in (bool, np.int64, np.int64))
        number = {int(r): i for i, r in enumerate(own.row)}
        for r in pos.select("row", "p", "least", "most").collect():  # a block's anchors times ``positives``
            at = number[r["row"]], r["p"] - 1
            some[at], low[at], high[at] = True, r["least"], r["most"]
        windows = spark.sparkContext.broadcast((own, some, low, high))
        part = staged(_ranked(_negatives(rows, windows, width, negatives), pos, anchors, negatives), "negatives")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], OUT)


def _ranked(found: DataFrame, pos: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """The heaps of all tasks merged: each window's first ``size`` rows of what any task kept."""
    order = Window.partitionBy("row", "p").orderBy(F.col("score").desc(), "none", "id", "n_row")
    named = lambda none, x: F.when(~F.col(none), F.col(x))
    return (found.join(pos, "row").where(F.col("score").between(F.col("least"), F.col("most")))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
            .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", named("p_none", "p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    named("none", "id").alias("negative_id"), F.col("p_score").alias("positive_score"),
                    F.col("score").alias("negative_score")))
