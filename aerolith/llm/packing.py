"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens; only the histogram of their
lengths (``capacity`` numbers, whatever the corpus) goes to the driver. There each bin is
seeded with the longest length left, and a bitset subset-sum over the available lengths
finds the fullest feasible combination, which is removed. As the same combination stays
the fullest while its pieces last, it is removed as often as they allow in one step, so
the plan has a few thousand rows at most. Spark then numbers all pieces by length, dealt by
ranges that split a common length or a repeated row like any other, and each number looks
up its place.

Defined results: a null or empty text is one piece holding the end id; repeated rows are
packed as often as they occur; a null doc_id is kept; an empty table gives no pieces; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import free_name, ranked, staged
from aerolith.llm.common import pieces as slices
from aerolith.llm.tokens import encoder

CAPACITY = 1024


def cut(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text. The first
    piece of a longer document takes the remainder, all others are full."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "text"):
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for r, ids in enumerate(enc.encode(b.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    part = ids[4 * lo:4 * hi]
                    row.append(r), piece.append(k), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(part))
                    if keep_ids:
                        raw.append(part)
            cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * keep_ids,
                                             ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """[(length, copies)] of the available lengths whose sum is the largest up to ``room``.

    Bit s of ``reach`` says that the lengths tried so far can sum to s. ``steps`` keeps
    the sums that each (length, copies) added, which leads back to the combination.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        layer = reach
        for copies in range(1, min(counts[size], room // size) + 1):
            layer = layer << size & mask
            new = layer & ~reach
            if not layer:
                break
            if new:
                steps.append((size, copies, new))
        for s, _, new in reversed(steps):
            if s != size:
                break
            reach |= new
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, []
    while total:
        size, copies = next((s, c) for s, c, new in steps if new >> total & 1)
        found.append((size, copies))
        total -= size * copies
    return found


def min_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, copies in each bin)])] that uses up all pieces."""
    left, plan = {s: n for s, n in counts.items() if n}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        bin_ = dict(fullest({s: n for s, n in left.items() if n}, capacity - seed))
        left[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[s] // c for s, c in bin_.items())
        for s, c in bin_.items():
            left[s] -= c * times
            if not left[s]:
                del left[s]
        plan.append((times, sorted(bin_.items(), reverse=True)))
    return plan


def pack(cut_rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_rows`` (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut_rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, used = {s: [] for s in counts}, dict.fromkeys(counts, 0)
    base, before = {}, 0
    for s in sorted(counts):
        base[s], before = before, before + counts[s]
    seq = 0
    for times, bin_ in min_bin_slack(counts, capacity):
        at = 0
        for size, copies in bin_:
            first[size].append((used[size], copies, seq, at))
            used[size] += copies * times
            at += size * copies
        seq += times
    # at most (plan rows) x (different lengths that fit in a bin) entries: bounded by the capacity
    held = cut_rows.sparkSession.sparkContext.broadcast(({s: np.array(p, np.int64) for s, p in first.items()}, base))

    row, rank_of = free_name(cut_rows, "row"), free_name(cut_rows, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, starts = held.value
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column(rank_of).to_numpy()
            seq_id, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                mine, plan = size == s, plans[int(s)]
                own = rank[mine] - 1 - starts[int(s)]  # among the pieces of its length, from 0
                at = plan[np.searchsorted(plan[:, 0], own, "right") - 1]
                k = own - at[:, 0]
                seq_id[mine], offset[mine] = at[:, 2] + k // at[:, 1], at[:, 3] + k % at[:, 1] * s
            names = [c for c in b.schema.names if c not in (row, rank_of)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(seq_id), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    numbered = cut_rows.withColumn(row, F.monotonically_increasing_id())
    placed = ranked(numbered, [F.col("length").asc(), F.col("doc_id").asc(), F.col("piece").asc(), F.col(row).asc()], rank_of)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_rows.schema)
    return placed.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its place; the pieces are staged, so texts are encoded once."""
    return pack(staged(cut(docs, tokenizer, end_id, capacity, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences, ids as little-endian uint32 bytes."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
            .select("sequence_id", "n_tokens", joined.alias("ids")))
