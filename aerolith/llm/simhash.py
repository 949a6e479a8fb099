"""SimHash near-duplicate classes with BK-trees.

Fingerprints: 64 majority bits over the XXH64 values of a text's word shingles. Two
rows are linked if their fingerprints differ in at most ``radius`` (2) bits; a class is
a connected component of those links.

Equal fingerprints are collapsed first, so a group of copies is one fingerprint however
many rows it has. Distinct fingerprints are dealt into shards: the 64 bits are cut into
four blocks, and two fingerprints within 2 bits agree on two whole blocks, so they meet in
at least one of the six shards named by a pair of blocks and its bits. A shard with more
than ``MAX_SHARD`` fingerprints is dealt again by pairs of the four quarters of its other
32 bits, after which it can hold 2^16 different fingerprints at most: no group is unbounded
and no pair is lost. In each shard a BK-tree is built (children keyed by their integer
distance to the parent) and searched along the edges within the radius only. A shard
returns one link per fingerprint (to the smallest of its local component), never all pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any other;
null doc_ids stay rows but are never a class id unless the class has no other; repeated
rows are members of the same class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import keyed, pieces, rows_of, staged
from aerolith.llm.components import connected

MAX_SHARD = 20_000
SEED = 42


def text_fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """uint64 SimHash of each text (see module docstring)."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        w = (text or "").encode("utf-8", "replace").lower().split()
        if not w:
            continue
        joined = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = max(len(w) - words + 1, 1)
        cut = zip(starts[:n].tolist(), ends[len(w) - n:].tolist(), strict=True)
        hashes += [digest(joined[s:e], SEED) for s, e in cut]
        sizes[k] = n
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    values = np.array(hashes, np.uint64)
    counts = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for lo in range(0, len(values), 1 << 16):
        part, of = values[lo:lo + (1 << 16)], owner[lo:lo + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        counts[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    on = 2 * counts > sizes[:, None]
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, row_key, fp): the fingerprint of every whole text as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fp = text_fingerprints(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(fp.view(np.int64))],
                                             ["doc_id", "row_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(run, f"doc_id {kind}, row_key bigint, fp bigint")


class BKTree:
    """BK-tree over distinct uint64 fingerprints; ``kids[i]`` maps a distance to a child."""

    def __init__(self, values: np.ndarray):
        self.values, self.kids = values, [{} for _ in values]
        todo = [np.arange(len(values))]
        while todo:
            members = todo.pop()
            root, rest = members[0], members[1:]
            if not len(rest):
                continue
            dist = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(dist, kind="stable")
            rest, dist = rest[order], dist[order]
            cuts = np.flatnonzero(np.diff(dist)) + 1
            for group, d in zip(np.split(rest, cuts), dist[np.concatenate(([0], cuts))], strict=True):
                self.kids[root][int(d)] = group[0]
                todo.append(group)

    def components(self, radius: int) -> np.ndarray:
        """Index of the first member of each value's component, all values being
        searched at once: a node passes on only the queries whose distance to it is
        within the radius of the edge."""
        label = np.arange(len(self.values))
        while True:
            before = label.copy()
            todo = [(0, np.arange(len(self.values)))]
            while todo:
                node, ask = todo.pop()
                dist = np.bitwise_count(self.values[ask] ^ self.values[node]).astype(np.int16)
                near = ask[dist <= radius]
                if len(near) > 1:
                    label[near] = label[near].min()
                for d, child in self.kids[node].items():
                    go = ask[np.abs(dist - d) <= radius]
                    if len(go):
                        todo.append((child, go))
            if (label == before).all():
                return label


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None  # the shard that the next batch may go on with

        def links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = BKTree(fp).components(radius)
            moved = first != np.arange(len(fp))
            return fp[moved], fp[first[moved]]

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("pair", "bits", "pair2", "bits2")], axis=1).astype(np.int64)
            fp = b.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found = []
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)])), strict=True):
                if key is not None and (keys[lo] != key).any():
                    group = np.concatenate(held)
                    if len(group) > 1:
                        found.append(links(group))
                    held = []
                held.append(fp[lo:hi])
                key = keys[lo]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["a", "b"])
        if held and len(group := np.concatenate(held)) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links(group)], ["a", "b"])

    return run


def _pairs(blocks: list[int], width: int) -> list[int]:
    """Masks (as signed longs) of every pair of the blocks starting at these bits."""
    one = [((1 << width) - 1) << at for at in blocks]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(one, 2))]


def links(distinct: DataFrame, radius: int = 2, max_shard: int = MAX_SHARD) -> DataFrame:
    """(a, b): enough links within the radius to connect every class of ``distinct.fp``."""
    if radius > 2:
        raise ValueError("the shards find pairs of at most 2 differing bits")
    dealt = lambda masks, p, v: F.posexplode(
        F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias(p, v)
    first = _pairs([0, 16, 32, 48], 16)
    shards = distinct.select("fp", dealt(first, "pair", "bits"))
    sizes = shards.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(shards.join(sizes, ["pair", "bits"]), "simhash-shards")
    small = shared.where(F.col("n") <= max_shard).select(
        "fp", "pair", "bits", F.lit(-1).alias("pair2"), F.lit(0).cast("long").alias("bits2"))
    parts = [small]
    for p, blocks in enumerate(combinations([0, 16, 32, 48], 2)):
        free = [at + half for at in (0, 16, 32, 48) if at not in blocks for half in (0, 8)]
        parts.append(shared.where((F.col("n") > max_shard) & (F.col("pair") == p))
                     .select("fp", "pair", "bits", dealt(_pairs(free, 8), "pair2", "bits2")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    keys = ["pair", "bits", "pair2", "bits2"]
    return (rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
            .mapInArrow(_shard_links(radius), "a bigint, b bigint").distinct())


def _classes(docs: DataFrame, words: int, radius: int, max_shard: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows, and (fp, one) with the row that stands for each fingerprint's
    class: the one of the smallest doc_id, those without an id last."""
    rows = staged(fingerprints(docs, words), "simhash-rows")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    classes = staged(rows.groupBy("fp").agg(F.min(one).alias("one")), "simhash-classes")
    root = connected(links(classes.select("fp"), radius, max_shard)).withColumnRenamed("node", "fp")
    linked = classes.join(root, "fp", "left").select("fp", "one", F.coalesce("root", "fp").alias("root"))
    ones = linked.groupBy("root").agg(F.min("one").alias("one"))
    return rows, staged(linked.select("fp", "root").join(ones, "root").select("fp", "one"), "simhash-ids")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, max_shard: int = MAX_SHARD) -> DataFrame:
    """(doc_id, fp, component_id): one row per document."""
    rows, of = _classes(docs, words, radius, max_shard)
    return rows.join(of, "fp").select("doc_id", "fp", F.col("one.doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each class: the one whose id names the class."""
    rows, of = _classes(docs, words, radius, MAX_SHARD)
    ones = of.select("one.doc_id", "one.row_key").distinct()
    same = (rows["row_key"] == ones["row_key"]) & rows["doc_id"].eqNullSafe(ones["doc_id"])
    kept = staged(rows.join(ones, same, "left_semi").groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")), "simhash-kept")
    once = rows_of(docs, kept.where("n = 1"))
    again = kept.where("n > 1")
    if again.isEmpty():
        return once
    return once.union(rows_of(docs, again).dropDuplicates(["doc_id", "text"]))  # the same row repeated
