"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as lower-cased runs of letters and digits. The 3-word windows of the
test items are seeds; a first pass counts in how many documents each occurs. An item
keeps the seeds that at most ``RARE`` of the documents hold, and in any case the rarer half of
its own and the rarest of every ``RUN`` seeds in a row: a passage of eight of its words, copied
into however many documents, holds one of them. Where a document holds a kept seed, the item is aligned (match +2, mismatch and gap -1)
with the words around it, and the score is divided by that of a verbatim copy. A pair
scoring ``MIN_SCORE`` or more is a leak.

The items are a stated query set: equal texts are one item until the end, items are dealt to
blocks by their words, each block is broadcast and held against all documents. Documents
are never shuffled; every block of ``BLOCK_WORDS`` words means two passes over them.

Defined results: null or empty documents match nothing, items of fewer than three words
are never found, equal items are all reported, repeated documents give repeated rows, an
empty table on either side gives none; columns of other names are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import keyed, pieces, rows_of, staged

SEED_WORDS = 3
#: Words of the items of a block, which bounds what is collected and broadcast.
BLOCK_WORDS = 1_000_000
RARE = 1e-2
RARE_DOCS = 20
RUN = 6
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Items:
    """A block of test items: word ids, their seeds, and where these occur."""

    def __init__(self, ids: list, texts: list[str | None]):
        kept = [(i, w) for i, w in zip(ids, map(words, texts), strict=True) if len(w) >= SEED_WORDS]
        self.ids = [i for i, _ in kept]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64) for _, w in kept]
        own = [seed_codes(w) for w in self.words]
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        at = np.concatenate([np.arange(len(x)) for x in own]) if own else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.item, self.at = flat[order], item[order], at[order]
        self.seeds = np.unique(flat)

    def keep_rare(self, df: np.ndarray, limit: float) -> None:
        """Drops the occurrences whose seed is neither rare, nor in its item's rarer half, nor the rarest
        of any ``RUN`` seeds in a row."""
        freq = df[np.searchsorted(self.seeds, self.flat)]
        order = np.lexsort((self.flat, freq, self.item))
        sizes = np.bincount(self.item, minlength=len(self.ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = (freq <= limit) | (2 * rank < sizes[self.item] + 1)
        in_order = np.lexsort((self.at, self.item))
        for end, size in zip(np.cumsum(sizes), sizes, strict=True):
            own = in_order[end - size:end]
            runs = np.lib.stride_tricks.sliding_window_view(freq[own], min(RUN, size))
            keep[own[np.unique(runs.argmin(axis=1) + np.arange(len(runs)))]] = True
        self.flat, self.item, self.at = self.flat[keep], self.item[keep], self.at[keep]
        self.seeds = np.unique(self.flat)

    def encode(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        w = words(text)
        return np.fromiter((get(x, -1) for x in w), np.int64, len(w))


def seed_codes(ids: np.ndarray) -> np.ndarray:
    """A code per window of three word ids; negative if a word is in no item. Different windows may share
    a code, which costs an alignment and no result."""
    if len(ids) < SEED_WORDS:
        return np.zeros(0, np.int64)
    a, b, c = (x.astype(np.uint64) for x in (ids[:-2], ids[1:-1], ids[2:]))
    code = (((a * _MIX[0]) ^ b) * _MIX[1] ^ c) >> np.uint64(1)
    known = (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)
    return np.where(known, code.astype(np.int64), -1)


def align(item: np.ndarray, window: np.ndarray) -> float:
    """Smith-Waterman score over that of a verbatim copy (0 to 1)."""
    n = len(window)
    col = np.arange(n + 1) * -GAP
    row, best = np.zeros(n + 1, np.int64), 0
    for x in item:
        step = np.zeros(n + 1, np.int64)
        step[1:] = row[:-1] + np.where(window == x, MATCH, MISMATCH)
        step = np.maximum(np.maximum(step, row + GAP), 0)
        row = np.maximum.accumulate(step + col) - col  # gaps along the row: a running maximum
        best = max(best, int(row.max()))
    return best / (MATCH * len(item))


def matches(block: Items, text: str | None, min_score: float = MIN_SCORE) -> list[tuple[int, float]]:
    """(index of the item, score) of the items that the text holds."""
    ids = block.encode(text)
    codes = seed_codes(ids)
    lo, hi = np.searchsorted(block.flat, codes), np.searchsorted(block.flat, codes, "right")
    hits = np.flatnonzero(hi > lo)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in hits:
        for k in range(lo[i], hi[i]):
            item, size = int(block.item[k]), len(block.words[block.item[k]])
            start, slack = int(i - block.at[k]), size // 2 + 2
            span = (max(start - slack, 0), min(start + size + slack, len(ids)))
            if spans[item] and span[0] <= spans[item][-1][1]:
                was = spans[item][-1]
                spans[item][-1] = min(was[0], span[0]), max(was[1], span[1])
            else:
                spans[item].append(span)
    out = []
    for item, windows in spans.items():
        own, best = block.words[item], 0.0
        for s, e in windows:
            window = ids[s:e]
            if np.isin(own, window).mean() >= min_score:  # else no alignment can reach it
                best = max(best, align(own, window))
        if best >= min_score:
            out.append((item, best))
    return out


def _seed_counts(docs: DataFrame, block) -> np.ndarray:
    """Documents that hold each seed of the block: counted per task, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        total = np.zeros(len(b.seeds), np.int64)
        for batch in pieces(batches, "text"):
            for text in batch.column("text").to_pylist():
                codes = np.unique(seed_codes(b.encode(text)))
                at = np.searchsorted(b.seeds, codes)
                at = at[at < len(b.seeds)]
                total[at[np.isin(b.seeds[at], codes)]] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["seed", "n"])

    rows = (docs.select("text").mapInArrow(run, "seed bigint, n bigint")
            .groupBy("seed").agg(F.sum("n").alias("n")).toPandas())  # the block's seeds at most
    out = np.zeros(len(block.value.seeds), np.int64)
    out[rows["seed"].to_numpy()] = rows["n"].to_numpy()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, rare: float = RARE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, row_key): every pair of a document and an item that it holds."""
    spark = docs.sparkSession
    docs = keyed(docs)
    n_docs = docs.count()
    text = F.coalesce(F.col("text"), F.lit(""))
    items = staged(benchmark.select("item_id", F.md5(text).alias("item_key"), text.alias("item_text")), "items")
    texts = items.groupBy("item_key").agg(F.first("item_text").alias("text"))
    n_words = texts.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).head()[0]
    blocks = max(1, -(-n_words // block_words))
    part = F.pmod(F.xxhash64("item_key"), F.lit(blocks))
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for k in range(blocks):
        own = texts.where(part == k).toPandas()  # about block_words words, and no text twice
        first = Items(own["item_key"].tolist(), own["text"].tolist())
        counted = spark.sparkContext.broadcast(first)
        first.keep_rare(_seed_counts(docs, counted), max(RARE_DOCS, rare * n_docs))
        counted.unpersist()
        held = spark.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for b in pieces(batches, "text"):
                rows = [(r, block.ids[i], s) for r, text in enumerate(b.column("text").to_pylist())
                        for i, s in matches(block, text, min_score)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at := pa.array([r for r, _, _ in rows], pa.int64())),
                     pa.array([i for _, i, _ in rows], pa.string()), pa.array([s for _, _, s in rows], pa.float64()),
                     b.column("row_key").take(at)],
                    ["doc_id", "item_key", "score", "row_key"])

        pairs = docs.mapInArrow(run, f"doc_id {doc_kind}, item_key string, score double, row_key bigint")
        found = pairs if found is None else found.union(pairs)
    return found.join(items.select("item_key", "item_id"), "item_key").select("doc_id", "item_id", "score", "row_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    gone = staged(leaks(docs, benchmark).select("doc_id", "row_key").distinct(), "leaking")
    return rows_of(docs, gone, "left_anti")
