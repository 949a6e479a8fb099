"""Importance resampling of documents towards a target set of texts.

Features are the runs of 1 to ``longest`` words, hashed by CRC-32 into buckets. A bucket's
gain is the log ratio of its smoothed shares in the target and in the corpus, a document's
weight the mean gain of its features, and Gumbel noise from its id makes the highest scores
a weighted draw without replacement.

Checksums are computed for the distinct features of a slice of texts at once. Bytes of equal
length form a two-dimensional array, one feature a row, and a register per row takes up
column after column; the buckets are then scattered back to all places of the features. The
register of a run of words is that of the run without its last word, moved on by a space
and the last word, so a matrix holds the last words only. Bytes beyond a multiple of
``CHUNK`` form those matrices; the chunks before the end are one matrix of their own whose
registers start at zero and are joined by the shift of a chunk, as the checksum is linear.
A word of a megabyte then costs a few thousand steps, not a million.

Defined results: a null text has no words and weight 0; words are split at ASCII bytes
other than letters and digits, so text beyond ASCII without white space is one word;
repeated rows count as often as they occur and are drawn apart; a null doc_id is hashed as
no digits and comes last among ties; an empty target leaves smoothed shares alone; other
columns are not looked at, and ``draw`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import free_name, pieces, ranked, staged

LONGEST, BUCKETS = 2, 10_000
#: Share drawn, in hundredths, of the documents with at least LEAST_WORDS words; seed of the noise.
SHARE, LEAST_WORDS, SEED = 25, 20, 7
#: Bytes of a column of the long words' matrix.
CHUNK = 256


def _byte_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, v >> 1 ^ np.uint32(0xEDB88320), v >> 1)
    return v


_CRC = _byte_table()


def _columns(register: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The registers after all columns of the uint8 matrix ``rows``."""
    for c in range(rows.shape[1]):
        register = _CRC[(register ^ rows[:, c]) & 255] ^ register >> 8
    return register


#: What a register becomes over CHUNK zero bytes, by each of its four bytes.
_SHIFT = np.stack([_columns(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), np.zeros((256, CHUNK), np.uint8)) for k in range(4)])


class Words:
    """Distinct byte strings, cut for column-wise checksums: ``go_on(registers, which)``
    moves registers on over the strings numbered ``which``."""

    def __init__(self, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        whole = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        self.head = size % CHUNK
        self.chunks = size // CHUNK
        self.first = np.cumsum(self.chunks) - self.chunks
        self.matrix, self.at = {}, np.zeros(len(words), np.int64)
        for n in np.unique(self.head):
            own = np.flatnonzero(self.head == n)
            self.matrix[int(n)] = whole[start[own, None] + np.arange(n)]
            self.at[own] = np.arange(len(own))
        long = np.flatnonzero(self.chunks)
        begin = np.concatenate([start[i] + self.head[i] + CHUNK * np.arange(self.chunks[i]) for i in long] or [np.zeros(0, np.int64)])
        self.zero = np.concatenate([_columns(np.zeros(len(b), np.uint32), whole[b[:, None] + np.arange(CHUNK)])
                                    for b in np.array_split(begin, len(begin) // 4096 + 1)])

    def go_on(self, register: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = register.copy()
        for n, rows in self.matrix.items():
            own = np.flatnonzero(self.head[which] == n)
            out[own] = _columns(out[own], rows[self.at[which[own]]])
        left = np.flatnonzero(self.chunks[which])
        step = 0
        while len(left):
            r = out[left]
            shifted = _SHIFT[0][r & 255] ^ _SHIFT[1][r >> 8 & 255] ^ _SHIFT[2][r >> 16 & 255] ^ _SHIFT[3][r >> 24]
            out[left] = shifted ^ self.zero[self.first[which[left]] + step]
            step += 1
            left = left[self.chunks[which[left]] > step]
        return out


_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def hashed(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(words of each text, features of each text, buckets of the features of all texts by length of run)."""
    number: dict[bytes, int] = {}
    ids, n_words = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = words_of(t)
        n_words[i] = len(own)
        ids += [number.setdefault(w, len(number)) for w in own]
    word, known = np.array(ids, np.int64), Words(list(number))
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(word))  # words to the end of the text
    gram, register = word, known.go_on(np.full(len(number), 0xFFFFFFFF, np.uint32), np.arange(len(number)))
    found, space = [], np.full((1, 1), 32, np.uint8)
    for n in range(1, longest + 1):
        if n > 1:  # the run that began at each word, and the word that follows it
            begin = np.flatnonzero(left >= n)
            pair, gram_of = np.unique(gram[begin] * len(number) + word[begin + n - 1], return_inverse=True)
            before, last = np.divmod(pair, max(len(number), 1))
            register = known.go_on(_columns(register[before], np.broadcast_to(space, (len(before), 1))), last)
            gram = np.full(len(word), -1, np.int64)
            gram[begin] = gram_of
        bucket = (register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
        found.append(bucket[gram[left >= n]])
    features = sum(np.maximum(n_words - k, 0) for k in range(longest))
    return n_words, features, found


def _width(buckets: int) -> str:
    """The integer type of a bucket."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, buckets) of ``docs`` (row, doc_id, text): the buckets of all
    features of a text, runs of one word first, as little-endian integers of 2 or 4 bytes."""
    kind, own = docs.schema["doc_id"].dataType.simpleString(), np.dtype(_width(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n_words, n_features, found = hashed(b.column("text").to_pylist(), longest, buckets)
            parts = []
            for n, x in enumerate(found):
                ends = np.concatenate(([0], np.cumsum(np.maximum(n_words - n, 0))))
                raw, ends = x.astype(own).tobytes(), (ends * own.itemsize).tolist()
                parts.append([raw[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(n_words), pa.array(n_features),
                 pa.array([b"".join(p) for p in zip(*parts, strict=True)], pa.binary())],
                ["row", "doc_id", "n_words", "n_features", "buckets"])

    schema = f"row bigint, doc_id {kind}, n_words bigint, n_features bigint, buckets binary"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket. A task sends a row per bucket at most, and so does
    Spark's sum of them to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for b in pieces(batches, "buckets"):
            raw = b"".join(b.column("buckets").to_pylist())
            seen += np.bincount(np.frombuffer(raw, _width(buckets)), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = rows.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    n = float(len(s))
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): the floored mean gain of a row's features."""
    kind, buckets = rows.schema["doc_id"].dataType.simpleString(), len(gain)
    held = rows.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "buckets"):
            raw = b"".join(b.column("buckets").to_pylist())
            summed = np.concatenate(([0], np.cumsum(held.value[np.frombuffer(raw, _width(buckets))])))
            n = b.column("n_features").to_numpy()
            end = np.cumsum(n)
            weight = (summed[end] - summed[end - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("row", "doc_id", "n_words", "n_features")] + [pa.array(weight)],
                                             ["row", "doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"row bigint, doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """floor(1000 times a Gumbel variate), drawn from the id's digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, longest: int = LONGEST,
             buckets: int = BUCKETS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of every document of ``docs`` (doc_id, text);
    ``rank`` numbers the drawn ones from 1, others have none. ``target`` has the texts to come near to.
    ``row`` may name a column that numbers the rows; they are numbered here otherwise."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = staged(features(docs.select(number.alias("row"), "doc_id", "text"), longest, buckets), "features")
    wanted = target.select(F.lit(0).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("doc_id"), "text")
    gain = gains(totals(rows, buckets), totals(features(wanted, longest, buckets), buckets))
    long_enough = F.col("n_words") >= least_words
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(seed=seed)).withColumn("eligible", long_enough)
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    placed = ranked(staged(scored, "scores"), order, "rank")
    quota = placed.where("eligible").count() * share // 100
    return placed.withColumn("rank", F.when(F.col("eligible") & (F.col("rank") <= quota), F.col("rank"))).drop("eligible")


def draw(docs: DataFrame, target: DataFrame, **params) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. Rows are numbered in a written copy, so
    repeated rows are drawn apart."""
    row = free_name(docs, "row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = resample(numbered, target, row=row, **params).where(F.col("rank").isNotNull()).select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
