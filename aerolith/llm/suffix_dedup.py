"""Repeated byte strings by a common-prefix interval tree over enhanced suffix arrays.

Every ``LEAST``-byte string (200) is named by its anchor: the smallest hash among its
``GRAM``-byte grams (the last of equals). Equal strings have equal anchors, so the strings
of a text fall into windows (the consecutive starts with one anchor), and all occurrences
of a string lie in windows of one anchor value. That splits the suffixes of the corpus
without a global sort:

1. windows whose anchor occurs once are dropped;
2. equal windows are counted, and stand for their copies as one;
3. the different windows of an anchor are gathered in blocks, and each block gets a suffix
   array with common-prefix lengths, of the suffixes that can begin a maximal repeat: those
   that share their first 200 bytes with one that has another byte to the left. A stack
   scan yields its prefix intervals of 200 bytes or more; those whose suffixes differ in
   the byte to the left are the maximal repeats.
   Each suffix is reported under its deepest maximal interval and each interval under its
   parent, so a repeat's occurrences (its own and those of the intervals below) are all
   there in space linear in the block;
4. an anchor with more than ``BLOCK_WINDOWS`` different windows is settled by counting
   128-bit hashes of its 200-byte strings instead, so no task holds an unbounded group; its
   tree, where it is asked for, comes from hashes of all longer prefixes of what repeats.

A repeat longer than a window is reported piece by piece, one for each anchor in it. Strings
never cross texts and are judged on the input.

Defined results: a null or empty text has no bytes; repeated rows are occurrences of each
other; a null doc_id is a value like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import keyed, pieces, staged

LEAST, GRAM = 200, 50
SPAN = LEAST - GRAM + 1  # grams in a string
CHUNK = 1 << 19          # starts handled at once; positions must fit in 20 bits
BLOCK_BYTES, BLOCK_WINDOWS = 2 << 20, 6000
SORT_BYTES = 48 << 20    # suffixes that a block holds as strings of their own
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the gram at each position, from those of half the length."""
    powers, level, size = {}, b.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        base, out, done, rest = _MUL, None, 0, gram
        while rest:
            if rest & 1:  # the gram is put together from its binary parts, the shortest first
                here = level[done:]
                out = here if out is None else out[:len(here)] * base + here[:len(out)]
                done += size
            powers[size] = base
            nxt = len(level) - size
            if nxt <= 0:
                break
            level = level[:nxt] * base + level[size:]
            base, size, rest = base * base, size * 2, rest >> 1
        out = out[:max(len(b) - gram + 1, 0)]
        out = (out ^ out >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        return out ^ out >> np.uint64(29)


def _text_windows(b: np.ndarray, sizes: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start in ``b``, starts, anchor hash) of the texts of ``sizes`` bytes that make up
    ``b``, covering each start of a text once."""
    span, out = least - gram + 1, [(np.zeros(0, np.int64),) * 4]
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(b))  # bytes to the end of the text
    for lo in range(0, max(len(b) - least + 1, 0), CHUNK):
        part = b[lo:lo + CHUNK + least - 1]
        h = _gram_hashes(part, gram)
        n = len(h)
        low = np.uint64((1 << 20) - 1)
        key = h & ~low | low - np.arange(n, dtype=np.uint64)
        full = -(-n // span) * span
        grid = np.concatenate((key, np.full(full - n, ~np.uint64(0)))).reshape(-1, span)
        head = np.minimum.accumulate(grid, axis=1).reshape(-1)
        tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        starts = n - span + 1
        anchor = (low - (np.minimum(tail[:starts], head[span - 1:span - 1 + starts]) & low)).astype(np.int64)
        own, inside = text[lo:lo + starts], left[lo:lo + starts] >= least
        change = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
        cut = np.concatenate(([0], np.flatnonzero(change) + 1, [starts]))
        first, size = cut[:-1], np.diff(cut)
        first, size = first[inside[first]], size[inside[first]]
        out.append((own[first], first + lo, size, h[anchor[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows(b: np.ndarray, least: int = LEAST, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """[(first start, starts, anchor hash)] of a text's bytes, covering each start once."""
    _, first, size, anchor = _text_windows(b, np.array([len(b)]), least, gram)
    return list(zip(first.tolist(), size.tolist(), anchor.tolist(), strict=True))


def _window_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in pieces(batches, "text", CHUNK):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sizes, raw = np.array([len(x) for x in texts], np.int64), b"".join(texts)
            row, at, n, anchor = _text_windows(np.frombuffer(raw, np.uint8), sizes)
            content = [digest(raw[x:y]) for x, y in zip(at.tolist(), (at + n + LEAST - 1).tolist(), strict=True)]
            key = [b.column(c).take(pa.array(row)) for c in ("doc_id", "row_key", "times")]
            yield pa.RecordBatch.from_arrays(
                [*key, pa.array((at - (np.cumsum(sizes) - sizes)[row]).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(anchor),
                 pa.array(np.array(content, np.uint64).view(np.int64))],
                ["doc_id", "row_key", "times", "at", "n", "anchor", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row_key bigint, times bigint, at int, n smallint, anchor bigint, content bigint")


def _once(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Rows equal in doc_id and text as one with their number (``times``), and if there are any."""
    keys = docs.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("times"))
    if keys.where("times > 1").isEmpty():
        return docs.withColumn("times", F.lit(1).cast("bigint")), False
    one = docs.groupBy("doc_id", "row_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    return staged(one.select("doc_id", "text", "row_key", "times"), "rows-once"), True


def _for_each_row(docs: DataFrame, results: DataFrame, label: str) -> DataFrame:
    """The results of a row (doc_id, row_key, ...) for each of the rows that equal it."""
    results = staged(results, label)  # written, so that the join reads two plain exchanges
    same = (docs["row_key"] == results["row_key"]) & docs["doc_id"].eqNullSafe(results["doc_id"])
    return docs.select("doc_id", "row_key").join(results, same).select(
        docs["doc_id"], *[results[c] for c in results.columns if c not in ("doc_id", "row_key")])


def _branching(h: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The members of groups of equal ``h`` in which ``left`` is not one value."""
    order = np.argsort(h)
    h, left = h[order], left[order]
    same = h[1:] == h[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    mixed = np.zeros(len(h), bool)
    mixed[group[1:][same & (left[1:] != left[:-1])]] = True
    out = np.zeros(len(h), bool)
    out[order] = mixed[group]
    return out


def _doubled(raw: bytes, first: np.ndarray, sizes: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``pos`` by prefix doubling over the whole strings."""
    ends = np.arange(len(sizes))
    level = np.full(len(raw) + len(sizes), 256, np.int64)
    shift = np.repeat(ends, sizes)
    level[np.arange(len(raw)) + shift] = np.frombuffer(raw, np.uint8)
    level[first + sizes + ends] += ends  # ends are unique: no prefix goes over one
    size, most = 1, int(sizes.max(initial=0)) + 1
    while size < most:
        nxt = np.zeros(len(level), np.int64)
        nxt[:-size] = level[size:] + 1
        level = np.unique(level * (int(nxt.max()) + 1) + nxt, return_inverse=True)[1]
        size *= 2
    return np.argsort(level[pos + shift[pos]], kind="stable")


def _bytewise(raw: bytes, pos: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order of the suffixes ``raw[pos:end]`` by comparing them as strings."""
    suffixes = [raw[x:y] for x, y in zip(pos.tolist(), end.tolist(), strict=True)]
    return np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)


class Block:
    """Enhanced suffix array over window strings; suffixes start within the first ``n``.

    Suffixes with equal first ``least`` bytes, by their hash, are left out where the byte to
    the left is one and the same: no interval of theirs is maximal. So are those that no
    other one equals, but for whole strings with copies. Up to ``sort_bytes`` of the rest are
    sorted as strings; more, which would be held as copies, by prefix doubling."""

    def __init__(self, strings: list[bytes], least: int = LEAST, copies: list[int] | None = None, sort_bytes: int = SORT_BYTES):
        sizes = np.array([len(s) for s in strings], np.int64)
        first, raw = np.cumsum(sizes) - sizes, b"".join(strings)
        starts = np.maximum(sizes - least + 1, 0)
        owner = np.repeat(np.arange(len(strings)), starts)
        offset = np.arange(len(owner)) - (np.cumsum(starts) - starts)[owner]
        pos = first[owner] + offset
        times = np.array(copies if copies is not None else [1] * len(strings), np.int64)
        before = np.frombuffer(b"\0" + raw, np.uint8)[pos].astype(np.int64)
        left = np.where(offset > 0, before, -1 - np.arange(len(pos)))
        kept = (times[owner] > 1) & (offset == 0)
        if len(pos):
            kept |= _branching(_gram_hashes(np.frombuffer(raw, np.uint8), least)[pos], left)
        owner, offset, pos, left = owner[kept], offset[kept], pos[kept], left[kept]
        end = (first + sizes)[owner]
        order = _bytewise(raw, pos, end) if int((end - pos).sum()) <= sort_bytes else _doubled(raw, first, sizes, pos)
        self.least, self.raw = least, raw
        self.owner, self.offset, self.pos = owner[order], offset[order], pos[order]
        self.rest = (end - pos)[order]  # bytes of the suffix
        self.left, self.lcp = left[order], self._lcp()
        self.copies = times[self.owner]

    def _lcp(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it, eight bytes at a time."""
        words = np.ndarray((len(self.raw) + 1,), "<u8", self.raw + bytes(8), strides=(1,))
        most = np.minimum(self.rest[1:], self.rest[:-1])
        found, live = np.zeros(len(most), np.int64), np.arange(len(most))
        while len(live):
            at = found[live]
            other = words[self.pos[1:][live] + at] ^ words[self.pos[:-1][live] + at]
            ends = np.flatnonzero(other)
            for k in range(1, 8):  # the first bytes are the low ones
                found[live[ends]] += other[ends] << np.uint64(64 - 8 * k) == 0
            live = live[other == 0]
            found[live] += 8
            live = live[found[live] < most[live]]
        return np.concatenate(([0], np.minimum(found, most)))

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(common prefix, first rank, last rank) of every interval of ``least`` or more, the
        inner ones first: a stack scan of the array."""
        stack: list[tuple[int, int]] = []
        deep = np.flatnonzero(self.lcp >= self.least)
        if not len(deep):
            return
        for group in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
            for rank, here in zip(group.tolist(), self.lcp[group].tolist(), strict=True):
                first = rank - 1
                while stack and stack[-1][0] > here:
                    size, first = stack.pop()
                    yield size, first, rank - 1
                if not stack or stack[-1][0] < here:
                    stack.append((here, first))
            end = int(group[-1])
            while stack:
                size, first = stack.pop()
                yield size, first, end

    def repeats(self) -> tuple[list[tuple[int, int, int]], list[int], np.ndarray]:
        """(maximal intervals, parent index of each or -1, deepest one of each suffix or -1)."""
        change = np.concatenate(([0], np.cumsum(self.left[1:] != self.left[:-1])))
        beside = np.maximum(self.lcp, np.concatenate((self.lcp[1:], [0]))) if len(self.pos) else self.rest
        # a string with copies repeats as a whole, though it is one suffix
        alone = np.flatnonzero((self.copies > 1) & (self.offset == 0) & (self.rest > beside))
        kept = [(int(self.rest[k]), int(k), int(k)) for k in alone] + [x for x in self.intervals() if change[x[2]] > change[x[1]]]
        parent, of = [-1] * len(kept), np.full(len(self.pos), -1, np.int64)
        for k in range(len(kept) - 1, -1, -1):  # outer ones first, so inner ones overwrite
            _, lo, hi = kept[k]
            parent[k] = int(of[lo]) if of[lo] >= 0 else -1
            of[lo:hi + 1] = k
        return kept, parent, of


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, start + size) as maximal runs: their starts and their ends."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + sizes)[order])
    apart = s[1:] > e[:-1]
    return s[np.concatenate((np.ones(min(len(s), 1), bool), apart))], e[np.concatenate((apart, np.ones(min(len(s), 1), bool)))]


def _lists(col: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(row of each item, the items' fields) of a column of lists of structs; a null list has none."""
    sizes = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    items = col.flatten()
    return np.repeat(np.arange(len(col)), sizes), dict(zip([f.name for f in items.type], items.flatten(), strict=True))


_REPEATS = "repeat bigint, parent bigint, length int, n int, anchor bigint, content bigint, offset int"


def _block_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Interval trees of consecutive anchors. A row with an ``offset`` is an occurrence, one
    without it is a repeat with its parent and its number of occurrences."""
    held, size, anchor = [], 0, None

    def solve() -> pa.RecordBatch:
        block = Block([s for _, _, s, _ in held], copies=[c for *_, c in held])
        kept, parent, of = block.repeats()
        upto = np.concatenate(([0], np.cumsum(block.copies)))
        base = held[0][0]  # ids are unique among the blocks: an anchor is in one block only
        ids = [hash((base, k)) for k in range(len(kept))]
        hit = np.flatnonzero(of >= 0)
        own = block.owner[hit].tolist()
        none = [None] * len(hit)
        cols = [
            [ids[k] for k in of[hit]] + ids,
            none + [ids[p] if p >= 0 else None for p in parent],
            [kept[k][0] for k in of[hit]] + [k[0] for k in kept],
            none + [int(upto[k[2] + 1] - upto[k[1]]) for k in kept],
            [held[o][0] for o in own] + [None] * len(kept),
            [held[o][1] for o in own] + [None] * len(kept),
            block.offset[hit].tolist() + [None] * len(kept)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        names = [x.split()[0] for x in _REPEATS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    for b in batches:
        for a, content, s, copies in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "string", "copies")), strict=True):
            if a != anchor and held and (size >= BLOCK_BYTES or len(held) >= BLOCK_WINDOWS):
                yield solve()
                held, size = [], 0
            held.append((a, content, s, copies))
            size, anchor = size + len(s), a
    if held:
        yield solve()


def _hashed_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit hash per 200-byte string of each window."""
    digest = xxhash.xxh3_128_digest
    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            row, off, h = [], [], []
            for r, s in enumerate(part.column("string").to_pylist()):
                for k in range(len(s) - LEAST + 1):
                    row.append(r), off.append(k), h.append(digest(s[k:k + LEAST]))
            keys = [part.column(c).take(pa.array(row, pa.int64())) for c in ("anchor", "content", "copies")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(off, pa.int32()), pa.array(h, pa.binary())],
                                             ["anchor", "content", "copies", "offset", "h"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each prefix of 200 bytes or more of the suffixes at ``offsets``: its 128-bit hash, the
    byte after it (-1 at the end) and before it (-1 at the window's start)."""
    names = ["anchor", "content", "copies", "offset", "h", "length", "after", "before"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int16(), pa.int16()]
    for b in batches:
        for a, content, copies, s, offsets in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "copies", "string", "offsets")), strict=True):
            rows = []
            for k in offsets:
                x = xxhash.xxh3_128(s[k:k + LEAST])
                for e in range(k + LEAST, len(s) + 1):
                    rows.append((a, content, copies, k, x.digest(), e - k, s[e] if e < len(s) else -1, s[k - 1] if k else -1))
                    x.update(s[e:e + 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _hot_trees(strings: DataFrame, repeated: DataFrame) -> DataFrame:
    """Interval trees of anchors too large for a block, in the form of ``_block_repeats``: the
    suffixes that repeat are split by the bytes after their first 200, so no group is gathered."""
    offsets = repeated.groupBy("anchor", "content").agg(F.collect_list("offset").alias("offsets"))
    found = staged(strings.join(offsets, ["anchor", "content"]).select("anchor", "content", "copies", "string", "offsets").mapInArrow(
        _prefixes, "anchor bigint, content bigint, copies bigint, offset int, h binary, length int, after smallint, before smallint"), "hot-prefixes")
    # an end or a start of a window differs from every other
    differ = "min({0}) < max({0}) OR min({0}) = -1"
    maximal = staged(found.groupBy("h", "length").agg(
        F.sum("copies").alias("n"), F.expr(differ.format("after")).alias("right"), F.expr(differ.format("before")).alias("left"))
        .where("n > 1 AND right AND left").select("h", "length", F.xxhash64("h", "length").alias("repeat"), F.col("n").cast("int").alias("n")), "hot-maximal")
    chain = (found.join(maximal, ["h", "length"]).groupBy("anchor", "content", "offset")
             .agg(F.sort_array(F.collect_list(F.struct("length", "repeat", "n"))).alias("c")))
    chain = staged(chain, "hot-chains")
    none = F.lit(None)
    own = chain.select(F.element_at("c", -1).alias("r"), "anchor", "content", "offset").select(
        "r.repeat", none.cast("bigint").alias("parent"), "r.length", none.cast("int").alias("n"), "anchor", "content", "offset")
    up = F.transform("c", lambda x, i: F.struct(x["repeat"].alias("repeat"), F.when(i > 0, F.get("c", i - 1)["repeat"]).alias("parent"), x["length"].alias("length"), x["n"].alias("n")))
    nodes = chain.select(F.explode(up).alias("x")).select("x.*").distinct()
    return own.unionByName(nodes.select("*", none.cast("bigint").alias("anchor"), none.cast("bigint").alias("content"), none.cast("int").alias("offset")))


def _cut_strings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, content, copies, hot, string) of the wanted windows, cut from their texts."""
    per_text = wanted.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("at", "n", "anchor", "content", "copies", "hot")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            texts, (row, c) = b.column("text").cast(pa.binary()).to_pylist(), _lists(b.column("cuts"))
            strings = [texts[r][x:x + n + LEAST - 1] for r, x, n in zip(row.tolist(), c["at"].to_pylist(), c["n"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c["anchor"], c["content"], c["copies"], c["hot"], pa.array(strings, pa.binary())],
                                             ["anchor", "content", "copies", "hot", "string"])

    same = (docs["row_key"] == per_text["row_key"]) & docs["doc_id"].eqNullSafe(per_text["doc_id"])
    return (docs.join(per_text, same).select("text", "cuts")
            .mapInArrow(run, "anchor bigint, content bigint, copies bigint, hot boolean, string binary"))


def window_repeats(docs: DataFrame, block_windows: int = BLOCK_WINDOWS, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurring, repeats, covered): the windows that share an anchor, the interval trees of
    the block-wise arrays, and (anchor, content, first, size) ranges that repeats cover. The
    ranges need no trees of windows that only occur as copies, nor of anchors above
    ``block_windows``; with ``whole`` the trees have them too."""
    found = staged(_window_rows(docs), "windows")
    shared = staged(found.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "anchors")
    occurring = staged(found.join(shared, "anchor", "left_semi"), "shared-windows")
    kinds = staged(occurring.groupBy("anchor", "content").agg(
        F.sum("times").alias("copies"), F.min(F.struct("doc_id", "row_key", "at", "n")).alias("one")), "window-kinds")
    several = (kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("copies").alias("most"))
               .where("kinds > 1 OR most > 1" if whole else "kinds > 1")
               .select("anchor", (F.col("kinds") > block_windows).alias("hot")))
    wanted = kinds.join(several, "anchor").select("anchor", "content", "copies", "hot", "one.*")
    strings = staged(_cut_strings(docs, wanted), "window-strings")
    trees = staged(strings.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "content")
                   .select("anchor", "content", "string", "copies").mapInArrow(_block_repeats, _REPEATS), "repeats")
    hot = staged(strings.where("hot").select("anchor", "content", "copies", "string").mapInArrow(
        _hashed_strings, "anchor bigint, content bigint, copies bigint, offset int, h binary"), "hot-strings")
    often = hot.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h")
    if whole:
        trees = trees.unionByName(staged(_hot_trees(strings.where("hot"), hot.join(often, "h", "left_semi")), "hot-repeats"))
    covered = (kinds.where("copies > 1").select("anchor", "content", F.lit(0).alias("first"), (F.col("one.n") + LEAST - 1).cast("int").alias("size"))
               .union(trees.where("offset IS NOT NULL").select("anchor", "content", "offset", "length"))
               .union(hot.join(often, "h", "left_semi").select("anchor", "content", "offset", F.lit(LEAST))))
    return occurring, trees, covered


def maximal_repeats(docs: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(repeat, parent, length, doc_id, start): every occurrence of every maximal repeat within
    windows, exact copies of windows too, under the deepest repeat that holds it; a repeat's occurrences are
    its own rows and those of the repeats that name it as parent, and so on down."""
    rows = keyed(docs)
    docs, again = _once(rows)
    occurring, trees, _ = window_repeats(docs, block_windows, whole=True)
    where = trees.where("offset IS NOT NULL").select("repeat", "length", "anchor", "content", "offset")
    up = trees.where("offset IS NULL").select("repeat", "parent")
    out = (occurring.join(where, ["anchor", "content"]).join(up, "repeat")
           .select("repeat", "parent", "length", "doc_id", "row_key", (F.col("at") + F.col("offset")).alias("start")))
    if again:
        out = _for_each_row(rows, out, "repeats-once")
    return out.select("repeat", "parent", "length", "doc_id", "start")


def remove_repeats(docs: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every byte that a repeated
    200-byte string covers is removed; ``kept`` is the rest."""
    rows = keyed(docs)
    docs, again = _once(rows)
    occurring, _, covered = window_repeats(docs, block_windows)
    # written, so that the join below reads two plain exchanges and a hot window's rows can be split
    per_kind = staged(covered.groupBy("anchor", "content").agg(F.collect_set(F.struct("first", "size")).alias("covers")), "covers")
    cuts = (occurring.join(per_kind, ["anchor", "content"])
            .select("doc_id", "row_key", "at", "covers")
            .groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("at", "covers")).alias("cuts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            texts, (row, c) = b.column("text").cast(pa.binary()).to_pylist(), _lists(b.column("cuts"))
            sizes = np.array([len(x) for x in texts], np.int64)
            base = np.cumsum(sizes + 1) - sizes - 1  # texts stand apart by one, so no run goes over two
            of, x = _lists(c["covers"])
            at = (base[row] + c["at"].to_numpy())[of]
            gone = [[] for _ in texts]
            begin, end = _ranges(at + x["first"].to_numpy(), x["size"].to_numpy())
            own = np.searchsorted(base, begin, "right") - 1
            for r, s, e in zip(own.tolist(), (begin - base[own]).tolist(), (end - base[own]).tolist(), strict=True):
                gone[r].append((s, e))
            rows = []
            for raw, runs in zip(texts, gone, strict=True):
                at, keep = 0, []
                for s, e in runs:
                    keep.append(raw[at:s])
                    at = e
                kept = b"".join([*keep, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                                             ["doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    same = (docs["row_key"] == cuts["row_key"]) & docs["doc_id"].eqNullSafe(cuts["doc_id"])
    out = (docs.join(cuts, same, "left").select(docs["doc_id"], docs["row_key"], "text", "cuts")
           .mapInArrow(run, f"doc_id {kind}, row_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"))
    return _for_each_row(rows, out, "rows-removed") if again else out.drop("row_key")
