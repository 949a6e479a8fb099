"""Language identification with interpolated Kneser-Ney character models.

Training counts all 4-grams of the learning rows on Spark; the model of each language is
interpolated Kneser-Ney (absolute discount on the 4-gram counts, continuation counts
below). Models are kept in sorted arrays of 64-bit n-gram hashes, one row of
log-probabilities per hash with a column per language, so one binary search serves all
languages. A text gets the language of lowest cross-entropy per character. No 4-gram is
left out: of a model above ``MAX_CELLS``, the columns of the commonest 4-grams are broadcast
and the texts are read once; what a text holds of the others is joined to their columns and
summed, which is one shuffle of rare 4-grams with no common key in it.

Rows with crc32(doc_id) mod 4 of 2 are held out. A model of the rows of 0 and 1 is
calibrated on those of 3: accuracy by margin (bounded bins, made monotone) becomes the
score, and the cross-entropies of right predictions give each language the limit above
which a text is rejected. The texts are then scored by a model of all three, so a language
that occurs in any learning row can be predicted.

Letters are lower-cased; a run of other characters is one space. Defined results: a null
text, or one without a letter, is ``und`` with score 0 and rejected; so is every row if
nothing could be learned. A null doc_id is never held out and never learned from. Of
languages with equal cross-entropy the first by name is taken; repeated rows count as often
as they occur; an empty table gives no rows; other columns are not looked at, and
``accepted`` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import pieces, rows_of, staged

ORDER = 4
#: Bound of a broadcast: log-probabilities (4-grams x languages). Of a larger model the commonest
#: are broadcast and the others joined, with the same results.
MAX_CELLS = 8_000_000
BINS = 64
#: Calibration rows that a margin bin gathers before it stands for itself.
LEAST_ROWS = 50
UND = "und"
SPACE_CODE = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """16-bit code of the lower-cased letter at each code point; other characters are a space."""
    code = np.full(0x110000, SPACE_CODE, np.uint16)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            v = ord(low[0])
            code[c] = v if v < 0x10000 else 0x8000 | (v * 40503 >> 4 & 0x7FFF)
    return code


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): all texts' codes, each text starting with a space; text i is
    ``codes[bounds[i]:bounds[i + 1]]``, a single space if it has no letter."""
    raw = [np.frombuffer((" " + (t or "")).encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    codes = _letters()[np.concatenate(raw)] if raw else np.zeros(0, np.uint16)
    first = np.zeros(len(codes), bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))[:len(raw)]] = True
    space = codes == SPACE_CODE
    keep = ~(space & np.concatenate(([False], space[:-1])))
    keep |= first
    owner = np.repeat(np.arange(len(raw)), sizes)[keep]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(raw)))))
    return codes[keep], bounds.astype(np.int64)


def grams(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner) of the 4-grams that end at each character after a text's first
    space: 16 bits a character, so equal hashes are equal 4-grams."""
    c = codes.astype(np.uint64)
    at = np.arange(len(c)) - np.repeat(bounds[:-1], np.diff(bounds))
    key = c.copy()
    for back in range(1, ORDER):
        prev = np.concatenate((np.full(min(back, len(c)), SPACE_CODE, np.uint64), c[:-back] if back < len(c) else c[:0]))
        key |= np.where(at >= back, prev, np.uint64(SPACE_CODE)) << np.uint64(16 * back)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    body = at > 0
    return key[body], owner[body]


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (text, lang), summed in the task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(which):
            for lang in which:
                key, n = held.pop(lang)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in pieces(batches, "text", 1 << 20):
            langs = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                key, n = np.unique(grams(*encode([t for t, x in zip(texts, langs, strict=True) if x == lang]))[0], return_counts=True)
                if lang in held:
                    old, m = held[lang]
                    both = np.concatenate((old, key))
                    key, inv = np.unique(both, return_inverse=True)
                    n = np.bincount(inv, np.concatenate((m, n)), len(key)).astype(np.int64)
                held[lang] = key, n.astype(np.int64)
            if sum(len(k) for k, _ in held.values()) > 2_000_000:  # a bounded working set, nothing lost
                yield from out(list(held))
        yield from out(list(held))

    return (rows.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in the sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    langs: list[str]
    hashes: list[np.ndarray]    # per order 1..4: sorted n-gram hashes
    logp: list[np.ndarray]      # per order: [n-grams, languages], natural logarithms
    contexts: list[np.ndarray]  # per order 2..4: sorted hashes of seen contexts
    backoff: list[np.ndarray]   # per order 2..4: [contexts, languages], log weight of the lower order
    floor: np.ndarray           # [languages]: an unseen character

    def cross_entropy(self, keys: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
        """[texts, languages] mean -log p per character."""
        at = _lookup(self.hashes[-1], keys)
        lp = np.empty((len(keys), len(self.langs)), np.float32)
        seen = at >= 0
        lp[seen] = self.logp[-1][at[seen]]
        if not seen.all():
            missed, back = np.unique(keys[~seen], return_inverse=True)
            lp[~seen] = self._lower(missed, ORDER)[back]
        total = np.zeros((n_texts, len(self.langs)))
        if len(keys):
            cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            total[owner[cut]] = np.add.reduceat(lp, cut, axis=0, dtype=np.float64)
        return -total, np.bincount(owner, minlength=n_texts)

    def _lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """log p of keys (n-grams of this order) that no language's model holds."""
        if order == 1:
            return np.broadcast_to(self.floor, (len(keys), len(self.langs))).astype(np.float32)
        bits = np.uint64(16 * (order - 1))
        short = keys & ((np.uint64(1) << bits) - np.uint64(1))
        at = _lookup(self.hashes[order - 2], short)
        out = np.empty((len(keys), len(self.langs)), np.float32)
        out[at >= 0] = self.logp[order - 2][at[at >= 0]]
        if (at < 0).any():
            out[at < 0] = self._lower(short[at < 0], order - 1)
        ctx = _lookup(self.contexts[order - 2], keys >> np.uint64(16))
        out[ctx >= 0] += self.backoff[order - 2][ctx[ctx >= 0]]
        return out


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The interpolated models of {language: (sorted 4-gram hashes, counts)}."""
    langs = sorted(counts)
    per = {}
    for lang in langs:
        keys, n = counts[lang]
        orders = [(keys, n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
            mask = np.uint64((1 << 16 * order) - 1)
            k, c = np.unique(orders[0][0] & mask, return_counts=True)
            orders.insert(0, (k, c.astype(np.float64)))
        per[lang] = orders
    hashes = [np.unique(np.concatenate([per[x][o][0] for x in langs])) for o in range(ORDER)]
    contexts, backoff, logp = [], [], []
    n_chars = len(hashes[0]) + 1
    floor = np.zeros(len(langs), np.float32)
    prob = np.zeros((len(hashes[0]), len(langs)))
    for j, lang in enumerate(langs):
        k, c = per[lang][0]
        d = _discount(c)
        rest = d * len(k) / c.sum() / n_chars
        prob[:, j] = rest
        prob[np.searchsorted(hashes[0], k), j] += (c - d) / c.sum()
        floor[j] = np.log(rest)
    logp.append(np.log(prob).astype(np.float32))
    for o in range(1, ORDER):
        ctx = np.unique(hashes[o] >> np.uint64(16))
        weight = np.ones((len(ctx), len(langs)))
        lower = prob[np.searchsorted(hashes[o - 1], hashes[o] & np.uint64((1 << 16 * o) - 1))]
        of = np.searchsorted(ctx, hashes[o] >> np.uint64(16))
        prob = np.zeros((len(hashes[o]), len(langs)))
        for j, lang in enumerate(langs):
            k, c = per[lang][o]
            d = _discount(c)
            here = np.searchsorted(ctx, k >> np.uint64(16))
            total = np.bincount(here, c, len(ctx))
            kinds = np.bincount(here, minlength=len(ctx))
            known = total > 0
            weight[known, j] = d * kinds[known] / total[known]
            prob[:, j] = weight[of, j] * lower[:, j]
            prob[np.searchsorted(hashes[o], k), j] += (c - d) / total[here]
        contexts.append(ctx)
        backoff.append(np.log(weight).astype(np.float32))
        logp.append(np.log(prob).astype(np.float32))
    return Model(langs, hashes, logp, contexts, backoff, floor)


def _discount(c: np.ndarray) -> float:
    return _discount_of(float((c == 1).sum()), float((c == 2).sum()))


def _discount_of(one: float, two: float) -> float:
    return min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5


@dataclass
class CountedModel:
    """A model above the bound of a broadcast: its counts stay on Spark."""
    langs: list[str]
    counts: DataFrame  # (lang, gram, n)
    max_cells: int


def train(rows: DataFrame, max_cells: int = MAX_CELLS) -> Model | CountedModel | None:
    """The model of all rows (text, lang) and all their 4-grams; None if there is nothing to learn."""
    return learned(staged(count_grams(rows), "lang-counts"), max_cells)


def learned(counts: DataFrame, max_cells: int = MAX_CELLS) -> Model | CountedModel | None:
    """The model of counts (lang, gram, n)."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # a row per language
    if not langs:
        return None
    if counts.select("gram").distinct().count() > max_cells // len(langs):
        return CountedModel(langs, counts, max_cells)
    pdf = counts.toPandas()  # bounded by max_cells
    out = {}
    for lang, part in pdf.groupby("lang"):
        key = part["gram"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        out[lang] = key[order], part["n"].to_numpy()[order]
    return kneser_ney(out)


def _distinct_grams(docs: DataFrame) -> DataFrame:
    """(gram): the different 4-grams of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for b in pieces(batches, "text", 1 << 20):
            held = np.union1d(held, grams(*encode(b.column("text").to_pylist()))[0])
            if len(held) > 2_000_000:  # a bounded working set, nothing lost
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], ["gram"])
                held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], ["gram"])

    return docs.select("text").mapInArrow(run, "gram bigint").distinct()


def gram_columns(model: CountedModel, wanted: DataFrame) -> DataFrame:
    """(gram, logp): what ``kneser_ney`` gives the wanted 4-grams, in the order of ``langs``."""
    def short(order: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))

    def by_lang(rows: DataFrame, key: str, value: str) -> DataFrame:  # an entry per language
        return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("j", value))).alias(value))

    def of(values: list[float]) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("j"))

    j = (F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")) - 1).cast("int")
    counted = {ORDER: model.counts.select(j.alias("j"), "gram", "n")}
    asked = {ORDER: wanted}
    for o in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        counted[o] = staged(counted[o + 1].groupBy("j", short(o).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "lang-continuations")
        asked[o] = asked[o + 1].select(short(o).alias("gram")).distinct()
    n_chars = counted[1].select("gram").distinct().count() + 1
    probs = None
    for o in range(1, ORDER + 1):
        stats = sorted(counted[o].groupBy("j").agg(  # a row per language
            F.sum((F.col("n") == 1).cast("long")).alias("one"), F.sum((F.col("n") == 2).cast("long")).alias("two"),
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect())
        d = [_discount_of(float(r["one"]), float(r["two"])) for r in stats]
        if o == 1:
            rest = [x * r["kinds"] / r["total"] / n_chars for x, r in zip(d, stats, strict=True)]
            own = counted[o].select("j", "gram", ((F.col("n") - of(d)) / of([float(r["total"]) for r in stats])).alias("own"))
            probs = asked[o].join(by_lang(own, "gram", "own"), "gram", "left").select("gram", F.transform(
                F.array(*map(F.lit, rest)), lambda p, k: p + F.coalesce(F.try_element_at("own", k), F.lit(0.0))).alias("p"))
            continue
        rows = counted[o].withColumn("ctx", F.shiftrightunsigned("gram", 16))
        seen = rows.groupBy("j", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        own = rows.join(seen, ["j", "ctx"]).select("j", "gram", ((F.col("n") - of(d)) / F.col("total")).alias("own"))
        weight = seen.select("j", "ctx", (of(d) * F.col("kinds") / F.col("total")).alias("weight"))
        lower = probs.withColumnRenamed("gram", "short").withColumnRenamed("p", "lower")
        mixed = F.transform("lower", lambda p, k: p * F.coalesce(F.try_element_at("weight", k), F.lit(1.0))
                            + F.coalesce(F.try_element_at("own", k), F.lit(0.0)))
        probs = staged(asked[o].select("gram", short(o - 1).alias("short"), F.shiftrightunsigned("gram", 16).alias("ctx"))
                       .join(lower, "short").join(by_lang(own, "gram", "own"), "gram", "left")
                       .join(by_lang(weight, "ctx", "weight"), "ctx", "left").select("gram", mixed.alias("p")), "lang-columns")
    return probs.select("gram", F.transform("p", lambda p: F.log(p).cast("float")).alias("logp"))


def _ranked(total: np.ndarray, n: np.ndarray, no_letter: np.ndarray, langs: list[str]) -> list[pa.Array]:
    """lang_pred, xent, margin and n of texts with these -log p by language."""
    mean = total / np.maximum(n, 1)[:, None]
    ranked = np.sort(mean, axis=1)
    margin = ranked[:, 1] - ranked[:, 0] if len(langs) > 1 else np.full(len(mean), 1.0)
    pred = [UND if x else langs[i] for x, i in zip(no_letter, mean.argmin(axis=1), strict=True)]
    return [pa.array(pred, pa.string()), pa.array(ranked[:, 0]), pa.array(np.where(no_letter, 0.0, margin)), pa.array(n)]


def _no_letter(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.array([not (codes[x:y] != SPACE_CODE).any() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], bool)


def score(docs: DataFrame, model: Model | CountedModel, *keep: str) -> DataFrame:
    """(*keep, lang_pred, xent, margin, n): best language, its cross-entropy, the gap to
    the second, and the characters scored. Whole texts, in bounded pieces."""
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "lang_pred string, xent double, margin double, n bigint"
    if isinstance(model, CountedModel):
        return _score_counted(docs, model, keep, schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in pieces(batches, "text", 1 << 20):
            texts = b.column("text").to_pylist()
            codes, bounds = encode(texts)
            total, n = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), np.int64)
            key, owner = grams(codes, bounds)
            for lo in range(0, len(key), 1 << 20):
                s, k = m.cross_entropy(key[lo:lo + (1 << 20)], owner[lo:lo + (1 << 20)], len(texts))
                total, n = total + s, n + k
            cols = [b.column(c) for c in keep] + _ranked(total, n, _no_letter(codes, bounds), m.langs)
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "xent", "margin", "n"])

    return docs.select("text", *keep).mapInArrow(run, schema)


def _common(counts: DataFrame, most: int) -> Column:
    """Whether a 4-gram seen ``n`` times is one of the commonest, of which there are at most ``most``."""
    size = F.floor(F.log2("n")).cast("int")
    classes = (counts.groupBy("gram").agg(F.sum("n").alias("n")).groupBy(size.alias("size"))
               .agg(F.count(F.lit(1)).alias("grams")).orderBy(F.col("size").desc()).collect())  # a row per power of two
    held, least = 0, 64
    for r in classes:
        held += r["grams"]
        if held > most:
            break
        least = r["size"]
    return size >= least


def _score_counted(docs: DataFrame, model: CountedModel, keep: tuple[str, ...], schema: str) -> DataFrame:
    """``score`` by one pass over the texts: a text's sum over the commonest 4-grams, and its other
    4-grams with their numbers, whose columns are joined and added. Equal texts are one."""
    spark, langs = docs.sparkSession, model.langs
    wanted = staged(_distinct_grams(docs), "lang-grams")
    seen = model.counts.groupBy("gram").agg(F.sum("n").alias("n"))
    common = F.coalesce(_common(model.counts, model.max_cells // len(langs)), F.lit(False))
    columns = staged(gram_columns(model, wanted).join(seen, "gram", "left").select("gram", "logp", common.alias("common")), "lang-columns")
    found = columns.where("common").select("gram", "logp").toArrow()  # bounded by max_cells
    key = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(key)
    logp = found.column("logp").combine_chunks()
    logp = (logp.combine_chunks() if isinstance(logp, pa.ChunkedArray) else logp).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
    held = spark.sparkContext.broadcast((key[order], logp[order]))
    named = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("same"), "text", *keep)
    parts = staged(named.select("same", "text").groupBy("same").agg(F.first("text").alias("text")).mapInArrow(
        _text_pass(held, len(langs)), "same string, gram bigint, n bigint, no_letter boolean, total array<double>"), "lang-parts")
    own = parts.where("gram IS NULL").select("same", "n", "no_letter", "total")
    rare = (parts.where("gram IS NOT NULL").select("same", "gram", F.col("n").alias("times"))
            .join(columns.where("NOT common").select("gram", "logp"), "gram")
            .select("same", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("no_letter"),
                    F.transform("logp", lambda p: -p.cast("double") * F.col("times")).alias("total")))
    sums = (own.union(rare).groupBy("same").agg(
        F.max("no_letter").alias("no_letter"), F.max("n").alias("n"),
        F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(len(langs))]).alias("total")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.array(b.column("total").to_pylist(), np.float64).reshape(-1, len(langs))
            n, no_letter = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "no_letter"))
            cols = [b.column(c) for c in keep] + _ranked(total, n.astype(np.int64), no_letter.astype(bool), langs)
            yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "xent", "margin", "n"])

    return (named.select("same", *keep).join(staged(sums, "lang-sums"), "same")
            .select(*keep, "no_letter", "n", "total").mapInArrow(finish, schema))


def _text_pass(held, n_langs: int):
    """Task: for each text a row without a gram, with its characters and the -log p by language of its
    common 4-grams, and a row for each other 4-gram with its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logp = held.value
        step = max((1 << 23) // n_langs, 1)
        names = ["same", "gram", "n", "no_letter", "total"]
        for b in pieces(batches, "text", 1 << 20):
            codes, bounds = encode(b.column("text").to_pylist())
            key, owner = grams(codes, bounds)
            total = np.zeros((b.num_rows, n_langs))
            for lo in range(0, len(key), step):
                at = _lookup(table, key[lo:lo + step])
                own = owner[lo:lo + step]
                inside, at = own[at >= 0], at[at >= 0]
                if len(at):
                    cut = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1])))
                    total[inside[cut]] -= np.add.reduceat(logp[at], cut, axis=0, dtype=np.float64)
            size = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("same"), pa.nulls(size, pa.int64()), pa.array(np.bincount(owner, minlength=size).astype(np.int64)),
                 pa.array(_no_letter(codes, bounds)), pa.array(list(total), pa.list_(pa.float64()))], names)
            rest = _lookup(table, key) < 0
            order = np.lexsort((key[rest], owner[rest]))
            k, o = key[rest][order], owner[rest][order]
            first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))) if len(k) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("same").take(pa.array(o[first])), pa.array(k[first].view(np.int64)),
                 pa.array(np.diff(np.append(first, len(k))).astype(np.int64)), pa.nulls(len(first), pa.bool_()),
                 pa.nulls(len(first), pa.list_(pa.float64()))], names)

    return run


@dataclass
class Calibration:
    edges: list[float]             # upper margin edges of the bins
    accuracy: list[float]          # calibrated score of each bin
    limit: dict[str, list[float]]  # language -> cross-entropy limit by log2(characters)

    def score(self) -> Column:
        out = F.lit(self.accuracy[-1])
        for edge, acc in reversed(list(zip(self.edges, self.accuracy, strict=True))):
            out = F.when(F.col("margin") <= edge, F.lit(acc)).otherwise(out)
        return out

    def rejected(self) -> Column:
        size = F.least(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))), F.lit(SIZES - 1)).cast("int")
        over = F.lit(False)
        for lang, limits in self.limit.items():
            over = F.when(F.col("lang_pred") == lang, F.col("xent") > F.get(F.array(*[F.lit(x) for x in limits]), size)).otherwise(over)
        return (F.col("lang_pred") == UND) | over | (F.col("score") < 0.5)


SIZES = 24


def calibrate(scored: DataFrame, width: float = 0.05, spread: float = 6.0, least_spread: float = 0.15) -> Calibration:
    """From rows (lang, lang_pred, xent, margin, n) that the model has not counted.

    Score: share of right predictions by margin bin (``width`` nats, widened to
    ``LEAST_ROWS`` rows, smoothed by one right and one wrong row) made non-decreasing by pooling neighbours. Limit: mean plus
    ``spread`` deviations (``least_spread`` nats at least) of the cross-entropy of right
    predictions in the same language and size class. Sizes without 20 rows take the mean
    and deviation of the whole language, short ones with more spread; a language without
    5 rows rejects nothing.
    """
    right = F.col("lang") == F.col("lang_pred")
    rows = scored.where(f"lang_pred <> '{UND}'")
    bins = (rows.groupBy(F.least(F.floor(F.col("margin") / width), F.lit(BINS - 1)).cast("int").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(right.cast("long")).alias("ok")).orderBy("b").collect())
    pool: list[list[float]] = []  # [ok, n, last bin]
    for r in bins:
        if pool and pool[-1][1] < LEAST_ROWS:
            pool[-1] = [pool[-1][0] + r["ok"], pool[-1][1] + r["n"], r["b"]]
        else:
            pool.append([r["ok"] + 1.0, r["n"] + 2.0, r["b"]])
        while len(pool) > 1 and pool[-2][0] / pool[-2][1] > pool[-1][0] / pool[-1][1]:
            ok, n, b = pool.pop()
            pool[-1] = [pool[-1][0] + ok, pool[-1][1] + n, b]
    stats = (rows.where(right).groupBy("lang", F.least(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))), F.lit(SIZES - 1)).cast("int").alias("size"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("xent").alias("s"), F.sum(F.col("xent") * F.col("xent")).alias("q")).collect())

    def over(rows: list, more: float = 1.0) -> float:
        n, s, q = (sum(r[k] for r in rows) for k in ("n", "s", "q"))
        return s / n + spread * more * max(max(q / n - (s / n) ** 2, 0.0) ** 0.5, least_spread)

    limit: dict[str, list[float]] = {}
    for lang in sorted({r["lang"] for r in stats}):
        mine = [r for r in stats if r["lang"] == lang]
        own = {r["size"]: over([r]) for r in mine if r["n"] >= 20}
        enough = sum(r["n"] for r in mine) >= 5
        limit[lang] = [own.get(s) or (over(mine, max(1.0, (64 / 2 ** s) ** 0.5)) if enough else float("inf")) for s in range(SIZES)]
    return Calibration([(p[2] + 1) * width for p in pool] or [0.0], [p[0] / p[1] for p in pool] or [0.5], limit)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): one row per document."""
    return judged(docs).drop("row_key")


def judged(docs: DataFrame) -> DataFrame:
    """``identify`` with the row_key that tells equal doc_ids apart."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.select("doc_id", "text", "lang", part.cast("int").alias("part"),
                       F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"))
    labelled = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counts, others = (staged(count_grams(labelled.where(f"part IN {p}")), "lang-counts") for p in ("(0, 1)", "(3)"))
    every = staged(counts.union(others).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-counts")
    held = F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out")
    model, first = learned(every), learned(counts)
    if model is None:
        return rows.select("doc_id", held, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), "row_key")
    if first is None:
        cal = Calibration([0.0], [0.5], {})
    else:
        cal = calibrate(staged(score(labelled.where("part = 3"), first, "lang"), "lang-calibration"))
    scored = staged(score(rows, model, "doc_id", "part", "row_key"), "lang-scored")
    out = scored.withColumn("score", F.when(F.col("lang_pred") == UND, F.lit(0.0)).otherwise(cal.score()))
    return out.select("doc_id", held, "lang_pred", "score", cal.rejected().alias("rejected"), "row_key")


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected."""
    gone = staged(judged(docs).where("rejected").select("doc_id", "row_key").distinct(), "lang-rejected")
    return rows_of(docs, gone, "left_anti")
