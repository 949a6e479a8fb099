"""Mixing sources to target weights by Sainte-Laguë apportionment [native].

Each source gets a target of words: its weight's share of ``share`` hundredths of all words,
at most ``passes`` times its own size, the excess dealt again by weight. Targets become
whole numbers of blocks of ``block_words`` words by the highest quotients target / (2k + 1),
and each source's blocks become quotas of its shards in the same way, by the shards' words.

A shard's documents stand in an order that the seed and the text's digest decide, as one ring
of words. Its quota is the run of so many blocks that begins at a seeded block, and goes on
around the ring where the quota exceeds it. Documents are therefore taken whole but for the
two at the ends of a run, no word is taken more than ``passes`` times, and the result hangs
on the rows alone, not on how they are stored.

Quotients are ranked without a step per block: with W / H words a block, a party's seats lie
between its rounded shares of H - n/2 and H + n/2 blocks (n parties), so only the seats
between, about two a party, are ranked.

Rows equal in id, source and text are one row with a count until the end, so a row that
makes up a third of the table is no hot key; a hot source is many shards.

Defined results: a null text has no words and is never taken; a null source is a source of
its own, last in order; a null doc_id is an id like others; repeated rows lie on the ring one
after the other; an empty table, or one without a word, takes nothing; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.common import ranked, staged

#: Weights of the sources in code point order, repeating; hundredths of all words to take.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 150, 2
BLOCK_WORDS, SEED = 16, 13
#: Documents and words of which a source has one shard each.
SHARD_ROWS, SHARD_WORDS = 2_000, 1 << 20
#: Copies of a row that one row stands for while they are made again.
COPIES = 1_000

_SPACE = r"[ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")).cast("bigint")


def classes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key, copies): equal rows as one. ``key`` orders them, by digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_, F.lit(":"), F.md5(text)))
    return (docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
            .groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")))


def targets(sources: DataFrame, share: int = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size, ...) with ``place`` (from 1, by code point, null last) and ``target``.

    Each round shares what the full sources leave by the weights of the others and fills those
    whose share exceeds their limit; the driver sees the sums of a round. Sums of words are whole
    numbers and each target is one product, so rounds and machines can't differ in a digit."""
    placed = staged(ranked(sources, [F.col("source").asc_nulls_last()], "place"), "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * passes
    unit = 0.0  # words a weight of 1
    while True:
        full = limit < weight * F.lit(unit)
        s = placed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, limit)).alias("full"),
                       F.sum(F.when(~full, weight)).alias("weight")).head()
        if not s["all"] or not s["weight"]:
            break
        again = (s["all"] * share / 100 - (s["full"] or 0)) / s["weight"]
        if again == unit:
            break
        unit = again
    target = F.when(limit < weight * F.lit(unit), limit.cast("double")).otherwise(weight * F.lit(unit))
    return placed.withColumn("target", target)


def apportioned(parties: DataFrame, group: list[str], party: str) -> DataFrame:
    """``parties`` (group, party, weight, all_weight, parties, seats, ...) with ``quota``: how many of the
    ``seats`` of its group the highest quotients weight / (2k + 1) give a party, ties to the smaller one.
    ``all_weight``, ``parties`` (at least as many as there are) and ``seats`` belong to the group.
    The seats that hang in the balance are ranked over all groups at once, so a group may have any size."""
    share = F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight"))
    bound = lambda by: F.coalesce(F.floor(share * (F.col("seats") + by * F.col("parties") / 2) + 0.5), F.lit(0))
    known = parties.withColumn("sure", F.greatest(bound(-1) - 1, F.lit(0))).withColumn("most", bound(1) + 1)
    known = staged(known.withColumn("most", F.when((F.col("seats") > 0) & (F.col("weight") > 0), F.col("most")).otherwise(0)), "parties")
    open_ = (known.where(F.col("most") > F.col("sure"))
             .select(*group, party, "weight", F.explode(F.sequence("sure", F.col("most") - 1)).alias("k"))
             .select(*group, party, "k", (F.col("weight") / (2 * F.col("k") + 1)).alias("quotient")))
    order = [F.col(c).asc() for c in group] + [F.col("quotient").desc(), F.col(party).asc(), F.col("k").asc()]
    seat = staged(ranked(open_, order, "rank"), "seats")
    left = known.groupBy(*group).agg((F.max("seats") - F.sum("sure")).alias("left"))
    won = (seat.join(seat.groupBy(*group).agg(F.min("rank").alias("first")), group).join(left, group)
           .where(F.col("rank") - F.col("first") < F.col("left"))
           .groupBy(*group, party).agg(F.count(F.lit(1)).alias("won")))
    return (known.join(won, [*group, party], "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
            .select(*parties.columns, "quota"))


def _digits(text: Column) -> Column:
    """The number that the first 15 hexadecimal digits of ``text`` stand for."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")


def mixture(docs: DataFrame, share: int = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS,
            seed: int = SEED, shard_rows: int = SHARD_ROWS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, key, spans), a row for each row of ``docs`` (doc_id,
    source, text). ``spans`` are the runs of words that the mix takes of it, (from_word, to_word) from 0, one
    for each pass that meets the document."""
    cls = staged(classes(docs, seed), "classes")
    words = F.col("size") * F.col("copies")
    sizes = cls.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("copies").alias("rows"))
    src = staged(targets(sizes, share, passes, weights), "targets")
    n, total = src.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).head()
    wanted = min(total * share / 100, total * passes)
    shards = (1 + F.expr(f"rows div {shard_rows} + source_size div {shard_words}")).alias("shards")
    of_source = apportioned(src.select("*", shards, F.lit(0).alias("mix"), F.col("target").alias("weight"), F.lit(wanted).alias("all_weight"),
                                       F.lit(n).alias("parties"), F.lit(int(wanted / block_words + 0.5)).cast("bigint").alias("seats")),
                            ["mix"], "place").select("place", "source", "source_size", "target", "shards", "quota")
    src = staged(of_source, "source-quotas")

    placed = (cls.join(src.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "quota")
              .withColumn("shard", F.pmod(_digits(F.col("key")), F.col("shards"))))
    ring = Window.partitionBy("place", "shard")
    before = ring.orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(placed.withColumn("start", F.coalesce(F.sum(words).over(before), F.lit(0)))
                    .withColumn("ring", F.sum(words).over(ring)), "rings")
    of_shard = placed.groupBy("place", "shard").agg(F.max("ring").alias("weight")).join(
        src.select("place", F.col("source_size").alias("all_weight"), F.col("shards").alias("parties"), F.col("quota").alias("seats")), "place")
    quotas = staged(apportioned(of_shard, ["place"], "shard").select("place", "shard", F.col("quota").alias("blocks")), "shard-quotas")
    rows = _copied(placed.join(quotas, ["place", "shard"]))

    at = F.col("start") + F.col("copy") * F.col("size")
    first = _digits(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("place").cast("string"), F.col("shard").cast("string"))))
    begin = F.pmod(first, F.greatest(F.expr(f"(ring + {block_words} - 1) div {block_words}"), F.lit(1))) * block_words
    rows = (rows.withColumn("at", at).withColumn("begin", begin)
            .withColumn("end", F.col("begin") + F.least(F.col("blocks") * block_words, F.col("ring") * passes)))

    def span(turn: Column) -> Column:
        here = F.col("at") + turn * F.col("ring")
        return F.struct((F.greatest(F.col("begin"), here) - here).alias("from_word"),
                        (F.least(F.col("end"), here + F.col("size")) - here).alias("to_word"))

    spans = F.filter(F.transform(F.array(*[F.lit(k).cast("bigint") for k in range(passes + 1)]), span), lambda s: s["from_word"] < s["to_word"])
    return rows.select("doc_id", "source", "size", "source_size", "target", "shard", "key", spans.alias("spans"))


def taken(spans: str = "spans") -> Column:
    """Words that spans hold, repeats counted."""
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s["to_word"] - s["from_word"])


def _copied(rows: DataFrame) -> DataFrame:
    """A row for each of a row's ``copies`` with ``copy`` from 0; those of many are made in lots,
    which are dealt before."""
    few = rows.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    lots = (rows.where(F.col("copies") > COPIES)
            .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
            .repartition("key", "lot"))
    many = lots.withColumn("copy", F.explode(F.sequence(F.col("lot"), F.least(F.col("lot") + COPIES, F.col("copies")) - 1))).drop("lot")
    return few.unionByName(many)


def mixed_texts(docs: DataFrame, mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, text): the passages of ``mixed``, cut from their texts between words, with the white
    space within. A text is moved once, whatever the number of its rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = (docs.select(F.md5(F.concat(F.lit(f"{seed}:"), id_, F.lit(":"), F.md5(text))).alias("key"), text.alias("text"))
             .groupBy("key").agg(F.first("text").alias("text")))
    parts = mixed.select("doc_id", "source", "key", F.explode("spans").alias("s"))
    words = F.split(F.regexp_replace("text", f"^{_SPACE}", ""), r"(?<=[ \t\n\x0B\f\r])(?=[^ \t\n\x0B\f\r])")
    own = F.array_join(F.slice(words, F.col("s.from_word").cast("int") + 1, (F.col("s.to_word") - F.col("s.from_word")).cast("int")), "")
    return parts.join(texts, "key").select("doc_id", "source", own.alias("text"))
