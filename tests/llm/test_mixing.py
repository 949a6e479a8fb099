"""Source mixing: quotas against seat-by-seat Sainte-Laguë, targets, odd rows, reruns."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aerolith.llm import mixing as M
from aerolith.llm.common import table

SF = "/root/testdata/sf0.001"


def seats_one_by_one(weights, seats):
    held = dict.fromkeys(weights, 0)
    for _ in range(seats if any(weights.values()) else 0):
        best = min(weights, key=lambda p: (-weights[p] / (2 * held[p] + 1), p))
        held[best] += 1
    return held


def test_quotas_are_the_highest_quotients(spark):
    rnd = random.Random(4)
    groups = {}
    for g in range(25):
        weights = {p: rnd.choice([0, 1, 5, 5, 17, rnd.randint(1, 5000)]) for p in range(rnd.choice([1, 2, 7, 30]))}
        groups[g] = weights, rnd.choice([0, 1, 3, len(weights), 10 * len(weights), 1000])
    groups[99] = {p: 7 for p in range(12)}, 31
    rows = [(g, p, x, sum(w.values()), len(w) + g % 3, n) for g, (w, n) in groups.items() for p, x in w.items()]
    df = spark.createDataFrame(rows, "g int, p int, weight bigint, all_weight bigint, parties bigint, seats bigint")
    got = {(r.g, r.p): r.quota for r in M.apportioned(df, ["g"], "p").collect()}
    for g, (weights, seats) in groups.items():
        assert {p: got[g, p] for p in weights} == seats_one_by_one(weights, seats), g


def fill(sizes, share=1.5):
    """Targets by sharing, stopping and sharing the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 3, "shard_words": 500, "block_words": 4}])
def test_sources_come_near_their_targets(spark, sizes):
    docs = table(spark, SF, "documents")
    rows = M.mixture(docs, **sizes).withColumn("taken", M.taken()).collect()
    total, size = Counter(), Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        total[r.source] += r.taken
        size[r.source] += r["size"]
    want = fill(size)
    shards = Counter(s for s, _ in {(r.source, r.shard) for r in rows})
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
    for s, t in want.items():
        assert abs(total[s] - t) <= 16 + 4 * shards[s]
    assert len(rows) == docs.count()


def test_reruns_and_other_partitions_agree(spark):
    docs = table(spark, SF, "documents")
    runs = [sorted(map(tuple, M.mixture(d, shard_rows=4).select("doc_id", "target", M.taken()).collect()))
            for d in (docs, docs.repartition(5), docs.orderBy(F.col("doc_id").desc()))]
    assert runs[0] == runs[1] == runs[2]
    other = sorted(map(tuple, M.mixture(docs, shard_rows=4, seed=5).select("doc_id", "target", M.taken()).collect()))
    assert other != runs[0]


ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "a"), (None, "no id", "a"), (None, None, None), (4, "null source has words", None),
       (5, "one two", ""), (6, " lead\t\ttwo \x0b three\r\nfour  ", "b"), (7, "only nulls", "d"), (8, None, "e"), (8, "again", "b"), (8, "again", "c"),
       (9, "word " * 30_000, "long")] + [(10, "the same row", "hot")] * 2_503


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], "doc_id bigint, text string, source string, copies int, key string, shard int").repartition(3)
    mixed = M.mixture(docs)
    rows = mixed.withColumn("taken", M.taken()).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((i, s) for i, _, s in ODD)
    size = {(i, s, t): len((t or "").split()) for i, t, s in ODD}
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, size[i, s, t]) for i, t, s in ODD)
    total, want = Counter(), fill(Counter({s: sum(size[r[0], r[2], r[1]] for r in ODD if r[2] == s) for s in {r[2] for r in ODD}}))
    for r in rows:
        total[r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    assert all(abs(total[s] - want[s]) <= 16 for s in want)
    # the passages are what the spans say, words and the white space between them
    out = defaultdict(int)
    by_id = {i: t for i, t, _ in ODD}
    for r in M.mixed_texts(docs, mixed).collect():
        out[r.source] += len(r.text.split())
        if r.doc_id in (6, 9, 10):
            assert r.text in by_id[r.doc_id]
    assert {s: n for s, n in out.items() if n} == {s: n for s, n in total.items() if n}


def test_empty_and_wordless(spark):
    schema = "doc_id bigint, text string, source string"
    assert M.mixture(spark.createDataFrame([], schema)).count() == 0
    rows = M.mixture(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).withColumn("taken", M.taken()).collect()
    assert [(r.source_size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
