"""Hard negatives against a plain definition, ties, odd rows and small blocks."""

import math
import random

import numpy as np
import pytest

from aerolith.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, v string, score double"


def plain(rows, every=10, positives=3, negatives=4, relabel=7):
    ok = []
    for k, (i, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        if i is not None and i % relabel == 0:
            label = (label + 1) % 10
        ok.append((k, i, label, [math.floor(256 * float(np.float32(x))) for x in e]))
    order = lambda s, r: (-s, r[1] is None, r[1] or 0, r[0])
    out = []
    for a in ok:
        if a[1] is None or a[1] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[3], r[3])), r) for r in ok if r[0] != a[0]]
        pos = sorted((x for x in scored if x[1][2] == a[2]), key=lambda x: order(*x))[:positives]
        for p, r in pos:
            neg = [x for x in scored if x[1][2] != a[2] and 30 * p <= 100 * x[0] <= 90 * p]
            neg.sort(key=lambda x: order(*x))
            out += [(a[1], r[1], n + 1, x[1][1], p, x[0]) for n, x in enumerate(neg[:negatives])]
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA).repartition(3)
    found = H.mine(df, every=10, positives=3, negatives=4, relabel=7, **kw)
    return sorted(map(tuple, found.collect()), key=repr)


def table(seed, n=160, wide=6):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-0.02, 0.0, 0.01, 0.02, 0.4]) for _ in range(wide)], rnd.randint(0, 3)) for i in range(n)]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 6 * 8 * 5])
def test_against_a_plain_definition(spark, block_bytes):
    rows = table(3)  # few values: scores tie often
    want = plain(rows)
    assert len(want) > 50
    assert got(spark, rows, block_bytes=block_bytes) == want


def test_small_tiles(spark, monkeypatch):
    rows = table(4, 300)
    one = H._tiles
    monkeypatch.setattr(H, "TILE_BYTES", 6 * 8 * 7)  # in the driver only: the walk itself is called below
    monkeypatch.setattr(H, "RUN_BYTES", 6 * 8 * 20)
    batches = H.staged(H.vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")), "v").toArrow().to_batches(50)
    seen = [int(r) for run, at in one(iter(batches), 6) for r in run.row[at]]
    assert len(seen) == len(set(seen)) == 300


def test_odd_rows(spark):
    e = [0.1, 0.2, 0.3]
    rows = table(5, 60, 3) + [
        (70, None, 1), (80, e, None), (90, [0.1, None, 0.2], 1), (100, [0.1, float("nan"), 0.2], 1), (110, [float("inf"), 0.0, 0.0], 1),
        (None, e, 1), (None, e, 2), (120, [], 1), (130, [0.3, 0.4], 2), (140, [0.1, 0.2, 0.3, 0.4, 0.5], 2), (150, [-0.9, -0.9, -0.9], 0),
        (20, e, 1), (20, e, 1), (20, [0.2, 0.2, 0.2], 1), (-10, e, 3), (-20, e, -5)]
    assert got(spark, rows) == plain(rows)


def test_copies_of_one_row(spark):
    rows = [(10, [0.5, 0.5], 1)] * 40 + [(k, [0.3, 0.4], 2) for k in range(31, 60)] + [(30, [0.3, 0.4], 2)] * 30
    assert got(spark, rows) == plain(rows)


def test_empty_and_no_anchor(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [0.1], 1), (2, [0.2], 1)]) == []


def test_products_are_exact():
    rnd = np.random.default_rng(1)
    for n, k, m, top in [(77, 65, 99, 1 << 61), (40, 200, 33, 300), (1, 1, 1, 9), (64, 64, 64, 1 << 30), (130, 3, 70, 5)]:
        a, b = rnd.integers(-top, top, (n, k)), rnd.integers(-top, top, (k, m))
        assert (H.strassen(a, b) == a @ b).all()
    assert H.strassen(np.zeros((0, 5), np.int64), np.zeros((5, 3), np.int64)).shape == (0, 3)


def test_heaps_merge():
    rnd = random.Random(6)
    entries = [(rnd.randint(0, 4), rnd.randint(-3, 3), rnd.random() < 0.2, rnd.randint(0, 9), k) for k in range(400)]
    cols = lambda part: [np.array(x) for x in zip(*part)]
    whole, left, right = H.Heaps(5, 7), H.Heaps(5, 7), H.Heaps(5, 7)
    whole.push(*cols(entries)), left.push(*cols(entries[:150])), right.push(*cols(entries[150:]))
    left.push(right.group, right.score, right.none, right.id, right.row)
    want = [e for g in range(5) for e in sorted((e for e in entries if e[0] == g), key=lambda e: (-e[1], e[2], e[3], e[4]))[:7]]
    for h in (whole, left):
        assert list(zip(h.group, h.score, h.none, h.id, h.row)) == want
        assert h.full.all() and list(h.worst) == [want[7 * g + 6][1] for g in range(5)]
