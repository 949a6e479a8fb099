"""Importance resampling against a plain definition, and its checksums against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from aerolith.llm import importance as I
from aerolith.llm.common import ranked, table
from aerolith.llm.queries import op12

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs, items):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text))
    for text in items:
        t.update(grams(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for i, text in docs:
        g = grams(text)
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None, len(words(text))])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(enough[:25 * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_query_against_a_plain_definition(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert sorted(map(tuple, op12(spark, SF).collect()), key=repr) == plain(docs, items)


ODD = [
    (1, None), (2, ""), (3, " \t\n-- !!"), (4, "one"), (4, "two words"), (None, "no id here " * 9), (None, None),
    (5, "日本語のテキスト" * 40_000), (6, "a" * 300_000 + " B " + "a" * 255 + " " + "a" * 256 + " " + "a" * 257), (7, "Ä é ÀB z9Z x_y [a]^`{b}~\x7f\x00c " * 20),
] + [(8, "the same row again and again " * 6)] * 9 + [(100 + k, f"word{k} stands among {k % 3} others " * 8) for k in range(40)]


def test_odd_rows(spark):
    items = ["the same row", None, "", "日本語", "word5 stands"]
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id bigint, text string, row int, score string").repartition(4)
    found = I.resample(docs, spark.createDataFrame([(x, 1) for x in items], "text string, doc_id int"))
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain(ODD, items)
    kept = I.draw(docs, spark.createDataFrame([(x,) for x in items], "text string"))
    assert kept.columns == docs.columns
    want = Counter(r[0] for r in plain(ODD, items) if r[4])
    assert Counter(r.doc_id for r in kept.collect()) == want and sum(want.values()) > 8


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert I.resample(none, none).count() == I.draw(none, none).count() == 0
    docs = spark.createDataFrame([(k, "a b c " * 9) for k in range(8)], "doc_id bigint, text string")
    assert I.resample(docs, none).where("rank is not null").count() == 2


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_checksums(longest):
    rnd = random.Random(longest)
    sizes = [1, 2, 3, 7, 255, 256, 257, 511, 512, 1000]
    texts = [" ".join("".join(rnd.choice("abcé日0") for _ in range(rnd.choice(sizes))) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    n_words, n_features, found = I.hashed(texts, longest, 65_521)
    for n in range(longest):
        want = [zlib.crc32(" ".join(w[i:i + n + 1]).encode()) % 65_521 for w in map(words, texts) for i in range(len(w) - n)]
        assert list(found[n]) == want
    assert list(n_words) == [len(words(t)) for t in texts]
    assert int(np.sum(n_features)) == sum(map(len, found))


def test_rank_over_many_ranges(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 50), k, 0) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, k int, part int").repartition(7)
    got = ranked(df, [df["a"].desc(), df["k"].asc()], "rank").orderBy("rank").collect()
    assert [(r.a, r.k) for r in got] == sorted(((a, k) for a, k, _ in rows), key=lambda r: (-r[0], r[1]))
    assert [r["rank"] for r in got] == list(range(1, 3001)) and got[0].asDict().keys() == {"a", "k", "part", "rank"}
