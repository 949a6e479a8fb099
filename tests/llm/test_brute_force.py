"""Operators that SQL cannot express against plain definitions on small tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from aerolith.llm import decontaminate, langid, licenses, line_dedup, packing, quality_rules, simhash, suffix_dedup, token_files, tokens
from aerolith.llm.common import DOCUMENT_COLUMNS, staged, table
from aerolith.llm.queries import tokenizer_file
from aerolith.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# --- tokens, packing, files ---------------------------------------------------------------

PARTS = [" ", "  ", "\n", "\t", "a", "B", "é", "e\u0301", "'s", "'S", "!", ".", ",", "9", "\xa0", "\x85", "\x1c", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>",
         "<|startoftext|>", "the", "The", "\r\n", "日本", "'", "—", "ß", "Σ", "ς", "İ", "ſ", "ǆ", "\u0301", "ª", "µ", "Ǖ", "ſt", "K", "Å", "\u200b", "\ufeff",
         "x" * 70, "Straße", "cióntaie", "Óas", "½", "٣", "\u3000", "\u2028"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_a_plain_call(texts, name):
    rnd = random.Random(5)
    odd = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(6000)]
    enc, plain = Encoder(tokenizer_file(name)), Tokenizer.from_file(tokenizer_file(name))
    both = list(texts.values()) + odd
    want = [np.array(plain.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in both]
    assert enc.encode(both) == want
    assert enc.encode(both[::-1]) == want[::-1]
    assert enc.kind == ("bytes" if name.startswith("byte") else "words")


def test_the_cache_is_bounded_by_bytes(texts, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_BYTES", 60_000)
    enc, plain = Encoder(tokenizer_file("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    own = [x or "" for x in texts.values()]
    assert enc.encode(own) == [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in own]
    long = ["日本語のテキスト" * 50 + str(k) for k in range(300)]
    enc.encode(long)
    assert not any(len(u) > tokens.MAX_UNIT for u in enc.known) and enc.held < 60_000 + 200 * 400 * 300


def test_a_tokenizer_of_another_kind_is_called_whole(tmp_path, texts):
    made = json.loads(open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read())
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    enc, plain = Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    own = [x or "" for x in list(texts.values())[:40]]
    assert enc.kind == "other"
    assert enc.encode(own) == [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in own]


def _ids(name, texts, end):
    t = Tokenizer.from_file(tokenizer_file(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x in texts.items()}


def test_packing_places_every_token_once(docs, texts):
    want = _ids("byte_bpe_50k.json", texts, 2)
    packed = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), keep_ids=True)
    rows = packed.orderBy("doc_id", "piece").collect()
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for r in rows:
        own = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and len(own) == r.length <= 1024
        assert r.length == 1024 or r.piece == 0
        assert len(want[r.doc_id]) > 1024 or r.length == len(want[r.doc_id])
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024
    assert len(at) <= 1.02 * -(-sum(at.values()) // 1024) + 1
    one = packing.sequences(packed).where("sequence_id = 0").head()
    assert one.ids == b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.sequence_id == 0), key=lambda r: r.offset))


def test_a_word_is_one_unit_before_any_mark():
    from tokenizers import Tokenizer
    path = tokenizer_file("word_bpe_49k.json")
    enc, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    text = "Été. été, ÉTÉ! été.\nword word."
    assert enc.encode([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert set(enc.known) == {"été", "word", ".", ",", "!"}
    rnd = random.Random(8)
    some = [*map(chr, range(0x1C)), *map(chr, range(0x20, 0x100)), *"..,,!!''   \n", *"abÀé"]
    texts = ["".join(rnd.choices(some, k=rnd.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(rnd.choices("ab. ,!'s_\"\u2013\u00bd\u0301", k=rnd.randint(1, 12))) for _ in range(1500)]
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_fullest_is_the_best_subset_sum():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        room = rnd.randint(0, 60)
        sums = {0}
        for s, n in counts.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        found = packing.fullest(counts, room)
        assert all(k <= counts[s] for s, k in found) and len({s for s, _ in found}) == len(found)
        assert sum(s * k for s, k in found) == max(x for x in sums if x <= room)


def test_token_files_round_trip(docs, texts):
    want = _ids("word_bpe_49k.json", texts, 1)
    rows = token_files.round_trip(docs, tokenizer_file("word_bpe_49k.json")).orderBy("doc_id").collect()
    at = 0
    for r, (i, ids) in zip(rows, sorted(want.items()), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_variable_length_code():
    v = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7, 300], np.uint32)
    for n in range(len(v) + 1):
        control, data = token_files.encode_ranks(v[:n])
        assert len(control) == -(-n // 4)
        assert (token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v[:n]).all()
    with pytest.raises(ValueError, match="cut short"):
        token_files.unpack_file(token_files.pack_file([1], [9], 0, v)[:-1])


# --- repeated strings ---------------------------------------------------------------------

def _removed(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _odd_texts():
    rnd = random.Random(9)
    word = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 7))) for _ in range(n))
    shared = word(120)
    near = shared.split()
    out = [word(80) + " " + shared + " " + word(60) for _ in range(40)]  # one passage, other contexts
    for k in range(30):  # near copies
        w = near.copy()
        w[rnd.randrange(len(w))] = f"edit{k}"
        out.append(" ".join(w))
    out += ["ab" * 400, "ab" * 300, "x" * 200, "x" * 199, "y" * 201, "", None, "é" * 150, shared[:200], shared[:199], shared, shared]
    out.append(word(3) * 200)
    return out


@pytest.mark.parametrize("block_windows", [suffix_dedup.BLOCK_WINDOWS, 10, 0])
def test_repeats_of_odd_texts(spark, block_windows):
    """With a small ``block_windows`` the groups are settled by hashes, as very large ones are."""
    texts = _odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = suffix_dedup.remove_repeats(df, block_windows).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == _removed(texts)


def test_repeated_rows_are_worked_on_once(spark):
    """Rows equal in doc_id and text: one list of cuts, one string of each window kind."""
    twin, other = " ".join(f"t{i}" for i in range(150)), " ".join(f"o{i}" for i in range(150))
    rows = [(1, twin)] * 300 + [(None, other)] * 300 + [(2, f"head {twin[:400]} tail"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    once, again = suffix_dedup._once(suffix_dedup.keyed(df))
    occurring, _, _ = suffix_dedup.window_repeats(once)
    assert again and once.count() == 4
    assert occurring.where("doc_id = 1").count() == occurring.where("doc_id = 1").select("at").distinct().count()
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(df).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, _removed([t for _, t in rows]), strict=True))


def test_repeats_of_documents(docs, texts):
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(zip(texts, _removed(list(texts.values())), strict=True))


def test_interval_tree_finds_the_maximal_repeats():
    rnd = random.Random(3)
    for _ in range(60):
        strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(4, 24))).encode() for _ in range(rnd.randint(1, 5))]
        block = suffix_dedup.Block(strings, least=4)
        kept, parent, of = block.repeats()
        found = {}
        for size, lo, hi in kept:
            where = frozenset((int(block.owner[k]), int(block.offset[k])) for k in range(lo, hi + 1))
            found[strings[block.owner[lo]][block.offset[lo]:][:size]] = where
        want = {}
        for k, s in enumerate(strings):
            for i in range(len(s)):
                for j in range(i + 4, len(s) + 1):
                    want.setdefault(s[i:j], set()).add((k, i))
        maximal = {}
        for sub, where in want.items():
            right = {strings[k][i + len(sub):i + len(sub) + 1] or (k, i) for k, i in where}
            left = {strings[k][i - 1:i] or (k, i) for k, i in where}
            if len(where) > 1 and len(right) > 1 and len(left) > 1:
                maximal[sub] = frozenset(where)
        assert found == maximal
        for k, p in enumerate(parent):
            assert p == -1 or (kept[p][1] <= kept[k][1] and kept[k][2] <= kept[p][2] and kept[p][0] < kept[k][0])


def test_every_occurrence_of_a_repeat_is_reported(spark):
    passage = " ".join(f"p{i}" for i in range(100))
    texts = [f"left{k} {passage} right{k}" for k in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = suffix_dedup.maximal_repeats(df).collect()
    assert {r.doc_id for r in rows} == set(range(6))
    for r in rows:
        same = [x for x in rows if x.repeat == r.repeat]
        assert len({texts[x.doc_id][x.start:x.start + x.length] for x in same}) == 1
        assert {x.doc_id for x in same} == set(range(6))


@pytest.mark.parametrize("block_windows", [suffix_dedup.BLOCK_WINDOWS, 0])
def test_maximal_repeats_of_windows(spark, block_windows):
    """Exact copies and anchors above ``block_windows`` too: all maximal strings of all windows."""
    twin, part = (" ".join(f"{c}{i}" for i in range(60)) for c in "tp")
    texts = [twin, twin, f"x {part} one", f"y {part} two", f"y {part} two", f"z {part[:220]}", "w" * 210]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = suffix_dedup.maximal_repeats(df, block_windows).collect()
    parent, length = {r.repeat: r.parent for r in rows}, {r.repeat: r.length for r in rows}
    found = {}
    for r in rows:
        k = r.repeat
        while k is not None and k in length:
            found.setdefault((texts[r.doc_id][r.start:r.start + length[k]]), set()).add((r.doc_id, r.start))
            k = parent[k]
    spans = {}  # anchor -> [(text, first start, end, starts)]
    for d, t in enumerate(texts):
        for s, n, a in suffix_dedup.windows(np.frombuffer(t.encode(), np.uint8)):
            spans.setdefault(a, []).append((d, s, s + n + 199, n))
    want = {}
    for own in spans.values():
        at = {}
        for d, s, e, n in own:
            for i in range(s, s + n):
                for j in range(i + 200, e + 1):
                    at.setdefault(texts[d][i:j], []).append((d, i, texts[d][j] if j < e else (d, i), texts[d][i - 1] if i > s else (d, i)))
        for x, where in at.items():
            if len(where) > 1 and len({w[2] for w in where}) > 1 and len({w[3] for w in where}) > 1:
                want[x] = {w[:2] for w in where}
    # one that only occurs as part of the deeper ones has no rows of its own; those below it carry it
    assert {0, 1} <= {r.doc_id for r in rows} and any(len(x) > 200 and {w[0] for w in y} == {0, 1} for x, y in found.items())
    assert all(want.get(x) == y for x, y in found.items())
    assert {w for y in want.values() for w in y} == {w for y in found.values() for w in y}


@pytest.mark.parametrize("sort_bytes", [suffix_dedup.SORT_BYTES, 0])
def test_a_block_sorts_the_suffixes_that_can_begin_a_maximal_repeat(sort_bytes):
    """Of a passage in three contexts the suffixes after its first byte have one byte to the left, so the
    array has those of its first byte alone; sorted as strings or by prefix doubling it is the same."""
    passage = " ".join(f"p{i}" for i in range(80)).encode()
    strings = [b"a" * k + bytes([65 + k]) + passage + b"z" * k for k in range(3)]
    block = suffix_dedup.Block(strings, sort_bytes=sort_bytes)
    assert sorted(zip(block.owner.tolist(), block.offset.tolist(), strict=True)) == [(0, 1), (1, 2), (2, 3)]
    kept, parent, of = block.repeats()
    assert [(n, hi - lo) for n, lo, hi in kept] == [(len(passage) + 1, 1), (len(passage), 2)]
    assert parent == [1, -1] and sorted(of.tolist()) == [0, 0, 1]


def test_both_orders_of_a_block_give_the_same_repeats():
    rnd = random.Random(4)
    for _ in range(80):
        strings = [bytes(rnd.choice((0, 1, 255)) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        copies = [rnd.choice((1, 1, 3)) for _ in strings]
        found = []
        for sort_bytes in (1 << 20, 0):
            block = suffix_dedup.Block(strings, 4, copies, sort_bytes)
            kept, parent, of = block.repeats()
            where = [frozenset((int(block.owner[k]), int(block.offset[k])) for k in range(lo, hi + 1)) for _, lo, hi in kept]
            found.append({(n, w, where[p] if p >= 0 else None) for (n, _, _), w, p in zip(kept, where, parent, strict=True)})
        assert found[0] == found[1]


def test_windows_of_texts_put_together():
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"abc") for _ in range(n)) for n in (0, 199, 200, 900, 1, 350, 0, 201, 40)] + [b"ab" * 300, b"ab" * 300]
    sizes = np.array([len(t) for t in texts])
    found = suffix_dedup._text_windows(np.frombuffer(b"".join(texts), np.uint8), sizes)
    base = np.cumsum(sizes) - sizes
    got = [(r, s - base[r], n, h) for r, s, n, h in zip(*(x.tolist() for x in found), strict=True)]
    assert got == [(r, *w) for r, t in enumerate(texts) for w in suffix_dedup.windows(np.frombuffer(t, np.uint8))]


def test_ranges_are_the_maximal_runs():
    rnd = random.Random(6)
    for _ in range(50):
        spans = [(rnd.randint(0, 60), rnd.randint(1, 9)) for _ in range(rnd.randint(0, 12))]
        flags = bytearray(80)
        for s, n in spans:
            flags[s:s + n] = b"\1" * n
        begin, end = suffix_dedup._ranges(*np.array(spans, np.int64).reshape(-1, 2).T)
        assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [m.span() for m in re.finditer(b"\1+", bytes(flags))]


# --- SimHash ------------------------------------------------------------------------------

def _fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_simhash_classes(docs, texts):
    fps = [_fingerprint(t) for t in texts.values()]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    ids = list(texts)
    assert got == {i: (f, ids[r]) for i, f, r in zip(ids, fps, _roots(fps), strict=True)}


@pytest.mark.parametrize("max_shard", [20_000, 3])
def test_links_of_dense_fingerprints(spark, max_shard):
    """Chains and clusters within 2 bits; a small ``max_shard`` deals every shard again."""
    rnd = random.Random(4)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp bigint").repartition(4)
    pairs = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, 2, max_shard).collect()]
    at = {f: k for k, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    assert [find(k) for k in range(len(fps))] == _roots(fps)


# --- decontamination ----------------------------------------------------------------------

def test_alignment_is_smith_waterman():
    rnd = random.Random(6)
    for _ in range(100):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert decontaminate.align(np.array(a), np.array(b)) == max(map(max, h)) / (2 * len(a))


def test_planted_copies_are_found(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [prose(rnd.randint(15, 60)) for _ in range(30)]
    docs, want = [], set()
    for k in range(300):
        words = prose(rnd.randint(5, 300))
        if k % 3 == 0:
            item = k // 3 % 30
            copy = items[item].copy()
            if k % 2:  # an edited copy: one word of seven replaced, one left out
                copy = [w if j % 7 else "edited" for j, w in enumerate(copy)]
                del copy[len(copy) // 2]
            at = rnd.randint(0, len(words))
            words[at:at] = copy
            want.add((k, item))
        docs.append((k, " ".join(words).capitalize() + "!"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    for size in (1_000_000, 200):  # one block, and several
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, block_words=size).collect()} == want


def test_partial_copies_of_an_item_that_many_documents_hold(spark):
    """An item copied whole into sixty documents and in part into others: a part is found wherever it was cut."""
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(4000)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [prose(37) for _ in range(20)]
    docs = [(k, " ".join(prose(60) + items[0] + prose(60))) for k in range(60)]
    want = {(k, 0) for k in range(60)}
    # the last part of another item is held by forty documents, its first part by few
    docs += [(100 + k, " ".join(prose(40) + items[1][18:] + prose(40))) for k in range(40)]
    want |= {(100 + k, 1) for k in range(40)}
    for k in range(400):
        item, n = rnd.randrange(20), rnd.randint(19, 37)
        at = rnd.choice([0, 37 - n, rnd.randint(0, 37 - n)])
        docs.append((1000 + k, " ".join(prose(rnd.randint(5, 90)) + items[item][at:at + n] + prose(rnd.randint(5, 90)))))
        want.add((1000 + k, item))
    docs += [(5000 + k, " ".join(prose(200))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want


def test_equal_items_are_one_until_the_end(spark):
    rows = [(k, "the very same item stands here many times over") for k in range(500)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(1, "so the very same item stands here many times over it seems"), (2, "nothing")], "doc_id bigint, text string")
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    assert sorted(r.item_id for r in decontaminate.leaks(df, bench, block_words=3).collect()) == list(range(500))


def test_leaks_of_documents_against_all_alignments(spark, docs, texts):
    bench = table(spark, SF, "benchmark")
    items = decontaminate.Items(*zip(*[(r.item_id, r.text) for r in bench.collect()], strict=True))
    want = set()
    for i, t in texts.items():
        ids = items.encode(t)
        for k, own in enumerate(items.words):
            if np.isin(own, ids).mean() >= 0.5 and decontaminate.align(own, ids) >= 0.5:
                want.add((i, items.ids[k]))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want


# --- language -----------------------------------------------------------------------------

def test_model_is_a_distribution():
    text = ["the cat sat on the mat and the dog ate the rat", "a hat that sat"]
    counts = {}
    for lang, t in (("x", text), ("y", ["der hund und die katze", "das haus"])):
        counts[lang] = np.unique(langid.grams(*langid.encode(t))[0], return_counts=True)
    m = langid.kneser_ney(counts)
    chars = m.hashes[0]
    for ctx in [*m.contexts[2][:20], np.uint64(0x0041_0042_0043)]:
        keys = (np.uint64(ctx) << np.uint64(16)) | chars
        lp = np.stack([-m.cross_entropy(k[None], np.zeros(1, int), 1)[0][0] for k in keys])
        assert np.allclose(np.exp(lp).sum(axis=0) + np.exp(_unseen(m, ctx)), 1, atol=1e-4)


def _unseen(m, ctx):
    key = (np.uint64(ctx) << np.uint64(16)) | np.uint64(0x7F)
    return -m.cross_entropy(np.array([key]), np.zeros(1, int), 1)[0][0]


def test_held_out_accuracy_and_long_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("cells", [12_000, 40])
def test_a_counted_model_scores_as_the_whole_one(spark, cells):
    """A model over the bound keeps every 4-gram and language, a rare one of single counts too."""
    rows = table(spark, SF, "documents").where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    odd = [(-1, "Ljubav zmaja grozdje", "rare"), (-2, "zmaja Ljubav", None), (-3, "", None), (-4, None, None), (-5, "日本語 ж", None), (-5, "日本語 ж", None)]
    rows = rows.limit(150).union(spark.createDataFrame(odd, rows.schema))
    learned = rows.where("lang IS NOT NULL")
    whole, part = langid.train(learned), langid.train(learned, max_cells=cells)
    assert part.langs == whole.langs and "rare" in part.langs
    want, got = ([tuple(r) for r in langid.score(rows, m, "doc_id").orderBy("doc_id").collect()] for m in (whole, part))
    assert len(got) == len(want) == rows.count()
    for w, g in zip(want, got, strict=True):
        assert (w[0], w[1], w[4]) == (g[0], g[1], g[4])
        assert w[2:4] == pytest.approx(g[2:4], abs=1e-5)
    assert {g[1] for g in got if g[0] in (-1, -2)} == {"rare"}


def test_model_against_a_plain_kneser_ney(spark):
    """Cross-entropies by dictionaries of strings, from the definition."""
    texts = {"x": ["the cat sat on the mat", "that hat, the cat's"], "y": ["der hund und die katze", "das haus der katze"], "z": ["a"]}
    probe = ["the cat", "die katze sat", "zzz qq", "a", "hat der hund"]
    rows = [(k, t, lang) for lang, own in texts.items() for k, t in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    norm = lambda t: " " + re.sub(r"[^a-z]+", " ", t.lower()).lstrip(" ")
    pad = lambda t: "\0\0" + norm(t)
    four = lambda t: [pad(t)[i:i + 4] for i in range(len(pad(t)) - 3)]

    def discount(c):
        one, two = (sum(v == n for v in c.values()) for n in (1, 2))
        return min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5

    levels = {}
    for lang, own in texts.items():
        c = {4: Counter(g for t in own for g in four(t))}
        for o in (3, 2, 1):
            c[o] = Counter(g[1:] for g in c[o + 1])
        levels[lang] = c
    n_chars = len({g for c in levels.values() for g in c[1]}) + 1

    def prob(lang, gram):
        c = levels[lang][len(gram)]
        d = discount(c)
        if len(gram) == 1:
            total = sum(c.values())
            return d * len(c) / total / n_chars + (c[gram] - d) / total * (gram in c)
        follow = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        total = sum(follow.values())
        if not total:
            return prob(lang, gram[1:])
        return d * len(follow) / total * prob(lang, gram[1:]) + (c[gram] - d) / total * (gram in c)

    model = langid.train(df)
    assert model.langs == sorted(texts)
    key, owner = langid.grams(*langid.encode(probe))
    got = model.cross_entropy(key, owner, len(probe))[0]
    want = np.array([[-sum(np.log(prob(lang, g)) for g in four(t)) for lang in model.langs] for t in probe])
    assert np.allclose(got, want, rtol=1e-4), (got, want)


def test_a_language_of_calibration_rows_only_is_learned(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    rest = [k for k in range(10**6, 10**6 + 400) if zlib.crc32(str(k).encode()) % 4 == 3][:30]
    asked = [k for k in range(10**6, 10**6 + 400) if zlib.crc32(str(k).encode()) % 4 == 2][:5]
    say = lambda k: f"ljubav zmaja grozdje cvijet zvijezda nebo {k} more ljeto zima proljece jesen kisa " * 4
    more = [(k, say(k), "rare") for k in rest] + [(k, say(k), "rare") for k in asked]
    got = langid.identify(docs.union(spark.createDataFrame(more, docs.schema))).where("doc_id >= 1000000").collect()
    assert {r.lang_pred for r in got} == {"rare"} and sum(r.held_out for r in got) == len(asked)


def test_foreign_script_is_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select(*DOCUMENT_COLUMNS)
    rnd = random.Random(8)
    noise = ["".join(rnd.choice("бвгджзклмнпрст ") for _ in range(800)), "".join(rnd.choice("qxzjkwv ") for _ in range(800))]
    more = docs.union(spark.createDataFrame([(-1 - k, t, None, "s", 800) for k, t in enumerate(noise)], docs.schema))
    kept = {r.doc_id for r in langid.accepted(more).select("doc_id").collect()}
    assert -1 not in kept and -2 not in kept and len(kept) >= 0.99 * docs.count()


# --- rules, lines, licences ---------------------------------------------------------------

def test_ablations(spark):
    led = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64 | 4,), (64,)], "failures bigint")
    got = {(r.policy, r.rule): (r.n_failed, r.n_only) for r in quality_rules.ablations(led).collect()}
    assert got[("base", "few_words")] == (3, 2) and got[("base", "repeated_windows")] == (1, 0)
    assert got[("v1", "symbols")] == (2, 2) and got[("v2", "symbols")] == (2, 1) and got[("v2", "exclamations")] == (2, 1)


def test_lines_over_the_ratio_go(spark):
    rows = [(k, f"Menu \nown line {k}\n\n" + ("often" if k < 10 else f"else {k}"), "h") for k in range(60)]
    rows += [(100 + k, "Menu\nrare", "small") for k in range(4)] + [(200 + k, "Menu", None) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0] == ("own line 0\n", 4, 2) and got[59] == ("own line 59\n\nelse 59", 4, 1)
    assert got[100] == ("", 2, 2) and got[200] == ("Menu", 1, 0)  # two of four pages are over the ratio, too


def test_licences_in_prose(spark, docs):
    prose = "one ordinary sentence follows another here and nothing in them speaks of rights or of terms at all today"
    notes = [(0, "Released under the MIT License."), (1, f"{prose} {prose} {prose} Licensed under the Apache License, Version 2.0. {prose}"),
             (2, prose), (3, "Released under the zlib license."), (4, f"{prose}\nThis work is licensed under the GNU General Public License, version 3.")]
    df = docs.select("doc_id", "text").where("doc_id >= 10").union(spark.createDataFrame(notes, "doc_id bigint, text string"))
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(df, 600).where("doc_id < 10").collect()}
    assert got == {(0, 0): "MIT", (1, 0): "Apache-2.0", (3, 0): "unknown", (4, 1): "GPL-3.0"}


def test_every_notice_of_a_line(spark, docs):
    prose = "one ordinary sentence follows another here and nothing in them speaks of rights or of terms at all today " * 6
    parts = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
             "Released under the MIT License."]
    df = docs.select("doc_id", "text").where("doc_id >= 10").union(spark.createDataFrame([(0, prose + prose.join(parts) + prose)], "doc_id bigint, text string"))
    rows = licenses.scan(df, 600).where("doc_id = 0").orderBy("first_word").collect()
    assert [r.family for r in rows] == ["MIT", "GPL-3.0", "MIT"]
    assert {r.paragraph for r in rows} == {0} and len({r.first_word for r in rows}) == 3


# --- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages_against_plain_python(spark, docs):
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    cur = staged(docs, "in")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        cur = staged(stage(spark, cur, SF), "stage")
        outs.append(cur)
    rows = [{r.doc_id: r for r in o.collect()} for o in outs[:-1]]
    before = {r.doc_id: r for r in docs.collect()}
    assert all(rows[0][i] == before[i] for i in rows[0]) and len(rows[0]) >= 0.99 * len(before)
    lines, pages = Counter(), Counter(r.source for r in rows[0].values())
    key = lambda x: re.sub(r"^[ \t\r]+|[ \t\r]+$", "", x)
    for r in rows[0].values():
        lines.update({(r.source, key(x)) for x in r.text.split("\n") if key(x)})
    for i, r in rows[0].items():
        kept = [x for x in r.text.split("\n") if not (key(x) and lines[r.source, key(x)] >= 2 and lines[r.source, key(x)] > 0.1 * pages[r.source])]
        assert rows[1][i].text == "\n".join(kept)
    ids = sorted(rows[1])
    root = _roots([_fingerprint(rows[1][i].text) for i in ids])
    assert set(rows[2]) == {ids[k] for k in range(len(ids)) if root[k] == k}
    items = decontaminate.Items(*zip(*bench, strict=True))
    leak = {i for i, r in rows[2].items() for k, own in enumerate(items.words)
            if np.isin(own, items.encode(r.text)).mean() >= 0.5 and decontaminate.align(own, items.encode(r.text)) >= 0.5}
    assert set(rows[3]) == set(rows[2]) - leak
    want = _ids("byte_bpe_50k.json", {i: r.text for i, r in rows[3].items()}, 2)
    got = Counter()
    for r in outs[-1].collect():
        got[r.doc_id] += r.length
    assert got == {i: len(x) for i, x in want.items()}
