"""Every operator and pipeline stage on null, empty, long, repeated and clashing input."""

import pytest

import corpus_pipeline
from aerolith.llm import (decontaminate, langid, licenses, line_dedup, packing, quality_rules, simhash, suffix_dedup,
                          token_files)
from aerolith.llm.queries import tokenizer_file

LONG = " ".join(f"word{i % 977} stands, here" for i in range(40_000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away into the green woods of the north country"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines int, n int, fp string, row_key string, "
          "host string, lines string, anchor int, length int, rank int, part int, score double, kept boolean")
ROWS = [
    (1, PLAIN, "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\r\n \x0b\x0c ", "en", "a", 5),
    (None, PLAIN, "en", "b", 10), (None, None, None, None, None), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
    (7, PLAIN, "en", "a", 10), (7, PLAIN, "en", "a", 10), (8, "one", "de", "a", 3), (8, "zwei drei", "de", "a", 9),
    (9, "日本語のテキスト 12 é", "ja", "c", 12), (10, "12 34 !!", "en", "a", 8),
]


@pytest.fixture(scope="module")
def nasty(spark):
    rest = (1, 2, "x", "y", "h", "l", 3, 4, 5, 6, 0.5, True)
    return spark.createDataFrame([r + rest for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PLAIN), (2, None), (3, ""), (4, "one"), (4, PLAIN)], "item_id bigint, text string")


OPERATORS = {
    "licenses": (lambda d, b: licenses.scan(d, 50), None),
    "packing": (lambda d, b: packing.pack_documents(d, tokenizer_file("byte_bpe_50k.json")), None),
    "quality": (lambda d, b: quality_rules.apply_policy(quality_rules.ledger(quality_rules.measure(d)), "v2"), len(ROWS)),
    "tokens": (lambda d, b: token_files.round_trip(d, tokenizer_file("word_bpe_49k.json")), len(ROWS)),
    "lines": (lambda d, b: line_dedup.drop_boilerplate(d), len(ROWS)),
    "leaks": (lambda d, b: decontaminate.leaks(d, b), 8),  # four rows hold PLAIN, two items have it
    "suffix": (lambda d, b: suffix_dedup.remove_repeats(d), len(ROWS)),
    "language": (lambda d, b: langid.identify(d), len(ROWS)),
    "simhash": (lambda d, b: simhash.near_duplicates(d), len(ROWS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(nasty, items, name):
    op, rows = OPERATORS[name]
    got = op(nasty, items).collect()
    assert rows is None or len(got) == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nasty, items, name):
    assert OPERATORS[name][0](nasty.limit(0), items).count() == 0


def test_no_items(nasty, items):
    assert decontaminate.leaks(nasty, items.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, nasty, items, tmp_dir):
    items.write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = nasty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tmp_dir)
        assert out.columns == corpus_pipeline.DOCUMENT_COLUMNS, name
        out.collect()
    assert corpus_pipeline.best_fit_packing(spark, docs, tmp_dir).count() >= len(ROWS)


def test_stages_on_an_empty_table(spark, nasty, items, tmp_dir):
    items.write.parquet(f"{tmp_dir}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nasty.limit(0), tmp_dir).count() == 0


def test_row_filters_tell_equal_ids_apart(spark, nasty):
    kept = simhash.representatives(nasty)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.select("doc_id", "text").collect())
    # the empty texts are one class, so are the copies of PLAIN (one without an id) and LONG; 8 has two texts
    assert [i for i, _ in rows] == [1, 2, 5, 8, 8, 9, 10]
    gone = decontaminate.clean(nasty, spark.createDataFrame([(1, PLAIN)], "item_id bigint, text string"))
    assert gone.count() == len(ROWS) - 4


def test_defined_results(nasty):
    lang = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(nasty).where("lang_pred = 'und'").collect()}
    assert lang == {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (None, "und", 0.0), (10, "und", 0.0)}
    fp = {r.doc_id: r.fp for r in simhash.near_duplicates(nasty).where("doc_id in (2, 3, 4)").collect()}
    assert fp == {2: 0, 3: 0, 4: 0}
    packed = packing.pack_documents(nasty, tokenizer_file("byte_bpe_50k.json")).where("doc_id in (2, 3)").collect()
    assert [(r.piece, r.start, r.length) for r in packed] == [(0, 0, 1)] * 2
    quality = quality_rules.measure(nasty).where("doc_id in (2, 3, 4)").collect()
    assert all(r.n_words == r.word_chars == r.n_repeat_words == 0 for r in quality)
    lines = {r.doc_id: (r.text, r.n_lines) for r in line_dedup.drop_boilerplate(nasty).where("doc_id in (2, 3)").collect()}
    assert lines == {2: (None, 0), 3: ("", 1)}


def test_small_hosts_and_clashing_names_of_lines(spark):
    """The ratio decides for a host of any size; inner columns take no name of the input."""
    names = ("doc_id bigint, text string, source string, host string, lines string, split string, kept string, _host int, "
             "__host int, n int, line int, pages int, n_lines int, n_dropped int")
    rest = ("h", "l", "s", "k", 1, 2, 3, 4, 5, 6, 7)
    rows = [(k, f"own line {k}\nthe footer", "small", *rest) for k in range(4)] + [(9, "alone\nthe footer", "one", *rest)]
    df = spark.createDataFrame(rows, names)
    out = line_dedup.drop_boilerplate(df)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.host, r.kept, r["__host"]) for r in out.collect()}
    assert got == {k: (f"own line {k}", 2, 1, "h", "k", 2) for k in range(4)} | {9: ("alone\nthe footer", 2, 0, "h", "k", 2)}
    kept = line_dedup.drop_boilerplate(df, counts=("before", "gone"))
    assert kept.columns == [*df.columns, "before", "gone"] and {(r.n_lines, r.n_dropped) for r in kept.collect()} == {(6, 7)}
