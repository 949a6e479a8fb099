"""The ``opN_<name>`` queries: each applies its operator, with production
parameters, to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import (decontaminate, hard_negatives, html_text, importance, langid, licenses, line_dedup, mixing, packing,
                          quality_rules, simhash, suffix_dedup, token_files)
from aerolith.llm.common import table
from aerolith.llm.registry import register



def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; it is installed on every node."""
    import public_tokenizers
    return public_tokenizers.path(name)


#: Policy of ``op4_quality_rules`` and the newest of the ledger.
QUALITY_POLICY = "v2"

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t,
             list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
pos AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
tri AS (SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
rep AS (SELECT k, i FROM tri QUALIFY count(*) OVER (PARTITION BY k, a, b, c) > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) s(o) GROUP BY k),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
             length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
      FROM w LEFT JOIN cov USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_letter_words < n_words OR 2 * n_exclamations > n_words) AS kept,
       CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
            + 8 * (2 * n_dup_lines > n_lines)::INT
            + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
            + 32 * (2 * n_letter_words < n_words)::INT + 64 * (2 * n_exclamations > n_words)::INT AS BIGINT) AS failures
FROM m
"""


@register("op4_quality_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents")))
    judged = quality_rules.apply_policy(quality_rules.apply_policy(led, QUALITY_POLICY), "base", "base_kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~F.col("base_kept")).alias("base_failed"), "kept", "failures")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, text FROM documents),
l AS (SELECT k, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM d WHERE text IS NOT NULL),
t AS (SELECT k, source, i, line, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line_key FROM l),
pages AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT source, line_key FROM (SELECT source, line_key, count(DISTINCT k) AS n FROM t
            WHERE line_key <> '' AND source IS NOT NULL GROUP BY source, line_key) JOIN pages USING (source)
        WHERE n >= 2 AND n > 0.1 * pages),
kept AS (SELECT k, count(*) AS n_lines, count(*) FILTER (bad.line_key IS NOT NULL) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (bad.line_key IS NULL), '') AS kept
         FROM t LEFT JOIN bad ON t.source = bad.source AND t.line_key = bad.line_key GROUP BY k)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE kept END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN kept USING (k)
"""


@register("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs).drop("source")


@register("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


@register("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@register("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@register("op8_suffix_array_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@register("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id,
                  CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.k AS a_k, a.vec_id AS anchor_id, v.k, v.vec_id, a.label = v.label AS same,
             CAST(list_inner_product(a.v, v.v) AS BIGINT) AS score
      FROM a JOIN v ON a.k <> v.k),
p AS (SELECT *, row_number() OVER (PARTITION BY a_k ORDER BY score DESC, vec_id NULLS LAST, k) AS p FROM s WHERE same QUALIFY p <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.a_k, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST, s.k) AS INTEGER) AS rank
      FROM p JOIN s ON s.a_k = p.a_k AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@register("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), every=100, relabel=7)


@register("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS BIGINT) AS size,
             md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)) AS key FROM d),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
             1 + rows // 2000 + source_size // 1048576 AS shards, source_size * 2 AS cap
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS rows FROM c GROUP BY source)),
w AS (SELECT *, [5, 2, 1][1 + (place - 1) % 3] AS weight FROM s),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS words FROM w),
fill(n, unit) AS (SELECT 0, CAST(0 AS DOUBLE)
    UNION ALL SELECT n + 1, again FROM (
        SELECT n, unit, (CAST((SELECT words * 150 FROM total) AS DOUBLE) / 100 - coalesce(sum(cap) FILTER (cap < weight * unit), 0))
                        / sum(weight) FILTER (NOT cap < weight * unit) AS again
        FROM fill, w GROUP BY n, unit) WHERE again <> unit AND n < 1000),
u AS (SELECT unit FROM fill ORDER BY n DESC LIMIT 1),
t AS (SELECT w.*, CASE WHEN cap < weight * unit THEN CAST(cap AS DOUBLE) ELSE weight * unit END AS target FROM w, u),
seat AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r
         FROM (SELECT place, target, unnest(range(0, CAST(target / 16 AS BIGINT) + 2)) AS k FROM t)),
q AS (SELECT place, count(*) AS quota FROM seat, total WHERE r <= floor(least(words * 1.5, words * 2) / 16 + 0.5) GROUP BY place),
p AS (SELECT c.*, place, source_size, target, CAST(('0x' || substr(key, 1, 15)) AS BIGINT) % shards AS shard
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
ring AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS a,
                sum(size) OVER (PARTITION BY place, shard) AS ring FROM p),
sh AS (SELECT place, shard, any_value(ring) AS ring FROM ring GROUP BY place, shard),
sseat AS (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY ring / (2 * k + 1) DESC, shard, k) AS r
          FROM (SELECT place, shard, ring, unnest(range(0, CAST(2 * ring // 16 AS BIGINT) + 3)) AS k FROM sh)),
sq AS (SELECT place, shard, count(*) AS blocks FROM sseat JOIN q USING (place) WHERE r <= quota GROUP BY place, shard),
run AS (SELECT ring.*, CAST(('0x' || substr(md5('13:' || place || ':' || shard), 1, 15)) AS BIGINT) % greatest((ring + 15) // 16, 1) * 16 AS b,
               least(coalesce(blocks, 0) * 16, ring * 2) AS n FROM ring LEFT JOIN sq USING (place, shard))
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(b + n, a + size) - greatest(b, a), 0) + greatest(least(b + n, a + size + ring) - greatest(b, a + ring), 0)
            + greatest(least(b + n, a + size + 2 * ring) - greatest(b, a + 2 * ring), 0) AS BIGINT) AS taken
FROM run
"""


@register("op13_source_mixing", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))
