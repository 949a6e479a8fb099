"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once per document. The ledger keeps the measurements and
one BIGINT of failure bits; a policy is a versioned mask over those bits, so a new
policy or an ablation never reads a text again.

Defined results: a null or empty text has no words and fails ``few_words``; a null
doc_id is kept as it is; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import SPACE

#: Rule name -> (bit, failure condition over the ledger's measurements).
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "2 * n_dup_lines > n_lines"),
    "word_length": (4, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "letterless_words": (5, "2 * n_letter_words < n_words"),
    "exclamations": (6, "2 * n_exclamations > n_words"),
}

#: Policy version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_letter_words", "n_exclamations"]


def policy_mask(version: str) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[version])


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, *MEASURES), each as long.

    ``n_repeat_words`` counts the words covered by a 3-word window that occurs twice
    or more in the same text. Windows are compared by their 64-bit hashes. Only where a
    text has equal ones are they sorted with their positions: equal neighbours name the
    covered windows, and each covers as many new words as its distance to the next
    (3 at most). O(n log n) per text, no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    split = base.select(
        "doc_id", "t", _words(F.col("t")).alias("w"),
        F.split("t", "\n").alias("lines"))
    hashes = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
                         lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    lines = F.filter("lines", lambda x: x.rlike(f"[^{SPACE}]"))
    measured = split.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - count(f"[{SPACE}]")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"), lines.alias("lines"),
        count(rf"\p{{L}}[^{SPACE}]*").alias("n_letter_words"), count("!").alias("n_exclamations"), hashes.alias("h"))
    sizes = measured.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "repeats": F.size("h") > F.size(F.array_distinct("h"))})
    order = sizes.withColumn("s", F.when(F.col("repeats"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    same = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    covered = order.withColumn("pos", F.sort_array(F.transform(same, lambda x: x["p"])))
    steps = F.transform("pos", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("pos", i + 1) - p, F.lit(3))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return covered.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).select("doc_id", *MEASURES)


def ledger(measured: DataFrame) -> DataFrame:
    """Measurements plus ``failures``: bit b is set if the rule with bit b fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
            for bit, cond in RULES.values()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.withColumn("failures", mask)


def apply_policy(led: DataFrame, version: str, out: str = "kept") -> DataFrame:
    """Verdict of one policy version: kept if no bit of its mask is set."""
    return led.withColumn(out, F.col("failures").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0)


def ablations(led: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only): documents that fail a rule, and those that the
    policy without this rule would keep. Documents are first counted per bit pattern
    (2^rules rows at most), so the policies are compared on a handful of rows."""
    spark = led.sparkSession
    patterns = led.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame(
        [(v, policy_mask(v), r, 1 << RULES[r][0]) for v, rules in POLICIES.items() for r in rules],
        "policy string, mask long, rule string, bit long")
    hit = F.col("failures").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failures").bitwiseAND(F.col("mask")) == F.col("bit")
    return (patterns.join(F.broadcast(grid), hit)  # the grid is the fixed list above
            .groupBy("policy", "rule")
            .agg(F.sum("n").alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only")))
