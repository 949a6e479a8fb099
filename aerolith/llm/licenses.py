"""Licence scan by a trained paragraph classifier [native].

A paragraph is a line; longer ones are read in windows of ``WINDOW`` words, half a window
apart, so that a notice inside prose is seen whole. Word 1- and 2-grams are hashed into a
sparse vector, and a multinomial logistic regression (pyspark.ml, on the JVM) tells the
licence families and ``none`` apart. It is trained on the templates, bare and set between
words of ordinary paragraphs, against ``NEGATIVES`` ordinary paragraphs of the corpus
(bounded by that parameter; the choice is by hash, the same every time). Half of the
notices of families without a class train the class ``other``.

The limit of the ``unknown`` class is calibrated on rows kept out of training: known
notices, and the other half of those without a class. A named family must also be confirmed
by one of its templates: share of common word 3-grams, of the shorter of the two.

A paragraph yields a row per notice. A confirmed notice is where its window agrees with the
template; places that overlap, and those of one family less than half a window apart, are one
notice, an unconfirmed window that reaches into a place belongs to it, and other unconfirmed
windows that overlap are one. Each window names one family, so of two notices within the same
``WINDOW`` words one may be missed.

Defined results: a null or empty text has no paragraphs; a null doc_id is kept; repeated
rows give repeated paragraphs once per distinct row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.llm.common import keyed, staged
from aerolith.llm.license_templates import TEMPLATES, UNKNOWN

WINDOW = 40
FEATURES = 1 << 15
NEGATIVES = 3000
CONTEXTS = (0, 4, 12)
SIMILAR = 0.6
#: Range of the calibrated least probability of a licence.
LICENCE = (0.25, 0.5)
CLASSES = ["none", *TEMPLATES, "other"]
_CUE = r"(?i)licen[cs]|copyright|copyleft|public domain|all rights|permission|redistribut"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def paragraph_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, paragraph, first_word, w): every window of every paragraph."""
    lines = keyed(docs).select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    words = lines.select("doc_id", "row_key", "paragraph", _words(F.col("line")).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - WINDOW // 2 - 1, F.lit(0))
    # cut before the rows are made: a window's row holds its own words only
    cut = F.transform(F.sequence(F.lit(0), last, F.lit(WINDOW // 2)), lambda s: F.struct(s.alias("first_word"), F.slice("w", s + 1, WINDOW).alias("w")))
    return words.select("doc_id", "row_key", "paragraph", F.explode(cut).alias("x")).select("doc_id", "row_key", "paragraph", "x.*")


def _featured(rows: DataFrame) -> DataFrame:
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(
        rows.withColumn("terms", F.concat("w", pairs))).drop("terms")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f"{family}:{k}", family, CLASSES.index(family), text)
            for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    rows += [(f"unknown:{k}", "unknown", -1 if k % 2 else CLASSES.index("other"), text) for k, text in enumerate(UNKNOWN)]
    rows = [(slot, *row) for slot, row in enumerate(rows)]
    return (spark.createDataFrame(rows, "slot int, template string, family string, label int, text string")
            .select("slot", "template", "family", "label", _words(F.col("text")).alias("tw")))


def training_rows(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """(label, held, w): templates between ``CONTEXTS`` words of ordinary paragraphs, and
    the paragraphs themselves; label -1 is a family without a class."""
    spark = docs.sparkSession
    some = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(max(negatives // 4, 1))
    plain = (paragraph_windows(docs.join(some, "doc_id", "left_semi"))
             .where(~F.concat_ws(" ", "w").rlike(_CUE))
             .orderBy(F.xxhash64("doc_id", "row_key", "paragraph", "first_word")).limit(negatives)
             .withColumn("k", F.monotonically_increasing_id()).select("k", "w"))
    plain = staged(plain, "licence-negatives")
    templates = _templates(spark)
    n = sum(map(len, TEMPLATES.values())) + len(UNKNOWN)
    mixed = plain.select(F.pmod("k", F.lit(n)).cast("int").alias("slot"), "k", F.explode(F.array(*map(F.lit, CONTEXTS))).alias("c"), "w")
    around = F.concat(F.slice("w", 1, F.col("c")), F.col("tw"), F.slice("w", F.col("c") + 1, F.col("c") * 2))
    held = F.pmod(F.xxhash64("k"), F.lit(5)) == 0
    return (templates.join(mixed, "slot")
            .select("label", held.alias("held"), F.slice(around, 1, WINDOW).alias("w"))
            .union(plain.select(F.lit(0), held, "w"))
            .union(templates.where("label > 0").select("label", F.lit(False), "tw")))


def train(docs: DataFrame, negatives: int = NEGATIVES) -> tuple[LogisticRegressionModel, float, float]:
    """The classifier, the least probability of a licence (twice what any ordinary paragraph
    kept out of training gets, within ``LICENCE``), and the least share of its family."""
    rows = staged(_featured(training_rows(docs, negatives)), "licence-training")
    fit = rows.where("label >= 0 AND NOT held").withColumn("label", F.col("label").cast("double"))
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=0.002).fit(fit)
    kept_out = staged(_judged(rows.where("held OR label = -1"), model).select("label", "licence", "best", "p"), "licence-calibration")
    plain = kept_out.where("label = 0").agg(F.max("licence").alias("p")).head()["p"] or 0.0
    licence = min(max(2 * plain, LICENCE[0]), LICENCE[1])
    kept_out = kept_out.where(F.col("licence") >= licence)
    grid = F.explode(F.array(*[F.lit(x / 20) for x in range(4, 20)])).alias("limit")
    named = (F.col("p") >= F.col("limit")) & (F.col("best") < len(CLASSES) - 1)
    good = F.when(named, F.col("label") == F.col("best")).otherwise(F.col("label").isin(-1, len(CLASSES) - 1))
    # each side counts the same, however many rows it has
    sides = kept_out.select("label", "p", "best", grid).groupBy("limit", (F.col("label") == -1).alias("foreign")).agg(F.avg(good.cast("double")).alias("right"))
    best = sides.groupBy("limit").agg(F.avg("right").alias("right")).orderBy(F.desc("right"), "limit").head()
    return model, licence, float(best["limit"]) if best else 0.5


def _judged(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """``licence``: probability of any licence; ``best`` and ``p``: the likeliest family and its share of that."""
    scored = model.transform(rows).withColumn("probs", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction", "features")
    known = scored.withColumn("families", F.slice("probs", 2, len(CLASSES))).withColumn("top", F.array_max("families"))
    licence = F.lit(1.0) - F.get("probs", F.lit(0))
    return (known.withColumn("licence", licence).withColumn("p", F.col("top") / F.greatest(licence, F.lit(1e-9)))
            .withColumn("best", F.array_position("families", F.col("top")).cast("int")).drop("probs", "families", "top"))


def _grams(w: Column) -> Column:
    n = F.size(w)
    return F.array_distinct(F.when(n < 3, F.array(F.concat_ws(" ", w))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(w, i + 1, 3)))))


def scan(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """(doc_id, paragraph, family, licence_probability, family_probability, template,
    similarity, confirmed, first_word): the licence notices, each with its best window and its
    first word. ``family`` is ``unknown`` unless the classifier names one and a
    template of it confirms it."""
    spark = docs.sparkSession
    model, licence, limit = train(docs, negatives)
    hits = staged(_judged(_featured(paragraph_windows(docs)), model).where(F.col("licence") >= licence), "licence-windows")
    templates = F.broadcast(_templates(spark).where("family <> 'unknown'")  # the fixed list of templates
                            .select("template", F.col("label").alias("best"), "family", _grams(F.col("tw")).alias("tg")))
    grams = hits.withColumn("g", _grams(F.col("w")))
    same = F.size(F.array_intersect("g", "tg")) / F.least(F.size("g"), F.size("tg"))
    compared = (grams.join(templates, "best", "left")
                .withColumn("similarity", F.when(F.col("tg").isNull(), 0.0).otherwise(same))
                .withColumn("confirmed", (F.col("p") >= limit) & (F.col("similarity") >= SIMILAR)))
    third = F.transform("w", lambda x, i: F.concat_ws(" ", F.slice("w", i + 1, 3)))
    agree = F.filter(F.transform(third, lambda g, i: F.when(F.array_contains("tg", g), i)), lambda i: i.isNotNull())
    compared = (compared.withColumn("agree", F.when(F.col("confirmed"), agree))
                .withColumn("lo", F.col("first_word") + F.coalesce(F.array_min("agree"), F.lit(0)))
                .withColumn("hi", F.col("first_word") + F.least(F.coalesce(F.array_max("agree") + 2, F.size("w") - 1), F.size("w") - 1)))
    rank = F.struct("confirmed", "similarity", "licence", "p", "template", "family", "lo", "hi")
    line = ["doc_id", "row_key", "paragraph"]
    windows = compared.groupBy(*line, "first_word").agg(F.max(rank).alias("t")).select(*line, "t", "t.confirmed", "t.lo", "t.hi")
    reach = F.max(F.when(F.col("confirmed"), F.col("hi"))).over(
        Window.partitionBy(*line).orderBy("lo").rangeBetween(Window.unboundedPreceding, WINDOW - 1))
    own = windows.withColumn("reach", reach).where("confirmed OR reach IS NULL OR reach < lo")

    def joined(places: DataFrame, kind: str, gap: int) -> DataFrame:
        """Places of a kind that overlap or are at most ``gap`` words apart as one, with the best ``t``."""
        order = Window.partitionBy(*line, kind).orderBy("lo", "hi")
        before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        begins = F.coalesce(F.col("lo") - before > gap, F.lit(True)).cast("int")
        return (places.withColumn("begins", begins)
                .withColumn("notice", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(*line, kind, "notice").agg(F.max("t").alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("notice"))

    family = F.when(F.col("t.confirmed"), F.col("t.family")).otherwise("unknown")
    places = joined(own, "confirmed", 0).withColumn("family", family)
    notices = joined(places.where("confirmed"), "family", WINDOW // 2).unionByName(places.where("NOT confirmed").select(*line, "family", "t", "lo", "hi"))
    return notices.select("doc_id", "paragraph", "family", F.col("t.licence").alias("licence_probability"),
                          F.col("t.p").alias("family_probability"), F.col("t.template").alias("template"),
                          F.col("t.similarity").alias("similarity"), F.col("t.confirmed").alias("confirmed"), F.col("lo").alias("first_word"))
