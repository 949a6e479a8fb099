"""Landed JSON documents, parsed once and salvaged record by record (O-S9, O-E3, O-F16).

A document is one JSON text with a ``results`` array. Its text becomes a VARIANT, and every
element of ``results`` is read field by field against the explicit schema of its kind. So a
field of a wrong type costs that field, not the document: it becomes null and is named with
its text; a record whose key or time cannot be used is rejected, with its place in the
document. A document that is no JSON, or has no ``results``, is quarantined whole.

Every record of every document is counted as accepted, repaired or rejected, and every
document as read or failed; a :class:`Landing` may be written once below the shared root, so
that rows, rejects and counts of a job come from one parse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith import schemas
from aerolith.functions import scalars as X
from aerolith.session import written_once

NO_JSON, NO_RESULTS = "not JSON", "no results"
ACCEPTED, REPAIRED, REJECTED = "accepted", "repaired", "rejected"
#: A record's place in ``issues`` where it is no JSON object at all.
WHOLE_RECORD = "$"

#: Fields that a record cannot do without, by kind: of another type, or for times absent or
#: unparsable, the record is rejected. An absent key stays null, as the jobs judge that.
KEYS = {"locations": ("id",), "metadata": ("id",), "latest": ("locationsId", "sensorsId"), "measurements": ("locationsId", "sensorsId")}
TIMES = {"latest": ("datetime.utc",), "measurements": ("datetime",)}

_ISSUE = "array<struct<field:string,text:string>>"


def _present(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _issue(name: Column, v: Column, wrong: Column) -> Column:
    one = F.array(F.struct(name.alias("field"), F.to_json(v).alias("text")))
    return F.when(wrong, one).otherwise(F.array().cast(_ISSUE))


def _typed(v: Column, path: str, kind: T.DataType, name: Column) -> tuple[Column, Column]:
    """(the value at ``path`` of the variant as ``kind`` or null, issues): an issue for every value that
    is there and of another type. ``name`` is the field's place in the record."""
    raw = F.try_variant_get(v, path, "variant")
    if isinstance(kind, T.StructType):
        parts = [_typed(v, f"{path}.{f.name}", f.dataType, F.concat(name, F.lit(f".{f.name}"))) for f in kind]
        is_object = F.try_variant_get(v, path, "map<string,variant>").isNotNull()
        value = F.when(is_object, F.struct(*[p[0].alias(f.name) for p, f in zip(parts, kind, strict=True)]))
        return value, F.concat(_issue(name, raw, _present(raw) & ~is_object), *[p[1] for p in parts])
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(v, path, "array<variant>")
        place = lambda j: F.concat(name, F.lit("["), j.cast("string"), F.lit("]"))
        value = F.transform(items, lambda x: _typed(x, "$", kind.elementType, F.lit(""))[0])
        inner = F.flatten(F.transform(items, lambda x, j: _typed(x, "$", kind.elementType, place(j))[1]))
        return value, F.concat(_issue(name, raw, _present(raw) & items.isNull()), F.coalesce(inner, F.array().cast(_ISSUE)))
    value = F.try_variant_get(v, path, kind.simpleString())
    return value, _issue(name, raw, _present(raw) & value.isNull())


def _issues(v: Column, path: str, kind: T.DataType, name: Column, value: Column) -> list[Column]:
    """The issues of ``_typed`` where its value is known: the variant is asked again for null values only."""
    if isinstance(kind, T.ArrayType):
        return [_typed(v, path, kind, name)[1]]
    own = _issue(name, F.try_variant_get(v, path, "variant"), value.isNull() & _present(F.try_variant_get(v, path, "variant")))
    if not isinstance(kind, T.StructType):
        return [own]
    inner = [_issues(v, f"{path}.{f.name}", f.dataType, F.concat(name, F.lit(f".{f.name}")), value[f.name]) for f in kind]
    return [own, *[x for part in inner for x in part]]


def _element(kind: str) -> T.StructType:
    return schemas.PAYLOAD_SCHEMAS[kind]["results"].dataType.elementType


def _read(item: Column, index: Column, kind: str) -> Column:
    """One element of ``results`` with its fields."""
    return F.struct(index.alias("record"), item.alias("item"), F.try_variant_get(item, "$", "map<string,variant>").isNotNull().alias("is_object"),
                    F.struct(*[_typed(item, f"$.{f.name}", f.dataType, F.lit(f.name))[0].alias(f.name) for f in _element(kind)]).alias("r"))


def _record(x: Column, kind: str) -> Column:
    """An element that was read, with its issues."""
    item, is_object = x["item"], x["is_object"]
    parts = [y for f in _element(kind) for y in _issues(item, f"$.{f.name}", f.dataType, F.lit(f.name), x["r"][f.name])]
    issues = F.concat(_issue(F.lit(WHOLE_RECORD), item, ~is_object), *parts)
    for path in TIMES.get(kind, ()):  # without its time a record has no place in a table
        text = F.try_variant_get(item, f"$.{path}", "string")
        no_time = is_object & X.parse_utc(text).isNull()
        bad = F.array(F.struct(F.lit(path).alias("field"), text.alias("text")))
        known = F.transform(issues, lambda i: i["field"])
        issues = F.when(no_time & ~F.array_contains(known, path), F.concat(issues, bad)).otherwise(issues)
    return F.struct(x["record"].alias("record"), x["r"].alias("r"), issues.alias("issues"), item.alias("item"))


def _status(issues: Column, kind: str) -> Column:
    needed = [WHOLE_RECORD, *KEYS.get(kind, ()), *TIMES.get(kind, ())]
    lost = F.exists(issues, lambda i: i["field"].isin(needed))
    return F.when(lost, F.lit(REJECTED)).when(F.size(issues) > 0, F.lit(REPAIRED)).otherwise(F.lit(ACCEPTED))


@dataclass(frozen=True)
class Landing:
    """The documents of one kind: (document, file_path, reason, text, records, n_accepted, n_repaired,
    n_rejected), a row each. ``reason`` is null for documents that were read."""

    kind: str
    documents: DataFrame

    def results(self) -> DataFrame:
        """(document, results): the usable records of each document that was read, in order."""
        usable = F.filter("records", lambda x: x["status"] != REJECTED)
        return self.documents.where(F.col("reason").isNull()).select("document", F.transform(usable, lambda x: x["r"]).alias("results"))

    def rows(self) -> DataFrame:
        """The usable records, exploded."""
        return self.results().select(F.explode("results").alias("r")).select("r.*")

    def quarantined(self) -> DataFrame:
        """(file_path, reason, _corrupt_record): documents that could not be read, whole."""
        return self.documents.where(F.col("reason").isNotNull()).select("file_path", "reason", F.col("text").alias("_corrupt_record"))

    def _marked(self, status: str) -> DataFrame:
        own = F.filter("records", lambda x: x["status"] == status)
        return self.documents.select("file_path", "document", F.explode(own).alias("x"))

    def rejected(self) -> DataFrame:
        """(file_path, document, record, issues, text): records that cannot be used, by their place from 0,
        with the fields to blame."""
        return self._marked(REJECTED).select("file_path", "document", "x.record", "x.issues", "x.text")

    def repaired(self) -> DataFrame:
        """(file_path, document, record, field, text): fields that became null, a row each."""
        return (self._marked(REPAIRED).select("file_path", "document", "x.record", F.explode("x.issues").alias("i"))
                .select("file_path", "document", "record", "i.field", "i.text"))

    def ledger(self) -> DataFrame:
        """One row: documents, failed_documents, records, accepted, repaired, rejected; the last three add
        up to the records of the documents that were read."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        of = {s: total(f"n_{s}").alias(s) for s in (ACCEPTED, REPAIRED, REJECTED)}
        return self.documents.agg(
            F.count(F.lit(1)).alias("documents"), F.count("reason").alias("failed_documents"),
            total(F.col("n_accepted") + F.col("n_repaired") + F.col("n_rejected")).alias("records"), *of.values())

    def counts(self) -> dict[str, int]:
        return self.ledger().first().asDict()


def texts(spark: SparkSession, path: str, whole_file: bool) -> DataFrame:
    """(text, file_path): a file each, or a line each but blank ones. Spark's file sources leave out files
    of no bytes, so an empty file is no document."""
    found = spark.read.text(path, wholetext=whole_file).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file_path"))
    return found if whole_file else found.where(~F.col("text").rlike(r"^\s*$"))


def landing(spark: SparkSession, kind: str, path: str, multiline: bool = True, once: bool = False) -> Landing:
    """The documents below ``path``: a file each, or with ``multiline=False`` a line each (blank lines are
    none). ``once`` writes the parsed documents below the shared root and reads that. Unknown kinds raise."""
    if kind not in schemas.PAYLOAD_SCHEMAS:
        raise ValueError(f"Unknown extraction type: {kind}")
    lines = texts(spark, path, multiline)
    doc = F.try_parse_json("text")
    items = F.try_variant_get("doc", "$.results", "array<variant>")
    read = (lines.withColumn("document", F.monotonically_increasing_id()).withColumn("doc", doc)
            .withColumn("items", items)
            .withColumn("reason", F.when(F.col("doc").isNull(), F.lit(NO_JSON)).when(F.col("items").isNull(), F.lit(NO_RESULTS))))
    found = read.withColumn("found", F.transform("items", lambda x, i: _read(x, i, kind)))
    judged = F.transform(F.transform("found", lambda x: _record(x, kind)), lambda x: F.struct(
        x["record"].alias("record"), x["r"].alias("r"), x["issues"].alias("issues"), _status(x["issues"], kind).alias("status"),
        F.when(F.size(x["issues"]) > 0, F.to_json(x["item"])).alias("text")))
    count = lambda s: F.size(F.filter("records", lambda x: x["status"] == s)).cast("bigint").alias(f"n_{s}")
    docs = (found.withColumn("records", F.coalesce(judged, F.array()))
            .select("document", "file_path", "reason", F.when(F.col("reason").isNotNull(), F.col("text")).alias("text"), "records",
                    count(ACCEPTED), count(REPAIRED), count(REJECTED)))
    return Landing(kind, written_once(docs, f"landing-{kind}") if once else docs)
