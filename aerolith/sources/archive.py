"""Archive source (O-S1 .. O-S3): gzip CSV with a header, laid out in
Hive-style partitions ``locationid=/year=/month=``.

One scan covers every requested location and month: the selection is a
predicate on the partition columns, which Spark evaluates against the
partition listing (``PartitionFilters``) before any file is opened, instead
of one read per path. gzip files are not splittable, so each file is one
task; ``min_partitions`` spreads a scan of few large files after the read.

Spark's reader lists and plans every file on the driver. The load and the
search for missing partitions take the files from ``listed_files``, which
tasks list, and tasks read them, so the driver holds nothing for each file.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith import schemas
from aerolith.functions import scalars as X
from aerolith.session import path_exists, qualified, written_once

ARCHIVE_READ_SCHEMA = T.StructType(schemas.ARCHIVE_CSV.fields + schemas.ARCHIVE_PARTITIONS.fields)


def _month_index(text: str) -> int:
    d = dt.datetime.strptime(text, "%Y-%m")
    return d.year * 12 + d.month - 1


def month_key(year_col: str = "year", month_col: str = "month"):
    """year*12 + month-1 over partition columns (month is text, T1)."""
    return F.col(year_col) * 12 + F.col(month_col).cast("long") - 1


def scan_archive(spark: SparkSession, base: str) -> DataFrame:
    """O-S1 the whole archive with an explicit schema (``month`` stays text).
    Lines that do not parse are left out; ``corrupt_lines`` has them."""
    return _archive_lines(spark, base).where(_line_text() == "").drop(CORRUPT)


CORRUPT = "_corrupt_record"
#: What became of a line: in the fact, in it with a null time, not parsed (the line or its time), not asked for.
STORED, WITHOUT_TIME, UNPARSABLE, OUTSIDE = "stored", "without_time", "unparsable", "outside"


def _line_text():
    """The text of a line that does not parse, else ''. Not a bare column: the CSV reader would take a
    filter on that one before it has parsed the line. The reader converts only columns that the plan
    asks for, so this asks for all: a line is judged alike whatever is selected of it."""
    asked = F.xxhash64(*[f.name for f in schemas.ARCHIVE_CSV.fields]) % 2 < 2  # always true, but the planner can't know
    return F.when(asked, F.coalesce(F.col(CORRUPT), F.lit("")))


def _archive_lines(spark: SparkSession, base: str, files: DataFrame | None = None) -> DataFrame:
    """The lines of the archive, parsed; with ``files`` those of these files, read by tasks."""
    if files is not None:
        return _lines_of(spark, base, files)
    schema = T.StructType([*ARCHIVE_READ_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema)
            .option("header", True).option("basePath", base)
            .option("columnPruning", False)  # a line is judged by all its columns
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .csv(base))


def _unparsable():
    time = F.coalesce(F.col("datetime"), F.lit(""))
    return (_line_text() != "") | ((time != "") & X.parse_utc(time).isNull())


def tagged_lines(spark: SparkSession, base: str, location_ids=None, start: str | None = None,
                 end: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """O-S1 + O-K1: every line of the selected partitions as a ``raw.air_quality`` row with its
    ``line_status``. A line with an empty time is a row with a null time, as the table allows it; a line
    that does not parse, or whose time does not, has that text in ``_corrupt_record``. One parse of each
    file serves rows, counts and rejects. ``files`` are those of ``listed_files``, where they are known."""
    files = listed_files(spark, base) if files is None else files
    df, asked = files if files is not None else _archive_lines(spark, base), F.lit(True)
    if start is not None and end is not None:
        df, asked = _select(df, location_ids, start, end)
    elif location_ids is not None:
        df, asked = _select(df, location_ids, "0001-01", "9999-12")
    if files is not None:
        df, asked = _archive_lines(spark, base, df.withColumn(ASKED, asked)), F.col(ASKED)
    no_time = F.coalesce(F.col("datetime"), F.lit("")) == ""
    status = (F.when(~asked, F.lit(OUTSIDE)).when(_unparsable(), F.lit(UNPARSABLE))
              .when(no_time, F.lit(WITHOUT_TIME)).otherwise(F.lit(STORED)))
    df = df.withColumn("line_status", status)
    text = F.when(F.col("line_status") == UNPARSABLE, F.coalesce(CORRUPT, "datetime")).otherwise(F.col(CORRUPT))
    return to_raw_rows(df.withColumn(CORRUPT, text), keep=("line_status", CORRUPT))


def rejected_lines(tagged: DataFrame) -> DataFrame:
    """What ``corrupt_lines`` gives, of lines that are tagged already."""
    return tagged.where(F.col("line_status") == UNPARSABLE).select("locationid", "year", "month", CORRUPT)


def line_ledger(tagged: DataFrame) -> DataFrame:
    """(line_status, lines) of ``tagged_lines``."""
    return tagged.groupBy("line_status").agg(F.count(F.lit(1)).alias("lines"))


def corrupt_lines(spark: SparkSession, base: str, location_ids=None, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """(locationid, year, month, _corrupt_record): archive lines that do not parse,
    or whose time does not, within the selection."""
    df = _archive_lines(spark, base)
    if start is not None and end is not None:
        df = select_partitions(df, location_ids, start, end)
    return df.where(_unparsable()).select("locationid", "year", "month", F.coalesce(CORRUPT, "datetime").alias(CORRUPT))


#: Location ids up to which a frame of them becomes an IN filter on the partitions.
MAX_IN_IDS = 50_000


def select_partitions(df: DataFrame, location_ids: DataFrame | list[int] | None,
                      start: str, end: str) -> DataFrame:
    """O-S2 locations x months from ``start`` to ``end`` ('YYYY-MM', both
    inclusive) as partition predicates. A list of ids becomes an IN filter, and
    so does an id frame of at most ``MAX_IN_IDS`` ids (counted first), so only
    their folders are read; a larger frame is semi-joined."""
    out, asked = _select(df, location_ids, start, end)
    return out.where(asked).select(*df.columns)


def _select(df: DataFrame, location_ids: DataFrame | list[int] | None, start: str, end: str) -> tuple[DataFrame, Column]:
    """(rows of the partitions that are read, whether a row was asked for)."""
    lo, hi = _month_index(start), _month_index(end)
    out = df.where(month_key().between(lo, hi))
    if location_ids is None:
        return out, F.lit(True)
    if isinstance(location_ids, DataFrame):
        ids = location_ids.select(F.col(location_ids.columns[0]).cast("long").alias("_asked"))
        ids = written_once(ids.where("_asked IS NOT NULL").distinct(), "archive-ids")
        if ids.count() > MAX_IN_IDS:
            return out.join(ids, F.col("locationid") == F.col("_asked"), "left"), F.col("_asked").isNotNull()
        location_ids = [r["_asked"] for r in ids.collect()]
    known = [str(int(i)) for i in location_ids]
    # as one text: a literal column each would cost the driver a call into the JVM for every id
    return out.where(F.expr(f"locationid IN ({', '.join(known)})") if known else F.lit(False)), F.lit(True)


def to_raw_rows(df: DataFrame, now=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """O-K1 projection into ``raw.air_quality``: parse the offset timestamp to
    UTC (T2), add the ingestion time, and the columns of ``keep``."""
    return df.select(
        "location_id", "sensors_id", "location", X.parse_utc("datetime").alias("datetime"),
        "lat", "lon", "parameter", "units", X.nan_to_null("value").alias("value"),
        "locationid", "month", "year",
        (now if now is not None else X.utc_now()).alias("ingestion_datetime"), *keep)


def read_archive(spark: SparkSession, base: str, location_ids=None, start: str | None = None,
                 end: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """O-C1 archive backfill read: scan + partition selection + projection."""
    df = scan_archive(spark, base)
    if start is not None and end is not None:
        df = select_partitions(df, location_ids, start, end)
    elif location_ids is not None:
        df = select_partitions(df, location_ids, "0001-01", "9999-12")
    if min_partitions:
        df = df.repartition(min_partitions)
    return to_raw_rows(df)


def requested_partitions(spark: SparkSession, location_ids: DataFrame, start: str,
                         end: str) -> DataFrame:
    """Every (locationid, year, month) asked for: ids x month sequence."""
    lo, hi = _month_index(start), _month_index(end)
    ids = location_ids.select(F.col(location_ids.columns[0]).cast("long").alias("locationid")).distinct()
    # each id expands to its month sequence (bounded by the date range); no join
    m = F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("_m")
    return ids.select("locationid", m).select(
        "locationid", (F.col("_m") / 12).cast("long").alias("year"),
        F.lpad(((F.col("_m") % 12) + 1).cast("string"), 2, "0").alias("month"))


def present_partitions(spark: SparkSession, base: str, files: DataFrame | None = None) -> DataFrame:
    """(locationid, year, month) of every archive file, from the file listing
    alone: that of ``listed_files``, or else the ``binaryFile`` source, which
    reads no content when only path-derived columns are selected. Types are
    fixed whatever partition inference says (an inferred month 1 becomes '01'
    again, T1)."""
    files = listed_files(spark, base) if files is None else files
    if files is not None:
        files = files.where(F.substring_index("path", "/", -1).contains(".csv"))
    else:
        files = (spark.read.format("binaryFile").option("basePath", base)
                 .option("pathGlobFilter", "*.csv*").load(base))
    return files.select(F.col("locationid").cast("long").alias("locationid"),
                        F.col("year").cast("long").alias("year"),
                        F.lpad(F.col("month").cast("string"), 2, "0").alias("month")).distinct()


def missing_partitions(spark: SparkSession, base: str, location_ids: DataFrame, start: str,
                       end: str, files: DataFrame | None = None) -> DataFrame:
    """O-S3 requested partitions absent from the archive: an anti-join of the
    request against the partitions listed (no data file is read)."""
    found = present_partitions(spark, base, files)
    req = requested_partitions(spark, location_ids, start, end)
    return req.join(found, ["locationid", "year", "month"], "left_anti")


def write_archive(df: DataFrame, base: str, mode: str = "overwrite") -> None:
    """Land gen 1 rows as the archive layout (gzip CSV, header, partitions).
    The timestamp is written as ISO-8601 with its UTC offset."""
    out = df.select(
        "location_id", "sensors_id", "location",
        F.date_format(F.col("datetime").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("datetime"),
        "lat", "lon", "parameter", "units", "value", "locationid", "year", "month")
    write_folders(out, base, mode, "gzip")


FOLDERS = ("locationid", "year", "month")


def _opener():
    """A function for the driver and the tasks: (file system, folder) of pyarrow for a path. What it needs
    travels with it: workers need not have this package."""
    def open_root(path: str):
        """s3a and s3n are S3 to pyarrow."""
        from pyarrow import fs
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return open_root


#: Whether the lines of a file were asked for.
ASKED = "_lines_asked"
#: What a task reads of small files, and how much of a file at once.
FILES_A_TASK, BYTES_A_TASK, READ_BYTES = 500, 32 << 20, 1 << 20


def listed_files(spark: SparkSession, base: str) -> DataFrame | None:
    """(path, bytes, locationid, year, month) of every archive file, listed by tasks and written once. It
    takes what Spark's file sources take: no hidden and no empty files, and none beside the partitions. None
    where those are needed: for a file system that pyarrow does not read, and where a folder or a file is not
    as ``write_folders`` and the collectors make them (other partition columns, no numbers, other suffixes)."""
    from pyarrow import fs
    root, open_root = qualified(spark, base), _opener()
    try:
        if re.search(r"[%?#]", root):  # not a plain URI
            return None
        files, top = open_root(root)
        if files.get_file_info(top).type != fs.FileType.Directory:
            return None
    except (ValueError, NotImplementedError, OSError):
        return None
    partitions, read_as_is = list(FOLDERS), ("csv", "gz", "bz2")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        files, top = open_root(root)
        for _ in batches:
            found = files.get_file_info(fs.FileSelector(top))
            for i in range(0, len(found), 10_000):
                some = found[i:i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in some], pa.string()), pa.array([x.size for x in some], pa.int64()),
                                                  pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())], ["path", "bytes", "folder"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        files, top = open_root(root)
        hidden = lambda x: (x[0] == "_" and "=" not in x and not x.startswith(("_metadata", "_common_metadata"))
                            or x[0] == "." or x.endswith("._COPYING_"))
        number = lambda x: None if x == "__HIVE_DEFAULT_PARTITION__" else int(x)

        def row(path: str, size: int):
            """The file with its partition, or None for one that no reader takes."""
            *folders, name = path[len(top):].strip("/").split("/")
            if not size or any(hidden(x) for x in (*folders, name)):
                return None
            while folders and "=" not in folders[-1]:  # a folder within a partition
                folders.pop()
            if not folders:
                return None
            keys, values = zip(*((k, v) for k, _, v in (x.partition("=") for x in folders)), strict=True)
            if (list(keys) != partitions or "" in values or name.startswith("_") or name.rpartition(".")[2] not in read_as_is
                    or not all(re.fullmatch(r"[+-]?[0-9]{1,18}|__HIVE_DEFAULT_PARTITION__", v) for v in values[:2])):
                return path, size, None, None, None, False
            month = None if values[2] == "__HIVE_DEFAULT_PARTITION__" else re.sub("%([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), values[2])
            return path, size, number(values[0]), number(values[1]), month, True

        for b in batches:
            rows = []
            for path, size, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if folder and hidden(path[len(top):].strip("/")):
                    continue
                found = files.get_file_info(fs.FileSelector(path, recursive=True)) if folder else []
                own = [(x.path, x.size) for x in found if x.type == fs.FileType.File] if folder else [(path, size)]
                rows += [r for r in (row(*x) for x in own) if r is not None]
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "bytes": pa.int64(), "locationid": pa.int64(), "year": pa.int64(), "month": pa.string(), "plain": pa.bool_()}
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], [*kinds])

    tops = spark.range(0, 1, 1, 1).mapInArrow(children, "path string, bytes bigint, folder boolean")
    found = (tops.repartition(4 * spark.sparkContext.defaultParallelism)
             .mapInArrow(below, "path string, bytes bigint, locationid bigint, year bigint, month string, plain boolean"))
    found = written_once(found, "archive-files")
    seen = found.agg(F.count(F.when(F.col("plain"), True)).alias("plain"), F.count(F.when(~F.col("plain"), True)).alias("other")).first()
    return found.drop("plain") if seen["plain"] and not seen["other"] else None


def _lines_of(spark: SparkSession, base: str, files: DataFrame) -> DataFrame:
    """What Spark's reader gives of ``files``, with their column ``ASKED``: a task reads many files, cuts
    them into lines without the header and blank ones, and Spark's CSV parser takes each line."""
    chosen = written_once(files.select("path", "bytes", *FOLDERS, ASKED), "archive-chosen")
    n = chosen.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(n["files"], spark.sparkContext.defaultParallelism), -(-n["files"] // FILES_A_TASK), -(-n["bytes"] // BYTES_A_TASK))
    root, open_root, at_once, columns = qualified(spark, base), _opener(), READ_BYTES, [*FOLDERS, ASKED]

    def lines_in(source) -> Iterator[list[bytes]]:
        """The lines as Hadoop's reader cuts them: at line feeds, carriage returns or both."""
        rest, start = b"", True
        while chunk := source.read(at_once):
            rest += chunk
            if start:
                rest, start = rest.removeprefix(b"\xef\xbb\xbf"), False
            end = max(rest.rfind(b"\n"), rest.rfind(b"\r", 0, -1)) + 1  # after a return at the end a feed may follow
            if end:
                yield rest[:end].splitlines()
                rest = rest[end:]
        yield rest.splitlines()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, blank, kinds = open_root(root)[0], bytes(range(33)), [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        held, size = [[] for _ in kinds], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds, strict=True)], ["line", *columns])

        for b in batches:
            for path, *at in zip(*(b.column(c).to_pylist() for c in ("path", *columns)), strict=True):
                header = True
                with source.open_input_stream(path, compression={"gz": "gzip", "bz2": "bz2"}.get(path.rpartition(".")[2])) as text:
                    for some in lines_in(text):
                        some = [x for x in some if x.strip(blank)]
                        if header and some:
                            header, some = False, some[1:]
                        for own, values in zip(held, [some, *([v] * len(some) for v in at)], strict=True):
                            own += values
                        size += sum(map(len, some))
                        if len(held[0]) >= 10_000 or size >= 4 << 20:
                            yield batch()
                            held, size = [[] for _ in kinds], 0
        yield batch()

    lines = chosen.select("path", *columns).repartition(tasks).mapInArrow(read, "line binary, locationid bigint, year bigint, month string, " + ASKED + " boolean")
    schema = T.StructType([*schemas.ARCHIVE_CSV.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false"}
    parsed = F.from_csv(F.col("line").cast("string"), schema.toDDL(), options)  # a cast keeps the bytes, as Spark's reader does
    return lines.select(parsed.alias("_line"), *columns).select("_line.*", *columns)


def write_folders(df: DataFrame, base: str, mode: str, compression: str | None = None) -> None:
    """``df`` as CSV with a header in folders ``locationid=/year=/month=``. Spark makes the lines and
    deals them; the tasks put those of a folder into its file with pyarrow, where Spark's committer would
    rename every folder on the driver, and Hadoop's local files start a process for each file and its
    checksum. A file appears whole, under its name, and ``_SUCCESS`` after the last. File systems that
    pyarrow does not write are left to Spark's writer."""
    if mode == "ignore" and path_exists(df.sparkSession, base):
        return
    columns = [c for c in df.columns if c not in FOLDERS]
    plain = lambda rows, how: (rows.write.mode(how).partitionBy(*FOLDERS).option("header", True)
                               .option("compression", compression or "none"))
    root, open_root = qualified(df.sparkSession, base), _opener()
    try:
        open_root(root)
    except (ValueError, NotImplementedError, OSError):
        plain(df.hint("rebalance", *FOLDERS), mode).csv(base)
        return
    none = df.limit(0)
    plain(none, mode).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").csv(base)  # as the mode has it
    header, run_id, end = ",".join(columns) + "\n", uuid.uuid4().hex[:12], ".csv.gz" if compression else ".csv"

    folders = FOLDERS
    escaped = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what it needs travels with it: workers need not have this package
        files, top = open_root(root)
        name = f"part-{TaskContext.get().partitionId():05d}-{run_id}{end}"
        now = out = own = to = None

        def named(value) -> str:
            """A partition value as Spark names it in a folder."""
            return escaped.sub(lambda c: f"%{ord(c[0]):02X}", str(value)) if value not in (None, "") else "__HIVE_DEFAULT_PARTITION__"

        def close() -> None:
            out.close()
            files.move(f"{to}/{own}", f"{to}/{name}")

        for b in batches:
            at, lines = list(zip(*(b.column(c).to_pylist() for c in folders), strict=True)), b.column("line").to_pylist()
            for values, group in groupby(range(len(lines)), at.__getitem__):
                if values != now:
                    if out is not None:
                        close()
                    now, own = values, f"_{name}-{uuid.uuid4().hex}"
                    to = f"{top}/" + "/".join(f"{k}={named(v)}" for k, v in zip(folders, values, strict=True))
                    files.create_dir(to, recursive=True)
                    out = files.open_output_stream(f"{to}/{own}", compression=compression)
                    out.write(header.encode())
                out.write("".join(f"{lines[i]}\n" for i in group).encode())
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    lines = df.select(F.to_csv(F.struct(*columns)).alias("line"), *FOLDERS)
    # rebalance: AQE splits a hot partition over several tasks and merges small ones
    dealt = lines.hint("rebalance", *FOLDERS).sortWithinPartitions(*FOLDERS)
    dealt.mapInArrow(put, "done bigint").agg(F.sum("done")).collect()
    plain(none, "append").csv(base)  # nothing but _SUCCESS
