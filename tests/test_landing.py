"""Record-level salvage, the line ledger of the archive and the checked location map."""

import gzip
import json
import re

import pytest

from aerolith.plans import adapter as AD
from aerolith.plans import jobs as C
from aerolith.plans import queries_io as QI
from aerolith.sources import archive as SA
from aerolith.sources import payloads as SP
from aerolith.sources import sinks as K
from aerolith.sources.landing import landing

SF = "/root/testdata/sf0.001"


def reading(**kw):
    return {"locationsId": 1, "sensorsId": 2, "location": "a", "parameter": "pm25", "value": 5.0, "unit": "u",
            "datetime": "2024-01-01T00:00:00Z", "coordinates": {"latitude": 1.0, "longitude": 2.0}} | kw


def put(folder, name, doc):
    (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))


def test_a_bad_value_costs_itself_only(spark, tmp_path):
    put(tmp_path, "a.json", {"results": [reading(), reading(value="n/a", sensorsId=3)]})
    docs = landing(spark, "measurements", str(tmp_path))
    assert {(r.sensorsId, r.value) for r in docs.rows().collect()} == {(2, 5.0), (3, None)}
    (bad,) = docs.repaired().collect()
    assert (bad.record, bad.field, bad.text) == (1, "value", '"n/a"') and bad.file_path.endswith("a.json")
    assert docs.counts() == {"documents": 1, "failed_documents": 0, "records": 2, "accepted": 1, "repaired": 1, "rejected": 0}


def test_numbers_as_text_and_odd_types(spark, tmp_path):
    put(tmp_path, "a.json", {"results": [
        reading(value="12.5"), reading(value=True), reading(value=None), reading(value=7), reading(value=1e400 if False else 3e2),
        reading(parameter=25), reading(coordinates=None), reading(coordinates={"latitude": "x", "longitude": 2}), reading(value={"v": 1}),
        reading(extra=[1, 2])]})
    rows = landing(spark, "measurements", str(tmp_path)).rows().collect()
    assert [r.value for r in rows] == [12.5, 1.0, None, 7.0, 300.0, 5.0, 5.0, 5.0, None, 5.0]
    assert rows[5].parameter == "25" and rows[6].coordinates is None and tuple(rows[7].coordinates) == (None, 2.0)
    fields = {(r.record, r.field) for r in landing(spark, "measurements", str(tmp_path)).repaired().collect()}
    assert fields == {(7, "coordinates.latitude"), (8, "value")}


def test_rejected_records_have_their_place_and_reason(spark, tmp_path):
    put(tmp_path, "a.json", {"results": [
        "text", 3, None, [1], reading(locationsId="x"), reading(datetime=None), reading(datetime="soon"), reading(datetime=5), reading()]})
    docs = landing(spark, "measurements", str(tmp_path))
    got = {r.record: {i.field for i in r.issues} for r in docs.rejected().collect()}
    assert got == {0: {"$"}, 1: {"$"}, 2: {"$"}, 3: {"$"}, 4: {"locationsId"}, 5: {"datetime"}, 6: {"datetime"}, 7: {"datetime"}}
    assert docs.rows().count() == 1 and docs.counts()["rejected"] == 8


def test_sensors_of_a_location(spark, tmp_path):
    put(tmp_path, "a.json", {"results": [{"id": 1, "name": "L", "sensors": [
        {"id": 5, "name": "pm25", "units": "u"}, {"id": "five", "name": "o3"}, "none", {"id": 6, "parameter": {"name": "CO", "units": 3}}]}]})
    docs = landing(spark, "metadata", str(tmp_path))
    assert {r.field for r in docs.repaired().collect()} == {"sensors[1].id", "sensors[2]"}
    got = {(r.sensor_id, r.parameter, r.units) for r in SP.sensor_lookup(spark, docs).collect()}
    assert got == {(5, "pm25", "u"), (6, "co", "3")}


@pytest.mark.parametrize("kind", ["locations", "latest", "measurements", "metadata"])
def test_documents_that_are_none(spark, tmp_path, kind):
    put(tmp_path, "a.json", '{"results": [{"id": 1, "na')
    put(tmp_path, "b.json", {"detail": "rate limit exceeded"})
    put(tmp_path, "c.json", {"results": None})
    put(tmp_path, "d.json", "[1, 2]")
    put(tmp_path, "e.json", " \n")
    put(tmp_path, "f.json", {"results": []})
    docs = landing(spark, kind, str(tmp_path))
    assert {r.file_path[-6]: r.reason for r in docs.quarantined().collect()} == {
        "a": "not JSON", "b": "no results", "c": "no results", "d": "no results", "e": "not JSON"}
    assert docs.counts()["documents"] == 6 and docs.rows().count() == 0


def test_lines_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(["", json.dumps({"results": [reading()]}), "  ", "{broken", json.dumps({"results": [reading()] * 2}), ""]))
    docs = landing(spark, "measurements", str(tmp_path), multiline=False)
    assert docs.counts() == {"documents": 3, "failed_documents": 1, "records": 3, "accepted": 3, "repaired": 0, "rejected": 0}


def test_a_job_parses_its_documents_once(spark, tmp_path):
    put(tmp_path, "a.json", {"results": [reading()]})
    docs = landing(spark, "measurements", str(tmp_path), once=True)
    for df in (docs.rows(), docs.rejected(), docs.ledger(), docs.quarantined()):
        text = df._jdf.queryExecution().toString()
        assert "parquet" in text and "try_parse_json" not in text.lower()


def test_a_live_collection_counts_what_it_leaves_out(spark, tmp_path):
    meta, latest, fact = (tmp_path / x for x in ("meta", "latest", "fact"))
    meta.mkdir(), latest.mkdir()
    put(meta, "a.json", {"results": [{"id": 1, "name": "L", "sensors": [{"id": 5, "name": "pm25", "units": "u"}]}]})
    item = {"sensorsId": 5, "locationsId": 1, "value": 3.0, "datetime": {"utc": "2024-01-01T00:00:00Z"}, "coordinates": {}}
    put(latest, "a.json", {"results": [item, item | {"sensorsId": "five"}, item | {"datetime": "now"}, item | {"value": "-", "datetime": {"utc": "2024-01-02T00:00:00Z"}}]})
    put(latest, "b.json", {"detail": "no"})
    _, stats = C.live_collection(spark, str(meta), str(latest), fact_path=str(fact))
    assert stats == {"inserted": 2, "failed_documents": 1, "repaired_records": 1, "rejected_records": 2}


def test_a_location_sync_counts_records_without_a_usable_id(spark, tmp_path):
    put(tmp_path, "a.json", {"results": [{"id": 1, "name": "new"}, {"id": "one", "name": "x"}, {"name": "no id"}, 7]})
    loc = AD.locations(spark, SF).where("location_id > 1").withColumn("last_updated", QI.X.utc_now())
    counts, dim = C.location_sync(spark, str(tmp_path), loc, str(tmp_path / "dim"))
    assert {r.sync_status: r.n for r in counts.collect()} == {"added": 1, "errors": 1, "rejected_records": 2}
    assert dim.where("location_id = 1").count() == 1


# --- archive ------------------------------------------------------------------------------

HEAD = "location_id,sensors_id,location,datetime,lat,lon,parameter,units,value\n"


def archive(tmp_path, lines, at="locationid=1/year=2024/month=01"):
    folder = tmp_path / "archive" / at
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"f{len(list(folder.iterdir()))}.csv").write_text(HEAD + "\n".join(lines) + "\n")
    return str(tmp_path / "archive")


def put_map(tmp_path, text):
    (tmp_path / "map.json").write_text(text)
    return str(tmp_path / "map.json")


GOOD = "1,2,here,2024-01-01T00:00:00Z,1.0,2.0,pm10,u,3.0"


def test_every_line_is_counted(spark, tmp_path):
    base = archive(tmp_path, [GOOD, "1,2,here,,1.0,2.0,pm10,u,4.0", "1,two,here,2024-01-01T00:00:00Z,1.0,2.0,pm10,u,3.0"])
    archive(tmp_path, [GOOD, "x,y"])
    fact, aside = str(tmp_path / "fact"), str(tmp_path / "aside")
    got = C.archive_backfill(spark, base, put_map(tmp_path, '{"1": "here", "9": null}'), "2024-01", "2024-02", fact, rejects_path=aside)
    missing = {(r.locationid, r.month) for r in got.pop("missing_partitions").collect()}
    assert got == {"lines": 5, "appended": 3, "without_time": 1, "corrupt_lines": 2, "outside": 0, "rejected_map_shards": []}
    assert missing == {(1, "02"), (9, "01"), (9, "02")}
    rows = spark.read.parquet(fact).collect()
    assert sorted((r.datetime is None, r.value) for r in rows) == [(False, 3.0), (False, 3.0), (True, 4.0)]
    assert {r._corrupt_record for r in spark.read.parquet(aside).collect()} == {"1,two,here,2024-01-01T00:00:00Z,1.0,2.0,pm10,u,3.0", "x,y"}


def test_rejects_come_from_the_lines_that_were_read(spark, tmp_path, monkeypatch):
    base = archive(tmp_path, [GOOD, "1,2,here,yesterday,1.0,2.0,pm10,u,4.0", "x,y"])
    want = SA.corrupt_lines(spark, base, [1], "2024-01", "2024-01").collect()
    scans, own = [], SA._archive_lines
    monkeypatch.setattr(SA, "_archive_lines", lambda *a: scans.append(a) or own(*a))
    aside = str(tmp_path / "aside")
    got = C.archive_backfill(spark, base, put_map(tmp_path, '{"1": "here"}'), "2024-01", "2024-01", str(tmp_path / "fact"), rejects_path=aside)
    assert got["corrupt_lines"] == 2 and len(scans) == 1
    kept = [tuple(r) for r in spark.read.schema("locationid bigint, year bigint, month string, _corrupt_record string").parquet(aside).collect()]
    assert sorted(kept) == sorted((int(r[0]), int(r[1]), *r[2:]) for r in want)


def test_the_archive_is_written_as_spark_writes_it(spark, tmp_path):
    rows = [(1, 2, 'a "b", c', "t", 1.5, None, "p", "u", 0.1, 1, 2024, "01"), (None, 2, "", None, 1e-9, 2.0, " p ", "\u00e9", float("nan"), None, 2024, None),
            (3, 4, "x\\y", "t", 1.0, 2.0, "p", "u", None, 3, 2024, "a/b=c%d[]^{\\ e"), (1, 2, "again", "t", 1.5, 2.5, "p", "u", 3.0, 1, 2024, "01")]
    df = spark.createDataFrame(rows, "location_id long, sensors_id long, location string, datetime string, lat double, lon double, parameter string, "
                                     "units string, value double, locationid long, year long, month string")
    own, plain = tmp_path / "own", tmp_path / "plain"
    SA.write_folders(df, str(own), "overwrite", "gzip")
    SA.write_folders(df, str(own), "overwrite", "gzip")  # replaces what is there
    df.coalesce(1).write.partitionBy(*SA.FOLDERS).option("header", True).option("compression", "gzip").csv(str(plain))

    def held(top):
        return {str(p.parent.relative_to(top)): sorted(gzip.decompress(p.read_bytes()).decode().splitlines()) for p in top.rglob("part-*.csv.gz")}
    assert held(own) == held(plain) and len(held(own)) == 3
    assert (own / "_SUCCESS").exists() and len([p for p in own.rglob("*") if p.is_file() and p.suffix != ".crc"]) == 4
    assert not [p for p in own.rglob(".part*.crc")]  # a checksum file beside each doubled the files of an archive
    SA.write_folders(df, str(own), "append")
    assert len([*own.rglob("part-*.csv")]) == 3 and len(held(own)) == 3
    SA.write_folders(df, str(own), "ignore")
    assert len([*own.rglob("part-*.csv")]) == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        SA.write_folders(df, str(own), "errorifexists")


def test_ids_of_a_request_are_one_expression(spark, tmp_path, monkeypatch):
    base = archive(tmp_path, [GOOD])
    archive(tmp_path, [GOOD, GOOD], "locationid=2/year=2024/month=01")
    monkeypatch.setattr(SA.F, "lit", lambda x, own=SA.F.lit: own(x) if not isinstance(x, int) or isinstance(x, bool) else pytest.fail("a call for each id"))
    monkeypatch.setattr(SA.Column, "isin", lambda *a: pytest.fail("a call for each id"))
    df = SA.read_archive(spark, base, [2, 7], "2024-01", "2024-01")
    assert df.count() == 2 and len(df.inputFiles()) == 2
    assert SA.read_archive(spark, base, [], "2024-01", "2024-01").count() == 0


def test_records_without_issues_are_not_made_text(spark, tmp_path):
    """The variant is asked once for a value that is there, and for a record's text where it has issues."""
    put(tmp_path, "a.json", {"results": [{"locationsId": 1, "sensorsId": 2, "value": 1.5, "datetime": {"utc": "2024-01-01T00:00:00Z"}}]})
    docs = SP.landing(spark, "latest", str(tmp_path)).documents
    plan = docs._jdf.queryExecution().analyzed().toString()
    assert re.search(r"THEN to_json\(lambda [\w#]+\.item", plan)
    assert [tuple(r) for r in docs.select("n_accepted", "n_repaired", "n_rejected").collect()] == [(1, 0, 0)]


def test_lines_outside_a_large_request_are_counted(spark, tmp_path, monkeypatch):
    base = archive(tmp_path, [GOOD])
    archive(tmp_path, [GOOD, GOOD], "locationid=2/year=2024/month=01")
    monkeypatch.setattr(SA, "MAX_IN_IDS", 1)
    ids = spark.createDataFrame([(1,), (7,)], "location_id long")
    tagged = SA.tagged_lines(spark, base, ids, "2024-01", "2024-01")
    assert {r.line_status: r.lines for r in SA.line_ledger(tagged).collect()} == {"stored": 1, "outside": 2}
    assert K.append_archive(tagged, str(tmp_path / "fact"))["appended"] == spark.read.parquet(str(tmp_path / "fact")).count() == 1
    assert SA.read_archive(spark, base, ids, "2024-01", "2024-01").count() == 1


def test_an_empty_selection_counts_nothing(spark, tmp_path):
    base = archive(tmp_path, [GOOD])
    got = C.archive_backfill(spark, base, put_map(tmp_path, '{"5": "x"}'), "2024-01", "2024-01", str(tmp_path / "fact"))
    assert (got["lines"], got["appended"], got["outside"]) == (0, 0, 0)


def odd_archive(tmp_path):
    """An archive with all that a reader has to get right: ends of lines, quotes, bytes that are no text, files that are none."""
    base = archive(tmp_path, [GOOD, "", '1,2,"a ""b"", c",,1.0,2.0,pm10,u,4.0', "x,y", '1,2,"open,2024-01-01T00:00:00Z,1.0,2.0,pm10,u,3.0', GOOD + ",more"])
    at = tmp_path / "archive" / "locationid=1/year=2024/month=01"
    (at / "feeds.csv").write_bytes(b"\xef\xbb\xbf \r\n" + HEAD.strip().encode() + b"\r\n" + GOOD.encode() + b"\r" + GOOD.encode() + b"\r\n\r\n\t \n" + GOOD.encode())
    (at / "bytes.csv").write_bytes(HEAD.encode() + b"1,2,\xff\xc3\xa9 \xe2\x82,2024-01-01T00:00:00+02:00,nan,2.0,pm10,u,1e3\n1,2,\xc3,yesterday,1,2,\x00,u,3\n")
    (at / "twice.csv.gz").write_bytes(gzip.compress((HEAD + GOOD).encode()) + gzip.compress(f"\n{GOOD}\n".encode()))
    (at / "only_head.csv").write_text(HEAD)
    for name in ("_hidden.csv", ".hidden.csv", "copied.csv._COPYING_"):
        (at / name).write_text(HEAD + GOOD)
    (at / "empty.csv").write_text("")
    for folder in ("sub", "_temporary/0"):
        (at / folder).mkdir(parents=True)
        (at / folder / "f.csv").write_text(HEAD + GOOD)
    (tmp_path / "archive" / "beside.csv").write_text(HEAD + GOOD)
    for other in ("locationid=2/year=2024/month=02", "locationid=7/year=2023/month=12", "locationid=3/year=2024/month=a%2Fb",
                  "locationid=__HIVE_DEFAULT_PARTITION__/year=2024/month=__HIVE_DEFAULT_PARTITION__"):
        archive(tmp_path, [GOOD, "x,y"], other)
    return base


def held(df):
    """The rows of a frame as text, NaN and null apart."""
    return sorted(str([(c, repr(v)) for c, v in r.asDict().items() if c != "ingestion_datetime"]) for r in df.collect())


@pytest.mark.parametrize("asked", [(), ([1, 7, 9], "2023-12", "2024-01"), (None, "2024-01", "2024-02")])
@pytest.mark.parametrize("at_once", [1 << 20, 5])
def test_tasks_read_what_sparks_reader_reads(spark, tmp_path, monkeypatch, asked, at_once):
    base = odd_archive(tmp_path)
    if asked:  # a month that is no number fails with either reader where months are compared
        (tmp_path / "archive/locationid=3/year=2024/month=a%2Fb").rename(tmp_path / "archive/locationid=3/year=2024/month=03")
    monkeypatch.setattr(SA, "READ_BYTES", at_once)
    assert SA.listed_files(spark, base) is not None
    own, there = held(SA.tagged_lines(spark, base, *asked)), held(SA.present_partitions(spark, base))
    monkeypatch.setattr(SA, "listed_files", lambda *a: None)
    assert own == held(SA.tagged_lines(spark, base, *asked)) and len(own) >= 10
    assert there == held(SA.present_partitions(spark, base)) and len(there) == 5


def test_the_driver_does_not_list_the_files_of_a_load(spark, tmp_path):
    """Spark's reader keeps and plans every file of an archive on the driver; at a million files that is gigabytes."""
    base = archive(tmp_path, [GOOD, "x,y"])
    ids = spark.createDataFrame([(1,), (9,)], "location_id long")
    tagged = SA.tagged_lines(spark, base, ids, "2024-01", "2024-02")
    missing = C.archive_backfill(spark, base, put_map(tmp_path, '{"1": "here", "9": null}'), "2024-01", "2024-02", str(tmp_path / "fact"))["missing_partitions"]
    for df in (tagged, missing, SA.missing_partitions(spark, base, ids, "2024-01", "2024-02")):
        assert not [f for f in df.inputFiles() if "/locationid=" in f]
    assert {(r.locationid, r.month) for r in missing.collect()} == {(1, "02"), (9, "01"), (9, "02")}
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1 and sorted(r.line_status for r in tagged.collect()) == ["stored", "unparsable"]


@pytest.mark.parametrize("at, name", [("country=x/locationid=1/year=2024/month=01", "f.csv"), ("locationid=one/year=2024/month=01", "f.csv"),
                                      ("locationid=1/month=01/year=2024", "f.csv"), ("locationid=1/year=2024/month=01", "f.csv.deflate"),
                                      ("", "f.csv"), ("locationid=1/year=2024/month=01", "_f.csv")])
def test_other_layouts_are_left_to_sparks_reader(spark, tmp_path, at, name):
    (tmp_path / "archive" / at).mkdir(parents=True)
    (tmp_path / "archive" / at / name).write_text(HEAD + GOOD + "\n")
    assert SA.listed_files(spark, str(tmp_path / "archive")) is None
    assert SA.listed_files(spark, str(tmp_path / "none")) is None


def test_a_file_that_is_cut_short_fails(spark, tmp_path):
    base = archive(tmp_path, [GOOD])
    whole = gzip.compress((HEAD + GOOD * 50).encode())
    (tmp_path / "archive/locationid=1/year=2024/month=01/cut.csv.gz").write_bytes(whole[:-9])
    with pytest.raises(Exception, match="Truncated"):
        SA.tagged_lines(spark, base).collect()


def test_many_files_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    for i in range(12):
        base = archive(tmp_path, [GOOD] * 3, f"locationid={i}/year=2024/month=01")
    monkeypatch.setattr(SA, "FILES_A_TASK", 1)
    tagged = SA.tagged_lines(spark, base)
    assert tagged.rdd.getNumPartitions() == 12 and tagged.count() == 36
    monkeypatch.setattr(SA, "FILES_A_TASK", 500)
    monkeypatch.setattr(SA, "BYTES_A_TASK", 200)
    assert SA.tagged_lines(spark, base).rdd.getNumPartitions() > 12


# --- location map -------------------------------------------------------------------------

@pytest.mark.parametrize("text, reason", [('{"1": "a", "2": "b', "not JSON"), ("[1, 2]", "not an object"), ('{"1": "a", "one": "b"}', "an id is no number"),
                                          ('{"1": "a", "1": "b"}', "not JSON"), ("\n", "not JSON")])
def test_a_broken_location_map_raises(spark, tmp_path, text, reason):
    path = put_map(tmp_path, text)
    with pytest.raises(Exception, match=reason):
        SP.read_location_map(spark, path).collect()
    (bad,) = SP.rejected_map_shards(spark, path).collect()
    assert bad.reason == reason and bad.file_path.endswith("map.json")
    assert SP.read_location_map(spark, path, strict=False).count() == 0


def test_a_backfill_with_a_broken_map(spark, tmp_path):
    base = archive(tmp_path, [GOOD])
    path = put_map(tmp_path, '{"1": "here"}\n{"2": "th')
    with pytest.raises(Exception, match="not JSON"):
        C.archive_backfill(spark, base, path, "2024-01", "2024-01", str(tmp_path / "fact"), map_whole_file=False)
    got = C.archive_backfill(spark, base, path, "2024-01", "2024-01", str(tmp_path / "fact"), map_whole_file=False, strict_map=False)
    assert got["appended"] == 1 and [x.rsplit("/", 1)[1] for x in got["rejected_map_shards"]] == ["map.json"]
