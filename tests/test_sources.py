import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from grainwise.grain import PITCH, Relation, RequestError
from grainwise.sources import archive, cache, export, ingest, supplemental
from grainwise.streaming.ingest import merge_landing

HEAD = "pitch_type,game_date,game_pk,at_bat_number,pitch_number,pitcher,batter,release_speed,description"


def csv(*rows, head=HEAD):
    return "\n".join([head, *rows]) + "\n"


def frame(spark, tmp_path, text, name="x.csv"):
    path = tmp_path / name
    path.write_text("﻿" + text, encoding="utf-8")
    return ingest.read_csv(spark, str(path))


TWO = csv("FF,2024-04-01,1,1,1,10,7,95.5,ball", "SL,2024-04-01,1,1,2,10,7,85,ball")


def test_parsing(spark):
    df = spark.createDataFrame([("12.7",), ("",), ("x",), ("-3.9",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*[ingest.parse(F.col("t"), k).alias(k) for k in ("long", "double", "string")]).collect()]
    assert got == [(12, 12.7, "12.7"), (None, None, None), (None, None, "x"), (-3, -3.9, "-3.9"), (None, None, None)]


def test_merge_is_idempotent_and_evolves(spark, tmp_path):
    table = ingest.FactTable(spark, str(tmp_path / "facts"))
    s = table.ingest(frame(spark, tmp_path, TWO), "s1")
    assert (s.received, s.inserted, s.updated, s.unchanged) == (2, 2, 0, 0) and "release_speed" in s.new_columns
    s = table.ingest(frame(spark, tmp_path, TWO), "s2")
    assert (s.inserted, s.updated, s.unchanged) == (0, 0, 2)
    more = csv(*[r + ",1" for r in TWO.strip().split("\n")[1:]], head=HEAD + ",new_metric,bad header")
    s = table.ingest(frame(spark, tmp_path, more.replace(",1\n", ",1,odd\n")), "s3")
    assert (s.updated, s.new_columns) == (2, ("new_metric",))
    rows = table.read().collect()
    assert len(rows) == 2 and json.loads(rows[0]._invalid_headers_json)["bad header"] == "odd" and not {"_position", "_fate", "bucket"} & set(table.read().columns)
    known = {r.column_name: (r.first_snapshot_id, r.last_snapshot_id, r.is_documented) for r in table.registry().collect()}
    assert known["pitch_type"] == ("s1", "s3", True) and known["new_metric"] == ("s3", "s3", False)


def test_the_last_row_counts(spark, tmp_path):
    for n in range(8):
        table = ingest.FactTable(spark, str(tmp_path / f"facts-{n}"))
        rows = [f"FF,2024-04-01,1,1,1,10,7,{90 + (k * 7 + n) % 10},ball {k}" for k in range(10)] + ["SL,2024-04-01,1,1,2,10,7,85,ball"]
        s = table.ingest(frame(spark, tmp_path, csv(*rows), f"f{n}.csv").repartition(3), "s1")
        got = {r.pitch_uid: r.description for r in table.read().collect()}
        assert got == {"1:1:1": "ball 9", "1:1:2": "ball"} and (s.received, s.inserted) == (11, 2)
    later = frame(spark, tmp_path, csv("FF,2024-04-01,1,1,1,10,7,99,a", "FF,2024-04-01,1,1,1,10,7,98,b"), "g.csv")
    assert table.ingest(later, "s2").updated == 1 and table.read().filter("pitch_uid = '1:1:1'").first().description == "b"


def test_undelivered_columns_stay(spark, tmp_path):
    table = ingest.FactTable(spark, str(tmp_path / "facts"))
    head = HEAD + ",zone"
    table.ingest(frame(spark, tmp_path, csv("FF,2024-04-01,1,1,1,10,7,95,ball,5", "SL,2024-04-01,1,1,2,10,7,85,ball,6", head=head)), "s1")
    s = table.ingest(frame(spark, tmp_path, csv("FF,2024-04-01,1,1,1,10,7,,strike")), "s2")
    got = {r.pitch_uid: (r.zone, r.release_speed, r.description, r._source_snapshot_id) for r in table.read().collect()}
    assert s.updated == 1 and got == {"1:1:1": (5, None, "strike", "s2"), "1:1:2": (6, 85.0, "ball", "s1")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    import os

    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "facts" / "data") for f in names if f.endswith(".parquet")}
    table = ingest.FactTable(spark, str(tmp_path / "facts"), 8)
    table.ingest(frame(spark, tmp_path, csv(*[f"FF,2024-04-01,{g},1,{k},10,7,95,ball" for g in range(40) for k in range(3)])), "s1")
    before = files()
    table.ingest(frame(spark, tmp_path, csv("FF,2024-04-01,7,1,1,10,7,99,ball", "FF,2024-04-01,7,1,9,10,7,99,ball"), "y.csv"), "s2")
    after = files()
    assert {k: after[k] for k in before} == before and len({os.path.dirname(k) for k in set(after) - set(before)}) == 1
    again = ingest.FactTable(spark, str(tmp_path / "facts"))  # the state knows the number of buckets
    assert again.store.buckets == 8 and again.read().count() == 121 and again.read().filter("release_speed = 99").count() == 2
    assert again.store.vacuum() == 1 and again.read().count() == 121 and again.store.vacuum() == 0


def test_mirror(spark, tmp_path):
    table = ingest.FactTable(spark, str(tmp_path / "facts"), 4)
    copy = lambda: ingest.Mirror(table, str(tmp_path / "mirror"))
    with pytest.raises(ValueError):
        copy().ensure()
    table.ingest(frame(spark, tmp_path, csv(*[f"FF,2024-04-01,{g},1,1,10,7,95,ball" for g in range(6)])), "s1")
    assert copy().ensure() == {"rebuilt": True, "changed_rows": None} and copy().ensure() == {"rebuilt": False, "changed_rows": 0}
    table.ingest(frame(spark, tmp_path, csv("FF,2024-04-01,1,1,1,10,7,100,ball", "FF,2024-04-01,9,1,1,10,7,91,ball"), "y.csv"), "s2")
    assert copy().ensure() == {"rebuilt": False, "changed_rows": 2}
    same = lambda: sorted(map(str, copy().read().collect())) == sorted(map(str, table.read().collect()))
    assert same() and copy().read().agg(F.max("release_speed")).first()[0] == 100
    table.ingest(frame(spark, tmp_path, csv("FF,2024-04-01,1,1,1,10,7,100,ball,1", head=HEAD + ",zone"), "z.csv"), "s3")
    assert copy().ensure()["rebuilt"] and same()


def test_missing_key_and_report(spark, tmp_path):
    table = ingest.FactTable(spark, str(tmp_path / "facts"))
    s = table.ingest(frame(spark, tmp_path, csv("FF,2024-04-02,1,1,,10,7,95,ball", "FF,2024-04-01,2,1,1,10,7,95,ball")), "s1")
    assert s.missing_key == 1
    row = ingest.verify(table.read()).first()
    assert (row.pitch_rows, row.games, row.missing_natural_key, row.missing_pitch_number, row.duplicate_pitch_uid, row.latest_game_date) == (2, 2, 1, 1, 0, "2024-04-02")
    table.ingest(frame(spark, tmp_path, csv("FF,2024-04-03,3,1,1,10,7,95,ball,1", head=HEAD.replace("batter", "batter_") + ",odd_one"), "y.csv"), "s2")
    notes = [archive.Snapshot(s, "", "", "", "", 0, s) for s in ("s1", "s2")]
    got = ingest.integrity(table, notes, {"a..b": {"status": "failed", "error": "no line"}, "c..d": {"status": "done"}})
    assert (got["pitch_rows"], got["games"], got["missing_required_ids"]["batter"], got["failed_chunks"], got["raw_snapshots"]) == (3, 3, 1, 1, 2)
    assert got["new_or_undocumented_columns"] == ["batter_", "odd_one"] and got["columns_missing_from_latest_snapshot"] == ["batter"] and got["failed_chunk_details"] == [{"chunk": "a..b", "error": "no line"}]
    empty = ingest.integrity(ingest.FactTable(spark, str(tmp_path / "none")))
    assert (empty["pitch_rows"], empty["schema_columns"], empty["raw_snapshots"]) == (0, 0, 0)


def test_refresh(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "pitch_uid string, v int")
    new = spark.createDataFrame([("b", 100), ("c", 3)], "pitch_uid string, v int")
    assert sorted(map(tuple, ingest.refresh(old, new).collect())) == [("a", 1), ("b", 100), ("c", 3)]


def test_chunks():
    got = list(ingest.chunk_ranges(dt.date(2024, 1, 1), dt.date(2024, 1, 12), 5))
    assert [(b - a).days + 1 for a, b in got] == [5, 5, 2]


class Days:
    def __init__(self, fail=()):
        self.fail, self.asked = set(fail), []

    def fetch(self, start, end):
        self.asked.append((start, end))
        if start in self.fail:
            raise OSError("no line")
        days = [start + dt.timedelta(k) for k in range((end - start).days + 1)]
        return csv(*[f"FF,{d},{d.toordinal()},1,1,10,7,95,ball" for d in days]).encode()


def test_sync(spark, tmp_path):
    source = Days(fail=[dt.date(2024, 1, 3)])
    store = archive.Archive(spark, str(tmp_path / "raw"))
    table = ingest.FactTable(spark, str(tmp_path / "facts"))
    sync = archive.Sync(spark, source, store, table, str(tmp_path / "log.json"))
    archive.time.sleep = lambda s: None
    assert sum(s.inserted for s in sync.backfill(dt.date(2024, 1, 1), dt.date(2024, 1, 3), 2)) == 2
    assert sync.failed() == [(dt.date(2024, 1, 3), dt.date(2024, 1, 3))]
    source.fail = set()
    assert [s.inserted for s in sync.retry_failed()] == [1] and not sync.failed()
    n = len(source.asked)
    assert sync.backfill(dt.date(2024, 1, 1), dt.date(2024, 1, 3), 2)[:0] == [] and len(source.asked) <= n + 1
    assert len(store.snapshots()) == 2 and store.verify().where("missing or mismatched").count() == 0 and store.verify().count() == 2
    assert [s.unchanged for s in sync.update(dt.date(2024, 1, 4), 3)] == [2]
    again = ingest.FactTable(spark, str(tmp_path / "again"))
    assert sync.rebuild(again).inserted == 4 and sorted(r.pitch_uid for r in again.read().collect()) == sorted(r.pitch_uid for r in table.read().collect())
    assert {r.column_name for r in again.registry().collect()} == set(HEAD.split(","))
    path = tmp_path / "raw" / f"{store.snapshots()[0].snapshot_id}.csv.gz"
    import gzip

    path.write_bytes(gzip.compress(b"other"))
    (tmp_path / "raw" / f".{path.name}.crc").unlink()
    with pytest.raises(ValueError):
        store.load(store.snapshots()[0])
    with pytest.raises(ValueError):
        sync.rebuild(ingest.FactTable(spark, str(tmp_path / "third")))
    assert store.verify().where("mismatched").count() == 1
    path.unlink()
    assert store.verify().where("missing").count() == 1


def test_rebuild_is_as_if_they_came_one_by_one(spark, tmp_path):
    store = archive.Archive(spark, str(tmp_path / "raw"))
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    for day, text in zip(days, (csv("FF,2024-01-01,1,1,1,10,7,95,ball,5", "SL,2024-01-01,1,1,2,10,7,85,ball,6", head=HEAD + ",zone"), csv("FF,2024-01-01,1,1,1,10,7,,strike"), csv("CH,2024-01-03,3,1,1,10,7,80,ball", "CU,2024-01-03,3,1,1,10,7,81,ball")), strict=True):
        store.save(text.encode(), day, day)
    one, whole = (ingest.FactTable(spark, str(tmp_path / n)) for n in ("one", "whole"))
    sync = archive.Sync(spark, Days(), store, whole, str(tmp_path / "log"))
    assert sync.rebuild(whole).received == 5
    for s in store.snapshots():
        one.ingest(ingest.read_csv(spark, s.path), s.snapshot_id)
    columns = [c for c in one.read().columns if c not in ("_ingested_at", "_row_hash")]
    same = [sorted(map(str, t.read().select(*columns).collect())) for t in (one, whole)]
    assert same[0] == same[1] and len(same[0]) == 3
    assert archive.Sync(spark, Days(), archive.Archive(spark, str(tmp_path / "empty")), whole, str(tmp_path / "log2")).rebuild(one).received == 0


def test_fetching_again():
    waits = []

    class Odd:
        n = 0

        def fetch(self, a, b):
            self.n += 1
            return b"<html>" if self.n < 3 else b"a,b\n1,2\n"

    day = dt.date(2024, 1, 1)
    assert archive.fetched(Odd(), day, day, sleep=waits.append) == b"a,b\n1,2\n" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        archive.fetched(Odd(), day, day, tries=2, sleep=waits.append)


def test_stream_replays_change_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text(TWO)
    table = ingest.FactTable(spark, str(tmp_path / "facts"))
    run = lambda n: merge_landing(spark, str(landing), HEAD.split(","), table, str(tmp_path / n)).awaitTermination(120)
    run("check")
    (landing / "b.csv").write_text(TWO.replace("95.5", "99"))
    run("check")
    assert table.read().agg(F.count("*"), F.max("release_speed")).first() == (2, 99.0)
    run("fresh-check")
    assert table.read().count() == 2


def test_supplemental(spark, tmp_path):
    raw = spark.createDataFrame([("1", "p1", "2.5", "x"), ("1", "", "3", "")], "game_pk string, play_id string, poly string, note string")
    rows = supplemental.keyed(supplemental.inferred(raw))
    assert dict(rows.dtypes)["game_pk"] == "bigint" and dict(rows.dtypes)["poly"] == "double"
    path = str(tmp_path / "extra")
    supplemental.replace(rows, path, "pitch3d", "e1")
    supplemental.replace(rows, path, "pitch3d", "e2")
    supplemental.replace(rows.limit(1), path, "pitch3d", "e1")
    assert {(r.entity, r["count"]) for r in supplemental.read(spark, path).groupBy("entity").count().collect()} == {("e1", 1), ("e2", 2)}
    found = supplemental.verify(supplemental.read(spark, path)).first()
    assert (found.n_rows, found.n_entities, found.duplicate_keys) == (3, 2, 1)
    files = spark.createDataFrame([("pitch3d", False, False), ("pitch3d", True, False), ("spin", False, True)], "dataset string, missing boolean, mismatched boolean")
    got = {r.dataset: tuple(r)[1:] for r in supplemental.verify(supplemental.read(spark, path), files).collect()}
    assert got == {"pitch3d": (3, 2, 1, 2, 1, 0, False), "spin": (0, 0, 0, 1, 0, 1, False)}
    assert {tuple(r) for r in supplemental.summary(supplemental.read(spark, path), files).collect()} == {("pitch3d", 3, 2, 2), ("spin", 0, 0, 1)}
    html = 'var x = [1,2]; var data = [{"season": 2024, "t": "a]\\"b", "n": [1]}, {"season": 2023, "odd": 1}]; end'
    pages = spark.createDataFrame([(1, html), (2, "none"), (3, None)], "id int, html string")
    found = supplemental.objects(supplemental.arrays(pages)).collect()
    assert [r.fields["season"] for r in found] == ["2024", "2023"] and found[0].fields["t"] == 'a]"b'
    units = spark.createDataFrame([(1, "d", "e", "failed"), (2, "d", "e", "done"), (3, "d", "f", "failed")], "unit_id int, dataset string, entity string, status string")
    assert [r.entity for r in supplemental.failed_units(units).collect()] == ["f"]


def test_exports(spark, tmp_path):
    df = spark.range(18_887).selectExpr("id as pitcher", "id % 7 / 2 as unit_value", "cast(null as string) as note")
    export.csv(df, str(tmp_path / "a.csv"))
    text = (tmp_path / "a.csv").read_text(encoding="utf-8")
    assert text.startswith("﻿pitcher,") and text.count("\n") == 18_888
    export.as_json(df.limit(3), str(tmp_path / "a.json"), {"k": 1})
    assert len(json.loads((tmp_path / "a.json").read_text())["section"]["rows"]) == 3
    export.xlsx(df, str(tmp_path / "a.xlsx"), {"k": "<1>"})
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 18_888 and b"&lt;1&gt;" in z.read("xl/worksheets/sheet2.xml")
    export.parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 18_887
    export.report(df, str(tmp_path / "a.html"), "<t>")
    assert (tmp_path / "a.html").read_text().count("<tr>") == 81
    with pytest.raises(RequestError):
        export.csv(spark.range(500_001), str(tmp_path / "b.csv"))


def test_cache_and_log(spark, tmp_path):
    store = cache.ResultCache(spark, str(tmp_path / "c"), 2)
    for i in range(3):
        store.put({"mode": "basic", "limit": i}, "r1", spark.range(i + 1))
    store = cache.ResultCache(spark, str(tmp_path / "c"), 2)
    assert store.get({"limit": 2, "mode": "basic"}, "r1").count() == 3
    assert store.get({"mode": "basic", "limit": 0}, "r1") is None and store.get({"mode": "basic", "limit": 2}, "r2") is None
    store.get({"mode": "basic", "limit": 1}, "r1")
    store.put({"mode": "other"}, "r1", spark.range(1))
    assert store.get({"mode": "basic", "limit": 2}, "r1") is None and store.get({"mode": "basic", "limit": 1}, "r1").count() == 2
    small = cache.ResultCache(spark, str(tmp_path / "d"), 2, 2000)
    assert small.put({}, "r", spark.range(5000)).count() == 5000 and small.get({}, "r") is None
    log = cache.RequestLog(spark, str(tmp_path / "log"))
    number = log.record({"mode": "basic"}, 3)
    log.save("mine", {"mode": "basic"})
    log = cache.RequestLog(spark, str(tmp_path / "log"))
    assert log.request(number)["row_count"] == 3 and log.request("x") is None
    assert log.history()[0]["row_count"] == 3 and log.saved() == {"mine": {"mode": "basic"}} and log.delete("mine") and not log.delete("mine")


def test_small_files(spark, tmp_path):
    from grainwise.sources.store import Document, Folder

    f = Folder(spark, str(tmp_path / "f"))
    assert f.names() == []
    f.write("a", b"\x00\xff" * 1000)
    assert f.read("a") == b"\x00\xff" * 1000 and f.size("a") == 2000 and f.names() == ["a"]
    with pytest.raises(FileExistsError):
        f.write("a", b"")
    assert f.names() == ["a"]
    doc = Document(spark, str(tmp_path / "doc"))
    assert doc.read(7) == 7
    for i in range(3):
        doc.write({"i": i})
    assert Document(spark, str(tmp_path / "doc")).read() == {"i": 2} and len(list((tmp_path / "doc").glob("*.json"))) == 1


def test_schema_capabilities(spark):
    from grainwise import presets

    got = {f["name"]: f["capabilities"] for f in presets.schema_of(spark.createDataFrame([], "pitcher long, release_speed double, game_date string, pitch_type string"))}
    assert "identifier" in got["pitcher"] and "numeric" not in got["pitcher"] and "numeric" in got["release_speed"] and "temporal" in got["game_date"] and "canonical_pitch_type" in got["pitch_type"]
    assert Relation(spark.range(1).selectExpr("id as pitch_uid"), PITCH).fields == ["pitch_uid"] and len(presets.Registry().names()) == 10
