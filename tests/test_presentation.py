import pytest

from grainwise.grain import Grain, Relation, RequestError
from grainwise.plans import jobs, presentation, visuals
from grainwise.sources.status import FastStatus


def test_fields_and_presets(spark):
    r = Relation(spark.createDataFrame([], "game_date string, pitcher long, pitch_type string, pfx_x double, pfx_z double, usage_rate double, row_count long, ci_lower double, odd_thing double, flag boolean"), Grain(()))
    got = {f["name"]: f for f in presentation.fields_of(r)}
    assert got["pitcher"]["role"] == "identifier" and got["game_date"]["role"] == "temporal_dimension" and got["pfx_x"]["unit"] == "ft" and got["usage_rate"]["unit"] == "ratio"
    assert got["row_count"]["role"] == "sample_size" and got["odd_thing"]["role"] == "measure" and got["flag"]["type"] == "boolean" and got["ci_lower"]["paired_with"] == "estimate"
    assert got["pfx_x"]["label"] == "水平位移 Horizontal Movement" and got["odd_thing"]["label"] == "odd_thing"
    flags = {n: tuple(f[k] for k in ("is_numeric", "is_identifier", "is_temporal", "is_categorical")) for n, f in got.items()}
    assert flags["pitcher"] == (True, True, False, True) and flags["game_date"] == (False, False, True, False) and flags["pitch_type"] == (False, False, False, True) and flags["odd_thing"] == (True, False, False, False)
    more = {f["name"]: f["role"] for f in presentation.fields_of(Relation(spark.createDataFrame([], "event_id long, day date, at timestamp, key long, season int, low_speed double, hit_rate double, update_note string"), Grain(("key",), "x")))}
    assert more == {"event_id": "identifier", "day": "temporal_dimension", "at": "temporal_dimension", "key": "identifier", "season": "temporal_dimension", "low_speed": "interval_lower", "hit_rate": "percentage", "update_note": "category"}
    assert presentation.recommended(r) == ["pitch_movement", "usage_trend", "generic_time", "category_comparison", "scatter"]
    assert presentation.normalised({})["sampling"] == {"mode": "automatic", "method": "every_nth", "seed": 42, "size": 5000}
    for bad in ({"type": "pie"}, {"sampling": {"mode": "manual", "size": 60_000}}, {"sampling": {"mode": "some"}}):
        with pytest.raises(RequestError):
            presentation.normalised(bad)


def test_jobs(spark):
    ring = jobs.Jobs(2)
    with ring.running(spark, "basic") as n:
        ring.update(n, "planning", 40)
        ring.update(n, percentage=20)
        assert ring.get(n).percentage == 40
        spark.range(10).count()
        assert ring.follow(spark, n) >= 40
    assert (ring.get(n).status, ring.get(n).percentage) == ("success", 100.0)
    with pytest.raises(ZeroDivisionError), ring.running(spark, "odd") as m:
        raise ZeroDivisionError
    assert ring.get(m).status == "failed"
    ring.start("a"), ring.start("b")
    assert ring.get(n) is None


def test_fast_status(spark, tmp_path):
    schema = "pitch_uid string, game_pk long, game_date string"
    open_ = lambda: FastStatus(spark, str(tmp_path / "s"))
    numbers = lambda row: {k: v for k, v in row.items() if k != "summary_updated_at"}
    assert open_().read()["summary_state"] == "pending" and open_().read()["pitch_rows"] is None
    rows = spark.createDataFrame([("1:1:1", 1, "2024-04-01"), ("fallback:x", 1, "2024-04-01")], schema)
    assert open_().add(rows)["summary_state"] == "pending"
    first = {"summary_state": "ready", "pitch_rows": 2, "games": 1, "latest_game_date": "2024-04-01", "missing_natural_key": 1, "integrity_stale": False, "data_revision": "r1"}
    assert numbers(open_().rebuild(rows, "r1")) == first and numbers(open_().read()) == first
    more = spark.createDataFrame([("2:1:1", 2, "2024-04-02"), ("1:1:2", 1, "2024-03-01")], schema)
    want = first | {"pitch_rows": 4, "games": 2, "latest_game_date": "2024-04-02", "integrity_stale": True, "data_revision": "r2"}
    assert numbers(open_().add(more, revision="r2")) == want
    # Rows that an ingestion only updated are received, not inserted.
    assert numbers(open_().add(more, inserted=0)) == want
    assert numbers(open_().rebuild(rows.union(more), "r2")) == want | {"integrity_stale": False}
    with pytest.raises(Exception):
        open_().rebuild(rows.selectExpr("pitch_uid", "raise_error('lost') as game_pk", "game_date"))
    assert open_().read()["summary_state"] == "error"


def test_chart_sources(spark, tmp_path):
    made, now = [], ["r1"]

    def analyse(payload):
        made.append(payload)
        return {"result": spark.range(payload["n"]).selectExpr("id", "id * 2.5 as v"), "more": spark.range(2).selectExpr("cast(null as string) as note")}

    open_ = lambda: visuals.Visuals(spark, str(tmp_path / "v"), analyse, lambda: now[0])
    v = open_()
    number = v.request({"mode": "basic", "n": 5})
    got = open_().resolve({"kind": "history", "id": number})
    assert [df.count() for df in got.sections.values()] == [5, 2] and len(made) == 1 and got.provenance["data_revision"] == "r1"
    v.log.save("mine", {"mode": "basic", "n": 3})
    assert v.resolve({"kind": "saved", "id": "mine"}).sections is None
    got = v.resolve({"kind": "saved", "id": "mine"}, rerun=True)
    assert got.sections["result"].count() == 3 and got.provenance["rerun"] and v.resolve({"kind": "saved", "id": "mine"}).sections["result"].count() == 3
    live = v.save("live", {"kind": "analysis_payload", "payload": {"mode": "basic", "n": 4}}, {"type": "line"})
    assert v.resolve({"kind": "visualization", "id": live}, rerun=True).sections["result"].count() == 4
    chain = live
    for _ in range(3):
        chain = v.save("link", {"kind": "visualization", "id": chain}, {})
    assert v.resolve({"kind": "visualization", "id": chain}).payload == {"mode": "basic", "n": 4}
    chain = v.save("link", {"kind": "visualization", "id": chain}, {})
    for bad in ({"kind": "visualization", "id": chain}, {"kind": "visualization", "id": "x"}, {"kind": "history", "id": "x"}, {"kind": "saved", "id": "x"}, {"kind": "odd"}, {"kind": "analysis_payload"}, None):
        with pytest.raises(RequestError):
            v.resolve(bad)
    # Frozen ones keep all their sections, once for equal results, as long as a chart has them.
    a = v.save("a", {"kind": "saved", "id": "mine"}, {}, frozen=True)
    v.log.save("same", {"mode": "other", "n": 3})
    b = v.save("b", {"kind": "saved", "id": "same"}, {}, frozen=True)
    snapshot = v.charts()[a]["snapshot"]
    assert v.charts()[b]["snapshot"] == snapshot and v.snapshots.folder.names() == [snapshot]
    now[0] = "r2"
    v.log.delete("mine")
    got = open_().resolve({"kind": "visualization", "id": a})
    assert list(got.sections) == ["result", "more"] and got.sections["result"].count() == 3 and got.payload is None and got.provenance["frozen"]
    assert v.delete(a) and v.snapshots.folder.names() == [snapshot] and v.delete(b) and v.snapshots.folder.names() == [] and not v.delete(b)
    v.log.save("long", {"mode": "basic", "n": 100_001})
    with pytest.raises(RequestError):
        v.save("c", {"kind": "saved", "id": "long"}, {}, frozen=True)
