"""The blob store and the chain of stages."""

import pytest
from pyspark.sql import functions as F

from logweft.operators import session as sessions
from logweft.operators import stages
from logweft.sources import blobs
from logweft.sources.records import sessions as stored_sessions

RECORD = sessions.RECORD


def rows(spark, **contents):
    return spark.createDataFrame([(k, None if v is None else bytearray(v.encode())) for k, v in contents.items()], blobs.SCHEMA)


def held(store):
    return {r.key: bytes(r.content).decode() for r in store.table().collect()}


def test_store_keeps_versions(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path))
    assert held(store) == {} and store.version() == 0
    first = store.put(rows(spark, a="1", b="2", c="3"))
    began = store.at(first)
    store.put(rows(spark, b="two", d="4"))
    store.delete(rows(spark, a="", z="").select("key"))
    assert held(store) == {"b": "two", "c": "3", "d": "4"} and held(began) == {"a": "1", "b": "2", "c": "3"}
    assert [bytes(r.content) for r in store.get(rows(spark, c="", q="").select("key")).collect()] == [b"3"]
    store.clear()
    assert held(store) == {} and held(began) == {"a": "1", "b": "2", "c": "3"} and store.put(rows(spark)) == 4
    store.put(rows(spark, e="5"))
    store.forget(store.version())
    assert held(store) == {"e": "5"} and len(list((tmp_path / "data").iterdir())) == 1
    with pytest.raises(ValueError):
        store.at(1).clear()


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path))
    store.put(rows(spark, a="1"))
    broken = rows(spark, a="2").withColumn("content", F.expr("if(key = 'a', cast(raise_error('no disk') as binary), content)"))
    with pytest.raises(Exception, match="no disk"):
        store.put(broken)
    assert held(store) == {"a": "1"} and store.version() == 1
    with pytest.raises(blobs.Conflict):
        store.committed(1, {})
    assert held(store) == {"a": "1"}


def test_contents_are_joined_on_restore(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path))
    store.put(rows(spark, a="1"))
    got = blobs.hydrated(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, key string"), "key", store)
    assert {r.n: r.content and bytes(r.content) for r in got.collect()} == {1: b"1", 2: None, 3: None}


def test_stored_sessions(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id":"a","mode":"best","images":[{"id":1,"status":"accepted"}],"deletedRecordIds":["r"]}\n{"id":"b"}\nnot json\n')
    got = {r.id: (r.mode, len(r.images), list(r.deletedRecordIds), r.corrupt) for r in stored_sessions(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"a": ("best", 1, ["r"], False), "b": ("balanced", 0, [], False), None: ("balanced", 0, [], True)}


def record(k, player, item, time="[01:00:00]"):
    return (k, f"record_{k}", "1-1", time, player, item, "manual")


@pytest.fixture(scope="module")
def chain():
    return sessions.chain()


@pytest.fixture(scope="module")
def with_records(spark, chain):
    """A session with records typed in, that has import and issues behind it."""

    def make(*records, read=()):
        images = spark.createDataFrame([(1, "accepted", "active", "abc")], "id long, status string, lifecycle string, checksum string")
        slices = spark.createDataFrame([("1-1", 1)], "slice_id string, image_id long")
        schema = f"ord long, slice_id string, mode string, status string, rejection_reason string, {RECORD.replace('ord long, ', '')}"
        began = sessions.started(spark, images, slices, spark.createDataFrame(list(read), schema))
        entered = chain.entered(began, 1)
        return entered.having(manual=spark.createDataFrame(list(records), RECORD))

    return make


def listed(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord").collect()]


def test_typed_records_come_after_those_read(chain, with_records):
    read = [(0, "1-1", "balanced", "accepted", None, "record_1-1", "1-1", "[01:00:00]", "Ann", "pie", "ocr")]
    s = with_records(record(1, "Ann", "cake"), record(2, " ", "cake"), read=read)
    assert listed(sessions.base(s), "id", "player") == [("record_1-1", "Ann"), ("record_1", "Ann")]


def test_work_stays_while_its_start_does(spark, chain, with_records):
    s = chain.entered(with_records(record(1, "Ann", "pie")), 2)
    s = s.having(edits=spark.createDataFrame([record(1, "Ann", "cake")], RECORD))
    assert listed(chain.entered(s, 2).parts["edits"], "item") == [("cake",)] and listed(sessions.final(s), "item") == [("cake",)]


def test_results_and_settings(chain, with_records):
    s = chain.entered(with_records(record(1, "Ann", "pie", "[23:59:58]"), record(2, "Ann", "pie", "[23:59:58]"), record(3, "Bob", "cake", "[00:00:02]")), 3)
    s = chain.entered(sessions.with_setting(s, "export_settings", format="csv", effect="scaled"), 4)
    assert listed(s.parts["results"], "id") == [("record_1",), ("record_3",)]
    assert tuple(s.parts["export_settings"].first()) == ("csv", "scaled")


def test_reach(spark, chain, with_records):
    exported = chain.entered(with_records(record(1, "Ann", "pie")), 4)
    renamed = exported.having(edits=spark.createDataFrame([record(1, "Bob", "pie")], RECORD))
    assert chain.reachable(exported) == 4 and chain.reachable(renamed) == 3
    assert chain.reachable(renamed.having(edits=exported.parts["edits"])) == 4
    assert chain.reachable(sessions.with_setting(exported, "import_settings", mode="best")) == 1
    retyped = exported.having(manual=spark.createDataFrame([record(1, "Ann", "cake")], RECORD))
    assert chain.reachable(retyped) == 2
    again = chain.entered(retyped, 2)
    assert again.parts["edits"].isEmpty() and chain.reachable(again) == 3
    assert "import" not in chain.forgotten(exported).initial and chain.forgotten(exported).given == exported.given


def test_a_stage_that_starts_anew_loses_its_work(spark, chain, with_records):
    s = chain.entered(with_records(record(1, "Ann", "pie")), 2).having(deleted=spark.createDataFrame([("record_1",)], "id string"), edits=spark.createDataFrame([record(1, "Bob", "")], RECORD))
    s = chain.entered(s.having(manual=spark.createDataFrame([record(1, "Ann", "cake")], RECORD)), 2)
    assert s.parts["edits"].isEmpty() and s.parts["deleted"].isEmpty() and s.current == 2


def test_fingerprints_do_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert stages.told(a) == stages.told(a.orderBy(F.desc("k")).repartition(3)) != stages.told(a.where("k = 1"))
