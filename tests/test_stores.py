import json
import sqlite3

import pytest
from pyspark.sql import types as T

from scriptoria.plans.jobs import sync_snapshot
from scriptoria.sources.files import data_dir, first_existing
from scriptoria.sources.snapshot import choose_store, read_snapshot, save_snapshot, state
from scriptoria.sources.sqlite import read_sqlite

WORDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("w", T.StringType())])
GOOD = '{"w":[{"id":1,"w":"一"},{"id":2}]}'


@pytest.mark.parametrize("first", [None, "", '{"w":[{"id":1', GOOD])
@pytest.mark.parametrize("second", [None, "", "{", '{"w":[{"id":7,"w":"seven"}]}'])
def test_choice_and_recovery(spark, tmp_path, first, second):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    for p, text in ((a, first), (b, second)):
        if text is not None:
            p.write_text(text)
    seed = {"w": spark.createDataFrame([(9, "seed")], WORDS)}
    path, which = choose_store(spark, str(a), str(b), seed)
    assert which == ("preferred" if first == GOOD else "fallback" if second and len(second) > 2 else "seed")
    ids = [r.id for r in read_snapshot(spark, path, {"w": WORDS})["w"].orderBy("id").collect()]
    assert ids == {"preferred": [1, 2], "fallback": [7], "seed": [9]}[which]
    if first is not None:
        assert a.read_text() == first
    if which == "seed" and second is not None:
        assert [p.read_text() for p in tmp_path.glob("b.json.bad-*")] == [second]


def test_snapshot_is_replaced_while_read_from(spark, tmp_path):
    path = str(tmp_path / "s.json")
    save_snapshot(spark, {"w": spark.createDataFrame([(1, "a"), (2, None)], WORDS), "none": spark.createDataFrame([], WORDS)}, path)
    assert json.loads((tmp_path / "s.json").read_text()) == {"w": [{"id": 1, "w": "a"}, {"id": 2, "w": None}], "none": []}
    save_snapshot(spark, {"w": read_snapshot(spark, path, {"w": WORDS})["w"].where("id = 2")}, path)
    assert [tuple(r) for r in read_snapshot(spark, path, {"w": WORDS})["w"].collect()] == [(2, None)]
    assert state(spark, path) == "valid" and state(spark, path + "x") == "missing"
    assert {p.name for p in tmp_path.glob("*.json*")} == {"s.json"}


def test_data_dir(spark, tmp_path):
    assert data_dir("d", {}) == "d"
    assert data_dir("d", {"RAILWAY_VOLUME_MOUNT_PATH": "v"}) == "v"
    assert data_dir("d", {"RAILWAY_VOLUME_MOUNT_PATH": "v", "DATA_DIR": "x"}) == "x"
    (tmp_path / "there").write_text("x")
    assert first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "there")]) == str(tmp_path / "there")


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "wo""rds" (id INTEGER PRIMARY KEY, w TEXT, n INT, f REAL, b BLOB)')
        c.executemany('INSERT INTO "wo""rds" VALUES (?, ?, ?, ?, ?)', [(1, "一𠀀", 5, 1.5, b"\x00x"), (500, None, None, None, None), (501, 17, "12", 2, b"")])
        c.execute("CREATE TABLE empty (x INTEGER)")
        c.execute("CREATE TABLE plain (k TEXT PRIMARY KEY) WITHOUT ROWID")
        c.execute("INSERT INTO plain VALUES ('k')")
    return path


def test_sqlite(spark, database):
    df = read_sqlite(spark, database, 'wo"rds', partitions=3)
    assert [(r.id, r.w, r.n, r.f, None if r.b is None else bytes(r.b)) for r in df.orderBy("id").collect()] == [(1, "一𠀀", 5, 1.5, b"\x00x"), (500, None, None, None, None), (501, "17", 12, 2.0, b"")]
    assert [r.id for r in df.where("w = '17' and n >= 12").collect()] == [501]
    assert [r.id for r in df.where("w is null").collect()] == [500]
    assert [r.id for r in df.where("n in (5, 6)").collect()] == [1]
    assert df.select("id").count() == 3
    assert [r.id for r in read_sqlite(spark, database, 'wo"rds', equals={"n": 5, "w": "一𠀀"}).collect()] == [1]
    assert read_sqlite(spark, database, "empty").count() == 0
    assert [r.k for r in read_sqlite(spark, database, "plain").collect()] == ["k"]


def test_sync(spark, database, tmp_path):
    out = str(tmp_path / "snapshot.json")
    assert sync_snapshot(spark, database, out, ["empty", "plain"]) == ["empty", "plain"]
    assert json.loads((tmp_path / "snapshot.json").read_text()) == {"empty": [], "plain": [{"k": "k"}]}


def test_a_store_of_any_size_is_valid(spark, tmp_path):
    path = tmp_path / "big.json"
    with path.open("w") as f:
        f.write('{"w":[')
        f.write(",".join('{"id":%d,"w":"%s"}' % (i, "x" * 1000) for i in range(150_000)))
        f.write("]}")
    assert state(spark, str(path)) == state(spark, str(path), {"w": WORDS}) == "valid"
    assert choose_store(spark, str(tmp_path / "none"), str(path), {"w": spark.createDataFrame([(9, "seed")], WORDS)}) == (str(path), "fallback")
    with path.open("r+") as f:
        f.truncate(150_000_000)
    assert state(spark, str(path)) == state(spark, str(path), {"w": WORDS}) == "corrupt"


@pytest.mark.parametrize("text", ['{"w": 5}', "[]", "7", '[{"id": 1}]'])
def test_a_store_of_another_shape_is_not_read(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(GOOD)
    assert choose_store(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")) == (str(tmp_path / "b.json"), "fallback")


def test_a_store_left_aside_is_put_back(spark, tmp_path):
    """As after a crash between the two moves of a write."""
    (tmp_path / "s.json.old-1").write_text(GOOD)
    (tmp_path / "s.json.old-2").write_text('{"w":[')
    path = str(tmp_path / "s.json")
    assert choose_store(spark, str(tmp_path / "none"), path, {"w": spark.createDataFrame([(9, "seed")], WORDS)}) == (path, "fallback")
    assert (tmp_path / "s.json").read_text() == GOOD


def test_sqlite_names(spark, tmp_path):
    """A column that is called as the row id is, all three names taken, and a path with characters of its own in a URI."""
    path = str(tmp_path / "a#b?c%20.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (rowid TEXT, x INT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [("k", 1), ("k", 2), (None, 3)])
        c.execute("CREATE TABLE u (rowid TEXT, oid TEXT, _rowid_ TEXT)")
        c.execute("INSERT INTO u VALUES ('a', 'b', 'c')")
    assert sorted((r.x, r.rowid) for r in read_sqlite(spark, path, "t", partitions=2).collect()) == [(1, "k"), (2, "k"), (3, None)]
    assert [tuple(r) for r in read_sqlite(spark, path, "u").collect()] == [("a", "b", "c")]
