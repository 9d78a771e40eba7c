"""Loading with bad rows and copies, appended notes, the registry of seen items."""

import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from dealscope.session import scratch_path
from dealscope.sources import loading as ld
from dealscope.sources import notes as nt
from dealscope.sources import tables as src
from dealscope.streaming import ingest as st
from dealscope.streaming import seen as sn


def put(folder, name, text):
    file = pathlib.Path(folder) / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding="utf-8")
    return str(file)


@pytest.fixture()
def folder(spark):
    return scratch_path(spark, "csv-in").removeprefix("file://")


def test_a_bad_line_goes_to_its_own_output(spark, folder):
    put(folder, "a.csv", 'x,y,z\n1,2,3\n4,5\n6,7,8,9\n"q, r",N/A,\n')
    put(folder, "b.csv", "x,x,\n1,2,3\n")
    put(folder, "empty.csv", "")
    put(folder, "notes.txt", "no table")
    loaded = ld.load(spark, folder)
    assert {tuple(r) for r in loaded.tables["a"].collect()} == {("1", "2", "3"), ("q, r", None, None)}
    assert loaded.tables["b"].columns == ["x", "x1", "_c2"]
    assert sorted(r["record"] for r in loaded.bad_rows.collect()) == ["4,5", "6,7,8,9"]
    assert {r["file"].rsplit("/", 1)[1] for r in loaded.bad_rows.collect()} == {"a.csv"}
    status = {r["name"]: r for r in loaded.status.collect()}
    assert (status["a"]["n_rows"], status["a"]["n_bad"], status["a"]["cache"]) == (2, 2, "miss")
    assert status["empty"]["status"] == "failed" and set(status) == {"a", "b", "empty"}


def test_files_that_lack_columns(spark, folder):
    put(folder, "t.csv/part1.csv", "id,name,extra\n1,a,e\n2,b,f\n")
    put(folder, "t.csv/part2.csv", "name,id\nc,3\nd,4,5\n")
    loaded = ld.load(spark, [f"{folder}/t.csv", f"{folder}/gone.csv"])
    assert sorted(map(tuple, loaded.tables["t"].collect())) == [("1", "a", "e"), ("2", "b", "f"), ("3", "c", None)]
    assert [r["record"] for r in loaded.bad_rows.collect()] == ["d,4,5"]
    status = {r["name"]: r for r in loaded.status.collect()}
    assert status["t"]["missing_columns"] == ["extra"] and "gone.csv" in status["gone"]["error"]


def test_line_breaks_in_cells(spark, folder):
    put(folder, "m.csv", '"first\nname",n\n"one\ntwo",1\nplain,2\n')
    loaded = ld.load(spark, folder, multiLine=True)
    assert sorted(map(tuple, loaded.tables["m"].collect())) == [("one\ntwo", "1"), ("plain", "2")]


def test_copies_are_used_until_a_file_changes(spark, folder):
    path, cache = put(folder, "a.csv", "x\n1\n2,3\n"), scratch_path(spark, "copies")
    first = ld.load(spark, folder, cache)
    again = ld.load(spark, folder, cache)
    for loaded, kind in ((first, "miss"), (again, "hit")):
        row = loaded.status.first()
        assert (row["cache"], row["n_rows"], row["n_bad"]) == (kind, 1, 1)
        assert [r["x"] for r in loaded.tables["a"].collect()] == ["1"] and loaded.bad_rows.first()["record"] == "2,3"
    put(folder, "a.csv", "x\n7\n8\n")
    os.utime(path, (2_000_000_000, 2_000_000_000))
    changed = ld.load(spark, folder, cache)
    assert sorted(r["x"] for r in changed.tables["a"].collect()) == ["7", "8"]
    summary = ld.load_summary(changed.status).first()
    assert (summary["cache_misses"], summary["total_rows"], summary["bad_rows"], summary["errors"]) == (1, 2, 0, "")


def test_the_files_are_read_once(spark, folder):
    """Only the write of the copy scans the file; counts and later reads use the copy."""
    put(folder, "a.csv", "x\n" + "1\n" * 100)
    loaded = ld.load(spark, folder)
    os.remove(f"{folder}/a.csv")
    assert loaded.tables["a"].count() == 100 and loaded.status.first()["n_rows"] == 100


def test_header_only(spark, folder):
    put(folder, "h.csv", "x,y\n")
    loaded = ld.load(spark, folder)
    assert loaded.tables["h"].columns == ["x", "y"] and loaded.tables["h"].count() == 0 and loaded.bad_rows.count() == 0


# ---- notes


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), "day string, seq bigint, note string")


def documents(days):
    out = {}
    for r in sorted(days.parts().collect(), key=lambda r: r["place"]):
        out[r["day"]] = out.get(r["day"], "") + r["part"]
    return out


def test_appending_twice_leaves_one_note(spark):
    days = nt.DayNotes(spark, scratch_path(spark, "notes"))
    assert documents(days) == {}
    assert days.append("a1", notes(spark, ("d1", 2, "two"), ("d1", 1, "one"), ("d2", 1, "x"), ("d2", 9, None)), "day", "seq", "note")
    assert not days.append("a1", notes(spark, ("d1", 1, "again")), "day", "seq", "note")
    assert days.append("a2", notes(spark, ("d1", 0, "three")), "day", "seq", "note")
    sep = "\n\n---\n\n"
    assert documents(days) == {"d1": sep.join(["one", "two", "three"]), "d2": "x"}


def test_a_crash_between_the_writes_leaves_the_old_document(spark, monkeypatch):
    days = nt.DayNotes(spark, scratch_path(spark, "notes"))
    days.append("a1", notes(spark, ("d1", 1, "one")), "day", "seq", "note")
    with monkeypatch.context() as broken:
        broken.setattr(days, "_commit", lambda _: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            days.append("a2", notes(spark, ("d1", 2, "half")), "day", "seq", "note")
    assert documents(days) == {"d1": "one"}
    assert days.append("a2", notes(spark, ("d1", 2, "whole")), "day", "seq", "note")
    assert documents(days) == {"d1": "one\n\n---\n\nwhole"}
    # a writer that lost the race for its commit changes nothing
    src.create_empty(spark, f"{days.path}/commits/0000000007-a2")
    assert documents(days) == {"d1": "one\n\n---\n\nwhole"}
    with pytest.raises(ValueError):
        days.append("../x", notes(spark, ("d1", 2, "half")), "day", "seq", "note")


def test_documents_as_files(spark):
    days = nt.DayNotes(spark, scratch_path(spark, "notes"))
    days.append("a1", notes(spark, ("d1", 1, "one"), ("d1", 2, "two"), ("d2", 1, "x")), "day", "seq", "note")
    path = days.write_documents(scratch_path(spark, "documents"))
    text = "".join(p.read_text() for p in sorted(pathlib.Path(path.removeprefix("file:")).glob("document=notes_d1/part-*")))
    assert text == "one\n\n---\n\ntwo\n"


# ---- seen items


def hashes(spark, values):
    return spark.createDataFrame([(v,) for v in values], "h string")


def test_registry_equals_a_set(spark):
    draw = random.Random(1)
    registry, known = sn.SeenItems(spark, scratch_path(spark, "seen"), rows_per_part=40, merge_after=3), set()
    for number in range(8):
        batch = {f"x{draw.randrange(700)}" for _ in range(90)}
        got = {r["h"] for r in registry.unseen(hashes(spark, sorted(batch)), "h", number).collect()}
        assert got == batch - known, number
        registry.add(number, hashes(spark, sorted(got)), "h")
        # the same batch again finds and leaves the same
        assert {r["h"] for r in registry.unseen(hashes(spark, sorted(batch)), "h", number).collect()} == got
        registry.add(number, hashes(spark, sorted(got)), "h")
        known |= batch
    assert {r["hash"] for r in registry.hashes().collect()} == known
    assert registry.state().parts > sn.FIRST_PARTS or len(known) <= 40 * sn.FIRST_PARTS
    registry.merge()
    state = registry.state()
    assert state.batches == [] and {r["hash"] for r in registry.hashes().collect()} == known
    assert registry.unseen(hashes(spark, ["x1", "new", None]), "h").where("h = 'new'").count() == 1


def test_bytes_opened_do_not_grow_with_the_registry(spark):
    def opened(n):
        registry = sn.SeenItems(spark, scratch_path(spark, "seen"), rows_per_part=500)
        registry.add(0, spark.range(n).select(F.md5(F.col("id").cast("string")).alias("h")), "h")
        registry.merge()
        asked = spark.range(-3, 2).select(F.md5(F.col("id").cast("string")).alias("h"))  # two of five are known
        assert registry.unseen(asked, "h").count() == 3
        return registry.bytes_opened(asked, "h"), registry.state().parts

    small, parts = opened(8_000)
    large, more = opened(64_000)
    assert more == 8 * parts and large < 1.5 * small


def test_a_registry_without_batches(spark):
    registry = sn.SeenItems(spark, scratch_path(spark, "seen"))
    assert registry.unseen(hashes(spark, ["a"]), "h").count() == 1 and registry.hashes().count() == 0


def test_stream_of_seen_items_with_merges(spark):
    folder, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    for step in range(5):
        rows = spark.range(step * 10, step * 10 + 20).select(F.col("id"), F.concat(F.lit("v"), "id").alias("val"))
        rows.coalesce(1).write.mode("append").parquet(folder)
        st.ingest_unseen(st.new_files(spark, folder, "id bigint, val string", "parquet"), "val", target, state, merge_after=2)
    found = [r["val"] for r in spark.read.parquet(target).collect()]
    assert sorted(found) == sorted(f"v{i}" for i in range(60))
