"""Lines with places, committed lines and streams into them, against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from morphlake.sources import places
from morphlake.sources.commits import CommittedLines
from morphlake.streaming import committed

PROGRAM = {"steps": [{"op": "cast", "from": "text", "to": "n", "target_type": "integer"}]}


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_have_their_places_over_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    texts = {}
    for name in ("a b.txt", "c%20.txt", "empty.txt", "one.txt", "ends.txt"):
        n = {"empty.txt": 0, "one.txt": 1}.get(name, 200)
        lines = [rng.choice(["", " ", "é" * rng.randrange(9), "x" * rng.randrange(900), '{"n": 1}']) for _ in range(n)]
        texts[name] = lines
        end = {"c%20.txt": "\r\n"}.get(name, "\n")
        (tmp_path / name).write_bytes((end.join(lines) + (end if name == "ends.txt" else "")).encode())
    made = places.read_lines(spark, str(tmp_path / "*.txt"))
    assert made.rdd.getNumPartitions() > 1
    got = {}
    for r in made.collect():
        got.setdefault(r.file, []).append((r.line, r.value))
    # a last line that is empty and has no end is no line
    want = {name: [*enumerate(lines[:-1] if name != "ends.txt" and lines and not lines[-1] else lines, 1)] for name, lines in texts.items()}
    assert sorted(sorted(v) for v in got.values()) == sorted(v for v in want.values() if v)
    spaced = next(f for f in got if "a" in os.path.basename(f)[:1])
    assert sorted(got[spaced]) == want["a b.txt"]


def test_malformed_lines_keep_their_places(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"n": 1}\n\n{"n": \n[1]\n3\n"n"\nnull\n{"n": "t", "m": 2}\n  \n{}\n')
    rows = places.read_placed_json_lines(spark, str(tmp_path / "x.jsonl"), schema="n long, m long").orderBy("line").collect()
    assert [(r.line, r.malformed, r.n, r.m) for r in rows] == [
        (1, False, 1, None), (3, True, None, None), (4, True, None, None), (5, True, None, None), (6, True, None, None),
        (7, True, None, None), (8, False, None, 2), (10, False, None, None),
    ]
    assert all(r.file.endswith("x.jsonl") for r in rows)
    with pytest.raises(ValueError, match="line"):
        places.read_placed_json_lines(spark, str(tmp_path / "x.jsonl"), schema="line long")


def _values(log):
    return sorted(r.v for r in log.read("v long").collect())


def _left(path):
    return len([p for p in (path / "rows").glob("part=*")])


def test_commits(spark, tmp_path):
    log = CommittedLines(spark, f"file://{tmp_path}/t")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    assert _values(log) == []
    assert log.write(rows(1, 2, None)) and log.write(rows(2), "append", "b")
    assert not log.write(rows(3), "append", "b") and log.write(rows(4), "append")
    with pytest.raises(FileExistsError, match="3 commits"):
        log.write(rows(9))
    with pytest.raises(ValueError):
        log.write(rows(9), "ignore")
    assert sorted((r.v is None, r.v) for r in log.read("v long").collect() if r.v is not None) == [(False, 1), (False, 2), (False, 2), (False, 4)]
    assert log.read("v long").count() == 5
    assert log.write(rows(7), "overwrite") and log.write(rows(), "append") and log.write(rows(8), "append")
    assert _values(log) == [7, 8]
    assert not log.write(rows(3), "append", "b")  # a replaced batch stays known
    assert [r["rows"] for r in log.commits().orderBy("version").collect()] == [3, 1, 1, 1, 0, 1]
    assert _left(tmp_path / "t") == 6


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    log = CommittedLines(spark, f"file://{tmp_path}/t")
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        log.write(bad)
    assert _left(tmp_path / "t") == 0 and log.commits().count() == 0
    assert log.write(spark.range(3).select(F.col("id").alias("v")))
    os.makedirs(tmp_path / "t/rows/part=gone")  # a driver that died before its commit
    (tmp_path / "t/rows/part=gone/part-0.txt").write_text('{"v": 99}\n')
    assert _values(log) == [0, 1, 2]


def test_writers_at_one_time_get_versions_of_their_own(spark, tmp_path, monkeypatch):
    path, row = f"file://{tmp_path}/t", spark.range(1).select(F.col("id").alias("v"))
    one, two = CommittedLines(spark, path), CommittedLines(spark, path)
    placed = one._placed

    def late(version, manifest):  # another writer commits first, once
        monkeypatch.setattr(one, "_placed", placed)
        assert two.write(row, "append", "same")
        return placed(version, manifest)

    monkeypatch.setattr(one, "_placed", late)
    assert one.write(row, "append", "mine")
    assert [r.batch for r in one.commits().orderBy("version").collect()] == ["same", "mine"]
    monkeypatch.setattr(one, "_placed", late)
    two.write(row, "append", "again")
    two = CommittedLines(spark, f"{path}2")
    one = CommittedLines(spark, f"{path}2")
    placed = one._placed
    monkeypatch.setattr(one, "_placed", late)
    assert not one.write(row, "append", "same")  # the same batch, by two drivers
    assert one.read("v long").count() == 1 and _left(tmp_path / "t2") == 1


def _feed(spark, folder, k, texts, day="2024-01-01"):
    rows = [(i, t, f"{day} {h:02}:00:00") for i, (t, h) in enumerate(texts)]
    spark.createDataFrame(rows, "i long, text string, at string").selectExpr("i", "text", "at::timestamp_ntz at").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("i long, text string, at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stream_that_breaks_after_its_commit_repeats_nothing(spark, tmp_path, monkeypatch):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k in range(3):
        stream = _feed(spark, folder, k, [(str(10 * k + i), 0) for i in range(5)] + [("x", 0)])
    write = CommittedLines.write

    def breaks(self, df, mode, batch):
        done = write(self, df, mode, batch)
        if batch == "batch 1":
            raise RuntimeError("driver lost")
        return done

    monkeypatch.setattr(CommittedLines, "write", breaks)
    query = committed.transform_to_lines(stream, PROGRAM, out, checkpoint)
    with pytest.raises(Exception, match="driver lost"):
        query.awaitTermination()
    monkeypatch.setattr(CommittedLines, "write", write)
    committed.transform_to_lines(stream, PROGRAM, out, checkpoint).awaitTermination()
    rows = CommittedLines(spark, out).read("n long, error string").collect()
    assert sorted(r.n for r in rows if r.error is None) == [*range(5), *range(10, 15), *range(20, 25)]
    assert [r.error for r in rows if r.n is None] == ["cannot cast text to integer"] * 3


def test_counts_go_on_after_a_stop_and_late_rows_are_dropped(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    run = lambda stream: committed.count_errors(stream, PROGRAM, "at", "1 hour", "2 hours", out, checkpoint).awaitTermination()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        run(_feed(spark, folder, 0, [("1", 1), ("x", 1), ("2", 5)]))
        run(_feed(spark, folder, 1, [("3", 5), ("y", 4), ("z", 1)]))  # the last is four hours late
        made = committed.read_counts(spark, out).select(committed.wall_clock(F.col("start")).alias("start"), "error", "rows")
        got = {(r.start.hour, r.error): r["rows"] for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    bad = "cannot cast text to integer"
    assert got == {(1, None): 1, (1, bad): 1, (5, None): 2, (4, bad): 1}
