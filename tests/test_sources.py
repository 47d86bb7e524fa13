"""Files of a snapshot: dialects from all bytes, splittable reading, types, folders, counts and digests."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallybridge.catalogue import write_folders
from tallybridge.errors import CompareError
from tallybridge.functions.exact import exact_session
from tallybridge.sources import dialect
from tallybridge.sources.files import digests, inventory
from tallybridge.sources.snapshots import read_snapshot


def read(spark, source, options=None):
    with exact_session(spark):
        found = read_snapshot(spark, str(source) if not isinstance(source, list) else [str(p) for p in source], options)
        return found, found.rows.collect()


def reading(path, step, piece, monkeypatch):
    """The states of a file's ranges of ``step`` bytes, read ``piece`` bytes at a time, merged in order."""
    monkeypatch.setattr(dialect, "PIECE", piece)
    size, whole = path.stat().st_size, {}
    for at in range(0, size, step):
        for key, both in dialect.range_states(str(path), at, min(size, at + step), size, dialect.candidates({}))[0].items():
            whole[key] = dialect.merged(whole[key], both) if key in whole else both
    return whole


def test_states_merge_wherever_a_file_is_cut(tmp_path, monkeypatch):
    rnd = random.Random(5)
    for trial in range(60):
        path = tmp_path / f"{trial}.csv"
        path.write_bytes(bytes(rnd.choice(b'a,;"\n\r\\\'x1') for _ in range(rnd.randrange(1, 40))))
        want = reading(path, 1 << 20, 1 << 20, monkeypatch)
        assert reading(path, rnd.randrange(1, 9), rnd.randrange(1, 5), monkeypatch) == want


def test_a_misleading_beginning(spark, tmp_path, monkeypatch):
    """The first hundred kilobytes fit semicolons as well; only what follows shows the commas."""
    path = tmp_path / "x.csv"
    path.write_text("id;note,amount\n" + "".join(f"{i};a,{i}.5\n" for i in range(12_000)) + "".join(f"{i},7.25\n" for i in range(3000)))
    found, rows = read(spark, path)
    assert found.profile["parsing"][0]["delimiter"] == "," and found.schema == {"id;note": "VARCHAR", "amount": "DOUBLE"} and len(rows) == 15_000
    assert found.profile["parsing"][0]["splittable"]
    monkeypatch.setattr(dialect, "RANGE", 1000)
    monkeypatch.setattr(dialect, "PIECE", 300)
    again, _ = read(spark, path)
    assert again.profile["parsing"] == found.profile["parsing"] and again.profile["row_count"] == 15_000


@pytest.mark.parametrize(
    ("text", "quote", "escape", "splittable", "rows"),
    [
        ('a;b\n"x;y";1\n"p ""q""";2\n', '"', '"', True, [("x;y", 1), ('p "q"', 2)]),
        ("a;b\n'x;y';1\n'it''s';2\n", "'", "'", True, [("x;y", 1), ("it's", 2)]),
        ('a,b\n"x\\",y",1\n"z",2\n', '"', "\\", True, [('x",y', 1), ("z", 2)]),
        ('a,b\n"x\ny",1\nz,2\n', '"', '"', False, [("x\ny", 1), ("z", 2)]),
        ('a,b\r\nx,1\r\n\r\ny,2\r\n', '"', '"', True, [("x", 1), ("y", 2)]),
        ('﻿a|b\nä|1\n日本|2', '"', '"', True, [("ä", 1), ("日本", 2)]),
    ],
)
def test_quotes_and_line_ends(spark, tmp_path, text, quote, escape, splittable, rows):
    path = tmp_path / "q.csv"
    path.write_bytes(text.encode())
    found, got = read(spark, path)
    parsing = found.profile["parsing"][0]
    assert sorted(map(tuple, got)) == sorted(rows) and found.profile["row_count"] == len(rows)
    assert (parsing["quote"], parsing["escape"], parsing["splittable"]) == (quote, escape, splittable)


@pytest.mark.parametrize(
    ("raw", "message"),
    [(b"report of May\nmade by x\nid,a,b\n1,2,3\n4,5,6\n7,8,9\n", "preamble"), (b"a,b\n1,\xff\n", "UTF-8"), (b"", "empty"), (b"a,A\n1,2\n", "unique")],
)
def test_refused_files(spark, tmp_path, raw, message):
    (tmp_path / "x.csv").write_bytes(raw)
    with pytest.raises(CompareError, match=message):
        read(spark, tmp_path / "x.csv")


def test_plain_files_are_split(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id,name\n" + "".join(f"{i},name {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found, rows = read(spark, path)
        assert found.rows.rdd.getNumPartitions() > 3 and len(rows) == 20_000
        with path.open("a") as f:
            f.write("1,2,3\n")
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|malformed"):
            read(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_times(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,at,day\n1,12:34:56,2024-01-02\n2,01:02:03.5,\n3,,2024-03-04\n")
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int64()), "at": pa.array([45296000000, None], pa.time64("us"))}), tmp_path / "t.parquet")
    found, rows = read(spark, tmp_path / "t.csv")
    assert found.schema == {"id": "BIGINT", "at": "TIME", "day": "DATE"} and [str(r.at) for r in rows] == ["12:34:56", "01:02:03.500000", "None"]
    found, rows = read(spark, tmp_path / "t.parquet")
    assert found.schema["at"] == "TIME" and str(rows[0].at) == "12:34:56"
    (tmp_path / "t.csv").write_text("id,at\n1,25:00:00\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|25:00:00|cannot be cast"):
        read(spark, tmp_path / "t.csv", {"types": {"at": "TIME"}})


def test_many_files_in_one_pass(spark, tmp_path):
    for k in range(5):
        folder = tmp_path / "s" / f"region=r {k % 2}%2B" / f"day={k}"
        folder.mkdir(parents=True)
        with (folder / f"part {{{k}}}.csv").open("w") as f:
            f.write("id,v\n" + "".join(f"{k * 10 + i},{i}\n" for i in range(k)))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counting", "")
    types = {"types": {"id": "BIGINT", "v": "BIGINT"}}  # a file without rows fits any type
    found, rows = read(spark, tmp_path / "s", types)
    few = len(jobs.getJobIdsForGroup("counting"))
    assert sorted(f["rows"] for f in found.profile["files"]) == [0, 1, 2, 3, 4]
    assert {(r.region, r.day) for r in rows} == {("r 1+", "1"), ("r 0+", "2"), ("r 1+", "3"), ("r 0+", "4")} and len(rows) == 10
    for k in range(5, 12):
        folder = tmp_path / "s" / "region=more" / f"day={k}"
        folder.mkdir(parents=True)
        (folder / "x.csv").write_text("id,v\n1,2\n")
    spark.sparkContext.setJobGroup("counting more", "")
    found, _ = read(spark, tmp_path / "s", types)
    spark.sparkContext.setJobGroup("", "")
    assert found.profile["row_count"] == 17 and len(jobs.getJobIdsForGroup("counting more")) == few, "jobs must not grow with the files"


def test_files_of_a_header_alone(spark, tmp_path):
    """Spark writes a header for an empty first partition; such a file has the types of the others."""
    (tmp_path / "1.csv").write_text("id|day|word\n")
    (tmp_path / "2.csv").write_text("id|day|word\n7|2024-01-02|a\n")
    (tmp_path / "3.csv").write_text('id|day|word\n8|2024-01-03|"b\nc"\n')
    found, rows = read(spark, tmp_path)
    assert found.schema == {"id": "BIGINT", "day": "DATE", "word": "VARCHAR"} and sorted(r.id for r in rows) == [7, 8]
    assert [f["rows"] for f in found.profile["files"]] == [0, 1, 1]
    (tmp_path / "4.csv").write_text("id|day|word\nx|2024-01-02|a\n")
    with pytest.raises(CompareError, match="disagree"):
        read(spark, tmp_path)
    (tmp_path / "alone").mkdir()
    (tmp_path / "alone" / "1.csv").write_text("id|day|word\n")
    found, rows = read(spark, tmp_path / "alone")
    assert set(found.schema.values()) == {"VARCHAR"} and rows == []


def test_folders_move_no_rows(spark, tmp_path):
    """Folder values come to the rows where these are read; neither reading nor writing folders sorts or exchanges rows."""
    for k in (1, 2):
        (tmp_path / f"kind={k}").mkdir()
        pq.write_table(pa.table({"id": list(range(50))}), tmp_path / f"kind={k}" / "x.parquet")
    found, rows = read(spark, tmp_path)
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 100 and "BuildRight" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    write_folders(spark.range(90).selectExpr("id", "id % 3 AS kind"), "kind", tmp_path / "out")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert len(read(spark, tmp_path / "out")[1]) == 90


def test_folder_conflicts(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"kind={k}").mkdir()
        pq.write_table(pa.table({"id": [k], "kind": pa.array([k], pa.int32())}), tmp_path / f"kind={k}" / "x.parquet")
    found, rows = read(spark, tmp_path)
    assert found.schema["kind"] == "INTEGER" and sorted(map(tuple, rows)) == [(1, 1), (2, 2)]
    pq.write_table(pa.table({"id": [3], "kind": pa.array([7], pa.int32())}), tmp_path / "kind=2" / "y.parquet")
    with pytest.raises(CompareError, match="another value"):
        read(spark, tmp_path)


def test_schemas_must_agree(spark, tmp_path):
    pq.write_table(pa.table({"a": pa.array([1], pa.int32()), "b": ["x"]}), tmp_path / "1.parquet")
    pq.write_table(pa.table({"b": ["y"], "a": pa.array([2], pa.int32())}), tmp_path / "2.parquet")
    assert sorted(map(tuple, read(spark, tmp_path)[1])) == [(1, "x"), (2, "y")]
    pq.write_table(pa.table({"b": ["y"], "a": pa.array([2], pa.int64())}), tmp_path / "3.parquet")
    with pytest.raises(CompareError, match="disagree"):
        read(spark, tmp_path)


def test_refused_folders(tmp_path):
    (tmp_path / "a").mkdir()
    with pytest.raises(CompareError, match="no .csv"):
        inventory(str(tmp_path))
    (tmp_path / "a" / "x.csv").write_text("a\n1\n")
    assert [f.path for f in inventory(str(tmp_path))] == [str(tmp_path / "a" / "x.csv")]
    (tmp_path / "l.csv").symlink_to(tmp_path / "a" / "x.csv")
    with pytest.raises(CompareError, match="link to a file"):
        inventory(str(tmp_path))
    (tmp_path / "l.csv").unlink()
    (tmp_path / "k").symlink_to(tmp_path / "a")
    with pytest.raises(CompareError, match="link to a folder"):
        inventory(str(tmp_path))
    (tmp_path / "k").unlink()
    for name, message in (("p=1", "same Hive"), ("p=%FF", "UTF-8"), ("=1", "leaves its name"), ("p=1/P=2", "repeats")):
        folder = tmp_path / "z" / name
        folder.mkdir(parents=True)
        (folder / "y.csv").write_text("a\n1\n")
        with pytest.raises(CompareError, match=message):
            inventory(str(tmp_path))
        (folder / "y.csv").unlink()


def test_digests_in_tasks(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text(n * 10_000_000)
    got = digests(spark, [str(tmp_path), [str(tmp_path / "b.csv")]])
    hashed = {n: hashlib.sha256(n.encode() * 10_000_000).hexdigest() for n in "ab"}
    want = [hashlib.sha256("".join(f"{tmp_path / f'{n}.csv'}\0{hashed[n]}\n" for n in names).encode()).hexdigest() for names in ("ab", "b")]
    assert got == want
