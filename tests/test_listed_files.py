"""Exports read by the list of their files, which the writing tasks make, instead of a look into each folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel import registry
from tidepanel.sources import lake
from tidepanel.sources.export import Export

SCHEMA = "entity_id string, day date, open double, close double, volume double"


def same(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("dealt", [False, True])
def test_rows_by_the_list_are_those_of_sparks_reader(spark, tmp_path, monkeypatch, dealt):
    names = ["", "a", "001", "a b/c", "é 票", "__HIVE_DEFAULT_PARTITION__", *(f"s{i}" for i in range(40))]
    values = [None, float("nan"), float("inf"), -float("inf"), -0.0, 1e-7, 1.0e22, 0.1 + 0.2, 12345678.9]
    rows = [(s, dt.date(2024, 1, 1 + k), values[(i + k) % 9], 1.5 * k, values[k]) for k in range(9) for i, s in enumerate(names)]
    bars = spark.createDataFrame(rows, SCHEMA).repartition(2, "entity_id")
    out = Export(spark, f"file://{tmp_path}/x")
    out.run(bars.where("day < '2024-01-05'"), dealt)
    out.run(bars, dealt)
    # by the list, no folder of a symbol is looked at: the inputs are the lists alone
    assert out.read().inputFiles() and all(f"{tmp_path}/x/files/" in f for f in out.read().inputFiles())
    listed = {name: same(read()) for name, read in (("1", lambda: out.read(1)), ("all", out.read), ("latest", out.latest))}
    # the two symbols that are read back without a name have no mark, as before
    assert len(listed["1"]) == 4 * len(names) and len(listed["all"]) == 10 * len(names) + 2 * 3
    files = spark.read.parquet(f"file://{tmp_path}/x/files").collect()
    assert all((tmp_path / f"x/data/run={f.run}/{f.file}").stat().st_size == f.bytes for f in files) and len(files) == len(list(tmp_path.glob("x/data/*/*/*.csv")))
    assert len(files) == 2 * len(names) or not dealt
    monkeypatch.setattr(out, "_listed", lambda *_: None)  # as for a run of before there were lists
    assert listed == {name: same(read()) for name, read in (("1", lambda: out.read(1)), ("all", out.read), ("latest", out.latest))}


def test_a_run_without_a_list_is_read_by_folders(spark, tmp_path):
    at = tmp_path / "x/data/run=1/symbol=old"
    at.mkdir(parents=True)
    (at / "part-00000.csv").write_text("date,open,high,low,close,volume\n2024-01-01,0.0,0.0,0.0,5.0,1.0\n")
    spark.createDataFrame([("old", dt.date(2024, 1, 1))], "symbol string, mark date").write.parquet(f"file://{tmp_path}/x/marks/run=1")
    out = Export(spark, f"file://{tmp_path}/x")
    assert out.run(spark.createDataFrame([("old", dt.date(2024, 1, 2), 1.0, 2.0, 3.0)], SCHEMA)) == 2
    assert [(r.date.day, r.close) for r in out.latest().orderBy("date").collect()] == [(1, 5.0), (2, 2.0)]


def test_long_files_are_read_in_pieces(spark, tmp_path):
    lines = spark.range(400_000).select(F.when(F.col("id") % 9 > 0, "long").otherwise("short").alias("k"), F.concat(F.lit("é,"), "id", F.lit(" ")).alias("value"))
    lake.write_lines(lines.repartition(1), f"file://{tmp_path}/x", "k", "txt", "head", f"file://{tmp_path}/list", dealt=True)
    got = lake.read_lines(spark.read.parquet(f"file://{tmp_path}/list"), f"file://{tmp_path}/x", header=True)
    assert got.columns == ["k", "value"] and got.count() == 400_000 and got.exceptAll(lines).isEmpty()
    (tmp_path / "x/k=short/cut.txt").write_text("head\nlast line without an end")
    cut = spark.createDataFrame([("short", "k=short/cut.txt", 30)], "k string, file string, bytes long")
    assert [tuple(r) for r in lake.read_lines(cut, f"file://{tmp_path}/x", header=True).collect()] == [("short", "last line without an end")]


def test_a_query_reads_its_k_lines_by_the_list(spark):
    files = registry.queries()["kline_export"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
