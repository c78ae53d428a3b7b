"""Exports to very many folders: named as Spark names them, written by tasks that start no process, listed together."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidepanel.plans import studies
from tidepanel.sources import lake
from tidepanel.sources.export import Export


def most_tasks(spark, job):
    """The tasks of the largest stage that the job runs."""
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, "counted")
    try:
        job()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s)


def test_folders_and_rows_are_those_of_sparks_own_writer(spark, tmp_path):
    names = [None, "", "a", "001", "a b", "a/b", "x:y=z", "%41", "é 票", "[c]^", "q\"'#?*\\", "tab\there"]
    rows = spark.createDataFrame([(s, f"{i},{k}") for i, s in enumerate(names) for k in range(3)], "symbol string, value string")
    rows.write.partitionBy("symbol").text(f"file://{tmp_path}/spark")
    lake.write_lines(rows, f"file://{tmp_path}/own", "symbol", "txt")
    folders = lambda at: {p.name for p in (tmp_path / at).iterdir() if p.is_dir()}
    assert folders("own") == folders("spark")
    read = lambda at: sorted((r.symbol or "", r.value) for r in spark.read.schema("value string, symbol string").text(f"file://{tmp_path}/{at}").collect())
    assert read("own") == read("spark") and len(read("own")) == 3 * len(names)
    assert not list((tmp_path / "own").rglob(".*"))  # no file of an attempt is left


def test_an_export_of_many_symbols_lists_its_folders_in_few_tasks(spark, tmp_path):
    bars = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 150).alias("entity_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 150).cast("int")).alias("day"), F.col("id").cast("double").alias("close"))
    out = Export(spark, f"file://{tmp_path}/x")
    assert most_tasks(spark, lambda: (out.run(bars.where("day < '2024-01-02'")), out.run(bars))) <= 64
    assert out.read(1).count() == 150 and out.read(2).count() == 300
    assert {r.mark for r in out.marks().collect()} == {dt.date(2024, 1, 2)}


def test_what_a_failed_run_left_is_gone(spark, tmp_path):
    left = tmp_path / "x/data/run=1/symbol=old"
    left.mkdir(parents=True)
    (left / "part-00000.csv").write_text("date,open,high,low,close,volume\n2024-01-01,0.0,0.0,0.0,5.0,1.0\n")
    out = Export(spark, f"file://{tmp_path}/x")
    out.run(spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "entity_id string, day date, close double"))
    assert [r.symbol for r in out.latest().collect()] == ["a"]
