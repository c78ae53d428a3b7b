"""Exports that go on from saved days."""

import datetime as dt

import pytest

from tidepanel.sources.export import Export

SCHEMA = "entity_id string, day date, close double, volume double"


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def rows_of(df):
    return sorted((r.symbol, r.date, r.close) for r in df.collect())


def test_second_run_goes_on_from_each_symbols_last_day(spark, tmp_path):
    out = Export(spark, f"file://{tmp_path}/x")
    first = [("001", d(0), 1.0, 1.0), ("001", d(1), 2.0, 1.0), ("b", d(400), None, 1.0), (None, d(3), 9.0, 1.0), ("b", None, 9.0, 1.0)]
    assert out.run(spark.createDataFrame(first, SCHEMA)) == 1
    assert rows_of(out.read()) == [("001", d(0), 1.0), ("001", d(1), 2.0), ("b", d(400), None)]
    again = [*first, ("001", d(2), 3.0, 1.0), ("c", d(0), 5.0, 1.0)]
    again[1] = ("001", d(1), 2.5, 1.0)  # the last bar was unfinished
    assert out.run(spark.createDataFrame(again, SCHEMA)) == 2
    assert rows_of(out.read(2)) == [("001", d(1), 2.5), ("001", d(2), 3.0), ("b", d(400), None), ("c", d(0), 5.0)]
    assert rows_of(out.latest()) == [("001", d(0), 1.0), ("001", d(1), 2.5), ("001", d(2), 3.0), ("b", d(400), None), ("c", d(0), 5.0)]
    assert {(r.symbol, r.mark) for r in out.marks().collect()} == {("001", d(2)), ("b", d(400)), ("c", d(0))}
    folders = {p.name for p in (tmp_path / "x/data/run=2").iterdir() if p.is_dir()}
    assert folders == {"symbol=001", "symbol=b", "symbol=c"}
    head = next((tmp_path / "x/data/run=2/symbol=c").glob("*.csv")).read_text().splitlines()
    assert head == ["date,open,high,low,close,volume", "2024-01-01,0.0,0.0,0.0,5.0,1.0"]


def test_a_run_that_fails_before_its_marks_is_done_again(spark, tmp_path, monkeypatch):
    out = Export(spark, f"file://{tmp_path}/x")
    bars = spark.createDataFrame([("a", d(0), 1.0, 1.0), ("a", d(1), 2.0, 1.0)], SCHEMA)
    out.run(bars.where("day < '2024-01-02'"))

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(out, "read", lost)  # the rows are written, the marks are not
    with pytest.raises(RuntimeError):
        out.run(bars)
    monkeypatch.undo()
    assert rows_of(out.read()) == [("a", d(0), 1.0)] and out.last_run() == 1
    assert out.run(bars) == 2
    assert rows_of(out.latest()) == [("a", d(0), 1.0), ("a", d(1), 2.0)]


def test_nothing_to_export(spark, tmp_path):
    out = Export(spark, f"file://{tmp_path}/x")
    none = spark.createDataFrame([], SCHEMA)
    out.run(none)
    assert out.latest().isEmpty() and out.marks().isEmpty()
    out.run(spark.createDataFrame([("a", d(0), 1.0, 1.0)], SCHEMA))
    out.run(none)
    assert rows_of(out.latest()) == [("a", d(0), 1.0)] and out.marks().count() == 1
