"""Files of every stored kind of timestamp become one zone-less dataset."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidepanel.sources import lake, migrate

TIMES = [dt.datetime(2024, 3, 10, 2, 30, 0, 123456), None, dt.datetime(1960, 1, 1, 0, 0, 0, 1)]  # the first is skipped by New York's clocks


@pytest.fixture
def mixed(tmp_path):
    at = tmp_path / "lake"
    for day in ("a", "b"):
        (at / f"day={day}").mkdir(parents=True)
    plain = pa.array(TIMES, pa.timestamp("us"))
    nanos = plain.cast(pa.timestamp("ns"))
    files = {
        "day=a/plain": plain, "day=a/zoned": plain.cast(pa.timestamp("us", tz="Asia/Shanghai")), "day=b/nanos": nanos, "day=b/nanos [zoned]": nanos.cast(pa.timestamp("ns", tz="UTC")),
        "day=b/millis": pa.array([t and t.replace(microsecond=0) for t in TIMES], pa.timestamp("ms", tz="UTC")),
    }
    for n, (name, ts) in enumerate(files.items()):
        pq.write_table(pa.table({"id": [3 * n, 3 * n + 1, 3 * n + 2], "ts": ts}), at / f"{name}.parquet")
    pq.write_table(pa.table({"id": [90, 91, 92], "ts": nanos, "extra": ["x", None, "z"]}), at / "day=b/int96.parquet", use_deprecated_int96_timestamps=True)
    pq.write_table(pa.table({"id": [99], "other": [1.5]}), at / "day=b/none.parquet")
    return f"file://{at}"


def test_report_names_each_file_and_what_it_needs(spark, mixed):
    got = {(r.path.rsplit("/", 1)[1].removesuffix(".parquet"), r.type, r.action, r.rows) for r in migrate.footers(spark, mixed).collect()}
    assert got == {
        ("plain", "timestamp[us]", "keep", 3), ("zoned", "timestamp[us, tz=Asia/Shanghai]", "utc", 3), ("nanos", "timestamp[ns]", "micros", 3),
        ("nanos [zoned]", "timestamp[ns, tz=UTC]", "micros", 3), ("millis", "timestamp[ms, tz=UTC]", "utc", 3), ("int96", "int96", "utc", 3), ("none", None, "keep", 1),
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_migrated_rows_are_the_same_instants(spark, mixed, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        to = f"file://{tmp_path}/to"
        migrate.migrate(spark, mixed, to, by=("day",))
        rows = spark.read.parquet(to)
        assert dict(rows.dtypes) == {"id": "bigint", "ts": "timestamp_ntz", "extra": "string", "other": "double", "day": "string"}
        got = {r.id: r.ts for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want = {3 * n + k: t and (t.replace(microsecond=0) if n == 4 else t) for n in range(5) for k, t in enumerate(TIMES)}
    assert got == want | dict(zip((90, 91, 92), TIMES)) | {99: None}
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == "false"
    after = migrate.footers(spark, to).collect()
    assert {r.action for r in after} == {"keep"} and {r.type for r in after if r.column} == {"timestamp[us]"}
    assert all(".lz4" in r.path for r in after)


def test_broken_file_is_named_and_nothing_is_written(spark, mixed, tmp_path):
    (tmp_path / "lake/day=a/bad.parquet").write_bytes(b"not parquet")
    assert [r.path.endswith("bad.parquet") for r in migrate.footers(spark, mixed).where("action = 'unreadable'").collect()] == [True]
    with pytest.raises(ValueError, match="bad.parquet"):
        migrate.migrate(spark, mixed, f"file://{tmp_path}/to")
    assert not (tmp_path / "to").exists()


def test_nanoseconds_are_cut_towards_the_past(spark, tmp_path):
    (tmp_path / "from").mkdir()
    pq.write_table(pa.table({"ts": pa.array([-1, 1999, -2000], pa.timestamp("ns"))}), tmp_path / "from" / "n.parquet")
    migrate.migrate(spark, f"file://{tmp_path}/from", f"file://{tmp_path}/to")
    epoch = dt.datetime(1970, 1, 1)
    assert sorted(r.ts for r in spark.read.parquet(f"file://{tmp_path}/to").collect()) == [epoch - dt.timedelta(microseconds=2), epoch - dt.timedelta(microseconds=1), epoch + dt.timedelta(microseconds=1)]


def test_without_zone_is_right_at_clock_changes(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_micros(1710037800000000) AS ts")
        assert lake.without_zone(df).first().ts == dt.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
