"""Upkeep of the lake: timestamps brought to one type, exports that go on from saved marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import migrate
from ..sources.adapters import BARS, bars, table
from ..sources.export import PRICES, Export
from .catalog import query, r6
from .tables import _scratch

C = F.col


def _mixed_lake(spark, sf_dir) -> str:
    """Events as a lake of old files, with instants, and new ones, without a zone."""
    path = _scratch(spark, "mixed")
    e = table(spark, sf_dir, "events").select("event_id", C("ts").cast("timestamp_ntz").alias("ts"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), C("ts"))
    is_old = C("ts") < F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    e.where(is_old).withColumn("ts", F.timestamp_micros(micros)).write.parquet(f"{path}/part=old")
    e.where(~is_old).write.parquet(f"{path}/part=new")
    return path


@query("SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'old' ELSE 'new' END AS part FROM events")
def timestamp_migration(spark, sf_dir):
    """SNK-7: a lake of mixed files rewritten with zone-less timestamps, which one scan then reads."""
    to = _scratch(spark, "migrated")
    migrate.migrate(spark, _mixed_lake(spark, sf_dir), to, by=("part",))
    return spark.read.parquet(to).select("event_id", "ts", "part")


@query("""SELECT 'ts' AS "column", CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'utc' ELSE 'keep' END AS action, count(*)::BIGINT AS rows FROM events GROUP BY 2""")
def timestamp_report(spark, sf_dir):
    """SNK-7: the dry run, rows by what their files need."""
    return migrate.summary(migrate.footers(spark, _mixed_lake(spark, sf_dir))).groupBy("column", "action").agg(F.sum("rows").alias("rows"))


@query(f"""WITH {BARS}, m AS (SELECT entity_id, max(day) AS mark FROM bars WHERE day < DATE '2000-01-01' GROUP BY 1), r AS (SELECT *, 1 AS run FROM bars WHERE day < DATE '2000-01-01' UNION ALL SELECT bars.*, 2 FROM bars LEFT JOIN m USING (entity_id) WHERE mark IS NULL OR day >= mark)
SELECT run, entity_id AS symbol, day AS date, {', '.join(f'round({p}, 6) AS {p}' for p in PRICES)} FROM r""")
def export_from_marks(spark, sf_dir):
    """SNK-6, ST-9: two runs of an export, the second from each symbol's saved day on, that day again."""
    out, b = Export(spark, _scratch(spark, "export")), bars(spark, sf_dir, rows_a_task=200_000)
    out.run(b.where("day < '2000-01-01'"), dealt=True)
    out.run(b, dealt=True)
    return out.read().select("run", "symbol", "date", *(r6(C(p)).alias(p) for p in PRICES))
