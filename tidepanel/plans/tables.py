"""Scans, sinks, profiles, expressions and dates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expr as ex
from ..sources import lake
from ..sources.adapters import BARS, ENTITIES, TICKS, WEEKLY, bars, bars_weekly, entities, table, ticks
from .catalog import query, r6

C = F.col


@query(f"WITH {BARS} SELECT entity_id, day, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, round(turnover, 4) AS turnover FROM bars")
def bars_daily(spark, sf_dir):
    """SRC-1, SRC-9: daily bars."""
    return bars(spark, sf_dir).select("entity_id", "day", *(r6(C(c)).alias(c) for c in ("open", "high", "low", "close", "volume")), F.round("turnover", 4).alias("turnover"))


@query(f"WITH {WEEKLY} SELECT entity_id, day, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM weekly")
def bars_weekly_levels(spark, sf_dir):
    """A-23."""
    return bars_weekly(spark, sf_dir).select("entity_id", "day", *(r6(C(c)).alias(c) for c in ("open", "high", "low", "close", "volume")))


@query(f"WITH {BARS} SELECT entity_id, day, round(close, 6) AS price FROM bars WHERE entity_id IN ('supp_1', 'supp_2', 'supp_3') AND day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND volume > 10")
def query_table_filtered(spark, sf_dir):
    """SRC-3, SRC-6, SRC-10: filter, project, rename, order."""
    d = lake.query_table(bars(spark, sf_dir), where=[C("volume") > 10], ids=["supp_1", "supp_2", "supp_3"], columns=["entity_id", "day", "close"], labels={"close": "price"}, start="1997-01-01", end="1998-12-31")
    return d.select("entity_id", "day", r6(C("price")).alias("price"))


@query(f"WITH {BARS}, {ENTITIES}, i AS (SELECT entity_id FROM entities WHERE area = 'ASIA') SELECT entity_id, count(*)::BIGINT AS n FROM bars WHERE entity_id IN (SELECT entity_id FROM i) GROUP BY 1")
def query_table_semi_join(spark, sf_dir):
    """SRC-6, SRC-7, J-9: a long id list as a semi join."""
    ids = entities(spark, sf_dir).where("area = 'ASIA'")
    return lake.query_table(bars(spark, sf_dir), ids=ids, order=["entity_id"]).groupBy("entity_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 500 AND c_mktsegment = 'BUILDING'")
def sql_with_parameters(spark, sf_dir):
    """SRC-2, SRC-4: parametrised SQL on a registered view."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("tidepanel_customer")
    return spark.sql("SELECT c_custkey, c_name, c_acctbal FROM tidepanel_customer WHERE c_acctbal > :least AND c_mktsegment = :segment", args={"least": 500, "segment": "BUILDING"})


@query(f"WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) AS k FROM bars) SELECT entity_id, day, round(close, 6) AS close FROM n WHERE k <= 5")
def last_rows_per_entity(spark, sf_dir):
    """SRC-11."""
    return lake.last_rows(bars(spark, sf_dir), 5).select("entity_id", "day", r6(C("close")).alias("close"))


@query(f"WITH {BARS} SELECT DISTINCT day FROM bars WHERE entity_id = 'supp_1' ORDER BY day DESC LIMIT 20")
def recent_trade_dates(spark, sf_dir):
    """SRC-15."""
    return lake.trade_dates(bars(spark, sf_dir), "supp_1", 20)


@query(f"""WITH {BARS}, d AS (SELECT DISTINCT day FROM bars WHERE isodow(day) < 6)
SELECT day, count(*)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT day, unnest(list_concat(generate_series(day + INTERVAL 570 MINUTE, day + INTERVAL 690 MINUTE, INTERVAL 30 MINUTE), generate_series(day + INTERVAL 780 MINUTE, day + INTERVAL 900 MINUTE, INTERVAL 30 MINUTE))) AS ts FROM d) GROUP BY day""")
def interval_timestamps(spark, sf_dir):
    """SRC-16, SC-5: the expected half-hour stamps of each business day."""
    grid = lake.session_grid(bars(spark, sf_dir).select("day").distinct(), 30)
    return grid.groupBy("day").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


@query(f"""WITH {BARS} SELECT DISTINCT date_trunc('month', day)::DATE AS month_start, last_day(day) AS month_end, (date_trunc('month', day) - INTERVAL 1 MONTH)::DATE AS previous_start, quarter(day)::INTEGER AS quarter,
CASE quarter(day) WHEN 1 THEN 'season1' WHEN 2 THEN 'half_year' WHEN 3 THEN 'season3' ELSE 'year' END AS period, (date_trunc('quarter', day) - INTERVAL 1 DAY)::DATE AS report_date, (date_trunc('quarter', day) - INTERVAL 6 MONTH - INTERVAL 1 DAY)::DATE AS report_date_2 FROM bars""")
def calendar_periods(spark, sf_dir):
    """SRC-17, SC-2, SC-3, SC-6."""
    d = C("day")
    return bars(spark, sf_dir).select(F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.add_months(F.trunc(d, "month"), -1).alias("previous_start"), F.quarter(d).alias("quarter"),
                                      ex.report_period(d).alias("period"), ex.recent_report_date(d).alias("report_date"), ex.recent_report_date(d, 2).alias("report_date_2")).distinct()


@query(f"""WITH {TICKS} SELECT event_id, strftime(ts, '%Y%m%d %H:%M') AS text, (epoch_us(ts) // 1000)::BIGINT AS ms, date_trunc('hour', ts) AS hour, (strftime(ts, '%H:%M') BETWEEN '09:30' AND '11:30' OR strftime(ts, '%H:%M') BETWEEN '13:00' AND '15:00') AS trading FROM ticks""")
def timestamps_and_sessions(spark, sf_dir):
    """F-17, SC-1, SC-4."""
    t = C("ts").cast("timestamp")
    return ticks(spark, sf_dir).select("event_id", F.date_format("ts", "yyyyMMdd HH:mm").alias("text"), F.unix_millis(t).alias("ms"), F.date_trunc("hour", t).cast("timestamp_ntz").alias("hour"), ex.in_session(C("ts")).alias("trading"))


@query(f"""WITH {BARS} SELECT count(*)::BIGINT AS n_rows, min(day) AS first_day, max(day) AS last_day, count(DISTINCT entity_id)::BIGINT AS n_entities, count_if(close IS NULL)::BIGINT AS null_close FROM bars""")
def dataset_profile(spark, sf_dir):
    """A-1, A-2."""
    return bars(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct("entity_id").alias("n_entities"), F.count_if(C("close").isNull()).alias("null_close"))


@query(f"""WITH {BARS}, f AS (SELECT close / nullif(lag(close, 20) OVER (PARTITION BY entity_id ORDER BY day), 0) - 1 AS x FROM bars)
SELECT count_if(x IS NULL)::BIGINT AS n_null, count_if(abs(x) = 'inf'::DOUBLE)::BIGINT AS n_inf, round(count_if(x IS NULL) / count(*), 6) AS null_ratio, count_if(x IS NULL) / count(*) <= 0.1 AS valid FROM f""")
def factor_validity(spark, sf_dir):
    """A-3."""
    from ..operators.ts import Series

    x, nulls = C("x"), F.count_if(C("x").isNull())
    return bars(spark, sf_dir).select(Series().pct_change(C("close"), 20).alias("x")).agg(nulls.alias("n_null"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"), r6(nulls / F.count("*")).alias("null_ratio"), (nulls / F.count("*") <= 0.1).alias("valid"))


@query(f"""WITH {ENTITIES}, x AS (SELECT entity_id, lpad((abs(hash_) % 900000 + 1)::VARCHAR, 6, '0') AS code FROM (SELECT entity_id, (split_part(entity_id, '_', 2)::BIGINT * 7919) AS hash_ FROM entities))
SELECT entity_id, split_part(entity_id, '_', 1) AS type, split_part(entity_id, '_', 2) AS number, code, 'stock_' || CASE WHEN code::INTEGER >= 600000 AND code::INTEGER < 800000 THEN 'sh' WHEN code::INTEGER >= 400000 THEN 'bj' ELSE 'sz' END || '_' || code AS stock_id FROM x""")
def entity_id_codec(spark, sf_dir):
    """P-3, SC-11."""
    e = entities(spark, sf_dir).select("entity_id")
    number = ex.entity_part(C("entity_id"), 2)
    code = F.lpad((F.abs(number.cast("bigint") * 7919) % 900000 + 1).cast("string"), 6, "0")
    return e.select("entity_id", ex.entity_part(C("entity_id"), 1).alias("type"), number.alias("number"), code.alias("code"), ex.china_stock_id(code).alias("stock_id"))


@query("""WITH t AS (SELECT p_partkey, p_retailprice AS p, CASE p_partkey % 5 WHEN 0 THEN '1,234.5' || '万' WHEN 1 THEN p_size || '%' WHEN 2 THEN '--' WHEN 3 THEN p_size || '亿' ELSE p_size || '' END AS t, p_size FROM part)
SELECT p_partkey, t, round(CASE p_partkey % 5 WHEN 0 THEN 12345000.0 WHEN 1 THEN p_size * 0.01 WHEN 2 THEN NULL WHEN 3 THEN p_size * 1e8 ELSE p_size::DOUBLE END, 6) AS value FROM t""")
def number_text(spark, sf_dir):
    """P-9, SRC-12."""
    k = C("p_partkey") % 5
    t = F.when(k == 0, "1,234.5万").when(k == 1, F.concat(C("p_size").cast("string"), F.lit("%"))).when(k == 2, "--").when(k == 3, F.concat(C("p_size").cast("string"), F.lit("亿"))).otherwise(C("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), r6(ex.to_float(t)).alias("value"))


@query(f"""WITH {WEEKLY}, p AS (SELECT entity_id, day, low AS a0, high AS a1, lag(low) OVER w AS b0, lag(high) OVER w AS b1 FROM weekly WINDOW w AS (PARTITION BY entity_id ORDER BY day))
SELECT entity_id, day, round(CASE WHEN greatest(a0, b0) <= least(a1, b1) THEN greatest(a0, b0) END, 6) AS i0, round(CASE WHEN greatest(a0, b0) <= least(a1, b1) THEN least(a0, b0) END, 6) AS c0, round(CASE WHEN b0 > a1 THEN b0 - a1 WHEN b1 < a0 THEN b1 - a0 ELSE 0 END, 6) AS dist FROM p WHERE b0 IS NOT NULL""")
def range_functions(spark, sf_dir):
    """SC-8."""
    from ..operators.ts import Series

    s = Series()
    p = bars_weekly(spark, sf_dir).withColumns({"b0": s.lag(C("low")), "b1": s.lag(C("high"))}).where("b0 is not null")
    a, b = (C("low"), C("high")), (C("b0"), C("b1"))
    return p.select("entity_id", "day", r6(ex.intersect(a, b)[0]).alias("i0"), r6(ex.combine(a, b)[0]).alias("c0"), r6(ex.distance(a, b)).alias("dist"))


@query(f"""WITH {TICKS} SELECT entity_id, max(event_id)::BIGINT AS event_id, count(*)::BIGINT AS n, sum(size)::BIGINT AS size FROM ticks GROUP BY entity_id""")
def json_fields(spark, sf_dir):
    """SC-12, SRC-13."""
    return ticks(spark, sf_dir).groupBy("entity_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"), F.sum("size").alias("size"))


def _scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, or beside the temporary ones where that is unset."""
    import tempfile

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {BARS} SELECT entity_id, day, round(close, 6) AS close, year(day)::INTEGER AS year FROM bars WHERE day >= DATE '1998-06-01'")
def lake_write_and_scan(spark, sf_dir):
    """SNK-1, SRC-1, SRC-3: partitioned write, overwrite of the same partitions, pruned scan."""
    path = _scratch(spark, "lake")
    rows = bars(spark, sf_dir).select("entity_id", "day", "close")
    lake.write_panel(rows, path)
    lake.write_panel(rows.where("day >= '2000-01-01'"), path, mode="overwrite")
    return lake.query_table(lake.scan(spark, path), start="1998-06-01").select("entity_id", "day", r6(C("close")).alias("close"), "year")


@query(f"""WITH {BARS}, f AS (SELECT entity_id, day, avg(close) OVER w AS a, CASE WHEN count(close) OVER w = 5 THEN 1 END AS ok, volume FROM bars WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT entity_id, day, round(CASE WHEN ok = 1 THEN a END, 6) AS ma_5, round(volume, 6) AS volume_0 FROM f""")
def factor_matrix(spark, sf_dir):
    """SNK-2, SRC-5, A-20, A-21: factors written long, scanned together and pivoted."""
    from ..operators.ts import Series

    b, path = bars(spark, sf_dir, rows_a_task=1_000_000), _scratch(spark, "factors")
    s = Series()
    lake.write_factor(b.select("entity_id", "day", s.mean(C("close"), 5).alias("value")), f"{path}/a", "ma_5")
    lake.write_factor(b.select("entity_id", "day", C("volume").alias("value")), f"{path}/b", "volume_0")
    long = spark.read.parquet(f"{path}/a").unionByName(spark.read.parquet(f"{path}/b"))
    return lake.wide(long, ("ma_5", "volume_0")).select("entity_id", "day", *(r6(C(c)).alias(c) for c in ("ma_5", "volume_0")))


@query("""WITH o AS (SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey AS id, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 1),
ol AS (SELECT id, max(seq) AS seq FROM o GROUP BY id), nl AS (SELECT id, max(seq) AS seq FROM n GROUP BY id), os AS (SELECT id, ol.seq FROM ol), ns AS (SELECT id, nl.seq FROM nl)
SELECT id, seq, 'ignore' AS way FROM os UNION ALL SELECT id, seq, 'ignore' FROM ns WHERE id NOT IN (SELECT id FROM os)
UNION ALL SELECT id, seq, 'replace' FROM ns UNION ALL SELECT id, seq, 'replace' FROM os WHERE id NOT IN (SELECT id FROM ns)""")
def upsert_by_key(spark, sf_dir):
    """SNK-3, SNK-5, J-10, ST-10: insert-ignore and replace by key, the last row of a key winning."""
    o = table(spark, sf_dir, "orders").select(C("o_custkey").alias("id"), C("o_orderkey").alias("seq"))
    old, new = lake.keep_last(o.where("seq % 2 = 0"), "id", "seq"), o.where("seq % 2 = 1")
    return lake.upsert(old, new).withColumn("way", F.lit("ignore")).union(lake.upsert(old, new, replace=True).withColumn("way", F.lit("replace")))


@query("WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events ORDER BY 1 DESC LIMIT 5) SELECT event_id, ts::DATE AS day FROM events WHERE ts::DATE >= (SELECT min(day) FROM d)")
def retention(spark, sf_dir):
    """SNK-4, ST-12."""
    return lake.retained(table(spark, sf_dir, "events").select("event_id", C("ts").cast("date").alias("day")), 5)


@query(f"""WITH {BARS}, m AS (SELECT entity_id, max(day) AS mark FROM bars WHERE day < DATE '2000-01-01' GROUP BY 1) SELECT entity_id, day, round(close, 6) AS close FROM bars LEFT JOIN m USING (entity_id) WHERE mark IS NULL OR day >= mark""")
def newer_than_stored(spark, sf_dir):
    """ST-9, SNK-6: rows from each entity's high-water mark on."""
    b = bars(spark, sf_dir)
    return lake.newer(b, b.where("day < '2000-01-01'")).select("entity_id", "day", r6(C("close")).alias("close"))
