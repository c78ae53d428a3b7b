"""Top lists, flags and breakouts of every trade day, for all days in one job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import toplists as tl
from ..sources.adapters import BARS, ENTITIES, bars, entities
from .catalog import query

C = F.col
# The tables' suppliers change by more in a day and trade less than shares: these take the place of the limits of a share market.
LIMIT, LEAST, BIG, LISTED_DAYS = 0.5, 20000, 5000.0, 30


def _full(x: str, n: int) -> str:
    w = f"OVER (PARTITION BY entity_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN avg({x}) {w} END"


DAYS = """days AS (SELECT day, row_number() OVER (ORDER BY day)::INTEGER AS nr, coalesce(day - lag(day) OVER (ORDER BY day) = 1, false)::INTEGER AS near FROM (SELECT DISTINCT day FROM bars))"""
FLAGS = f"""b1 AS (SELECT bars.*, nr, close / nullif(lag(close) OVER (PARTITION BY entity_id ORDER BY day), 0) - 1 AS ch, {", ".join(f"{_full('close', n)} AS m{n}" for n in (10, 20, 30, 60, 120, 250))}, {_full('volume', 30)} AS v30 FROM bars JOIN days USING (day)),
b2 AS (SELECT *, coalesce(bool_or(turnover >= {LEAST} AND ch > 0.08) OVER (PARTITION BY entity_id ORDER BY nr RANGE BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS rose, coalesce(bool_or(ch > {LIMIT}) OVER (PARTITION BY entity_id ORDER BY nr RANGE BETWEEN 9 PRECEDING AND CURRENT ROW), false) AS was_up,
coalesce(((close > m120 AND close < 1.15 * m120) OR (close > m250 AND close < 1.1 * m250)) AND turnover > {LEAST}, false) AS near_, coalesce(volume > 2 * v30, false) AS loud FROM b1),
marks AS (SELECT entity_id, day, coalesce(ch > {LIMIT}, false) AS limit_up, was_up AND coalesce(turnover >= {LEAST} AND close > m10, false) AS active,
rose AND coalesce(turnover >= {LEAST} AND close > m20 AND m10 > m20 AND m20 > m30 AND m30 > m60 AND m60 > m120 AND m120 > m250, false) AS trending,
near_ AND bool_or(near_ AND loud) OVER (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS vol_up FROM b2)"""


@query(f"WITH {BARS}, {DAYS}, {FLAGS} SELECT entity_id, day, limit_up, active, trending, vol_up FROM marks")
def trending_and_active_by_day(spark, sf_dir):
    """W-48, W-31: limit-up, active, trending and breakout of every bar, with the averages up to 250."""
    b = bars(spark, sf_dir)
    return tl.marked(b, tl.calendar(b), C("change") > LIMIT, LEAST)


LISTS = """win AS (SELECT t.day, s.nr AS start_nr, s.day AS start, s.nr > t.nr - t.near - 19 AS short, l.nr IS NOT NULL AND s.nr <= l.nr - l.near AND s.nr > l.nr - l.near - 30 AS long
  FROM days t LEFT JOIN days l ON l.nr = t.nr - t.near - 18 JOIN days s ON s.nr <= t.nr - t.near AND s.nr > t.nr - 50),
cand AS (SELECT DISTINCT t.day, b.entity_id FROM days t JOIN bars b ON b.day BETWEEN t.day - 7 AND t.day AND b.turnover >= 0 JOIN entities e ON e.entity_id = b.entity_id AND e.list_date + 30 <= t.day),
lastbar AS (SELECT c.*, b.day AS last_day, b.close AS last FROM cand c ASOF JOIN bars b ON c.entity_id = b.entity_id AND c.day >= b.day),
grid AS (SELECT l.*, w.start_nr, w.start, w.short, w.long FROM lastbar l JOIN win w USING (day) WHERE (w.short OR w.long) AND l.last_day >= w.start),
scored AS (SELECT g.*, round(coalesce((g.last - f.close) / nullif(abs(f.close), 0), 0), 9) AS score FROM grid g ASOF JOIN bars f ON g.entity_id = f.entity_id AND g.start <= f.day),
best AS (SELECT day, entity_id, bool_or(short) AS short, bool_or(long) AS long FROM (SELECT *, row_number() OVER (PARTITION BY day, start_nr ORDER BY score DESC, entity_id) AS k FROM scored) WHERE k <= 30 GROUP BY ALL),
lists AS (SELECT day, entity_id, 'short' AS list FROM best WHERE short UNION SELECT day, entity_id, 'long' FROM best WHERE long UNION SELECT day, entity_id, 'short' FROM marks JOIN entities USING (entity_id) WHERE limit_up OR active OR trending
  UNION SELECT day, entity_id, CASE WHEN cap >= 5000 THEN 'big_vol_up' ELSE 'small_vol_up' END FROM marks JOIN entities USING (entity_id) WHERE vol_up AND list_date + 30 <= day)"""


def _stored_sql(n: str) -> str:
    return f"(count(*) FILTER (WHERE list = '{n}'))::BIGINT AS {n}_count, to_json(coalesce(list(entity_id ORDER BY entity_id) FILTER (WHERE list = '{n}'), []::VARCHAR[]))::VARCHAR AS {n}_stocks"


@query(f"WITH {BARS}, {ENTITIES}, {DAYS}, {FLAGS}, {LISTS} SELECT day, {', '.join(map(_stored_sql, tl.LISTS))}, to_json(list(DISTINCT entity_id ORDER BY entity_id))::VARCHAR AS all_stocks FROM lists GROUP BY day")
def top_lists_by_day(spark, sf_dir):
    """S-7, A-7: short and long performers, limit-up, active and trending ones and breakouts, a row a trade day with JSON lists."""
    return tl.as_json(tl.top_lists(bars(spark, sf_dir), entities(spark, sf_dir), C("change") > LIMIT, LEAST, BIG, LISTED_DAYS))
