"""Rolling, cross-section and indicator queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signals as sg
from ..operators import ts
from ..operators.cs import CrossSection
from ..operators.ts import Series
from ..sources.adapters import BARS, ENTITIES, WEEKLY, bars, bars_weekly, entities
from .catalog import query, r6

S, X, C = Series(), CrossSection(), F.col
KEY = ["entity_id", "day"]
WE = "PARTITION BY entity_id ORDER BY day"


def wn(n: int) -> str:
    return f"({WE} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, f: str) -> str:
    return f"CASE WHEN count({x}) OVER {wn(n)} = {n} THEN {f} END"


RET = f"ret AS (SELECT *, close / nullif(lag(close) OVER ({WE}), 0) - 1 AS ret FROM bars)"


@query(f"""WITH {BARS}, {RET}, m AS (SELECT *, {full('ret', 20, f'avg(ret) OVER {wn(20)}')} AS x FROM ret),
f AS (SELECT * FROM m WHERE close >= 1.0 AND x IS NOT NULL),
q AS (SELECT day, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM f GROUP BY day),
w AS (SELECT f.entity_id, f.day, greatest(lo, least(hi, x)) AS y FROM f JOIN q USING (day)),
z AS (SELECT entity_id, day, (y - avg(y) OVER (PARTITION BY day)) / nullif(stddev_samp(y) OVER (PARTITION BY day), 0) AS score FROM w),
k AS (SELECT entity_id, day, round(score, 6) AS score, row_number() OVER (PARTITION BY day ORDER BY round(score, 6) DESC NULLS LAST, entity_id) AS rank FROM z)
SELECT entity_id, day, score, rank::INTEGER AS rank FROM k WHERE rank <= 10""")
def flagship_momentum_top10(spark, sf_dir):
    """W-16, F-2, W-12, W-10, K-3: the ten strongest 20-bar momenta of each day."""
    p = ts.with_returns(bars(spark, sf_dir), S, C("close")).withColumn("x", ts.momentum_return(S, C("ret"), 20)).where("close >= 1.0 and x is not null")
    p = p.withColumn("y", X.winsorize(C("x"), 0.05, 0.95)).withColumn("score", r6(X.zscore(C("y"))))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc_nulls_last("score"), "entity_id"))
    return p.withColumn("rank", rank).where("rank <= 10").select(*KEY, "score", "rank")


@query(f"""WITH {BARS} SELECT entity_id, day, round({full('close', 5, f'avg(close) OVER {wn(5)}')}, 6) AS mean_5, round({full('close', 5, f'sum(close) OVER {wn(5)}')}, 6) AS sum_5,
round({full('close', 5, f'stddev_samp(close) OVER {wn(5)}')}, 6) AS std_5, round({full('close', 5, f'max(close) OVER {wn(5)}')}, 6) AS max_5, round({full('close', 5, f'min(close) OVER {wn(5)}')}, 6) AS min_5 FROM bars""")
def ts_mean_sum_std_max_min(spark, sf_dir):
    """W-1, W-2, W-3, W-6."""
    c = C("close")
    return bars(spark, sf_dir).select(*KEY, *(r6(f(c, 5)).alias(n) for f, n in ((S.mean, "mean_5"), (S.sum, "sum_5"), (S.std, "std_5"), (S.max, "max_5"), (S.min, "min_5"))))


@query(f"""WITH {BARS}, a AS (SELECT entity_id, day, close, list(close) OVER {wn(5)} AS v FROM bars)
SELECT entity_id, day, CASE WHEN len(v) = 5 THEN round((len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / 5, 6) END AS rank_5,
CASE WHEN len(v) = 5 THEN round((v[1] + 2 * v[2] + 3 * v[3] + 4 * v[4] + 5 * v[5]) / 15, 6) END AS decay_5,
CASE WHEN len(v) = 5 THEN (5 - list_position(v, list_max(v)))::BIGINT END AS argmax_5, CASE WHEN len(v) = 5 THEN (5 - list_position(v, list_min(v)))::BIGINT END AS argmin_5 FROM a""")
def ts_rank_decay_argmax(spark, sf_dir):
    """W-4, W-5, W-7, U-6."""
    c = C("close")
    return bars(spark, sf_dir).select(*KEY, r6(S.rank(c, 5)).alias("rank_5"), r6(S.decay_linear(c, 5)).alias("decay_5"), S.argmax(c, 5).alias("argmax_5"), S.argmin(c, 5).alias("argmin_5"))


@query(f"""WITH {BARS} SELECT entity_id, day, round(close - lag(close, 3) OVER ({WE}), 6) AS delta_3, round({full('close', 10, f'CASE WHEN stddev_pop(close) OVER {wn(10)} > 0 AND stddev_pop(volume) OVER {wn(10)} > 0 THEN corr(close, volume) OVER {wn(10)} END')}, 4) AS corr_10 FROM bars""")
def ts_delta_corr(spark, sf_dir):
    """W-8."""
    ok = (F.stddev_pop("close").over(S.frame(10)) > 0) & (F.stddev_pop("volume").over(S.frame(10)) > 0)
    return bars(spark, sf_dir).select(*KEY, r6(S.delta(C("close"), 3)).alias("delta_3"), F.round(F.when(ok, S.corr(C("close"), C("volume"), 10)), 4).alias("corr_10"))


@query(f"""WITH {BARS}, {ENTITIES}, j AS (SELECT bars.*, cap FROM bars LEFT JOIN entities USING (entity_id)),
r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY close) + (count(*) OVER (PARTITION BY day, close) - 1) / 2.0 AS ar, count(*) OVER (PARTITION BY day) AS n FROM j)
SELECT entity_id, day, round(ar / n, 6) AS cs_rank, round((close - avg(close) OVER (PARTITION BY day)) / nullif(stddev_samp(close) OVER (PARTITION BY day), 0), 6) AS cs_zscore,
round(close - avg(close) OVER (PARTITION BY day), 6) AS cs_demean, round((close - min(close) OVER (PARTITION BY day)) / nullif(max(close) OVER (PARTITION BY day) - min(close) OVER (PARTITION BY day), 0), 6) AS cs_norm,
round(close - sum(close * cap) OVER (PARTITION BY day) / nullif(sum(cap) OVER (PARTITION BY day), 0), 4) AS cs_neutral FROM r""")
def cs_rank_zscore_norm_neutralize(spark, sf_dir):
    """W-9, W-10, W-11, W-13, W-38, J-4."""
    j = bars(spark, sf_dir).join(entities(spark, sf_dir).select("entity_id", "cap"), "entity_id", "left")
    c = C("close")
    return j.select(*KEY, r6(X.rank(c)).alias("cs_rank"), r6(X.zscore(c)).alias("cs_zscore"), r6(X.demean(c)).alias("cs_demean"), r6(X.norm(c)).alias("cs_norm"), F.round(X.neutralize(c, C("cap")), 4).alias("cs_neutral"))


@query(f"""WITH {BARS}, q AS (SELECT day, quantile_cont(close, [0.1, 0.9]) AS e, quantile_cont(close, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS g FROM bars GROUP BY day)
SELECT entity_id, day, round(greatest(e[1], least(e[2], close)), 6) AS winsorized, CASE WHEN len(list_distinct(g)) = 6 THEN greatest(1, len(list_filter(g[1:5], lambda b: b < close)))::INTEGER END AS label FROM bars JOIN q USING (day)""")
def cs_winsorize_quantile_label(spark, sf_dir):
    """W-12, W-21."""
    return bars(spark, sf_dir).select(*KEY, r6(X.winsorize(C("close"), 0.1, 0.9)).alias("winsorized"), X.quantile_label(C("close"), 5).cast("int").alias("label"))


@query(f"""WITH {BARS}, q AS (SELECT day, quantile_cont(close, [0.2, 0.5, 0.8]) AS e FROM bars GROUP BY day)
SELECT entity_id, day, CASE WHEN close >= e[3] THEN 0.8 WHEN close >= e[2] THEN 0.5 WHEN close >= e[1] THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM bars JOIN q USING (day)""")
def cs_quantile_score(spark, sf_dir):
    """W-39."""
    return bars(spark, sf_dir).select(*KEY, X.quantile_score(C("close"), [0.2, 0.5, 0.8]).alias("score"))


@query(f"""WITH {BARS}, h AS (SELECT *, CASE WHEN volume >= 20 THEN close END AS x FROM bars)
SELECT entity_id, day, round(last_value(x IGNORE NULLS) OVER ({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ffill,
round(first_value(x IGNORE NULLS) OVER ({WE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bfill, round(coalesce(x, avg(x) OVER (PARTITION BY day)), 6) AS mean_fill, round(coalesce(x, 0), 6) AS zero_fill,
round(CASE WHEN stddev_samp(x) OVER (PARTITION BY day) = 0 THEN x ELSE (x - avg(x) OVER (PARTITION BY day)) / nullif(stddev_samp(x) OVER (PARTITION BY day), 0) END, 6) AS standard FROM h""")
def postprocess_fill_standardize(spark, sf_dir):
    """W-14."""
    h = bars(spark, sf_dir).withColumn("x", F.when(C("volume") >= 20, C("close")))
    x, up, down = C("x"), S.by.rowsBetween(Window.unboundedPreceding, 0), S.by.rowsBetween(0, Window.unboundedFollowing)
    return h.select(*KEY, r6(F.last(x, True).over(up)).alias("ffill"), r6(F.first(x, True).over(down)).alias("bfill"), r6(X.fill_mean(x)).alias("mean_fill"), r6(F.coalesce(x, F.lit(0.0))).alias("zero_fill"), r6(X.standardize(x)).alias("standard"))


@query(f"""WITH {BARS}, {RET}, f AS (SELECT entity_id, day, close / nullif(lag(close, 20) OVER ({WE}), 0) - 1 AS mom, {full('ret', 20, f'avg(ret) OVER {wn(20)}')} AS m, {full('ret', 20, f'stddev_samp(ret) OVER {wn(20)}')} AS v FROM ret)
SELECT entity_id, day, round(mom, 6) AS momentum_20, round(m, 6) AS momentum_return_20, round(v, 6) AS volatility_20, round(m / CASE WHEN v = 0 THEN 1e-6 ELSE v END, 6) AS risk_adjusted_20 FROM f""")
def factor_momentum_volatility(spark, sf_dir):
    """W-15 to W-18, U-1, U-2: composite factors from shared columns."""
    p = ts.with_returns(bars(spark, sf_dir), S, C("close"))
    p = p.select(*KEY, ts.momentum(S, C("close"), 20).alias("mom"), ts.momentum_return(S, C("ret"), 20).alias("m"), ts.volatility(S, C("ret"), 20).alias("v"))
    return p.select(*KEY, r6(C("mom")).alias("momentum_20"), r6(C("m")).alias("momentum_return_20"), r6(C("v")).alias("volatility_20"), r6(ts.risk_adjusted_momentum(C("m"), C("v"))).alias("risk_adjusted_20"))


MA = "ma AS (SELECT *, " + ", ".join(f"{full('close', n, f'avg(close) OVER {wn(n)}')} AS ma{n}" for n in (5, 10, 20)) + " FROM bars)"


def _ma(spark, sf_dir):
    return bars(spark, sf_dir).select("*", *(S.mean(C("close"), n).alias(f"ma{n}") for n in (5, 10, 20)))


@query(f"""WITH {BARS}, {MA} SELECT entity_id, day, round(ma5, 6) AS ma5, round(ma10, 6) AS ma10, round(ma20, 6) AS ma20, round(close / nullif(lag(close) OVER ({WE}), 0) - 1, 6) AS change_pct,
coalesce(ma5 > ma10 AND ma10 > ma20, false) AS bullish, CASE WHEN ma5 > ma20 THEN 1.0 WHEN ma20 IS NOT NULL THEN 0.0 END::DOUBLE AS weight,
CASE WHEN lag(ma5) OVER ({WE}) <= lag(ma20) OVER ({WE}) AND ma5 > ma20 THEN 1 WHEN lag(ma5) OVER ({WE}) >= lag(ma20) OVER ({WE}) AND ma5 < ma20 THEN -1 ELSE 0 END AS crossed FROM ma""")
def ma_cross_signals(spark, sf_dir):
    """W-19, W-28, W-41, W-42."""
    m = _ma(spark, sf_dir)
    return m.select(*KEY, *(r6(C(f"ma{n}")).alias(f"ma{n}") for n in (5, 10, 20)), r6(S.pct_change(C("close"))).alias("change_pct"), sg.cross(C("ma5"), C("ma10"), C("ma20")).alias("bullish"),
                    F.when(C("ma5") > C("ma20"), 1.0).when(C("ma20").isNotNull(), 0.0).alias("weight"), sg.crossover(S, C("ma5"), C("ma20")).alias("crossed"))


@query(f"""WITH {BARS}, {MA}, c AS (SELECT *, close < ma5 AS b, close > ma5 AS u FROM ma)
SELECT entity_id, day, CASE WHEN coalesce(bool_and(b) OVER {wn(3)}, false) AND count(b) OVER {wn(3)} = 3 THEN false END AS keep,
coalesce(bool_and(u) OVER ({WE} ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING), false) AND count(u) OVER ({WE} ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING) = 3
AND coalesce(bool_and(b) OVER {wn(2)}, false) AND count(b) OVER {wn(2)} = 2 AS turned FROM c""")
def fall_below_state(spark, sf_dir):
    """W-29, W-30."""
    m = _ma(spark, sf_dir)
    return m.select(*KEY, sg.falls_below(S, C("close"), C("ma5"), 3).alias("keep"), sg.turned(S, C("close"), C("ma5"), 3, 2).alias("turned"))


@query(f"""WITH {BARS}, {MA}, l AS (SELECT *, CASE WHEN ma5 > ma10 THEN 1 ELSE -1 END AS live, (ma5 - ma10) / nullif(close, 0) AS distance FROM ma WHERE ma10 IS NOT NULL),
c AS (SELECT *, coalesce((live <> lag(live) OVER ({WE}))::INTEGER, 0) AS c FROM l), g AS (SELECT *, sum(c) OVER ({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bulk FROM c)
SELECT entity_id, day, live, bulk::BIGINT AS bulk, (row_number() OVER (PARTITION BY entity_id, bulk ORDER BY day) * live)::BIGINT AS live_count, round(sum(distance) OVER (PARTITION BY entity_id, bulk ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS area FROM g""")
def ma_run_statistics(spark, sf_dir):
    """W-22, W-33."""
    m = _ma(spark, sf_dir).where("ma10 is not null").withColumns({"live": F.when(C("ma5") > C("ma10"), 1).otherwise(-1), "distance": F.try_divide(C("ma5") - C("ma10"), C("close"))})
    m = sg.run_length(m, C("live"), S)
    w = Window.partitionBy("entity_id", "run_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return m.select(*KEY, "live", C("run_id").alias("bulk"), C("run").alias("live_count"), r6(F.sum("distance").over(w)).alias("area"))


def _ema(x: str, n: int) -> str:
    return f"list_reduce({x}, lambda a, v: a + 2.0 / {n + 1} * (v - a))"


MACD = f"""{BARS}, a AS (SELECT entity_id, day, list(close) OVER ({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM bars),
d AS (SELECT entity_id, day, CASE WHEN len(v) >= 26 THEN {_ema('v', 12)} - {_ema('v', 26)} END AS diff FROM a),
b AS (SELECT *, list(diff) FILTER (WHERE diff IS NOT NULL) OVER ({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM d),
e AS (SELECT entity_id, day, diff, CASE WHEN diff IS NOT NULL THEN {_ema('w', 9)} END AS dea FROM b)"""


@query(f"""WITH {MACD}
SELECT entity_id, day, round(diff, 4) AS diff, round(dea, 4) AS dea, round(2 * (diff - dea), 4) AS macd, coalesce(diff > 0 AND dea > 0, false) AS bull FROM e""")
def macd_indicator(spark, sf_dir):
    """W-20: EMA and MACD by affine maps over chunks of bars."""
    m = ts.macd(bars(spark, sf_dir))
    return m.select(*KEY, *(F.round(C(c), 4).alias(c) for c in ("diff", "dea", "macd")), "bull")


@query(f"""WITH {MACD}, l AS (SELECT entity_id, day, CASE WHEN diff > dea THEN 1 ELSE -1 END AS live, coalesce(diff > 0 AND dea > 0, false) AS bull, row_number() OVER ({WE}) AS i FROM e),
t AS (SELECT *, lag(live) OVER ({WE}) AS was, CASE WHEN live IS DISTINCT FROM lag(live) OVER ({WE}) THEN i END AS turn FROM l), c AS (SELECT *, (i - max(turn) OVER ({WE}) + 1) * live AS run FROM t)
SELECT entity_id, day, coalesce(bool_and(bull) OVER ({WE} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), false) AND count(bull) OVER ({WE} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 AS keep_bull, live = 1 AND was = -1 AS gold_cross, lag(run) OVER ({WE}) <= -5 AND run >= 1 AS live_after_dead FROM c""")
def macd_patterns(spark, sf_dir):
    """W-35: bull for 10 bars, golden cross, long dead run turned live."""
    m = ts.macd(bars(spark, sf_dir))
    return m.select(*KEY, S.all_of(C("bull"), -9, 0).alias("keep_bull"), ((C("live") == 1) & (S.lag(C("live")) == -1)).alias("gold_cross"), ((S.lag(C("live_count")) <= -5) & (C("live_count") >= 1)).alias("live_after_dead"))


@query(f"""WITH {WEEKLY}, o AS (SELECT *, max(low) OVER {wn(3)} AS lo, min(high) OVER {wn(3)} AS hi FROM weekly)
SELECT entity_id, day, round(CASE WHEN lo <= hi THEN lo ELSE 0 END, 6) AS lo, round(CASE WHEN lo <= hi THEN hi ELSE 0 END, 6) AS hi FROM o""")
def range_overlap(spark, sf_dir):
    """W-23."""
    lo, hi = sg.overlap(S, C("low"), C("high"), 3)
    return bars_weekly(spark, sf_dir).select(*KEY, r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(f"""WITH {BARS} SELECT entity_id, day, round({full('high', 20, f'max(high) OVER {wn(20)}')}, 6) AS top, round({full('low', 20, f'min(low) OVER {wn(20)}')}, 6) AS bottom,
round({full('close', 20, f'avg(close) OVER {wn(20)}')}, 6) AS mid, round({full('close', 20, f'avg(close) OVER {wn(20)} + 2 * stddev_pop(close) OVER {wn(20)}')}, 6) AS upper,
round({full('close', 20, f'avg(close) OVER {wn(20)} - 2 * stddev_pop(close) OVER {wn(20)}')}, 6) AS lower,
CASE WHEN close < {full('close', 20, f'avg(close) OVER {wn(20)} - 2 * stddev_pop(close) OVER {wn(20)}')} THEN true WHEN close > {full('close', 20, f'avg(close) OVER {wn(20)} + 2 * stddev_pop(close) OVER {wn(20)}')} THEN false END AS signal FROM bars""")
def top_bottom_bollinger(spark, sf_dir):
    """W-34, W-36."""
    rows = ts.long_stats(bars(spark, sf_dir).select(*KEY, "high", "low", "close"), 20, moments=("close",), tops=("high",), bottoms=("low",))
    b = sg.bands(C("close"), C("close_mean"), C("close_dev"))
    return rows.select(*KEY, r6(C("high_top")).alias("top"), r6(C("low_bottom")).alias("bottom"), *(r6(b[k]).alias(k) for k in ("mid", "upper", "lower")), b["signal"].alias("signal"))


@query(f"""WITH {BARS}, l AS (SELECT *, lead(close, 5) OVER ({WE}) AS f FROM bars)
SELECT entity_id, day, round(f, 6) AS predict, round(close / nullif(f, 0) - 1, 6) AS change_reference, round(f / nullif(close, 0) - 1, 6) AS forward_return,
CASE WHEN rnk >= 0.9 THEN 0.9 WHEN rnk >= 0.5 THEN 0.5 WHEN rnk IS NOT NULL THEN 0.0 END::DOUBLE AS tier
FROM (SELECT *, CASE WHEN f IS NOT NULL THEN (rank() OVER (PARTITION BY day ORDER BY f / nullif(close, 0) NULLS LAST) + (count(f) OVER (PARTITION BY day, f / nullif(close, 0)) - 1) / 2.0) / nullif(count(f) OVER (PARTITION BY day), 0) END AS rnk FROM l)""")
def forward_labels(spark, sf_dir):
    """W-24: the reference label has its sign inverted; forward_return is the plain one."""
    p = bars(spark, sf_dir).withColumn("f", S.lead(C("close"), 5))
    ratio = F.try_divide(C("f"), C("close"))
    p = p.withColumn("q", ratio).withColumn("rnk", X.rank(C("q")))
    return p.select(*KEY, r6(C("f")).alias("predict"), r6(F.try_divide(C("close"), C("f")) - 1).alias("change_reference"), r6(ratio - 1).alias("forward_return"), F.when(C("rnk") >= 0.9, 0.9).when(C("rnk") >= 0.5, 0.5).when(C("rnk").isNotNull(), 0.0).alias("tier"))


@query(f"""WITH {BARS}, {MA}, s AS (SELECT *, ma5 > ma10 AS sig FROM ma), n AS (SELECT *, row_number() OVER ({WE}) = 1 OR sig IS DISTINCT FROM lag(sig) OVER ({WE}) AS new FROM s)
SELECT entity_id, day, sig, CASE WHEN sig THEN 'open_long' WHEN NOT sig THEN 'close_long' END AS signal, round(close, 6) AS close, day + 1 AS due FROM n WHERE new""")
def trading_signals(spark, sf_dir):
    """W-25, J-17, U-8: signal changes with price and due day."""
    m = sg.changes(_ma(spark, sf_dir).withColumn("sig", C("ma5") > C("ma10")), C("sig"), S)
    return m.select(*KEY, "sig", F.when(C("sig"), "open_long").when(~C("sig"), "close_long").alias("signal"), r6(C("close")).alias("close"), F.date_add("day", 1).alias("due"))


@query(f"""WITH {BARS}, g AS (SELECT entity_id, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM bars GROUP BY entity_id)
SELECT entity_id, day, round(last_value(close IGNORE NULLS) OVER ({WE} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS close FROM g LEFT JOIN bars USING (entity_id, day)""")
def fill_gaps_limited(spark, sf_dir):
    """W-26."""
    return sg.fill_gaps(bars(spark, sf_dir), "close", 2).select(*KEY, r6(C("close")).alias("close"))


@query(f"""WITH {WEEKLY} SELECT e.entity_id, d.day, round(close, 6) AS close FROM (SELECT DISTINCT entity_id FROM weekly) e CROSS JOIN (SELECT DISTINCT day FROM weekly) d LEFT JOIN weekly w ON w.entity_id = e.entity_id AND w.day = d.day""")
def fill_same_times(spark, sf_dir):
    """W-27."""
    return sg.same_times(bars_weekly(spark, sf_dir), "close").select(*KEY, r6(C("close")).alias("close"))


@query(f"""WITH {BARS}, {RET}, v AS (SELECT *, exp(sum(ln(1 + ret)) OVER ({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS c FROM ret WHERE ret > -1)
SELECT entity_id, day, round(c, 5) AS compounded, round(c / max(c) OVER ({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS drawdown, round(close * 100 / first_value(CASE WHEN close <> 0 THEN close END IGNORE NULLS) OVER ({WE} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS rebased FROM v""")
def drawdown_rebase(spark, sf_dir):
    """W-44, W-45."""
    v = ts.with_returns(bars(spark, sf_dir), S, C("close")).where("ret > -1").withColumn("c", sg.compounded(C("ret"), S.by))
    return v.select(*KEY, F.round("c", 5).alias("compounded"), r6(sg.drawdown(C("c"), S.by)).alias("drawdown"), r6(sg.rebase(C("close"), S.by, 100.0)).alias("rebased"))


@query(f"""WITH {BARS}, {MA}, a AS (SELECT *, {full('volume', 10, f'avg(volume) OVER {wn(10)}')} AS v10 FROM ma),
h AS (SELECT *, coalesce(close > ma5 AND close < 1.15 * ma5 AND close > ma10 AND close < 1.1 * ma10 AND volume > 1.2 * v10 AND turnover > 20000, false) AS hit FROM a)
SELECT entity_id, day, hit, bool_or(hit) OVER ({WE} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AND coalesce(close > ma5 AND turnover > 20000, false) AS valid, coalesce(ma5 > ma10 AND turnover > 20000, false) AS cross_volume FROM h""")
def volume_up_ma(spark, sf_dir):
    """W-31, W-32, W-37: averages broken upward on volume, and how long a hit stays valid."""
    m = _ma(spark, sf_dir).withColumn("v10", S.mean(C("volume"), 10))
    c, no = C("close"), F.lit(False)
    hit = (c > C("ma5")) & (c < 1.15 * C("ma5")) & (c > C("ma10")) & (c < 1.1 * C("ma10")) & (C("volume") > 1.2 * C("v10")) & (C("turnover") > 20000)
    m = m.withColumn("hit", F.coalesce(hit, no))
    valid = F.bool_or("hit").over(S.by.rowsBetween(-3, 0)) & F.coalesce((c > C("ma5")) & (C("turnover") > 20000), no)
    return m.select(*KEY, "hit", valid.alias("valid"), F.coalesce((C("ma5") > C("ma10")) & (C("turnover") > 20000), no).alias("cross_volume"))


@query(f"""WITH {BARS}, {RET} SELECT entity_id, day, coalesce(count(CASE WHEN ret > 0 THEN 1 END) OVER (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) >= 4, false) AS good FROM ret""")
def passed_in_window(spark, sf_dir):
    """W-40: passing rows counted in a left-open calendar window."""
    p = ts.with_returns(bars(spark, sf_dir), S, C("close"))
    return p.select(*KEY, sg.passed_in_window(C("ret") > 0, "entity_id", C("day"), 30, 4).alias("good"))


@query(f"""WITH {BARS}, w AS (SELECT entity_id, day, close FROM bars WHERE day < (SELECT max(day) FROM bars)),
f AS (SELECT entity_id, day, round(CASE WHEN count(close) OVER b = 5 THEN avg(close) OVER b END, 8) AS x FROM bars WINDOW b AS ({WE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
g AS (SELECT entity_id, day, round(CASE WHEN count(close) OVER b = 5 THEN avg(close) OVER b END, 8) AS x FROM w WINDOW b AS ({WE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT * FROM g EXCEPT ALL SELECT * FROM f""")
def look_ahead_check(spark, sf_dir):
    """W-46: rows of a factor that change when the last day is left out (none, if it doesn't look ahead)."""
    full_ = bars(spark, sf_dir)
    last = full_.agg(F.max("day").alias("last"))
    cut = full_.join(F.broadcast(last), C("day") < C("last")).drop("last")
    f = lambda d: d.select(*KEY, F.round(S.mean(C("close"), 5), 8).alias("x"))
    return f(cut).exceptAll(f(full_))
