"""Quotes, tags, pools, money flow and news."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as ex
from ..operators.ts import Series
from ..sources.adapters import BARS, ENTITIES, TICKS, bars, entities, table, ticks
from .catalog import query, r6

C, S = F.col, Series()
CH = "c AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY entity_id ORDER BY day), 0) - 1 AS ch FROM bars)"


def _changes(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("ch", S.pct_change(C("close")))


@query(f"""WITH {BARS}, {CH}, d AS (SELECT day, (count(*) FILTER (WHERE ch > 0))::BIGINT AS up, (count(*) FILTER (WHERE ch <= 0))::BIGINT AS down, (count(*) FILTER (WHERE ch > 0.09))::BIGINT AS limit_up, round(sum(turnover), 4) AS turnover, round(avg(ch), 6) AS change FROM c GROUP BY day)
SELECT *, lag(up) OVER (ORDER BY day) AS previous_up FROM d""")
def quote_stats(spark, sf_dir):
    """A-11: the day's counts beside the day before's. One row a day is ordered, not the bars."""
    d = _changes(spark, sf_dir).groupBy("day").agg(F.count_if(C("ch") > 0).alias("up"), F.count_if(C("ch") <= 0).alias("down"), F.count_if(C("ch") > 0.09).alias("limit_up"), F.round(F.sum("turnover"), 4).alias("turnover"), r6(F.avg("ch")).alias("change"))
    return d.withColumn("previous_up", F.lag("up").over(Window.partitionBy(F.lit(0)).orderBy("day")))


@query(f"""WITH {BARS}, {CH}, {ENTITIES} SELECT area AS tag, day, count(c.entity_id)::BIGINT AS n, (count(*) FILTER (WHERE ch > 0))::BIGINT AS up, round(sum(turnover), 4) AS turnover, round(avg(ch), 6) AS change FROM c JOIN entities USING (entity_id) GROUP BY ALL""")
def tag_quote_stats(spark, sf_dir):
    """A-12, J-6, J-14."""
    c = _changes(spark, sf_dir).join(F.broadcast(entities(spark, sf_dir).select("entity_id", C("area").alias("tag"))), "entity_id")
    return c.groupBy("tag", "day").agg(F.count("*").alias("n"), F.count_if(C("ch") > 0).alias("up"), F.round(F.sum("turnover"), 4).alias("turnover"), r6(F.avg("ch")).alias("change"))


@query(f"""WITH {BARS}, {ENTITIES}, s AS (SELECT day, exchange AS tag, sum(turnover) AS t, count(*) AS n, string_agg(entity_id, ',' ORDER BY entity_id) AS ids FROM bars JOIN entities USING (entity_id) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY t DESC, n DESC, tag) - 1 AS pos FROM s), d AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM s)),
m AS (SELECT p.*, k - row_number() OVER (PARTITION BY tag ORDER BY p.day) AS island FROM p JOIN d USING (day) WHERE pos < 5)
SELECT day, tag, pos::INTEGER AS position, n::BIGINT AS n, ids, row_number() OVER (PARTITION BY tag, island ORDER BY day)::BIGINT AS days_in_a_row FROM m""")
def pool_tag_stats(spark, sf_dir):
    """A-13, A-14: each day's five main tags, their members, and for how many days in a row."""
    s = bars(spark, sf_dir).join(F.broadcast(entities(spark, sf_dir).select("entity_id", C("exchange").alias("tag"))), "entity_id")
    s = s.groupBy("day", "tag").agg(F.sum("turnover").alias("t"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("ids"))
    p = s.withColumn("position", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("t"), F.desc("n"), "tag")) - 1)
    d = s.select("day").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")))
    m = p.where("position < 5").join(d, "day").withColumn("island", C("k") - F.row_number().over(Window.partitionBy("tag").orderBy("day")))
    return m.select("day", "tag", "position", "n", "ids", F.row_number().over(Window.partitionBy("tag", "island").orderBy("day")).cast("long").alias("days_in_a_row"))


@query(f"""WITH {BARS}, {CH}, {ENTITIES} SELECT area, day, round(sum(turnover * ch), 2) AS flow, round(sum(ch) / count(*), 6) AS rate FROM c JOIN entities USING (entity_id) GROUP BY ALL""")
def index_money_flow(spark, sf_dir):
    """A-16, P-7, P-8: member amounts summed, rates over all members (a missing rate counts as a row)."""
    c = _changes(spark, sf_dir).join(F.broadcast(entities(spark, sf_dir).select("entity_id", "area")), "entity_id")
    return c.groupBy("area", "day").agg(F.round(F.sum(C("turnover") * C("ch")), 2).alias("flow"), r6(F.sum("ch") / F.count("*")).alias("rate"))


@query(f"""WITH {TICKS} SELECT entity_id, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS ids, count(*)::BIGINT AS n FROM ticks GROUP BY entity_id""")
def series_as_arrays(spark, sf_dir):
    """A-17: each entity's rows as one ordered array."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x.event_id.cast("string"))
    return ticks(spark, sf_dir).groupBy("entity_id").agg(F.array_join(rows, ",").alias("ids"), F.count("*").alias("n"))


@query(f"""WITH {TICKS}, m AS (SELECT min(price) AS lo, max(price) AS hi FROM ticks WHERE price IS NOT NULL), b AS (SELECT CASE WHEN price = hi THEN 10 ELSE floor((price - lo) / ((hi - lo) / 10))::INTEGER + 1 END AS bucket FROM ticks, m WHERE price IS NOT NULL)
SELECT bucket::BIGINT AS bucket, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY bucket""")
def distribution(spark, sf_dir):
    """A-24: histogram of ten bins, counts and shares."""
    t = ticks(spark, sf_dir).where("price is not null")
    m = t.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    place = F.when(C("price") == C("hi"), 10).otherwise(F.floor((C("price") - C("lo")) / ((C("hi") - C("lo")) / 10)) + 1).cast("long")
    b = t.join(F.broadcast(m), C("price") >= C("lo")).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    return b.withColumn("share", r6(C("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


# Topics and their words.
TOPICS = {"articles": ["the", "la", "der"], "joins": ["and", "und", "et"]}


@query("""WITH w AS (SELECT * FROM (VALUES ('articles','the'),('articles','la'),('articles','der'),('joins','and'),('joins','und'),('joins','et')) v(topic, word))
SELECT source AS entity_id, topic, sum(len(string_split(text, word)) - 1)::BIGINT AS hits, sum(len(string_split(text, word)) - 1) >= 20 AS grouped FROM documents, w WHERE text IS NOT NULL GROUP BY source, topic""")
def texts_by_topic(spark, sf_dir):
    """A-25, A-26, F-15: occurrences of every topic word in an entity's whole texts; counted by text, as no word holds the space that joins texts."""
    hits = F.array(*(F.struct(F.lit(k).alias("topic"), sum((ex.occurrences(C("text"), F.lit(w)) for w in v), F.lit(0)).cast("long").alias("hits")) for k, v in TOPICS.items()))
    d = table(spark, sf_dir, "documents").where("text is not null").select(C("source").alias("entity_id"), F.explode(hits).alias("h"))
    return d.groupBy("entity_id", C("h.topic").alias("topic")).agg(F.sum("h.hits").alias("hits")).withColumn("grouped", C("hits") >= 20)


@query("""WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source AS entity_id, array_to_string(list(lang || '=' || n ORDER BY lang), ',') AS tags, arg_max(lang, (n, lang)) AS main_tag, coalesce(arg_max(lang, (n, lang)) FILTER (WHERE lang <> 'en'), 'other') AS without_en FROM d GROUP BY source""")
def tag_maps(spark, sf_dir):
    """T-1 to T-5, SC-12: tag -> reason maps, the main tag, and what is left when one is removed."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy(C("source").alias("entity_id")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    main = lambda m: F.get(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e.value.alias("v"), e.key.alias("k"))), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), F.lit(0)).k
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k).cast("string"))), ",")
    return d.select("entity_id", shown.alias("tags"), main(C("m")).alias("main_tag"), F.coalesce(main(F.map_filter("m", lambda k, v: k != "en")), F.lit("other")).alias("without_en"))


@query("""WITH a AS (SELECT DISTINCT n_name AS alias FROM nation), t AS (SELECT r_name AS tag, r_regionkey AS k FROM region), p AS (SELECT alias, tag, k, len(list_intersect(list_distinct(string_split(alias, '')), list_distinct(string_split(tag, '')))) AS n FROM a, t),
r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, k) AS q FROM p) SELECT alias, CASE WHEN n >= 2 THEN tag ELSE alias END AS tag, CASE WHEN n >= 2 THEN 'main_tag' ELSE 'new_tag' END AS kind FROM r WHERE q = 1""")
def match_tags(spark, sf_dir):
    """T-8: the tag with most distinct characters in common (two at least); the catalogue of tags is broadcast."""
    a = table(spark, sf_dir, "nation").select(C("n_name").alias("alias")).distinct().withColumn("j", F.lit(1))
    t = table(spark, sf_dir, "region").select(C("r_name").alias("tag"), C("r_regionkey").alias("k"), F.lit(1).alias("j"))
    p = a.join(F.broadcast(t), "j").withColumn("n", F.size(F.array_intersect(F.split("alias", ""), F.split("tag", ""))))
    r = p.withColumn("q", F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("n"), "k"))).where("q = 1")
    return r.select("alias", F.when(C("n") >= 2, C("tag")).otherwise(C("alias")).alias("tag"), F.when(C("n") >= 2, "main_tag").otherwise("new_tag").alias("kind"))


@query(f"""WITH {ENTITIES} SELECT area AS tag, count(*)::BIGINT AS n, array_to_string(list(DISTINCT exchange ORDER BY exchange), ',') AS sub_tags, array_to_string(list(entity_id ORDER BY entity_id), ',') AS members FROM entities GROUP BY area""")
def tag_relations(spark, sf_dir):
    """T-6, T-7, A-15, A-32, SC-13: sub tags and members of each tag."""
    e = entities(spark, sf_dir)
    return e.groupBy(C("area").alias("tag")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("exchange")), ",").alias("sub_tags"), F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("members"))


@query(f"""WITH {BARS}, l AS (SELECT day, count(*) AS n FROM bars GROUP BY day) SELECT day, n::BIGINT AS n, n >= 20 AS complete FROM l WHERE day >= (SELECT max(day) - 30 FROM l)""")
def completeness_gate(spark, sf_dir):
    """A-33."""
    l = bars(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"))
    last = l.agg(F.date_sub(F.max("day"), 30).alias("since"))
    return l.join(F.broadcast(last), C("day") >= C("since")).select("day", "n", (C("n") >= 20).alias("complete"))


@query("""WITH f AS (SELECT l_suppkey AS entity_id, l_partkey AS member, sum(l_extendedprice) AS cap FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey AS entity_id, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1), s AS (SELECT entity_id, sum(cap) AS cap FROM f GROUP BY 1)
SELECT entity_id, round(cap, 2) AS cap, round(cap / mean, 6) AS ratio FROM s JOIN m USING (entity_id) QUALIFY row_number() OVER (ORDER BY round(cap / mean, 9) DESC, entity_id) <= 20""")
def fund_holding_top(spark, sf_dir):
    """A-10, A-38, J-7: held value over the mean value, the top twenty (a report)."""
    g = table(spark, sf_dir, "lineitem").groupBy(C("l_suppkey").alias("entity_id")).agg(F.sum("l_extendedprice").alias("cap"), F.avg("l_extendedprice").alias("mean"))
    return g.withColumn("q", F.try_divide("cap", "mean")).orderBy(F.desc(F.round("q", 9)), "entity_id").limit(20).select("entity_id", F.round("cap", 2).alias("cap"), r6(C("q")).alias("ratio"))


@query(f"""WITH {BARS}, h AS (SELECT day, least(floor(close / 300), 7)::INTEGER AS height FROM bars), g AS (SELECT day, height, count(*) AS n FROM h GROUP BY ALL) SELECT day, max(height)::INTEGER AS max_height, sum(height * n)::BIGINT AS continuous_power FROM g GROUP BY day""")
def limit_ladder(spark, sf_dir):
    """A-36."""
    g = bars(spark, sf_dir).groupBy("day", F.least(F.floor(C("close") / 300), F.lit(7)).cast("int").alias("height")).agg(F.count("*").alias("n"))
    return g.groupBy("day").agg(F.max("height").alias("max_height"), F.sum(C("height") * C("n")).alias("continuous_power"))
