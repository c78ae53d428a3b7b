from pyspark.sql import functions as F

from tidepanel.operators import portfolio as pf
from tidepanel.operators.cs import CrossSection
from tidepanel.plans.selection import combine, combined


def test_group_returns_equal_those_of_exploded_rows(spark):
    p = spark.sql("select concat('e', pmod(id, 7)) as entity_id, date_add('2024-01-01', cast(id div 7 as int)) as day, cast(pmod(id * 31, 11) as double) / 10 as ret, if(pmod(id * 13, 6) = 0, null, cast(pmod(id * 13, 6) as int)) as q, 0.25D as w from range(140)")
    wide = p.withColumn("quantile", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("weight", F.when(F.col("q") == F.col("quantile"), F.col("w")).otherwise(0.0))
    rows = lambda d: {(r.quantile, r.day): round(r.r, 9) for r in d.collect()}
    got = pf.group_returns(p, "q", 5)
    assert rows(got) == rows(pf.returns(wide, group=["quantile"])) and len(rows(got)) == 100
    assert "Generate explode(sequence" not in got._jdf.queryExecution().toString()


def test_labels_and_ties_equal_those_of_windows(spark):
    p = spark.sql("select date_add('2024-01-01', cast(pmod(id, 3) as int)) as day, id, if(id % 5 = 0, null, cast(pmod(id * id, 17) as double)) as x from range(90)")
    cs, x = CrossSection(), F.col("x")
    r = cs.with_quantile_label(p, "x", 4, "q").withColumn("w", cs.quantile_label(x, 4)).withColumn("a", cs.average_rank(x)).withColumn("b", F.when(x.isNotNull(), F.rank().over(cs.over.orderBy(x.asc_nulls_last())) + (F.count(x).over(cs.over.partitionBy("day", "x")) - 1) / 2)).collect()
    assert all(v.q == v.w and v.a == v.b for v in r) and any(v.q for v in r)


def test_factors_of_one_table(spark):
    p = spark.sql("select concat(a, b) as entity_id, current_date() as day, nullif(a, 2) = 1 as a, nullif(b, 2) = 1 as b from values (0), (1), (2) s(a), values (0), (1), (2) t(b)")
    for mode in ("and", "or"):
        both = combine([p.select("entity_id", "day", F.col(c).alias("result")) for c in "ab"], mode).join(p.select("entity_id", combined([F.col("a"), F.col("b")], mode).alias("one")), "entity_id")
        assert both.count() == 9 and both.where("not (result <=> one)").isEmpty()
