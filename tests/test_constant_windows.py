import numpy as np
from pyspark.sql import functions as F

from tidepanel.operators import portfolio as pf
from tidepanel.operators.ts import Series


def test_corr_of_windows_that_do_not_vary(spark):
    """Volume is the same on the first days, so the first windows have no correlation; the later ones have."""
    p = spark.sql("select 'a' as entity_id, date_add('2024-01-01', cast(id as int)) as day, cast(id * id as double) as close, cast(greatest(id, 3) as double) as volume from range(8)")
    got = [r.c for r in p.select("day", F.round(Series().corr(F.col("close"), F.col("volume"), 3), 6).alias("c")).sort("day").collect()]
    x, v = [float(i * i) for i in range(8)], [float(max(i, 3)) for i in range(8)]
    assert got == [None] * 4 + [round(float(np.corrcoef(x[i - 2 : i + 1], v[i - 2 : i + 1])[0, 1]), 6) for i in range(4, 8)]


def test_information_coefficient_of_equal_factors(spark):
    p = spark.sql("select date'2024-01-01' as day, 1.0D as f, cast(id as double) as y from range(4) union all select date'2024-01-02', cast(id as double), cast(id as double) from range(4)")
    got = {str(r.day): r.ic for r in pf.information_coefficient(p, "f", "y").collect()}
    assert got["2024-01-01"] is None and abs(got["2024-01-02"] - 1) < 1e-12
