"""SNK-6: bars exported as CSV, a folder for each symbol, each run going on from the days that the last one reached.

``marks`` holds a symbol's last exported day. A run exports the rows from it on,
the day itself too (its bar may have been unfinished), and symbols without a mark
in whole; the marks are replaced after the rows are written, so a run that fails
is done again with the same number and overwrites its own files alone. One writer
an export. On a local file system the writing tasks list their files in ``files``,
and reads go by that list instead of looking through a folder for each symbol.

Rows without an entity or time are no bars and stay out; a column that is missing
is filled with 0; a NULL is an empty field. Repeated rows are all written. No
rows: no files, and the marks stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake

C = F.col
# The columns of an exported file.
PRICES = ("open", "high", "low", "close", "volume")


class Export:
    def __init__(self, spark: SparkSession, path: str, entity: str = "entity_id", time: str = "day"):
        self.spark, self.path, self.entity, self.time = spark, path, entity, time

    def _versions(self) -> DataFrame:
        schema = "symbol string, mark date, run int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/marks") if lake.exists(self.spark, f"{self.path}/marks") else self.spark.createDataFrame([], schema)

    def last_run(self) -> int:
        """The number of the last finished run, 0 before the first."""
        return self._versions().agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]

    def marks(self) -> DataFrame:
        return self._versions().where(C("run") == self.last_run()).drop("run")

    def run(self, bars: DataFrame, dealt: bool = False) -> int:
        """Export what is new; the number of the run. ``dealt``: all bars of an entity lie in one task already."""
        n, marks = self.last_run() + 1, self.marks()
        there = bars.where(C(self.entity).isNotNull() & C(self.time).isNotNull())
        stored = marks.select(C("symbol").alias(self.entity), C("mark").alias(self.time))
        new = lake.newer(there, stored, self.entity, self.time) if n > 1 else there
        prices = [(C(p) if p in bars.columns else F.lit(0.0)).cast("double").alias(p) for p in PRICES]
        rows = new.select(C(self.entity).cast("string").alias("symbol"), C(self.time).cast("date").alias("date"), *prices)
        to = f"{self.path}/data/run={n}"
        if lake.local_path(self.spark, to):
            lake.remove(self.spark, to)  # what a failed run left
            line = F.concat_ws(",", "date", *(F.coalesce(C(p).cast("string"), F.lit("")) for p in PRICES))
            lake.write_lines(rows.select("symbol", line.alias("value")), to, "symbol", "csv", ",".join(("date", *PRICES)), f"{self.path}/files/run={n}", dealt)
        else:
            # a symbol's rows go into one file, those of a symbol with very many into several, which Spark splits by size
            rows.hint("rebalance", "symbol").write.mode("overwrite").option("header", True).partitionBy("symbol").csv(to)
        reached = self.read(n).groupBy("symbol").agg(F.max("date").alias("mark"))
        both = marks.unionByName(reached).groupBy("symbol").agg(F.max("mark").alias("mark"))
        both.write.mode("overwrite").parquet(f"{self.path}/marks/run={n}")
        return n

    def _listed(self, run: int | None) -> DataFrame | None:
        """The files of one run, or of all finished ones, or None where a run has no list of them."""
        at = f"{self.path}/files"
        runs = range(1, self.last_run() + 1) if run is None else [run]
        if not runs or not all(lake.exists(self.spark, f"{at}/run={n}/_SUCCESS") for n in runs):
            return None
        files = self.spark.read.schema("symbol string, file string, bytes long, run int").option("basePath", at).parquet(*(f"{at}/run={n}" for n in runs))
        return files.withColumn("file", F.concat(F.lit("run="), "run", F.lit("/"), "file"))

    def read(self, run: int | None = None) -> DataFrame:
        """The exported rows of one run, or of all finished ones, with the run's number; all columns as written."""
        at, files = f"{self.path}/data", self._listed(run)
        if files is not None:
            part = F.split("value", ",")
            columns = [F.get(part, F.lit(i)).try_cast("double" if i else "date").alias(c) for i, c in enumerate(("date", *PRICES))]
            return lake.read_lines(files, at, header=True).select(*columns, "symbol", "run")
        schema = f"date date, {', '.join(f'{p} double' for p in PRICES)}, symbol string, run int"
        # of one run only its own folders are listed
        with lake.listed_together(self.spark):
            rows = self.spark.read.schema(schema).option("header", True).option("basePath", at).csv(at if run is None else f"{at}/run={run}")
        return rows.where(C("run") == run) if run is not None else rows.where(C("run") <= self.last_run())

    def latest(self) -> DataFrame:
        """The export as a reader sees it: of a day that several runs wrote, the last run's rows."""
        rows = self.read()
        last = rows.groupBy("symbol", "date").agg(F.max("run").alias("run"))
        return rows.join(last, ["symbol", "date", "run"], "left_semi").drop("run")
