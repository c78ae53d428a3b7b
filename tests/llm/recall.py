"""Recall of the registered op1 query against brute force: python tests/llm/recall.py FOLDER..."""

import sys
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from tidepanel.llm.queries import op1_balanced_posting_lists  # noqa: E402

if __name__ == "__main__":
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", folder).getOrCreate()
    for d in sys.argv[1:]:
        rows = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null").collect()
        rows = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
        ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
        found: dict[int, list[float]] = {}
        for r in op1_balanced_posting_lists(spark, d).collect():
            found.setdefault(r.query_id, []).append(r.score)
        hit = total = 0
        for i in np.flatnonzero(ids % 20 == 0):
            s = x @ x[i]
            s[ids == ids[i]] = -np.inf
            least = np.sort(s)[-20]
            got = np.array(found.get(int(ids[i]), []))
            hit, total = hit + int((got >= least - 1e-9).sum()), total + 20
        print(d, "queries", total // 20, "recall", round(hit / total, 4), flush=True)
