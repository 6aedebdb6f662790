"""`python tests/check.py SF [name ...]`: compare queries with their SQL and print timings."""

import sys
import tempfile
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

import compare  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

sf, wanted = sys.argv[1], sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-")).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
con = compare.duck(sf_dir)
queries, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in queries.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in sqls:
            diff = compare.difference(df, con, sqls[name])
            rows = len(df.collect()) if diff else ""
            verdict = "ok" if diff is None else f"DIFF {diff}"
        else:
            verdict = f"rows {df.count()} (no SQL)"
    except Exception as e:
        verdict = "ERROR " + str(e).split("JVM stacktrace")[0][:900]
        if "-v" in wanted:
            traceback.print_exc()
    bad += verdict.startswith(("DIFF", "ERROR"))
    print(f"{name:28s} {time.time() - t0:6.2f}s {verdict}", flush=True)
print("bad", bad)
