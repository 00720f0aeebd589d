"""python tests/run_oracle.py [name-prefix ...]: check registered queries, print time per query."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from oracle import compare, connect

folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
         .config("spark.driver.host", "127.0.0.1").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
queries, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in queries.items():
    if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
        continue
    start = time.time()
    try:
        if name in sqls:
            problem = compare(spark, con, name, fn, sqls[name], folder)
        else:
            problem = None if fn(spark, folder).count() else "no rows"
    except Exception:
        problem = traceback.format_exc()[-900:]
    spark.catalog.clearCache()
    bad += problem is not None
    print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s"
          + ("" if name in sqls else " (rows only)") + (f"\n   {problem}" if problem else ""), flush=True)
print("bad:", bad)
