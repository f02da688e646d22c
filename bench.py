"""Benchmark: run every registered query on $BENCH_SF_DIR and time it.

Each query is forced to completion with the ``noop`` sink (full evaluation,
nothing collected to the driver). Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketweave.registry import QUERIES  # noqa: E402
from marketweave.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = get_spark("marketweave-bench", master=f"local[{cpus}]",
                      shuffle_partitions=int(cpus) * 2,
                      extra_conf={"spark.driver.memory": "16g",
                                  "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                  "spark.local.dir": os.path.join(scratch, "local")})
    # warm-up (JVM JIT, code generation, Python workers) on the smallest data
    # set; not timed.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("holiday_sales_summary", "smart_stock", "feature_table"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
