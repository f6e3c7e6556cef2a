"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver) and timed separately after a
short warm-up. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hirelens.plans import queries as Q  # noqa: E402
from hirelens.session import get_session  # noqa: E402
from hirelens.sources.tables import SPREAD  # noqa: E402

HEADLINE = [
    "match", "similarity", "resume_skills", "ats_scorecard", "redaction", "bundle",
    "latest_bundle", "llm_requests", "llm_validation", "extract_stats", "page_assembly",
    "part_assembly", "header_redaction", "term_frequency",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # The driver's tables are one row group each, which would be one task.
    spark.conf.set(SPREAD, str(2 * cpus))
    # Warm-up: JVM, parquet readers, Python workers for the one Arrow UDF.
    Q.resume_skills(spark, sf_dir).limit(10).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        df = Q.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
