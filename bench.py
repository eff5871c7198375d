"""Headline benchmark: runs registered queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] with a no-op sink and prints one JSON line.

Each query: one warm-up run, then the median of $BENCH_REPEATS timed runs
(default 1).  The value is the sum of the per-query medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sheaf.plans import registry  # noqa: E402
from sheaf.session import get_spark  # noqa: E402

HEADLINE = [
    "line_facts",            # lines classified
    "drawing_numbers",       # context extraction
    "document_report",       # wide lists + report
    "page_text",             # blocks -> pages
    "doc_forms",             # key/value resolution
    "doc_table_grid",        # cells -> dense grids
    "doc_assembly",          # nested documents (block queries derive their input inside the timed run)
    "page_report",           # OCR x shapes
    "file_triage",
    "quota_flags",
    "quota_admission",
    "usage_monthly",
    "job_outcomes",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("sheaf-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = registry.queries()
    times = {}
    for name in names:
        build = qs[name]
        run(build(spark, sf_dir))  # warm-up
        samples = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            run(build(spark, sf_dir))
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
