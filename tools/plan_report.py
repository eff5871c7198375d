"""Write PLANS.md: per registered query, the shape of its physical plan
(exchanges, scans, pushed filters, read schemas) from .explain("formatted").

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sheaf.plans import registry  # noqa: E402
from sheaf.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("plan-report", master="local[8]", shuffle_partitions=16,
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# Physical plans of the registered queries", "",
           f"Generated by `tools/plan_report.py` on `{os.path.basename(sf_dir)}` (initial adaptive plans; AQE may",
           "coalesce partitions, reuse stages or switch a join to broadcast from measured sizes at run time).", "",
           "| Query | Exchanges | Scans | Broadcast exchanges | Window | Sort-merge joins | Python |",
           "| --- | --- | --- | --- | --- | --- | --- |"]
    details = []
    for name, build in registry.queries().items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            build(spark, sf_dir).explain("formatted")
        plan = buf.getvalue()
        count = lambda pat: len(re.findall(pat, plan))
        py = count(r"\n\(\d+\) (?:FlatMapGroupsInPandas|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandasWithState)")
        out.append(f"| `{name}` | {count(r'\n\(\d+\) Exchange')} | {count(r'\n\(\d+\) Scan ')} | "
                   f"{count(r'\n\(\d+\) BroadcastExchange')} | {count(r'\n\(\d+\) Window')} | "
                   f"{count(r'\n\(\d+\) SortMergeJoin')} | {py} |")
        scans = sorted({ln.strip() for ln in plan.splitlines()
                        if ln.startswith(("PushedFilters", "ReadSchema"))})
        details += [f"### `{name}`", ""] + [f"    {s[:240]}" for s in scans] + [""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"),
              "w") as fh:
        fh.write("\n".join(out + ["", "## Scans", ""] + details) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
