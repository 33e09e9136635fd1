"""Summarise the physical plans of registered queries (before execution).

usage: python scripts/plan_summary.py [sf_dir] [name ...]
Counts shuffles, join strategies, generators, Python stages and scans, and
prints each scan's read schema and pushed filters.
"""

import re
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from codesift.plans.registry import QUERIES  # noqa: E402
from codesift.session import local_session  # noqa: E402

NODES = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
         "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "Generate", "MapInPandas", "InMemoryTableScan", "FileScan", "TakeOrderedAndProject", "Window"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan, no AQE re-planning
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    print("| query | " + " | ".join(n.split()[0] if n.startswith("Exchange") and n != "Exchange hashpartitioning"
                                     else n for n in NODES) + " |")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(re.escape(n), plan)) for n in NODES]
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + " |")
        for scan in re.findall(r"FileScan parquet [^\n]*", plan):
            loc = re.search(r"Location: [^\[]*\[([^\]]*)\]", scan)
            schema = re.search(r"ReadSchema: (struct<[^>]*>)", scan)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", scan)
            print(f"|   scan | {loc.group(1).rsplit('/', 1)[-1] if loc else '?'} | "
                  f"{schema.group(1) if schema else ''} | {pushed.group(1) if pushed else ''} |")


if __name__ == "__main__":
    main()
