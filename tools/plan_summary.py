"""Physical-plan summary of every query of the library itself (operator counts) → PLANS.md.

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Eager steps of a query (written id tables, vocabularies) run while its plan
is built; the counts below are for the final plan only.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobinPartitioning",
       "Exchange SinglePartition", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
       "HashAggregate", "WindowGroupLimit", "Window ", "Generate", "ArrowEvalPython", "MapInPandas", "FileScan"]
DETAIL = ["scored_articles", "page_main_text", "new_urls_indexed", "encode_prompts", "sentence_boundaries"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from lisible.session import build_session
    from lisible.plans.registry import all_queries
    spark = build_session("local[8]", 8, extra={"spark.driver.memory": "16g", "spark.lisible.input.partitions": "8"})
    qs = all_queries()
    print("# Physical plans\n")
    print(f"Operator counts in the executed plan of each registered query (`{sf_dir}`, AQE on, before run-time re-planning; identical exchanges and subqueries are counted each time they appear, although Spark reuses them at run time).\n")
    print("| query | " + " | ".join(o.strip().replace("Exchange ", "X ") for o in OPS) + " |")
    print("|---|" + "---|" * len(OPS))
    details = {}
    for name in qs:
        df = qs[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(re.escape(o), plan)) for o in OPS]
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + " |")
        if name in DETAIL:
            details[name] = df._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for name, text in details.items():
        head = text.split("\n\n(1)")[0]
        print(f"\n## {name}\n\n```\n{head.strip()}\n```")


if __name__ == "__main__":
    main()
