"""Plan facts per query: scans of the large tables, exchanges, reused exchanges, windows without keys, Python nodes."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from indicatrix import catalog  # noqa: E402
from indicatrix.session import build_session  # noqa: E402


def keyless_windows(plan: str) -> int:
    """Windows over everything: Spark prints a window's expressions, its keys and its order, and leaves out the keys where there are none."""
    found = 0
    for line in plan.splitlines():
        if start := re.search(r"\bWindow \[", line):
            groups, depth = 0, 0
            for c in line[start.end() - 1:]:
                depth += (c == "[") - (c == "]")
                groups += c == "[" and depth == 1
            found += groups < 3
    return found


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = build_session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                                  "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, query in catalog.queries().items():
        if wanted and name not in wanted:
            continue
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        big = {t: len(re.findall(rf"FileScan parquet \[[^\n]*/{t}.parquet", plan)) for t in ("lineitem", "orders", "customer", "events")}
        facts = {
            "scans": {k: v for k, v in big.items() if v}, "exchanges": plan.count("Exchange hashpartitioning"), "reused": plan.count("ReusedExchange"),
            "single": plan.count("Exchange SinglePartition"), "keyless_window": keyless_windows(plan),
            "bnlj": plan.count("BroadcastNestedLoopJoin"), "cartesian": plan.count("CartesianProduct"),
            "python": len(re.findall(r"ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|BatchEvalPython", plan)), "rdd": plan.count("ExistingRDD"),
        }
        print(name, {k: v for k, v in facts.items() if v}, flush=True)


if __name__ == "__main__":
    main()
