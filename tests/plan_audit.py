"""python tests/plan_audit.py [sf_dir] [query ...]: scans and exchanges of the executed plans."""

import re
import sys

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from session import session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def final_plan(df) -> str:
    """The plan as it was run, including subqueries, without the initial plans."""
    df.collect()
    kept, skip_below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(re.match(r"[\s:|+-]*", line).group())
        if skip_below is not None and depth > skip_below:
            continue
        skip_below = None
        if "== Initial Plan ==" in line:
            skip_below = depth - 1
            continue
        kept.append(line)
    return "\n".join(kept)


def audit(df) -> dict:
    final = final_plan(df)
    scans = {}
    for table in re.findall(r"FileScan parquet .*?(?:/(\w+)\.parquet|tidemark/(\w+)-)", final):
        name = next(filter(None, table))
        scans[name] = scans.get(name, 0) + 1
    count = lambda word: len(re.findall(word, final))
    return {
        "scans": scans,
        "exchanges": count(r"- Exchange (?:hash|range|Single|Round)"),
        "reused": count("ReusedExchange"),
        "single": count("Exchange SinglePartition"),
        "nested_loop": count("NestedLoopJoin|CartesianProduct"),
        "smj": count("SortMergeJoin"),
    }


if __name__ == "__main__":
    spark = session()
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    for name, run in entry.queries().items():
        if not sys.argv[2:] or name in sys.argv[2:]:
            print(f"{name:26s}", audit(run(spark, directory)), flush=True)
