"""Summarise the physical plan of every registered query (writes PLANS.md).

For each batch query of the incident engine: shuffles (Exchange), join
strategies, aggregates by kind, windows, generators, and what each Parquet
scan reads and pushes down.  Streaming queries (which run when they are
built) are left out.
Usage: python scripts/plans.py [sf_dir] > PLANS.md
"""
import contextlib
import io
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridwatch.plans import catalog  # noqa: E402
from gridwatch.session import build_session  # noqa: E402


def summarise(plan: str) -> dict:
    ops = {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "joins": sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan))),
        "aggregates": ", ".join(f"{n} {k.lower()}" for k, n in sorted(Counter(
            re.findall(r"(?<![A-Za-z])(Hash|Sort|ObjectHash)Aggregate\(keys?=", plan)).items())) or "-",
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "generators": len(re.findall(r"\bGenerate ", plan)),
    }
    scans = []
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\](.*?)Location: [^\[]*\[([^\]]*)\](.*?)ReadSchema: (struct<[^\n]*)", plan, re.S):
        cols, pre, loc, mid, schema = m.groups()
        mid = pre + mid
        table = loc.rstrip("/").split("/")[-1].replace(".parquet", "")
        pushed = re.search(r"PushedFilters: \[([^\]\n]*)", mid)
        part = re.search(r"PartitionFilters: \[([^\]\n]*)", mid)
        scans.append((table, cols.count(",") + 1 if cols else 0,
                      (pushed.group(1) if pushed else "")[:120], (part.group(1) if part else "")[:80]))
    ops["scans"] = scans
    return ops


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 16, extra={"spark.ui.showConsoleProgress": "false"})
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plans.py` at `{sf}` (static plan before AQE; AQE may still turn a")
    print("sort-merge join into a broadcast join after measuring a side).\n")
    print("| query | shuffles | broadcasts | joins | aggs | windows | explode | parquet scans (table: cols read; pushed / partition filters) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in catalog.registry().items():
        if name.startswith("stream_"):
            continue
        df = fn(spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="simple")
        s = summarise(buf.getvalue())
        scans = "; ".join(f"{t}: {n} cols" + (f", pushed [{p}]" if p else "") + (f", partitions [{q}]" if q else "")
                          for t, n, p, q in s["scans"])
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {', '.join(s['joins']) or '-'} | "
              f"{s['aggregates']} | {s['windows']} | {s['generators']} | {scans.replace('|', '/')} |")
    spark.stop()


if __name__ == "__main__":
    main()
