"""Print the physical plan of registered queries.

    python scripts/explain.py serve [vote_quorum_1 ...] [--sf DIR] [--formatted]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    mode = "formatted" if "--formatted" in args else "simple"
    names = [a for a in args if not a.startswith("--")] or ["serve"]
    from quorum.plans.catalog import QUERIES
    from quorum.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    for n in names:
        print(f"== {n} ==")
        QUERIES[n](spark, sf).explain(mode)


if __name__ == "__main__":
    main()
