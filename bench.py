"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "label_counts",
    "normalize_posts",
    "normalize_nicknames",
    "classify_posts",
    "classify_joined_lexicon",
    "window_counts",
    "tag_inventory",
    "label_catalogues",
    "lexicon_lookup",
    "activity_sessions",
    "live_keys",
]


def main() -> None:
    from postweave.plans import all_queries
    from postweave.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    registered = all_queries()
    names = sys.argv[1:] or HEADLINE
    # One query first, untimed, so that no timing holds the start of the session.
    registered[names[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        df = registered[name].run(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
