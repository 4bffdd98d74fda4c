"""Headline queries timed on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

Every query runs from the given tables to a full materialisation (``noop`` sink), after one warm-up
run of the flagship on the smallest tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberfield.plans import CATALOG  # noqa: E402
from emberfield.session import local_session  # noqa: E402

HEADLINE = [
    "frame_statistics",
    "scene_robust_statistics",
    "box_sums",
    "evidence_layers",
    "finding_register",
    "roi_statistics",
    "media_pairs",
    "observation_clusters",
    "canonical_findings",
    "inspection_comparison",
    "mosaic",
    "quality_gate",
    "rendered_ironbow",
    "inspection_run_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf_dir
    CATALOG["finding_register"][0](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_wall",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
