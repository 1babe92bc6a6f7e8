"""Time the headline queries; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from popweave.catalog import QUERIES, load_all  # noqa: E402
from popweave.session import local_session  # noqa: E402

HEADLINE = ["ds3_conditioner_ranking", "ag16_multi_margin_counts", "ds5_all_margins", "as3_section_allocation", "as8_hot_deck", "as9_weighted_draw",
            "ip1_two_margins", "ip7_block_raking", "ip7_converged", "jn6_point_in_polygon", "hh6_assembly"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    QUERIES["ag1_composition"](spark, sf_dir).write.format("noop").mode("overwrite").save()     # start-up
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
