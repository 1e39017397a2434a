"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pathmine.plans.registry import QUERIES  # noqa: E402
from pathmine.session import ensure_checkpoint_dir, local_session, release_persisted  # noqa: E402

#: The last three read the dataset that path_dataset wrote earlier in the session; COLD is timed with nothing written.
HEADLINE = ["ast_paths", "cfg_paths", "cdg_paths", "ddg_paths", "path_dataset", "format_dataset", "token_freq", "path_freq"]
COLD = ["format_dataset"]


def timed(spark, name: str, sf_dir: str) -> float:
    t = time.time()
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()  # computes every column, unlike count()
    took = round(time.time() - t, 3)
    release_persisted()
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, partitions=int(cpus) * 2, app="pathmine-bench")
    spark.range(1).count()
    times = {name: timed(spark, name, sf_dir) for name in HEADLINE}
    warm_dir = ensure_checkpoint_dir(spark)
    cold = {}
    for name in COLD:
        spark.sparkContext.setCheckpointDir(f"{warm_dir}/cold-{name}")
        cold[name] = timed(spark, name, sf_dir)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "sf": sf}))


if __name__ == "__main__":
    main()
