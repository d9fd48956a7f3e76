"""Times the headline queries: one warm-up run and the median of three, written to a no-op sink. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(":"))]))

#: A query that takes longer, in seconds, is measured once after its warm-up run.
LONG = 4.0
HEADLINE = ("prof_table", "chunk_fixed", "chunk_score", "vec_topk", "kw_search", "hybrid_chunks", "rule_transitive", "clean_pipeline", "shapes_validate")


def main() -> None:
    from pyspark.sql import SparkSession

    from strataloom import registry

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in registry.QUERIES if n.startswith(("r_", "m_")) and n in registry.ORACLES] + [n for n in HEADLINE if n in registry.QUERIES]
    took = {}
    for name in names:
        runs = []
        while len(runs) < 4:
            begun = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
            if len(runs) > 1 and runs[-1] > LONG:
                break
        took[name] = round(statistics.median(runs[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
