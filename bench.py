"""Times the headline queries, one JSON line: best of two runs, long ones run once."""

from __future__ import annotations

import json
import os
import time

from riskloom.queries import QUERIES
from riskloom.session import build_session

HEADLINE = [
    "malicious", "long_line", "dangerous_fn", "network", "encoding", "secrets", "entropy",
    "dockerfile", "ignore_anti", "quick_cap", "npm_floor", "pip_floor", "advisory",
    "pages_findings", "file_score", "all_findings", "repo_summary", "top50",
]
RUNS = 2
LONG_SECONDS = 20


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["malicious"](spark, sf_dir).count()  # warm-up: JVM and Python workers
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if times[0] > LONG_SECONDS:
                break
        seconds[name] = round(min(times), 3)
    scanned = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
        "documents_mb_per_sec_all_detectors": round(scanned / 1e6 / seconds["file_score"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
