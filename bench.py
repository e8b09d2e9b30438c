"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed once, after one that starts the engine; results go to Spark's noop sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from boxframe import catalog  # noqa: E402

HEADLINE = ("text_bboxes", "text_pages", "stream_tumbling", "aggregate_grouped", "join_nearest", "html_bboxes", "bboxes_json", "report_cells", "pass1_types", "table_regions", "treemap_paths")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("text_pages")  # starts the engine
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    cells = catalog.QUERIES["report_cells"](spark, folder).count()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "cells": cells, "cells_per_second": round(cells / times["report_cells"]), "chain_cells_per_second": round(cells / times["treemap_paths"])}))


if __name__ == "__main__":
    main()
