"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from limnos.plans import QUERIES  # noqa: E402
from limnos.session import local_session  # noqa: E402

HEADLINES = (
    "water_types_by_group",
    "chm_08_dominant_facies",
    "chm_20_irrigation_indices",
    "chm_24_saturation_indices",
    "geo_03_piper_classic",
    "crs_06_utm_to_geographic",
    "agg_03_compliance",
    "agg_06_column_statistics",
    "agg_09_group_medians",
    "imp_01_group_median",
    "imp_02_global_median",
    "imp_05_principal_components",
    "src_12_canonical_rows",
    "win_01_change_summary",
    "tmp_07_trend_summary",
    "full_analysis",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["water_types_by_group"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
