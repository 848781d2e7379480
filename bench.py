"""Times the headline queries once warm and prints one JSON line.

BENCH_SF_DIR names the tables (default: scale 0.1) and BENCH_CPUS the local cores. Every query
runs once untimed, so that code generation and file listing are not measured, then once timed
into Spark's no-op sink, which computes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import time

from tarn.plans import registry
from tarn.session import build_session

HEADLINE = (
    "normalise_text", "chunk_windows", "chunk_pages_range_join", "bm25_topk", "dense_topk", "rrf_fuse", "passage_locate_exact", "recall_any_by_kind",
    "clean_answer", "cell_medians", "joules_per_correct", "energy_form_choice", "kappa_bootstrap", "stratified_sample", "resume_anti_join", "star_join",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    found, seconds = registry.queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
