"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "h1_a7_bm25_top5",
    "h2_j7_vector_top5",
    "h4_h3_t1_hybrid_top5",
    "a5_a23_term_statistics",
    "a2_j5_document_label",
    "x1_x2_x4_split_clauses",
    "x10_chunks",
    "r3_j3_prefilter",
    "w7_a22_corpus_dedup",
    "x26_parse_responses",
    "j11_so3_attach_verdicts",
    "a13_risk_distribution",
    "a14_w10_risk_shares",
    "a15_aggregate_references",
    "t4_a19_risky_summary",
    "s13_w9_st2_overrides",
    "s16_revised_lines",
    "h7_evaluation",
]

WARM_UP = ["h4_h3_t1_hybrid_top5", "j11_so3_attach_verdicts", "a15_aggregate_references", "w7_a22_corpus_dedup"]


def main() -> None:
    from clausewise.session import get_spark
    from queries import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(),
    }
    spark = get_spark("clausewise-bench", f"local[{cpus}]", conf)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    # session start and class loading are not part of a query: one pass over the smallest tables
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in WARM_UP:
            REGISTRY[name][0](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result, ensure_ascii=False))
    spark.stop()


if __name__ == "__main__":
    main()
