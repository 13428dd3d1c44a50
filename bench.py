"""Time the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom.catalog import QUERIES  # noqa: E402
from docloom.session import build_session  # noqa: E402

HEADLINE = [
    "ingest_report", "src1_table_scan", "src4_html_text", "fil1_filter_grammar", "ord2_page_with_total",
    "win1_rank_per_group", "win2_latest_per_key", "joi1_child_counts", "joi5_insert_if_absent", "agg3_project_stats",
    "agg4_dedup_ratio", "agg10_histogram", "set1_dedupe_first", "set5_classify_documents", "set6_dedup_chunks",
    "str7_redact", "str10_mask_pii", "hsh1_fingerprints", "chk1_fixed", "chk2_sentence", "chk3_paragraph",
    "semantic_chunker", "pip1_quality_gate", "pip2_choose_extraction", "pip3_dedup_enrich_link", "pip4_reconcile_tables",
    "pip10_extract_many", "vec1_embed", "vec3_topk_cosine", "vec5_kmeans", "set4_fanout", "ord4_rank_hybrid",
    "stm2_latest_snapshot", "stm3_upload_rate_limit", "stm5_sliding_rates", "stm6_sustained_alerts", "stm7_idempotency",
    "stm11_active_runs",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in HEADLINE if len(sys.argv) < 2 or any(p in n for p in sys.argv[1:])]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(base.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
