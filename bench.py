"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from recordmill import get_session
from recordmill.plans.catalog import QUERIES

HEADLINE = [
    "record_lengths",
    "length_histogram",
    "stratified_first_k",
    "credit_sample",
    "longest_first",
    "byte_split",
    "greedy_pack",
    "distinct_first",
    "duplicates_reported",
    "semi_by_name",
    "status_left_join",
    "multiset_classify",
    "carry_forward_last",
    "interval_build",
    "offsets",
    "reassemble",
    "rollup_blocks",
    "fasta_scan",
    "block_file_v1",
    "report_tab_hits",
    "term_counts",
    "boolean_retrieval",
    "broadcast_dim_join",
    "kmer_seed_join",
    "ungapped_hits",
    "search_hits",
    "screen_segments",
    "profile_search",
    "profile_diagonals",
    "chunk_files",
    "report_merge",
    "single_linkage",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    # The folder for intermediate tables; a cluster names one that all executors share.
    scratch = os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="run-")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"), **{"spark.checkpoint.dir": scratch})
    # Start the JVM, the Parquet reader, the Python workers and the Python data
    # source planner before timing.
    QUERIES["record_lengths"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["report_tab_hits"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["block_count"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
