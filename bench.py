"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local cores. Every query runs
once unmeasured and once measured, its whole result written to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatloom.plans import QUERIES  # noqa: E402

HEADLINE = (
    "c3_pair_lines",
    "e1_from_txt",
    "e1_from_txt_files",
    "e2_from_messages_jsonl",
    "e3_from_sharegpt",
    "e4_from_alpaca",
    "e6_from_catalog",
    "e8_import_chatml",
    "f1_render_training_text",
    "f1_render_turns",
    "g1_split_records",
    "h2_attach_predictions",
    "h6_token_f1",
    "h8_rouge_l",
    "h10_eval_summary",
    "i4_normalize_request",
    "i6_parse_responses",
    "i7_assemble_chunks",
    "j4_parse_prompt_list",
    "k3_license_from_text",
    "k5_classify_license",
    "k7_redact_literal",
    "l1_audit_snapshots",
    "m2_assemble_chunk_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chatloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        for measured in (False, True):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if measured:
                seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
