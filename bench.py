"""Run the headline queries and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from colloquy.plans import catalog, inputs  # noqa: E402

HEADLINES = ["clean", "remove_fillers", "normalize_numbers", "chunk_text", "assign_speaker", "coalesce_turns",
             "labeled_transcript", "apply_exact", "scan_variants", "scan_phonetic", "coverage_report",
             "fact_check_report", "check_citations", "merge_blocks", "parse_model_result", "render_minutes",
             "run_summary"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-ckpt-"))
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    # Start the session's machinery outside the measurement.
    queries["size_tier"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    chars = inputs.transcripts(spark, sf_dir).selectExpr("sum(length(text))").head()[0]
    segments = inputs.segments(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name, "cpus": int(cpus),
        "rates": {"clean_chars_per_sec": round(chars / times["clean"]),
                  "coverage_chars_per_sec": round(chars / times["coverage_report"]),
                  "assign_segments_per_sec": round(segments / times["assign_speaker"])}}))
    spark.stop()


if __name__ == "__main__":
    main()
