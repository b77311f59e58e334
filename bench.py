"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds (median of three after a warm-up)."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from tagweave.plans import catalogue

HEADLINE = [
    "html_token_counts", "html_end_tags", "html_start_tags_by_name", "html_links", "css_grammar_counts", "js_calls_from_pages", "js_scope_uses_from_pages", "json_events_from_props", "json_number_values",
    "xml_tokens_from_parts", "css_units_from_parts", "collapse_ws", "ascii_lower", "encode_url", "read_float", "append_decimal", "append_number", "replace_entities", "bin_round_trip", "rollup_tags", "events_per_hour",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    html_mb = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("sum(octet_length(html)) / 1e6").first()[0]
    tokens = catalogue.page_tokens(spark, sf_dir, "token_type").count()
    rate = {"html_mb_per_s": round(html_mb / seconds["html_token_counts"], 1), "html_tokens_per_s": round(tokens / seconds["html_token_counts"])}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), **rate}))
    spark.stop()


if __name__ == "__main__":
    main()
