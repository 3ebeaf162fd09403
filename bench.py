"""Headline timings on one machine. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.operators import audit, redaction
from sparkveil.queries import QUERIES
from sparkveil.queries.detectors import table
from sparkveil.sources.files import INPUT_PARTITIONS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def all_findings(spark: SparkSession) -> DataFrame:
    return audit.count_by(redaction.findings(table(spark, SF_DIR, "documents"), "text", ["source"]), "source", "pi_type")


def all_redacted(spark: SparkSession) -> DataFrame:
    rows = table(spark, SF_DIR, "documents").select("doc_id", "text")
    return redaction.redact_columns(rows, ["text"]).select("doc_id", "text_cleaned")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.session.timeZone", "UTC")
        .config(INPUT_PARTITIONS, CPUS)  # each test table is one small file
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {"all_findings": all_findings, "all_redacted": all_redacted}
    for name in (
        "findings_by_type", "redacted_documents", "audit_report", "phones_by_country", "bank_accounts",
        "overlap_resolution", "dictionary_name_hits", "email_near_number", "redacted_pages", "windowed_metrics",
    ):
        jobs[name] = lambda s, q=QUERIES[name]: q(s, SF_DIR)
    # one untimed pass: class loading and JIT are the start of a JVM, not the query
    all_redacted(spark).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job(spark).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows, chars = table(spark, SF_DIR, "documents").agg(F.count("*"), F.sum(F.length("text"))).first()
    main_run = seconds["all_findings"]
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows_per_second": round(rows / main_run),
                "chars_per_second": round(chars / main_run),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
