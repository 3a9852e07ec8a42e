"""Headline timings: one JSON line.

    BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default: all)

Every query is run to its last row into a sink that discards it. ``rates`` gives rows or lines
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vecgrid.functions.features import SMILES_PATTERNS  # noqa: E402
from vecgrid.plans.jobs import vectors_job  # noqa: E402
from vecgrid.plans.queries import QUERIES, smiles_of, table  # noqa: E402
from vecgrid.session import scratch_path, spread  # noqa: E402
from vecgrid.sources.readers import read_strings  # noqa: E402

HEADLINE = [
    "scan_columns", "tail_count", "chunk_plan_orders", "chunk_id_orders", "union_files",
    "featurize_with_descriptors", "descriptors_parts", "quarantine_smiles", "count_profile_docs", "hashed_bits_docs", "dense_bits_docs", "minhash_docs",
    "moments_embeddings", "pca_project", "pca_grid", "vectors_job",
    "edges_price", "edges_by_flag", "edges_sorted", "kll_profile", "percentile_profile", "iqr_fence", "iqr_filter",
    "bins_price", "grid_lineitem", "grid_lineitem_sketch", "create_clusters", "representatives", "select_cell",
    "knn_docs", "knn_coords", "spanning_forest_docs", "category_codes",
    "sink_grid", "pending_chunks", "stream_project", "stream_sketch", "stream_assign",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "16" if cpus == "*" else str(2 * int(cpus)))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times: dict[str, float] = {}
    rates: dict[str, int] = {}
    drain(QUERIES["grid_customer"](spark, sf))  # start-up, not timed
    drain(QUERIES["minhash_docs"](spark, sf.replace("sf0.1", "sf0.01")))

    for name in HEADLINE:
        if not only or name in only:
            times[name] = timed(lambda name=name: drain(QUERIES[name](spark, sf)))

    if not only or "text" in only:
        lines = table(spark, sf, "lineitem").select(smiles_of("l_orderkey"), "l_partkey", "l_shipdate")
        n = lines.count()
        for name, codec in (("read_plain_text", "none"), ("read_bz2_text", "bzip2")):
            path = scratch_path(spark, name)
            spread(lines, 16).write.options(sep="\t", compression=codec).csv(path)
            times[name] = timed(lambda path=path: drain(read_strings(spark, path, fmt="tsv", header=False)))
            rates[f"{name}_lines_per_s"] = int(n / times[name])

    if not only or "end_to_end" in only:
        # strings -> 27 counts -> PCA fit -> coordinates written, as in the published run
        strings = spread(table(spark, sf, "lineitem").select(smiles_of("l_orderkey").alias("smiles")), 16)

        def end_to_end() -> None:
            coords, _ = vectors_job(strings, len(SMILES_PATTERNS))
            coords.write.parquet(scratch_path(spark, "coords"))

        times["strings_to_coordinates"] = timed(end_to_end)
        rates["strings_to_coordinates_rows_per_s"] = int(strings.agg(F.count("*")).first()[0] / times["strings_to_coordinates"])

    out = {
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rates": rates,
        "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
