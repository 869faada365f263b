"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession


# Tables that CSV can hold, by how many files each is dealt into: about as many as the smaller published lake has.
CSV_PARTS = {
    "customer": 12, "supplier": 6, "part": 12, "orders": 14, "lineitem": 16, "events": 14, "documents": 14, "pages": 10, "benchmark": 4,
    "labels": 8, "conversations": 10, "orders_filled": 14, "orders_urgent": 12, "part_sku": 8, "supplier_nation": 6,
}


def many_csv_files(spark: SparkSession, tables: dict, folder: str) -> tuple[str, int]:
    """A folder of many CSV files made of the given tables, and their number."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/lake"))
    n = 0
    for name, parts in CSV_PARTS.items():
        df = tables[name]
        # Files of one table share some keys and differ in others.
        df.repartition(parts, df.columns[-1], df.columns[0]).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
        for f in fs.listStatus(path(f"{folder}/{name}")):
            if f.getPath().getName().endswith(".csv"):
                fs.rename(f.getPath(), path(f"{folder}/lake/{name}_{n:03d}.csv"))
                n += 1
    return f"{folder}/lake", n


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tablescout-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture costs more than planning itself for plans made of many small expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from tablescout import TableSource, build_lake, csv_source
    from tablescout.plans.profiling import Profile
    from tablescout.plans.registry import lake, new_lake
    from tablescout.plans.testlake import lake_tables

    from tablescout.workspace import cleanup, new_dir

    timings: dict[str, float] = {}

    def timed(name: str, run):
        start = time.perf_counter()
        result = run()
        timings[name] = round(time.perf_counter() - start, 3)
        return result

    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        # One build and one search on the smallest data, so that no timing contains JVM start-up.
        lake(spark, small).search_all().collect()

    timed("value_counts", lambda: Profile(TableSource(lake_tables(spark, sf_dir))).raw_counts)
    timed("column_profile", lambda: Profile(TableSource(lake_tables(spark, sf_dir))).column_profile)
    built = timed("build_lake", lambda: new_lake(spark, sf_dir))
    timed("search_indexed", lambda: built.search_indexed("customer", top_n=None).collect())
    timed("search_pool", lambda: built.search_indexed("customer", rerank_pool=8).collect())
    timed("search_external", lambda: built.search(lake_tables(spark, sf_dir)["orders_urgent"]).collect())
    timed("search_all", lambda: built.search_all(top_n=10).collect())

    folder, n_files = many_csv_files(spark, lake_tables(spark, sf_dir), new_dir(spark, "bench-csv"))
    csv_lake = timed("build_csv_lake", lambda: build_lake(csv_source(spark, folder), new_dir(spark, "csv-lake") + "/lake", "files"))
    timed("search_csv_lake", lambda: csv_lake.search_all(top_n=10).collect())

    n_tables = built.meta["n_tables"]
    print(json.dumps({
        "metric": "table discovery: profile, build, search",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "n_tables": n_tables,
        "build_sec_per_table": round(timings["build_lake"] / n_tables, 3),
        "n_csv_files": n_files,
        "csv_build_sec_per_table": round(timings["build_csv_lake"] / n_files, 3),
    }))
    cleanup(spark)
    spark.stop()


if __name__ == "__main__":
    main()
