"""Build a lake's catalog once, then search it without touching its tables.

Layout of a lake folder:

    <lake>/lake.json/              one manifest per build, named by its number; the highest one names the current version
    <lake>/<version>/<table>/      Parquet: column_profile, join_cols, table_profile, table_embedding
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.operators.embedding import Encoder, hashing_encoder, nearest, nearest_approx, vector_of
from tablescout.operators.joinability import best_pairs, column_pairs, table_joinability
from tablescout.operators.ranking import rank_all, rank_one
from tablescout.plans.profiling import Profile
from tablescout.sources.csv_lake import csv_source
from tablescout.sources.source import RenamedSource, TableSource

_META_DDL = (
    "name string, description string, n_tables bigint, build_profile_s double, build_embedding_s double,"
    " build_total_s double, skipped array<string>, version string, built_at double, encoder string,"
    " dimensions bigint, skip_reasons array<string>, number bigint"
)

# Told a step, how many of the tables are through it, and how many there are.
Progress = Callable[[str, int, int], None]


def build_lake(
    source, path: str, name: str, description: str = "",
    encoder: Encoder = hashing_encoder, progress: Progress | None = None,
) -> Lake:
    """Q4: profile, sketch and embed every table of `source`, and publish the result under `path`.

    A build writes to a folder of its own and becomes visible when its manifest is put into `lake.json` under the number after
    the one it started from, so readers never see half a lake (S10). If another build has taken that number meanwhile, this one
    is refused with `BuildConflict`, and what it wrote is deleted.
    """
    spark = source.spark
    base = _newest_number(spark, path)
    report = progress or (lambda step, done, total: None)
    version = f"v-{uuid.uuid4().hex}"

    def publish(table: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/{version}/{table}")
        return spark.read.schema(df.schema).parquet(f"{path}/{version}/{table}")

    start = time.perf_counter()
    p = Profile(source, skip_failing=True)
    total = p.columns.select("table_name").distinct().count()
    report("profiling", 0, total)
    p.raw_counts  # noqa: B018  Tables that cannot be read are known from here on.
    p.column_profile = publish("column_profile", p.lazy_column_profile())
    n_tables = p.column_profile.select("table_name").distinct().count()
    if n_tables == 0:
        raise ValueError("A lake needs at least one table with a column that holds values.")
    p.table_profile = publish("table_profile", p.table_profile)
    publish("join_cols", p.join_columns)
    profiled = time.perf_counter()
    report("profiling", n_tables, total)
    report("embedding", 0, n_tables)
    embedded = publish("table_embedding", encoder(p.texts))
    dimensions = embedded.select(F.size("vec")).head()[0]
    report("embedding", n_tables, n_tables)
    done = time.perf_counter()
    empty = p.columns.join(p.table_profile, "table_name", "left_anti").select("table_name").distinct()
    meta = {
        "name": name, "description": description, "n_tables": n_tables,
        "build_profile_s": round(profiled - start, 1),
        "build_embedding_s": round(done - profiled, 1),
        "build_total_s": round(done - start, 1),
        "skipped": sorted([*p.source.skipped, *(r["table_name"] for r in empty.collect())]),
        "skip_reasons": [f"{table}: {why}" for table, why in sorted(getattr(p.source, "reasons", {}).items())],
        "version": version, "built_at": time.time(), "encoder": encoder_name(encoder), "dimensions": dimensions, "number": base + 1,
    }
    try:
        _publish(spark, path, meta)
    except BuildConflict:
        _delete(spark, f"{path}/{version}")
        raise
    return Lake(spark, path)


class BuildConflict(RuntimeError):
    """Another build of the lake was published since this one began."""


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def _newest_number(spark: SparkSession, path: str) -> int:
    """The number of the newest manifest, 0 without any. Names alone tell, not clocks."""
    fs, at = _file_system(spark, f"{path}/lake.json")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)


def _publish(spark: SparkSession, path: str, meta: dict) -> None:
    """Put the manifest under its number, if that number is free."""
    fs, at = _file_system(spark, f"{path}/lake.json/{meta['number']:012d}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if not fs.exists(at):
            raise
        raise BuildConflict(f"Build {meta['number']} of {path} was published by another one.") from e
    try:
        out.write(bytearray((json.dumps(meta) + "\n").encode()))
    finally:
        out.close()


def drop_old_versions(spark: SparkSession, path: str, older_than_s: float) -> list[str]:
    """Delete the builds that are neither the newest nor younger than `older_than_s` seconds; their versions. Searches that began on one of
    them fail from then on."""
    builds = spark.read.schema(_META_DDL).json(f"{path}/lake.json").select("number", "version", "built_at").collect()
    newest = _newest_number(spark, path)
    old = [b for b in builds if b["number"] != newest and b["built_at"] < time.time() - older_than_s]
    for b in old:
        # The manifest goes first, so that no list of lakes shows a build without its tables.
        _delete(spark, f"{path}/lake.json/{b['number']:012d}.json")
        _delete(spark, f"{path}/{b['version']}")
    return sorted(b["version"] for b in old)


def encoder_name(encoder: Encoder) -> str:
    """What the catalog knows an encoder by: its `name`, else the name of its function."""
    return getattr(encoder, "name", None) or getattr(encoder, "__qualname__", type(encoder).__name__)


def list_lakes(spark: SparkSession, folder: str) -> DataFrame:
    """The current metadata of every lake below `folder`, sorted by lake key (its folder name)."""
    builds = spark.read.schema(_META_DDL).json(f"{folder}/*/lake.json").withColumn(
        "lake", F.regexp_extract(F.input_file_name(), "([^/]+)/lake\\.json/[^/]+$", 1)
    )
    newest = builds.groupBy("lake").agg(F.max(F.struct("number", "built_at", "name", "description", "n_tables",
                                                       "build_profile_s", "build_embedding_s",
                                                       "build_total_s", "skipped", "version")).alias("m"))
    return newest.select("lake", "m.*").drop("number").orderBy("lake")


class Lake:
    """A built lake: loaded once, searched many times."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        builds = spark.read.schema(_META_DDL).json(f"{path}/lake.json")
        self.meta = builds.orderBy(F.col("number").desc()).head()
        if self.meta is None:
            raise ValueError(f"There is no lake at {path}")
        self.column_profile = self._read("column_profile")
        self.table_profile = self._read("table_profile")
        self.join_cols = self._read("join_cols").cache()
        self.table_embedding = self._read("table_embedding")
        # A table needs both an embedding and a profile to be a candidate.
        self.fingerprints = (
            self.table_embedding.select("table_name", "vec")
            .join(self.table_profile.select("table_name", "struct_vec"), "table_name").cache()
        )

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.meta['version']}/{table}")

    def unload(self) -> None:
        self.join_cols.unpersist()
        self.fingerprints.unpersist()

    def report(self) -> DataFrame:
        """S15."""
        return self.spark.read.schema(_META_DDL).json(f"{self.path}/lake.json").where(
            F.col("version") == self.meta["version"]
        ).drop("version", "built_at", "encoder", "dimensions", "skip_reasons", "number")

    def vector(self, name: str) -> list[float]:
        """E6."""
        return vector_of(self.table_embedding, name)

    def search_indexed(
        self, query_name: str, top_n: int | None = 10, rerank_pool: int | None = None,
        approximate: bool = False,
    ) -> DataFrame:
        """Q1: rank the lake for one of its own tables."""
        query_vec = self.vector(query_name)
        row = self.fingerprints.where(F.col("table_name") == query_name).select("struct_vec").head()
        if row is None:
            raise KeyError(f"the lake stores no structural vector of {query_name}")
        query_cols = self.join_cols.where(F.col("table_name") == query_name)
        return self._rank(query_name, query_vec, row["struct_vec"], query_cols, top_n, rerank_pool, approximate)

    def search(
        self, query: DataFrame | str, top_n: int | None = 10, query_name: str | None = None,
        rerank_pool: int | None = None, approximate: bool = False, encoder: Encoder = hashing_encoder,
    ) -> DataFrame:
        """Q2: rank the lake for a table it has not seen (a DataFrame or the path of a CSV file)."""
        if isinstance(query, str):
            query_name = query_name or os.path.basename(query)
            source = RenamedSource(csv_source(self.spark, query), query_name)
        else:
            query_name = query_name or "query"
            if not query.columns or query.isEmpty():
                raise ValueError("A query table needs a column and a row.")
            source = TableSource({query_name: query})
        p = Profile(source)
        if encoder_name(encoder) != self.meta["encoder"]:
            raise ValueError(f"The lake was built with {self.meta['encoder']}, not with {encoder_name(encoder)}: their vectors cannot be compared.")
        row = encoder(p.texts).join(p.table_profile, "table_name").select("vec", "struct_vec").head()
        if row is None:
            raise ValueError(f"{query_name} has no column with values.")
        if len(row["vec"]) != self.meta["dimensions"]:
            raise ValueError(f"A vector of {len(row['vec'])} numbers cannot be compared with the lake's {self.meta['dimensions']}.")
        return self._rank(
            query_name, row["vec"], row["struct_vec"], p.join_columns, top_n, rerank_pool, approximate
        )

    def search_all(self, top_n: int = 10) -> DataFrame:
        """Q3: the first `top_n` of every table's ranking, in one job."""
        joinability = table_joinability(best_pairs(column_pairs(self.join_cols, self.join_cols, many_queries=True)))
        return rank_all(self.fingerprints, joinability, top_n)

    def _rank(self, query_name, query_vec, query_struct, query_cols, top_n, rerank_pool, approximate) -> DataFrame:
        candidates, join_cols = self.fingerprints, self.join_cols
        if rerank_pool is not None:
            # The query counts towards the pool and is removed afterwards.
            find = nearest_approx if approximate else nearest
            pool = find(self.table_embedding, query_vec, rerank_pool).select("table_name")
            candidates = candidates.join(pool, "table_name", "left_semi")
            join_cols = join_cols.join(pool, "table_name", "left_semi")
        others = join_cols.where(F.col("table_name") != query_name)
        joinability = table_joinability(best_pairs(column_pairs(query_cols, others)))
        return rank_one(query_name, query_vec, query_struct, candidates, joinability, top_n)


def export_ranking(ranking: DataFrame, path: str) -> None:
    """A ranking as CSV with a header (a folder of part files)."""
    ranking.write.mode("overwrite").option("header", True).csv(path)
