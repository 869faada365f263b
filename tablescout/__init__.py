"""Table discovery on Spark: profile a lake of tables and rank them by how well they combine."""

from tablescout.operators.normalize import preprocess_profiles, zscore_profiles
from tablescout.plans.lake import Lake, build_lake, list_lakes
from tablescout.plans.profiling import export_profiles, profile, profile_lake
from tablescout.sources.csv_lake import csv_source, discover_csv, read_csv
from tablescout.sources.source import CellSource, TableSource

__all__ = [
    "CellSource",
    "Lake",
    "TableSource",
    "build_lake",
    "csv_source",
    "discover_csv",
    "export_profiles",
    "list_lakes",
    "preprocess_profiles",
    "profile",
    "profile_lake",
    "read_csv",
    "zscore_profiles",
]
