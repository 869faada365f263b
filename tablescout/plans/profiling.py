"""Q5, Q6: profile jobs."""

from __future__ import annotations

from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators import counts as c
from tablescout.operators import profile as p
from tablescout.operators.normalize import preprocess_profiles, zscore_profiles
from tablescout.operators.sketch import eligible_counts, join_columns, minhash
from tablescout.operators.summary import executive_summary, named_text_columns, table_sample, table_text
from tablescout.operators.table_profile import table_profile
from tablescout.workspace import materialize


class Profile:
    """Everything derived from one source. The source is scanned once for the value counts (and once
    more for its sample rows and the full text of long values that are shown).

    A table that cannot be read is an error. Only where the caller tells of the tables that are left out, as a lake does, may they
    be skipped (`skip_failing`).
    """

    def __init__(self, source, skip_failing: bool = False) -> None:
        self.source = source
        self.skip_failing = skip_failing

    @cached_property
    def columns(self) -> DataFrame:
        return self.source.columns()

    @cached_property
    def raw_counts(self) -> DataFrame:
        """Counted once. If the scan fails and tables may be skipped (S11), each that fails by itself is, and the others are counted again."""
        try:
            return self._counted()
        except (PySparkException, Py4JJavaError):
            failed = self.source.failing() if self.skip_failing and hasattr(self.source, "failing") else {}
            if not failed or len(failed) == len(self.source.tables):
                raise
            self.source = self.source.without(failed)
            self.__dict__.pop("columns", None)
            return self._counted()

    def _counted(self) -> DataFrame:
        return c.from_store(materialize(c.to_store(self.source.raw_counts()), "raw_counts"))

    @cached_property
    def counts(self) -> DataFrame:
        return c.profile_counts(self.raw_counts)

    @cached_property
    def summary_counts(self) -> DataFrame:
        return c.summary_counts(self.raw_counts)

    @cached_property
    def picks(self) -> DataFrame:
        return p.picked_values(self.counts, self.source, cleaned=True)

    @cached_property
    def column_profile(self) -> DataFrame:
        """One row per profiled column, written once: every later step starts from it."""
        return materialize(self.lazy_column_profile(), "column_profile")

    def lazy_column_profile(self) -> DataFrame:
        return p.assemble_profile(
            self.columns,
            p.column_metrics(self.counts),
            p.picks_per_column(self.picks),
            p.text_metrics(self.summary_counts),
        )

    @cached_property
    def table_profile(self) -> DataFrame:
        return table_profile(self.column_profile)

    @cached_property
    def join_columns(self) -> DataFrame:
        return join_columns(
            self.column_profile, minhash(eligible_counts(self.column_profile, self.raw_counts))
        )

    @cached_property
    def samples(self) -> DataFrame:
        return table_sample(self.columns, self.source.sample_rows())

    @cached_property
    def summaries(self) -> DataFrame:
        named = named_text_columns(self.columns)
        shown = self.summary_counts.join(named, c.COLUMN_KEY, "left_semi")
        top = p.top_values(p.picked_values(shown, self.source, cleaned=False, boundaries=False))
        return executive_summary(
            self.columns, top,
            self.column_profile.select("column_id", "val_len_min", "val_len_max", "text_entropy"),
            self.table_profile,
        )

    @cached_property
    def texts(self) -> DataFrame:
        return table_text(self.summaries, self.samples)


def profile(source) -> Profile:
    """Q5: profile the tables of a source."""
    return Profile(source)


def profile_lake(source) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q6: raw, z-scored (6 decimals) and typed profiles; the typed ones are of the z-scored values."""
    raw = Profile(source).column_profile
    if raw.isEmpty():
        raise ValueError("The source has no column with values.")
    z = zscore_profiles(raw)
    rounded = z.withColumns({
        name: F.round(name, 6) for name, kind in z.dtypes if kind == "double"
    })
    return raw, rounded, preprocess_profiles(z)


def export_profiles(source, path: str) -> None:
    """The three kinds of profiles as Parquet tables below `path`."""
    raw, z, typed = profile_lake(source)
    for name, df in (("profiles", raw), ("profiles_normalized", z), ("profiles_typed", typed)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
