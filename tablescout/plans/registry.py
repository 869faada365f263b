"""The registered queries and, where DuckDB can state it, the SQL of their expected results.

All run over one lake (see `testlake`). Its profile and its catalog are built by Spark the first time a
query of a session needs them and reused by the rest, as a lake is built once and searched many times.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.scores import (
    ROLES,
    cardinality_bucket,
    cosine,
    length_bucket,
    length_compat,
    vector_literal,
)
from tablescout.functions.text import clean_value, integer_or, name_tokens, normalise_value, number_or, soundex, type_class
from tablescout.operators import profile as p
from tablescout.operators.embedding import token_weights
from tablescout.operators.joinability import best_pairs, column_pairs, table_joinability
from tablescout.operators.normalize import preprocess_profiles, zscore_profiles
from tablescout.operators.sketch import minhash, sketch_index
from tablescout.operators.table_profile import macro_means, row_count_recovery, type_fractions
from tablescout.operators.vector_index import VectorIndex, nearest_each
from tablescout.plans.lake import Lake, build_lake, export_ranking, list_lakes
from tablescout.plans.oracles import _ROLES, _Z, OCTILES, with_ctes
from tablescout.plans.profiling import Profile, export_profiles
from tablescout.plans.testlake import lake_tables
from tablescout.sources.csv_lake import csv_source, infer_types, read_csv
from tablescout.sources.source import TableSource, parquet_source
from tablescout.workspace import new_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_profiles: dict[tuple[str, str], Profile] = {}
_lakes: dict[tuple[str, str], Lake] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = with_ctes(oracle)
        return fn

    return register


def lake_profile(spark: SparkSession, sf_dir: str) -> Profile:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _profiles:
        _profiles[key] = Profile(TableSource(lake_tables(spark, sf_dir)))
    return _profiles[key]


def new_lake(spark: SparkSession, sf_dir: str) -> Lake:
    source = TableSource(lake_tables(spark, sf_dir))
    return build_lake(source, new_dir(spark, "lake") + "/tables", "Test lake", "Given tables and views of them.")


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        _lakes[key] = new_lake(spark, sf_dir)
    return _lakes[key]


def named(prof: Profile, df: DataFrame) -> DataFrame:
    """Per-column results with the names of table and column in place of the column's number."""
    return prof.columns.select("column_id", "table_name", "column_name").join(df, "column_id").drop("column_id")


def real(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """A double as the oracles state it: rounded, and never negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, digits) + 0.0).alias(name or c)


def whole(c: str | Column, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


def listed(c: str | Column, name: str | None = None, sep: str = "|") -> Column:
    return F.array_join(c, sep).alias(name or c)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


def _i(*names: str) -> str:
    return ", ".join(f"cast({n} as bigint) as {n}" for n in names)


# ── Schema, cleaning and value counts ──────────────────────────────────────


@query("select table_name, column_name, data_type, type_class, cast(non_null as bigint) as non_null"
       " from cols join row_counts using (table_name, column_pos)")
def type_class_of_columns(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    present = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    rows = prof.raw_counts.groupBy("column_id").agg(F.sum(present).alias("non_null"))
    return prof.columns.join(rows, "column_id").select(
        "table_name", "column_name", "data_type", type_class(F.col("data_type")).alias("type_class"), "non_null"
    )


@query("select doc_id, md5(lower(replace(replace(trim(text), chr(10), ''), chr(13), ''))) as profile_md5,"
       " md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as sketch_md5 from documents")
def clean_values(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id", F.md5(clean_value(F.col("text"))).alias("profile_md5"),
        F.md5(normalise_value(F.col("text"))).alias("sketch_md5"),
    )


@query("select table_name, string_agg(token, '|' order by token) as tokens from (select distinct table_name,"
       " unnest(regexp_extract_all(lower(column_name), '[a-z]+')) as token from profile) group by table_name")
def column_name_tokens(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    tokens = prof.column_profile.select("table_name", F.explode(name_tokens(F.col("column_name"))).alias("t"))
    return tokens.groupBy("table_name").agg(listed(F.array_sort(F.collect_set("t")), "tokens"))


@query("select table_name, column_name, case when length(p) > 256 then sha256(p) else p end as value,"
       " cast(n as bigint) as n from vc join cols using (table_name, column_pos)")
def value_counts(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    counts = prof.counts.where(F.col("v").isNotNull())
    return named(prof, counts.select("column_id", F.coalesce("digest", "v").alias("value"), "n"))


@query("select table_name, column_name, v is null as is_missing, cast(count(*) as bigint) as n_values,"
       " cast(sum(n) as bigint) as n_rows from (select table_name, column_pos, v, count(*) as n from cells"
       " where type_class = 'string' group by all) join cols using (table_name, column_pos)"
       " group by table_name, column_name, is_missing")
def raw_value_counts(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    text = prof.raw_counts.where(F.col("type_class") == "string")
    return named(prof, text.groupBy("column_id", F.col("v").isNull().alias("is_missing")).agg(
        F.count("*").alias("n_values"), F.sum("n").alias("n_rows")
    ))


# ── Column profile ─────────────────────────────────────────────────────────


@query(f"select table_name, column_name, {_i('row_count', 'non_null', 'cardinality')},"
       f" {_r('uniqueness', 'incompleteness', 'entropy')} from profile")
def cardinality_metrics(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select(
        "table_name", "column_name", whole("row_count"), whole("non_null"), whole("cardinality"),
        real("uniqueness"), real("incompleteness"), real("entropy"),
    )


@query(f"select table_name, column_name, {_i('frequency_min', 'frequency_max')},"
       f" {_r('frequency_avg', 'frequency_sd', 'val_pct_min', 'val_pct_max', 'val_pct_std', 'constancy')}"
       " from profile")
def frequency_distribution(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    return prof.column_profile.select(
        "table_name", "column_name", whole("frequency_min"), whole("frequency_max"),
        *[real(c) for c in ("frequency_avg", "frequency_sd", "val_pct_min", "val_pct_max", "val_pct_std", "constancy")],
    )


_OCTILE_NAMES = ["frequency_iqr", *[f"frequency_{i}qo" for i in OCTILES]]


@query(f"select table_name, column_name, {_r(*_OCTILE_NAMES)} from profile")
def frequency_octiles(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    return prof.column_profile.select("table_name", "column_name", *[real(c) for c in _OCTILE_NAMES])


@query(f"select table_name, column_name, {_r('skewness', 'kurtosis')} from profile")
def skew_kurtosis(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select("table_name", "column_name", real("skewness"), real("kurtosis"))


@query("select table_name, column_name, cast(rank as bigint) as rank, cast(n as bigint) as n, p as value"
       " from tops join cols using (table_name, column_pos)")
def top10_values(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    top = p.top_values(prof.picks)
    return named(prof, top.select("column_id", whole("rank"), "n", F.col("text").alias("value")))


def _soundex_sql(v: str) -> str:
    """Soundex step by step: marks for all characters, then each digit's runs made single."""
    upper = f"translate({v}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    first = f"substr({upper}, 1, 1)"
    rest = f"replace(replace(substr({upper}, 2), 'H', ''), 'W', '')"
    marks = f"translate(regexp_replace({first} || {rest}, '[^BCDFGJKLMNPQRSTVXZ]', '.', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    for digit in range(1, 7):
        marks = f"regexp_replace({marks}, '{digit}+', '{digit}', 'g')"
    return f"case when {v} = '' then '' else {first} || rpad(substr(replace(substr({marks}, 2), '.', ''), 1, 3), 3, '0') end"


@query(f"select table_name, column_name, string_agg({_soundex_sql('p')}, '|' order by rank) as soundex"
       " from tops join cols using (table_name, column_pos) group by table_name, column_name")
def soundex_top10(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    return prof.column_profile.select("table_name", "column_name", listed("freq_word_soundex_containment", "soundex"))


@query("select table_name, column_name, string_agg(code, '|' order by code) as soundex_values from"
       f" (select distinct table_name, column_name, lower({_soundex_sql('p')}) as code from tops join cols using (table_name, column_pos))"
       " group by table_name, column_name")
def soundex_sets(spark, sf_dir):
    return p.value_sets(lake_profile(spark, sf_dir).column_profile).select("table_name", "column_name", listed("soundex_values"))


@query(f"select doc_id, md5(string_agg({_soundex_sql('word')}, ' ' order by pos)) as codes_md5 from (select doc_id, unnest(ws) as word,"
       " generate_subscripts(ws, 1) as pos from (select doc_id, string_split(text, ' ') as ws from documents)) group by doc_id")
def soundex_of_words(spark, sf_dir):
    """P13 on every word of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(F.array_join(F.transform(F.split("text", " "), soundex), " ")).alias("codes_md5"))


@query("select table_name, column_name, string_agg(value, '|' order by value) as top_values from"
       " (select distinct table_name, column_name, lower(p) as value from tops join cols using (table_name, column_pos))"
       " group by table_name, column_name")
def value_sets(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    return p.value_sets(prof.column_profile).select("table_name", "column_name", listed("top_values"))


@query(f"select table_name, column_name, {_i('len_max_word', 'len_min_word')}, {_r('len_avg_word')} from profile")
def word_lengths(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select(
        "table_name", "column_name", whole("len_max_word"), whole("len_min_word"), real("len_avg_word")
    )


@query(f"select table_name, column_name, {_i('number_words', 'words_cnt_max', 'words_cnt_min')},"
       f" {_r('words_cnt_avg', 'words_cnt_sd')} from profile")
def word_counts(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select(
        "table_name", "column_name", whole("number_words"), whole("words_cnt_max"), whole("words_cnt_min"),
        real("words_cnt_avg"), real("words_cnt_sd"),
    )


@query("select table_name, column_name, first_word, last_word from profile")
def boundary_values(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select("table_name", "column_name", "first_word", "last_word")


@query(f"select table_name, column_name, {_i('is_empty', 'is_binary')}, fixed_length,"
       f" {_r('cardinality_ratio')} from roles")
def column_flags(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select(
        "table_name", "column_name", whole("is_empty"), whole("is_binary"), "fixed_length", real("cardinality_ratio")
    )


@query("select table_name, column_name, cast(val_len_min as bigint) as val_len_min,"
       " cast(val_len_max as bigint) as val_len_max, round(val_len_avg, 6) as val_len_avg"
       " from raw_lengths join cols using (table_name, column_pos)")
def value_lengths(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    return named(prof, p.text_metrics(prof.summary_counts).where("val_len_min is not null").select(
        "column_id", whole("val_len_min"), whole("val_len_max"), real("val_len_avg")
    ))


@query("select table_name, column_name, round(text_entropy, 6) + 0.0 as text_entropy"
       " from raw_entropy join cols using (table_name, column_pos)")
def text_entropy(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    return named(prof, p.text_metrics(prof.summary_counts).select("column_id", real("text_entropy")))


_WHOLE = ("row_count", "non_null", "cardinality", "frequency_min", "frequency_max", "len_max_word", "len_min_word",
          "number_words", "words_cnt_max", "words_cnt_min", "is_empty", "is_binary")
_REAL = ("uniqueness", "incompleteness", "entropy", "frequency_avg", "frequency_sd", *_OCTILE_NAMES,
         "val_pct_min", "val_pct_max", "val_pct_std", "constancy", "len_avg_word", "words_cnt_avg", "words_cnt_sd")


@query(f"select table_name, column_name, data_type, type_class, role, {_i(*_WHOLE)}, {_r(*_REAL)},"
       " top_values, first_word, last_word from roles")
def column_profile(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select(
        "table_name", "column_name", "data_type", "type_class", "role", *[whole(c) for c in _WHOLE],
        *[real(c) for c in _REAL], listed("freq_word_containment", "top_values"), "first_word", "last_word",
    )


@query(f"select table_name, column_name, {_i('cardinality')}, {_r('entropy', 'val_pct_max', 'len_avg_word')}"
       " from profile where data_type = 'string'")
def varchar_only_profile(spark, sf_dir):
    """The profile of text columns only."""
    prof = Profile(TableSource(lake_tables(spark, sf_dir), varchar_only=True))
    return prof.column_profile.select(
        "table_name", "column_name", whole("cardinality"), real("entropy"), real("val_pct_max"), real("len_avg_word")
    )


@query("select table_name, column_name, role, cast(case when cardinality_ratio <= 0.1 then 0"
       " when cardinality_ratio <= 0.5 then 1 when cardinality_ratio <= 0.9 then 2 else 3 end as bigint)"
       " as cardinality_bucket, cast(case when len_avg_word <= 5 then 0 when len_avg_word <= 30 then 1 else 2 end"
       " as bigint) as length_bucket from roles")
def column_roles(spark, sf_dir):
    return lake_profile(spark, sf_dir).column_profile.select(
        "table_name", "column_name", "role",
        whole(cardinality_bucket(F.col("cardinality_ratio")), "cardinality_bucket"),
        whole(length_bucket(F.col("len_avg_word")), "length_bucket"),
    )


# ── Table profile ──────────────────────────────────────────────────────────


@query("select table_name, " + ", ".join(f"cast(r{i} as bigint) as {r.lower()}" for i, r in enumerate(_ROLES))
       + " from hist")
def role_histogram(spark, sf_dir):
    t = lake_profile(spark, sf_dir).table_profile
    return t.select("table_name", *[whole(F.col("role_counts")[r], r.lower()) for r in ROLES])


@query(f"select table_name, {_i('c0', 'c1', 'c2', 'c3')} from hist")
def cardinality_histogram(spark, sf_dir):
    t = lake_profile(spark, sf_dir).table_profile
    return t.select("table_name", *[whole(F.col("cardinality_hist")[i], f"c{i}") for i in range(4)])


@query(f"select table_name, {_i('l0', 'l1', 'l2')} from hist")
def length_histogram(spark, sf_dir):
    t = lake_profile(spark, sf_dir).table_profile
    return t.select("table_name", *[whole(F.col("length_hist")[i], f"l{i}") for i in range(3)])


@query("select table_name, round(avg(incompleteness), 6) as null_ratio, round(avg(cardinality), 6) as cardinality,"
       " round(avg(val_pct_max), 6) as val_pct_max, round(avg(len_avg_word), 6) as avg_string_length"
       " from profile group by table_name")
def macro_means_of_tables(spark, sf_dir):
    m = macro_means(lake_profile(spark, sf_dir).column_profile)
    return m.select("table_name", *[real(c) for c in ("null_ratio", "cardinality", "val_pct_max", "avg_string_length")])


@query("select table_name, " + ", ".join(
    f"round(avg(case when type_class = '{t}' then 1.0 else 0.0 end), 6) as type_{t}_frac"
    for t in ("numeric", "string", "date")) + " from profile group by table_name")
def type_fractions_of_tables(spark, sf_dir):
    f = type_fractions(lake_profile(spark, sf_dir).column_profile)
    return f.select("table_name", *[real(f"type_{t}_frac") for t in ("numeric", "string", "date")])


@query("select table_name, cast(max(round(cardinality / uniqueness)) filter (uniqueness > 0) as bigint) as row_count"
       " from profile group by table_name")
def recovered_row_counts(spark, sf_dir):
    return row_count_recovery(lake_profile(spark, sf_dir).column_profile)


@query("select table_name, cast(max(row_count) as bigint) as row_count, count(*) as col_count,"
       " string_agg(column_name, '|' order by column_pos) as col_names from profile group by table_name")
def table_profiles(spark, sf_dir):
    t = lake_profile(spark, sf_dir).table_profile
    return t.select("table_name", "row_count", "col_count", listed("col_names"))


@query("select table_name, " + ", ".join(f"round(sv[{i + 1}], 6) as s{i}" for i in range(15)) + " from structs")
def structural_vector(spark, sf_dir):
    t = lake_profile(spark, sf_dir).table_profile
    return t.select("table_name", *[real(F.col("struct_vec")[i], f"s{i}") for i in range(15)])


# ── Sketches and joinability ───────────────────────────────────────────────


@query("select table_name, column_name, array_to_string(sig, ',') as sig, cast(n as bigint) as n"
       " from sigs join cols using (table_name, column_pos)")
def minhash_signature(spark, sf_dir):
    prof = lake_profile(spark, sf_dir)
    return named(prof, minhash(prof.raw_counts).select("column_id", listed("sig", sep=","), "n"))


@query("select table_name, column_name, role, array_to_string(sig, ',') as sig, cast(n as bigint) as n, type,"
       " cast(len_min as bigint) as len_min, cast(len_max as bigint) as len_max from join_cols")
def join_columns(spark, sf_dir):
    return lake(spark, sf_dir).join_cols.select(
        "table_name", "column_name", "role", listed("sig", sep=","), "n", "type", whole("len_min"), whole("len_max")
    )


@query("select h, count(*) as n_columns from (select unnest(sig) as h from join_cols) group by h")
def sketch_postings(spark, sf_dir):
    return sketch_index(lake(spark, sf_dir).join_cols).groupBy("h").agg(F.count("*").alias("n_columns"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = lake(spark, sf_dir).join_cols
    return column_pairs(cols, cols, many_queries=True)


_PAIR = ["q_table", "q_column", "c_table", "c_column"]


@query(f"select {', '.join(_PAIR)}, round(containment, 6) as containment from pairs")
def containment_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*_PAIR, real("containment"))


@query(f"select {', '.join(_PAIR)}, round(compat, 6) as compat from pairs")
def length_compatibility(spark, sf_dir):
    cols = lake(spark, sf_dir).join_cols
    q = cols.select(*[F.col(c).alias(f"q_{c}") for c in ("table_name", "column_name", "len_min", "len_max")])
    c = cols.select(*[F.col(c).alias(f"c_{c}") for c in ("table_name", "column_name", "len_min", "len_max")])
    pairs = _pairs(spark, sf_dir).select(*_PAIR)
    both = (
        pairs.join(q, (pairs.q_table == q.q_table_name) & (pairs.q_column == q.q_column_name))
        .join(c, (pairs.c_table == c.c_table_name) & (pairs.c_column == c.c_column_name))
    )
    compat = length_compat(F.col("q_len_min"), F.col("q_len_max"), F.col("c_len_min"), F.col("c_len_max"))
    return both.select(*_PAIR, real(compat, "compat"))


@query(f"select {', '.join(_PAIR)}, round(prior, 6) as prior from scored")
def joinable_prior_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*_PAIR, real("prior"))


@query(f"select {', '.join(_PAIR)}, round(j, 6) as j from scored")
def pair_joinability(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*_PAIR, real("j"))


@query(f"select {', '.join(_PAIR)}, round(j, 6) as j, j >= 0.5 as is_key from best")
def best_column_pairs(spark, sf_dir):
    return best_pairs(_pairs(spark, sf_dir)).select(*_PAIR, real("j"), (F.col("j") >= 0.5).alias("is_key"))


@query("select q_table, c_table, round(joinability, 6) as joinability from joins")
def joinability(spark, sf_dir):
    return table_joinability(best_pairs(_pairs(spark, sf_dir))).select("q_table", "c_table", real("joinability"))


@query("select q_table, c_table, join_columns, cast(n_join_keys as bigint) as n_join_keys, best_query_column,"
       " best_candidate_column from joins")
def join_key_report(spark, sf_dir):
    return table_joinability(best_pairs(_pairs(spark, sf_dir))).drop("joinability")


# ── Texts, embeddings and nearest tables ───────────────────────────────────


@query("select table_name, sample_text from sample_texts")
def table_sample(spark, sf_dir):
    return lake_profile(spark, sf_dir).samples


@query("select table_name, summary from summaries")
def executive_summary(spark, sf_dir):
    return lake_profile(spark, sf_dir).summaries


@query("select table_name, table_text from texts")
def table_text(spark, sf_dir):
    return lake(spark, sf_dir).table_embedding.select("table_name", "table_text")


@query("select table_name, cast(bucket as bigint) as bucket, tf from bags")
def token_buckets(spark, sf_dir):
    texts = lake(spark, sf_dir).table_embedding.select("table_name", "table_text")
    return token_weights(texts).select("table_name", whole("bucket"), "tf")


@query("select table_name, cast(bucket as bigint) as bucket, round(w, 6) as w from vecs")
def table_embedding(spark, sf_dir):
    vecs = lake(spark, sf_dir).table_embedding.select("table_name", F.posexplode("vec").alias("bucket", "w"))
    return vecs.where(F.col("w") != 0).select("table_name", whole("bucket"), real("w"))


@query("select cast(bucket as bigint) as bucket, round(w, 6) as w from vecs where table_name = 'customer'")
def embedding_lookup(spark, sf_dir):
    vec = lake(spark, sf_dir).table_embedding.where(F.col("table_name") == "customer")
    return vec.select(F.posexplode("vec").alias("bucket", "w")).where(F.col("w") != 0).select(
        whole("bucket"), real("w")
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as an index; `vec_id` stands for the table's name."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").cast("string").alias("table_name"), F.col("embedding").alias("vec"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double))"


@query("select vec_id, cast(pos as bigint) as pos, round(x / norm, 6) + 0.0 as x from (select vec_id,"
       " unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos,"
       " sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) as norm from embeddings)")
def normalised_vectors(spark, sf_dir):
    from tablescout.functions.scores import unit

    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select("vec_id", F.posexplode(unit(F.col("embedding"))).alias("pos", "x")).select(
        "vec_id", whole("pos"), real("x")
    )


def _every_fiftieth(index: DataFrame) -> DataFrame:
    return index.where(F.col("table_name").cast("bigint") % 50 == 0)


_TOPK = (
    "(select *, row_number() over (partition by query order by s desc, table_name) as rank from (select a.vec_id as query,"
    f" cast(b.vec_id as varchar) as table_name, greatest(0, {_DOT}) as s from embeddings a, embeddings b where a.vec_id % 50 = 0))")
_NEAREST = f"select cast(query as varchar) as query, table_name, round(s, 6) as score, cast(rank as bigint) as rank from {_TOPK} where rank <= 10"


@query(_NEAREST)
def cosine_topk(spark, sf_dir):
    """The ten nearest rows of every vec_id divisible by 50, by exact cosine over all rows."""
    index = _vectors(spark, sf_dir)
    return nearest_each(index, _every_fiftieth(index), 10).select("query", "table_name", real("score"), whole("rank"))


@query(_NEAREST)
def cosine_topk_each(spark, sf_dir):
    return cosine_topk(spark, sf_dir)


def _vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return VectorIndex.build(_vectors(spark, sf_dir), new_dir(spark, "vector-index"))


@query()
def ann_topk(spark, sf_dir):
    """The same searches by a stored index of cells; `ann_recall` holds them against all rows."""
    found = _vector_index(spark, sf_dir).nearest_each(_every_fiftieth(_vectors(spark, sf_dir)), 10)
    return found.select("query", "table_name", real("score"), whole("rank"))


@query()
def ann_topk_each(spark, sf_dir):
    return ann_topk(spark, sf_dir)


@query(f"select count(distinct query) as queries, count(*) as rows_found, true as recall_reached from {_TOPK} where rank <= 10")
def ann_recall(spark, sf_dir):
    """Whether the index finds at least 0.9 of the ten nearest rows (by score, so that ties count), over every vec_id divisible by 50."""
    index = _vectors(spark, sf_dir)
    exact = nearest_each(index, _every_fiftieth(index), 10).groupBy("query").agg(F.min("score").alias("bound"))
    found = _vector_index(spark, sf_dir).nearest_each(_every_fiftieth(index), 10).join(exact, "query", "left")
    return found.agg(
        whole(F.count_distinct("query"), "queries"), whole(F.count("*"), "rows_found"),
        (F.avg((F.col("score") >= F.col("bound")).cast("double")) >= 0.9).alias("recall_reached"))


@query("select c_table as candidate_table, round(ts, 4) as table_semantic from sims where q_table = 'customer'")
def table_semantic(spark, sf_dir):
    built = lake(spark, sf_dir)
    score = cosine(F.col("vec"), vector_literal(built.vector("customer")))
    others = built.table_embedding.where(F.col("table_name") != "customer")
    return others.select(F.col("table_name").alias("candidate_table"), F.round(score, 4).alias("table_semantic"))


@query("select q_table, c_table, round(ss, 4) as struct_sim from sims join joins using (q_table, c_table)")
def structural_similarity(spark, sf_dir):
    structs = lake(spark, sf_dir).table_profile
    pairs = table_joinability(best_pairs(_pairs(spark, sf_dir))).select("q_table", "c_table")
    q = structs.select(F.col("table_name").alias("q_table"), F.col("struct_vec").alias("q"))
    c = structs.select(F.col("table_name").alias("c_table"), F.col("struct_vec").alias("c"))
    return pairs.join(q, "q_table").join(c, "c_table").select(
        "q_table", "c_table", F.round(cosine(F.col("q"), F.col("c")), 4).alias("struct_sim")
    )


# ── Searches ───────────────────────────────────────────────────────────────

_RANKING = ("query_table, cast(rank as bigint) as rank, candidate_table, similarity_score, joinability_score,"
            " table_semantic, struct_sim, join_columns, cast(n_join_keys as bigint) as n_join_keys,"
            " best_query_column, best_candidate_column")
_RANKED = "(select * exclude (c_table), c_table as candidate_table from full_ranking)"


def _shown(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"select {_RANKING} from {_RANKED} where query_table = 'customer'")
def search_indexed(spark, sf_dir):
    """Q1, the full ranking of one stored table."""
    return _shown(lake(spark, sf_dir).search_indexed("customer", top_n=None))


@query(f"select {_RANKING} from {_RANKED} where query_table = 'orders_filled' and rank <= 10")
def search_top10(spark, sf_dir):
    return _shown(lake(spark, sf_dir).search_indexed("orders_filled"))


@query(f"select {_RANKING} from {_RANKED} where query_table = 'orders_urgent' and rank <= 10")
def search_external(spark, sf_dir):
    """Q2 with a table the lake holds under the same name, so that the stored result is the expected one."""
    return _shown(lake(spark, sf_dir).search(lake_tables(spark, sf_dir)["orders_urgent"], query_name="orders_urgent"))


@query(f"select query_table, row_number() over (order by similarity_score desc, candidate_table) as rank,"
       f" * exclude (query_table, rank) from (select {_RANKING} from {_RANKED} where query_table = 'customer')"
       " where candidate_table in (select c_table from sims where q_table = 'customer'"
       " order by ts desc, c_table limit 7)")
def search_pool(spark, sf_dir):
    """A pool of 8 tables by meaning, the query being one of them."""
    return _shown(lake(spark, sf_dir).search_indexed("customer", top_n=None, rerank_pool=8))


@query(f"select {_RANKING} from {_RANKED} where rank <= 10")
def search_all(spark, sf_dir):
    """Q3, the flagship: the ten best tables for every table of the lake."""
    return _shown(lake(spark, sf_dir).search_all(top_n=10))


@query("select query_table, candidate_table, similarity_score from "
       f"{_RANKED} where joinability_score > 0 and rank <= 10")
def similarity_scores(spark, sf_dir):
    ranking = lake(spark, sf_dir).search_all(top_n=10).where(F.col("joinability_score") > 0)
    return ranking.select("query_table", "candidate_table", "similarity_score")


# ── Profiles of whole lakes, catalogs and CSV ──────────────────────────────


@query("select table_name, column_name, " + ", ".join(
    f"round(coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0), 6) + 0.0 as {c}" for c in _Z)
    + " from profile")
def zscored_profiles(spark, sf_dir):
    z = zscore_profiles(lake_profile(spark, sf_dir).column_profile)
    return z.select("table_name", "column_name", *[real(c) for c in _Z])


@query("select table_name, column_name, cast(number_words as double) as number_words, round(entropy, 6) as entropy,"
       " cast(is_binary as double) as is_binary, first_word, last_word, t.top_values from profile join (select"
       " table_name, column_pos, string_agg(p, '|' order by p) as top_values from tops group by all) t"
       " using (table_name, column_pos)")
def preprocessed_profiles(spark, sf_dir):
    typed = preprocess_profiles(lake_profile(spark, sf_dir).column_profile)
    return typed.select(
        "table_name", "column_name", "number_words", real("entropy"), "is_binary", "first_word", "last_word",
        listed("freq_word_containment", "top_values"),
    )


@query("select table_name, column_name, case data_type when 'int' then 'bigint' when 'timestamp_ntz' then 'timestamp'"
       " else data_type end as data_type from cols")
def inferred_types(spark, sf_dir):
    """S2b on the text of every value of the lake."""
    return _inferred(lake_profile(spark, sf_dir))


def _inferred(prof: Profile) -> DataFrame:
    cells = prof.columns.select("column_id", "table_name", "column_pos").join(prof.raw_counts, "column_id")
    types = infer_types(cells.select("table_name", "column_pos", "v", F.col("long.fits").alias("fits")))
    return prof.columns.drop("data_type").join(types, ["table_name", "column_pos"]).select(
        "table_name", "column_name", "data_type"
    )


_ROWS_OF_TABLES = "(select table_name, cast(max(row_count) as bigint) as n_rows from profile group by table_name)"


@query(f"select 'Test lake' as name, (select count(*) from {_ROWS_OF_TABLES} u) as n_tables, cast(0 as bigint) as n_skipped, table_name, n_rows"
       f" from {_ROWS_OF_TABLES} t")
def lake_report(spark, sf_dir):
    """S15, next to the row counts of the tables it reports on."""
    built = lake(spark, sf_dir)
    rows = built.column_profile.groupBy("table_name").agg(F.max("row_count").alias("n_rows"))
    report = built.report().select("name", "n_tables", whole(F.size("skipped"), "n_skipped"))
    return rows.join(F.broadcast(report))


@query(f"select 'tables' as lake, 'Test lake' as name, count(*) as n_tables, cast(sum(n_rows) as bigint) as n_rows from {_ROWS_OF_TABLES} t")
def lakes_of_folder(spark, sf_dir):
    """S9, with the rows of each lake's tables."""
    built = lake(spark, sf_dir)
    rows = built.column_profile.groupBy("table_name").agg(F.max("row_count").alias("n"))
    total = rows.agg(F.sum("n").alias("n_rows")).withColumn("lake", F.lit(built.path.rsplit("/", 1)[1]))
    return list_lakes(spark, built.path.rsplit("/", 1)[0]).select("lake", "name", "n_tables").join(total, "lake")


@query(f"select {_RANKING} from {_RANKED} where query_table = 'customer'")
def exported_ranking(spark, sf_dir):
    """The full ranking of a table, exported as CSV and read again."""
    ranking = lake(spark, sf_dir).search_indexed("customer", top_n=None)
    path = new_dir(spark, "ranking")
    export_ranking(ranking, path)
    read = spark.read.schema(ranking.schema).option("header", True).csv(path)
    return _shown(read.withColumn("join_columns", F.coalesce("join_columns", F.lit(""))))


@query("select table_name, column_name, " + ", ".join(
    f"round(coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0), 5) + 0.0 as {c}" for c in _Z)
    + ", first_word, last_word from profile")
def exported_typed_profiles(spark, sf_dir):
    """All tables profiled, z-scored, typed and exported; the typed profiles, read again."""
    path = new_dir(spark, "profiles")
    export_profiles(TableSource(lake_tables(spark, sf_dir)), path)
    typed = spark.read.parquet(f"{path}/profiles_typed")
    return typed.select("table_name", "column_name", *[real(c, digits=5) for c in _Z], "first_word", "last_word")


@query("select column_name, cast(row_count as bigint) as row_count, cast(cardinality as bigint) as cardinality from (select"
       " case column_name when 'c_custkey' then 'key' when 'c_name' then 'key_1' when 'c_nationkey' then 'na tion' when 'c_acctbal' then 'KEY_2'"
       " else 'seg' end as column_name, row_count, cardinality from profile where table_name = 'customer')")
def dirty_header(spark, sf_dir):
    """Byte-order mark, quotes, line breaks and blanks go, names that are taken get a number."""
    df = lake_tables(spark, sf_dir)["customer"].toDF("\ufeffkey", ' "key"\n', "na tion\r\n", "KEY", '  se"g  ')
    return Profile(TableSource({"dirty": df})).column_profile.select("column_name", whole("row_count"), whole("cardinality"))


@query("select o_orderkey, coalesce(try_cast(substr(o_orderpriority, 1, 1 + o_orderkey % 3) as double), 0) as number,"
       " coalesce(try_cast(trunc(o_totalprice) as bigint), -1) as whole_part,"
       " coalesce(try_cast(o_orderstatus as double), 7) as fallback from orders")
def tolerant_numbers(spark, sf_dir):
    """What is no number becomes the default."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        "o_orderkey", number_or(F.expr("substr(o_orderpriority, 1, cast(1 + o_orderkey % 3 as int))")).alias("number"),
        integer_or(F.col("o_totalprice").cast("string"), -1).alias("whole_part"), number_or(F.col("o_orderstatus"), 7).alias("fallback"))


@query("select table_name, column_name, cast(row_count as bigint) as row_count from profile where table_name in ('orders', 'part')")
def rebuilt_lake(spark, sf_dir):
    """A lake is built, replaced by a build over other tables, and loaded again."""
    tables = lake_tables(spark, sf_dir)
    path = new_dir(spark, "rebuilt") + "/lake"
    build_lake(TableSource({"customer": tables["customer"]}), path, "first")
    build_lake(TableSource({name: tables[name] for name in ("orders", "part")}), path, "second")
    return Lake(spark, path).column_profile.select("table_name", "column_name", whole("row_count"))


@query(f"select {_RANKING} from {_RANKED} where query_table = 'supplier' and candidate_table = 'supplier'")
def empty_ranking(spark, sf_dir):
    """The ranking of the only table of a lake has all columns and no row."""
    only = build_lake(TableSource({"supplier": lake_tables(spark, sf_dir)["supplier"]}), new_dir(spark, "only") + "/lake", "only")
    return _shown(only.search_indexed("supplier", top_n=None))


@query("select table_name, count(*) as n_join_columns from join_cols group by table_name")
def lake_build(spark, sf_dir):
    """Q4: a build from scratch, then what its catalog holds."""
    return new_lake(spark, sf_dir).join_cols.groupBy("table_name").agg(F.count("*").alias("n_join_columns"))


_READABLE = ("customer", "documents", "events", "nation", "orders", "supplier")


@query(f"select table_name, column_name, {_i('row_count', 'cardinality')}, 'events_cut,orders_junk' as skipped, true as told_why"
       f" from profile where table_name in {_READABLE}")
def lake_with_unreadable_tables(spark, sf_dir):
    """A folder of Parquet tables, one of which has a part that is none and one only such a part; the others make a lake."""
    folder = new_dir(spark, "tables")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lake_tables(spark, sf_dir)
    for name in _READABLE:
        tables[name].write.parquet(f"{folder}/{name}.parquet")
    tables["events"].write.parquet(f"{folder}/events_cut.parquet")
    for name in ("events_cut", "orders_junk"):
        out = fs.create(path(f"{folder}/{name}.parquet/part-zz.parquet"))
        out.write(bytearray(b"PAR1 but nothing after it"))
        out.close()
    built = build_lake(parquet_source(spark, folder), new_dir(spark, "partial") + "/lake", "partial")
    skipped, why = built.meta["skipped"], built.meta["skip_reasons"]
    return built.column_profile.select(
        "table_name", "column_name", whole("row_count"), whole("cardinality"), F.lit(",".join(skipped)).alias("skipped"),
        F.lit([w.split(": ")[0] for w in why] == skipped and all(len(w) > 20 for w in why)).alias("told_why"))


# Tables and columns that CSV can hold; a view's text that is a number in disguise would come back as one.
_CSV_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels",
    "conversations", "customer_contacts", "documents_labelled", "events_kinds", "nation_region", "orders_filled", "orders_urgent",
    "part_list", "part_sku", "supplier_nation",
)


# How CSV files are written: delimiter, quote, escape.
_DIALECTS = ((",", '"', '"'), (";", "'", "'"), ("\t", '"', '"'), ("|", '"', "\\"))


def _csv_lake(spark: SparkSession, sf_dir: str, dialects: tuple = _DIALECTS[:1]) -> str:
    """A folder with each table as a folder of CSV files, written by Spark, in one dialect after the other."""
    folder = new_dir(spark, "csv")
    for i, (name, df) in enumerate((n, t) for n, t in lake_tables(spark, sf_dir).items() if n in _CSV_TABLES):
        delimiter, quote, escape = dialects[i % len(dialects)]
        (
            df.write.option("header", True).option("sep", delimiter).option("quote", quote).option("escape", escape)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(f"{folder}/{name}.csv")
        )
    return folder


@query("select table_name || '.csv' as table_name, column_name, case data_type when 'int' then 'bigint' when 'timestamp_ntz' then 'timestamp'"
       f" else data_type end as data_type from cols where table_name in {_CSV_TABLES}")
def csv_lake_types(spark, sf_dir):
    """Types inferred from all cells of a folder of CSV files in four dialects."""
    return csv_source(spark, _csv_lake(spark, sf_dir, _DIALECTS)).columns().select("table_name", "column_name", "data_type")


@query(f"select table_name || '.csv' as table_name, column_name, type_class, {_i('row_count', 'cardinality', 'len_max_word')},"
       f" {_r('entropy')}, first_word, last_word from profile where table_name in {_CSV_TABLES}")
def csv_lake_profile(spark, sf_dir):
    """All tables as a folder of CSV files, read through one source and profiled."""
    return Profile(csv_source(spark, _csv_lake(spark, sf_dir))).column_profile.select(
        "table_name", "column_name", "type_class", whole("row_count"), whole("cardinality"), whole("len_max_word"),
        real("entropy"), "first_word", "last_word",
    )


@query(f"select table_name || '.csv' as table_name, column_name, type_class, {_i('row_count', 'cardinality', 'len_max_word')},"
       f" {_r('entropy')}, first_word, last_word from profile where table_name in {_CSV_TABLES}")
def csv_dialects(spark, sf_dir):
    """All tables as CSV files of four dialects, told apart by their lines, read through one source and profiled."""
    return Profile(csv_source(spark, _csv_lake(spark, sf_dir, _DIALECTS))).column_profile.select(
        "table_name", "column_name", "type_class", whole("row_count"), whole("cardinality"), whole("len_max_word"),
        real("entropy"), "first_word", "last_word",
    )


@query(f"select table_name, column_name, type_class, {_i('row_count', 'cardinality', 'len_max_word')},"
       f" {_r('entropy')}, first_word, last_word from profile where table_name in {_CSV_TABLES}")
def csv_roundtrip(spark, sf_dir):
    """Tables written as folders of CSV files, read back as wide tables with inferred types and profiled."""
    tables = lake_tables(spark, sf_dir)
    folder = new_dir(spark, "csv")
    for t in _CSV_TABLES:
        (
            tables[t].write.option("header", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(f"{folder}/{t}")
        )
    # Small tables are read while large ones are.
    with ThreadPoolExecutor(4) as pool:
        read = dict(zip(_CSV_TABLES, pool.map(lambda t: read_csv(spark, f"{folder}/{t}"), _CSV_TABLES), strict=True))
    source = TableSource(read)
    return Profile(source).column_profile.select(
        "table_name", "column_name", "type_class", whole("row_count"), whole("cardinality"), whole("len_max_word"),
        real("entropy"), "first_word", "last_word",
    )
