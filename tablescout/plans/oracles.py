"""DuckDB SQL that states the expected result of the registered queries, over the same tables."""

from __future__ import annotations

import re

from tablescout.functions.text import type_class_of
from tablescout.plans.testlake import VIEWS

# Schemas of the given tables and of the views (Spark type names); `embedding` is nested and left out.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                " l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, _ nested, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer_contacts": "c_custkey bigint, contact string, c_acctbal double, segment string",
    "documents_labelled": "doc_id bigint, lang string, source string, n_chars bigint, quality int",
    "events_kinds": "event_id bigint, kind string, props string",
    "nation_region": "n_nationkey int, n_name string, r_name string",
    "orders_filled": "o_orderkey bigint, buyer string, o_totalprice double, o_orderdate timestamp_ntz",
    "orders_urgent": "o_orderkey bigint, customer string, market string, o_orderpriority string",
    "part_list": "item string, p_type string, p_retailprice double",
    "part_sku": "sku string, p_name string, p_brand string, p_size int",
    "supplier_nation": "s_suppkey bigint, s_name string, country string, s_acctbal double",
}

OCTILES = range(1, 8)


def _fields(table: str) -> list[tuple[int, str, str]]:
    parts = [p.split() for p in SCHEMAS[table].split(",")]
    return [(i, name, kind) for i, (name, kind) in enumerate(parts) if kind != "nested"]


def _cells() -> str:
    rows = []
    for table in SCHEMAS:
        for pos, name, kind in _fields(table):
            number = f"cast({name} as double)" if type_class_of(kind) == "numeric" else "cast(null as double)"
            rows.append(
                f"select '{table}' as table_name, {pos} as column_pos, '{name}' as column_name,"
                f" '{kind}' as data_type, '{type_class_of(kind)}' as type_class,"
                f" cast({name} as varchar) as v, {number} as num from {table}"
            )
    return "\nunion all ".join(rows)


def _samples() -> str:
    rows = []
    for table in SCHEMAS:
        text = " || ' | ' || ".join(f"coalesce(cast({name} as varchar), '')" for _, name, _ in _fields(table))
        rows.append(
            f"select * from (select '{table}' as table_name, md5(row_text) as h, row_text from"
            f" (select {text} as row_text from {table}) order by h limit 3)"
        )
    return "\nunion all ".join(rows)


_COLUMNS = "values " + ", ".join(
    f"('{t}', {pos}, '{name}', '{kind}', '{type_class_of(kind)}')"
    for t in SCHEMAS for pos, name, kind in _fields(t)
)

_ROLES = ("IDENTIFIER", "JOIN_CODE", "FOREIGN_KEY_CANDIDATE", "CATEGORY", "MEASURE", "FREE_TEXT", "TEMPORAL", "FLAG")
_Z = ("cardinality", "entropy", "frequency_avg", "frequency_min", "frequency_max", "frequency_sd",
      "len_max_word", "len_min_word", "len_avg_word", "number_words", "words_cnt_max", "words_cnt_min",
      "words_cnt_avg", "words_cnt_sd")

_STRUCT = [
    *[f"coalesce(r{i} / nullif(rs, 0), 0.0)" for i in range(8)],
    *[f"coalesce(c{i} / nullif(cs, 0), 0.0)" for i in range(4)],
    *[f"coalesce(l{i} / nullif(ls, 0), 0.0)" for i in range(3)],
]

# Building blocks; a statement gets those it names, directly or through others.
CTES = {
    **VIEWS,
    "cells": _cells(),
    "cols(table_name, column_pos, column_name, data_type, type_class)": _COLUMNS,
    "prof": "select *, case when type_class = 'string'"
            " then lower(replace(replace(trim(v), chr(10), ''), chr(13), '')) else v end as p from cells",
    "row_counts": "select table_name, column_pos, count(*) as row_count, count(p) as non_null,"
                  " count(distinct p) as card, entropy(p) as ent from prof group by all",
    "vc": "select table_name, column_pos, p, any_value(num) as num, count(*) as n from prof"
          " where p is not null group by table_name, column_pos, p",
    "freq": "select table_name, column_pos, avg(n) as f_avg, min(n) as f_min, max(n) as f_max,"
            " stddev_pop(n) as f_sd, skewness(n) as skew, kurtosis(n) as kurt, "
            + ", ".join(f"quantile_disc(n, {i / 8}) as q{i}" for i in OCTILES)
            + " from vc group by table_name, column_pos",
    "word_rows": "select table_name, column_pos, list_transform(str_split(p, ' '), lambda s: length(s)) as ls,"
                 " length(p) - length(replace(p, ' ', '')) + 1 as words from prof where p is not null",
    "words": "select table_name, column_pos, max(list_max(ls)) as len_max, min(list_min(ls)) as len_min,"
             " avg(list_avg(ls)) as len_avg, sum(words) as w_sum, max(words) as w_max, min(words) as w_min,"
             " avg(words) as w_avg, stddev_pop(words) as w_sd from word_rows group by table_name, column_pos",
    "tops": "select * from (select table_name, column_pos, p, n, row_number() over (partition by table_name,"
            " column_pos order by n desc, num asc, p asc) as rank from vc) where rank <= 10",
    "top_lists": "select table_name, column_pos, string_agg(p, '|' order by rank) as top_values"
                 " from tops group by table_name, column_pos",
    "bounds": "select table_name, column_pos,"
              " coalesce(arg_min(p, num), min(p)) as first_word, coalesce(arg_max(p, num), max(p)) as last_word"
              " from vc group by table_name, column_pos",
    "raw_lengths": "select table_name, column_pos, min(length(v)) as val_len_min, max(length(v)) as val_len_max,"
                   " avg(length(v)) as val_len_avg from cells where type_class = 'string' and v is not null"
                   " group by table_name, column_pos",
    "raw_vc": "select table_name, column_pos, v, count(*) as n from cells where v is not null"
              " group by table_name, column_pos, v",
    "raw_entropy": "select table_name, column_pos, -sum(s * log2(s + 1e-10)) as text_entropy from"
                   " (select *, n / sum(n) over (partition by table_name, column_pos) as s from raw_vc)"
                   " group by table_name, column_pos",
    "profile": "select c.*, row_count, non_null, card as cardinality, round(ent, 9) as entropy,"
               " round(card / row_count, 9) as uniqueness, round((row_count - non_null) / row_count, 9) as incompleteness,"
               " round(f_avg, 9) as frequency_avg, f_min as frequency_min, f_max as frequency_max,"
               " round(f_sd, 9) as frequency_sd, round((q6 - q2) / row_count, 9) as frequency_iqr, "
               + ", ".join(f"round(q{i} / row_count, 9) as frequency_{i}qo" for i in OCTILES)
               + ", coalesce(case when isnan(skew) then 0 else round(skew, 9) end, 0) as skewness,"
               " coalesce(case when isnan(kurt) then 0 else round(kurt, 9) end, 0) as kurtosis,"
               " round(f_min / row_count, 9) as val_pct_min, round(f_max / row_count, 9) as val_pct_max,"
               " round(f_sd / row_count, 9) as val_pct_std, round(f_max / row_count, 9) as constancy,"
               " len_max as len_max_word, len_min as len_min_word, round(len_avg, 9) as len_avg_word,"
               " w_sum as number_words, w_max as words_cnt_max, w_min as words_cnt_min,"
               " round(w_avg, 9) as words_cnt_avg, round(w_sd, 9) as words_cnt_sd,"
               " top_values, first_word, last_word, 0 as is_empty, case when card = 2 then 1 else 0 end as is_binary,"
               " val_len_min, val_len_max, val_len_avg"
               " from cols c join row_counts using (table_name, column_pos) join freq using (table_name, column_pos)"
               " join words using (table_name, column_pos) join top_lists using (table_name, column_pos)"
               " join bounds using (table_name, column_pos)"
               " left join raw_lengths using (table_name, column_pos)",
    "roles": "select *, case when row_count > 0 then cardinality / row_count else 0 end as cardinality_ratio,"
             " type_class = 'string' and len_min_word = len_max_word and len_min_word > 0 as fixed_length, case"
             " when type_class = 'date' then 'TEMPORAL'"
             " when is_binary = 1 then 'FLAG'"
             " when uniqueness > 0.95 and type_class = 'numeric' then 'IDENTIFIER'"
             " when uniqueness > 0.95 and (len_avg_word > 30 or words_cnt_avg > 3) then 'FREE_TEXT'"
             " when uniqueness > 0.95 then 'JOIN_CODE'"
             " when type_class = 'numeric' and (val_pct_max > 0.3 or cardinality < 50) then 'CATEGORY'"
             " when type_class = 'numeric' then 'MEASURE'"
             " when len_min_word = len_max_word and len_min_word > 0 then 'JOIN_CODE'"
             " when val_pct_max > 0.3 or cardinality / row_count < 0.10 then 'CATEGORY'"
             " when len_avg_word > 30 or words_cnt_avg > 3 then 'FREE_TEXT'"
             " else 'FOREIGN_KEY_CANDIDATE' end as role from profile",
    "hist": "select table_name, "
            + ", ".join(f"count(*) filter (role = '{r}') as r{i}" for i, r in enumerate(_ROLES))
            + ", count(*) filter (cardinality_ratio <= 0.1) as c0,"
            " count(*) filter (cardinality_ratio > 0.1 and cardinality_ratio <= 0.5) as c1,"
            " count(*) filter (cardinality_ratio > 0.5 and cardinality_ratio <= 0.9) as c2,"
            " count(*) filter (cardinality_ratio > 0.9) as c3,"
            " count(*) filter (type_class = 'string' and len_avg_word <= 5) as l0,"
            " count(*) filter (type_class = 'string' and len_avg_word > 5 and len_avg_word <= 30) as l1,"
            " count(*) filter (type_class = 'string' and len_avg_word > 30) as l2,"
            " avg(incompleteness) as null_ratio"
            " from roles group by table_name",
    "shares": "select table_name, [" + ", ".join(_STRUCT) + "] as s from (select *,"
              " r0+r1+r2+r3+r4+r5+r6+r7 as rs, c0+c1+c2+c3 as cs, l0+l1+l2 as ls from hist)",
    "structs": "select table_name, list_transform(s, lambda x:"
               " x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) as sv from shares",
    "hashes": "select distinct table_name, column_pos,"
              " md5(lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g'))) as h from cells where v is not null",
    "sigs": "select table_name, column_pos, list(substring(h, 1, 16) order by h) filter (rn <= 128) as sig,"
            " count(*) as n from (select *, row_number() over (partition by table_name, column_pos order by h) as rn"
            " from hashes) group by table_name, column_pos",
    "join_cols": "select table_name, column_name, column_pos, role, sig, n, type_class as type,"
                 " len_min_word as len_min, len_max_word as len_max"
                 " from roles join sigs using (table_name, column_pos)"
                 " where role in ('JOIN_CODE', 'FOREIGN_KEY_CANDIDATE', 'CATEGORY')"
                 " and not (role = 'CATEGORY' and type_class = 'numeric')",
    "met": "select q.table_name as q_table, q.column_name as q_column, q.column_pos as q_pos,"
                " c.table_name as c_table, c.column_name as c_column, c.column_pos as c_pos,"
                " q.n as qn, c.n as cn, q.type as q_type, c.type as c_type,"
                " q.len_min as q_min, q.len_max as q_max, c.len_min as c_min, c.len_max as c_max,"
                " list_sort(list_distinct(list_concat(q.sig, c.sig)))[1:128] as u,"
                " list_intersect(q.sig, c.sig) as both_sigs"
                " from join_cols q join join_cols c on q.table_name <> c.table_name",
    "jaccards": "select *, len(list_intersect(u, both_sigs)) / len(u) as jac from met where len(both_sigs) > 0",
    "pairs": "select *, least(1.0, greatest(jac * (qn + cn) / (1.0 + jac) / qn, jac * (qn + cn) / (1.0 + jac) / cn))"
             " as containment,"
             " 0.5 + 0.5 * (case when greatest(q_max, c_max) - least(q_min, c_min) <= 0 then 1.0 else"
             " greatest(0, least(q_max, c_max) - greatest(q_min, c_min))"
             " / (greatest(q_max, c_max) - least(q_min, c_min)) end) as compat,"
             " case when q_type = c_type then 1.0 else 0.7 end as type_factor from jaccards where jac > 0",
    "scored": "select *, type_factor * compat as prior, containment * type_factor * compat as j from pairs",
    "best": "select * from (select *, row_number() over (partition by q_table, c_table, q_column"
            " order by j desc, c_pos) as choice from scored) where choice = 1",
    "ordered": "select *, row_number() over (partition by q_table, c_table order by j desc, q_pos) as r from best",
    "joins": "select q_table, c_table, 1 - product(1 - j) filter (r <= 3) as joinability,"
             " case when count(*) filter (j >= 0.5) > 0 then"
             " string_agg(q_column || ' ↔ ' || c_column || ' (' || printf('%.2f', j) || ')', '; ' order by r)"
             " filter (j >= 0.5) else"
             " string_agg(q_column || ' ↔ ' || c_column || ' (' || printf('%.2f', j) || ')', '; ') filter (r = 1)"
             " end as join_columns,"
             " count(*) filter (j >= 0.5) as n_join_keys,"
             " max(q_column) filter (r = 1) as best_query_column,"
             " max(c_column) filter (r = 1) as best_candidate_column"
             " from ordered group by q_table, c_table",
    "samples": _samples(),
    "sample_texts": "select table_name, 'Table Name: ' || table_name || chr(10) || 'Columns: ' || names || chr(10)"
                    " || 'Sample Data:' || chr(10) || rows_text as sample_text from"
                    " (select table_name, string_agg(column_name, ', ' order by column_pos) as names from cols"
                    " group by table_name) join (select table_name, string_agg(row_text, chr(10) order by h, row_text)"
                    " as rows_text from samples group by table_name) using (table_name)",
    "raw_tops": "select table_name, column_pos, string_agg(v, ', ' order by rk) as top from"
                " (select *, row_number() over (partition by table_name, column_pos order by n desc, v) as rk"
                " from raw_vc) where rk <= 10 group by table_name, column_pos",
    "described": "select c.*, row_number() over (partition by c.table_name, c.type_class order by c.column_pos) as nth,"
                 " c.column_name || coalesce(case when val_len_min = val_len_max then"
                 " ' (' || val_len_min || '-char values)' else"
                 " ' (' || val_len_min || '-' || val_len_max || ' char values)' end, '')"
                 " || coalesce(': ' || top, '') as label, coalesce(text_entropy, 0) as te"
                 " from cols c left join raw_lengths using (table_name, column_pos)"
                 " left join raw_tops using (table_name, column_pos)"
                 " left join raw_entropy using (table_name, column_pos)",
    "classes": "select table_name, count(*) as n, avg(te) as ent,"
               " count(*) filter (type_class = 'numeric') as nn, count(*) filter (type_class = 'string') as ns,"
               " count(*) filter (type_class = 'date') as nd,"
               " string_agg(column_name, ', ' order by column_pos) filter (type_class = 'numeric' and nth <= 3) as num_text,"
               " string_agg(label, '; ' order by column_pos) filter (type_class = 'string' and nth <= 3) as str_text,"
               " string_agg(column_name, ', ' order by column_pos) filter (type_class = 'date' and nth <= 3) as date_text"
               " from described group by table_name",
    "summaries": "select table_name, 'This dataset has ' || n || ' columns: ' || concat_ws('; ',"
                 " case when nn > 0 then nn || ' numeric column' || case when nn > 1 then 's' else '' end || ' (' ||"
                 " num_text || case when nn > 3 then ' and ' || (nn - 3) || ' more' else '' end || ')' end,"
                 " case when ns > 0 then ns || ' text column' || case when ns > 1 then 's' else '' end || ' (' ||"
                 " str_text || case when ns > 3 then ' and ' || (ns - 3) || ' more' else '' end || ')' end,"
                 " case when nd > 0 then nd || ' date column' || case when nd > 1 then 's' else '' end || ' (' ||"
                 " date_text || ')' end) || '. ' ||"
                 " case when ent > 4.0 then 'Columns have high entropy (many distinct values).'"
                 " when ent > 2.0 then 'Columns have moderate entropy.'"
                 " else 'Columns have low entropy (few dominant values).' end || ' ' ||"
                 " case when null_ratio < 0.02 then 'Data is complete.' when null_ratio < 0.2 then"
                 " 'Data has some missing values.' else 'Data is sparse with many missing values.' end as summary"
                 " from classes join hist using (table_name)",
    "texts": "select table_name, summary || chr(10) || chr(10) || sample_text as table_text"
             " from summaries join sample_texts using (table_name)",
    "tokens": "select table_name, unnest(regexp_extract_all(lower(table_text), '[a-z]+')) as token from texts",
    "bags": "select table_name, cast('0x' || right(md5(token), 4) as integer) % 384 as bucket, count(*) as tf"
            " from tokens group by table_name, bucket",
    "vecs": "select table_name, bucket, tf / sqrt(sum(tf * tf) over (partition by table_name)) as w from bags",
    "semantics": "select a.table_name as q_table, b.table_name as c_table, sum(a.w * b.w) as ts"
                 " from vecs a join vecs b on a.bucket = b.bucket and a.table_name <> b.table_name"
                 " group by a.table_name, b.table_name",
    "sims": "select a.table_name as q_table, b.table_name as c_table,"
            " coalesce(greatest(0, ts), 0) as ts, greatest(0, list_dot_product(a.sv, b.sv)) as ss"
            " from structs a join structs b on a.table_name <> b.table_name"
            " left join semantics s on s.q_table = a.table_name and s.c_table = b.table_name",
    "full_ranking": "select q_table as query_table, row_number() over (partition by q_table order by"
                    " similarity_score desc, c_table) as rank, * exclude (q_table) from"
                    " (select q_table, c_table, round(sqrt(coalesce(joinability, 0) * (0.7 * ts + 0.3 * ss)), 4)"
                    " as similarity_score, round(coalesce(joinability, 0), 4) as joinability_score,"
                    " round(ts, 4) as table_semantic, round(ss, 4) as struct_sim,"
                    " coalesce(join_columns, '') as join_columns, coalesce(n_join_keys, 0) as n_join_keys,"
                    " best_query_column, best_candidate_column"
                    " from sims left join joins using (q_table, c_table))",
}

_NAMES = {re.match(r"\w+", k).group(): k for k in CTES}


def with_ctes(body: str) -> str:
    """`body` preceded by the building blocks it needs, in order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"\w+", sql)):
            if word in _NAMES and word not in needed:
                needed.add(word)
                visit(CTES[_NAMES[word]])

    visit(body)
    parts = [f"{key} as ({CTES[key]})" for name, key in _NAMES.items() if name in needed]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
