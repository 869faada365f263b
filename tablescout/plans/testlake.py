"""The lake the registered queries run on: all given tables, and views over whole given tables.

The raw tables share almost no text values, so the views bring renamed keys, NULLs, values in another
case and keys of varying length. Their SQL is valid in Spark and in DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "customer_contacts": (
        "select c_custkey, c_name as contact, c_acctbal,"
        " case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as segment from customer"
    ),
    "documents_labelled": (
        "select d.doc_id, d.lang, d.source, d.n_chars, l.quality"
        " from documents d left join labels l on d.doc_id = l.doc_id"
    ),
    "events_kinds": "select event_id, upper(event_type) || '  ' as kind, props from events",
    "nation_region": "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey",
    "orders_filled": (
        "select o_orderkey, c_name as buyer, o_totalprice, o_orderdate"
        " from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'"
    ),
    "orders_urgent": (
        "select o_orderkey, c_name as customer, c_mktsegment as market, o_orderpriority"
        " from orders join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'"
    ),
    "part_list": (
        "select 'sku-' || cast(p_partkey as string) as item, p_type, p_retailprice from part"
        " where p_retailprice < 1500"
    ),
    "part_sku": "select 'SKU-' || cast(p_partkey as string) as sku, p_name, p_brand, p_size from part",
    "supplier_nation": (
        "select s_suppkey, s_name, n_name as country, s_acctbal from supplier join nation"
        " on s_nationkey = n_nationkey"
    ),
}


def lake_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in RAW_TABLES}
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    return {**tables, **{name: spark.sql(sql) for name, sql in VIEWS.items()}}
