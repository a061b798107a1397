"""The graph that queries run on, derived from the given tables; the same text makes it in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "supplier", "part", "customer", "orders", "lineitem")

CONCEPTS = """
SELECT concat('region:', r_regionkey) AS id, 'shared' AS store, 'geo' AS scope, 'Cluster' AS type, r_name AS title, CAST(NULL AS VARCHAR(99)) AS description, 'active' AS status, CAST(NULL AS TIMESTAMP) AS updated_at, TRUE AS curated, CAST(NULL AS VARCHAR(99)) AS source_name FROM {region}
UNION ALL SELECT concat('nation:', n_nationkey), 'shared', 'geo', 'Nation', n_name, NULL, CASE WHEN n_nationkey % 17 = 0 THEN 'tombstone' ELSE 'active' END, NULL, n_nationkey % 2 = 0, NULL FROM {nation}
UNION ALL SELECT concat('supplier:', s_suppkey), 'shared', 'catalog', 'Supplier', s_name, NULL, CASE WHEN s_suppkey % 17 = 0 THEN 'tombstone' ELSE 'active' END, NULL, s_suppkey % 3 = 0, 'erp' FROM {supplier}
UNION ALL SELECT concat('part:', p_partkey), 'shared', 'catalog', 'Part', p_name, p_type, CASE WHEN p_partkey % 17 = 0 THEN 'tombstone' ELSE 'active' END, NULL, p_partkey % 5 = 0, 'erp' FROM {part}
UNION ALL SELECT concat('customer:', c_custkey), 'personal', 'sales', 'Customer', c_name, c_mktsegment, CASE WHEN c_custkey % 17 = 0 THEN 'tombstone' ELSE 'active' END, NULL, FALSE, 'crm' FROM {customer}
UNION ALL SELECT concat('order:', o_orderkey), 'personal', 'sales', 'Order', concat('order ', o_orderkey), o_orderpriority, 'active', CAST(o_orderdate AS TIMESTAMP), FALSE, 'crm' FROM {orders}
"""
EDGES = """
SELECT 'shared' AS from_store, concat('region:', n_regionkey) AS from_id, 'shared' AS to_store, concat('nation:', n_nationkey) AS to_id, 'member' AS kind, CAST(1 AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS confidence, FALSE AS generated, CAST(NULL AS VARCHAR(99)) AS generated_by, TRUE AS curated, CAST(NULL AS TIMESTAMP) AS verified_at, TIMESTAMP '1992-01-01 00:00:00' AS created_at FROM {nation}
UNION ALL SELECT 'shared', concat('supplier:', s_suppkey), 'shared', concat('nation:', s_nationkey), 'related', CAST(1 AS DOUBLE), CAST(s_suppkey % 100 AS DOUBLE) / 100, TRUE, 'clustering', s_suppkey % 4 = 0, CASE WHEN s_suppkey % 6 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' END, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '1996-01-01 00:00:00' ELSE TIMESTAMP '1997-01-01 00:00:00' END FROM {supplier}
UNION ALL SELECT 'personal', concat('customer:', c_custkey), 'shared', concat('nation:', CASE WHEN c_custkey % 13 = 0 THEN 1000 + c_nationkey ELSE c_nationkey END), 'references', CAST(1 AS DOUBLE), NULL, FALSE, 'source_ref', FALSE, NULL, TIMESTAMP '1993-01-01 00:00:00' FROM {customer}
UNION ALL SELECT 'personal', concat('order:', o_orderkey), 'personal', concat('customer:', o_custkey), 'references', CAST(1 AS DOUBLE), NULL, FALSE, 'body_ref', FALSE, NULL, CAST(o_orderdate AS TIMESTAMP) FROM {orders}
UNION ALL SELECT 'personal', concat('order:', l_orderkey), 'shared', concat('part:', l_partkey), 'depends_on', CAST(count(*) AS DOUBLE), CAST((l_orderkey + l_partkey) % 100 AS DOUBLE) / 100, TRUE, 'relations', l_partkey % 10 = 0, NULL, CAST(max(l_shipdate) AS TIMESTAMP) FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'shared', concat('part:', l_partkey), 'shared', concat('supplier:', l_suppkey), 'implements', CAST(count(*) AS DOUBLE), CAST((l_suppkey + l_partkey) % 100 AS DOUBLE) / 100, TRUE, 'relations', l_partkey % 7 = 0, NULL, CAST(max(l_shipdate) AS TIMESTAMP) FROM {lineitem} GROUP BY l_partkey, l_suppkey
"""


#: Lines of orders, the largest table, for each partition that shuffles of the graph begin with.
ROWS = 250_000


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and edges as DataFrames; only the columns that a query uses are read.

    Shuffles of the session begin with partitions by the size of the graph (at least as many as its setting says), which Spark joins where
    they are small: with a fixed number, the memory of a task would grow with the tables.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tables["lineitem"].count() // ROWS + 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    used = lambda text: {t: df for t, df in tables.items() if "{" + t + "}" in text}
    return spark.sql(CONCEPTS, **used(CONCEPTS)), spark.sql(EDGES, **used(EDGES))


def oracle(query: str) -> str:
    """DuckDB text with the graph in front of a query."""
    names = {t: t for t in TABLES}
    return f"WITH RECURSIVE concepts AS ({CONCEPTS.format(**names)}), edges AS ({EDGES.format(**names)}){query}"
