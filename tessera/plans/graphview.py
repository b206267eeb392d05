"""The star schema read as a property graph: nodes, edges, commits, chunks.

A node id is the table's key times 8 plus the table's number, so ids of different tables never meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"REGION": 0, "NATION": 1, "CUSTOMER": 2, "SUPPLIER": 3, "PART": 4, "ORDER": 5}


def node_id(kind: str, key: str) -> Column:
    return (F.col(key).cast("long") * 8 + KINDS[kind]).alias(key)


class Tables:
    """The tables of one folder, read lazily by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        """(id, node_type, name, scope): scope is the id of the containing node."""
        none = F.lit(None).cast("long")
        rows = [
            self.region.select(node_id("REGION", "r_regionkey"), F.lit("REGION"), "r_name", none),
            self.nation.select(node_id("NATION", "n_nationkey"), F.lit("NATION"), "n_name", node_id("REGION", "n_regionkey")),
            self.customer.select(node_id("CUSTOMER", "c_custkey"), F.lit("CUSTOMER"), "c_name", node_id("NATION", "c_nationkey")),
            self.supplier.select(node_id("SUPPLIER", "s_suppkey"), F.lit("SUPPLIER"), "s_name", node_id("NATION", "s_nationkey")),
            self.part.select(node_id("PART", "p_partkey"), F.lit("PART"), "p_name", none),
            self.orders.select(node_id("ORDER", "o_orderkey"), F.lit("ORDER"), F.col("o_orderkey").cast("string"), node_id("CUSTOMER", "o_custkey")),
        ]
        return reduce(DataFrame.union, rows).toDF("id", "node_type", "name", "scope")

    @property
    def edges(self) -> DataFrame:
        """(src, dst, edge_type), each once: containment, customers on orders, orders on parts."""
        calls = self.lineitem.select(node_id("ORDER", "l_orderkey"), node_id("PART", "l_partkey"), F.lit("CALLS")).distinct()
        rows = [
            self.nation.select(node_id("REGION", "n_regionkey"), node_id("NATION", "n_nationkey"), F.lit("CONTAINS")),
            self.customer.select(node_id("NATION", "c_nationkey"), node_id("CUSTOMER", "c_custkey"), F.lit("CONTAINS")),
            self.supplier.select(node_id("NATION", "s_nationkey"), node_id("SUPPLIER", "s_suppkey"), F.lit("CONTAINS")),
            self.orders.select(node_id("CUSTOMER", "o_custkey"), node_id("ORDER", "o_orderkey"), F.lit("DEPENDS_ON")),
            calls,
        ]
        return reduce(DataFrame.union, rows).toDF("src", "dst", "edge_type")

    @property
    def touches(self) -> DataFrame:
        """(commit, ts, item) distinct: an order touches its parts."""
        items = self.lineitem.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("item")).distinct()
        return items.join(self.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts")), "commit")

    @property
    def trade(self) -> DataFrame:
        """(src, dst, weight): supplier nation to customer nation, by lines shipped."""
        line = self.lineitem.select("l_orderkey", "l_suppkey")
        owner = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("dst"))
        maker = self.supplier.select("s_suppkey", F.col("s_nationkey").alias("src"))
        joined = line.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).join(maker, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.groupBy("src", "dst").agg(F.count("*").alias("weight"))


#: The same views for DuckDB.
SQL_EDGES = """
edges as (
  select n_regionkey::bigint * 8 as src, n_nationkey::bigint * 8 + 1 as dst, 'CONTAINS' as edge_type from nation
  union all select c_nationkey::bigint * 8 + 1, c_custkey * 8 + 2, 'CONTAINS' from customer
  union all select s_nationkey::bigint * 8 + 1, s_suppkey * 8 + 3, 'CONTAINS' from supplier
  union all select o_custkey * 8 + 2, o_orderkey * 8 + 5, 'DEPENDS_ON' from orders
  union all select distinct l_orderkey * 8 + 5, l_partkey * 8 + 4, 'CALLS' from lineitem)
"""
SQL_NODES = """
nodes as (
  select r_regionkey::bigint * 8 as id, 'REGION' as node_type, r_name as name, null::bigint as scope from region
  union all select n_nationkey::bigint * 8 + 1, 'NATION', n_name, n_regionkey::bigint * 8 from nation
  union all select c_custkey * 8 + 2, 'CUSTOMER', c_name, c_nationkey::bigint * 8 + 1 from customer
  union all select s_suppkey * 8 + 3, 'SUPPLIER', s_name, s_nationkey::bigint * 8 + 1 from supplier
  union all select p_partkey * 8 + 4, 'PART', p_name, null from part
  union all select o_orderkey * 8 + 5, 'ORDER', o_orderkey::varchar, o_custkey * 8 + 2 from orders)
"""
SQL_TRADE = """
trade as (
  select s_nationkey as src, c_nationkey as dst, count(*) as weight
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  group by all)
"""
SQL_TOUCHES = """
touches as (select distinct l_orderkey as commit, o_orderdate as ts, l_partkey as item from lineitem join orders on l_orderkey = o_orderkey)
"""
