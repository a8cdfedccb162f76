"""Relational queries over the order tables: joins, aggregates, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import Registry, table

R = Registry()
MONEY = "decimal(18,4)"


def _money(e):
    return F.sum(e.cast(MONEY)).cast("double")


@R.add(
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_base,
    CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(_money(F.col("l_quantity")).alias("sum_qty"), _money(F.col("l_extendedprice")).alias("sum_base"), _money(price).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


@R.add(
    """SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name"""
)
def local_suppliers(spark, sf_dir):
    t = lambda n, *c: table(spark, sf_dir, n, *c)
    sold = t("customer", "c_custkey", "c_nationkey").join(t("orders", "o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    sold = sold.join(t("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(t("supplier", "s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    sold = sold.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region", "r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sold.groupBy("n_name").agg(_money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@R.add(
    """SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 5"""
)
def top_orders(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey", "o_totalprice").withColumn("rank", rank).where("rank <= 5").drop("o_totalprice")


@R.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def customers_without_urgent_orders(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


QUERIES, ORACLE = R.queries, R.oracle
