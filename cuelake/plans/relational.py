"""Generic relational primitives over the star-schema tables: joins, aggregates, windows and sets as Spark has them. No counterpart in the cue domain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.plans import fixtures as X
from cuelake.plans.registry import query


@query("primitive_j1_inner_join", "SELECT n_name, count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def primitive_j1_inner_join(spark, sf_dir):
    t = lambda n: X.table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("primitive_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, min(l_shipdate)::VARCHAR AS first_ship, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def primitive_aggregates(spark, sf_dir):
    return X.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min("l_shipdate").cast("string").alias("first_ship"), F.countDistinct("l_partkey").alias("parts"))


@query("primitive_left_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def primitive_left_anti(spark, sf_dir):
    return X.table(spark, sf_dir, "customer").join(X.table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("primitive_top_k_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def primitive_top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return X.table(spark, sf_dir, "customer").withColumn("_n", F.row_number().over(w)).filter("_n <= 3").select("c_nationkey", "c_custkey")


@query("primitive_rollup", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def primitive_rollup(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("primitive_running_total", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS nth FROM orders")
def primitive_running_total(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return X.table(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(w).alias("nth"))
