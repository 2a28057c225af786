"""Beyond the reference: what Spark brings along, over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klangsieb.plans.catalog import query, table

_DEC = "decimal(18,4)"


def _money(c):
    return F.round(F.sum(c.cast(_DEC)), 2).cast("double")


@query(
    "pricing_summary",
    "select l_returnflag, l_linestatus, sum(l_quantity) as quantity, round(sum((l_extendedprice * (1 - l_discount))::decimal(18,4)), 2)::double as revenue, round(avg(l_discount), 6) as discount, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
)
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), _money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query(
    "revenue_by_nation",
    "select n_name, round(sum((l_extendedprice * (1 - l_discount))::decimal(18,4)), 2)::double as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1",
)
def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    t = {n: table(spark, folder, n) for n in ("lineitem", "orders", "customer", "supplier", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    j = j.join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"].where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(_money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("rollup_counts", "select l_returnflag, l_linestatus, count(*) as n, grouping(l_linestatus)::int as level from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_linestatus").cast("int").alias("level"))


@query("cube_counts", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("approximate_distinct")
def approximate_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("hourly_windows", "select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def hourly_windows(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("w.start").alias("hour"), "n", "total")
