"""Pricing summary of shipped lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.sources import read_table

SHIPPED_BY = "2001-06-01"

ORACLE = f"""
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_quantity), 4) AS avg_qty,
       round(avg(l_discount), 4) AS avg_disc,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '{SHIPPED_BY} 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Sums and means per return flag and line status; one shuffle of a few partial rows per task."""
    price = F.col("l_extendedprice")
    return (
        read_table(spark, folder, "lineitem")
        .where(F.col("l_shipdate") <= F.lit(f"{SHIPPED_BY} 00:00:00").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base_price"),
            F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )
