"""Revenue questions on orders (production) and line items (merchandise)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import quarter
from siltstone.sources.tables import table


def q01_quarterly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and line revenue side by side per quarter that either has. Rows are added up by day, lines also by discount, before
    a quarter or a discounted amount is computed, so both tables are read once."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_discount").agg(price)
    per_order = orders.select(quarter("day").alias("quarter"), F.col("amount").alias("order_revenue"))
    per_line = lines.select(quarter("day").alias("quarter"), (F.col("price") * (1 - F.col("l_discount").cast("decimal(6,4)"))).alias("line_revenue"))
    both = per_order.unionByName(per_line, allowMissingColumns=True).groupBy("quarter").agg(F.sum("order_revenue").alias("order_revenue"), F.sum("line_revenue").alias("line_revenue"))
    # rows without a day have no revenue in any quarter
    total = lambda c: F.round(F.coalesce(F.when(F.col("quarter").isNotNull(), F.col(c)), F.lit(0)), 2).cast("decimal(20,2)").cast("double").alias(c)
    return both.select("quarter", total("order_revenue"), total("line_revenue"))


QUERIES = {"q01_quarterly_revenue": q01_quarterly_revenue}

ORACLES = {
    "q01_quarterly_revenue": """
WITH o AS (
  SELECT year(o_orderdate)::VARCHAR || 'Q' || quarter(o_orderdate)::VARCHAR AS quarter,
         sum(o_totalprice::DECIMAL(18,2)) AS order_revenue FROM orders GROUP BY 1),
l AS (
  SELECT year(l_shipdate)::VARCHAR || 'Q' || quarter(l_shipdate)::VARCHAR AS quarter,
         sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(6,4))) AS line_revenue FROM lineitem GROUP BY 1),
s AS (SELECT quarter FROM o UNION SELECT quarter FROM l)
SELECT quarter, round(coalesce(order_revenue, 0), 2)::DOUBLE AS order_revenue,
       round(coalesce(line_revenue, 0), 2)::DOUBLE AS line_revenue
FROM s LEFT JOIN o USING (quarter) LEFT JOIN l USING (quarter)
"""
}
