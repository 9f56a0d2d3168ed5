"""The star schema on the given tables, as DataFrames and, for the oracles, as the same rules in SQL.

Bookings are orders, crew days and merchandise lines are line items, sessions are events; currencies, rates, refunds
and advertising spend follow from keys and dates by the rules written here. Money is decimal from the scan on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import day_number, num, quarter, ratio
from siltstone.operators.temporal import FOREVER, join_valid, repair_scd2
from siltstone.sources.tables import table

__all__ = ["ad_spend", "bookings", "crew_days", "day_number", "fx_daily", "live", "merch_lines", "num", "price_versions", "quarter", "ratio", "sessions"]

MONEY = "decimal(18,2)"
CHANNELS = ("click", "view", "error", "purchase", "signup")
BASE_DATE = "1997-01-01"


def fx_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(currency, rate_date, rate): local units for one of the currency, for every day from the first to the last order and
    the base date."""
    base = F.lit(BASE_DATE).cast("date")
    day = F.col("o_orderdate").cast("date")
    span = table(spark, sf_dir, "orders").agg(F.least(F.min(day), base).alias("a"), F.greatest(F.max(day), base).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("rate_date"))
    rate = F.when(F.col("currency") == "USD", 700 + day_number(F.col("rate_date")) % 100).when(F.col("currency") == "GBP", 900 + day_number(F.col("rate_date")) % 120).otherwise(1)
    return days.withColumn("currency", F.explode(F.array(F.lit("NGN"), F.lit("USD"), F.lit("GBP")))).select("currency", "rate_date", rate.cast("decimal(14,6)").alias("rate"))


def bookings(spark: SparkSession, sf_dir: str, client: bool = True) -> DataFrame:
    """One row per order. client: with the columns that come from its customer, currency and lead_source; without them
    nothing is joined."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Confirmed").otherwise("Cancelled")
    currency = F.when(F.col("c_nationkey") % 3 == 0, "NGN").when(F.col("c_nationkey") % 3 == 1, "USD").otherwise("GBP")
    own = [
        F.col("o_orderkey").alias("booking_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("date").alias("shoot_date"), F.col("o_orderpriority").alias("service"),
        status.alias("status"), F.col("o_totalprice").cast(MONEY).alias("net"), (F.col("o_orderstatus") == "P").alias("is_cancelled"),
    ]
    if not client:
        return orders.select(*own)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(*own, currency.alias("currency"), F.col("c_mktsegment").alias("lead_source"))


def crew_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per timesheet line; a missing charged rate is replaced by the roster's and marked."""
    line = table(spark, sf_dir, "lineitem")
    standard = (2000 + F.col("l_suppkey") % 7 * 100).cast("long")
    charged = F.when(F.col("l_linenumber") % 4 != 0, standard * (1 + F.col("l_linenumber") % 3))
    return line.select(
        F.col("l_orderkey").alias("booking_id"), F.col("l_suppkey").alias("crew_id"), F.col("l_shipdate").cast("date").alias("work_date"),
        F.concat(F.lit("role"), (F.col("l_suppkey") % 5).cast("string")).alias("role"), (F.col("l_quantity") / 2).alias("hours"),
        standard.alias("standard_rate"), charged.alias("charged_rate"), F.coalesce(charged, standard).cast(MONEY).alias("labour_cost"),
        charged.isNull().alias("rate_is_estimated"), (F.col("l_linenumber") % 3 == 2).alias("overtime"),
    )


def price_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three price versions per part: some overlap, some leave a gap, some are inverted, some are closed at the end."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").cast(MONEY).alias("price"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("version"))
    day = lambda n: F.date_add(F.lit("1995-01-01").cast("date"), n.cast("int"))
    lo = day(F.col("version") * 900)
    end = F.when(F.col("sku") % 5 == 1, 930).when(F.col("sku") % 5 == 2, 880).otherwise(899)
    hi = F.when((F.col("version") == 2) & (F.col("sku") % 3 != 0), F.lit(None)).when((F.col("version") == 1) & (F.col("sku") % 5 == 4), F.lit(None)).otherwise(day(F.col("version") * 900 + end))
    inverted = (F.col("sku") % 7 == 0) & (F.col("version") == 0)
    return p.select("sku", "version", (F.col("price") + F.col("version") * 10).cast(MONEY).alias("list_price"), F.when(inverted, hi).otherwise(lo).alias("valid_from"), F.when(inverted, lo).otherwise(hi).alias("valid_to"))


def merch_lines(spark: SparkSession, sf_dir: str, priced: bool = True, by_sku: bool = False) -> DataFrame:
    """One row per order line with its measures. priced: with the columns cogs, list_value and version, which are those of the
    price version in force on its day (null if there is none); without them no version is joined. by_sku: dealt by sku, for what
    groups the lines by it."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    gross, quantity = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast("int")
    refund = F.when(F.col("l_returnflag") == "R", F.round(gross * F.lit("0.30").cast("decimal(4,2)"), 2)).otherwise(0).cast(MONEY)
    known = part.select("p_partkey", "p_brand")
    # versions are met by part as well, so one shuffle of the lines serves both joins
    sold = line.join(known.hint("shuffle_hash") if priced or by_sku else known, F.col("l_partkey") == F.col("p_partkey")).withColumn("__day", F.col("l_shipdate").cast("date"))
    own = [
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("sku"), F.col("p_brand").alias("collection"),
        F.col("__day").alias("order_date"), quantity.alias("quantity"), gross.alias("gross"), F.round(gross * F.col("l_discount").cast("decimal(5,4)"), 2).cast(MONEY).alias("discount"),
        refund.alias("refunded"), F.concat(F.lit("reason"), (F.col("l_suppkey") % 4).cast("string")).alias("reason"),
        (F.col("l_returnflag") == "R").alias("has_refund"), (F.col("l_linestatus") == "F").alias("is_revenue"),
        F.when(F.col("l_linenumber") % 5 == 0, "pending").when(F.col("l_linenumber") % 5 == 1, "cancelled").otherwise("shipped").alias("order_status"),
    ]
    if not priced:
        return sold.select(*own)
    cost = F.round(F.col("list_price") * F.lit("0.60").cast("decimal(4,2)"), 2).cast(MONEY)
    versions = repair_scd2(price_versions(spark, sf_dir), "sku").select(F.col("sku").alias("p_partkey"), "version", "list_price", cost.alias("__cost"), "valid_from", "valid_to")
    return join_valid(sold, versions, "p_partkey", "__day").select(*own, (F.col("__cost") * quantity).cast(MONEY).alias("cogs"), (F.col("list_price") * quantity).cast(MONEY).alias("list_value"), "version")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; spam is part of bot traffic; order ids may not exist."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("session_id"), F.col("user_id").alias("client_id"), F.col("ts").cast("date").alias("session_date"), F.col("ts").alias("ts"),
        F.col("event_type").alias("channel"), (F.col("event_id") % 17 == 0).alias("is_bot"), (F.col("event_id") % 34 == 0).alias("is_spam"),
        (F.col("event_type") == "purchase").alias("converted"), F.when(F.col("event_type") == "purchase", F.col("event_id") * 3).alias("order_id"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0).cast(MONEY).alias("revenue"),
    )


def ad_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day, channel and campaign; only two channels are paid."""
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("spend_date")).distinct()
    d = F.dayofmonth("spend_date")
    rows = days.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "spend_date", F.when(F.col("c") == 2, "display").otherwise(F.element_at(F.array(F.lit("click"), F.lit("view")), F.least(F.col("c"), F.lit(1)) + 1)).alias("channel"),
        F.concat(F.lit("campaign"), ((d + F.col("c")) % 4).cast("string")).alias("campaign"),
        (1000 + d * 7 + F.col("c") * 50).cast("long").alias("impressions"), (20 + d % 5 + F.col("c")).cast("long").alias("clicks"), (50 + d + F.col("c") * 10).cast(MONEY).alias("spend"),
    )
    return rows


def live(df: DataFrame) -> DataFrame:
    """Bookings that are not cancelled."""
    return df.filter(~F.col("is_cancelled"))


#: The same rules in SQL; the oracles put them in front of their own SELECT.
CORE_SQL = f"""
WITH RECURSIVE fx AS (
  SELECT c AS currency, d::DATE AS rate_date,
    (CASE c WHEN 'USD' THEN 700 + (d::DATE - DATE '1970-01-01') % 100 WHEN 'GBP' THEN 900 + (d::DATE - DATE '1970-01-01') % 120 ELSE 1 END)::DECIMAL(14,6) AS rate
  FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY) t(d), (VALUES ('NGN'), ('USD'), ('GBP')) v(c)),
booking AS (
  SELECT o_orderkey AS booking_id, o_custkey AS client_id, o_orderdate::DATE AS shoot_date, o_orderpriority AS service,
    CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Confirmed' ELSE 'Cancelled' END AS status,
    CASE c_nationkey % 3 WHEN 0 THEN 'NGN' WHEN 1 THEN 'USD' ELSE 'GBP' END AS currency, c_mktsegment AS lead_source,
    o_totalprice::DECIMAL(18,2) AS net, o_orderstatus = 'P' AS is_cancelled
  FROM orders JOIN customer ON o_custkey = c_custkey),
live AS (SELECT * FROM booking WHERE NOT is_cancelled),
version_raw AS (SELECT p_partkey AS sku, r AS version, (p_retailprice::DECIMAL(18,2) + r * 10)::DECIMAL(18,2) AS list_price, DATE '1995-01-01' + (r * 900)::INT AS lo,
  CASE WHEN r = 2 AND p_partkey % 3 <> 0 THEN NULL WHEN r = 1 AND p_partkey % 5 = 4 THEN NULL ELSE DATE '1995-01-01' + (r * 900 + CASE p_partkey % 5 WHEN 1 THEN 930 WHEN 2 THEN 880 ELSE 899 END)::INT END AS hi, p_partkey % 7 = 0 AND r = 0 AS inv FROM part, range(3) t(r)),
version AS (SELECT sku, version, list_price, lo AS valid_from, coalesce(lead(lo) OVER (PARTITION BY sku ORDER BY lo) - 1, DATE '{FOREVER}') AS valid_to FROM version_raw),
crew_day AS (
  SELECT l_orderkey AS booking_id, l_suppkey AS crew_id, l_shipdate::DATE AS work_date, 'role' || (l_suppkey % 5)::VARCHAR AS role,
    l_quantity / 2 AS hours, 2000 + l_suppkey % 7 * 100 AS standard_rate,
    CASE WHEN l_linenumber % 4 <> 0 THEN (2000 + l_suppkey % 7 * 100) * (1 + l_linenumber % 3) END AS charged_rate,
    coalesce(CASE WHEN l_linenumber % 4 <> 0 THEN (2000 + l_suppkey % 7 * 100) * (1 + l_linenumber % 3) END, 2000 + l_suppkey % 7 * 100)::DECIMAL(18,2) AS labour_cost,
    l_linenumber % 4 = 0 AS rate_is_estimated, l_linenumber % 3 = 2 AS overtime
  FROM lineitem),
line AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS sku, p_brand AS collection, l_shipdate::DATE AS order_date, l_quantity::INT AS quantity,
    l_extendedprice::DECIMAL(18,2) AS gross, round(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(5,4), 2)::DECIMAL(18,2) AS discount,
    (round(list_price * 0.60::DECIMAL(4,2), 2)::DECIMAL(18,2) * l_quantity::INT)::DECIMAL(18,2) AS cogs, (list_price * l_quantity::INT)::DECIMAL(18,2) AS list_value, version,
    (CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice::DECIMAL(18,2) * 0.30::DECIMAL(4,2), 2) ELSE 0 END)::DECIMAL(18,2) AS refunded,
    'reason' || (l_suppkey % 4)::VARCHAR AS reason, l_returnflag = 'R' AS has_refund, l_linestatus = 'F' AS is_revenue,
    CASE l_linenumber % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'cancelled' ELSE 'shipped' END AS order_status
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN version ON sku = l_partkey AND l_shipdate::DATE BETWEEN valid_from AND valid_to),
session AS (
  SELECT event_id AS session_id, user_id AS client_id, ts::DATE AS session_date, ts, event_type AS channel, event_id % 17 = 0 AS is_bot, event_id % 34 = 0 AS is_spam,
    event_type = 'purchase' AS converted, CASE WHEN event_type = 'purchase' THEN event_id * 3 END AS order_id,
    (CASE WHEN event_type = 'purchase' THEN value ELSE 0 END)::DECIMAL(18,2) AS revenue
  FROM events),
spend AS (
  SELECT d AS spend_date, CASE c WHEN 2 THEN 'display' WHEN 0 THEN 'click' ELSE 'view' END AS channel, 'campaign' || ((day(d) + c) % 4)::VARCHAR AS campaign,
    1000 + day(d) * 7 + c * 50 AS impressions, 20 + day(d) % 5 + c AS clicks, (50 + day(d) + c * 10)::DECIMAL(18,2) AS spend
  FROM (SELECT DISTINCT ts::DATE AS d FROM events), (VALUES (0), (1), (2)) v(c))
"""
