"""Queries of the split and repair operators: known rows are damaged by a rule on their key, and found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import split as S
from siltstone.plans.core import MONEY, num
from siltstone.sources.tables import table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").cast(MONEY).alias("price"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast(MONEY).alias("price"), "o_orderpriority")


def d1_exact_duplicates(spark, sf_dir):
    """Orders doubled where the key is divisible by 50; by reason, rows and the price of the copies."""
    o = _orders(spark, sf_dir).withColumn("_row", F.col("o_orderkey") * 2)
    raw = o.unionByName(o.filter("o_orderkey % 50 = 0").withColumn("_row", F.col("_row") + 1))
    kept, gone = S.split_exact_duplicates(raw, ["o_orderkey", "o_custkey", "day", "price", "o_orderpriority"], "_row")
    return kept.select(F.lit("kept").alias("part"), "o_orderkey", "price", F.lit(None).cast("string").alias("detail")).unionByName(gone.select(F.lit("rejected").alias("part"), "o_orderkey", "price", F.col("_detail").alias("detail"))).select("part", "o_orderkey", num(F.col("price")).alias("price"), "detail")


def d2_content_duplicates(spark, sf_dir):
    """Copies that differ in the priority alone blank it."""
    o = _orders(spark, sf_dir).withColumn("_row", F.col("o_orderkey") * 2)
    copies = o.filter("o_orderkey % 40 = 0").withColumns({"_row": F.col("_row") + 1, "o_orderpriority": F.when(F.col("o_orderkey") % 80 == 0, F.lit("other")).otherwise(F.col("o_orderpriority"))})
    kept, gone = S.split_content_duplicates(o.unionByName(copies), ["o_orderkey", "o_custkey", "day", "price"], "o_orderpriority", "_row")
    a = kept.select("o_orderkey", "o_orderpriority", "soft_conflict", F.lit(None).cast("string").alias("reason"))
    return a.unionByName(gone.select("o_orderkey", "o_orderpriority", F.lit(None).cast("boolean").alias("soft_conflict"), F.col("_reason").alias("reason")))


def d8_disambiguated_keys(spark, sf_dir):
    """Order and line number made unique by suffixes."""
    keyed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"))
    return S.disambiguate_key(keyed, "k", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "line_key").select("line_key", "l_partkey", "l_suppkey", "l_quantity")


def d11_grain(spark, sf_dir):
    """Line keys that are not unique."""
    return S.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def r1_orphans(spark, sf_dir):
    """Lines whose order key was shifted out of range go to quarantine; rows in less kept and rejected ones by line
    number, where some kept rows were lost afterwards."""
    raw = _lines(spark, sf_dir).withColumn("o_orderkey", F.when(F.col("l_partkey") % 37 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")))
    kept, gone = S.split_orphans(raw, table(spark, sf_dir, "orders"), ["o_orderkey"])
    return S.row_accounting(raw, kept.filter("l_orderkey % 503 <> 0"), gone, "l_linenumber")


def s9_quarantine(spark, sf_dir):
    """The payload of rejected orphans read back by JSON path."""
    raw = _lines(spark, sf_dir).withColumn("o_orderkey", F.when(F.col("l_partkey") % 37 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")))
    gone = S.split_orphans(raw, table(spark, sf_dir, "orders"), ["o_orderkey"])[1]
    q = S.quarantine(gone, "lineitem", ["o_orderkey", "l_linenumber", "l_partkey", "price"])
    read = lambda k, t: F.get_json_object("payload", f"$.{k}").cast(t)
    return q.select("src_table", "reason", read("o_orderkey", "long").alias("o_orderkey"), read("l_partkey", "long").alias("l_partkey"), num(read("price", MONEY)).alias("price"))


def r2_sibling_repair(spark, sf_dir):
    """R2: lines whose supplier is unknown take the only known one of their order."""
    raw = _lines(spark, sf_dir).withColumn("s_suppkey", F.when(F.col("l_partkey") % 11 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_orderkey") % 90))
    kept, gone = S.repair_from_siblings(raw, "l_orderkey", "s_suppkey", table(spark, sf_dir, "supplier").select("s_suppkey"))
    a = kept.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("repaired").alias("repaired"))
    return a.unionByName(gone.groupBy(F.lit(None).cast("long").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("repaired")))


def r3_sentinels(spark, sf_dir):
    """Quantity 9999 goes, negative ones are kept and flagged."""
    q = F.when(F.col("l_partkey") % 41 == 0, 9999).when(F.col("l_partkey") % 43 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    kept, gone = S.split_sentinel(_lines(spark, sf_dir).withColumn("l_quantity", q), "l_quantity", 9999)
    flagged = S.flag(kept, [(F.col("l_quantity") < 0, "negative_quantity"), (F.col("l_quantity") > 45, "large_quantity")])
    counts = S.flag_counts(flagged)
    return counts.unionByName(gone.groupBy(F.col("_reason").alias("flag")).agg(F.count(F.lit(1)).alias("n")))


def r4_cascade(spark, sf_dir):
    """Orders all of whose lines were rejected."""
    lines = _lines(spark, sf_dir)
    kept, gone = lines.filter("l_partkey % 3 <> 0"), lines.filter("l_partkey % 3 = 0")
    orders = _orders(spark, sf_dir).withColumnRenamed("o_orderkey", "l_orderkey")
    stay, go = S.split_cascade(orders, kept, gone, ["l_orderkey"])
    return go.select("l_orderkey", F.col("_reason").alias("reason"), num(F.col("price")).alias("price"))


def quarantined(spark, sf_dir):
    """Rejected rows of two tables in the shape of the quarantine."""
    lines = _lines(spark, sf_dir)
    a = S.quarantine(S.rejected(lines.filter("l_partkey % 37 = 0"), "orphan"), "lineitem", ["l_orderkey", "price"])
    b = S.quarantine(S.rejected(lines.filter("l_partkey % 41 = 0"), "sentinel quantity"), "lineitem", ["l_orderkey", "price"])
    c = S.quarantine(S.rejected(_orders(spark, sf_dir).filter("o_orderkey % 50 = 0"), "exact duplicate"), "orders", ["o_orderkey", "price"])
    return a.unionByName(b).unionByName(c)


def r6_value_at_risk(spark, sf_dir):
    """Quarantined rows of two tables by table and reason, with the value at risk and sub-totals."""
    out = S.value_rejected(quarantined(spark, sf_dir), "price", ["orphan", "sentinel quantity"])
    return out.withColumn("at_risk", num(F.col("at_risk")))


def q13_rejected_rows(spark, sf_dir):
    """Q13: rejected rows by table and reason with the value at risk, their share of all rejected rows, and the grand total."""
    out = S.value_rejected(quarantined(spark, sf_dir), "price", ["orphan", "sentinel quantity"]).filter("level <> 1")
    everything = F.max(F.when(F.col("level") == 3, F.col("n_rows"))).over(Window.partitionBy())
    return out.select(F.coalesce("src_table", F.lit("all")).alias("src_table"), "reason", "n_rows", num(F.coalesce("at_risk", F.lit(0))).alias("at_risk"), "affects_revenue", F.round(F.col("n_rows") / everything, 6).alias("share"))


def r7_status_from_absence(spark, sf_dir):
    """Orders without a status and without lines are cancelled."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.infer_status(o, lines, ["o_orderkey"], "status", "Cancelled").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def r8_fill_from(spark, sf_dir):
    """A blank nation is filled from the customer's orders where they agree; agreement with the truth."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("nation"))
    ref = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.when((F.col("o_orderkey") % 10 == 0) & (F.col("c_custkey") % 8 == 0), F.lit(99)).otherwise(F.col("c_nationkey")).alias("nation"))
    filled = S.fill_from(c, ref, "c_custkey", "nation")
    return S.agreement(filled, "nation", "c_nationkey").crossJoin(filled.agg(F.count_if("nation_filled").alias("filled")))


def r9_proven_rule(spark, sf_dir):
    """The segment's first letter as a class, filled by its rule where the rule gives every known value; and the same
    with known values that break the rule, which is then not used."""
    rule = F.substring("c_mktsegment", 1, 1)
    known = F.when(F.col("c_custkey") % 5 != 0, rule)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", known.alias("class"))
    broken = c.withColumn("class", F.when((F.col("c_custkey") % 97 == 1) & F.col("class").isNotNull(), F.lit("?")).otherwise(F.col("class")))
    told = lambda df, name: S.fill_if_rule_proven(df, "class", rule).select(F.lit(name).alias("rule"), "c_custkey", "class", "rule_violations")
    return told(c, "proven").unionByName(told(broken, "broken"))


def r10_constant_in_group(spark, sf_dir):
    """A part's blank size is filled within its brand and type where all others agree."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("g"), F.when(F.col("p_partkey") % 3 != 0, F.length("p_brand")).alias("size"))
    return S.fill_constant_in_group(p, "g", ["size"])


def r12_parent_names(spark, sf_dir):
    """Product names on lines forced to the product's; mismatches by brand."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    raw = _lines(spark, sf_dir).join(part, "l_partkey").withColumn("p_name", F.when(F.col("l_orderkey") % 9 == 0, F.lit("typo")).when(F.col("l_orderkey") % 9 == 1, F.upper("p_name")).otherwise(F.col("p_name")))
    return S.conform_to_parent(raw, part, "l_partkey", "p_name").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("p_name_mismatch").alias("mismatches"))


def r13_negative_lines(spark, sf_dir):
    """Evidence about lines with negative quantity."""
    raw = _lines(spark, sf_dir).withColumn("l_partkey", F.col("l_partkey") % 5).withColumn("q", F.when(F.col("l_suppkey") % 13 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")))
    return S.negative_line_evidence(raw, "l_orderkey", "l_partkey", "q", "price").withColumn("value", num(F.col("value")))


def r14_orphan_evidence(spark, sf_dir):
    """What the orphans of R1 look like."""
    raw = _lines(spark, sf_dir).withColumn("o_orderkey", F.when(F.col("l_partkey") % 37 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")))
    orders = table(spark, sf_dir, "orders")
    return S.orphan_evidence(S.split_orphans(raw, orders, ["o_orderkey"])[1], orders, "o_orderkey", "day")


def r15_exceeds_parent(spark, sf_dir):
    """Refunds larger than their order's lines."""
    lines = _lines(spark, sf_dir)
    refunds = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), (-(F.col("price") * F.lit("0.50").cast("decimal(3,2)")).cast(MONEY)).cast(MONEY).alias("refund"))
    return S.flag_exceeds_parent(refunds, lines, "l_orderkey", "refund", "price").groupBy("exceeds_parent").agg(F.count(F.lit(1)).alias("n"), num(F.sum("refund")).alias("refund"))


def r16_repeats(spark, sf_dir):
    """Crew, job and day that occur on several rows."""
    return S.repeat_count(_lines(spark, sf_dir), ["l_orderkey", "l_suppkey", "day"])


def s3_unified_sources(spark, sf_dir):
    """S3: three exports of orders with different column names as one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    a, b, c = (o.filter(f"o_orderkey % 3 = {i}") for i in range(3))
    b = b.withColumnsRenamed({"o_orderkey": "booking_ref", "o_custkey": "customer_id"})
    c = c.withColumnsRenamed({"o_orderkey": "Booking Ref"}).drop("o_orderpriority")
    return S.unify_sources({"one": (a, {}), "two": (b, {"booking_ref": "o_orderkey", "customer_id": "o_custkey"}), "three": (c, {"Booking Ref": "o_orderkey"})})


QUERIES = {f.__name__: f for f in (d1_exact_duplicates, d2_content_duplicates, d8_disambiguated_keys, d11_grain, r1_orphans, s9_quarantine, r2_sibling_repair, r3_sentinels, r4_cascade, r6_value_at_risk, q13_rejected_rows, r7_status_from_absence, r8_fill_from, r9_proven_rule, r10_constant_in_group, r12_parent_names, r13_negative_lines, r14_orphan_evidence, r15_exceeds_parent, r16_repeats, s3_unified_sources)}

_M = "DECIMAL(18,2)"
ORACLES = {
    "d1_exact_duplicates": f"""SELECT 'kept' AS part, o_orderkey, round(o_totalprice::{_M}::DOUBLE, 2) AS price, NULL::VARCHAR AS detail FROM orders
UNION ALL SELECT 'rejected', o_orderkey, round(o_totalprice::{_M}::DOUBLE, 2), 'copy of ' || (o_orderkey * 2)::VARCHAR FROM orders WHERE o_orderkey % 50 = 0""",
    "d2_content_duplicates": """SELECT o_orderkey, CASE WHEN o_orderkey % 80 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderkey % 80 = 0 AS soft_conflict, NULL::VARCHAR AS reason FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 80 = 0 THEN 'other' ELSE o_orderpriority END, NULL, CASE WHEN o_orderkey % 80 = 0 THEN 'duplicate but for o_orderpriority' ELSE 'duplicate' END FROM orders WHERE o_orderkey % 40 = 0""",
    "d8_disambiguated_keys": """WITH k AS (SELECT *, l_orderkey::VARCHAR || '.' || l_linenumber::VARCHAR AS k FROM lineitem)
SELECT CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN k || '-' || (row_number() OVER (PARTITION BY k ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice))::VARCHAR ELSE k END AS line_key, l_partkey, l_suppkey, l_quantity FROM k""",
    "d11_grain": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "r1_orphans": "SELECT l_linenumber, count(*) AS rows_in, count(*) FILTER (l_partkey % 37 <> 0 AND l_orderkey % 503 <> 0) AS rows_kept, count(*) FILTER (l_partkey % 37 = 0) AS rows_rejected, count(*) FILTER (l_partkey % 37 <> 0 AND l_orderkey % 503 = 0) AS difference FROM lineitem GROUP BY 1",
    "s9_quarantine": f"SELECT 'lineitem' AS src_table, 'orphan' AS reason, -l_orderkey - 1 AS o_orderkey, l_partkey, round(l_extendedprice::{_M}::DOUBLE, 2) AS price FROM lineitem WHERE l_partkey % 37 = 0",
    "r2_sibling_repair": """WITH s AS (SELECT count(*) AS c, max(s_suppkey) AS m FROM supplier), r AS (SELECT l_orderkey, l_partkey % 11 = 0 AS bad, l_orderkey % 90 AS s, bool_or(l_partkey % 11 <> 0) OVER (PARTITION BY l_orderkey) AS has FROM lineitem)
SELECT s AS s_suppkey, count(*) AS n, count(*) FILTER (bad) AS repaired FROM r WHERE (has OR NOT bad) AND s IN (SELECT s_suppkey FROM supplier) GROUP BY 1
UNION ALL SELECT NULL, count(*), 0 FROM r WHERE NOT ((has OR NOT bad) AND s IN (SELECT s_suppkey FROM supplier)) HAVING count(*) > 0""",
    "r3_sentinels": """SELECT 'negative_quantity' AS flag, count(*) AS n FROM lineitem WHERE l_partkey % 41 <> 0 AND l_partkey % 43 = 0 HAVING count(*) > 0
UNION ALL SELECT 'large_quantity', count(*) FROM lineitem WHERE l_partkey % 41 <> 0 AND l_partkey % 43 <> 0 AND l_quantity > 45 HAVING count(*) > 0
UNION ALL SELECT 'sentinel l_quantity', count(*) FROM lineitem WHERE l_partkey % 41 = 0 HAVING count(*) > 0""",
    "r4_cascade": f"SELECT o_orderkey AS l_orderkey, 'parent rejected' AS reason, round(o_totalprice::{_M}::DOUBLE, 2) AS price FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey % 3 = 0))",
    "r6_value_at_risk": f"""WITH q AS (SELECT 'lineitem' AS src_table, 'orphan' AS reason, l_extendedprice::{_M} AS v, true AS a FROM lineitem WHERE l_partkey % 37 = 0
  UNION ALL SELECT 'lineitem', 'sentinel quantity', l_extendedprice::{_M}, true FROM lineitem WHERE l_partkey % 41 = 0 UNION ALL SELECT 'orders', 'exact duplicate', o_totalprice::{_M}, false FROM orders WHERE o_orderkey % 50 = 0)
SELECT src_table, reason, grouping(src_table, reason)::INTEGER AS level, count(*) AS n_rows, round((sum(v) FILTER (a))::DOUBLE, 2) AS at_risk, bool_or(a) AS affects_revenue FROM q GROUP BY ROLLUP (src_table, reason)""",
    "q13_rejected_rows": f"""WITH q AS (SELECT 'lineitem' AS t, 'orphan' AS r, l_extendedprice::{_M} AS v, true AS a FROM lineitem WHERE l_partkey % 37 = 0
  UNION ALL SELECT 'lineitem', 'sentinel quantity', l_extendedprice::{_M}, true FROM lineitem WHERE l_partkey % 41 = 0 UNION ALL SELECT 'orders', 'exact duplicate', o_totalprice::{_M}, false FROM orders WHERE o_orderkey % 50 = 0),
g AS (SELECT t AS src_table, r AS reason, count(*) AS n, sum(v) FILTER (a) AS x, bool_or(a) AS b FROM q GROUP BY ALL UNION ALL SELECT 'all', NULL, count(*), sum(v) FILTER (a), bool_or(a) FROM q)
SELECT src_table, reason, n AS n_rows, round(coalesce(x, 0)::DOUBLE, 2) AS at_risk, b AS affects_revenue, round(n / (SELECT count(*) FROM q), 6) AS share FROM g""",
    "r7_status_from_absence": "SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'Cancelled' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "r8_fill_from": """WITH r AS (SELECT o_custkey, count(DISTINCT CASE WHEN o_orderkey % 10 = 0 AND o_custkey % 8 = 0 THEN 99 ELSE c_nationkey END) AS n, min(CASE WHEN o_orderkey % 10 = 0 AND o_custkey % 8 = 0 THEN 99 ELSE c_nationkey END) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
f AS (SELECT c_nationkey, c_custkey % 4 = 0 AS blank, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey ELSE v END AS nation FROM customer LEFT JOIN r ON c_custkey = o_custkey AND n = 1)
SELECT count(*) FILTER (nation = c_nationkey) AS same, count(*) FILTER (nation <> c_nationkey) AS different, count(*) FILTER (nation IS NULL) AS missing, count(*) FILTER (blank AND nation IS NOT NULL) AS filled FROM f""",
    "r9_proven_rule": """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 97 = 1 THEN '?' ELSE substr(c_mktsegment, 1, 1) END END AS class, substr(c_mktsegment, 1, 1) AS rule FROM customer)
SELECT 'proven' AS rule, c_custkey, rule AS class, count(*) FILTER (CASE WHEN c_custkey % 5 <> 0 THEN rule END <> rule) OVER () AS rule_violations FROM b UNION ALL SELECT 'broken', c_custkey, class, count(*) FILTER (class <> rule) OVER () FROM b""",
    "r10_constant_in_group": """WITH p AS (SELECT p_partkey, p_brand || p_type AS g, CASE WHEN p_partkey % 3 <> 0 THEN length(p_brand)::INTEGER END AS size FROM part)
SELECT p_partkey, g, coalesce(size, CASE WHEN min(size) OVER w = max(size) OVER w THEN max(size) OVER w END)::INTEGER AS size FROM p WINDOW w AS (PARTITION BY g)""",
    "r12_parent_names": "SELECT p_name, count(*) AS n, count(*) FILTER (l_orderkey % 9 = 0) AS mismatches FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "r13_negative_lines": f"""WITH l AS (SELECT l_orderkey AS o, l_partkey % 5 AS p, CASE WHEN l_suppkey % 13 = 0 THEN -l_quantity ELSE l_quantity END AS q, l_extendedprice::{_M} AS v FROM lineitem)
SELECT count(*) AS negative, count(*) FILTER (EXISTS (SELECT 1 FROM l b WHERE b.o = a.o AND b.p = a.p AND b.q > 0)) AS beside_sale, count(*) FILTER ((SELECT count(*) FROM l b WHERE b.o = a.o) = 1) AS alone, round(sum(v)::DOUBLE, 2) AS value FROM l a WHERE q < 0""",
    "r14_orphan_evidence": """SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS ids, min(-l_orderkey - 1) AS orphan_min, max(-l_orderkey - 1) AS orphan_max, count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS months,
  (SELECT min(o_orderkey) FROM orders) AS real_min, (SELECT max(o_orderkey) FROM orders) AS real_max FROM lineitem WHERE l_partkey % 37 = 0""",
    "r15_exceeds_parent": f"""WITH s AS (SELECT l_orderkey, sum(l_extendedprice::{_M}) AS v FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, (-round(o_totalprice::{_M} * 0.50::DECIMAL(3,2), 2))::{_M} AS refund FROM orders)
SELECT coalesce(abs(refund) > v + 0.005, false) AS exceeds_parent, count(*) AS n, round(sum(refund)::DOUBLE, 2) AS refund FROM r LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY 1""",
    "r16_repeats": "WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey, l_shipdate) SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated_rows, sum(n)::BIGINT AS all_rows FROM k",
    "s3_unified_sources": "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderpriority END AS o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END AS src_file FROM orders",
}
