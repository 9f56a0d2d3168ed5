"""Queries of entity resolution and of time-valid data, on tables with planted defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import intervals as I
from siltstone.operators import resolve as R
from siltstone.operators import temporal as T
from siltstone.plans.core import CORE_SQL, MONEY, day_number, num, price_versions, sessions
from siltstone.sources.tables import table

OFFSET = 1_000_000


def clients(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    """Customers, and copies of every tenth one at an offset key with a typo in the name. planted: every sixth copy has the
    next customer's name, every seventh an address of its own."""
    name = lambda k: F.concat(F.lit("Client "), F.translate(F.substring(F.md5(k.cast("string")), 1, 12), "0123456789", "ghijklmnop"))
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", name(k).alias("name"), F.when(k % 3 != 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org"))).alias("email"), "c_nationkey")
    told = F.when(F.lit(planted) & (k % 60 == 0), name(k + 1)).otherwise(F.concat(F.lit("C"), "name"))
    email = F.when(F.lit(planted) & (k % 70 == 10), F.lit("v@y.org")).when(k % 20 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org")))
    copies = c.filter("c_custkey % 10 = 0").select((k + OFFSET).alias("c_custkey"), told.alias("name"), email.alias("email"), "c_nationkey")
    return c.unionByName(copies)


def d3_merged_rows(spark, sf_dir):
    """D3: orders of a customer as rows of one key: first total, earliest day, most common priority, conflicts."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    return R.merge_by_key(o, "o_custkey", "o_orderkey", ["status"], ["day"], ["o_orderpriority"])[0]


def d4_rekeyed_pairs(spark, sf_dir):
    """Copies at an offset key, by similarity of folded names and e-mails that do not conflict; some do not hold."""
    return R.match_rekeyed(clients(spark, sf_dir, planted=True), "c_custkey", OFFSET, "name", "email", 0.85).select("high", "low", "email_conflict", "holds")


def d5_best_match(spark, sf_dir):
    """Whether the twin is the best name match among the names that share one of their rarest runs of letters; some
    copies have another customer's name."""
    c = clients(spark, sf_dir, planted=True)
    pairs = R.match_rekeyed(c, "c_custkey", OFFSET, "name", "email", 0.85)
    return R.best_match_evidence(c, pairs, "c_custkey", "name").groupBy("is_best").agg(F.count(F.lit(1)).alias("n"))


def d6_applied_merges(spark, sf_dir):
    """Survivors with gaps filled, and orders that referred to copies."""
    c = clients(spark, sf_dir)
    pairs = R.match_rekeyed(c, "c_custkey", OFFSET, "name", "email", 0.85).filter("holds")
    out = R.apply_merges(c, pairs, "c_custkey", ["email"], ["c_nationkey"])
    refs = table(spark, sf_dir, "orders").select(F.when((F.col("o_custkey") % 10 == 0) & (F.col("o_orderkey") % 2 == 0), F.col("o_custkey") + OFFSET).otherwise(F.col("o_custkey")).alias("c_custkey"))
    n = R.remap(refs, "c_custkey", pairs).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return out.join(n, "c_custkey", "left").select("c_custkey", "email", F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ",").alias("merged_from"), F.round("merge_confidence", 6).alias("merge_confidence"), F.coalesce("orders", F.lit(0)).alias("orders"))


def d7_shared_attributes(spark, sf_dir):
    """Segments as shared attribute, with the number of nations behind each."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_nationkey") > 2, F.col("c_nationkey")).alias("nation"))
    return R.shared_attribute_groups(c, "c_mktsegment", ["nation"]).withColumn("n_nation", F.col("n_nation").cast("long"))


def d9_id_block(spark, sf_dir):
    """Gaps among the low ids and high ids without a twin, of a table that lost every 90th customer."""
    return R.check_id_block(clients(spark, sf_dir).filter("c_custkey % 90 <> 10 OR c_custkey >= 1000000"), "c_custkey", OFFSET)


def d10_canonical_labels(spark, sf_dir):
    """The most common mixed-case spelling of a part's type."""
    s = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, F.lower("p_name")).otherwise(F.initcap("p_name"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("k"), s.alias("label"))
    return R.canonical_label(p, "k", "label", "p_partkey")


def published_rates(spark, sf_dir):
    """Rates of the days on which orders were taken, a currency by the client's number: a base and what the cents of the
    day's orders leave, so steps are small. Weekdays only, every 29th day missing, every 61st and 67th with the point one
    place off."""
    currency, base = F.when(F.col("o_custkey") % 3 == 1, "USD").when(F.col("o_custkey") % 3 == 2, "GBP"), F.when(F.col("currency") == "USD", 1000).otherwise(1500)
    o = table(spark, sf_dir, "orders").select(currency.alias("currency"), F.col("o_orderdate").cast("date").alias("rate_date"), (F.col("o_totalprice").cast(MONEY) * 100).cast("long").alias("cents"))
    day = o.filter((F.weekday("rate_date") < 5) & F.col("currency").isNotNull()).groupBy("currency", "rate_date").agg(F.sum("cents").alias("cents"))
    n, rate = day_number(F.col("rate_date")), (base + F.col("cents") % 100).cast("decimal(14,6)")
    return day.filter(n % 29 != 0).select("currency", "rate_date", F.when(n % 61 == 0, rate * 10).when(n % 67 == 0, rate / 10).otherwise(rate).cast("decimal(14,6)").alias("rate"))


def t1_corrected_rates(spark, sf_dir):
    """Slips of the decimal point are found and undone."""
    return T.correct_rate_outliers(published_rates(spark, sf_dir)).select("currency", "rate_date", num(F.col("rate"), 6).alias("rate"), "is_corrected")


def t2_daily_rates(spark, sf_dir):
    """A rate for every day from the first to the last one published, filled from the last one."""
    return T.daily_calendar(T.correct_rate_outliers(published_rates(spark, sf_dir))).withColumn("rate", num(F.col("rate"), 6))


def t3_rate_steps(spark, sf_dir):
    """Large steps of the published rates."""
    return T.rate_steps(published_rates(spark, sf_dir))


def t4_missing_weekdays(spark, sf_dir):
    """T4: weekdays without a rate between the first and the last one published."""
    return T.missing_weekdays(published_rates(spark, sf_dir))


def t5_repaired_versions(spark, sf_dir):
    """T5: windows without overlap and gap."""
    return T.repair_scd2(price_versions(spark, sf_dir), "sku").select("sku", "version", "valid_from", "valid_to", "is_current", "repair")


def t6_version_check(spark, sf_dir):
    """Defects of the raw windows, and of the repaired ones, which have none."""
    raw = price_versions(spark, sf_dir)
    checked = {"raw": raw.withColumn("is_current", F.col("valid_to").isNull()), "repaired": T.repair_scd2(raw, "sku")}
    a, b = (T.check_scd2(df, "sku").withColumn("state", F.lit(n)) for n, df in checked.items())
    return a.unionByName(b)


def q06_window_integrity(spark, sf_dir):
    """Overlapping pairs, inverted windows, open ends before the last, and affected SKUs of the raw versions."""
    v = price_versions(spark, sf_dir)
    pairs = I.overlaps(v, "sku", "version", "valid_from", "valid_to")
    rows = [("overlapping pairs", pairs.agg(F.count(F.lit(1)))), ("skus with overlaps", pairs.agg(F.countDistinct("sku"))), ("inverted windows", v.agg(F.count_if(F.col("valid_to") < F.col("valid_from")))), ("open windows", v.agg(F.count_if(F.col("valid_to").isNull())))]
    out = None
    for name, df in rows:
        one = df.toDF("n").select(F.lit(name).alias("metric"), F.col("n").cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    fixed = T.check_scd2(T.repair_scd2(v, "sku"), "sku").select(F.lit("defects after repair").alias("metric"), (F.col("overlaps") + F.col("gaps") + F.col("repeated_starts") + F.col("keys_without_one_current")).alias("n"))
    return out.unionByName(fixed)


def _priced(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("paid"), "l_returnflag")
    return T.join_valid(lines, T.repair_scd2(price_versions(spark, sf_dir), "sku"), "sku", "day")


def t7_validity_join(spark, sf_dir):
    """Each line with the price version in force; exactly one each."""
    return _priced(spark, sf_dir).groupBy("version").agg(F.count(F.lit(1)).alias("n"), num(F.sum("list_price")).alias("list_total"))


def _service_windows(spark, sf_dir):
    """Many windows a supplier: from the day of a first line, for 3 to 12 days; every eleventh is inverted."""
    k = F.col("l_partkey")
    day = F.col("l_shipdate").cast("date")
    end = F.when(k % 11 == 0, F.date_sub(day, 2)).otherwise(F.date_add(day, (3 + k % 10).cast("int")))
    return table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_suppkey").alias("supplier"), F.concat_ws("-", "l_orderkey", "l_partkey").alias("window"), day.alias("since"), end.alias("until"))


def t7_interval_join(spark, sf_dir):
    """Second lines that were shipped within windows of their supplier, of which a supplier has many."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").cast(MONEY).alias("price"))
    met = I.join_intervals(lines, _service_windows(spark, sf_dir), ["supplier"], "day", "since", "until")
    return met.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), num(F.sum("price")).alias("price"))


def t7_range_join(spark, sf_dir):
    """Days of orders within windows of any part's promotion: a range join without a key."""
    k, first = F.col("p_partkey"), F.lit("1995-01-01").cast("date")
    windows = table(spark, sf_dir, "part").filter("p_partkey % 7 = 0").select(k.alias("part"), F.date_add(first, (k * 3 % 2200).cast("int")).alias("since"), F.date_add(first, (k * 3 % 2200 + k % 30).cast("int")).alias("until"))
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    return I.join_intervals(days, windows, [], "day", "since", "until").groupBy("part").agg(F.count(F.lit(1)).alias("days"), F.sum("orders").alias("orders"))


def t7_as_of_rates(spark, sf_dir):
    """Orders with the last rate published on their day or before, from two series with many days."""
    currency = F.when(F.col("o_custkey") % 3 == 1, "USD").when(F.col("o_custkey") % 3 == 2, "GBP").otherwise("NGN")
    o = table(spark, sf_dir, "orders").select("o_orderkey", currency.alias("currency"), F.col("o_orderdate").cast("date").alias("day"))
    rates = published_rates(spark, sf_dir).withColumn("published", F.col("rate_date"))
    return I.join_as_of(o, rates, ["currency"], "day", "rate_date", ["rate", "published"]).select("o_orderkey", num(F.col("rate"), 6).alias("rate"), "published")


def t8_overlaps(spark, sf_dir):
    """Overlapping windows of suppliers with many, by a sweep: pairs by supplier."""
    return I.overlaps(_service_windows(spark, sf_dir), "supplier", "window", "since", "until").groupBy("supplier").agg(F.count(F.lit(1)).alias("pairs"))


def t9_price_evidence(spark, sf_dir):
    """Paid over list price."""
    return T.price_evidence(_priced(spark, sf_dir), "paid", "list_price", "l_returnflag")


def _refund_days(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("day"))
    true = F.date_add("day", (F.col("l_orderkey") % 46).cast("int"))
    return r.withColumn("true_day", true).withColumn("raw", F.when(F.col("l_partkey") % 2 == 0, F.date_format("true_day", "d/M/yyyy")).otherwise(F.date_format("true_day", "M/d/yyyy")))


def t10_ambiguous_dates(spark, sf_dir):
    """Refund dates in two orders, resolved where one reading fits the learned window; right and wrong ones."""
    out = T.resolve_ambiguous_dates(_refund_days(spark, sf_dir), "raw", ["day"])[0]
    d, m = T.two_readings(F.col("raw"))
    return out.select((d.isNotNull() & m.isNotNull() & (d != m)).alias("ambiguous"), F.col("resolved").isNotNull().alias("is_resolved"), (F.col("resolved") == F.col("true_day")).alias("is_right")).groupBy("ambiguous", "is_resolved", "is_right").agg(F.count(F.lit(1)).alias("n"))


def t10_learned_window(spark, sf_dir):
    """The window itself."""
    return T.resolve_ambiguous_dates(_refund_days(spark, sf_dir), "raw", ["day"])[1]


def t11_calendar(spark, sf_dir):
    """The calendar of the days from the first to the last order, with the orders taken on each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    span = o.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return T.calendar(span.select(F.explode(F.sequence("a", "b")).alias("day"))).join(o.groupBy("day").agg(F.count(F.lit(1)).alias("orders")), "day", "left").na.fill(0, ["orders"])


def t12_attribution_lag(spark, sf_dir):
    """Days between a session and the order it names."""
    s = sessions(spark, sf_dir).filter("order_id IS NOT NULL")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("order_day"))
    return T.attribution_lag(s, o, "order_id", "session_date", "order_day")


def w7_refund_allocation(spark, sf_dir):
    """Refunds capped at their order's positive value; per order the counted amount and what lines got of it."""
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("day"), F.when(F.col("l_partkey") % 13 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast(MONEY).alias("value"), "l_returnflag")
    refunds = base.filter("l_returnflag = 'R'").select("l_orderkey", "day", F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("value").cast("string")).alias("k"), (F.abs("value") * F.lit("0.70").cast("decimal(3,2)")).cast(MONEY).alias("amount"))
    counted, shared = T.allocate_refunds(base, refunds, "l_orderkey", "value", "amount", "day", "k")
    a = counted.groupBy("l_orderkey").agg(F.sum("amount").alias("amount"), F.sum("counted").alias("counted"))
    b = shared.groupBy("l_orderkey").agg(F.sum("refunded").alias("refunded"))
    return a.join(b, "l_orderkey").select("l_orderkey", num(F.col("amount")).alias("amount"), num(F.col("counted")).alias("counted"), (F.abs(F.col("refunded") - F.col("counted").cast("double")) < 0.1).alias("ties_out"))


QUERIES = {f.__name__: f for f in (d3_merged_rows, d4_rekeyed_pairs, d5_best_match, d6_applied_merges, d7_shared_attributes, d9_id_block, d10_canonical_labels, t1_corrected_rates, t2_daily_rates, t3_rate_steps, t4_missing_weekdays, t5_repaired_versions, t6_version_check, q06_window_integrity, t7_validity_join, t7_interval_join, t7_range_join, t7_as_of_rates, t8_overlaps, t9_price_evidence, t10_ambiguous_dates, t10_learned_window, t11_calendar, t12_attribution_lag, w7_refund_allocation)}

FX_SQL = """WITH o AS (SELECT CASE o_custkey % 3 WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' END AS currency, o_orderdate::DATE AS d, (o_totalprice::DECIMAL(18,2) * 100)::BIGINT AS c FROM orders),
q AS (SELECT currency, d, (d - DATE '1970-01-01') AS n, (max(CASE currency WHEN 'USD' THEN 1000 ELSE 1500 END) + sum(c) % 100)::DECIMAL(14,6) AS r FROM o WHERE isodow(d) < 6 AND currency IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT currency, d, (CASE WHEN n % 61 = 0 THEN r * 10 WHEN n % 67 = 0 THEN r / 10 ELSE r END)::DECIMAL(14,6)::DOUBLE AS raw FROM q WHERE n % 29 <> 0),
w AS (SELECT *, lag(raw) OVER w AS b, lead(raw) OVER w AS f FROM p WINDOW w AS (PARTITION BY currency ORDER BY d)),
h AS (SELECT *, b IS NOT NULL OR f IS NOT NULL AS beside, coalesce(raw > 5 * b, true) AND coalesce(raw > 5 * f, true) AND (coalesce(abs(raw / 10 / b - 1) <= 0.15, false) OR coalesce(abs(raw / 10 / f - 1) <= 0.15, false)) AS hi,
  coalesce(raw < b / 5, true) AND coalesce(raw < f / 5, true) AND (coalesce(abs(raw * 10 / b - 1) <= 0.15, false) OR coalesce(abs(raw * 10 / f - 1) <= 0.15, false)) AS lo FROM w),
fixed AS (SELECT currency, d, CASE WHEN beside AND hi THEN raw / 10 WHEN beside AND lo THEN raw * 10 ELSE raw END AS rate, beside AND (hi OR lo) AS is_corrected FROM h),
a AS (SELECT currency, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM p GROUP BY 1)"""
VERSIONS_SQL = f"""WITH v AS (SELECT p_partkey AS sku, r AS version, (p_retailprice::DECIMAL(18,2) + r * 10)::DECIMAL(18,2) AS list_price, DATE '1995-01-01' + (r * 900)::INT AS lo,
  CASE WHEN r = 2 AND p_partkey % 3 <> 0 THEN NULL WHEN r = 1 AND p_partkey % 5 = 4 THEN NULL ELSE DATE '1995-01-01' + (r * 900 + CASE p_partkey % 5 WHEN 1 THEN 930 WHEN 2 THEN 880 ELSE 899 END)::INT END AS hi, p_partkey % 7 = 0 AND r = 0 AS inv FROM part, range(3) t(r)),
f AS (SELECT sku, version, list_price, lo AS valid_from, CASE WHEN version = 2 THEN DATE '{T.FOREVER}' ELSE lo + 899 END AS valid_to, version = 2 AS is_current, concat_ws(',', CASE WHEN inv THEN 'swapped' END,
  CASE WHEN version = 2 THEN CASE WHEN hi IS NOT NULL THEN 'reopened' END WHEN hi IS NULL THEN 'closed' WHEN hi >= lo + 900 THEN 'trimmed' WHEN hi < lo + 899 THEN 'bridged' END) AS repair FROM v)"""
_RD = """WITH r AS (SELECT l_shipdate::DATE AS day, l_shipdate::DATE + (l_orderkey % 46)::INT AS t, l_partkey % 2 = 0 AS df FROM lineitem WHERE l_returnflag = 'R'),
s AS (SELECT *, CASE WHEN day(t) <= 12 THEN make_date(year(t), day(t), month(t)) END AS o FROM r), u AS (SELECT *, o IS NULL OR o = t AS sure FROM s), w AS (SELECT min(t - day) AS a, max(t - day) AS b, count(*) AS n FROM u WHERE sure)"""
_WINDOWS = """WITH w AS (SELECT l_suppkey AS supplier, l_orderkey::VARCHAR || '-' || l_partkey::VARCHAR AS "window", l_shipdate::DATE AS since, CASE WHEN l_partkey % 11 = 0 THEN l_shipdate::DATE - 2 ELSE l_shipdate::DATE + (3 + l_partkey % 10)::INT END AS until FROM lineitem WHERE l_linenumber = 1)"""
ORACLES = {
    "d3_merged_rows": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders), p AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL)
SELECT o.o_custkey, first(status ORDER BY o_orderkey) FILTER (status IS NOT NULL) AS status, min(o_orderdate)::DATE AS day, concat_ws(',', CASE WHEN count(DISTINCT status) > 1 THEN 'status' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'o_orderpriority' END) AS conflicts,
  count(*) AS n_rows, (SELECT first(o_orderpriority ORDER BY n DESC, f) FROM p WHERE p.o_custkey = o.o_custkey) AS o_orderpriority FROM o GROUP BY o.o_custkey""",
    "d4_rekeyed_pairs": f"""SELECT c_custkey + {OFFSET} AS high, c_custkey AS low, c_custkey % 70 = 10 AND c_custkey % 3 <> 0 AS email_conflict, c_custkey % 60 <> 0 AND NOT (c_custkey % 70 = 10 AND c_custkey % 3 <> 0) AS holds
FROM customer WHERE c_custkey % 10 = 0""",
    "d5_best_match": "SELECT c_custkey % 60 <> 0 AS is_best, count(*) AS n FROM customer WHERE c_custkey % 10 = 0 AND (c_custkey % 60 <> 0 OR c_custkey + 1 IN (SELECT c_custkey FROM customer)) GROUP BY 1",
    "d6_applied_merges": f"""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 20 = 0 THEN 'u' || (CASE WHEN c_custkey % 3 <> 0 THEN c_custkey ELSE c_custkey END)::VARCHAR || '@x.org' END AS email,
  CASE WHEN c_custkey % 10 = 0 THEN (c_custkey + {OFFSET})::VARCHAR END AS merged_from,
  CASE WHEN c_custkey % 10 = 0 THEN round(2 * l / (2 * l + 1)::DOUBLE, 6) END AS merge_confidence, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders
FROM (SELECT *, 6 + length(regexp_replace(translate(md5(c_custkey::VARCHAR)[:12], '0123456789', 'ghijklmnop'), '[^a-z]', '', 'g')) AS l FROM customer)""",
    "d7_shared_attributes": "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) FILTER (c_nationkey > 2) + max((c_nationkey <= 2)::INT) AS n_nation FROM customer GROUP BY 1 HAVING count(*) > 1",
    "d9_id_block": """WITH l AS (SELECT min(c_custkey) AS low_min, max(c_custkey) AS low_max, count(*) AS low_ids FROM customer WHERE c_custkey % 90 <> 10)
SELECT l.*, low_max - low_min + 1 - low_ids AS gaps, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS high_ids, (SELECT count(*) FROM customer WHERE c_custkey % 90 = 10) AS without_twin FROM l""",
    "d10_canonical_labels": """WITH p AS (SELECT p_partkey, lower(p_name) AS k, p_partkey % 4 AS r, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS i FROM part),
s AS (SELECT k, CASE r WHEN 0 THEN upper(k) WHEN 1 THEN k ELSE i END AS label, CASE WHEN r IN (0, 1) THEN 1 ELSE 0 END AS m, count(*) AS n, min(p_partkey) AS o FROM p GROUP BY ALL)
SELECT k, first(label ORDER BY m, n DESC, o) AS label FROM s GROUP BY k""",
    "t1_corrected_rates": FX_SQL + " SELECT currency, d AS rate_date, round(rate, 6) AS rate, is_corrected FROM fixed",
    "t2_daily_rates": FX_SQL + """ SELECT a.currency, a.d AS rate_date, round(last_value(x.rate IGNORE NULLS) OVER w, 6) AS rate, x.d IS NULL AS is_filled, last_value(x.d IGNORE NULLS) OVER w AS source_rate_date, coalesce(x.is_corrected, false) AS is_corrected
FROM a LEFT JOIN fixed x ON a.currency = x.currency AND a.d = x.d WINDOW w AS (PARTITION BY a.currency ORDER BY a.d ROWS UNBOUNDED PRECEDING)""",
    "t3_rate_steps": FX_SQL + """, s AS (SELECT currency, d, raw / lag(raw) OVER (PARTITION BY currency ORDER BY d) AS step FROM p)
SELECT currency, d AS rate_date, round(step, 6) AS step, step > 2 OR step < 0.5 AS is_rejected FROM s WHERE step > 1.2 OR step < 1 / 1.2""",
    "t4_missing_weekdays": FX_SQL + " SELECT currency, d AS rate_date FROM a WHERE isodow(d) < 6 AND (currency, d) NOT IN (SELECT currency, d FROM p)",
    "t5_repaired_versions": VERSIONS_SQL + " SELECT sku, version::INTEGER AS version, valid_from, valid_to, is_current, repair FROM f",
    "t6_version_check": VERSIONS_SQL + """, r AS (SELECT sku, CASE WHEN inv THEN hi ELSE lo END AS a, CASE WHEN inv THEN lo ELSE hi END AS b FROM v), w AS (SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb FROM r WINDOW o AS (PARTITION BY sku ORDER BY a NULLS FIRST, b NULLS FIRST)),
c AS (SELECT sku, count(*) FILTER (b IS NULL) AS c FROM r GROUP BY sku)
SELECT 'raw' AS state, count(*) FILTER (pb >= a) AS overlaps, count(*) FILTER (pb + 1 < a) AS gaps, count(*) FILTER (pa = a) AS repeated_starts, (SELECT count(*) FILTER (c <> 1) FROM c) AS keys_without_one_current FROM w
UNION ALL SELECT 'repaired', 0, 0, 0, 0""",
    "q06_window_integrity": VERSIONS_SQL + f""", g AS (SELECT sku, version, lo, coalesce(hi, DATE '{T.FOREVER}') AS hi FROM v WHERE NOT inv), o AS (SELECT a.sku FROM g a JOIN g b ON a.sku = b.sku AND a.version < b.version AND a.lo <= b.hi AND b.lo <= a.hi)
SELECT 'overlapping pairs' AS metric, count(*) AS n FROM o UNION ALL SELECT 'skus with overlaps', count(DISTINCT sku) FROM o UNION ALL SELECT 'inverted windows', count(*) FROM v WHERE inv UNION ALL SELECT 'open windows', count(*) FROM v WHERE hi IS NULL UNION ALL SELECT 'defects after repair', 0""",
    "t7_validity_join": VERSIONS_SQL + " SELECT version::INTEGER AS version, count(*) AS n, round(sum(list_price)::DOUBLE, 2) AS list_total FROM lineitem JOIN f ON sku = l_partkey AND l_shipdate::DATE BETWEEN valid_from AND valid_to GROUP BY 1",
    "t7_interval_join": _WINDOWS + " SELECT supplier, count(*) AS n, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS price FROM lineitem JOIN w ON l_suppkey = supplier AND l_shipdate::DATE BETWEEN since AND until WHERE l_linenumber = 2 GROUP BY 1",
    "t7_range_join": """WITH w AS (SELECT p_partkey AS part, DATE '1995-01-01' + (p_partkey * 3 % 2200)::INT AS since, DATE '1995-01-01' + (p_partkey * 3 % 2200 + p_partkey % 30)::INT AS until FROM part WHERE p_partkey % 7 = 0)
SELECT part, count(DISTINCT o_orderdate::DATE) AS days, count(*) AS orders FROM w JOIN orders ON o_orderdate::DATE BETWEEN since AND until GROUP BY 1""",
    "t7_as_of_rates": FX_SQL + """, q2 AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'NGN' END AS currency, o_orderdate::DATE AS day FROM orders)
SELECT o_orderkey, round(raw, 6) AS rate, p.d AS published FROM q2 ASOF LEFT JOIN p ON q2.currency = p.currency AND q2.day >= p.d""",
    "t8_overlaps": _WINDOWS + """ SELECT a.supplier, count(*) AS pairs FROM w a JOIN w b ON a.supplier = b.supplier AND a."window" < b."window" AND a.since <= b.until AND b.since <= a.until AND a.since <= a.until AND b.since <= b.until GROUP BY 1""",
    "t9_price_evidence": VERSIONS_SQL + """, r AS (SELECT l_returnflag, l_extendedprice / l_quantity / list_price::DOUBLE AS r FROM lineitem JOIN f ON sku = l_partkey AND l_shipdate::DATE BETWEEN valid_from AND valid_to)
SELECT l_returnflag, count(*) AS n, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.95), 6) AS p95, round(avg((r BETWEEN 0.75 AND 1.25)::INT), 6) AS within_quarter FROM r GROUP BY 1""",
    "t10_ambiguous_dates": _RD + """, x AS (SELECT NOT sure AS ambiguous, sure OR NOT (o - day BETWEEN a AND b) AS is_resolved FROM u, w)
SELECT ambiguous, is_resolved, CASE WHEN is_resolved THEN true END AS is_right, count(*) AS n FROM x GROUP BY ALL""",
    "t10_learned_window": _RD + " SELECT 'day' AS basis, a::INTEGER AS lag_min, b::INTEGER AS lag_max, n AS sure, true AS is_chosen FROM w",
    "t11_calendar": """WITH o AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT t.d::DATE AS day, year(t.d)::INTEGER AS year, quarter(t.d)::INTEGER AS quarter, year(t.d)::VARCHAR || 'Q' || quarter(t.d)::VARCHAR AS year_quarter, isoyear(t.d)::INTEGER AS iso_year, weekofyear(t.d)::INTEGER AS iso_week, date_trunc('week', t.d)::DATE AS week_start,
  isodow(t.d) > 5 AS is_weekend, month(t.d) IN (11, 12) AS is_peak, coalesce(n, 0) AS orders FROM generate_series((SELECT min(d)::TIMESTAMP FROM o), (SELECT max(d)::TIMESTAMP FROM o), INTERVAL 1 DAY) t(d) LEFT JOIN o ON o.d = t.d::DATE""",
    "t12_attribution_lag": """WITH j AS (SELECT ts::DATE - (DATE '2024-01-01' + (o_orderkey % 30)::INT) AS d FROM events JOIN orders ON o_orderkey = event_id * 3 WHERE event_type = 'purchase')
SELECT count(*) AS n, median(abs(d))::DOUBLE AS median_days, round(avg((d < 0)::INT), 6) AS before FROM j""",
    "w7_refund_allocation": """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS day, (CASE WHEN l_partkey % 13 = 0 THEN -l_extendedprice ELSE l_extendedprice END)::DECIMAL(18,2) AS v, l_returnflag FROM lineitem),
o AS (SELECT l_orderkey, greatest(0, sum(v)) AS cap FROM b GROUP BY 1), r AS (SELECT l_orderkey, round(abs(v) * 0.70::DECIMAL(3,2), 2)::DECIMAL(18,2) AS a FROM b WHERE l_returnflag = 'R'), s AS (SELECT l_orderkey, sum(a) AS a FROM r GROUP BY 1)
SELECT l_orderkey, round(a::DOUBLE, 2) AS amount, round(least(a, cap)::DOUBLE, 2) AS counted, true AS ties_out FROM s JOIN o USING (l_orderkey)""",
}
