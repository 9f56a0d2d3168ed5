"""Queries of what the main query of an identifier leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import checks as K
from siltstone.operators import conform as C
from siltstone.operators import intervals as I
from siltstone.operators import split as S
from siltstone.operators import temporal as T
from siltstone.plans import analysis, questions, splitting, timevalid
from siltstone.plans.core import CORE_SQL, MONEY, ad_spend, bookings, crew_days, fx_daily, live, merch_lines, num, price_versions, ratio
from siltstone.plans.timevalid import VERSIONS_SQL
from siltstone.sources.tables import table


def c11_billing(spark, sf_dir):
    """C11: currency of orders from the amount, a column, the client's billing, its other orders or the floor, by rule."""
    return C.resolve_currency(_priced_orders(spark, sf_dir), ["amount_currency", "column_currency", "billing"], "o_custkey", (F.col("o_custkey") % 5 == 0, "NGN")).groupBy("rule", "currency").agg(F.count(F.lit(1)).alias("n"))


def c11_agreement(spark, sf_dir):
    """C11: how often the sources of a currency agree."""
    return C.source_agreement(_priced_orders(spark, sf_dir), ["amount_currency", "column_currency", "billing"])


def _priced_orders(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    clients = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 == 1, F.when(F.col("c_custkey") % 8 == 1, "USD").otherwise("GBP")).alias("billing"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k % 3 == 0, F.when(c % 2 == 1, "USD").otherwise("EUR")).alias("amount_currency"), F.when(k % 5 == 0, F.when(c % 6 == 1, "GBP").otherwise("USD")).alias("column_currency"))
    return o.join(clients, "o_custkey")


def c12_net(spark, sf_dir):
    """Net of the discount at the rate of the day; foreign amounts without a day and days without a rate go to
    quarantine: rows and amounts by currency and reason."""
    k = F.col("o_orderkey")
    currency = F.when(F.col("o_custkey") % 3 == 0, "NGN").when(F.col("o_custkey") % 3 == 1, "USD").otherwise("XXX")
    o = table(spark, sf_dir, "orders").select("o_orderkey", currency.alias("currency"), F.when(k % 31 != 0, F.col("o_orderdate").cast("date")).alias("day"), F.col("o_totalprice").cast(MONEY).alias("gross"), F.when(k % 4 != 0, (k % 4 * F.lit("0.05").cast("decimal(3,2)")).cast("decimal(6,4)")).alias("discount"))
    kept, gone = C.convert_net(o, fx_daily(spark, sf_dir), "gross", "discount", "currency", "day", "NGN")
    a = kept.groupBy("currency", F.lit("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"), num(F.sum("net")).alias("net"), num(F.sum("local")).alias("local"))
    b = S.quarantine(gone, "orders", ["currency", "net"]).select(F.get_json_object("payload", "$.currency").alias("currency"), "reason", F.get_json_object("payload", "$.net").cast(MONEY).alias("net"))
    return a.unionByName(b.groupBy("currency", "reason").agg(F.count(F.lit(1)).alias("n"), num(F.sum("net")).alias("net"), F.lit(None).cast("double").alias("local")))


def c13_allowed(spark, sf_dir):
    """Discounts that are off the list or cannot be read."""
    d = F.col("l_discount").cast("decimal(4,2)")
    spelt = F.when(F.col("l_orderkey") % 50 == 1, "half").when(F.col("l_orderkey") % 50 == 2, "33%").otherwise(F.concat((d * 100).cast("int").cast("string"), F.lit("%")))
    clean = table(spark, sf_dir, "lineitem").select(C.conform_discount(spelt).alias("d"))
    return clean.groupBy(C.discount_problem(F.col("d"), ["0", "0.01", "0.02", "0.03", "0.04", "0.05"]).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def c21_mediums(spark, sf_dir):
    """Media in groups, and campaigns in one format."""
    k = F.col("event_id")
    medium = F.when(k % 6 == 0, "CPC").when(k % 6 == 1, "paid-social").when(k % 6 == 2, "(none)").when(k % 6 == 3, "E-Mail").when(k % 6 == 4, "referral")
    campaign = F.when(k % 3 == 0, F.concat(F.lit(" Spring Sale-"), (k % 4).cast("string"))).when(k % 3 == 1, F.concat(F.lit("spring_sale__"), (k % 4).cast("string")))
    mapping = spark.createDataFrame([("cpc", "Paid"), ("paid social", "Paid"), ("none", "Direct"), ("e mail", "Email"), ("referral", "Referral")], "key string, value string")
    raw = table(spark, sf_dir, "events").select(medium.alias("medium"), C.conform_campaign(campaign).alias("campaign"))
    return C.conform_category(raw, "medium", mapping, default="Direct")[0].groupBy("medium", "campaign").agg(F.count(F.lit(1)).alias("n"))


def r10_suffix(spark, sf_dir):
    """A part's collection from the end of its name."""
    known = ["Heritage", "Street", "Street Lite"]
    k = F.col("p_partkey")
    name = F.concat("p_brand", F.when(k % 4 == 0, " heritage").when(k % 4 == 1, " Street").when(k % 4 == 2, " Street LITE ").otherwise("street"))
    return table(spark, sf_dir, "part").select(S.name_suffix(name, known).alias("collection")).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def r14_guests(spark, sf_dir):
    """Orphans of customers' ids, and how many of them guest orders know."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 37 == 0, F.col("o_custkey") + 5_000_000).otherwise(F.col("o_custkey")).alias("c_custkey"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    customers = table(spark, sf_dir, "customer")
    guests = o.filter("o_orderkey % 111 = 0").select("c_custkey")
    return S.orphan_evidence(S.split_orphans(o, customers, ["c_custkey"])[1], customers, "c_custkey", "day", guests)


def r15_outside_window(spark, sf_dir):
    """Refunds whose day is not within 0 to 45 days of the order's first line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("day"))
    refunds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 9 != 0, F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 90).cast("int"))).alias("refund_day"))
    return S.flag_outside_window(refunds, lines, "l_orderkey", "refund_day", "day", 0, 45).groupBy("outside_window").agg(F.count(F.lit(1)).alias("n"))


def t9_after_last_window(spark, sf_dir):
    """Paid over list price, apart for lines after the last closed window of their SKU's raw versions."""
    raw = price_versions(spark, sf_dir)
    ends = raw.groupBy("sku").agg(F.max(F.greatest("valid_from", "valid_to")).alias("last_end"), F.bool_or(F.col("valid_to").isNull()).alias("is_open"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("paid"))
    priced = T.join_valid(lines, T.repair_scd2(raw, "sku"), "sku", "day").join(ends, "sku")
    return T.price_evidence(priced.withColumn("after_last", ~F.col("is_open") & (F.col("day") > F.col("last_end"))), "paid", "list_price", "after_last")


def w1_fx_dimension(spark, sf_dir):
    """The exchange rates as a dimension, numbered by currency and day, a year of a currency at a time."""
    fx = fx_daily(spark, sf_dir).withColumn("year", F.year("rate_date"))
    sizes = fx.groupBy("currency", "year").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("currency", "year").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("currency", "year").orderBy("rate_date"))
    dim = fx.join(starts, ["currency", "year"]).withColumn("fx_sk", F.col("start") + inside)
    jobs = live(bookings(spark, sf_dir)).select(F.col("currency").alias("c"), "shoot_date")
    return jobs.join(dim, (F.col("c") == F.col("currency")) & (F.col("shoot_date") == F.col("rate_date")), "left").groupBy(F.col("c").alias("currency")).agg(F.count(F.lit(1)).alias("jobs"), F.count("fx_sk").alias("keyed"), F.min("fx_sk").alias("first_sk"), F.max("fx_sk").alias("last_sk"))


def w2_both_sides(spark, sf_dir):
    """One bridge of the names of sessions and of spend: channels with the spellings of either side."""
    told = table(spark, sf_dir, "events").select(F.lit("sessions").alias("side"), F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("spelling"))
    spent = ad_spend(spark, sf_dir).select(F.lit("spend").alias("side"), F.concat(F.initcap("channel"), F.lit(" Ads")).alias("spelling"))
    named = told.unionByName(spent).withColumn("channel", F.regexp_replace(F.lower("spelling"), " ads$", ""))
    side = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("spelling")))), ",").alias(f"in_{s}")
    return named.groupBy("channel").agg(side("sessions"), side("spend"))


def w5_expected(spark, sf_dir):
    """Charged rates that have the expected multiplier, 3 for overtime and 1 else."""
    c = crew_days(spark, sf_dir).filter("charged_rate IS NOT NULL").withColumn("multiplier", F.round(F.col("charged_rate") / F.col("standard_rate"), 2))
    expected = F.when(F.col("overtime"), 3.0).otherwise(1.0)
    return c.groupBy("overtime", expected.alias("expected")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("multiplier") == expected).alias("as_expected"), ratio(F.count_if(F.col("multiplier") == expected), F.count(F.lit(1))).alias("share"))


def w9_campaign_map(spark, sf_dir):
    """Sessions by the campaign of the spend that their own campaign stands for; those that stand for none."""
    own = F.concat(F.lit("S-"), (F.col("event_id") % 6).cast("string"))
    mapping = spark.createDataFrame([(f"S-{i}", f"campaign{i}") for i in range(5)], "session_campaign string, campaign string")
    s = table(spark, sf_dir, "events").groupBy(own.alias("session_campaign")).agg(F.count(F.lit(1)).alias("sessions")).join(F.broadcast(mapping), "session_campaign", "left")
    spend = ad_spend(spark, sf_dir).groupBy("campaign").agg(num(F.sum("spend")).alias("spend"))
    return s.join(spend, "campaign", "full").select("session_campaign", "campaign", "sessions", "spend")


def w11_windows(spark, sf_dir):
    """Overlapping price windows, of the raw versions and of the repaired ones."""
    raw = price_versions(spark, sf_dir)
    pairs = {"raw windows": I.overlaps(raw, "sku", "version", "valid_from", "valid_to"), "repaired windows": I.overlaps(T.repair_scd2(raw, "sku"), "sku", "version", "valid_from", "valid_to")}
    return K.run_checks([K.result(df, name, F.count(F.lit(1)), 0) for name, df in pairs.items()])


def a23_quarantine_tile(spark, sf_dir):
    """Rejected rows and revenue at risk from the quarantine, bookings of an unknown currency, and their share of
    the revenue of both."""
    total = S.value_rejected(splitting.quarantined(spark, sf_dir), "price", ["orphan", "sentinel quantity"]).filter("level = 3").select(F.col("n_rows").alias("rejected"), F.coalesce("at_risk", F.lit(0)).alias("at_risk"))
    unknown = F.col("booking_id") % 59 == 0
    b = live(bookings(spark, sf_dir, client=False)).agg(F.count_if(unknown).alias("unresolved"), F.coalesce(F.sum(F.when(unknown, F.col("net"))), F.lit(0)).alias("unresolved_value"), F.sum("net").alias("net"))
    m = merch_lines(spark, sf_dir, priced=False).filter("is_revenue").agg(F.sum("gross").alias("gross"))
    share = ratio(F.col("at_risk") + F.col("unresolved_value"), F.col("net") + F.col("gross"))
    return total.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(m)).select("rejected", num(F.col("at_risk")).alias("at_risk"), "unresolved", num(F.col("unresolved_value")).alias("unresolved_value"), share.alias("share"))


def v_more_checks(spark, sf_dir):
    """Cardinality, plain numbers and one instant an order, on tables with planted violations."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    price = F.col("o_totalprice").cast(MONEY)
    spelt = o.select("o_orderkey", F.when(F.col("o_orderkey") % 83 == 0, F.format_number(price, 2)).when(F.col("o_orderkey") % 89 == 0, F.concat(F.lit("NGN "), price.cast("string"))).otherwise(price.cast("string")).alias("price"))
    twice = e.unionByName(e.filter("event_id % 71 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))).unionByName(e.filter("event_id % 73 = 0"))
    return K.run_checks([
        K.cardinality(o, "V6 states", "o_orderstatus", 3), K.cardinality(e, "V6 types", "event_type", 4), K.plain_numbers(spelt, "V7 plain numbers", ["price"]), K.plain_numbers(o, "V7 keys", ["o_orderkey", "o_custkey"]),
        K.one_instant(twice, "V12 one instant", "event_id", "ts"), K.one_instant(e, "V12 one instant as given", "event_id", "ts"),
    ])


FOUND = {f.__name__: f for f in (analysis.a12_below_cost, analysis.a13_sensitivity, analysis.a14_refunded_orders, analysis.a19_contribution_per_spend, analysis.a20_repeat_chi_square, analysis.a23_quality_tile, questions.q12_cross_sell, timevalid.t12_attribution_lag, a23_quarantine_tile)}


def s15_all_findings(spark, sf_dir):
    """The numbers of every analysis that is one row of numbers, as (section, metric, value)."""

    def told(name: str, df: DataFrame) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]))
        return df.select(F.lit(name).alias("section"), rows.alias("x")).select("section", "x.metric", "x.value")

    return reduce(lambda a, b: a.unionByName(b), [told(name, f(spark, sf_dir)) for name, f in FOUND.items()])


QUERIES = {f.__name__: f for f in (c11_billing, c11_agreement, c12_net, c13_allowed, c21_mediums, r10_suffix, r14_guests, r15_outside_window, t9_after_last_window, w1_fx_dimension, w2_both_sides, w5_expected, w9_campaign_map, w11_windows, a23_quarantine_tile, v_more_checks, s15_all_findings)}

_O = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 1 THEN 'USD' ELSE 'EUR' END END AS a, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey % 6 = 1 THEN 'GBP' ELSE 'USD' END END AS b,
  CASE WHEN o_custkey % 4 = 1 THEN CASE WHEN o_custkey % 8 = 1 THEN 'USD' ELSE 'GBP' END END AS d FROM orders)"""
ORACLES = {
    "c11_billing": _O + """, s AS (SELECT *, coalesce(a, b, d) AS direct, CASE WHEN min(coalesce(a, b, d)) OVER (PARTITION BY c) = max(coalesce(a, b, d)) OVER (PARTITION BY c) THEN min(coalesce(a, b, d)) OVER (PARTITION BY c) END AS sib FROM o)
SELECT CASE WHEN a IS NOT NULL THEN 'amount_currency' WHEN b IS NOT NULL THEN 'column_currency' WHEN d IS NOT NULL THEN 'billing' WHEN sib IS NOT NULL THEN 'siblings' WHEN c % 5 = 0 THEN 'floor' ELSE 'unresolved' END AS rule,
  coalesce(direct, sib, CASE WHEN c % 5 = 0 THEN 'NGN' END) AS currency, count(*) AS n FROM s GROUP BY ALL""",
    "c11_agreement": _O + " SELECT 'amount_currency' AS first, 'column_currency' AS second, count(*) FILTER (a = b) AS same, count(*) FILTER (a <> b) AS different FROM o UNION ALL SELECT 'amount_currency', 'billing', count(*) FILTER (a = d), count(*) FILTER (a <> d) FROM o UNION ALL SELECT 'column_currency', 'billing', count(*) FILTER (b = d), count(*) FILTER (b <> d) FROM o",
    "c12_net": """WITH o AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'NGN' WHEN 1 THEN 'USD' ELSE 'XXX' END AS currency, o_orderkey % 31 = 0 AS no_day, round(o_totalprice::DECIMAL(18,2) * (1 - (o_orderkey % 4 * 5)::DECIMAL(6,0) / 100)::DECIMAL(6,4), 2)::DECIMAL(18,2) AS net, (700 + (o_orderdate::DATE - DATE '1970-01-01') % 100)::DECIMAL(14,6) AS r FROM orders),
t AS (SELECT *, CASE WHEN currency = 'NGN' THEN 'kept' WHEN no_day THEN 'foreign without a day' WHEN currency = 'XXX' THEN 'no rate' ELSE 'kept' END AS reason FROM o)
SELECT currency, reason, count(*) AS n, round(sum(net)::DOUBLE, 2) AS net, round((sum(CASE currency WHEN 'NGN' THEN net ELSE round(net * r, 2)::DECIMAL(18,2) END) FILTER (reason = 'kept'))::DOUBLE, 2) AS local FROM t GROUP BY ALL""",
    "c13_allowed": "SELECT CASE WHEN l_orderkey % 50 = 1 THEN 'unreadable' WHEN l_orderkey % 50 = 2 OR l_discount > 0.055 THEN 'off the list' END AS problem, count(*) AS n FROM lineitem GROUP BY 1",
    "c21_mediums": """SELECT CASE event_id % 6 WHEN 0 THEN 'Paid' WHEN 1 THEN 'Paid' WHEN 3 THEN 'Email' WHEN 4 THEN 'Referral' ELSE 'Direct' END AS medium, CASE WHEN event_id % 3 < 2 THEN 'spring_sale_' || (event_id % 4)::VARCHAR END AS campaign, count(*) AS n FROM events GROUP BY ALL""",
    "r10_suffix": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'Heritage' WHEN 1 THEN 'Street' WHEN 2 THEN 'Street Lite' END AS collection, count(*) AS n FROM part GROUP BY 1",
    "r14_guests": """WITH g AS (SELECT o_custkey + 5000000 AS k, o_orderdate AS d, o_orderkey FROM orders WHERE o_orderkey % 37 = 0)
SELECT count(*) AS n_rows, count(DISTINCT k) AS ids, min(k) AS orphan_min, max(k) AS orphan_max, count(DISTINCT strftime(d, '%Y-%m')) AS months, (SELECT min(c_custkey) FROM customer) AS real_min, (SELECT max(c_custkey) FROM customer) AS real_max, count(DISTINCT k) FILTER (o_orderkey % 111 = 0) AS guest_ids FROM g""",
    "r15_outside_window": """WITH l AS (SELECT l_orderkey, min(l_shipdate::DATE) AS f FROM lineitem GROUP BY 1)
SELECT NOT (o_orderdate::DATE + (o_orderkey % 90)::INT - CASE WHEN o_orderkey % 9 <> 0 THEN f END BETWEEN 0 AND 45) AS outside_window, count(*) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""",
    "t9_after_last_window": VERSIONS_SQL + """, e AS (SELECT sku, max(greatest(lo, hi)) AS last_end, bool_or(hi IS NULL) AS is_open FROM v GROUP BY 1),
r AS (SELECT NOT is_open AND l_shipdate::DATE > last_end AS after_last, l_extendedprice / l_quantity / list_price::DOUBLE AS r FROM lineitem JOIN f ON f.sku = l_partkey AND l_shipdate::DATE BETWEEN valid_from AND valid_to JOIN e ON e.sku = l_partkey)
SELECT after_last, count(*) AS n, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.95), 6) AS p95, round(avg((r BETWEEN 0.75 AND 1.25)::INT), 6) AS within_quarter FROM r GROUP BY 1""",
    "w1_fx_dimension": CORE_SQL + """, s AS (SELECT least(min(o_orderdate::DATE), DATE '1997-01-01') AS a, greatest(max(o_orderdate::DATE), DATE '1997-01-01') AS b FROM orders), d AS (SELECT currency, rate_date, row_number() OVER (ORDER BY currency, rate_date) AS sk FROM fx, s WHERE rate_date BETWEEN a AND b)
SELECT live.currency, count(*) AS jobs, count(sk) AS keyed, min(sk) AS first_sk, max(sk) AS last_sk FROM live LEFT JOIN d ON d.currency = live.currency AND rate_date = shoot_date GROUP BY 1""",
    "w2_both_sides": CORE_SQL + """, n AS (SELECT 'a' AS side, event_type AS channel, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS s FROM events UNION ALL SELECT 'b', channel, upper(channel[1]) || channel[2:] || ' Ads' FROM spend)
SELECT channel, coalesce(string_agg(DISTINCT s, ',' ORDER BY s) FILTER (side = 'a'), '') AS in_sessions, coalesce(string_agg(DISTINCT s, ',' ORDER BY s) FILTER (side = 'b'), '') AS in_spend FROM n GROUP BY 1""",
    "w5_expected": CORE_SQL + " SELECT overtime, CASE WHEN overtime THEN 3.0 ELSE 1.0 END::DOUBLE AS expected, count(*) AS n, count(*) FILTER (charged_rate = standard_rate * CASE WHEN overtime THEN 3 ELSE 1 END) AS as_expected, round(count(*) FILTER (charged_rate = standard_rate * CASE WHEN overtime THEN 3 ELSE 1 END) / count(*), 6) AS share FROM crew_day WHERE charged_rate IS NOT NULL GROUP BY ALL",
    "w9_campaign_map": CORE_SQL + """, s AS (SELECT 'S-' || (event_id % 6)::VARCHAR AS session_campaign, CASE WHEN event_id % 6 < 5 THEN 'campaign' || (event_id % 6)::VARCHAR END AS campaign, count(*) AS sessions FROM events GROUP BY ALL), p AS (SELECT campaign, round(sum(spend)::DOUBLE, 2) AS spend FROM spend GROUP BY 1)
SELECT session_campaign, coalesce(s.campaign, p.campaign) AS campaign, sessions, spend FROM s FULL JOIN p ON s.campaign = p.campaign""",
    "w11_windows": VERSIONS_SQL + f""", g AS (SELECT sku, version, lo, coalesce(hi, DATE '{T.FOREVER}') AS hi FROM v WHERE NOT inv), n AS (SELECT count(*)::DOUBLE AS n FROM g a JOIN g b ON a.sku = b.sku AND a.version < b.version AND a.lo <= b.hi AND b.lo <= a.hi)
SELECT 'raw windows' AS "check", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n AS got, 0::DOUBLE AS target FROM n UNION ALL SELECT 'repaired windows', 'PASS', 0, 0""",
    "a23_quarantine_tile": CORE_SQL + """, r AS (SELECT (SELECT count(*) FILTER (l_partkey % 37 = 0) + count(*) FILTER (l_partkey % 41 = 0) FROM lineitem) + (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS rejected,
  (SELECT coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_partkey % 37 = 0), 0) + coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_partkey % 41 = 0), 0) FROM lineitem) AS at_risk, (SELECT sum(gross) FROM line WHERE is_revenue) AS gross),
b AS (SELECT count(*) FILTER (booking_id % 59 = 0) AS unresolved, coalesce(sum(net) FILTER (booking_id % 59 = 0), 0) AS unresolved_value, sum(net) AS net FROM live)
SELECT rejected, round(at_risk::DOUBLE, 2) AS at_risk, unresolved, round(unresolved_value::DOUBLE, 2) AS unresolved_value, round((at_risk + unresolved_value)::DOUBLE / (net + gross)::DOUBLE, 6) AS share FROM r, b""",
    "v_more_checks": """WITH k AS (SELECT 'V6 states' AS "check", count(DISTINCT o_orderstatus)::DOUBLE AS got, 3::DOUBLE AS target FROM orders UNION ALL SELECT 'V6 types', count(DISTINCT event_type), 4 FROM events
  UNION ALL SELECT 'V7 plain numbers', count(*) FILTER ((o_orderkey % 83 = 0 AND o_totalprice::DECIMAL(18,2) >= 1000) OR (o_orderkey % 83 <> 0 AND o_orderkey % 89 = 0)), 0 FROM orders UNION ALL SELECT 'V7 keys', 0, 0
  UNION ALL SELECT 'V12 one instant', count(*) FILTER (event_id % 71 = 0), 0 FROM events UNION ALL SELECT 'V12 one instant as given', 0, 0)
SELECT "check", CASE WHEN got = target THEN 'PASS' ELSE 'FAIL' END AS status, got, target FROM k""",
}
ORACLES["s15_all_findings"] = " UNION ALL ".join(
    f"SELECT '{n}' AS section, metric, value FROM (SELECT COLUMNS(*)::DOUBLE FROM ({({**analysis.ORACLES, **questions.ORACLES, **timevalid.ORACLES, **ORACLES})[n]})) UNPIVOT INCLUDE NULLS (value FOR metric IN (*))" for n in FOUND
)
