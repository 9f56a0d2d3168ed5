"""The business questions Q2 to Q14 on the star schema. Ties are broken by key everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.temporal import exact_percentiles
from siltstone.plans.core import BASE_DATE, CORE_SQL, ad_spend, bookings, crew_days, fx_daily, live, merch_lines, num, quarter, ratio, sessions

W = Window


def q02_service_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and jobs by service and year: share of the year, change on the year before, first halves."""
    per = live(bookings(spark, sf_dir, client=False)).groupBy("service", F.year("shoot_date").alias("year")).agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("net").alias("revenue"), F.sum(F.when(F.month("shoot_date") <= 6, F.col("net"))).alias("h1")
    )
    by_service, by_year = W.partitionBy("service").orderBy("year"), W.partitionBy("year")
    before, h1_before = F.lag("revenue").over(by_service), F.lag("h1").over(by_service)
    return per.select(
        "service", F.col("year").cast("int").alias("year"), "jobs", num(F.col("revenue")).alias("revenue"), ratio(F.col("revenue"), F.sum("revenue").over(by_year)).alias("share"),
        ratio(F.col("revenue") - before, before).alias("yoy"), ratio(F.col("h1") - h1_before, h1_before).alias("h1_yoy"),
    )


def q03_worst_margin_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 live jobs with the worst margin, with a verdict: estimated rates or double-booked crew make it doubtful.
    Double bookings are looked for on the crew days of these 20 rows only, which carry their jobs along."""
    crew = crew_days(spark, sf_dir)
    labour = crew.groupBy("booking_id").agg(F.sum("labour_cost").alias("labour"), F.count_if("rate_is_estimated").alias("estimated"), F.count(F.lit(1)).alias("days"))
    jobs = live(bookings(spark, sf_dir, client=False)).join(labour, "booking_id").withColumn("margin", F.col("net") - F.col("labour"))
    top = jobs.orderBy("margin", "booking_id").limit(20).select("booking_id", F.struct("booking_id", "service", "net", "labour", "margin", "estimated", "days").alias("job"))
    theirs = crew.join(F.broadcast(top), "booking_id").groupBy("crew_id", "work_date").agg(F.collect_list("job").alias("jobs"))
    booked = crew.join(F.broadcast(theirs), ["crew_id", "work_date"]).groupBy("crew_id", "work_date").agg(F.countDistinct("booking_id").alias("n"), F.first("jobs").alias("jobs"))
    top = booked.select("n", F.explode("jobs").alias("job")).groupBy("job").agg(F.count_if(F.col("n") > 1).alias("doubled")).select("job.*", "doubled")
    verdict = F.when(F.col("estimated") * 2 > F.col("days"), "estimated").when(F.col("doubled") > 0, "double booked").otherwise("genuine")
    evidence = F.concat_ws("; ", F.when(F.col("estimated") > 0, F.concat(F.col("estimated").cast("string"), F.lit(" estimated"))), F.when(F.col("doubled") > 0, F.concat(F.col("doubled").cast("string"), F.lit(" doubled"))))
    return top.select("booking_id", "service", num(F.col("net")).alias("net"), num(F.col("labour")).alias("labour"), num(F.col("margin")).alias("margin"), verdict.alias("verdict"), evidence.alias("evidence"))


def weekly_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, role, active, working): crew members between their first and last week, and those at work."""
    days = crew_days(spark, sf_dir).select("crew_id", "role", F.trunc("work_date", "WEEK").alias("week")).distinct()
    span = days.groupBy("crew_id", "role").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    active = span.select("role", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week")).groupBy("week", "role").agg(F.count(F.lit(1)).alias("active"))
    working = days.groupBy("week", "role").agg(F.count(F.lit(1)).alias("working"))
    return active.join(working, ["week", "role"], "left").select("week", "role", "active", F.coalesce("working", F.lit(0)).alias("working"))


def q04_weekly_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per week: active crew, working crew, utilisation, and the role whose utilisation binds."""
    use = F.col("working") / F.col("active")
    weeks = weekly_utilisation(spark, sf_dir).groupBy("week").agg(F.sum("active").alias("active"), F.sum("working").alias("working"), F.min_by("role", F.struct(-use, F.col("role"))).alias("binding_role"), F.round(F.max(use), 6).alias("binding_use"))
    return weeks.select("week", "active", "working", ratio(F.col("working"), F.col("active")).alias("utilisation"), "binding_role", "binding_use")


def q05_fx_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by currency and year at the rate of the event and of the base date, with sub-totals."""
    fx = F.broadcast(fx_daily(spark, sf_dir))
    base = F.broadcast(fx_daily(spark, sf_dir).filter(F.col("rate_date") == F.lit(BASE_DATE).cast("date")).select("currency", F.col("rate").alias("base_rate")))
    jobs = live(bookings(spark, sf_dir)).withColumnRenamed("shoot_date", "rate_date").join(fx, ["currency", "rate_date"]).join(base, "currency")
    own = F.col("net").cast("double") / F.col("rate").cast("double")
    out = jobs.withColumn("year", F.year("rate_date")).rollup("currency", "year").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("jobs"), F.sum("net").alias("net"), F.sum(F.round(own * F.col("base_rate").cast("double"), 2).cast("decimal(18,2)")).alias("at_base"),
        F.avg((F.col("rate") > F.col("base_rate")).cast("int")).alias("above"),
    )
    return out.select("currency", F.col("year").cast("int").alias("year"), "level", "jobs", num(F.col("net")).alias("at_event"), num(F.col("at_base")).alias("at_base"), F.round("above", 6).alias("share_above_base"))


def q07_unit_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, revenue, cost, refunds and contribution by collection, with a loss flag."""
    lines = merch_lines(spark, sf_dir).filter("is_revenue")
    net = F.col("gross") - F.col("discount") - F.col("refunded") - F.col("cogs")
    out = lines.groupBy("collection").agg(F.sum("quantity").alias("units"), F.sum("gross").alias("gross"), F.sum("discount").alias("discount"), F.sum("cogs").alias("cogs"), F.sum("refunded").alias("refunded"), F.sum(net).alias("contribution"), F.count_if(F.col("cogs") > F.col("gross")).alias("below"))
    return out.withColumn("n", F.sum("below").over(W.partitionBy())).select(
        "collection", "units", *[num(F.col(c)).alias(c) for c in ("gross", "discount", "cogs", "refunded", "contribution")],
        ratio(F.col("contribution"), F.col("gross") - F.col("discount")).alias("margin"), (F.col("contribution") < 0).alias("is_loss"), F.col("n").alias("lines_below_cost"),
    )


def q08_refunds_by_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refund rate of each SKU against the store's, and the reason with the largest refunds."""
    lines = merch_lines(spark, sf_dir, priced=False)
    reasons = merch_lines(spark, sf_dir, priced=False, by_sku=True).groupBy("sku", "reason").agg(F.sum("gross").alias("gross"), F.sum("refunded").alias("refunded"), F.bool_or("has_refund").alias("has_refund"))
    most = F.min_by("reason", F.when(F.col("has_refund"), F.struct(-F.col("refunded"), "reason")))
    sku = reasons.groupBy("sku").agg(F.sum("gross").alias("gross"), F.sum("refunded").alias("refunded"), most.alias("top_reason"))
    store = lines.agg(ratio(F.sum("refunded"), F.sum("gross")).alias("store_rate"))
    return sku.crossJoin(F.broadcast(store)).select("sku", num(F.col("gross")).alias("gross"), num(F.col("refunded")).alias("refunded"), ratio(F.col("refunded"), F.col("gross")).alias("rate"), "store_rate", "top_reason")


def q08b_refunds_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refunds by reason and their share of all."""
    per = merch_lines(spark, sf_dir, priced=False).filter("has_refund").groupBy("reason").agg(F.count(F.lit(1)).alias("refunds"), F.count_if("is_revenue").alias("counted"), F.sum("refunded").alias("amount"))
    everything = W.partitionBy()
    return per.select("reason", "refunds", "counted", num(F.col("amount")).alias("amount"), ratio(F.col("refunds"), F.sum("refunds").over(everything)).alias("share"))


def channel_by_quarter(spark: SparkSession, sf_dir: str, within=lambda df, day: df) -> DataFrame:
    """Sessions and spend side by side; either may be missing. within: a filter of both, told the column of days."""
    s = within(sessions(spark, sf_dir).filter("NOT is_bot"), "session_date").groupBy("channel", quarter("session_date").alias("quarter")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if("converted").alias("conversions"), F.sum("revenue").alias("revenue"))
    a = within(ad_spend(spark, sf_dir), "spend_date").groupBy("channel", quarter("spend_date").alias("quarter")).agg(F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return s.join(a, ["channel", "quarter"], "full")


def q09_channel_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion, cost per conversion, return on spend and cost per click by channel and quarter."""
    d = channel_by_quarter(spark, sf_dir)
    return d.select("channel", "quarter", "sessions", "conversions", num(F.col("revenue")).alias("revenue"), num(F.col("spend")).alias("spend"), "clicks",
        ratio(F.col("conversions"), F.col("sessions")).alias("conversion"), ratio(F.col("spend"), F.col("conversions")).alias("cac"), ratio(F.col("revenue"), F.col("spend")).alias("roas"), ratio(F.col("spend"), F.col("clicks")).alias("cpc"))


def q10_attribution_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted sessions, those whose order exists, and the revenue between, for all sessions and people's alone."""
    orders = bookings(spark, sf_dir, client=False).select(F.col("booking_id").alias("order_id"), F.lit(True).alias("known"))
    s = sessions(spark, sf_dir).filter("converted").join(orders, "order_id", "left")
    scoped = s.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.when(~F.col("is_bot"), "human")))))
    return scoped.groupBy("scope").agg(
        F.count(F.lit(1)).alias("converted"), F.count("known").alias("joined"), num(F.sum("revenue")).alias("revenue"), num(F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("revenue"))), F.lit(0))).alias("unattributed")
    )


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per client with a live booking: first day, lead source, whether another followed within 90 days."""
    b = live(bookings(spark, sf_dir)).select("client_id", "shoot_date", "booking_id", "lead_source")
    first = b.groupBy("client_id").agg(F.min(F.struct("shoot_date", "booking_id", "lead_source")).alias("first"))
    days = b.select("client_id", "shoot_date").join(first, "client_id")
    after = (F.col("shoot_date") > F.col("first.shoot_date")) & (F.col("shoot_date") <= F.date_add("first.shoot_date", 90))
    return days.groupBy("client_id").agg(F.min("first.shoot_date").alias("first_day"), F.min("first.lead_source").alias("channel"), F.max(after).alias("repeated"))


def q11_repeat_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat rate within 90 days of the first booking: by month, by channel, and over all."""
    c = first_orders(spark, sf_dir).withColumn("g", F.explode(F.array(
        F.struct(F.lit("month").alias("kind"), F.date_format("first_day", "yyyy-MM").alias("value")), F.struct(F.lit("channel").alias("kind"), F.col("channel").alias("value")), F.struct(F.lit("all").alias("kind"), F.lit("all").alias("value")))))
    return c.groupBy("g.kind", "g.value").agg(F.count(F.lit(1)).alias("clients"), F.count_if("repeated").alias("repeaters"), F.round(F.avg(F.col("repeated").cast("int")), 6).alias("rate"))


def q12_cross_sell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booking values of clients with and without web sessions: means, medians, Welch's t and degrees of freedom."""
    known = sessions(spark, sf_dir).select("client_id").distinct().withColumn("web", F.lit(True))
    v = live(bookings(spark, sf_dir, client=False)).join(known, "client_id", "left").select(F.coalesce("web", F.lit(False)).alias("web"), F.col("net").cast("double").alias("x"))
    middle = exact_percentiles(v, ["web"], "x", {"md": 0.5}).withColumnRenamed("__by", "web")
    s = v.groupBy("web").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")).join(middle, "web")
    one = lambda c, w: F.max(F.when(F.col("web") == w, F.col(c)))
    p = s.agg(*[one(c, w).alias(f"{c}{int(w)}") for c in ("n", "m", "v", "md") for w in (True, False)])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b))
    df = F.try_divide(F.pow(a + b, 2), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    return p.select(F.col("n1").alias("web_jobs"), F.col("n0").alias("other_jobs"), F.round("m1", 2).alias("web_mean"), F.round("m0", 2).alias("other_mean"), F.round("md1", 2).alias("web_median"), F.round("md0", 2).alias("other_median"), F.round(t, 6).alias("welch_t"), F.round(df, 3).alias("welch_df"))


def q14_monthly_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of both businesses, known costs, the gap and the share of known costs by month."""
    m, zero = (lambda c: F.trunc(c, "MM").alias("month")), F.lit(0).cast("decimal(28,2)")
    parts = [
        live(bookings(spark, sf_dir, client=False)).groupBy(m("shoot_date")).agg(F.sum("net").alias("revenue")).select("month", "revenue", zero.alias("cost")),
        merch_lines(spark, sf_dir).filter("is_revenue").groupBy(m("order_date")).agg(F.sum(F.col("gross") - F.col("discount")).alias("revenue"), F.sum(F.col("cogs") + F.col("refunded")).alias("cost")),
        crew_days(spark, sf_dir).groupBy(m("work_date")).agg(F.sum("labour_cost").alias("cost")).select("month", zero.alias("revenue"), "cost"),
    ]
    per = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("month").agg(F.sum("revenue").alias("r"), F.sum("cost").alias("c"))
    revenue, cost = F.coalesce("r", F.lit(0)), F.coalesce("c", F.lit(0))
    return per.select("month", num(revenue).alias("revenue"), num(cost).alias("known_cost"), num(revenue - cost).alias("gap"), ratio(cost, revenue).alias("cost_share"))


QUERIES = {f.__name__: f for f in (q02_service_by_year, q03_worst_margin_jobs, q04_weekly_utilisation, q05_fx_exposure, q07_unit_economics, q08_refunds_by_sku, q08b_refunds_by_reason, q09_channel_efficiency, q10_attribution_gap, q11_repeat_purchase, q12_cross_sell, q14_monthly_flow)}

ORACLES = {k: CORE_SQL + v for k, v in {
    "q02_service_by_year": """, p AS (SELECT service, year(shoot_date) AS year, count(*) AS jobs, sum(net) AS revenue, sum(net) FILTER (month(shoot_date) <= 6) AS h1 FROM live GROUP BY ALL)
SELECT service, year::INTEGER AS year, jobs, round(revenue::DOUBLE, 2) AS revenue, round(revenue::DOUBLE / sum(revenue) OVER (PARTITION BY year)::DOUBLE, 6) AS share,
  round((revenue - lag(revenue) OVER w)::DOUBLE / nullif((lag(revenue) OVER w)::DOUBLE, 0), 6) AS yoy, round((h1 - lag(h1) OVER w)::DOUBLE / nullif((lag(h1) OVER w)::DOUBLE, 0), 6) AS h1_yoy
FROM p WINDOW w AS (PARTITION BY service ORDER BY year)""",
    "q03_worst_margin_jobs": """, dbl AS (SELECT crew_id, work_date FROM crew_day GROUP BY ALL HAVING count(DISTINCT booking_id) > 1),
lab AS (SELECT booking_id, sum(labour_cost) AS labour, count(*) FILTER (rate_is_estimated) AS estimated, count(dbl.crew_id) AS doubled, count(*) AS days
  FROM crew_day c LEFT JOIN dbl ON c.crew_id = dbl.crew_id AND c.work_date = dbl.work_date GROUP BY booking_id)
SELECT booking_id, service, round(net::DOUBLE, 2) AS net, round(labour::DOUBLE, 2) AS labour, round((net - labour)::DOUBLE, 2) AS margin,
  CASE WHEN estimated * 2 > days THEN 'estimated' WHEN doubled > 0 THEN 'double booked' ELSE 'genuine' END AS verdict,
  concat_ws('; ', CASE WHEN estimated > 0 THEN estimated::VARCHAR || ' estimated' END, CASE WHEN doubled > 0 THEN doubled::VARCHAR || ' doubled' END) AS evidence
FROM live JOIN lab USING (booking_id) ORDER BY net - labour, booking_id LIMIT 20""",
    "q04_weekly_utilisation": """, d AS (SELECT DISTINCT crew_id, role, date_trunc('week', work_date)::DATE AS week FROM crew_day),
s AS (SELECT crew_id, role, min(week) AS a, max(week) AS b FROM d GROUP BY ALL),
r AS (SELECT w.week, s.role, count(*) AS active, count(d.crew_id) AS working FROM (SELECT DISTINCT week FROM (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM d)) w
  JOIN s ON w.week BETWEEN s.a AND s.b LEFT JOIN d ON d.week = w.week AND d.crew_id = s.crew_id GROUP BY ALL)
SELECT week, sum(active)::BIGINT AS active, sum(working)::BIGINT AS working, round(sum(working)::DOUBLE / sum(active), 6) AS utilisation,
  first(role ORDER BY working / active DESC, role) AS binding_role, round(max(working / active), 6) AS binding_use FROM r GROUP BY week""",
    "q05_fx_exposure": f""", j AS (SELECT live.*, year(shoot_date) AS year, fx.rate, b.rate AS base_rate FROM live JOIN fx ON fx.currency = live.currency AND rate_date = shoot_date JOIN fx b ON b.currency = live.currency AND b.rate_date = DATE '{BASE_DATE}')
SELECT currency, year::INTEGER AS year, grouping(currency, year)::INTEGER AS level, count(*) AS jobs, round(sum(net)::DOUBLE, 2) AS at_event, round(sum(round(net::DOUBLE / rate::DOUBLE * base_rate::DOUBLE, 2)::DECIMAL(18,2))::DOUBLE, 2) AS at_base,
  round(avg((rate > base_rate)::INT), 6) AS share_above_base FROM j GROUP BY ROLLUP (currency, year)""",
    "q07_unit_economics": """, f AS (SELECT * FROM line WHERE is_revenue), g AS (SELECT collection, sum(quantity)::BIGINT AS units, sum(gross) AS gross, sum(discount) AS discount, sum(cogs) AS cogs, sum(refunded) AS refunded, sum(gross - discount - refunded - cogs) AS contribution FROM f GROUP BY 1)
SELECT collection, units, round(gross::DOUBLE, 2) AS gross, round(discount::DOUBLE, 2) AS discount, round(cogs::DOUBLE, 2) AS cogs, round(refunded::DOUBLE, 2) AS refunded, round(contribution::DOUBLE, 2) AS contribution,
  round(contribution::DOUBLE / nullif((gross - discount)::DOUBLE, 0), 6) AS margin, contribution < 0 AS is_loss, (SELECT count(*) FROM f WHERE cogs > gross) AS lines_below_cost FROM g""",
    "q08_refunds_by_sku": """, st AS (SELECT round(sum(refunded)::DOUBLE / sum(gross)::DOUBLE, 6) AS store_rate FROM line), s AS (SELECT sku, sum(gross) AS gross, sum(refunded) AS refunded FROM line GROUP BY 1),
t AS (SELECT sku, first(reason ORDER BY a DESC, reason) AS top_reason FROM (SELECT sku, reason, sum(refunded) AS a FROM line WHERE has_refund GROUP BY ALL) GROUP BY sku)
SELECT sku, round(gross::DOUBLE, 2) AS gross, round(refunded::DOUBLE, 2) AS refunded, round(refunded::DOUBLE / nullif(gross::DOUBLE, 0), 6) AS rate, store_rate, top_reason FROM s LEFT JOIN t USING (sku), st""",
    "q08b_refunds_by_reason": """SELECT reason, count(*) AS refunds, count(*) FILTER (is_revenue) AS counted, round(sum(refunded)::DOUBLE, 2) AS amount, round(count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM line WHERE has_refund GROUP BY reason""",
    "q09_channel_efficiency": """, s AS (SELECT channel, year(session_date)::VARCHAR || 'Q' || quarter(session_date)::VARCHAR AS quarter, count(*) AS sessions, count(*) FILTER (converted) AS conversions, sum(revenue) AS revenue FROM session WHERE NOT is_bot GROUP BY ALL),
a AS (SELECT channel, year(spend_date)::VARCHAR || 'Q' || quarter(spend_date)::VARCHAR AS quarter, sum(spend) AS spend, sum(clicks)::BIGINT AS clicks FROM spend GROUP BY ALL)
SELECT channel, quarter, sessions, conversions, round(revenue::DOUBLE, 2) AS revenue, round(spend::DOUBLE, 2) AS spend, clicks, round(conversions::DOUBLE / nullif(sessions, 0)::DOUBLE, 6) AS conversion,
  round(spend::DOUBLE / nullif(conversions, 0)::DOUBLE, 6) AS cac, round(revenue::DOUBLE / nullif(spend::DOUBLE, 0), 6) AS roas, round(spend::DOUBLE / nullif(clicks, 0)::DOUBLE, 6) AS cpc FROM s FULL JOIN a USING (channel, quarter)""",
    "q10_attribution_gap": """, c AS (SELECT s.*, b.booking_id IS NOT NULL AS known FROM session s LEFT JOIN booking b ON s.order_id = b.booking_id WHERE converted)
SELECT scope, count(*) AS converted, count(*) FILTER (known) AS joined, round(sum(revenue)::DOUBLE, 2) AS revenue, round(coalesce(sum(revenue) FILTER (NOT known), 0)::DOUBLE, 2) AS unattributed
FROM (SELECT 'all' AS scope, * FROM c UNION ALL SELECT 'human', * FROM c WHERE NOT is_bot) GROUP BY scope""",
    "q11_repeat_purchase": """, f AS (SELECT DISTINCT ON (client_id) client_id, shoot_date AS first_day, lead_source AS channel FROM live ORDER BY client_id, shoot_date, booking_id),
c AS (SELECT f.*, EXISTS (SELECT 1 FROM live l WHERE l.client_id = f.client_id AND l.shoot_date > first_day AND l.shoot_date <= first_day + 90) AS repeated FROM f)
SELECT kind, value, count(*) AS clients, count(*) FILTER (repeated) AS repeaters, round(avg(repeated::INT), 6) AS rate FROM (
  SELECT 'month' AS kind, strftime(first_day, '%Y-%m') AS value, repeated FROM c UNION ALL SELECT 'channel', channel, repeated FROM c UNION ALL SELECT 'all', 'all', repeated FROM c) GROUP BY ALL""",
    "q12_cross_sell": """, v AS (SELECT client_id IN (SELECT client_id FROM session) AS web, net::DOUBLE AS x FROM live),
s AS (SELECT count(*) FILTER (web) AS n1, count(*) FILTER (NOT web) AS n0, avg(x) FILTER (web) AS m1, avg(x) FILTER (NOT web) AS m0, var_samp(x) FILTER (web) AS v1, var_samp(x) FILTER (NOT web) AS v0, median(x) FILTER (web) AS md1, median(x) FILTER (NOT web) AS md0 FROM v)
SELECT n1 AS web_jobs, n0 AS other_jobs, round(m1, 2) AS web_mean, round(m0, 2) AS other_mean, round(md1, 2) AS web_median, round(md0, 2) AS other_median, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS welch_t,
  round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 3) AS welch_df FROM s""",
    "q14_monthly_flow": """, b AS (SELECT date_trunc('month', shoot_date)::DATE AS month, sum(net) AS x FROM live GROUP BY 1), m AS (SELECT date_trunc('month', order_date)::DATE AS month, sum(gross - discount) AS x, sum(cogs + refunded) AS c FROM line WHERE is_revenue GROUP BY 1),
l AS (SELECT date_trunc('month', work_date)::DATE AS month, sum(labour_cost) AS c FROM crew_day GROUP BY 1), s AS (SELECT month FROM b UNION SELECT month FROM m UNION SELECT month FROM l),
t AS (SELECT s.month, coalesce(b.x, 0) + coalesce(m.x, 0) AS revenue, coalesce(m.c, 0) + coalesce(l.c, 0) AS cost FROM s LEFT JOIN b USING (month) LEFT JOIN m USING (month) LEFT JOIN l USING (month))
SELECT month, round(revenue::DOUBLE, 2) AS revenue, round(cost::DOUBLE, 2) AS known_cost, round((revenue - cost)::DOUBLE, 2) AS gap, round(cost::DOUBLE / nullif(revenue::DOUBLE, 0), 6) AS cost_share FROM t""",
}.items()}
