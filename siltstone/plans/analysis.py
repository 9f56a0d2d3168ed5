"""The second layer: analyses A1 to A23 on the star schema, and the metric layer M0 to M14 with its filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import chi_square_tail
from siltstone.plans.core import BASE_DATE, CHANNELS, CORE_SQL, ad_spend, bookings, crew_days, fx_daily, live, merch_lines, num, quarter, ratio, sessions
from siltstone.plans.questions import channel_by_quarter, first_orders, q14_monthly_flow, weekly_utilisation
from siltstone.sources.tables import table

W = Window


def N() -> Column:  # noqa: N802
    """Number of rows."""
    return F.count(F.lit(1))


def _one(df: DataFrame) -> DataFrame:
    return F.broadcast(df)


def _base(spark, sf_dir):
    return fx_daily(spark, sf_dir).filter(F.col("rate_date") == F.lit(BASE_DATE).cast("date")).select("currency", F.col("rate").alias("base_rate"))


def _at_rates(spark, sf_dir):
    fx = F.broadcast(fx_daily(spark, sf_dir)).withColumnRenamed("rate_date", "shoot_date")
    return live(bookings(spark, sf_dir)).join(fx, ["currency", "shoot_date"]).join(F.broadcast(_base(spark, sf_dir)), "currency")


def a01_constant_currency(spark, sf_dir):
    """A1: quarterly revenue at the rate of the event and of the base date, its equivalent in the bookings' currencies, index with the mean quarter of 1997 as 100."""
    at_base = F.when(F.col("currency") == "NGN", F.col("net").cast("double")).otherwise(F.col("net").cast("double") / F.col("rate").cast("double") * F.col("base_rate").cast("double"))
    q = _at_rates(spark, sf_dir).groupBy(quarter("shoot_date").alias("quarter")).agg(F.sum("net").alias("revenue"), F.sum(F.round(at_base, 2).cast("decimal(18,2)")).alias("constant"), F.avg(F.col("rate").cast("double")).alias("rate"), F.sum(F.round(F.col("net").cast("double") / F.col("rate").cast("double"), 2).cast("decimal(18,2)")).alias("foreign"))
    mean = q.filter("quarter LIKE '1997%'").agg(F.avg(F.col("revenue").cast("double")).alias("mean"))
    return q.crossJoin(_one(mean)).select("quarter", num(F.col("revenue")).alias("revenue"), num(F.col("constant")).alias("constant"), num(F.col("foreign")).alias("foreign_equivalent"), F.round("rate", 6).alias("avg_rate"), F.round(F.col("revenue").cast("double") / F.col("mean") * 100, 4).alias("index"))


def a02_yearly_growth(spark, sf_dir):
    """A2: years and first halves, with growth."""
    y = live(bookings(spark, sf_dir, client=False)).groupBy(F.year("shoot_date").alias("year")).agg(F.sum("net").alias("r"), F.sum(F.when(F.month("shoot_date") <= 6, F.col("net"))).alias("h"))
    w = W.orderBy("year")
    return y.select("year", num(F.col("r")).alias("revenue"), num(F.col("h")).alias("h1"), ratio(F.col("r") - F.lag("r").over(w), F.lag("r").over(w)).alias("yoy"), ratio(F.col("h") - F.lag("h").over(w), F.lag("h").over(w)).alias("h1_yoy"))


def a03_service_mix(spark, sf_dir):
    """A3: jobs, revenue, mean job and shares by service."""
    s = live(bookings(spark, sf_dir, client=False)).groupBy("service").agg(N().alias("jobs"), F.sum("net").alias("r"))
    e = W.partitionBy()
    return s.select("service", "jobs", num(F.col("r")).alias("revenue"), ratio(F.col("r"), F.col("jobs"), 2).alias("mean_job"), ratio(F.col("r"), F.sum("r").over(e)).alias("revenue_share"), ratio(F.col("jobs"), F.sum("jobs").over(e)).alias("job_share"))


def a04_status_mix(spark, sf_dir):
    """A4: states by year, and the share of revenue that was not completed."""
    s = bookings(spark, sf_dir, client=False).groupBy(F.year("shoot_date").alias("year"), "status").agg(N().alias("jobs"), F.sum("net").alias("r"))
    y = W.partitionBy("year")
    return s.select("year", "status", "jobs", num(F.col("r")).alias("revenue"), ratio(F.col("jobs"), F.sum("jobs").over(y)).alias("share"), ratio(F.sum(F.when(F.col("status") != "Completed", F.col("r")).otherwise(0)).over(y), F.sum("r").over(y)).alias("not_completed"))


def a05_job_margins(spark, sf_dir):
    """A5: by service, jobs, losses, losses on estimated rates alone, jobs without labour, margin."""
    lab = crew_days(spark, sf_dir).groupBy("booking_id").agg(F.sum("labour_cost").alias("labour"), F.bool_and("rate_is_estimated").alias("estimated"))
    j = live(bookings(spark, sf_dir, client=False)).join(lab, "booking_id", "left")
    m = F.col("net") - F.coalesce("labour", F.lit(0))
    return j.groupBy("service").agg(N().alias("jobs"), F.count_if(m < 0).alias("losses"), F.count_if((m < 0) & F.col("estimated")).alias("artefacts"), F.count_if(F.col("labour").isNull()).alias("without_labour"), num(F.sum(m)).alias("margin"))


def a06_seasonality(spark, sf_dir):
    """Jobs by month of the year over the years in which no month is without one, and their rank."""
    per = live(bookings(spark, sf_dir, client=False)).groupBy(F.year("shoot_date").alias("year"), F.month("shoot_date").alias("month")).agg(N().alias("jobs"))
    years = per.groupBy("year").agg(F.collect_list(F.struct("month", "jobs")).alias("months")).filter(F.size("months") == 12)
    m = years.select(F.explode("months").alias("x")).groupBy("x.month").agg(F.sum("x.jobs").alias("jobs"), N().alias("years"))
    return m.select("month", "jobs", F.round(F.col("jobs") / F.col("years"), 6).alias("per_year"), F.row_number().over(W.orderBy(F.desc("jobs"), "month")).alias("rank"))


def a07_double_bookings(spark, sf_dir):
    """Crew members on several jobs on one day, by month."""
    d = crew_days(spark, sf_dir).groupBy("crew_id", "work_date").agg(F.countDistinct("booking_id").alias("jobs")).filter("jobs > 1")
    return d.groupBy(F.date_format("work_date", "yyyy-MM").alias("month")).agg(N().alias("double_bookings"), F.max("jobs").alias("most_jobs"))


def a07_double_booking_summary(spark, sf_dir):
    """All double bookings, their share in peak months, and the week with most of them (the first one of these)."""
    d = crew_days(spark, sf_dir).groupBy("crew_id", "work_date").agg(F.countDistinct("booking_id").alias("jobs")).filter("jobs > 1")
    weeks = d.groupBy(F.trunc("work_date", "WEEK").alias("week")).agg(N().alias("n"), F.count_if(F.month("work_date").isin(11, 12)).alias("peak"))
    return weeks.agg(F.sum("n").alias("double_bookings"), ratio(F.sum("peak"), F.sum("n")).alias("peak_share"), F.min_by("week", F.struct(-F.col("n"), F.col("week"))).alias("worst_week"), F.max("n").alias("in_worst_week"))


def a08_long_days(spark, sf_dir):
    """Share of days over 12 hours by month."""
    return crew_days(spark, sf_dir).groupBy(F.date_format("work_date", "yyyy-MM").alias("month")).agg(F.round(F.try_divide(F.count_if(F.col("hours") > 12), F.count("hours")), 6).alias("long_share"))


def a09_utilisation_summary(spark, sf_dir):
    """Utilisation without the weeks of ramp-up: median, peak, weeks, and the role that binds most often."""
    roles = weekly_utilisation(spark, sf_dir).withColumn("use", F.col("working") / F.col("active"))
    weeks = roles.groupBy("week").agg(F.sum("active").alias("active"), (F.sum("working") / F.sum("active")).alias("use"))
    full = weeks.crossJoin(_one(weeks.agg(F.max("active").alias("most")))).filter(F.col("active") >= 0.9 * F.col("most"))
    binding = roles.withColumn("r", F.row_number().over(W.partitionBy("week").orderBy(F.desc("use"), "role"))).filter("r = 1").join(full.select("week"), "week").groupBy("role").agg(N().alias("n"))
    return full.agg(N().alias("weeks"), F.round(F.percentile("use", F.lit(0.5)), 6).alias("median"), F.round(F.max("use"), 6).alias("peak")).crossJoin(_one(binding.agg(F.min_by("role", F.struct(-F.col("n"), "role")).alias("binding_role"))))


def a10_devaluation(spark, sf_dir):
    """A10: local-currency jobs in USD at the rate of the event and of the base date, by year, with the rates of its first and
    last day with a job."""
    usd = fx_daily(spark, sf_dir).filter("currency = 'USD'").select(F.col("rate_date").alias("shoot_date"), "rate")
    base = _base(spark, sf_dir).filter("currency = 'USD'").select("base_rate")
    j = live(bookings(spark, sf_dir)).filter("currency = 'NGN'").join(F.broadcast(usd), "shoot_date").crossJoin(_one(base))
    at = lambda r: F.sum(F.col("net").cast("double") / F.col(r).cast("double"))
    return j.groupBy(F.year("shoot_date").alias("year")).agg(F.round(at("rate"), 1).alias("usd"), F.round(at("base_rate"), 1).alias("usd_at_base"), F.round(at("rate") - at("base_rate"), 1).alias("gain"), num(F.min_by("rate", "shoot_date"), 6).alias("first_rate"), num(F.max_by("rate", "shoot_date"), 6).alias("last_rate"))


def _contribution():
    return F.col("gross") - F.col("discount") - F.col("refunded") - F.col("cogs")


def a11_contribution(spark, sf_dir):
    """Contribution by collection and quarter, with the number of losing groups."""
    g = merch_lines(spark, sf_dir).filter("is_revenue").groupBy("collection", quarter("order_date").alias("quarter")).agg(F.sum(_contribution()).alias("c"))
    return g.select("collection", "quarter", num(F.col("c")).alias("contribution"), F.count_if(F.col("c") < 0).over(W.partitionBy()).alias("losing_groups"))


def a11_sku_contribution(spark, sf_dir):
    """Contribution and units by SKU, and whether it loses."""
    g = merch_lines(spark, sf_dir).filter("is_revenue").groupBy("sku").agg(F.sum(_contribution()).alias("c"), F.sum("quantity").alias("units"))
    return g.select("sku", num(F.col("c")).alias("contribution"), "units", (F.col("c") < 0).alias("is_loss"))


def a12_below_cost(spark, sf_dir):
    """Lines sold below cost, and the shortfall."""
    return merch_lines(spark, sf_dir).filter((F.col("gross") < F.col("cogs")) & (F.col("quantity") > 0)).agg(N().alias("n"), num(F.coalesce(F.sum(F.col("cogs") - F.col("gross")), F.lit(0))).alias("shortfall"))


def a13_sensitivity(spark, sf_dir):
    """Merchandise totals under several filters in one pass."""
    t = lambda c: num(F.sum(F.when(c, F.col("gross")).otherwise(0)))
    return merch_lines(spark, sf_dir, priced=False).agg(t(F.lit(True)).alias("everything"), t(F.col("is_revenue")).alias("recognised"), t(F.col("order_status") != "pending").alias("without_pending"), t(F.col("order_status") != "cancelled").alias("without_cancelled"), t(F.col("quantity") > 0).alias("positive"))


def a14_refunded_orders(spark, sf_dir):
    """Share of orders with a refund."""
    return merch_lines(spark, sf_dir, priced=False).agg(ratio(F.countDistinct(F.when(F.col("has_refund"), F.col("order_id"))), F.countDistinct("order_id")).alias("share"))


def a15_channel_totals(spark, sf_dir):
    """Totals and ratios by channel."""
    c = channel_by_quarter(spark, sf_dir).groupBy("channel").agg(*[F.sum(x).alias(x) for x in ("sessions", "conversions", "revenue", "spend", "clicks")])
    return c.select("channel", ratio(F.col("conversions"), F.col("sessions")).alias("conversion"), ratio(F.col("spend"), F.col("conversions")).alias("cac"), ratio(F.col("revenue"), F.col("spend")).alias("roas"), ratio(F.col("spend"), F.col("clicks")).alias("cpc"))


def a16_attributed_revenue(spark, sf_dir):
    """Value of the orders that converted sessions name, by channel, and its return on the channel's spend."""
    per = merch_lines(spark, sf_dir, priced=False).groupBy("order_id").agg(F.sum("gross").alias("gross"))
    named = sessions(spark, sf_dir).filter("converted").join(per, "order_id").groupBy("channel").agg(N().alias("sessions"), F.sum("gross").alias("g"))
    spend = ad_spend(spark, sf_dir).groupBy("channel").agg(F.sum("spend").alias("s"))
    return named.join(spend, "channel", "left").select("channel", "sessions", num(F.col("g")).alias("attributed"), ratio(F.col("g"), F.col("s")).alias("attributed_roas"))


def a17_traffic(spark, sf_dir):
    """Traffic counts, and conversion with and without bots."""
    human = ~F.col("is_bot")
    return sessions(spark, sf_dir).agg(N().alias("all_sessions"), F.count_if("is_bot").alias("bots"), F.count_if("is_spam").alias("spam"), F.count_if(human).alias("human"), ratio(F.count_if("converted"), N()).alias("naive"), ratio(F.count_if(F.col("converted") & human), F.count_if(human)).alias("human_rate"))


def a18_lead_sources(spark, sf_dir):
    """Bookings by lead source, and which share of each would pay for all advertising."""
    s = live(bookings(spark, sf_dir)).groupBy("lead_source").agg(N().alias("jobs"), F.sum("net").alias("r"))
    spend = ad_spend(spark, sf_dir).agg(F.sum("spend").alias("spend"))
    return s.crossJoin(_one(spend)).select("lead_source", "jobs", num(F.col("r")).alias("revenue"), ratio(F.col("jobs"), F.sum("jobs").over(W.partitionBy())).alias("share"), ratio(F.col("spend"), F.col("r"), 9).alias("break_even"))


def a19_campaigns(spark, sf_dir):
    """Spend by campaign and by set of campaigns."""
    c = ad_spend(spark, sf_dir).withColumn("campaign_set", F.when(F.col("campaign").isin("campaign0", "campaign1"), "brand").otherwise("other"))
    return c.groupBy("campaign_set", "campaign").agg(num(F.sum("spend")).alias("spend"), F.sum("clicks").alias("clicks"))


def a19_contribution_per_spend(spark, sf_dir):
    """Merchandise contribution for each unit of spend, with what each set of campaigns has of it."""
    sets = ad_spend(spark, sf_dir).agg(F.sum("spend").alias("s"), F.sum(F.when(F.col("campaign").isin("campaign0", "campaign1"), F.col("spend"))).alias("b"))
    c = merch_lines(spark, sf_dir).filter("is_revenue").agg(F.sum(_contribution()).alias("c"))
    return c.crossJoin(_one(sets)).select(num(F.col("c")).alias("contribution"), num(F.col("s")).alias("spend"), ratio(F.col("c"), F.col("s")).alias("per_spend"), ratio(F.col("b"), F.col("s")).alias("brand_share"))


def a20_repeat_chi_square(spark, sf_dir):
    """Chi-square statistic, degrees of freedom and p value of repeat against channel."""
    c = first_orders(spark, sf_dir).groupBy("channel", "repeated").agg(N().alias("n"))
    cells = c.groupBy("channel").pivot("repeated", [False, True]).agg(F.sum("n")).na.fill(0).toDF("channel", "no", "yes")
    t = cells.agg(F.sum("no").alias("tn"), F.sum("yes").alias("ty"), N().alias("rows"))
    e = lambda x: (F.col("no") + F.col("yes")) * F.col(x) / (F.col("tn") + F.col("ty"))
    part = lambda o, x: F.try_divide(F.pow(F.col(o) - e(x), 2), e(x))
    found = cells.crossJoin(_one(t)).agg((F.sum(part("no", "tn")) + F.sum(part("yes", "ty"))).alias("x"), (N() - 1).cast("int").alias("df"))
    return found.select(F.round("x", 6).alias("statistic"), "df", F.round(chi_square_tail(F.col("x"), F.col("df")), 6).alias("p"))


def a21_customers(spark, sf_dir):
    """Channel with the lowest and highest repeat rate, clients that both businesses have, and the share of merchandise
    lines of clients that no session knows."""
    rates = first_orders(spark, sf_dir).groupBy("channel").agg(F.round(F.avg(F.col("repeated").cast("int")), 6).alias("rate"))
    best = rates.agg(F.min_by("channel", F.struct("rate", "channel")).alias("lowest"), F.min("rate").alias("lowest_rate"), F.min_by("channel", F.struct(-F.col("rate"), "channel")).alias("highest"), F.max("rate").alias("highest_rate"))
    both = live(bookings(spark, sf_dir)).select("client_id").distinct().join(sessions(spark, sf_dir).select("client_id").distinct(), "client_id", "left_semi").agg(N().alias("in_both"))
    known = sessions(spark, sf_dir).select("client_id").distinct().withColumn("known", F.lit(True))
    buyers = bookings(spark, sf_dir, client=False).select(F.col("booking_id").alias("l_orderkey"), "client_id").join(known, "client_id", "left")
    guests = table(spark, sf_dir, "lineitem").select("l_orderkey").join(buyers, "l_orderkey", "left").agg(F.round(F.avg(F.col("known").isNull().cast("int")), 6).alias("guest_line_share"))
    return best.crossJoin(_one(both)).crossJoin(_one(guests))


def a22_yearly_flow(spark, sf_dir):
    """Money flow by year, with job counts."""
    y = q14_monthly_flow(spark, sf_dir).groupBy(F.year("month").alias("year")).agg(*[F.sum(F.col(c).cast("decimal(18,2)")).alias(c) for c in ("revenue", "known_cost", "gap")])
    jobs = live(bookings(spark, sf_dir)).groupBy(F.year("shoot_date").alias("year")).agg(N().alias("jobs"))
    return y.join(jobs, "year", "left").select("year", num(F.col("revenue")).alias("revenue"), num(F.col("known_cost")).alias("known_cost"), num(F.col("gap")).alias("gap"), ratio(F.col("known_cost"), F.col("revenue")).alias("cost_share"), "jobs")


def a23_quality_tile(spark, sf_dir):
    """Rows that the quarantine rules reject, revenue at risk, and its share."""
    l = merch_lines(spark, sf_dir, priced=False)  # noqa: E741
    bad = F.col("sku") % 37 == 0
    return l.agg(F.count_if(bad).alias("rejected"), num(F.sum(F.when(bad & F.col("is_revenue"), F.col("gross")).otherwise(0))).alias("at_risk"), ratio(F.sum(F.when(bad & F.col("is_revenue"), F.col("gross")).otherwise(0)), F.sum(F.when(F.col("is_revenue"), F.col("gross")))).alias("share"))


@dataclass(frozen=True)
class Filters:
    """M0: a range of days, services and channels; None takes all."""

    start: str = "1900-01-01"
    end: str = "9999-12-31"
    services: tuple[str, ...] | None = None
    channels: tuple[str, ...] | None = None

    def on(self, df: DataFrame, day: str) -> DataFrame:
        """`df` within the filters that its columns can meet."""
        out = df.filter(F.col(day).between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date")))
        for column, values in (("service", self.services), ("channel", self.channels)):
            if values is not None and column in df.columns:
                out = out.filter(F.col(column).isin(*values))
        return out


#: What the registered metric queries ask for.
ASKED = Filters("1996-01-01", "1999-12-31", ("1-URGENT", "2-HIGH", "3-MEDIUM"))
WEB = Filters("2024-01-05", "2024-01-25", None, ("click", "view", "display"))


def metric_bookings(spark, sf_dir, f: Filters = ASKED) -> DataFrame:
    """M2: live bookings within the filters."""
    return f.on(live(bookings(spark, sf_dir, client=False)), "shoot_date")


def m02_production(spark, sf_dir, f: Filters = ASKED):
    """M0, M1, M2: production by quarter."""
    return metric_bookings(spark, sf_dir, f).groupBy(quarter("shoot_date").alias("quarter")).agg(num(F.sum("net")).alias("revenue"))


def m03_services(spark, sf_dir, f: Filters = ASKED):
    """M3: jobs, revenue, labour, losses, margin and share by service."""
    lab = crew_days(spark, sf_dir).groupBy("booking_id").agg(F.sum("labour_cost").alias("labour"))
    m = F.col("net") - F.coalesce("labour", F.lit(0))
    s = metric_bookings(spark, sf_dir, f).join(lab, "booking_id", "left").groupBy("service").agg(N().alias("jobs"), F.sum("net").alias("r"), F.sum(m).alias("m"), F.count_if(m < 0).alias("losses"))
    return s.select("service", "jobs", num(F.col("r")).alias("revenue"), "losses", ratio(F.col("m"), F.col("r")).alias("margin"), ratio(F.col("r"), F.sum("r").over(W.partitionBy())).alias("share"))


def m04_jobs_per_month(spark, sf_dir):
    """M4: jobs per month."""
    return metric_bookings(spark, sf_dir).groupBy(F.trunc("shoot_date", "MM").alias("month")).agg(N().alias("jobs"))


def m05_status_mix(spark, sf_dir):
    """M5: value by state."""
    return ASKED.on(bookings(spark, sf_dir, client=False), "shoot_date").groupBy("status").agg(num(F.sum("net")).alias("value"))


def m06_merch_quarters(spark, sf_dir):
    """M6: merchandise by quarter."""
    return ASKED.on(merch_lines(spark, sf_dir, priced=False).filter("is_revenue"), "order_date").groupBy(quarter("order_date").alias("quarter")).agg(num(F.sum("gross")).alias("gross"), num(F.sum("refunded")).alias("refunded"))


def m07_collections(spark, sf_dir, f: Filters = ASKED):
    """M7: margin and refund rate by collection."""
    c = f.on(merch_lines(spark, sf_dir).filter("is_revenue"), "order_date").groupBy("collection").agg(F.sum("gross").alias("g"), F.sum(_contribution()).alias("c"), F.sum("refunded").alias("f"))
    return c.select("collection", num(F.col("g")).alias("gross"), ratio(F.col("c"), F.col("g")).alias("margin"), ratio(F.col("f"), F.col("g")).alias("refund_rate"))


def m08_refund_reasons(spark, sf_dir):
    """M8: refunds by reason, dated by the first day of their order."""
    l = merch_lines(spark, sf_dir, priced=False)  # noqa: E741
    first = l.groupBy("order_id").agg(F.min("order_date").alias("first_day"))
    r = ASKED.on(l.filter("has_refund").join(first, "order_id"), "first_day").groupBy("reason").agg(F.sum("refunded").alias("a"))
    return r.select("reason", num(F.col("a")).alias("amount"), ratio(F.col("a"), F.sum("a").over(W.partitionBy())).alias("share"))


def m09_channels(spark, sf_dir):
    """M9: people's sessions and spend by channel in the fixed order of channels; missing is 0."""
    s = WEB.on(sessions(spark, sf_dir).filter("NOT is_bot"), "session_date").groupBy("channel").agg(N().alias("sessions"), F.count_if("converted").alias("conversions"))
    a = WEB.on(ad_spend(spark, sf_dir), "spend_date").groupBy("channel").agg(num(F.sum("spend")).alias("spend"))
    place = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel"))
    return s.join(a, "channel", "full").na.fill(0, ["sessions", "conversions"]).na.fill(0.0, ["spend"]).withColumn("place", place)


def m10_channel_quarters(spark, sf_dir, f: Filters = WEB):
    """Spend, revenue and return by channel and quarter within the filters."""
    d = channel_by_quarter(spark, sf_dir, f.on)
    return d.select("channel", "quarter", num(F.coalesce("spend", F.lit(0))).alias("spend"), num(F.coalesce("revenue", F.lit(0))).alias("revenue"), ratio(F.col("revenue"), F.col("spend")).alias("roas"))


def m11_attribution(spark, sf_dir, f: Filters = Filters(WEB.start, WEB.end)):
    """Converted, joined and unattributed within the filters."""
    known = bookings(spark, sf_dir, client=False).select(F.col("booking_id").alias("order_id"), F.lit(True).alias("known"))
    s = f.on(sessions(spark, sf_dir).filter("converted"), "session_date").join(known, "order_id", "left")
    return s.agg(N().alias("converted"), F.count("known").alias("joined"), num(F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("revenue"))), F.lit(0))).alias("unattributed"))


def m12_traffic(spark, sf_dir, f: Filters = Filters(WEB.start, WEB.end)):
    """Traffic quality within the filters."""
    return f.on(sessions(spark, sf_dir), "session_date").agg(N().alias("sessions"), F.count_if("is_bot").alias("bots"), F.count_if("is_spam").alias("spam"))


def m14_headlines(spark, sf_dir):
    """Blended margin, refund rate, and return of paid channels that have both sessions and spend."""
    c = ASKED.on(merch_lines(spark, sf_dir).filter("is_revenue"), "order_date").agg(ratio(F.sum(_contribution()), F.sum("gross")).alias("margin"), ratio(F.sum("refunded"), F.sum("gross")).alias("refund_rate"))
    p = channel_by_quarter(spark, sf_dir, WEB.on).filter("sessions > 0 AND spend > 0").agg(ratio(F.sum("revenue"), F.sum("spend")).alias("paid_roas"))
    return c.crossJoin(_one(p))


QUERIES = {n: f for n, f in dict(globals()).items() if n[0] in "am" and n[1:3].isdigit()}

_CON = "gross - discount - refunded - cogs"
_Q = lambda d: f"year({d})::VARCHAR || 'Q' || quarter({d})::VARCHAR"
_RATIO = lambda a, b, n=6: f"round(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), {n})"
_NUM = lambda a: f"round(({a})::DOUBLE, 2)"
_AB = f"shoot_date BETWEEN DATE '{ASKED.start}' AND DATE '{ASKED.end}' AND service IN {ASKED.services}"
_AL = f"order_date BETWEEN DATE '{ASKED.start}' AND DATE '{ASKED.end}'"
_WD = lambda d: f"{d} BETWEEN DATE '{WEB.start}' AND DATE '{WEB.end}'"
_CQ = f""", s AS (SELECT channel, {_Q('session_date')} AS quarter, count(*) AS sessions, count(*) FILTER (converted) AS conversions, sum(revenue) AS revenue FROM session WHERE NOT is_bot GROUP BY ALL),
a AS (SELECT channel, {_Q('spend_date')} AS quarter, sum(spend) AS spend, sum(clicks) AS clicks FROM spend GROUP BY ALL), cq AS (SELECT * FROM s FULL JOIN a USING (channel, quarter))"""
_CQW = _CQ.replace("WHERE NOT is_bot", f"WHERE NOT is_bot AND {_WD('session_date')} AND channel IN {WEB.channels}").replace("FROM spend GROUP", f"FROM spend WHERE {_WD('spend_date')} AND channel IN {WEB.channels} GROUP")
_FO = """, f AS (SELECT DISTINCT ON (client_id) client_id, shoot_date AS first_day, lead_source AS channel FROM live ORDER BY client_id, shoot_date, booking_id),
fo AS (SELECT f.*, EXISTS (SELECT 1 FROM live l WHERE l.client_id = f.client_id AND l.shoot_date > first_day AND l.shoot_date <= first_day + 90) AS repeated FROM f)"""
_WU = """, d AS (SELECT DISTINCT crew_id, role, date_trunc('week', work_date)::DATE AS week FROM crew_day), sp AS (SELECT crew_id, role, min(week) AS a, max(week) AS b FROM d GROUP BY ALL),
wu AS (SELECT w.week, sp.role, count(*) AS active, count(d.crew_id) AS working FROM (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM d) w JOIN sp ON w.week BETWEEN sp.a AND sp.b LEFT JOIN d ON d.week = w.week AND d.crew_id = sp.crew_id GROUP BY ALL)"""
_MF = """, b AS (SELECT date_trunc('month', shoot_date)::DATE AS month, sum(net) AS x FROM live GROUP BY 1), m AS (SELECT date_trunc('month', order_date)::DATE AS month, sum(gross - discount) AS x, sum(cogs + refunded) AS c FROM line WHERE is_revenue GROUP BY 1),
l AS (SELECT date_trunc('month', work_date)::DATE AS month, sum(labour_cost) AS c FROM crew_day GROUP BY 1), z AS (SELECT month FROM b UNION SELECT month FROM m UNION SELECT month FROM l),
mf AS (SELECT z.month, coalesce(b.x, 0) + coalesce(m.x, 0) AS revenue, coalesce(m.c, 0) + coalesce(l.c, 0) AS cost FROM z LEFT JOIN b USING (month) LEFT JOIN m USING (month) LEFT JOIN l USING (month))"""
ORACLES = {k: CORE_SQL + v for k, v in {
    "a01_constant_currency": f""", j AS (SELECT live.*, fx.rate, b.rate AS base_rate FROM live JOIN fx ON fx.currency = live.currency AND rate_date = shoot_date JOIN fx b ON b.currency = live.currency AND b.rate_date = DATE '{BASE_DATE}'),
q AS (SELECT {_Q('shoot_date')} AS quarter, sum(net) AS r, sum(round(CASE WHEN currency = 'NGN' THEN net::DOUBLE ELSE net::DOUBLE / rate::DOUBLE * base_rate::DOUBLE END, 2)::DECIMAL(18,2)) AS c, sum(round(net::DOUBLE / rate::DOUBLE, 2)::DECIMAL(18,2)) AS f, avg(rate::DOUBLE) AS a FROM j GROUP BY 1)
SELECT quarter, {_NUM('r')} AS revenue, {_NUM('c')} AS constant, {_NUM('f')} AS foreign_equivalent, round(a, 6) AS avg_rate, round(r::DOUBLE / (SELECT avg(r::DOUBLE) FROM q WHERE quarter LIKE '1997%') * 100, 4) AS index FROM q""",
    "a02_yearly_growth": f""", y AS (SELECT year(shoot_date)::INTEGER AS year, sum(net) AS r, sum(net) FILTER (month(shoot_date) <= 6) AS h FROM live GROUP BY 1)
SELECT year, {_NUM('r')} AS revenue, {_NUM('h')} AS h1, {_RATIO('r - lag(r) OVER w', 'lag(r) OVER w')} AS yoy, {_RATIO('h - lag(h) OVER w', 'lag(h) OVER w')} AS h1_yoy FROM y WINDOW w AS (ORDER BY year)""",
    "a03_service_mix": f", s AS (SELECT service, count(*) AS jobs, sum(net) AS r FROM live GROUP BY 1) SELECT service, jobs, {_NUM('r')} AS revenue, {_RATIO('r', 'jobs', 2)} AS mean_job, {_RATIO('r', 'sum(r) OVER ()')} AS revenue_share, {_RATIO('jobs', 'sum(jobs) OVER ()')} AS job_share FROM s",
    "a04_status_mix": f""", s AS (SELECT year(shoot_date)::INTEGER AS year, status, count(*) AS jobs, sum(net) AS r FROM booking GROUP BY ALL)
SELECT year, status, jobs, {_NUM('r')} AS revenue, {_RATIO('jobs', 'sum(jobs) OVER w')} AS share, round((sum(CASE WHEN status <> 'Completed' THEN r ELSE 0 END) OVER w)::DOUBLE / (sum(r) OVER w)::DOUBLE, 6) AS not_completed FROM s WINDOW w AS (PARTITION BY year)""",
    "a05_job_margins": f""", lab AS (SELECT booking_id, sum(labour_cost) AS labour, bool_and(rate_is_estimated) AS est FROM crew_day GROUP BY 1), j AS (SELECT live.*, labour, est, net - coalesce(labour, 0) AS m FROM live LEFT JOIN lab USING (booking_id))
SELECT service, count(*) AS jobs, count(*) FILTER (m < 0) AS losses, count(*) FILTER (m < 0 AND est) AS artefacts, count(*) FILTER (labour IS NULL) AS without_labour, {_NUM('sum(m)')} AS margin FROM j GROUP BY 1""",
    "a06_seasonality": ", m AS (SELECT month(shoot_date)::INTEGER AS month, count(*) AS jobs FROM live WHERE year(shoot_date) IN (SELECT year(shoot_date) FROM live GROUP BY 1 HAVING count(DISTINCT month(shoot_date)) = 12) GROUP BY 1), n AS (SELECT count(*) AS n FROM (SELECT year(shoot_date) FROM live GROUP BY 1 HAVING count(DISTINCT month(shoot_date)) = 12)) SELECT month, jobs, round(jobs / n.n, 6) AS per_year, (row_number() OVER (ORDER BY jobs DESC, month))::INTEGER AS rank FROM m, n",
    "a07_double_bookings": ", d AS (SELECT crew_id, work_date, count(DISTINCT booking_id) AS jobs FROM crew_day GROUP BY ALL HAVING count(DISTINCT booking_id) > 1) SELECT strftime(work_date, '%Y-%m') AS month, count(*) AS double_bookings, max(jobs) AS most_jobs FROM d GROUP BY 1",
    "a07_double_booking_summary": """, d AS (SELECT crew_id, work_date FROM crew_day GROUP BY ALL HAVING count(DISTINCT booking_id) > 1), w AS (SELECT date_trunc('week', work_date)::DATE AS week, count(*) AS n, count(*) FILTER (month(work_date) IN (11, 12)) AS p FROM d GROUP BY 1)
SELECT sum(n)::BIGINT AS double_bookings, round(sum(p)::DOUBLE / nullif(sum(n), 0), 6) AS peak_share, first(week ORDER BY n DESC, week) AS worst_week, max(n) AS in_worst_week FROM w""",
    "a08_long_days": "SELECT strftime(work_date, '%Y-%m') AS month, round(count(*) FILTER (hours > 12) / count(hours), 6) AS long_share FROM crew_day GROUP BY 1",
    "a09_utilisation_summary": _WU + """, k AS (SELECT week, sum(active) AS active, sum(working)::DOUBLE / sum(active) AS use FROM wu GROUP BY 1), g AS (SELECT * FROM k WHERE active >= 0.9 * (SELECT max(active) FROM k)),
bn AS (SELECT week, first(role ORDER BY working / active DESC, role) AS role FROM wu WHERE week IN (SELECT week FROM g) GROUP BY 1), bb AS (SELECT role, count(*) AS n FROM bn GROUP BY 1)
SELECT count(*) AS weeks, round(median(use), 6) AS median, round(max(use), 6) AS peak, (SELECT first(role ORDER BY n DESC, role) FROM bb) AS binding_role FROM g""",
    "a10_devaluation": f""", j AS (SELECT year(shoot_date)::INTEGER AS year, shoot_date AS day, fx.rate::DOUBLE AS rate, net::DOUBLE / fx.rate::DOUBLE AS a, net::DOUBLE / b.rate::DOUBLE AS b FROM live JOIN fx ON fx.currency = 'USD' AND rate_date = shoot_date JOIN fx b ON b.currency = 'USD' AND b.rate_date = DATE '{BASE_DATE}' WHERE live.currency = 'NGN')
SELECT year, round(sum(a), 1) AS usd, round(sum(b), 1) AS usd_at_base, round(sum(a) - sum(b), 1) AS gain, round(arg_min(rate, day), 6) AS first_rate, round(arg_max(rate, day), 6) AS last_rate FROM j GROUP BY 1""",
    "a11_contribution": f", g AS (SELECT collection, {_Q('order_date')} AS quarter, sum({_CON}) AS c FROM line WHERE is_revenue GROUP BY ALL) SELECT collection, quarter, {_NUM('c')} AS contribution, count(*) FILTER (c < 0) OVER () AS losing_groups FROM g",
    "a11_sku_contribution": f"SELECT sku, {_NUM(f'sum({_CON})')} AS contribution, sum(quantity)::BIGINT AS units, sum({_CON}) < 0 AS is_loss FROM line WHERE is_revenue GROUP BY 1",
    "a12_below_cost": f"SELECT count(*) AS n, {_NUM('coalesce(sum(cogs - gross), 0)')} AS shortfall FROM line WHERE gross < cogs AND quantity > 0",
    "a13_sensitivity": f"SELECT {_NUM('sum(gross)')} AS everything, {_NUM('sum(gross) FILTER (is_revenue)')} AS recognised, round((sum(gross) FILTER (order_status <> 'pending'))::DOUBLE, 2) AS without_pending, round((sum(gross) FILTER (order_status <> 'cancelled'))::DOUBLE, 2) AS without_cancelled, round((sum(gross) FILTER (quantity > 0))::DOUBLE, 2) AS positive FROM line",
    "a14_refunded_orders": "SELECT round(count(DISTINCT order_id) FILTER (has_refund)::DOUBLE / count(DISTINCT order_id), 6) AS share FROM line",
    "a15_channel_totals": _CQ + f", c AS (SELECT channel, sum(sessions) AS sessions, sum(conversions) AS conversions, sum(revenue) AS revenue, sum(spend) AS spend, sum(clicks) AS clicks FROM cq GROUP BY 1) SELECT channel, {_RATIO('conversions', 'sessions')} AS conversion, {_RATIO('spend', 'conversions')} AS cac, {_RATIO('revenue', 'spend')} AS roas, {_RATIO('spend', 'clicks')} AS cpc FROM c",
    "a16_attributed_revenue": f", p AS (SELECT order_id, sum(gross) AS g FROM line GROUP BY 1) SELECT channel, count(*) AS sessions, {_NUM('sum(g)')} AS attributed, round(sum(g)::DOUBLE / nullif((SELECT sum(spend) FROM spend s WHERE s.channel = x.channel)::DOUBLE, 0), 6) AS attributed_roas FROM session x JOIN p USING (order_id) WHERE converted GROUP BY 1",
    "a17_traffic": "SELECT count(*) AS all_sessions, count(*) FILTER (is_bot) AS bots, count(*) FILTER (is_spam) AS spam, count(*) FILTER (NOT is_bot) AS human, round(count(*) FILTER (converted) / count(*), 6) AS naive, round(count(*) FILTER (converted AND NOT is_bot) / count(*) FILTER (NOT is_bot), 6) AS human_rate FROM session",
    "a18_lead_sources": f", s AS (SELECT lead_source, count(*) AS jobs, sum(net) AS r FROM live GROUP BY 1) SELECT lead_source, jobs, {_NUM('r')} AS revenue, {_RATIO('jobs', 'sum(jobs) OVER ()')} AS share, {_RATIO('(SELECT sum(spend) FROM spend)', 'r', 9)} AS break_even FROM s",
    "a19_campaigns": f"SELECT CASE WHEN campaign IN ('campaign0', 'campaign1') THEN 'brand' ELSE 'other' END AS campaign_set, campaign, {_NUM('sum(spend)')} AS spend, sum(clicks)::BIGINT AS clicks FROM spend GROUP BY ALL",
    "a19_contribution_per_spend": f", s AS (SELECT sum(spend) AS s, sum(spend) FILTER (campaign IN ('campaign0', 'campaign1')) AS b FROM spend), c AS (SELECT sum({_CON}) AS c FROM line WHERE is_revenue) SELECT {_NUM('c')} AS contribution, {_NUM('s')} AS spend, {_RATIO('c', 's')} AS per_spend, {_RATIO('b', 's')} AS brand_share FROM s, c",
    "a20_repeat_chi_square": _FO + """, c AS (SELECT channel, count(*) FILTER (NOT repeated)::DOUBLE AS n, count(*) FILTER (repeated)::DOUBLE AS y FROM fo GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(y) AS ty FROM c), e AS (SELECT n, y, (n + y) * tn / (tn + ty) AS en, (n + y) * ty / (tn + ty) AS ey FROM c, t)
SELECT round(x, 6) AS statistic, df::INTEGER AS df, round(1 - (SELECT sum(exp(-x / 2 + (df / 2 + i) * ln(x / 2) - lgamma(df / 2 + i + 1))) FROM range(600) r(i)), 6) AS p
FROM (SELECT sum(pow(n - en, 2) / nullif(en, 0)) + sum(pow(y - ey, 2) / nullif(ey, 0)) AS x, (count(*) - 1)::DOUBLE AS df FROM e)""",
    "a21_customers": _FO + """, r AS (SELECT channel, round(avg(repeated::INT), 6) AS rate FROM fo GROUP BY 1)
SELECT first(channel ORDER BY rate, channel) AS lowest, min(rate) AS lowest_rate, first(channel ORDER BY rate DESC, channel) AS highest, max(rate) AS highest_rate, (SELECT count(DISTINCT client_id) FROM live WHERE client_id IN (SELECT client_id FROM session)) AS in_both,
  (SELECT round(avg((o_custkey IS NULL OR o_custkey NOT IN (SELECT client_id FROM session WHERE client_id IS NOT NULL))::INT), 6) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) AS guest_line_share FROM r""",
    "a22_yearly_flow": _MF + f""", y AS (SELECT year(month)::INTEGER AS year, sum(revenue) AS r, sum(cost) AS c FROM mf GROUP BY 1), n AS (SELECT year(shoot_date) AS year, count(*) AS jobs FROM live GROUP BY 1)
SELECT y.year, {_NUM('r')} AS revenue, {_NUM('c')} AS known_cost, {_NUM('r - c')} AS gap, {_RATIO('c', 'r')} AS cost_share, jobs FROM y LEFT JOIN n ON n.year = y.year""".replace("sum(revenue)", "sum(round(revenue, 2))").replace("sum(cost)", "sum(round(cost, 2))"),
    "a23_quality_tile": "SELECT count(*) FILTER (sku % 37 = 0) AS rejected, round((sum(gross) FILTER (sku % 37 = 0 AND is_revenue))::DOUBLE, 2) AS at_risk, round((sum(gross) FILTER (sku % 37 = 0 AND is_revenue))::DOUBLE / (sum(gross) FILTER (is_revenue))::DOUBLE, 6) AS share FROM line",
    "m02_production": f"SELECT {_Q('shoot_date')} AS quarter, {_NUM('sum(net)')} AS revenue FROM live WHERE {_AB} GROUP BY 1",
    "m03_services": f""", lab AS (SELECT booking_id, sum(labour_cost) AS labour FROM crew_day GROUP BY 1), s AS (SELECT service, count(*) AS jobs, sum(net) AS r, sum(net - coalesce(labour, 0)) AS m, count(*) FILTER (net < coalesce(labour, 0)) AS losses FROM live LEFT JOIN lab USING (booking_id) WHERE {_AB} GROUP BY 1)
SELECT service, jobs, {_NUM('r')} AS revenue, losses, {_RATIO('m', 'r')} AS margin, {_RATIO('r', 'sum(r) OVER ()')} AS share FROM s""",
    "m04_jobs_per_month": f"SELECT date_trunc('month', shoot_date)::DATE AS month, count(*) AS jobs FROM live WHERE {_AB} GROUP BY 1",
    "m05_status_mix": f"SELECT status, {_NUM('sum(net)')} AS value FROM booking WHERE {_AB} GROUP BY 1",
    "m06_merch_quarters": f"SELECT {_Q('order_date')} AS quarter, {_NUM('sum(gross)')} AS gross, {_NUM('sum(refunded)')} AS refunded FROM line WHERE is_revenue AND {_AL} GROUP BY 1",
    "m07_collections": f"SELECT collection, {_NUM('sum(gross)')} AS gross, {_RATIO(f'sum({_CON})', 'sum(gross)')} AS margin, {_RATIO('sum(refunded)', 'sum(gross)')} AS refund_rate FROM line WHERE is_revenue AND {_AL} GROUP BY 1",
    "m08_refund_reasons": f""", o AS (SELECT order_id, min(order_date) AS first_day FROM line GROUP BY 1), r AS (SELECT reason, sum(refunded) AS a FROM line JOIN o USING (order_id) WHERE has_refund AND {_AL.replace('order_date', 'first_day')} GROUP BY 1)
SELECT reason, {_NUM('a')} AS amount, {_RATIO('a', 'sum(a) OVER ()')} AS share FROM r""",
    "m09_channels": f""", s AS (SELECT channel, count(*) AS sessions, count(*) FILTER (converted) AS conversions FROM session WHERE NOT is_bot AND {_WD('session_date')} AND channel IN {WEB.channels} GROUP BY 1), a AS (SELECT channel, {_NUM('sum(spend)')} AS spend FROM spend WHERE {_WD('spend_date')} AND channel IN {WEB.channels} GROUP BY 1)
SELECT channel, coalesce(sessions, 0) AS sessions, coalesce(conversions, 0) AS conversions, coalesce(spend, 0) AS spend, coalesce(list_position({list(CHANNELS)}, channel), 0)::BIGINT AS place FROM s FULL JOIN a USING (channel)""",
    "m10_channel_quarters": _CQW + f" SELECT channel, quarter, {_NUM('coalesce(spend, 0)')} AS spend, {_NUM('coalesce(revenue, 0)')} AS revenue, {_RATIO('revenue', 'spend')} AS roas FROM cq",
    "m11_attribution": f", c AS (SELECT s.revenue, b.booking_id IS NOT NULL AS known FROM session s LEFT JOIN booking b ON s.order_id = b.booking_id WHERE converted AND {_WD('session_date')}) SELECT count(*) AS converted, count(*) FILTER (known) AS joined, round(coalesce(sum(revenue) FILTER (NOT known), 0)::DOUBLE, 2) AS unattributed FROM c",
    "m12_traffic": f"SELECT count(*) AS sessions, count(*) FILTER (is_bot) AS bots, count(*) FILTER (is_spam) AS spam FROM session WHERE {_WD('session_date')}",
    "m14_headlines": _CQW + f" SELECT {_RATIO(f'sum({_CON})', 'sum(gross)')} AS margin, {_RATIO('sum(refunded)', 'sum(gross)')} AS refund_rate, (SELECT {_RATIO('sum(revenue)', 'sum(spend)')} FROM cq WHERE sessions > 0 AND spend > 0) AS paid_roas FROM line WHERE is_revenue AND {_AL}",
}.items()}
