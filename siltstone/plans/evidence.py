"""Queries of fill chains, learned day bases, bursts of traffic and manifests of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import conform as C
from siltstone.operators import temporal as T
from siltstone.operators.fills import FillRule, fill_chain, fill_report, rule_agreement
from siltstone.sources.tables import table


def _blank_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Clients, bookings, crew lines and rosters with blanks that others determine. Of some clients the bookings name two
    cities; a crew member's lines agree on the rate unless its number is divisible by 13."""
    city = lambda k: F.concat(F.lit("city"), k.cast("string"))
    k, n, o = F.col("c_custkey"), F.col("c_nationkey"), F.col("o_orderkey")
    clients = table(spark, sf_dir, "customer").select(k.alias("client"), F.when(k % 4 != 0, city(n)).alias("city"), F.when(k % 3 != 0, F.concat(F.lit("region"), (n % 5).cast("string"))).alias("country"))
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == k)
    said = F.when(o % 5 < 2, None).when((o % 10 == 7) & (k % 8 == 0), F.lit("elsewhere")).otherwise(city(n))
    bookings = own.select(o.alias("booking"), k.alias("client"), said.alias("city"), F.when(o % 7 != 0, F.lit(2).cast("long")).alias("days"))
    line = table(spark, sf_dir, "lineitem")
    s = F.col("l_suppkey")
    rate = (100 + s % 9 + F.when((s % 13 == 0) & (F.col("l_linenumber") == 1), 1).otherwise(0)).cast("long")
    crew_lines = line.select(F.col("l_orderkey").alias("booking"), s.alias("crew"), F.col("l_shipdate").cast("date").alias("day"), rate.alias("rate"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("role"), (s % 5).cast("string"))).alias("role"))
    roster = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("crew"), F.when(F.col("s_suppkey") % 3 != 1, (100 + F.col("s_suppkey") % 9).cast("long")).alias("rate"), F.when(F.col("s_suppkey") % 10 != 3, F.concat(F.lit("role"), (F.col("s_suppkey") % 5).cast("string"))).alias("role"))
    cities = table(spark, sf_dir, "nation").select(city(F.col("n_nationkey")).alias("city"), F.concat(F.lit("region"), (F.col("n_nationkey") % 5).cast("string")).alias("country"))
    return {"clients": clients, "bookings": bookings, "crew_lines": crew_lines, "roster": roster, "cities": cities}


FILLS = [
    FillRule("country from city", "clients", "country", "city", lambda t: t["cities"]),
    FillRule("city from bookings", "clients", "city", "client", lambda t: t["bookings"]),
    FillRule("city from client", "bookings", "city", "client", lambda t: t["clients"]),
    FillRule("days from work dates", "bookings", "days", "booking", lambda t: t["crew_lines"].groupBy("booking").agg(F.countDistinct("day").alias("days")), reads=("booking", "day")),
    FillRule("rate from lines", "roster", "rate", "crew", lambda t: t["crew_lines"]),
    FillRule("role from lines", "roster", "role", "crew", lambda t: t["crew_lines"]),
    FillRule("role from roster", "crew_lines", "role", "crew", lambda t: t["roster"]),
]


def r8_fill_chain(spark, sf_dir):
    """Blanks of four tables filled by seven rules until nothing changes; cells by rule, and blanks that are left."""
    return fill_report(fill_chain(_blank_tables(spark, sf_dir), FILLS), FILLS)


def r11_rule_agreement(spark, sf_dir):
    """How often each rule of the chain gives what is known."""
    return rule_agreement(_blank_tables(spark, sf_dir), FILLS)


def _refunds(spark, sf_dir):
    """Refund dates of events in two orders, 0 to 45 days after the local day of the event, which is an hour ahead."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select("event_id", ts.cast("date").alias("utc"), (ts + F.expr("INTERVAL 1 HOUR")).cast("date").alias("local"), F.date_add((ts + F.expr("INTERVAL 1 HOUR")).cast("date"), (F.col("event_id") % 46).cast("int")).alias("true_day"))
    return e.withColumn("raw", F.when(F.col("event_id") % 3 == 0, F.date_format("true_day", "d/M/yyyy")).otherwise(F.date_format("true_day", "M/d/yyyy")))


def t10_two_bases(spark, sf_dir):
    """The window under each day basis, and which one is tighter."""
    return T.resolve_ambiguous_dates(_refunds(spark, sf_dir), "raw", ["utc", "local"])[1]


def t10_resolved_by_basis(spark, sf_dir):
    """Dates resolved by the tighter basis: how many of them are ambiguous, resolved and right."""
    out = T.resolve_ambiguous_dates(_refunds(spark, sf_dir), "raw", ["utc", "local"])[0]
    d, m = T.two_readings(F.col("raw"))
    return out.select((d.isNotNull() & m.isNotNull() & (d != m)).alias("ambiguous"), F.col("resolved").isNotNull().alias("is_resolved"), (F.col("resolved") == F.col("true_day")).alias("is_right")).groupBy("ambiguous", "is_resolved", "is_right").agg(F.count(F.lit(1)).alias("n"))


def c19_bursts(spark, sf_dir):
    """Bursts of sessions without duration or with heavy page counts, by source and day. Every fifth day some sessions
    are moved into a few minutes of the night."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    day = F.to_date("ts")
    moved = (F.dayofmonth(day) % 5 == 0) & (k % 3 == 0)
    at = F.when(moved, day.cast("timestamp") + F.make_interval(hours=F.lit(3), secs=(k % 300).cast("decimal(8,0)"))).otherwise(F.date_trunc("second", F.col("ts").cast("timestamp")))
    s = e.select(F.col("event_type").alias("source"), at.alias("at"), F.when(moved | (k % 11 == 0), 0).otherwise(30).alias("duration"), F.when(moved & (k % 2 == 0), 40).otherwise(k % 7).alias("pages"))
    found = C.traffic_bursts(s, "source", "at", "duration", "pages", gap_seconds=120, least=5)
    return found.select("source", "day", F.date_format("started", "HH:mm:ss").alias("started"), F.date_format("ended", "HH:mm:ss").alias("ended"), "sessions", F.round("zero_share", 6).alias("zero_share"), "heavy")


QUERIES = {f.__name__: f for f in (r8_fill_chain, r11_rule_agreement, t10_two_bases, t10_resolved_by_basis, c19_bursts)}

_FILLS = """WITH client AS (SELECT c_custkey AS k, c_nationkey AS n, 'city' || c_nationkey AS city, 'region' || (c_nationkey % 5) AS country FROM customer),
booking AS (SELECT o_orderkey AS b, k, CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 10 = 7 AND k % 8 = 0 THEN 'elsewhere' ELSE city END AS city, o_orderkey % 7 = 0 AS no_days FROM orders JOIN client ON o_custkey = k),
said AS (SELECT k, CASE WHEN count(DISTINCT city) = 1 THEN min(city) END AS city FROM booking GROUP BY k),
worked AS (SELECT l_orderkey AS b, count(DISTINCT l_shipdate::DATE) AS days FROM lineitem GROUP BY 1),
line AS (SELECT l_suppkey AS s, l_linenumber AS ln, 100 + l_suppkey % 9 + CASE WHEN l_suppkey % 13 = 0 AND l_linenumber = 1 THEN 1 ELSE 0 END AS rate FROM lineitem),
crew AS (SELECT s, CASE WHEN count(DISTINCT rate) = 1 THEN min(rate) END AS rate, count(*) FILTER (ln % 2 = 0) > 0 AS has_role, count(*) FILTER (ln % 2 = 1) AS blank FROM line GROUP BY s)"""
ORACLES = {
    "r8_fill_chain": _FILLS + """, c AS (SELECT client.*, said.city AS told, k % 4 = 0 AS no_city, k % 3 = 0 AS no_country, k % 4 <> 0 OR said.city IS NOT NULL AS has_city, CASE WHEN k % 4 <> 0 THEN client.city ELSE said.city END AS final FROM client LEFT JOIN said USING (k)),
g AS (SELECT s_suppkey AS s, crew.rate, coalesce(has_role, false) AS has_role, coalesce(blank, 0) AS blank, s_suppkey % 3 = 1 AS no_rate, s_suppkey % 10 = 3 AS no_role FROM supplier LEFT JOIN crew ON s = s_suppkey),
r AS (SELECT CASE WHEN final LIKE 'city%' THEN 'country from city' END AS rule, 'clients' AS "table", 'country' AS "column" FROM c WHERE no_country
  UNION ALL SELECT CASE WHEN told IS NOT NULL THEN 'city from bookings' END, 'clients', 'city' FROM c WHERE no_city
  UNION ALL SELECT CASE WHEN has_city THEN 'city from client' END, 'bookings', 'city' FROM booking b JOIN c USING (k) WHERE b.city IS NULL
  UNION ALL SELECT CASE WHEN days IS NOT NULL THEN 'days from work dates' END, 'bookings', 'days' FROM booking LEFT JOIN worked USING (b) WHERE no_days
  UNION ALL SELECT CASE WHEN rate IS NOT NULL THEN 'rate from lines' END, 'roster', 'rate' FROM g WHERE no_rate
  UNION ALL SELECT CASE WHEN has_role THEN 'role from lines' END, 'roster', 'role' FROM g WHERE no_role
  UNION ALL SELECT CASE WHEN NOT no_role OR has_role THEN 'role from roster' END, 'crew_lines', 'role' FROM g, range(blank) t(i))
SELECT rule, "table", "column", count(*) AS filled FROM r GROUP BY ALL""",
    "r11_rule_agreement": _FILLS + """ SELECT 'country from city' AS rule, count(*) FILTER (k % 3 <> 0 AND k % 4 <> 0) AS same, 0::BIGINT AS different FROM client
UNION ALL SELECT 'city from bookings', count(*) FILTER (said.city = client.city), count(*) FILTER (said.city <> client.city) FROM client JOIN said USING (k) WHERE k % 4 <> 0
UNION ALL SELECT 'city from client', count(*) FILTER (b.city = c.city), count(*) FILTER (b.city <> c.city) FROM booking b JOIN client c USING (k) WHERE k % 4 <> 0 AND b.city IS NOT NULL
UNION ALL SELECT 'days from work dates', count(*) FILTER (days = 2), count(*) FILTER (days <> 2) FROM booking JOIN worked USING (b) WHERE NOT no_days
UNION ALL SELECT 'rate from lines', count(*) FILTER (rate = 100 + s % 9), count(*) FILTER (rate <> 100 + s % 9) FROM crew WHERE s % 3 <> 1
UNION ALL SELECT 'role from lines', count(*), 0 FROM crew WHERE s % 10 <> 3 AND has_role
UNION ALL SELECT 'role from roster', count(*), 0 FROM line WHERE ln % 2 = 0 AND s % 10 <> 3""",
}
_R = """WITH e AS (SELECT event_id, ts::DATE AS utc, (ts + INTERVAL 1 HOUR)::DATE AS "local", event_id % 3 = 0 AS df FROM events), f AS (SELECT *, "local" + (event_id % 46)::INT AS t FROM e),
s AS (SELECT *, CASE WHEN day(t) <= 12 THEN make_date(year(t), day(t), month(t)) END AS o FROM f), u AS (SELECT *, o IS NULL OR o = t AS sure FROM s),
w AS (SELECT 'utc' AS basis, 0 AS i, min(t - utc) AS a, max(t - utc) AS b, count(*) AS n FROM u WHERE sure UNION ALL SELECT 'local', 1, min(t - "local"), max(t - "local"), count(*) FROM u WHERE sure),
best AS (SELECT * FROM w ORDER BY b - a, i LIMIT 1)"""
ORACLES |= {
    "t10_two_bases": _R + " SELECT w.basis, w.a::INTEGER AS lag_min, w.b::INTEGER AS lag_max, w.n AS sure, w.basis = best.basis AS is_chosen FROM w, best",
    "t10_resolved_by_basis": _R + """, y AS (SELECT u.*, a, b, CASE best.basis WHEN 'utc' THEN utc ELSE "local" END AS d FROM u, best),
z AS (SELECT NOT sure AS ambiguous, sure OR (t - d BETWEEN a AND b) <> (o - d BETWEEN a AND b) AS is_resolved, sure OR (t - d BETWEEN a AND b) AS fits FROM y)
SELECT ambiguous, is_resolved, CASE WHEN is_resolved THEN fits END AS is_right, count(*) AS n FROM z GROUP BY ALL""",
    "c19_bursts": """WITH e AS (SELECT *, ts::DATE AS d, day(ts) % 5 = 0 AND event_id % 3 = 0 AS moved FROM events),
s AS (SELECT event_type AS source, CASE WHEN moved THEN d + INTERVAL 3 HOUR + to_seconds(event_id % 300) ELSE date_trunc('second', ts) END AS moment, moved OR event_id % 11 = 0 AS zero, moved AND event_id % 2 = 0 AS heavy FROM e),
g AS (SELECT *, CASE WHEN moment - lag(moment) OVER w <= INTERVAL 120 SECOND THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY source, moment::DATE ORDER BY moment)),
r AS (SELECT *, sum(new) OVER (PARTITION BY source, moment::DATE ORDER BY moment ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT source, moment::DATE AS day, strftime(min(moment), '%H:%M:%S') AS started, strftime(max(moment), '%H:%M:%S') AS ended, count(*) AS sessions, round(avg(zero::INT), 6) AS zero_share, count(*) FILTER (heavy) AS heavy
FROM r GROUP BY source, moment::DATE, run HAVING count(*) >= 5 AND (avg(zero::INT) >= 0.9 OR count(*) FILTER (heavy) >= 0.5 * count(*))""",
}
