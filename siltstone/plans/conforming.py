"""Queries of the conformance operators: a clean column is misspelt by a rule on its key, conformed, and is itself again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import conform as C
from siltstone.operators.money import conform_money, money_problems
from siltstone.operators.split import flag, flag_counts
from siltstone.plans.core import MONEY, fx_daily, num
from siltstone.sources.tables import table


def by_key(key: str, *spellings):
    """The spelling whose number is the key's remainder."""
    out = F.when(F.col(key) % len(spellings) == 0, spellings[0])
    for i, s in enumerate(spellings[1:], 1):
        out = out.when(F.col(key) % len(spellings) == i, s)
    return out


def _nulled(spark, sf_dir):
    spelt = F.when(F.col("c_custkey") % 10 == 3, F.lit(" N/A ")).when(F.col("c_custkey") % 10 == 7, F.lit("unknown")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", spelt.alias("segment"))


def c1_nulls(spark, sf_dir):
    """Segments with two spellings of nothing."""
    return C.conform_nulls(_nulled(spark, sf_dir), ["segment", "c_name"])[0]


def c1_null_census(spark, sf_dir):
    """How often each spelling occurs."""
    return C.conform_nulls(_nulled(spark, sf_dir), ["segment", "c_name"])[1]


MAPPING = [("f", "Completed"), ("o", "Confirmed"), ("p", "Cancelled")]


def spelt_statuses(spark: SparkSession, sf_dir: str, planted: bool = True) -> DataFrame:
    """Order states in several spellings. planted: every hundredth key or so has one that no mapping explains."""
    odd = F.when(F.lit(planted) & (F.col("o_orderkey") % 100 == 3), F.lit("??x")).otherwise(F.col("o_orderstatus"))
    spelt = by_key("o_orderkey", F.col("o_orderstatus"), F.lower("o_orderstatus"), F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(". ")), odd)
    return table(spark, sf_dir, "orders").select("o_orderkey", spelt.alias("status"))


def _statuses(spark, sf_dir):
    return C.conform_category(spelt_statuses(spark, sf_dir), "status", spark.createDataFrame(MAPPING, "key string, value string"))


def c2_categories(spark, sf_dir):
    """Order states in several spellings."""
    return _statuses(spark, sf_dir)[0]


def c2_unmapped(spark, sf_dir):
    """The spellings that no mapping explains."""
    return _statuses(spark, sf_dir)[1]


def c21_source_groups(spark, sf_dir):
    """Event types as traffic sources in groups, blank as Direct."""
    mapping = spark.createDataFrame([("click", "Paid"), ("view", "Organic"), ("signup", "Referral"), ("purchase", "Email")], "key string, value string")
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.upper("event_type")).alias("source"))
    return C.conform_category(raw, "source", mapping, default="Direct")[0].groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def c3_booleans(spark, sf_dir):
    """The toxic label in fourteen spellings."""
    t, f = [F.lit(x) for x in ("yes", "TRUE", " Y", "1", "t", "Active", "on")], [F.lit(x) for x in ("no", "False", "N ", "0", "f", "inactive", "OFF")]
    raw = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, by_key("doc_id", *t)).otherwise(by_key("doc_id", *f)).alias("v"))
    return raw.select("doc_id", C.conform_boolean(F.col("v")).alias("toxic"))


def c4_ids(spark, sf_dir):
    """C4: customer ids in four spellings."""
    k = F.col("c_custkey").cast("string")
    raw = table(spark, sf_dir, "customer").select("c_custkey", by_key("c_custkey", F.concat(F.lit("CU-"), F.lpad(k, 7, "0")), F.concat(F.lit("cu"), k), k, F.concat(F.lit(" CU-"), k, F.lit(" "))).alias("raw"))
    return raw.select("c_custkey", C.conform_id(F.col("raw"), "CU", 7).alias("client_id"))


def c4_id_report(spark, sf_dir):
    """C4: spellings per id over a table in which most ids occur twice."""
    k = F.col("o_custkey").cast("string")
    raw = table(spark, sf_dir, "orders").select(by_key("o_orderkey", k, F.concat(F.lit("cu"), k)).alias("raw")).withColumn("id", C.conform_id(F.col("raw"), "CU", 7))
    return C.id_report(raw, "raw", "id")


def _dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    f = lambda fmt: F.date_format(d, fmt)
    spelt = by_key("o_orderkey", f("d/M/yyyy"), f("yyyy-MM-dd"), f("dd.MM.yyyy"), f("dd-MMM-yyyy"), f("MMMM d, yyyy"), F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"), F.concat(f("dd/MM/yyyy"), F.lit(" ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", spelt.alias("raw"))


def c5_date_order(spark, sf_dir):
    """How many of the slashed dates prove the order."""
    return C.date_order_evidence(_dates(spark, sf_dir).withColumn("raw", F.trim("raw")), "raw")


def c6_dates(spark, sf_dir):
    """Order dates in seven spellings."""
    return _dates(spark, sf_dir).select("o_orderkey", C.conform_date(F.col("raw"), day_first=True).alias("day"))


def _instants(spark, sf_dir, turn=0, late=None):
    """Event times in one of four formats, the next one for each turn; `late` events are an hour later."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    ts = ts if late is None else F.when(late, ts + F.expr("INTERVAL 1 HOUR")).otherwise(ts)
    f = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    formats = [F.concat(f(ts), F.lit("Z")), F.concat(f(ts + F.expr("INTERVAL 1 HOUR")), F.lit("+01:00")), f(ts), (F.unix_timestamp(ts) * 1000 + 3_600_000).cast("string")]
    spelt = by_key("event_id", *formats[turn:], *formats[:turn])
    value, tag = C.conform_instant(F.col("raw"), epoch_shift_hours=1)
    return table(spark, sf_dir, "events").select("event_id", "user_id", spelt.alias("raw")).select("event_id", "user_id", value.alias("at"), tag.alias("tag"))


def c7_instants(spark, sf_dir):
    """Event times in four formats."""
    return _instants(spark, sf_dir).select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "tag")


def c8_instant_agreement(spark, sf_dir):
    """Every event written in two formats, the second of some an hour late: the gaps by the two formats."""
    late = F.col("event_id") % 41 == 1
    return C.instant_agreement(_instants(spark, sf_dir).unionByName(_instants(spark, sf_dir, 1, late)), "event_id", "at", "tag")


def c9_clock_offset(spark, sf_dir):
    """The activity histogram of a copy that runs two hours ahead, under shifts of -3 to 3 hours."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return C.fit_clock_offset(e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS")), e, "ts")


def _amounts(spark, sf_dir):
    """Order values in spellings that are read, that are not, and that name two currencies."""
    price = F.col("o_totalprice").cast(MONEY)
    plain, grouped = price.cast("string"), F.format_number(price, 2)
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    spelt = by_key(
        "o_orderkey", plain, grouped, joined("NGN ", grouped), joined("$", plain), joined("(", grouped, ")"), joined("-", plain), joined(grouped, "/-"), joined((price / 1000).cast("decimal(18,5)").cast("string"), "k"),
        F.translate(grouped, ",", "\u00a0"), joined("\u20a6-", grouped), joined("NGN ", plain, " USD"), F.translate(plain, ".", ","), joined(F.translate(plain, ".", ","), ",1"), joined(" ", plain, " EUR "), F.lit(" n/a "), joined("(-", plain, ")"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", spelt.alias("raw"))


def c10_money(spark, sf_dir):
    """Order values in sixteen spellings, the currency that they name, and what cannot be read."""
    return conform_money(_amounts(spark, sf_dir), "raw").select("o_orderkey", num(F.col("money.amount")).alias("amount"), "money.currency", "money.problem")


def c10_problems(spark, sf_dir):
    """How often each problem occurs."""
    return money_problems(conform_money(_amounts(spark, sf_dir), "raw"))


def c10_decimal_comma(spark, sf_dir):
    """Values of a file with decimal commas, beside grouped and plain ones that keep their meaning."""
    price = F.col("o_totalprice").cast(MONEY)
    spelt = by_key("o_orderkey", F.translate(price.cast("string"), ".", ","), F.format_number(price, 2), price.cast("string"), F.concat(F.lit("€"), F.format_number(price.cast("long"), 0)), F.translate(F.format_number(price, 2), ",.", ".,"))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", spelt.alias("raw"))
    return conform_money(raw, "raw", decimal_comma=True).select("o_orderkey", num(F.col("money.amount")).alias("amount"), "money.problem")


def c11_currencies(spark, sf_dir):
    """C11: currency of an order from its amount, a column, its client's other orders, or the floor; by rule."""
    named = F.col("money.currency")
    o = conform_money(_amounts(spark, sf_dir), "raw").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 3 == 1, F.when(named.isNotNull(), "USD")).alias("amount_currency"), F.when(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_custkey") % 3 == 2, "GBP")).alias("column_currency"))
    found = C.resolve_currency(o, ["amount_currency", "column_currency"], "o_custkey", (F.col("o_custkey") % 3 == 0, "NGN"))
    return found.groupBy("rule", "currency").agg(F.count(F.lit(1)).alias("n"))


def c12_fx(spark, sf_dir):
    """Orders in a foreign currency at the rate of their day; what has no rate is marked."""
    currency = by_key("o_custkey", F.lit("NGN"), F.lit("USD"), F.lit("XXX"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", currency.alias("currency"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast(MONEY).alias("amount"))
    return C.convert_fx(o, fx_daily(spark, sf_dir), "amount", "currency", "day", "NGN").select("o_orderkey", "currency", num(F.col("local")).alias("local"), "fx_missing")


def c13_discounts(spark, sf_dir):
    """Discounts as 5%, 5, 0.05 or blank."""
    d = F.col("l_discount").cast("decimal(4,2)")
    whole = (d * 100).cast("int").cast("string")
    spelt = F.when(d == 0, F.lit(" ")).otherwise(by_key("l_orderkey", F.concat(whole, F.lit("%")), whole, d.cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", num(C.conform_discount(spelt), 4).alias("discount")).groupBy("discount").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


def c14_hours(spark, sf_dir):
    """Hours as 8h, 8 hrs or 8; over 24 blank, over 12 flagged; flags counted."""
    q = F.col("l_quantity").cast("int").cast("string")
    hours, told = C.conform_hours(by_key("l_orderkey", q, F.concat(q, F.lit("h")), F.concat(q, F.lit(" hrs"))))
    rows = table(spark, sf_dir, "lineitem").select(hours.alias("hours"), told.alias("told"))
    flagged = flag(rows, [(F.col("told").isNotNull(), "hours"), (F.col("told") == "long day", "long")])
    return flag_counts(flagged).unionByName(rows.agg(F.lit("sum").alias("flag"), F.sum("hours").cast("long").alias("n")))


def c14_counts(spark, sf_dir):
    """C14: counts with blanks between thousands."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.translate(F.format_number(F.col("o_orderkey") * 1234, 0), ",", " ").alias("raw"))
    return raw.select("o_orderkey", C.conform_number(F.col("raw")).cast("long").alias("n"))


def c15_contacts(spark, sf_dir):
    """E-mail addresses and telephone numbers in several spellings."""
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    mail = by_key("c_custkey", F.concat(F.lit(" User"), k, F.lit("@Example.COM")), F.concat(F.lit("user"), k, F.lit("+promo@example.com")), F.concat(F.lit("user"), k, F.lit("@example")))
    phone = by_key("c_custkey", F.concat(F.lit("+234 803 "), k, F.lit("0")), F.concat(F.lit("0803"), k, F.lit("0")), F.concat(F.lit("00234-803-"), k, F.lit("0")), F.concat(F.lit("0803"), k))
    number, why = C.conform_phone(phone)
    return table(spark, sf_dir, "customer").select("c_custkey", C.conform_email(mail).alias("email"), number.alias("phone"), why.alias("phone_problem"))


def c16_names(spark, sf_dir):
    """Names in title case with acronyms, and folded for matching."""
    raw = by_key("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("  o'NEIL ltd")), F.concat(F.lower("c_mktsegment"), F.lit("-crÉme tv")), F.concat(F.lit("Ọlá ṢADÉ "), F.col("c_mktsegment")), F.concat(F.lit("Łukasz Straße "), F.lower("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", C.tidy_name(raw).alias("name"), C.folded(raw).alias("folded"))


def c17_urls(spark, sf_dir):
    """C17: page addresses without query, fragment and trailing slash."""
    return table(spark, sf_dir, "pages").select("page_id", C.conform_url(F.col("url")).alias("url"))


def c19_traffic(spark, sf_dir):
    """Bots and spam by user agent and source; spam outside the bots is a violation."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 17 == 0, "GoogleBot/2.1").otherwise("Mozilla").alias("agent"), F.when(F.col("event_id") % 34 == 0, "free-traffic").when(F.col("event_id") % 101 == 0, "seo-offers").alias("source"))
    return C.classify_traffic(e, "agent", "source", ("free-traffic", "seo-offers"))[1]


def c20_zero_fill(spark, sf_dir):
    """C20: revenue of sessions without a purchase becomes 0, as the rule is proven on all rows."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") == "purchase", F.col("value")).alias("revenue"))
    return C.zero_fill_if_proven(e, "revenue", F.col("event_type") == "purchase").select("event_id", "revenue", "blank_wrong", "value_wrong")


def c22_missing(spark, sf_dir):
    """Missing values per column and what they mean; every second customer has no segment to record."""
    return C.missing_report(C.conform_nulls(_nulled(spark, sf_dir), ["segment", "c_name"])[0], ["c_custkey", "c_name", "segment"], {"segment": F.col("c_custkey") % 20 < 10})


def _mangled(spark, sf_dir):
    text = F.col("text")
    once = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    twice = F.decode(F.encode(F.translate(once, C.C1, C.CP1252_HIGH), "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, twice).otherwise(once).alias("text"))


def s4_repaired_text(spark, sf_dir):
    """Documents read byte by byte, a third of them encoded twice, are themselves again."""
    return C.repair_text(_mangled(spark, sf_dir), ["text"])[0].select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (c1_nulls, c1_null_census, c2_categories, c2_unmapped, c21_source_groups, c3_booleans, c4_ids, c4_id_report, c5_date_order, c6_dates, c7_instants, c8_instant_agreement, c9_clock_offset, c10_money, c10_problems, c10_decimal_comma, c11_currencies, c12_fx, c13_discounts, c14_hours, c14_counts, c15_contacts, c16_names, c17_urls, c19_traffic, c20_zero_fill, c22_missing, s4_repaired_text)}

ORACLES = {
    "c1_nulls": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 NOT IN (3, 7) THEN c_mktsegment END AS segment FROM customer",
    "c1_null_census": """SELECT 'segment' AS "column", CASE c_custkey % 10 WHEN 3 THEN ' N/A ' ELSE 'unknown' END AS spelling, count(*) AS n FROM customer WHERE c_custkey % 10 IN (3, 7) GROUP BY ALL""",
    "c2_categories": "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 3 THEN NULL ELSE CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Confirmed' ELSE 'Cancelled' END END AS status FROM orders",
    "c2_unmapped": "SELECT '??x' AS spelling, count(*) AS n FROM orders WHERE o_orderkey % 100 = 3 HAVING count(*) > 0",
    "c21_source_groups": "SELECT CASE event_type WHEN 'click' THEN 'Paid' WHEN 'view' THEN 'Organic' WHEN 'signup' THEN 'Referral' WHEN 'purchase' THEN 'Email' ELSE 'Direct' END AS source, count(*) AS n FROM events GROUP BY 1",
    "c3_booleans": "SELECT doc_id, toxic = 1 AS toxic FROM labels",
    "c4_ids": "SELECT c_custkey, 'CU-' || lpad(c_custkey::VARCHAR, 7, '0') AS client_id FROM customer",
    "c4_id_report": "SELECT sum(s)::BIGINT AS spellings, count(*) AS ids, count(*) FILTER (s > 1) AS respelt FROM (SELECT count(DISTINCT o_orderkey % 2) AS s FROM orders GROUP BY o_custkey)",
    "c5_date_order": "SELECT count(*) FILTER (day(o_orderdate) > 12) AS day_first, 0::BIGINT AS month_first, count(*) FILTER (day(o_orderdate) <= 12) AS either FROM orders WHERE o_orderkey % 7 IN (0, 6)",
    "c6_dates": "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders",
    "c7_instants": "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at, CASE event_id % 4 WHEN 0 THEN 'z' WHEN 1 THEN 'offset' WHEN 2 THEN 'naive' ELSE 'epoch' END AS tag FROM events",
    "c8_instant_agreement": """WITH e AS (SELECT ['z', 'offset', 'naive', 'epoch'][event_id % 4 + 1] AS f, ['offset', 'naive', 'epoch', 'z'][event_id % 4 + 1] AS g, CASE WHEN event_id % 41 = 1 THEN 3600 ELSE 0 END AS s FROM events)
SELECT least(f, g) AS tag_a, greatest(f, g) AS tag_b, (CASE WHEN f < g THEN s ELSE -s END)::BIGINT AS gap_s, count(*) AS n FROM e GROUP BY ALL""",
    "c9_clock_offset": """WITH h AS (SELECT (hour(ts) * 60 + minute(ts)) // 15 AS slot, count(*)::DOUBLE / (SELECT count(*) FROM events) AS q FROM events GROUP BY 1),
m AS (SELECT ((slot + 8 - 4 * s) % 96 + 96) % 96 AS slot, s AS shift, q AS p FROM h, range(-3, 4) r(s)), w AS (SELECT slot, s AS shift, q FROM h, range(-3, 4) r(s))
SELECT shift::INTEGER AS shift, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS distance FROM m FULL JOIN w USING (slot, shift) GROUP BY shift""",
    "c10_money": """SELECT o_orderkey, CASE WHEN k NOT IN (10, 11, 12, 14) THEN round((CASE WHEN k IN (4, 5, 9) THEN -1 ELSE 1 END * o_totalprice::DECIMAL(18,2))::DOUBLE, 2) END AS amount,
  CASE WHEN k IN (2, 9) THEN 'NGN' WHEN k = 3 THEN 'USD' WHEN k = 13 THEN 'EUR' END AS currency, CASE WHEN k = 10 THEN 'conflicting currencies' WHEN k IN (11, 12) THEN 'not an amount' END AS problem
FROM (SELECT *, o_orderkey % 16 AS k FROM orders)""",
    "c10_problems": "SELECT CASE WHEN o_orderkey % 16 = 10 THEN 'conflicting currencies' WHEN o_orderkey % 16 IN (11, 12) THEN 'not an amount' WHEN o_orderkey % 16 = 14 THEN 'blank' ELSE 'read' END AS kind, count(*) AS n FROM orders GROUP BY 1",
    "c10_decimal_comma": """SELECT o_orderkey, CASE WHEN k <= 2 THEN round(p::DOUBLE, 2) WHEN k = 3 THEN floor(p)::DOUBLE WHEN p < 1000 THEN round(p::DOUBLE, 2) END AS amount, CASE WHEN k = 4 AND p >= 1000 THEN 'not an amount' END AS problem
FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_totalprice::DECIMAL(18,2) AS p FROM orders)""",
    "c11_currencies": """WITH o AS (SELECT *, CASE WHEN o_custkey % 3 = 1 AND o_orderkey % 16 IN (2, 3, 9, 13) THEN 'USD' END AS a, CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 3 = 2 THEN 'GBP' END AS c FROM orders),
s AS (SELECT *, max(coalesce(a, c)) OVER (PARTITION BY o_custkey) AS sib FROM o)
SELECT CASE WHEN a IS NOT NULL THEN 'amount_currency' WHEN c IS NOT NULL THEN 'column_currency' WHEN sib IS NOT NULL THEN 'siblings' WHEN o_custkey % 3 = 0 THEN 'floor' ELSE 'unresolved' END AS rule,
  coalesce(a, c, sib, CASE WHEN o_custkey % 3 = 0 THEN 'NGN' END) AS currency, count(*) AS n FROM s GROUP BY ALL""",
    "c12_fx": """WITH o AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'NGN' WHEN 1 THEN 'USD' ELSE 'XXX' END AS currency, o_totalprice::DECIMAL(18,2) AS a, (700 + (o_orderdate::DATE - DATE '1970-01-01') % 100)::DECIMAL(14,6) AS r FROM orders)
SELECT o_orderkey, currency, CASE currency WHEN 'NGN' THEN round(a::DOUBLE, 2) WHEN 'USD' THEN round(round(a * r, 2)::DOUBLE, 2) END AS local, currency = 'XXX' AS fx_missing FROM o""",
    "c13_discounts": "SELECT round(l_discount::DECIMAL(4,2)::DOUBLE, 4) AS discount, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1",
    "c14_hours": """SELECT 'hours' AS flag, count(*) AS n FROM lineitem WHERE l_quantity > 12 UNION ALL SELECT 'long', count(*) FROM lineitem WHERE l_quantity > 12 AND l_quantity <= 24
UNION ALL SELECT 'sum', (sum(l_quantity) FILTER (l_quantity <= 24))::BIGINT FROM lineitem""",
    "c14_counts": "SELECT o_orderkey, o_orderkey * 1234 AS n FROM orders",
    "c15_contacts": """SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'user' || lpad(c_custkey::VARCHAR, 6, '0') || '@example.com' END AS email,
  CASE WHEN c_custkey % 4 < 3 THEN '+234803' || lpad(c_custkey::VARCHAR, 6, '0') || '0' END AS phone, CASE WHEN c_custkey % 4 = 3 THEN 'too short' END AS phone_problem FROM customer""",
    "c16_names": """WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, lower(c_mktsegment) AS l, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS t FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN t || ' O''Neil LTD' WHEN 1 THEN t || '-Créme TV' WHEN 2 THEN 'Ọlá Ṣadé ' || t ELSE 'Łukasz Straße ' || t END AS name,
  CASE k WHEN 0 THEN l || 'oneilltd' WHEN 1 THEN l || 'cremetv' WHEN 2 THEN 'olasade' || l ELSE 'lukaszstrasse' || l END AS folded FROM c""",
    "c17_urls": r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', '', 's'), '/index\.(html?|php)$', '/') AS u FROM pages)
SELECT page_id, CASE WHEN regexp_replace(u, '/+$', '') = '' THEN '/' ELSE regexp_replace(u, '/+$', '') END AS url FROM t""",
    "c19_traffic": "SELECT count(*) FILTER (event_id % 17 = 0) AS bots, count(*) FILTER (event_id % 34 = 0 OR event_id % 101 = 0) AS spam, count(*) FILTER (event_id % 101 = 0 AND event_id % 17 <> 0) AS violations FROM events",
    "c20_zero_fill": "SELECT event_id, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS revenue, 0::BIGINT AS blank_wrong, 0::BIGINT AS value_wrong FROM events",
    "c22_missing": """WITH m AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 IN (3, 7)) AS s, count(*) FILTER (c_custkey % 20 IN (3, 7)) AS e FROM customer)
SELECT CASE WHEN v.c = 'segment' THEN e ELSE 0 END AS expected, CASE WHEN v.c = 'segment' THEN s - e ELSE 0 END AS unrecorded, v.c AS "column", n AS n_rows, CASE WHEN v.c = 'segment' THEN s ELSE 0 END AS missing, round(CASE WHEN v.c = 'segment' THEN s ELSE 0 END / n, 6) AS share FROM m, (VALUES ('c_custkey'), ('c_name'), ('segment')) v(c)""",
    "s4_repaired_text": "SELECT doc_id, md5(text) AS digest FROM documents",
}
