"""Queries of the gates: each job runs on a table as it must be and on one with planted breaks; what was counted, and whether
the job was stopped. The jobs run when the query is built, as a gate speaks once its rows are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import gates as G
from siltstone.operators import temporal as T
from siltstone.plans.conforming import MAPPING, by_key, spelt_statuses
from siltstone.plans.core import price_versions
from siltstone.plans.timevalid import FX_SQL, OFFSET, VERSIONS_SQL, clients, published_rates
from siltstone.plans.warehouse import RULES, kept_by_hand
from siltstone.sources.tables import table

SCHEMA = "variant string, evidence string, value long, stopped boolean"


def _told(spark: SparkSession, jobs: dict[str, tuple[DataFrame, G.Gate]]) -> DataFrame:
    """(variant, evidence, value, stopped) of each job."""
    rows = []
    for variant, (df, gate) in jobs.items():
        try:
            G.passed([(df, gate)])
            evidence, stopped = gate.evidence(), False
        except G.GateStopped as why:
            evidence, stopped = why.evidence, True
        rows += [(variant, name, value, stopped) for name, value in evidence.items()]
    return spark.createDataFrame(rows, SCHEMA)


def c2_gate(spark, sf_dir):
    """Order states; every 25th or so has a spelling that no mapping explains."""
    mapping = spark.createDataFrame(MAPPING, "key string, value string")
    return _told(spark, {v: G.strict_category(spelt_statuses(spark, sf_dir, planted=v == "planted"), "status", mapping) for v in ("clean", "planted")})


def c3_gate(spark, sf_dir):
    """Toxic labels; some say `maybe`."""
    spelt = F.when(F.col("toxic") == 1, by_key("doc_id", F.lit("yes"), F.lit("1.0"), F.lit(" T "))).otherwise(by_key("doc_id", F.lit("No"), F.lit("0.0"), F.lit("n/a")))
    raw = table(spark, sf_dir, "labels").select("doc_id", spelt.alias("toxic"))
    planted = raw.withColumn("toxic", F.when(F.col("doc_id") % 7 == 3, "maybe").otherwise(F.col("toxic")))
    return _told(spark, {"clean": G.strict_boolean(raw, "toxic"), "planted": G.strict_boolean(planted, "toxic")})


def c5_gate(spark, sf_dir):
    """Order dates day first; some are month first, and a file of the first twelve days proves nothing."""
    d = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "d/M/yyyy").alias("raw"), F.date_format(d, "M/d/yyyy").alias("other"), F.dayofmonth(d).alias("n"))
    planted = rows.withColumn("raw", F.when(F.col("o_orderkey") % 50 == 7, F.col("other")).otherwise(F.col("raw")))
    few = rows.filter("n <= 12")
    return _told(spark, {v: G.strict_date_order(df.select("o_orderkey", "raw"), "raw", day_first=True) for v, df in (("clean", rows), ("planted", planted), ("unproven", few))})


def c9_gate(spark, sf_dir):
    """Event times against themselves; a copy that runs two hours ahead."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    moved = e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    return _told(spark, {"clean": G.strict_clock(e, e, "ts"), "planted": G.strict_clock(moved, e, "ts")})


def c19_gate(spark, sf_dir):
    """Spam is nested in bot traffic; some spam is not."""
    agent = F.when(F.col("event_id") % 17 == 0, "GoogleBot/2.1").otherwise("Mozilla")
    e = table(spark, sf_dir, "events").select("event_id", agent.alias("agent"), F.when(F.col("event_id") % 34 == 0, "free-traffic").alias("source"))
    planted = e.withColumn("source", F.when(F.col("event_id") % 101 == 0, "seo-offers").otherwise(F.col("source")))
    return _told(spark, {v: G.strict_traffic(df, "agent", "source", ("free-traffic", "seo-offers")) for v, df in (("clean", e), ("planted", planted))})


def d4_gate(spark, sf_dir):
    """Copies at an offset key; some have another name, some an address that contradicts."""
    jobs = {v: clients(spark, sf_dir, planted=v == "planted") for v in ("clean", "planted")}
    return _told(spark, {v: G.strict_pairs(df, "c_custkey", OFFSET, "name", "email", 0.85) for v, df in jobs.items()})


def s5_gate(spark, sf_dir):
    """Hand-kept sheets; some rows are neither data nor structure."""
    sheet = kept_by_hand(spark, sf_dir)
    planted = sheet.withColumn("label", F.when((F.col("_row") % 40 == 0) & F.col("label").rlike(r"^\d+$"), F.concat(F.lit("see "), "label")).otherwise(F.col("label")))
    return _told(spark, {v: G.strict_structure(df, RULES(), F.col("label").rlike(r"^\d+$")) for v, df in (("clean", sheet), ("planted", planted))})


def t3_gate(spark, sf_dir):
    """Rates after and before slips of the decimal point are undone."""
    rates = published_rates(spark, sf_dir)
    return _told(spark, {"clean": G.strict_steps(T.correct_rate_outliers(rates).select("currency", "rate_date", "rate")), "planted": G.strict_steps(rates)})


def t7_gate(spark, sf_dir):
    """Lines with the version in force; with the raw versions some have none and some several."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("l_partkey").alias("sku"), F.col("l_shipdate").cast("date").alias("day"))
    raw = price_versions(spark, sf_dir)
    versions = {"clean": T.repair_scd2(raw, "sku"), "planted": raw.withColumn("valid_to", F.coalesce("valid_to", F.lit(T.FOREVER).cast("date")))}
    joined = {v: T.join_valid(lines, df, "sku", "day") for v, df in versions.items()}
    return _told(spark, {v: G.strict_validity(df, ["file", "row"], "version") for v, df in joined.items()})


def w2_gate(spark, sf_dir):
    """Raw channel names of sessions; a bridge that lacks one."""
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("spelling"))
    bridge = raw.select("spelling", F.lower("spelling").alias("channel")).distinct()
    return _told(spark, {v: G.strict_bridge(raw, "spelling", df, "name") for v, df in (("clean", bridge), ("planted", bridge.filter("channel <> 'error'")))})


QUERIES = {f.__name__: f for f in (c2_gate, c3_gate, c5_gate, c9_gate, c19_gate, d4_gate, s5_gate, t3_gate, t7_gate, w2_gate)}


def _rows(source: str, **counts: str) -> str:
    """SQL for the evidence of one table with one row of counts; `stopped` is one of them."""
    names = [n for n in counts if n not in ("variant", "stopped")]
    return " UNION ALL ".join(f"SELECT {counts['variant']} AS variant, '{n}' AS evidence, ({counts[n]})::BIGINT AS value, {counts['stopped']} AS stopped FROM {source}" for n in names)


_V = "(VALUES ('clean'), ('planted')) x(variant)"
_PLANTED = "variant = 'planted'"
ORACLES = {
    "c2_gate": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 100 = 3) AS odd FROM orders) " + _rows(f"c, {_V}", variant="variant", rows="n", unmapped=f"CASE WHEN {_PLANTED} THEN odd ELSE 0 END", stopped=f"{_PLANTED} AND odd > 0"),
    "c3_gate": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 7 = 3) AS odd FROM labels) " + _rows(f"c, {_V}", variant="variant", rows="n", unmapped=f"CASE WHEN {_PLANTED} THEN odd ELSE 0 END", stopped=f"{_PLANTED} AND odd > 0"),
    "c5_gate": """WITH o AS (SELECT day(o_orderdate) AS d, month(o_orderdate) AS m, o_orderkey % 50 = 7 AS odd FROM orders),
c AS (SELECT 'clean' AS variant, count(*) FILTER (d > 12) AS proof, 0 AS against, count(*) FILTER (d <= 12) AS either FROM o
  UNION ALL SELECT 'planted', count(*) FILTER (NOT odd AND d > 12), count(*) FILTER (odd AND d > 12), count(*) FILTER (d <= 12) FROM o
  UNION ALL SELECT 'unproven', 0, 0, count(*) FROM o WHERE d <= 12),
t AS (SELECT *, CASE WHEN proof = 0 THEN either ELSE 0 END AS unproven FROM c) """ + _rows("t", variant="variant", proof="proof", against="against", unproven="unproven", stopped="against > 0 OR unproven > 0"),
    "c9_gate": """WITH h AS (SELECT (hour(ts) * 60 + minute(ts)) // 15 AS slot, count(*) AS n FROM events GROUP BY 1), f AS (SELECT s.slot, coalesce(n, 0) AS n FROM range(96) s(slot) LEFT JOIN h USING (slot)),
d AS (SELECT variant, k, sum(abs(a.n - b.n)) AS d FROM (VALUES ('clean', 0), ('planted', 8)) v(variant, m), range(-3, 4) r(k), f b, f a WHERE a.slot = (b.slot + 4 * k - m + 960) % 96 GROUP BY ALL),
c AS (SELECT variant, first(k ORDER BY d, abs(k), k) AS best, (SELECT count(*) FROM events) AS n FROM d GROUP BY variant) """ + _rows("c", variant="variant", best_shift="best", own="n", ref="n", stopped="best <> 0"),
    "c19_gate": """WITH c AS (SELECT variant, count(*) FILTER (event_id % 17 = 0) AS bots, count(*) FILTER (event_id % 34 = 0 OR (variant = 'planted' AND event_id % 101 = 0)) AS spam,
  count(*) FILTER (variant = 'planted' AND event_id % 101 = 0 AND event_id % 17 <> 0) AS odd FROM events, (VALUES ('clean'), ('planted')) x(variant) GROUP BY 1) """ + _rows("c", variant="variant", bots="bots", spam="spam", spam_not_bot="odd", stopped="odd > 0"),
    "d4_gate": """WITH c AS (SELECT variant, count(*) AS pairs, count(*) FILTER (variant = 'planted' AND c_custkey % 70 = 10 AND c_custkey % 3 <> 0) AS conflicts,
  count(*) FILTER (variant = 'planted' AND (c_custkey % 60 = 0 OR (c_custkey % 70 = 10 AND c_custkey % 3 <> 0))) AS failing FROM customer, (VALUES ('clean'), ('planted')) x(variant) WHERE c_custkey % 10 = 0 GROUP BY 1) """ + _rows("c", variant="variant", pairs="pairs", failing="failing", conflicts="conflicts", stopped="failing > 0"),
    "s5_gate": """WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 40 = 0) AS odd, count(DISTINCT (year(o_orderdate), month(o_orderdate))) AS months, count(DISTINCT year(o_orderdate)) AS years FROM orders),
c AS (SELECT variant, n, 2 * months + years AS structural, CASE WHEN variant = 'planted' THEN odd ELSE 0 END AS odd FROM o, (VALUES ('clean'), ('planted')) x(variant)) """ + _rows("c", variant="variant", data="n - odd", structural="structural", unexplained="odd", stopped="odd > 0"),
    "t3_gate": FX_SQL + """, s AS (SELECT 'planted' AS variant, raw / lag(raw) OVER (PARTITION BY currency ORDER BY d) AS step FROM p UNION ALL SELECT 'clean', rate / lag(rate) OVER (PARTITION BY currency ORDER BY d) FROM fixed),
c AS (SELECT variant, count(*) FILTER (step > 1.2 OR step < 1 / 1.2) AS listed, count(*) FILTER (step > 2 OR step < 0.5) AS rejected FROM s GROUP BY 1) """ + _rows("c", variant="variant", listed="listed", rejected="rejected", stopped="rejected > 0"),
    "t7_gate": VERSIONS_SQL + f""", l AS (SELECT row_number() OVER () AS id, l_partkey AS sku, l_shipdate::DATE AS day FROM lineitem),
y AS (SELECT 'clean' AS variant, sku, valid_from AS a, valid_to AS b FROM f UNION ALL SELECT 'planted', sku, CASE WHEN inv THEN hi ELSE lo END, coalesce(CASE WHEN inv THEN lo ELSE hi END, DATE '{T.FOREVER}') FROM v),
n AS (SELECT variant, id, count(y.sku) AS n FROM l CROSS JOIN (VALUES ('clean'), ('planted')) x(variant) LEFT JOIN y USING (variant, sku) WHERE y.sku IS NULL OR day BETWEEN a AND b GROUP BY ALL),
m AS (SELECT variant, id, coalesce(n, 0) AS n FROM l CROSS JOIN (VALUES ('clean'), ('planted')) x(variant) LEFT JOIN n USING (variant, id)),
c AS (SELECT variant, sum(greatest(n, 1)) AS n, count(*) FILTER (n = 0) AS without, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS several FROM m GROUP BY 1) """ + _rows("c", variant="variant", rows="n", without="without", several="several", stopped="without > 0 OR several > 0"),
    "w2_gate": f"WITH c AS (SELECT variant, count(*) AS n, count(*) FILTER ({_PLANTED} AND event_type = 'error') AS odd FROM events, {_V} GROUP BY 1) " + _rows("c", variant="variant", rows="n", unbridged="odd", stopped="odd > 0"),
}
