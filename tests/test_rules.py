"""Hand-made rows for the branches of the rules, and results that do not depend on partitions."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from siltstone.functions.columns import chi_square_tail
from siltstone.operators import checks as K
from siltstone.operators import conform as C
from siltstone.operators import fills as L
from siltstone.operators import gates as G
from siltstone.operators import intervals as I
from siltstone.operators import profile as P
from siltstone.operators import resolve as R
from siltstone.operators import split as S
from siltstone.operators import temporal as T
from siltstone.operators.money import conform_money, money_problems
from siltstone.plans import warehouse
from siltstone.plans.revenue import q01_quarterly_revenue
from siltstone.plans.warehouse import build_booking_fact, build_dim
from siltstone.sources import manifest as M
from siltstone.sources.manifest import check_manifest, save_with_manifest
from siltstone.sources.scratch import shared_folder
from siltstone.sources.tables import save_tables
from siltstone.sources.text import check_blocks, read_text_table, split_structural_rows

day = dt.date


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def money(spark, texts, **options):
    rows = conform_money(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string"), "x", **options).orderBy("i").collect()
    return [(None if r.money.amount is None else float(r.money.amount), r.money.currency, r.money.problem) for r in rows]


NONE, BAD = (None, None, None), (None, None, "not an amount")


def test_money(spark):
    told = {
        "1,234.50": (1234.5, None, None), "(1,000)": (-1000, None, None), "₦2.5m": (2.5e6, "NGN", None), "NGN 12k": (12000, "NGN", None), "500/-": (500, None, None), "-7": (-7, None, None), "1 200": (1200, None, None),
        "NGN2,977,000.00/-": (2977000, "NGN", None), "₦-4,900.00": (-4900, "NGN", None), "-(5)": BAD, "(-5)": (5, None, None), "5 USD": (5, "USD", None), "NGN ₦5": (5, "NGN", None), "1.5 B": (1.5e9, None, None), "1\u00a0234\u00a0567.8": (1234567.8, None, None),
        "abc": BAD, "": NONE, " n/a ": NONE, "12..3": BAD, "87635,35": BAD, "1,2,3": BAD, "1 2": BAD, "1,23": BAD, "12,34,567": BAD, "ngn 5": BAD, "5-": BAD, "5kk": BAD, ".5": BAD, "--": NONE,
        "NGN 12 USD": (None, None, "conflicting currencies"), "$5 €": (None, None, "conflicting currencies"), "£x": (None, "GBP", "not an amount"), "9" * 30: (None, None, "too large"), "9" * 19 + "b": (None, None, "too large"),
    }
    assert money(spark, [*told, None]) == [*told.values(), NONE]


def test_money_with_decimal_commas(spark):
    told = {"87635.35": (87635.35, None, None), "1,000.50": (1000.5, None, None), "1,254,300": (1254300, None, None), "87635,35": (87635.35, None, None), "1,254": (1254, None, None), "7,5": (7.5, None, None), "1.254,30": BAD, "€7,50": (7.5, "EUR", None), "1,2,3": BAD}
    assert money(spark, list(told), decimal_comma=True) == list(told.values())


def test_money_of_an_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([("5", 1)], "x string, money int")
    assert [r.money.amount for r in conform_money(df, "x").collect()] == [5] and conform_money(df.limit(0), "x").count() == 0
    assert {tuple(r) for r in money_problems(conform_money(spark.createDataFrame([("5",), ("x",), (None,), ("x",)], "x string"), "x")).collect()} == {("read", 1), ("not an amount", 2), ("blank", 1)}


@pytest.mark.parametrize("text, day_first, value", [("3/4/2024", True, day(2024, 4, 3)), ("3/4/2024", False, day(2024, 3, 4)), ("31.12.2023", True, day(2023, 12, 31)), ("5-Jan-24", True, day(2024, 1, 5)), ("45000", True, day(2023, 3, 15)), ("2024-02-30", True, None), ("13/13/2024", True, None), (None, True, None)])
def test_dates(spark, text, day_first, value):
    assert one(spark, text, lambda c: C.conform_date(c, day_first)) == value


@pytest.mark.parametrize("text, value", [("5%", "0.0500"), ("5", "0.0500"), ("0.05", "0.0500"), ("", "0.0000"), (None, "0.0000"), ("x", None)])
def test_discounts(spark, text, value):
    assert one(spark, text, C.conform_discount) == (None if value is None else D(value))


@pytest.mark.parametrize("text, value", [("xt123", "XT-00123"), (" 123 ", "XT-00123"), ("XT-00123", "XT-00123"), ("none", None), ("1234567", None), (None, None)])
def test_ids(spark, text, value):
    assert one(spark, text, lambda c: C.conform_id(c, "XT", 5)) == value


def test_text_that_is_valid_stays_as_it_is(spark):
    raw = "cafÃ© \u0093q\u0094 plain"
    clean, report = C.repair_text(spark.createDataFrame([(raw,), ("ascii",), (None,)], "t string"), ["t"])
    assert [r.t for r in clean.collect()] == ["café “q” plain", "ascii", None] and report.first().repaired == 1


def test_unmapped_categories_are_reported(spark):
    df = spark.createDataFrame([("A",), ("a.",), ("b",), (None,)], "c string")
    clean, unmapped = C.conform_category(df, "c", spark.createDataFrame([("a", "X")], "key string, value string"))
    assert sorted(str(r.c) for r in clean.collect()) == ["None", "None", "X", "X"] and [tuple(r) for r in unmapped.collect()] == [("b", 1)]


def fx(spark, rates):
    return spark.createDataFrame([("USD", day(2024, 1, 1) + dt.timedelta(i), D(r)) for i, r in rates], "currency string, rate_date date, rate decimal(14,6)")


def test_rate_slips_at_edges_and_real_jumps(spark):
    got = {r.rate_date.day: (float(r.rate), r.is_corrected) for r in T.correct_rate_outliers(fx(spark, [(0, "7000"), (1, "701"), (2, "70"), (3, "702"), (4, "1500"), (5, "1510")])).collect()}
    assert got[1] == (700.0, True) and got[3] == (700.0, True) and got[5] == (1500.0, False) and got[2] == (701.0, False)


def test_calendar_fills_backwards_first(spark):
    rows = T.daily_calendar(T.correct_rate_outliers(fx(spark, [(2, "5"), (4, "6")])), "2024-01-01", "2024-01-06").orderBy("rate_date").collect()
    assert [float(r.rate) for r in rows] == [5, 5, 5, 5, 6, 6] and [r.is_filled for r in rows] == [True, True, False, True, False, True]


def test_price_windows(spark):
    rows = [("a", 1, day(2024, 1, 1), day(2024, 3, 15)), ("a", 2, day(2024, 3, 1), None), ("a", 3, day(2024, 6, 1), day(2024, 5, 1)), ("b", 1, day(2024, 1, 1), day(2024, 1, 31)), ("b", 2, day(2024, 2, 5), None)]
    df = spark.createDataFrame(rows, "k string, v int, valid_from date, valid_to date")
    out = T.repair_scd2(df, "k")
    got = {(r.k, r.v): (r.valid_from, r.valid_to, r.repair) for r in out.collect()}
    assert got["a", 1] == (day(2024, 1, 1), day(2024, 2, 29), "trimmed") and got["a", 2][2] == "closed" and got["a", 3] == (day(2024, 5, 1), day(9999, 12, 31), "swapped,reopened")
    assert got["b", 1] == (day(2024, 1, 1), day(2024, 2, 4), "bridged")
    assert tuple(T.check_scd2(out, "k").first()) == (0, 0, 0, 0)


def test_ambiguous_dates_are_resolved_only_if_one_reading_fits(spark):
    rows = [("25/3/2024", day(2024, 3, 20)), ("3/27/2024", day(2024, 3, 20)), ("2/3/2024", day(2024, 2, 25)), ("4/5/2024", day(2024, 1, 1)), ("5/6/2024", day(2024, 5, 30))]
    out, window = T.resolve_ambiguous_dates(spark.createDataFrame(rows, "raw string, base date"), "raw", ["base"])
    assert (window.first().lag_min, window.first().lag_max) == (5, 7)
    assert {r.raw: r.resolved for r in out.collect()} == {"25/3/2024": day(2024, 3, 25), "3/27/2024": day(2024, 3, 27), "2/3/2024": day(2024, 3, 2), "4/5/2024": None, "5/6/2024": day(2024, 6, 5)}


def test_refunds_are_capped_in_order_and_shared(spark):
    lines = spark.createDataFrame([(1, 1, D("60.00")), (1, 2, D("40.00")), (1, 3, D("-10.00")), (2, 1, D("-5.00"))], "o int, l int, v decimal(18,2)")
    refunds = spark.createDataFrame([(1, "b", None, D("50.00")), (1, "a", day(2024, 1, 1), D("-70.00")), (2, "c", day(2024, 1, 1), D("5.00")), (9, "d", day(2024, 1, 1), D("5.00"))], "o int, k string, d date, a decimal(18,2)")
    counted, shared = T.allocate_refunds(lines, refunds, "o", "v", "a", "d", "k")
    assert {r.k: float(r.counted) for r in counted.collect()} == {"a": 70, "b": 20, "c": 0, "d": 0}
    assert {(r.o, r.l): r.refunded for r in shared.collect()} == {(1, 1): 54.0, (1, 2): 36.0, (1, 3): 0.0, (2, 1): 0.0}


def test_rekeyed_pairs_by_similarity_and_email(spark):
    rows = [(1, "Grace Farouk", "a@x.org"), (101, "Grrace Farouk", None), (2, "Ann Lee", "b@x.org"), (102, "Ann Lee", "c@x.org"), (3, "Bo", None), (103, "Completely Other", None)]
    got = {r.high: (r.holds, round(r.similarity, 3)) for r in R.match_rekeyed(spark.createDataFrame(rows, "k long, n string, e string"), "k", 100, "n", "e", 0.85).collect()}
    assert got[101] == (True, 0.957) and got[102][0] is False and got[103][0] is False


def test_structural_rows_that_nothing_explains(spark):
    df = spark.createDataFrame([("1",), ("Total",), ("??",), (None,)], "x string")
    data, other = split_structural_rows(df, [(F.col("x") == "Total", "total")], F.col("x").rlike(r"^\d+$"))
    assert data.count() == 1 and sorted(r._reason for r in other.collect()) == ["total", "unexplained", "unexplained"]


def test_a_failed_check_stops_the_job(spark):
    bad = K.violations(spark.range(3), "no two", F.col("id") == 2)
    assert K.run_checks([bad]).first().status == "FAIL"
    with pytest.raises(Exception, match="check failed"):
        K.run_checks([bad], raise_on_failure=True).collect()


def test_duplicate_splits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, i % 7, "x" if i % 5 else None) for i in range(200)], "r int, k int, s string")
    runs = []
    for n in (1, 3, 8):
        kept, gone = S.split_exact_duplicates(df.repartition(n), ["k", "s"], "r")
        soft, dropped = S.split_content_duplicates(df.repartition(n), ["k"], "s", "r")
        runs.append([sorted(map(str, x.collect())) for x in (kept, gone, soft, dropped)])
    assert runs[0] == runs[1] == runs[2]
    assert len(runs[0][0]) + len(runs[0][1]) == 200


def test_empty_tables(spark):
    df = spark.createDataFrame([], "r int, k int, s string")
    assert all(x.count() == 0 for x in (*S.split_exact_duplicates(df, ["k"], "r"), *S.split_orphans(df, df, ["k"]), S.duplicate_keys(df, ["k"]), S.fill_from(df, df, "k", "s")))
    assert C.missing_report(df, ["k", "s"]).count() == 2


def test_percentiles_are_exact_whatever_the_ranges(spark):
    rng = random.Random(1)
    rows = [(g, v) for g in ("a", "b", None) for v in [rng.choice([1.0, 2.0, rng.uniform(0, 9), rng.gauss(0, 100)]) for _ in range(700)]] + [("one", 5.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["__by"]: (r.lo, r.mid, r.hi) for r in T.exact_percentiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}).collect()}
    assert set(got) == {"a", "b", None, "one"} and got["one"] == (5.0, 5.0, 5.0)
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g)
        for p, found in zip((0.05, 0.5, 0.95), got[g]):
            at = p * (len(v) - 1)
            assert found == pytest.approx(v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at)))


def test_blocks_across_pieces(spark):
    """The next subtotal may be pieces below; rows below the last one belong to none."""
    rows = [("s", i, 5 if i == 40 else (6 if i == 75 else None), 5 if i <= 40 else 6) for i in range(1, 90)] + [("t", 3, None, 1)]
    df = spark.createDataFrame(rows, "src string, r long, marker int, month int")
    for size in (7, 1000):
        wrong = check_blocks(df, "src", "r", "marker", "month", size)
        assert sorted((x.src, x.r) for x in wrong.collect()) == [("s", r) for r in range(76, 90)] + [("t", 3)]


def test_rows_are_numbered_over_files_and_splits(spark, tmp_path):
    for n, part in enumerate((range(0, 5), range(5, 600), range(600, 603))):
        (tmp_path / f"part-{n}.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in part))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = {r.a: r._row for r in read_text_table(spark, str(tmp_path), ["a", "b"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {str(i): i + 2 for i in range(603)}


def test_best_match_finds_typos_in_frequent_names(spark):
    names = [(i, f"common name {chr(97 + i % 26)}{chr(97 + i // 26)}zq") for i in range(60)] + [(100, "grace farouk"), (1100, "grace faruok"), (1005, "comon name fazq"), (1007, None)]
    df = spark.createDataFrame(names, "k long, n string")
    pairs = spark.createDataFrame([(1100, 100), (1005, 5), (1007, 7)], "high long, low long")
    assert {r.high: (r.is_best, r.ties) for r in R.best_match_evidence(df, pairs, "k", "n").collect()} == {1100: (True, 1), 1005: (True, 1)}


def test_best_match_of_short_names_and_of_names_of_many_keys(spark):
    assert one(spark, "abc", lambda c: R.shortened(c, 2)) == ["abc", "bc", "ac", "ab", "c", "b", "a"] and one(spark, "", lambda c: R.shortened(c, 2)) == [""] and one(spark, None, lambda c: R.shortened(c, 2)) is None
    names = [(1, "ab"), (1001, "cd"), (2, "long name"), (1002, "long name"), (3, "long name"), (4, "other words"), (1004, "order words"), (1003, "lonk nane")]
    df = spark.createDataFrame(names, "k long, n string")
    pairs = spark.createDataFrame([(1001, 1), (1002, 2), (1003, 3), (1004, 4), (1004, 2)], "high long, low long")
    got = {(r.high, r.low): (r.is_best, r.ties) for r in R.best_match_evidence(df, pairs, "k", "n").collect()}
    assert got == {(1001, 1): (True, 1), (1002, 2): (True, 2), (1003, 3): (True, 3), (1004, 4): (True, 1), (1004, 2): (False, 1)}


def test_dimension_keys_are_gapless_over_pieces(spark):
    df = spark.createDataFrame([(i * 3 % 1000,) for i in range(1500)] + [(None,)], "k long")
    got = sorted((r.k, r.sk) for r in build_dim(df, "k", "sk", F.floor(F.col("k") / 64)).collect())
    keys = sorted({i * 3 % 1000 for i in range(1500)})
    assert got == [(k, n) for n, k in enumerate(keys, 1)]
    assert build_dim(df.limit(0), "k", "sk", F.lit(0)).count() == 0


def test_booking_fact_counts_what_does_not_fit(spark):
    day1 = day(2024, 1, 1)
    first = spark.createDataFrame([(1, 1, "USD", day1, D("10.00")), (2, 9, "XXX", day1, D("5.00")), (3, 1, "USD", day1, D("7.00")), (4, 1, "USD", day1, None)], "booking_id long, client_id long, currency string, shoot_date date, amount decimal(18,2)")
    second = spark.createDataFrame([(1, D("10.01")), (2, D("5.02")), (3, D("7.00")), (3, D("7.00"))], "booking_id long, other decimal(18,2)")
    rates = spark.createDataFrame([("USD", day1, D("2.0"))], "currency string, shoot_date date, rate decimal(14,6)")
    got = {r.booking_id: (r.matches, r.differs, r.no_rate, r.no_client) for r in build_booking_fact(first, second, rates, spark.createDataFrame([(1, "A")], "client_id long, c_name string")).collect()}
    assert got == {1: (1, False, False, False), 2: (1, True, True, True), 3: (2, True, False, False), 4: (0, True, False, False)}


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_similarity_against_a_table_of_lengths(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choices("abcd", k=rnd.randint(0, 12))), "".join(rnd.choices("abcd", k=rnd.randint(0, 12)))) for _ in range(150)] + [("", ""), ("", "a"), (None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", R.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert r.s == (None if r.a is None else 1.0 if r.a == r.b else 2 * lcs(r.a, r.b) / (len(r.a) + len(r.b)))


@pytest.mark.parametrize("text, value", [("Ọlá Ṣadé", "olasade"), ("Łukasz", "lukasz"), ("O\u0323la\u0301", "ola"), ("STRASSE straße", "strassestrasse"), ("ÆØ œ", "aeooe"), ("日本", ""), (None, None)])
def test_folded_names(spark, text, value):
    assert one(spark, text, C.folded) == value


def test_a_gate_stops_a_job_and_keeps_its_evidence(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 7 = 0 THEN 'maybe' WHEN id % 2 = 0 THEN '1.0' WHEN id % 3 = 0 THEN ' n/a ' ELSE 'No' END AS b")
    with pytest.raises(G.GateStopped, match="boolean b: unmapped is 15") as stopped:
        G.passed([G.strict_boolean(df, "b")])
    assert stopped.value.evidence == {"rows": 100, "unmapped": 15}
    (clean,) = G.passed([G.strict_boolean(df.filter("b <> 'maybe'"), "b")])
    assert {(r.id % 2 == 0, r.b) for r in clean.filter("id % 3 <> 0").collect()} == {(True, True), (False, False)}
    (empty,) = G.passed([G.strict_boolean(df.limit(0), "b")])
    assert empty.count() == 0


def test_gates_of_dates_and_clocks(spark):
    df = spark.createDataFrame([("13/1/2024",), ("1/2/2024",), (None,)], "d string")
    (got,) = G.passed([G.strict_date_order(df, "d", day_first=True)])
    assert sorted(str(r.d) for r in got.collect()) == ["2024-01-13", "2024-02-01", "None"]
    for rows, day_first in (([("13/1/2024",)], False), ([("1/2/2024",)], True)):
        with pytest.raises(G.GateStopped):
            G.passed([G.strict_date_order(spark.createDataFrame(rows, "d string"), "d", day_first)])
    e = spark.range(2000).selectExpr("CAST('2024-01-01' AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(8 + pow(id % 7, 2) / 4 AS INT), CAST(id % 60 AS INT), 0) AS ts")
    with pytest.raises(G.GateStopped, match="best_shift is -1"):
        G.passed([G.strict_clock(e.selectExpr("ts - INTERVAL 1 HOUR AS ts"), e, "ts")])
    (same,) = G.passed([G.strict_clock(e, e, "ts")])
    assert same.filter("NOT is_reference").count() == 2000


def _windows(seed, n):
    rnd = random.Random(seed)
    start = day(2020, 1, 1)
    some = lambda most: start + dt.timedelta(days=rnd.randint(0, most))
    points = [(i, rnd.choice(["a", "b", None]), some(400) if rnd.random() < 0.95 else None) for i in range(n)]
    windows = [(rnd.choice(["a", "b", "c", None]), i, some(350), rnd.choice([None, *[some(450) for _ in range(5)]])) for i in range(n // 2)]
    return points, windows


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("width", [1, 32, 1000])
def test_interval_joins_against_all_pairs(spark, keys, width):
    points, windows = _windows(1, 80)
    p, w = spark.createDataFrame(points, "i int, k string, day date"), spark.createDataFrame(windows, "k string, w int, lo date, hi date")
    w = w if keys else w.drop("k")
    want = sorted((i, x) for i, k, d in points for wk, x, lo, hi in windows if d and lo <= d <= (hi or dt.date.max) and (not keys or (k is not None and k == wk)))
    got = I.join_intervals(p, w, keys, "day", "lo", "hi", width)
    assert sorted((r.i, r.w) for r in got.collect()) == want
    left = I.join_intervals(p, w, keys, "day", "lo", "hi", width, how="left")
    assert {r.i for r in left.collect()} == set(range(80)) and left.filter("w IS NOT NULL").count() == len(want)
    assert I.join_intervals(p.limit(0), w, keys, "day", "lo", "hi", width).count() == 0


@pytest.mark.parametrize("width", [1, 20, 1000])
def test_as_of_joins_against_a_scan(spark, width):
    points, windows = _windows(2, 90)
    versions = list({(k, lo): (k, lo, x) for k, x, lo, _ in windows}.values())
    p, v = spark.createDataFrame(points, "i int, k string, day date"), spark.createDataFrame(versions, "k string, since date, x int")
    got = {r.i: r.x for r in I.join_as_of(p, v, ["k"], "day", "since", ["x"], width).collect()}
    for i, k, d in points:
        earlier = [(since, x) for vk, since, x in versions if d and vk == k and since <= d]
        assert got[i] == (max(earlier)[1] if earlier else None)
    assert len(got) == len(points)


def test_overlaps_against_all_pairs(spark):
    _, windows = _windows(3, 120)
    w = spark.createDataFrame(windows, "k string, w int, lo date, hi date")
    ends = [(k, x, lo, hi or dt.date.max) for k, x, lo, hi in windows if lo <= (hi or dt.date.max)]
    want = {(a[0], a[1], b[1]) for a in ends for b in ends if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3]}
    got = [tuple(r) for r in I.overlaps(w, "k", "w", "lo", "hi").collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("most", [3, 100_000])
def test_ranks_of_hot_groups(spark, monkeypatch, most):
    monkeypatch.setattr(S, "GROUP_ROWS", most)
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, rnd.randint(-50, 50)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = {r.i: r.r for r in S.rank_in_groups(df, ["k"], ["v", "i"], "r").collect()}
    for key in ("hot", "b", None):
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    texts = spark.createDataFrame([("k", f"prefix-{i % 50:03d}-{i:04d}") for i in range(300)], "k string, t string")
    ranked = S.rank_in_groups(texts, ["k"], ["t"], "r").orderBy("r").collect()
    assert [r.t for r in ranked] == sorted(r.t for r in ranked) and [r.r for r in ranked] == list(range(1, 301))


def test_duplicates_of_one_hot_group_with_null_keys(spark):
    df = spark.range(2000).selectExpr("CAST(NULL AS STRING) AS k", "IF(id % 2 = 0, NULL, 'x') AS soft", "id AS _row")
    kept, gone = S.split_exact_duplicates(df, ["k"], "_row")
    assert [r["_row"] for r in kept.collect()] == [0] and gone.count() == 1999 and {r["_detail"] for r in gone.collect()} == {"copy of 0"}
    kept, gone = S.split_content_duplicates(df, ["k"], "soft", "_row")
    assert [(r["_row"], r.soft, r.soft_conflict) for r in kept.collect()] == [(0, None, True)] and {r["_reason"] for r in gone.collect()} == {"duplicate but for soft"}
    assert sorted(r.u for r in S.disambiguate_key(df.withColumn("k", F.lit("k")), "k", ["_row"], "u").collect()) == sorted(f"k-{i}" for i in range(1, 2001))


def test_fill_chains_go_on_until_nothing_changes(spark):
    a = spark.createDataFrame([(1, None, None), (2, "x", None), (3, None, "old"), (None, None, None)], "k int, city string, country string")
    b = spark.createDataFrame([(1, "y"), (1, "y"), (3, "p"), (3, "q"), (None, "z")], "k int, city string")
    c = spark.createDataFrame([("x", "X"), ("y", "Y")], "city string, country string")
    rules = [L.FillRule("country", "a", "country", "city", lambda t: t["c"]), L.FillRule("city", "a", "city", "k", lambda t: t["b"])]
    out = L.fill_chain({"a": a, "b": b, "c": c}, rules)["a"].collect()
    assert sorted((r.k or 0, r.city, r.city_rule, r.country, r.country_rule) for r in out) == [(0, None, None, None, None), (1, "y", "city", "Y", "country"), (2, "x", None, "X", "country"), (3, None, None, "old", None)]
    assert {tuple(r) for r in L.rule_agreement({"a": a, "b": b, "c": c}, rules).collect()} == {("country", 0, 0), ("city", 0, 0)}
    assert L.fill_report(L.fill_chain({"a": a.limit(0), "b": b, "c": c}, rules), rules).count() == 0


def test_the_tighter_day_basis_is_chosen(spark):
    rows = [("13/1/2024", day(2024, 1, 10), day(2024, 1, 11)), ("25/1/2024", day(2024, 1, 21), day(2024, 1, 23)), ("2/1/2024", day(2024, 1, 1), day(2023, 12, 31)), (None, None, None)]
    out, windows = T.resolve_ambiguous_dates(spark.createDataFrame(rows, "raw string, a date, b date"), "raw", ["a", "b"])
    assert {tuple(r) for r in windows.collect()} == {("a", 3, 4, 2, False), ("b", 2, 2, 2, True)}
    assert [r.resolved for r in out.collect()] == [day(2024, 1, 13), day(2024, 1, 25), day(2024, 1, 2), None]
    _, tied = T.resolve_ambiguous_dates(spark.createDataFrame(rows, "raw string, a date, b date"), "raw", ["a", "a"])
    assert [r.is_chosen for r in tied.collect()] == [True, False]


def test_bursts_of_traffic(spark):
    start = dt.datetime(2024, 5, 1, 3, 0, 0)
    rows = [("s", start + dt.timedelta(seconds=40 * i), 0, 1) for i in range(10)] + [("s", start + dt.timedelta(hours=2, seconds=30 * i), 9, 50) for i in range(6)]
    rows += [("t", start + dt.timedelta(seconds=40 * i), 9, 1) for i in range(10)] + [("s", start + dt.timedelta(hours=5, minutes=10 * i), 0, 1) for i in range(9)] + [(None, None, 0, 90)]
    got = C.traffic_bursts(spark.createDataFrame(rows, "src string, at timestamp, d int, p int"), "src", "at", "d", "p", 60, 5).orderBy("started").collect()
    assert [(r.source, r.sessions, r.zero_share, r.heavy) for r in got] == [("s", 10, 1.0, 0), ("s", 6, 0.0, 6)]
    with pytest.raises(ValueError):
        C.traffic_bursts(spark.createDataFrame(rows, "src string, at timestamp, d int, p int"), "src", "at", "d", "p", 59)


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.344867, 3, 0.01), (0.0, 4, 1.0), (0.710723, 4, 0.95), (124.342113, 100, 0.05), (18.307038, 10, 0.05), (700.0, 3, 0.0)])
def test_chi_square_tails_of_a_table(spark, x, df, p):
    got = spark.createDataFrame([(x, df)], "x double, df int").select(chi_square_tail(F.col("x"), F.col("df")).alias("p")).first().p
    assert got == pytest.approx(p, abs=2e-6)


def test_profiles_of_nested_columns(spark):
    rows = [([1, 2], {"a": 1}, (1, "x"), "31.12.2023"), (None, None, None, "5-Jan-24"), ([], {}, (2, None), "January 5, 2024"), ([1, 2], {"a": 1}, (1, "x"), " n/a ")]
    df = spark.createDataFrame(rows, "a array<int>, m map<string,int>, s struct<i:int,t:string>, d string")
    exact = {r.column: r for r in P.profile({"t": df}, C.NULL_SPELLINGS).collect()}
    assert (exact["a"].distinct_values, exact["m"].distinct_values, exact["s"].distinct_values, exact["d"].type, exact["d"].nulls) == (2, 2, 2, "date", 1)
    assert exact["a"].least == "[1,2]" and exact["m"].greatest == '{}' and exact["s"].least == '{"i":1,"t":"x"}'
    sketched = {r.column: r for r in P.sketch_profile({"t": df}, C.NULL_SPELLINGS).collect()}
    for c, r in exact.items():
        assert all(sketched[c][k] == r[k] for k in ("n_rows", "nulls", "null_rate", "distinct_values", "distinct_shapes", "least", "greatest", "type"))
    assert P.profile({"t": df.limit(0)}, C.NULL_SPELLINGS).count() == P.sketch_profile({"t": df.limit(0)}, C.NULL_SPELLINGS).count() == 0


def test_values_that_differ_after_the_shown_part(spark):
    df = spark.createDataFrame([("x" * 50 + str(i % 5),) for i in range(20)] + [("é" * 200_000,)], "t string")
    (r,) = P.profile({"t": df}, C.NULL_SPELLINGS).collect()
    assert r.distinct_values == 6 and r.examples == " | ".join(["x" * 40] * 3) and r.greatest == "é" * 40


def test_a_profile_reads_its_tables_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x: int) -> str:
        read.add(1)
        return f"{x % 7}.5"

    df = spark.range(0, 40, 1, 2).select(F.udf(seen, "string")("id").alias("t"))
    (r,) = P.profile({"t": df}, C.NULL_SPELLINGS).collect()
    assert (r.n_rows, r.distinct_values, r.distinct_shapes, r.type, r.examples, r.greatest) == (40, 7, 1, "decimal", "0.5 | 1.5 | 2.5", "6.5") and read.value == 40


def test_profiles_of_numbers_and_times_are_those_of_their_texts(spark):
    numbers = [0.0, -0.0, 1e7, 9_999_999.0, 0.001, 0.0009, -5.25, float("nan"), float("inf"), None]
    ints = [0, 1, -1, 10**18, 10**18 - 1, -(2**63), 2**63 - 1, None, 7, -7]
    times = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(1, 1, 1), dt.datetime(2024, 1, 2, 3, 4, 5, 6), None] + [dt.datetime(9999, 12, 31)] * 6
    df = spark.createDataFrame(list(zip(numbers, ints, times)), "d double, i bigint, t timestamp_ntz")
    typed = {r.column: r for r in P.sketch_profile({"t": df}, C.NULL_SPELLINGS).collect()}
    texts = {r.column: r for r in P.sketch_profile({"t": df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])}, C.NULL_SPELLINGS).collect()}
    assert typed == texts and (typed["d"].distinct_shapes, typed["i"].distinct_shapes, typed["t"].type) == (5, 2, "timestamp")


def test_long_texts_keep_their_shapes_and_classes(spark):
    rows = ["1" * 45 + ".5", "1" * 44 + ".5", "1" * 39 + ".5", "2024-01-02 03:04:05 " + "x" * 40, "N/A" + " " * 60, "a" * 50, "a" * 40]
    (r,) = P.profile({"t": spark.createDataFrame([(x,) for x in rows], "t string")}, C.NULL_SPELLINGS).collect()
    assert (r.n_rows, r.nulls, r.distinct_values, r.distinct_shapes, r.type) == (7, 1, 6, 3, "decimal")


def test_sketches_and_counts_of_odd_cells_are_those_of_profiles(spark):
    numbers = [0.0, -0.0, 1e7, 9_999_999.0, 0.001, 0.0009, -5.25, float("nan"), float("inf"), None]
    ints = [0, 1, -1, 10**18, 10**18 - 1, -(2**63), 2**63 - 1, None, 7, -7]
    times = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(1, 1, 1), dt.datetime(2024, 1, 2, 3, 4, 5, 6), None] + [dt.datetime(9999, 12, 31)] * 6
    texts = ["1" * 45 + ".5", "x" * 50 + "1", "N/A" + " " * 60, "2024-01-02 03:04:05 " + "x" * 40, "t", "2024-01-05", "USD 12,000.50", " n/a ", "(1,234.50)", "1.5\n"]
    df = spark.createDataFrame(list(zip(numbers, ints, times, texts)), "d double, i bigint, t timestamp_ntz, s string")
    tables = {"t": df.unionAll(df), "none": df.limit(0)}
    for nulls in (C.NULL_SPELLINGS, ("", "7", "-5.25")):
        exact = {r.column: r.asDict() for r in P.profile(tables, nulls).collect()}
        direct = {r.column: r.asDict() for r in P.sketch_profile(tables, nulls).collect()}
        once, counts = P.sketches_and_counts(tables, nulls)
        assert {r.column: r.asDict() for r in once.collect()} == direct == {c: {k: r[k] for k in direct[c]} for c, r in exact.items()}
        assert {r.column: r.asDict() for r in counts.collect()} == {c: {k: r[k] for k in ("table", "column", "distinct_values", "distinct_shapes")} for c, r in exact.items()}


def test_classes_are_found_behind_their_shapes(spark):
    odd = ["1\n", "-1\r\n", "t\n", "False\r\n", ".5", "-.5\n", "5.", "1234567890123456789", "2024-01-05T10:00", "2024-01-05x", "1/2/2024\n", "1-Jan-24", "Juni 5, 2024", "5.1.2024\r\n", "JÜNI 5, 2024"]
    odd += ["$5", "(£ 1,000.5)", "ngn5", "NGN 1,000", "-USD 3", "1,000", "(1,000,000.25)", "1,00", "1,000\n", "EUR  5", "₦12,", "xyz 5", "", "-", "٣", "9" * 60 + ".5", "$" + "1" * 60, "x" * 60 + " 5, 2024"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    for r in df.select("t", P._bits(F.col("t"), P.shape(F.col("t"))).alias("bits"), *[F.col("t").rlike(p).alias(k) for k, p in P.CLASSES.items()]).collect():
        assert r.bits == sum(1 << i for i, k in enumerate(P.CLASSES) if r[k]), r


def test_a_query_of_sketches_reads_its_tables_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def seen(x: int) -> str:
        read.add(1)
        return f"{x % 7}.5"

    df = spark.range(0, 40, 1, 2).select(F.udf(seen, "string")("id").alias("t"))
    monkeypatch.setattr(warehouse, "_tables_to_profile", lambda spark, sf_dir: {"t": df})
    (r,) = warehouse.p1_sketch_profile(spark, "").collect()
    assert (r.n_rows, r.least, r.greatest, r.type, r.values_near, r.shapes_near) == (40, "0.5", "6.5", "decimal", True, True) and read.value == 40


def test_sketches_of_a_wide_table_are_compiled_in_short_methods(spark):
    wide = spark.range(9).select(*[F.col("id").cast(("double", "string", "bigint")[i % 3]).alias(f"c{i}") for i in range(24)])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = P.sketch_profile({"t": wide}, C.NULL_SPELLINGS)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    package = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    stages = getattr(package, "MODULE$").codegenStringSeq(plan)
    # HotSpot interprets longer methods for ever
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_manifests_find_what_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None), (2, None, None)], "i int, t string, m map<string,int>")
    save_with_manifest({"t": df, "none": df.limit(0)}, str(tmp_path / "a"))
    assert {tuple(r) for r in check_manifest(spark, str(tmp_path / "a")).collect()} == {("t", 3, True), ("none", 0, True)}
    for i, other in enumerate((df.limit(2), df.union(df), df.withColumn("t", F.coalesce("t", F.lit(""))), spark.createDataFrame([(1, None, {"k": 1}), (2, "a", None), (2, None, None)], df.schema))):
        save_tables({"t": other, "none": df.limit(0)}, str(tmp_path / f"b{i}"))
        assert {r["table"]: r.is_intact for r in check_manifest(spark, str(tmp_path / f"b{i}"), str(tmp_path / "a")).collect()} == {"t": False, "none": True}


def test_manifests_add_hashes_up_as_longs(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("t"))
    got = df.agg(*M.digest(df)).first()
    hashes = [r.h for r in df.select(F.xxhash64("id", "t", F.col("id").isNull(), F.col("t").isNull()).alias("h")).collect()]
    assert (got.n_rows, int(got.hash_sum)) == (1000, sum(hashes))
    save_with_manifest({"a": df, "b": df}, str(tmp_path / "m"))
    assert [tuple(r) for r in check_manifest(spark, str(tmp_path / "m"), names={"b"}).collect()] == [("b", 1000, True)]


def test_a_rule_runs_again_only_if_what_it_reads_was_filled(spark, monkeypatch):
    ran, plain = [], L._filled
    monkeypatch.setattr(L, "_filled", lambda tables, rule: (ran.append(rule.name), plain(tables, rule))[1])
    a = spark.createDataFrame([(1, None, None), (2, "x", None)], "k int, city string, country string")
    b = spark.createDataFrame([(1, "y", None), (3, "x", 5)], "k int, city string, n long")
    c = spark.createDataFrame([("x", "X"), ("y", "Y")], "city string, country string")
    counts = lambda t: t["b"].groupBy("k").agg(F.count("city").alias("n"))
    rules = [L.FillRule("country", "a", "country", "city", lambda t: t["c"]), L.FillRule("city", "a", "city", "k", lambda t: t["b"]), L.FillRule("n", "b", "n", "k", counts, ("k", "city"))]
    out = L.fill_chain({"a": a, "b": b, "c": c}, rules)
    assert ran == ["country", "city", "n", "country"]
    assert sorted((r.k, r.city, r.country) for r in out["a"].collect()) == [(1, "y", "Y"), (2, "x", "X")]
    assert sorted((r.k, r.n, r.n_rule) for r in out["b"].collect()) == [(1, 1, "n"), (3, 5, None)]


def test_rows_of_percentiles_and_versions_of_prices_do_not_gather(spark):
    lines = spark.range(100).select((F.col("id") % 7).alias("sku"), F.lit("1996-01-01").cast("date").alias("day"), (F.col("id") + 1).cast("double").alias("paid"), (F.col("id") % 3).alias("flag"))
    versions = spark.range(7).select(F.col("id").alias("sku"), F.lit("1995-01-01").cast("date").alias("valid_from"), F.lit("1997-01-01").cast("date").alias("valid_to"), F.lit(2.0).alias("list_price"))
    plan_of = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    joined = T.join_valid(lines, versions, "sku", "day")
    assert "BroadcastHashJoin" not in plan_of(joined) and joined.filter("list_price = 2").count() == 100
    rows = lines.withColumn("x", F.col("paid"))
    found = T.exact_percentiles(rows, ["flag"], "x", {"low": 0.1, "mid": 0.5})
    assert "SortMergeJoin" not in plan_of(found)
    assert {r["__by"]: r.mid for r in found.collect()} == {0: 50.5, 1: 50.0, 2: 51.0}


def test_revenue_reads_both_tables_once_and_keeps_rows_without_a_day(spark, tmp_path):
    day = F.to_timestamp(F.col("d"))
    o = spark.createDataFrame([("2024-01-02", 1.1), ("2024-05-02", 2.0), (None, 9.0)], "d string, o_totalprice double").withColumn("o_orderdate", day)
    l = spark.createDataFrame([("2024-01-02", 10.0, 0.05), ("2024-03-31", 0.1, 0.05), ("2024-01-02", 10.0, None), ("2024-07-01", None, 0.1)], "d string, l_extendedprice double, l_discount double").withColumn("l_shipdate", day)
    save_tables({"orders": o, "lineitem": l}, str(tmp_path))
    found = q01_quarterly_revenue(spark, str(tmp_path))
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
    assert {tuple(r) for r in found.collect()} == {("2024Q1", 1.1, 9.6), ("2024Q2", 2.0, 0.0), ("2024Q3", 0.0, 0.0), (None, 0.0, 0.0)}
