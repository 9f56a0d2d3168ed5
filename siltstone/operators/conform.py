"""Conformance of badly kept columns: each job parses with native expressions and reports what it could not explain."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spellings of a missing value, compared in lower case without outer blanks.
NULL_SPELLINGS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tbc", "unknown")
TRUE_SPELLINGS = ("1", "1.0", "true", "t", "yes", "y", "active", "on")
FALSE_SPELLINGS = ("0", "0.0", "false", "f", "no", "n", "inactive", "off")


def key_of(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, no outer blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "))


def conform_nulls(df: DataFrame, columns: list[str], spellings: tuple[str, ...] = NULL_SPELLINGS) -> tuple[DataFrame, DataFrame]:
    """`df` with nulls for all spellings of them, and how often each spelling occurs in each column."""
    is_null = lambda c: F.lower(F.trim(c)).isin(*spellings)
    clean = df.withColumns({c: F.when(~is_null(F.col(c)), F.col(c)) for c in columns})
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("spelling")) for c in columns])).alias("x")).select("x.*")
    return clean, long.filter(is_null(F.col("spelling"))).groupBy("column", "spelling").agg(F.count(F.lit(1)).alias("n"))


def conform_category(df: DataFrame, column: str, mapping: DataFrame, default: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`column` mapped by its key, and the spellings that no row of mapping (key, value) explains."""
    mapped = df.withColumn("__key", key_of(F.col(column))).join(mapping.select(F.col("key").alias("__key"), F.col("value").alias("__value")), "__key", "left")
    value = F.col("__value") if default is None else F.when(F.col(column).isNull() | (F.col("__key") == ""), default).otherwise(F.col("__value"))
    known = F.col(column).isNull() | (F.col("__key") == "") | F.col("__value").isNotNull()
    unmapped = mapped.filter(~known).groupBy(F.col(column).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    return mapped.withColumn(column, value).drop("__key", "__value"), unmapped


def conform_boolean(c: Column) -> Column:
    """True, false, or null for what is neither."""
    k = F.lower(F.trim(c))
    return F.when(k.isin(*TRUE_SPELLINGS), True).when(k.isin(*FALSE_SPELLINGS), False)


def conform_id(c: Column, prefix: str, digits: int) -> Column:
    """PREFIX-00000 from any spelling with digits; null without digits or with too many."""
    found = F.regexp_replace(c, r"\D", "")
    number = F.regexp_replace(found, r"^0+(?=\d)", "")
    return F.when((found != "") & (F.length(number) <= digits), F.concat(F.lit(f"{prefix}-"), F.lpad(number, digits, "0")))


def id_report(df: DataFrame, raw: str, clean: str) -> DataFrame:
    """Distinct spellings, distinct ids, and ids with more than one spelling."""
    per = df.groupBy(clean).agg(F.countDistinct(raw).alias("s"))
    return per.agg(F.sum("s").alias("spellings"), F.count(clean).alias("ids"), F.count_if(F.col("s") > 1).alias("respelt"))


def date_order_evidence(df: DataFrame, column: str, sep: str = "/") -> DataFrame:
    """How many a/b/yyyy values can only be day first, only month first, or both."""
    a = F.regexp_extract(column, rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}\d{{4}}$", 1).try_cast("int")
    b = F.regexp_extract(column, rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}\d{{4}}$", 2).try_cast("int")
    return df.agg(F.count_if((a > 12) & (b <= 12)).alias("day_first"), F.count_if((a <= 12) & (b > 12)).alias("month_first"), F.count_if((a <= 12) & (b <= 12)).alias("either"))


def conform_date(c: Column, day_first: bool) -> Column:
    """A date from ISO, a/b/yyyy in the proven order, dd.mm.yyyy, dd-Mon-yy(yy), Month dd, yyyy or a spreadsheet serial."""
    t = F.trim(c)
    as_date = lambda text, fmt: F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
    slash = "d/M/yyyy" if day_first else "M/d/yyyy"
    serial = F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int"))
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), as_date(t, "yyyy-MM-dd"))
        .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), as_date(t, slash))
        .when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), as_date(t, "d.M.yyyy"))
        .when(t.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), as_date(t, "d-MMM-yyyy"))
        .when(t.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"), as_date(t, "d-MMM-yy"))
        .when(t.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), as_date(t, "MMMM d, yyyy"))
        .when(t.rlike(r"^\d{5}$"), serial)
    )


def conform_instant(c: Column, epoch_shift_hours: int = 0) -> tuple[Column, Column]:
    """(instant without zone in UTC, format tag) from ISO with Z or an offset, naive ISO (UTC) or epoch milliseconds of a
    clock that runs `epoch_shift_hours` ahead."""
    t = F.trim(c)
    base = F.try_to_timestamp(F.substring(t, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    hours = F.regexp_extract(t, r"([+-]\d{2}):?(\d{2})$", 1).try_cast("int")
    minutes = F.regexp_extract(t, r"([+-]\d{2}):?(\d{2})$", 2).try_cast("int")
    seconds = lambda s: F.timestamp_seconds(s)
    tag = F.when(t.rlike(r"^\d{4}-.*Z$"), "z").when(t.rlike(r"^\d{4}-.*[+-]\d{2}:?\d{2}$"), "offset").when(t.rlike(r"^\d{4}-"), "naive").when(t.rlike(r"^\d{12,14}$"), "epoch")
    value = (
        F.when(tag.isin("z", "naive"), base)
        .when(tag == "offset", seconds(F.unix_timestamp(base) - hours * 3600 - F.when(hours < 0, -minutes).otherwise(minutes) * 60))
        .when(tag == "epoch", F.timestamp_millis(t.try_cast("long") - epoch_shift_hours * 3_600_000))
    )
    return value.cast("timestamp_ntz"), tag


def instant_agreement(df: DataFrame, key: str, instant: str, tag: str) -> DataFrame:
    """For rows of one key written in two formats: how often each gap in seconds occurs."""
    a = df.select(key, F.col(instant).alias("x"), F.col(tag).alias("tag_a"))
    b = df.select(key, F.col(instant).alias("y"), F.col(tag).alias("tag_b"))
    gap = F.unix_timestamp(F.col("y").cast("timestamp")) - F.unix_timestamp(F.col("x").cast("timestamp"))
    return a.join(b, key).filter("tag_a < tag_b").groupBy("tag_a", "tag_b", gap.alias("gap_s")).agg(F.count(F.lit(1)).alias("n"))


def fit_clock_offset(df: DataFrame, ref: DataFrame, ts: str, shifts: range = range(-3, 4)) -> DataFrame:
    """L1 distance of the 15-minute activity histograms of df, moved by each whole number of hours, and ref."""
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / 15).cast("int")

    def shares(x: DataFrame) -> DataFrame:
        counts = x.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("slot", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))

    moved = shares(df).withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("slot", F.pmod(F.col("slot") - 4 * F.col("shift"), F.lit(96)))
    wanted = shares(ref).withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumnRenamed("p", "q")
    both = moved.join(wanted, ["slot", "shift"], "full").withColumn("d", F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))))
    return both.groupBy("shift").agg(F.round(F.sum("d"), 6).alias("distance"))


def conform_discount(c: Column) -> Column:
    """A share as decimal(6,4) from 5%, 5 or 0.05; blank is 0."""
    t = F.trim(F.coalesce(c, F.lit("")))
    number = F.regexp_replace(t, "%", "").try_cast("decimal(10,4)")
    percent = t.endswith("%") | (number >= 1)
    return F.when(t == "", F.lit(0)).when(percent, number / 100).otherwise(number).cast("decimal(6,4)")


def conform_number(c: Column) -> Column:
    """A number from digits with blanks between them and a unit of hours behind them."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s*(h|hr|hrs|hours?)$", ""), r"(?<=\d)[ ,](?=\d{3})", "")
    return bare.try_cast("double")


def conform_hours(c: Column, most: float = 24, long: float = 12) -> tuple[Column, Column]:
    """(hours, flag): more than `most` is blanked, more than `long` flagged."""
    h = conform_number(c)
    return F.when(h <= most, h), F.when(h > most, "impossible").when(h > long, "long day")


def conform_email(c: Column) -> Column:
    """Lower case, without +alias; null if it is no address."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"\+[^@]*@", "@")
    return F.when(t.rlike(r"^[a-z0-9._-]+@[a-z0-9-]+(\.[a-z0-9-]+)+$"), t)


def conform_phone(c: Column, country: str = "234", digits: int = 10) -> tuple[Column, Column]:
    """(+country number, reason if it is none) from local, national and international spellings."""
    d = F.regexp_replace(c, r"\D", "")
    local = F.when(d.startswith("00" + country), F.substring(d, len(country) + 3, 30)).when(d.startswith(country), F.substring(d, len(country) + 1, 30)).when(d.startswith("0"), F.substring(d, 2, 30)).otherwise(d)
    return F.when(F.length(local) == digits, F.concat(F.lit(f"+{country}"), local)), F.when(F.length(local) < digits, "too short").when(F.length(local) > digits, "too long")


def tidy_name(c: Column, acronyms: tuple[str, ...] = ("LTD", "PLC", "TV")) -> Column:
    """Words in title case, also behind an apostrophe or hyphen; acronyms stay capitals; blanks are single."""
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    title = lambda w: F.array_join(F.transform(F.split(F.array_join(F.transform(F.split(w, "-"), lambda p: F.initcap(p)), "-"), "'"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))), "'")
    return F.array_join(F.transform(words, lambda w: F.when(F.upper(w).isin(*acronyms), F.upper(w)).otherwise(title(w))), " ")


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters of the Latin script beyond ASCII whose decomposition begins with a letter from a to z, and those
    letters; and the marks that a decomposed text has apart, which go."""
    pairs = {chr(i): unicodedata.normalize("NFKD", chr(i))[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(i).islower()}
    return "".join(c for c, x in pairs.items() if x.isascii() and x.isalpha()), "".join(x for x in pairs.values() if x.isascii() and x.isalpha())


ACCENTED, PLAIN = _plain_letters()
#: Letters without a decomposition that are read as these (fixed values).
STROKED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ħ": "h", "ı": "i", "ŋ": "n", "ɓ": "b", "ɗ": "d", "ƙ": "k"}


def folded(c: Column) -> Column:
    """Letters a to z only: lower case, letters with marks as those without."""
    out = F.translate(F.lower(c), ACCENTED, PLAIN)
    for letter, plain in STROKED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, "[^a-z]", "")


def conform_url(c: Column) -> Column:
    """Without query, fragment, index page and trailing slash; lower case; `/` for the root."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[?#].*$", ""), r"/index\.(html?|php)$", "/")
    bare = F.regexp_replace(t, r"/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def classify_traffic(df: DataFrame, agent: str, source: str, spam_sources: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """is_bot by user agent, is_spam by source; and how many spam rows are not bots, which must be none."""
    out = df.withColumns({"is_bot": F.coalesce(F.col(agent).rlike("(?i)bot|crawler|spider|headless"), F.lit(False)), "is_spam": F.coalesce(F.col(source).isin(*spam_sources), F.lit(False))})
    return out, out.agg(F.count_if("is_bot").alias("bots"), F.count_if("is_spam").alias("spam"), F.count_if(F.col("is_spam") & ~F.col("is_bot")).alias("violations"))


def traffic_bursts(df: DataFrame, source: str, at: str, duration: str, pages: str, gap_seconds: int = 300, least: int = 20, zero: float = 0.9, heavy_pages: int = 40, heavy: float = 0.5) -> DataFrame:
    """Bursts: runs of sessions of a source on a day without a gap of more than gap_seconds (60 at least), of `least` sessions
    or more, of which a share of `zero` has no duration or a share of `heavy` at least heavy_pages pages. (source, day,
    started, ended, sessions, zero_share, heavy).

    Sessions are added up by source and minute first, so a source and day is 1440 rows at most, whatever its traffic; a gap
    inside a minute is no gap. Null instants are left out, null durations and page counts are no evidence.
    """
    if gap_seconds < 60:
        raise ValueError("gaps under a minute are not told apart")
    known = df.filter(F.col(at).isNotNull())
    per = known.groupBy(F.col(source).alias("source"), F.to_date(at).alias("day"), F.date_trunc("minute", at).alias("minute")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(duration) == 0).alias("z"), F.count_if(F.col(pages) >= heavy_pages).alias("h"),
    )
    order = Window.partitionBy("source", "day").orderBy("minute")
    apart = F.unix_timestamp("first") - F.unix_timestamp(F.lag("last").over(order)) > gap_seconds
    runs = per.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = runs.groupBy("source", "day", "run").agg(F.min("first").alias("started"), F.max("last").alias("ended"), F.sum("n").alias("sessions"), (F.sum("z") / F.sum("n")).alias("zero_share"), F.sum("h").alias("heavy"))
    return told.filter((F.col("sessions") >= least) & ((F.col("zero_share") >= zero) | (F.col("heavy") >= heavy * F.col("sessions")))).drop("run")


def zero_fill_if_proven(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Blanks become 0 if no row that meets the condition is blank and no other row has a value."""
    v = df.agg(F.count_if(condition & F.col(column).isNull()).alias("blank_wrong"), F.count_if(~condition & F.coalesce(F.col(column) != 0, F.lit(False))).alias("value_wrong"))
    proven = (F.col("blank_wrong") == 0) & (F.col("value_wrong") == 0)
    return df.crossJoin(F.broadcast(v)).withColumn(column, F.when(proven, F.coalesce(F.col(column), F.lit(0))).otherwise(F.col(column)))


def missing_report(df: DataFrame, columns: list[str], expected: dict[str, Column] | None = None) -> DataFrame:
    """Per column: rows, missing, share of them, and what they mean: `expected` ones, where the column's condition says that
    there is nothing to record, and `unrecorded` ones; one pass over the table."""
    known = expected or {}
    blank = lambda c: F.col(c).isNull()
    due = {c: F.coalesce(known.get(c, F.lit(False)), F.lit(False)) for c in columns}
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count_if(blank(c)).alias("missing"), F.count_if(blank(c) & due[c]).alias("expected")).alias(c) for c in columns])
    told = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.missing").alias("missing"), F.col(f"{c}.expected").alias("expected")) for c in columns])).alias("x"))
    return told.select("x.column", F.col("n").alias("n_rows"), "x.missing", F.round(F.col("x.missing") / F.col("n"), 6).alias("share"), "x.expected", (F.col("x.missing") - F.col("x.expected")).alias("unrecorded"))


def conform_campaign(c: Column) -> Column:
    """A campaign's name in one format: lower case, anything but letters and digits as one underscore, none at the ends; the
    name itself is not mapped. Null if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "_"), r"^_|_$", "")
    return F.when(name != "", name)


def discount_problem(c: Column, allowed: list[str]) -> Column:
    """Why a conformed discount is rejected: `unreadable` for a null, `off the list` for one that is not allowed."""
    return F.when(c.isNull(), "unreadable").when(~c.isin(*[F.lit(x).cast("decimal(6,4)") for x in allowed]), "off the list")


def source_agreement(df: DataFrame, sources: list[str]) -> DataFrame:
    """(first, second, same, different) for each two columns that say the same thing, on rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1 :]]
    counts = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.count_if(F.col(a) == F.col(b)).alias(f"s{i}"), F.count_if(F.col(a) != F.col(b)).alias(f"d{i}"))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"s{i}").alias("same"), F.col(f"d{i}").alias("different")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


#: The characters that Windows-1252 has at 0x80 to 0x9F, in order; five of those bytes stand for themselves.
CP1252_HIGH = "€\u0081‚ƒ„…†‡ˆ‰Š‹Œ\u008dŽ\u008f\u0090‘’“”•–—˜™š›œ\u009džŸ"
C1 = "".join(chr(c) for c in range(0x80, 0xA0))


def _decoded(c: Column) -> Column:
    """Text whose characters are bytes (ISO-8859-1): each run beyond ASCII is UTF-8 if it can be, else Windows-1252."""
    runs = F.regexp_extract_all(c, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), F.lit(1))
    data = lambda r: F.encode(r, "ISO-8859-1")
    fix = lambda r: F.when(F.is_valid_utf8(data(r).cast("string")), F.decode(data(r), "UTF-8")).otherwise(F.translate(r, C1, CP1252_HIGH))
    return F.array_join(F.transform(runs, fix), "")


def repair_text(df: DataFrame, columns: list[str], passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Columns read as ISO-8859-1, decoded run by run, double encoding undone in a bounded number of passes; and the
    repaired cells per column."""

    def repaired(c: Column) -> Column:
        out = _decoded(c)
        for _ in range(passes - 1):
            back = F.translate(out, CP1252_HIGH, C1)
            narrow = ~back.rlike(r"[^\x00-\xFF]")
            again = _decoded(back)
            twice = narrow & back.rlike(r"[\xC2-\xF4][\x80-\xBF]")
            out = F.when(twice, again).otherwise(out)
        return out

    out = df.withColumns({f"__{c}": repaired(F.col(c)) for c in columns})
    report = out.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in columns])
    report = report.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("repaired")) for c in columns])).alias("x")).select("x.*")
    return out.withColumns({c: F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns]), report


def resolve_currency(df: DataFrame, sources: list[str], group: str, floor: tuple[Column, str]) -> DataFrame:
    """`currency` from the first source column that has one, else the only one of the group's other rows, else the floor
    rule; `rule` names which. Only rows without a source are joined with their group's; a null group has no siblings."""
    told = df.withColumn("__direct", F.coalesce(*[F.col(s) for s in sources]))
    rule = reduce(lambda a, s: a.when(F.col(s).isNotNull(), s), sources[1:], F.when(F.col(sources[0]).isNotNull(), sources[0]))
    direct = told.filter("__direct IS NOT NULL").withColumns({"rule": rule, "currency": F.col("__direct")})
    only = told.filter("__direct IS NOT NULL").groupBy(F.col(group).alias("__group")).agg(F.when(F.min("__direct") == F.max("__direct"), F.min("__direct")).alias("__sibling"))
    rest = told.filter("__direct IS NULL").join(only, F.col(group) == F.col("__group"), "left")
    inferred = F.when(F.col("__sibling").isNotNull(), "siblings").when(floor[0], "floor").otherwise("unresolved")
    found = rest.withColumns({"rule": inferred, "currency": F.coalesce("__sibling", F.when(floor[0], floor[1]))})
    return direct.drop("__direct").unionByName(found.drop("__direct", "__group", "__sibling"))


def convert_fx(df: DataFrame, fx: DataFrame, amount: str, currency: str, day: str, home: str) -> DataFrame:
    """`local`: the amount at the rate of its day; `fx_missing`: foreign without a rate. fx: (currency, rate_date, rate)."""
    rates = fx.select(F.col("currency").alias("__c"), F.col("rate_date").alias("__d"), F.col("rate").alias("fx_rate"))
    out = df.join(rates, (F.col(currency) == F.col("__c")) & (F.col(day) == F.col("__d")), "left").drop("__c", "__d")
    at = F.when(F.col(currency) == home, F.lit(1).cast("decimal(14,6)")).otherwise(F.col("fx_rate"))
    return out.withColumn("local", F.round(F.col(amount) * at, 2).cast("decimal(18,2)")).withColumn("fx_missing", at.isNull())


def convert_net(df: DataFrame, fx: DataFrame, gross: str, discount: str, currency: str, day: str, home: str) -> tuple[DataFrame, DataFrame]:
    """Rows with `net` (gross less its discount, null discounts being 0) and `local` at the rate of the day; and the rejected
    rows: foreign amounts without a day, and those whose day has no rate."""
    net = df.withColumn("net", F.round(F.col(gross) * (1 - F.coalesce(F.col(discount), F.lit(0).cast("decimal(6,4)"))), 2).cast("decimal(18,2)"))
    told = convert_fx(net, fx, "net", currency, day, home)
    reason = F.when(F.col("fx_missing") & F.col(day).isNull(), "foreign without a day").when(F.col("fx_missing"), "no rate")
    marked = told.withColumns({"_reason": reason, "_detail": F.concat_ws(" ", currency, F.col(day).cast("string"))})
    return marked.filter("_reason IS NULL").drop("_reason", "_detail", "fx_missing"), marked.filter("_reason IS NOT NULL").drop("fx_missing")
