"""Amounts of money by a strict grammar: what cannot be read without a guess is a problem, never a number."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of no amount, in lower case (fixed values).
NO_AMOUNT = ("", "-", "--", "null", "none", "n/a", "na", "#n/a", "unknown", "tbd", "nan")
#: Codes and signs of the currencies that an amount may name (fixed values).
CURRENCY_MARKS = (("NGN", "NGN"), ("USD", "USD"), ("GBP", "GBP"), ("EUR", "EUR"), ("₦", "NGN"), ("$", "USD"), ("£", "GBP"), ("€", "EUR"))
#: Problems.
CONFLICT, UNREADABLE, TOO_LARGE = "conflicting currencies", "not an amount", "too large"

#: The shapes of a bare amount (fixed patterns), of which no two fit one text, and their factors.
SHAPES = (
    (r"^\d+(\.\d+)?$", 1),
    (r"^\d{1,3}(,\d{3})+(\.\d+)?$", 1),
    (r"^\d{1,3}( \d{3})+(\.\d+)?$", 1),
    (r"^\d+(\.\d+)?\s?[kK]$", 1_000),
    (r"^\d+(\.\d+)?\s?[mM]$", 1_000_000),
    (r"^\d+(\.\d+)?\s?[bB]$", 1_000_000_000),
)
#: A further shape (fixed pattern), for files that are known to have decimal commas.
DECIMAL_COMMA = (r"^\d+,\d{1,2}$", 1)
AMOUNT = "decimal(24,6)"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, so that steps on top of each other do not multiply the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _minus(s: Column) -> Column:
    """(negative, t): a leading minus of the text turns the sign."""
    found = s["t"].startswith("-")
    return F.struct((s["negative"] != found).alias("negative"), F.when(found, _stripped(F.regexp_replace(s["t"], "^-", ""))).otherwise(s["t"]).alias("t"))


def read_money(c: Column, decimal_comma: bool = False) -> Column:
    """A struct (amount, currency, problem) read from a text.

    A spelling of null has none of the three. Parentheses around all of it and a minus before or behind the currency turn
    the sign, `/-` at the end is dropped. Then the marks of one currency may stand anywhere; marks of two are a problem
    without a currency. The rest must have one of SHAPES; `decimal_comma`, for files that are known to be written so, adds
    digits, a comma and one or two digits. Anything else is a problem that keeps its currency. An amount has six decimals at
    most (rounded half up); one that AMOUNT does not hold is a problem.
    """
    shapes = [*SHAPES, DECIMAL_COMMA] if decimal_comma else SHAPES
    marks = "|".join(rf"\{m}" if m == "$" else m for m, _ in CURRENCY_MARKS)
    sign = lambda negative, t: F.struct(negative.alias("negative"), t.alias("t"))
    none = lambda kind: F.lit(None).cast(kind)
    money = lambda amount, currency, problem: F.struct(amount.cast(AMOUNT).alias("amount"), currency.alias("currency"), problem.alias("problem"))

    def bracketed(t: Column) -> Column:
        found = t.rlike(r"(?s)^\(.*\)$")
        return sign(found, F.when(found, _stripped(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t))

    def currencies(t: Column) -> Column:
        return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(mark)), code) for mark, code in CURRENCY_MARKS])))

    def told(s: Column, currency: Column) -> Column:
        """What is left when sign and currency are known."""
        t = s["t"]
        fits = reduce(lambda w, i: w.when(t.rlike(shapes[i][0]), i), range(1, len(shapes)), F.when(t.rlike(shapes[0][0]), 0))
        return _let(fits, lambda shape: _amount(s, shape, currency))

    def _amount(s: Column, shape: Column, currency: Column) -> Column:
        bare = F.when(shape == len(SHAPES), F.translate(s["t"], ",", ".")).otherwise(F.translate(s["t"], " ,kKmMbB", ""))
        factor = F.get(F.array(*[F.lit(f) for _, f in shapes]), shape).cast("decimal(10,0)")
        value = F.when(shape.isNotNull(), F.round(bare.try_cast("decimal(38,8)") * factor, 6).try_cast(AMOUNT))
        return _let(value, lambda x: money(F.when(s["negative"], -x).otherwise(x), currency, F.when(shape.isNull(), UNREADABLE).when(x.isNull(), TOO_LARGE)))

    def without_marks(s: Column) -> Column:
        bare = sign(s["negative"], _stripped(F.regexp_replace(F.regexp_replace(s["t"], marks, " "), r"\s+", " ")))
        return _let(currencies(s["t"]), lambda named: F.when(F.size(named) > 1, money(none(AMOUNT), none("string"), F.lit(CONFLICT))).otherwise(_let(bare, lambda b: _let(_minus(b), lambda m: told(m, F.get(named, F.lit(0)))))))

    def signed(t: Column) -> Column:
        return _let(bracketed(t), lambda b: _let(_minus(b), lambda m: _let(sign(m["negative"], _stripped(F.regexp_replace(m["t"], r"/-$", ""))), without_marks)))

    text = _stripped(F.translate(c, "\u00a0\u202f", "  "))
    blank = lambda t: F.coalesce(F.lower(t).isin(*NO_AMOUNT), F.lit(True))
    return _let(text, lambda t: F.when(blank(t), money(none(AMOUNT), none("string"), none("string"))).otherwise(signed(t)))


def conform_money(df: DataFrame, column: str, decimal_comma: bool = False, out: str = "money") -> DataFrame:
    """`df` with `out`, what `read_money` says of the text `column`."""
    return df.withColumn(out, read_money(F.col(column), decimal_comma))


def money_problems(df: DataFrame, money: str = "money") -> DataFrame:
    """How often each problem occurs, with the amounts that were read and the blanks: (kind, n)."""
    kind = F.coalesce(F.col(f"{money}.problem"), F.when(F.col(f"{money}.amount").isNull(), "blank"), F.lit("read"))
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
