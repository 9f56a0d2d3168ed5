"""Gates: evidence that is counted while a job's rows are written, and that stops the job where it is not as it must be.

A job is a pair (rows, gate). The gate's counts are observed metrics of the rows, so nothing is read twice; `passed` writes
the rows of one or more jobs and lets them through only if every gate agrees. A metric is a whole number and must lie in
its range; blanks of the counted columns are no evidence either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siltstone.operators import conform as C
from siltstone.operators.resolve import match_rekeyed
from siltstone.operators.temporal import rate_steps
from siltstone.sources.scratch import new_path

NONE = (0, 0)


class GateStopped(ValueError):
    """A job that may not go on, with its evidence."""

    def __init__(self, name: str, evidence: dict[str, int], wrong: list[str]):
        super().__init__(f"{name}: " + ", ".join(f"{k} is {evidence[k]}" for k in wrong))
        self.name, self.evidence, self.wrong = name, evidence, wrong


class Gate:
    """Counts of one job; allowed: the least and the greatest value of a metric (None: any)."""

    def __init__(self, name: str, metrics: dict[str, Column], allowed: dict[str, tuple[int | None, int | None]]):
        self.name, self.metrics, self.allowed = name, metrics, allowed
        self.observation = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        """`df`, counted where it stands in the plan."""
        return df.observe(self.observation, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in self.metrics.items()])

    def evidence(self) -> dict[str, int]:
        """The counts, once the rows have been written."""
        return dict(self.observation.get)

    def settle(self) -> dict[str, int]:
        """The evidence; GateStopped if a count is out of its range."""
        found = self.evidence()
        wrong = [k for k, (least, most) in self.allowed.items() if (least is not None and found[k] < least) or (most is not None and found[k] > most)]
        if wrong:
            raise GateStopped(self.name, found, wrong)
        return found


class ClockGate(Gate):
    """The shift of whole hours at which the rows' time of day fits the reference best must be 0. Quarters of an hour of both
    are counted in one pass; the driver compares 96 numbers with 96."""

    def __init__(self, name: str, slot: Column, is_ref: Column, shifts: range):
        count = lambda side, i: F.count_if(side & (slot == i))
        super().__init__(name, {f"{n}{i}": count(side, i) for n, side in (("own", ~is_ref), ("ref", is_ref)) for i in range(96)}, {"best_shift": NONE})
        self.shifts = shifts

    def evidence(self) -> dict[str, int]:
        """The best shift (ties to the smallest move, then to the earlier) and the numbers of rows."""
        found = self.observation.get
        own, ref = ([found[f"{n}{i}"] for i in range(96)] for n in ("own", "ref"))
        a, b = max(1, sum(own)), max(1, sum(ref))
        apart = {s: sum(abs(own[(i + 4 * s) % 96] * b - ref[i] * a) for i in range(96)) for s in self.shifts}
        return {"best_shift": min(apart, key=lambda s: (apart[s], abs(s), s)), "own": sum(own), "ref": sum(ref)}


def passed(jobs: list[tuple[DataFrame, Gate]]) -> list[DataFrame]:
    """The rows of each job, stored in the shared folder; GateStopped from the first gate that does not agree."""
    out = []
    for df, gate in jobs:
        path = new_path(df.sparkSession, "gated")
        df.write.parquet(path)
        gate.settle()
        out.append(df.sparkSession.read.schema(df.schema).parquet(path))
    return out


def strict_category(df: DataFrame, column: str, mapping: DataFrame, default: str | None = None) -> tuple[DataFrame, Gate]:
    """A category mapped by its key; a spelling that no mapping explains stops the job."""
    kept = df.withColumn("__raw", F.col(column))
    mapped = C.conform_category(kept, column, mapping, default)[0]
    named = (C.key_of(F.col("__raw")) != "") & F.col("__raw").isNotNull()
    gate = Gate(f"category {column}", {"rows": F.count(F.lit(1)), "unmapped": F.count_if(named & F.col(column).isNull())}, {"unmapped": NONE})
    return gate.watch(mapped).drop("__raw"), gate


def strict_boolean(df: DataFrame, column: str) -> tuple[DataFrame, Gate]:
    """A boolean; a spelling that is neither true, false nor blank stops the job."""
    value = C.conform_boolean(F.col(column))
    blank = F.col(column).isNull() | F.lower(F.trim(column)).isin(*C.NULL_SPELLINGS)
    gate = Gate(f"boolean {column}", {"rows": F.count(F.lit(1)), "unmapped": F.count_if(value.isNull() & ~blank)}, {"unmapped": NONE})
    return gate.watch(df).withColumn(column, value), gate


def strict_date_order(df: DataFrame, column: str, day_first: bool, sep: str = "/") -> tuple[DataFrame, Gate]:
    """Dates in the order that is claimed; a date that only the other order explains stops the job, and so do dates of
    which none proves it where some could be read either way."""
    a, b = (F.regexp_extract(F.trim(column), rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}\d{{4}}$", i).try_cast("int") for i in (1, 2))
    day, month = (a, b) if day_first else (b, a)
    proof, either = F.count_if((day > 12) & (month <= 12)), F.count_if((day <= 12) & (month <= 12))
    unproven = F.when((proof == 0) & (either > 0), either).otherwise(0)
    gate = Gate(f"date order {column}", {"proof": proof, "against": F.count_if(month > 12), "unproven": unproven}, {"against": NONE, "unproven": NONE})
    return gate.watch(df).withColumn(column, C.conform_date(F.col(column), day_first)), gate


def strict_clock(df: DataFrame, ref: DataFrame, ts: str, shifts: range = range(-3, 4)) -> tuple[DataFrame, Gate]:
    """Instants whose time of day fits the reference's best without a shift; any other best shift stops the job. The
    rows of `ref` come along, marked by `is_reference`."""
    both = df.withColumn("is_reference", F.lit(False)).unionByName(ref.withColumn("is_reference", F.lit(True)), allowMissingColumns=True)
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / 15).cast("int")
    gate = ClockGate(f"clock {ts}", slot, F.col("is_reference"), shifts)
    return gate.watch(both), gate


def strict_traffic(df: DataFrame, agent: str, source: str, spam_sources: tuple[str, ...]) -> tuple[DataFrame, Gate]:
    """Bots and spam marked; spam outside the bots stops the job."""
    out = C.classify_traffic(df, agent, source, spam_sources)[0]
    gate = Gate("traffic", {"bots": F.count_if("is_bot"), "spam": F.count_if("is_spam"), "spam_not_bot": F.count_if(F.col("is_spam") & ~F.col("is_bot"))}, {"spam_not_bot": NONE})
    return gate.watch(out), gate


def strict_pairs(df: DataFrame, key: str, offset: int, name: str, email: str, threshold: float) -> tuple[DataFrame, Gate]:
    """Re-keyed copies; a pair that does not hold stops the job."""
    pairs = match_rekeyed(df, key, offset, name, email, threshold)
    gate = Gate("re-keyed pairs", {"pairs": F.count(F.lit(1)), "failing": F.count_if(~F.coalesce("holds", F.lit(False))), "conflicts": F.count_if("email_conflict")}, {"failing": NONE})
    return gate.watch(pairs), gate


def strict_structure(df: DataFrame, rules: list[tuple[Column, str]], is_data: Column) -> tuple[DataFrame, Gate]:
    """The data rows of a hand-kept sheet; a row that no rule explains stops the job."""
    reason = F.coalesce(*[F.when(c, n) for c, n in rules], F.when(~F.coalesce(is_data, F.lit(False)), F.lit("unexplained")))
    gate = Gate("structural rows", {"data": F.count_if(F.col("__reason").isNull()), "structural": F.count_if(F.col("__reason") != "unexplained"), "unexplained": F.count_if(F.col("__reason") == "unexplained")}, {"unexplained": NONE})
    return gate.watch(df.withColumn("__reason", reason)).filter("__reason IS NULL").drop("__reason"), gate


def strict_steps(fx: DataFrame, listed: float = 1.2, rejected: float = 2.0) -> tuple[DataFrame, Gate]:
    """The large steps of a rate series; one beyond `rejected` stops the job."""
    gate = Gate("rate steps", {"listed": F.count(F.lit(1)), "rejected": F.count_if("is_rejected")}, {"rejected": NONE})
    return gate.watch(rate_steps(fx, listed, rejected)), gate


def strict_validity(joined: DataFrame, row: list[str], version: str) -> tuple[DataFrame, Gate]:
    """Rows joined with the versions in force on their day (left join); a row without one or with several stops the
    job. row: what tells the rows apart."""
    n = F.count(version).over(Window.partitionBy(*row))
    gate = Gate("validity join", {"rows": F.count(F.lit(1)), "without": F.count_if(F.col("__n") == 0), "several": F.count_if(F.col("__n") > 1)}, {"without": NONE, "several": NONE})
    return gate.watch(joined.withColumn("__n", n)).drop("__n"), gate


def strict_bridge(df: DataFrame, column: str, bridge: DataFrame, name: str) -> tuple[DataFrame, Gate]:
    """Raw names with their channel from bridge (spelling, channel); a name that it lacks stops the job."""
    out = df.join(bridge.select(F.col("spelling").alias(column), F.col("channel").alias(name)), column, "left")
    gate = Gate(f"bridge {column}", {"rows": F.count(F.lit(1)), "unbridged": F.count_if(F.col(column).isNotNull() & F.col(name).isNull())}, {"unbridged": NONE})
    return gate.watch(out), gate
