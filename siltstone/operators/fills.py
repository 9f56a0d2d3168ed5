"""Chains of fills over several tables: blanks that other columns or tables determine, in order, until nothing changes."""

from __future__ import annotations

from collections import UserDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.operators.split import only_values
from siltstone.sources.scratch import new_path

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class FillRule:
    """Blanks of `column` in `table` take the value that `source` gives their `key`. source: from all tables as they stand to
    rows of (key, column); a key with several values determines nothing, null keys and null values count for nothing. reads:
    the columns that a source which does more than hand on a table takes from its tables; by default all of them."""

    name: str
    table: str
    column: str
    key: str
    source: Callable[[Tables], DataFrame]
    reads: tuple[str, ...] | None = None

    def values(self, tables: Tables) -> DataFrame:
        """(__key, __value): the one value of each key that has exactly one."""
        found = self.source(tables).filter(F.col(self.key).isNotNull() & F.col(self.column).isNotNull())
        return only_values(found, self.key, [self.column]).filter(F.col(self.column).isNotNull()).select(F.col(self.key).alias("__key"), F.col(self.column).alias("__value"))


    def inputs(self, tables: Tables) -> set[tuple[str, str | None]]:
        """(table, column) of all that may let the rule fill more once it changes; column None: any of the table."""
        asked = _Asked(tables)
        found = self.source(asked)
        names = asked.names or set(tables)
        handed_on = len(names) == 1 and all(found is tables[t] for t in names)
        columns = (self.key, self.column) if handed_on else self.reads or (None,)
        return {(self.table, self.key)} | {(t, c) for t in names for c in columns}


class _Asked(UserDict):
    """Tables that remember which of them were asked for."""

    def __init__(self, tables: Tables):
        super().__init__(tables)
        self.names: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        self.names.add(name)
        return super().__getitem__(name)


def rule_column(column: str) -> str:
    """Where the name of the rule that filled a cell stands."""
    return f"{column}_rule"


def _filled(tables: Tables, rule: FillRule) -> DataFrame:
    """The rule's table with the blanks that it determines filled; only blanks are joined."""
    df, named = tables[rule.table], rule_column(rule.column)
    blank = F.col(rule.column).isNull()
    told = df.filter(blank).join(rule.values(tables), F.col(rule.key) == F.col("__key"), "left")
    told = told.withColumns({named: F.when(F.col("__value").isNotNull(), F.lit(rule.name)).otherwise(F.col(named)), rule.column: F.col("__value")})
    return df.filter(~blank).unionByName(told.select(df.columns))


def _stored(df: DataFrame, rule: FillRule) -> tuple[DataFrame, int]:
    """The table, stored, and the cells that the rule has filled in it so far, which are counted while it is written."""
    path, seen = new_path(df.sparkSession, "fills"), Observation()
    df.observe(seen, F.count_if(F.col(rule_column(rule.column)) == rule.name).alias("filled")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["filled"]


def fill_chain(tables: Tables, rules: list[FillRule]) -> Tables:
    """The tables with their blanks filled by the rules in order, again and again until a round fills nothing; the column
    `<column>_rule` names the rule of each filled cell.

    After every rule its table is stored in the shared folder, as later rules and rounds read it several times. A round fills
    at least one cell, so there are at most as many as the longest chain of rules; cells never change once they have a value.
    A rule runs again only if something that it reads was filled since it ran, as it would fill nothing otherwise.
    """
    out = dict(tables)
    for rule in rules:
        if rule_column(rule.column) not in out[rule.table].columns:
            out[rule.table] = out[rule.table].withColumn(rule_column(rule.column), F.lit(None).cast("string"))

    changed, ran, filled = {}, {}, {}
    now = 0
    while True:
        began = now
        for i, rule in enumerate(rules):
            inputs = rule.inputs(out)
            if i in ran and not any(at > ran[i] and ((t, c) in inputs or (t, None) in inputs) for (t, c), at in changed.items()):
                continue
            stored, n = _stored(_filled(out, rule), rule)
            first, cells = i not in ran, (rule.table, rule.column, rule.name)
            ran[i] = now
            if n != filled.get(cells, 0):
                now += 1
                filled[cells] = n
                # its name of the rule changes with the cell
                changed |= {(rule.table, c): now for c in (rule.column, rule_column(rule.column))}
            if first or changed.get((rule.table, rule.column), 0) == now > ran[i]:
                out[rule.table] = stored
        if now == began:
            return out


def fill_report(filled: Tables, rules: list[FillRule]) -> DataFrame:
    """(rule, table, column, filled): cells by rule, and what is still blank as rule null."""
    parts = []
    for table, column in dict.fromkeys((r.table, r.column) for r in rules):
        told = filled[table].filter(F.col(rule_column(column)).isNotNull() | F.col(column).isNull())
        parts.append(told.groupBy(F.col(rule_column(column)).alias("rule")).agg(F.count(F.lit(1)).alias("filled")).select("rule", F.lit(table).alias("table"), F.lit(column).alias("column"), "filled"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_agreement(tables: Tables, rules: list[FillRule]) -> DataFrame:
    """(rule, same, different): how often a rule gives the value that a known cell has, on the tables before any fill."""
    parts = []
    for rule in rules:
        both = tables[rule.table].filter(F.col(rule.column).isNotNull()).join(rule.values(tables), F.col(rule.key) == F.col("__key"))
        equal = F.col(rule.column) == F.col("__value")
        parts.append(both.agg(F.lit(rule.name).alias("rule"), F.count_if(equal).alias("same"), F.count_if(~equal).alias("different")))
    return reduce(lambda a, b: a.unionByName(b), parts)
