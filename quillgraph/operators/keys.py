"""The ids an operation touches, as a filter that a table's scan can use, and as a side of a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut

#: Ids that a filter spells out; beyond that they are held by ranges, one for each of their beginnings.
FEW = 1000
RANGES = 32
#: Ids that are broadcast; more are left to Spark's choice.
MOST = 1 << 21


class Keys:
    """Distinct ids (the first column of ``ids``) in a table of their own. ``near`` is true for all of them, and for little else:
    files and row groups without such a value aren't read, and rows without one aren't looked up."""

    def __init__(self, ids: DataFrame):
        self.ids = cut(ids.select(F.col(ids.columns[0]).alias("_key")).filter("_key is not null").distinct())
        sums = F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")
        head = F.substring("_key", 1, 2)
        groups = self.ids.groupBy(head.alias("h")).agg(*sums).limit(RANGES + 1).collect()
        if len(groups) > RANGES:
            groups = self.ids.groupBy(F.lit(None).cast("string").alias("h")).agg(*sums).collect()
        self.count = sum(r.n for r in groups)
        listed, self.listed, self.ranges = [], [], []
        for r in sorted(groups, key=lambda r: r.n):
            if r.n + sum(x.n for x in listed) <= FEW:
                listed.append(r)
            else:
                self.ranges.append((r.lo, r.hi))
        if listed:  # FEW ids at most
            mine = self.ids if not self.ranges else self.ids.filter(head.isin([r.h for r in listed]))
            self.listed = [r[0] for r in mine.collect()]

    def near(self, col: str) -> Column:
        c = F.col(col)
        found = [c.between(lo, hi) for lo, hi in self.ranges] + ([c.isin(self.listed)] if self.listed else [])
        return reduce(lambda a, b: a | b, found) if found else F.lit(False)

    def _met(self, col: str, other: DataFrame, where: Column | None = None) -> tuple[DataFrame, Column]:
        """The side to join and the condition. A broadcast side is asked for what is near alone: a null key isn't looked up.
        In a shuffle null keys would meet in one task, so there every row has its own."""
        if self.count > MOST:
            return other, (F.col(col) == F.col("_key")) & (F.lit(True) if where is None else where)
        near = self.near(col) if where is None else where & self.near(col)
        return F.broadcast(other), F.when(near, F.col(col)) == F.col("_key")

    def only(self, df: DataFrame, col: str) -> DataFrame:
        """Rows whose ``col`` is one of the ids."""
        some = df.filter(self.near(col))
        if not self.ranges:
            return some
        ids = F.broadcast(self.ids) if self.count <= MOST else self.ids
        return some.join(ids, F.col(col) == F.col("_key"), "left_semi")

    def without(self, df: DataFrame, col: str) -> DataFrame:
        """Rows whose ``col`` is none of the ids."""
        if not self.ranges:
            return df.filter(~F.coalesce(self.near(col), F.lit(False)))
        return df.join(*self._met(col, self.ids), "left_anti")

    def mark(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """All rows, and whether ``col`` is one of the ids."""
        if not self.ranges:
            return df.withColumn(name, F.coalesce(self.near(col), F.lit(False)))
        out = df.join(*self._met(col, self.ids), "left")
        return out.withColumn(name, F.col("_key").isNotNull()).drop("_key")

    def add(self, df: DataFrame, col: str, other: DataFrame, where: Column | None = None) -> DataFrame:
        """All rows with the columns of ``other``, whose first is the ids, once each; where ``where`` doesn't hold, nulls."""
        first, *names = other.columns
        return df.join(*self._met(col, other.select(F.col(first).alias("_key"), *names), where), "left").drop("_key")


def keys(ids: DataFrame | Keys) -> Keys:
    return ids if isinstance(ids, Keys) else Keys(ids)
