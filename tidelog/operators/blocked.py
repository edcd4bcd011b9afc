"""Running values over a whole topic without a task that sorts the topic.

A group's rows fall into blocks of `width` units of their first order column. Windows run within a block; what a block
takes over from those before it comes from a window over one row for each block, so the largest task holds a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import BLOCK

_KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def _blocks(df: DataFrame, order: list[str], width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order[0]) / width))


def _meet(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside what their block takes over; null keys are a group too."""
    keys = [*by, "_block"]
    other = carried.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in carried.columns if c not in keys])
    return rows.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])).drop(*[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, by: list[str], order: list[str], width: int = BLOCK, before: bool = False, **columns: tuple[str, Column]) -> DataFrame:
    """Adds name=(kind, column): the sum, max or min over the group's rows up to each row, or up to the one before it."""
    rows = _blocks(df, order, width)
    totals = rows.groupBy(*by, "_block").agg(*[_KINDS[k][0](c).alias(f"_t_{n}") for n, (k, c) in columns.items()])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_block", *[_KINDS[k][0](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in columns.items()])
    own = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = rows
    for n, (k, c) in columns.items():
        out = out.withColumn(f"_o_{n}", _KINDS[k][0](c).over(own))
    out = _meet(out, carried, by)
    for n, (k, _) in columns.items():
        out = out.withColumn(n, _KINDS[k][1](F.col(f"_c_{n}"), F.col(f"_o_{n}")))
    return out.drop("_block", *[f"_{x}_{n}" for x in "co" for n in columns])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, width: int = BLOCK) -> DataFrame:
    """Adds the place of a row in its group, from 1."""
    return running(df, by, order, width, **{name: ("sum", F.lit(1).cast("long"))})


def beside(df: DataFrame, by: list[str], order: list[str], name: str, value: Column, width: int = BLOCK, following: bool = False) -> DataFrame:
    """Adds the value of the group's row before each (or of the one following), null for the first (or the last)."""
    rows = _blocks(df, order, width)
    place = F.struct(*order)
    ends = rows.groupBy(*by, "_block").agg((F.min_by if following else F.max_by)(F.struct(value.alias("v")), place).alias("_ends"))
    over, step = Window.partitionBy(*by).orderBy("_block"), F.lead if following else F.lag
    carried = ends.select(*by, "_block", step("_ends").over(over).alias("_carried"))
    own = Window.partitionBy(*by, "_block").orderBy(*order)
    out = _meet(rows.withColumn("_own", step(F.struct(value.alias("v"))).over(own)), carried, by)
    return out.withColumn(name, F.coalesce("_own", "_carried")["v"]).drop("_block", "_own", "_carried")
