"""Keeping one row of each key, and numbering and summing along long groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row of each key, that of the greatest ``by``; of equal ones that of the greatest hash of its columns.

    An aggregation, so that repeated rows of a hot key are merged before the
    shuffle. Null keys are a key of their own; rows with a null ``by`` yield to others.
    The rows travel whole: for wide ones there is ``latest_wide``.
    """
    rest = [c for c in df.columns if c not in keys]
    plain = [c for c, kind in df.dtypes if c in rest and "map<" not in kind]
    order = F.struct(F.coalesce(F.col(by).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")), F.xxhash64(*plain))
    best = F.max_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def latest_wide(df: DataFrame, keys: list[str], by: str, most: int = 200_000) -> DataFrame:
    """What ``latest`` gives, for rows too wide to be shuffled.

    The keys that come more than once are counted first, on the key columns alone.
    If there are ``most`` of them at most, they travel to the tasks: rows of all
    other keys stay where they are, and only those of these keys are shuffled. If
    there are more, all rows are.
    """
    again = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*[F.col(k).alias(f"__again_{k}") for k in keys])
    if again.limit(most + 1).count() > most:
        return latest(df, keys, by)
    few = F.broadcast(again)  # ``most`` keys at most, as counted
    same = [df[k].eqNullSafe(F.col(f"__again_{k}")) for k in keys]
    return df.join(few, same, "left_anti").unionByName(latest(df.join(few, same, "left_semi"), keys, by))


def _bucketed(df: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    return df.withColumn("__bucket", F.floor(F.col(order) / width).cast("long"))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, width: int = 100_000) -> DataFrame:
    """The rows with their number, from 1, among the rows of equal keys in the order of a whole-number column.

    A group is cut into buckets of ``width`` consecutive order values, each of
    which is numbered by a task of its own; the counts of the buckets before are
    added. A group of any size is thus spread. Order values are taken as unique
    within a group; equal ones get consecutive numbers in any order.
    """
    cut = _bucketed(df, keys, order, width)
    counts = cut.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order)
    placed = cut.withColumn("__k", F.row_number().over(inside))
    named = offsets.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__bucket").alias("__ob"), "__before")
    joined = placed.alias("p").join(named, [placed[k].eqNullSafe(F.col(f"__o_{k}")) for k in keys] + [placed["__bucket"].eqNullSafe(F.col("__ob"))])
    return joined.withColumn(name, (F.col("__k") + F.col("__before")).cast("long")).select(*[F.col(f"p.{c}") for c in df.columns], name)


def running_mean(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 100_000) -> DataFrame:
    """The rows with the mean of a value over the rows of equal keys up to each, in order; null values don't count.

    Sums run within buckets of order values; the totals of the buckets before are added.
    """
    cut = _bucketed(df.withColumn("__v", value.cast("decimal(38,6)")), keys, order, width)
    totals = cut.groupBy(*keys, "__bucket").agg(F.sum("__v").alias("__s"), F.count("__v").alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__o_{k}") for k in keys],
        F.col("__bucket").alias("__ob"),
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"),
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"),
    )
    run = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumn("__rs", F.coalesce(F.sum("__v").over(run), F.lit(0))).withColumn("__rc", F.count("__v").over(run))
    joined = placed.alias("p").join(offsets, [placed[k].eqNullSafe(F.col(f"__o_{k}")) for k in keys] + [placed["__bucket"].eqNullSafe(F.col("__ob"))])
    n = F.col("__rc") + F.col("__c0")
    mean = F.when(n > 0, (F.col("__rs") + F.col("__s0")).cast("double") / n)
    return joined.withColumn(name, mean).select(*[F.col(f"p.{c}") for c in df.columns], name)


def top(df: DataFrame, count: int, *order: Column | str) -> DataFrame:
    """The first rows by an order, which should end in a key; each task keeps its own first ones."""
    return df.orderBy(*order).limit(count)
