"""Figures of a collection of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, key: Column, name: str, most: int | None = None) -> DataFrame:
    """(name, n): rows for each value, most first, ties by name; null is a value."""
    found = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    return found if most is None else found.orderBy(F.desc("n"), F.asc_nulls_last(name)).limit(most)


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): equal bins from the least to the greatest value; empty bins are left out.

    The range is a single row that is joined to the values; without values there are no bins.
    """
    kept = df.select(value.cast("double").alias("v")).where("v is not null")
    span = kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-9))
    placed = kept.crossJoin(F.broadcast(span)).select(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"), "lo", width.alias("w"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("w").alias("w")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, q1, median, q3, greatest, n) of a value for each key, exactly.

    Values are counted first, so that a hot key shuffles its distinct values only.
    """
    weights = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("w"))
    q = F.expr("percentile(v, array(0.25, 0.5, 0.75), w)")
    return weights.groupBy(key).agg(F.min("v").alias("least"), F.max("v").alias("greatest"), q.alias("q"), F.sum("w").alias("n")).select(key, "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "greatest", "n")


def matching(df: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """The rows in which any of the columns, as text, matches a pattern in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").rlike(f"(?i){pattern}"), F.lit(False))
    return df.where(hit)


def share_of(df: DataFrame, key: str, flag: Column, most: int) -> DataFrame:
    """(key, percent, n): the keys with the greatest share of rows with a flag, in percent to one place, ties by key."""
    per = df.groupBy(key).agg(F.round(F.count_if(flag) * 100.0 / F.count("*"), 1).alias("percent"), F.count("*").alias("n"))
    return per.orderBy(F.desc("percent"), key).limit(most)


def most_frequent_kinds(df: DataFrame, column: str, most: int) -> DataFrame:
    """The rows whose value is one of the most frequent ones."""
    kept = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)
    return df.join(F.broadcast(kept.select(column)), column, "left_semi")  # at most ``most`` values


def first_of(df: DataFrame, keys: list[str], order: Column, count: int) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("k") <= count)
