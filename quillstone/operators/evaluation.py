"""Questions, answers and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import basename


def role(c: Column) -> Column:
    """The usual name of a role by the words in it; user for none."""
    low = F.lower(F.trim(c))

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return hit

    return (
        F.when(F.coalesce(c, F.lit("")) == "", "user")
        .when(has("developer", "engineer"), "developer")
        .when(has("manager"), "project manager")
        .when(has("data scientist", "data science", "ml"), "data scientist")
        .otherwise(low)
    )


def contexts(hits: DataFrame, query: str = "qid", order: str = "rank") -> DataFrame:
    """(qid, context, sources, source_count): the texts of each query's hits under their file names in rank order.

    Hits have query, order, source_file and content; a query has a few of them.
    """
    entry = F.struct(F.col(order).alias("r"), F.col("source_file").alias("f"), F.col("content").alias("c"))
    listed = hits.groupBy(query).agg(F.array_sort(F.collect_list(entry)).alias("h"))
    text = F.array_join(F.transform("h", lambda h, i: F.concat(F.lit("--- SOURCE "), (i + 1).cast("string"), F.lit(": "), F.coalesce(h["f"], F.lit("")), F.lit(" ---\n"), F.coalesce(h["c"], F.lit("")))), "\n\n")
    names = F.array_sort(F.array_distinct(F.transform("h", lambda h: basename(h["f"]))))
    return listed.select(query, text.alias("context"), F.array_join(names, ", ").alias("sources"), F.size("h").cast("long").alias("source_count"))


def summary(results: DataFrame) -> DataFrame:
    """One row: questions, how many had a source, the mean number of sources, distinct files, and whether all had one."""
    files = results.select(F.explode_outer(F.split("sources", ",")).alias("f")).select(F.trim("f").alias("f")).where("f <> ''").agg(F.countDistinct("f").alias("files"))
    mean = F.round(F.sum("source_count").cast("double") / F.count("*"), 1)
    whole = results.agg(F.count("*").alias("questions"), F.count_if(F.col("source_count") > 0).alias("sourced"), mean.alias("mean_sources"), (F.min("source_count") > 0).alias("passed"))
    return whole.crossJoin(F.broadcast(files))
