"""The feedback log as a stream: running figures of each project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.shared import fresh_folder


def figures(stream: DataFrame) -> DataFrame:
    """(project, n, reward_sum, rewarded, praised, blamed): running figures of a stream of log entries.

    Entries of equal id count once, however late or out of order they come; the
    state holds each id. Null ids are left out; null rewards count as entries
    without a reward.
    """
    once = stream.where("id is not null").dropDuplicates(["id"])
    return once.groupBy(F.lower(F.trim("project_name")).alias("project")).agg(
        F.count("*").alias("n"), F.sum(F.col("reward").cast("decimal(18,2)")).alias("reward_sum"), F.count("reward").alias("rewarded"), F.count_if(F.col("reward") > 0).alias("praised"), F.count_if(F.col("reward") < 0).alias("blamed")
    )


def follow(spark: SparkSession, path: str, files_at_once: int = 4) -> DataFrame:
    """The figures after all entries that are there now have been streamed, some files at a time.

    Each batch writes the whole table of figures, one row a project, to a folder of
    its own below the shared one, so that a batch that is run again after a failure
    replaces its own rows only. The last batch's table is the result.
    """
    schema = spark.read.parquet(path).schema
    folder = fresh_folder(spark, "feedback")
    # as a pattern, the path may be a folder or a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")
    batches: list[int] = []

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{batch}")
        batches.append(batch)

    running = figures(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    running.awaitTermination()
    if not batches:
        return figures(spark.read.parquet(path).limit(0))
    found = spark.read.parquet(f"{folder}/{max(batches)}")
    mean = F.coalesce(F.col("reward_sum").cast("double") / F.nullif("rewarded", F.lit(0)), F.lit(0.0))
    return found.select("project", "n", F.round(mean, 6).alias("mean_reward"), "praised", "blamed")
