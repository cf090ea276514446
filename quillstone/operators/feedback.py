"""The feedback log: cleaning, figures, and examples to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.ranking import latest

#: Spellings of times in the log, tried in this order.
TIME_FORMS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "dd.MM.yyyy HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd")


def moment(text: Column) -> Column:
    """A time in any of the known spellings, or whole seconds since 1970; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"(?:Z|[+-]00:?00)$", "")
    seconds = F.when(plain.rlike(r"^\d{9,10}$"), F.timestamp_seconds(plain.try_cast("bigint")))
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in TIME_FORMS], seconds)


def cleaned(log: DataFrame) -> DataFrame:
    """One row of each id, the last one taken in, with parsed vector, ids and time; broken ones are null.

    Project names are trimmed and in lower case. Rows with a null id are left out.
    """
    once = latest(log.where("id is not null"), ["id"], "ingested_at")
    vector = F.from_json("query_vector", "array<double>")
    return once.select(
        "id", F.lower(F.trim("project_name")).alias("project"), "query", F.when(F.forall(vector, lambda x: x.isNotNull()) & (F.size(vector) > 0), vector).alias("qvec"),
        F.array_distinct(F.filter(F.from_json("selected_chunk_ids", "array<string>"), lambda x: x.isNotNull())).alias("chunk_ids"), "reward", moment(F.col("timestamp")).alias("moment"),
    )


def figures(log: DataFrame, *keys: str) -> DataFrame:
    """For each key the number of rows, the mean reward (0 without any), and how many were praised and blamed."""
    mean = F.coalesce(F.sum(F.col("reward").cast("decimal(18,2)")).cast("double") / F.count("reward"), F.lit(0.0))
    out = log.groupBy(*keys).agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean_reward"), F.count_if(F.col("reward") > 0).alias("praised"), F.count_if(F.col("reward") < 0).alias("blamed"))
    return out


def last_of(log: DataFrame, keys: list[str], order: Column, count: int) -> DataFrame:
    """The last rows of each key in an order; tasks keep so many of each key before the shuffle."""
    back = Window.partitionBy(*keys).orderBy(order.desc())
    return log.withColumn("back", F.row_number().over(back)).where(F.col("back") <= count)


def examples(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, project, chunk_key, qvec, vec, reward): a row for each chunk that an entry of the log names and that exists.

    Chunk ids name a chunk within the entry's project; where several chunks share
    one, the smallest key counts. Ids that name none are left out.
    """
    named = log.select("id", "project", "qvec", "reward", F.explode("chunk_ids").alias("chunk_id"))
    known = chunks.where("chunk_id is not null").groupBy(F.lower("project").alias("project"), "chunk_id").agg(F.min_by(F.struct("chunk_key", "embedding", "source_file"), "chunk_key").alias("c"))
    return named.join(known, ["project", "chunk_id"]).select("id", "project", "chunk_id", F.col("c.chunk_key").alias("chunk_key"), "qvec", F.col("c.embedding").cast("array<double>").alias("vec"), "reward", F.col("c.source_file").alias("source_file"))
