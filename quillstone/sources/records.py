"""Readers and writers of chunks, collections and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "array<struct<text:string,label:string,start:int,end:int,score:double>>"
CHUNK = (
    "chunk_id string, content string, chunk_type string, file_type string, language string, source_file string, start_line int, end_line int, name string, docstring string,"
    " parameters array<string>, return_type string, parent string, imports array<string>, extra map<string,string>"
)
ENRICHED = CHUNK + (
    ", cleaned_text string, tokens array<string>, token_count int, normalized_lang string, entities " + ENTITY + ","
    " semantic_segments array<struct<text:string,start_char:int,end_char:int,segment_id:string>>, segment_count int, tags array<string>, complexity_score double, has_docstring boolean,"
    " has_tests boolean, has_todos boolean, api_surface array<string>, embedding array<float>, embedding_model string, embedding_dim int, detected_lang string, detected_lang_conf double,"
    " translated_text string, is_translated boolean"
)


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """Chunks from a JSON array or, by the suffix, from one object a line; keys without a column are dropped, blank lines skipped."""
    lines = path.rstrip("/").endswith(".jsonl")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_chunks(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Chunks as Parquet, or as one JSON object a line."""
    df.write.mode("overwrite").format("json" if form in ("json", "jsonl") else form).save(path)


def write_collection(df: DataFrame, path: str) -> None:
    """A vector collection, one folder a project, so that a search in one project reads that folder alone."""
    df.repartition("project", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("project").parquet(path)


def projects_of(spark: SparkSession, path: str) -> DataFrame:
    """The projects of a collection, in order."""
    return spark.read.parquet(path).select("project").distinct().orderBy("project")


def default_project(spark: SparkSession, path: str) -> str:
    """The project of a collection that is taken where none is named: the first in order."""
    first = projects_of(spark, path).limit(1).collect()
    if not first:
        raise ValueError(f"no collection in {path}")
    return first[0].project


def append_feedback(df: DataFrame, path: str) -> None:
    """Appends feedback rows; vectors and ids travel as JSON text."""
    rows = df.select("*")
    for c, kind in df.dtypes:
        if c in ("query_vector", "selected_chunk_ids") and kind.startswith("array"):
            rows = rows.withColumn(c, F.to_json(c))
    rows.write.mode("append").parquet(path)


def with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of both tables; a column that one lacks is null there."""
    return df.unionByName(other, allowMissingColumns=True)


def indexable(df: DataFrame, length: int | None = None) -> DataFrame:
    """Rows with text and a vector, of one length if it is given."""
    kept = df.where((F.trim(F.coalesce("cleaned_text", "content")) != "") & (F.size("embedding") > 0))
    return kept if length is None else kept.where(F.size("embedding") == length)
