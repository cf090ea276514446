"""Source trees: scanning, choosing, classifying and decoding files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.rules import EXTENSIONS, FILE_NAMES, REPORT_CHARS, REPORT_ENDINGS, REPORT_SKIPPED, SKIPPED_EXTENSIONS, SKIPPED_FOLDERS, SKIPPED_NAMES, SKIPPED_PATTERN
from quillstone.functions.text import basename

MAX_BYTES = 500 * 1024


def scan_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, modified_at, content) of the regular files below a folder; longer files are left out before they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(F.col("length") <= max_bytes).select("path", "length", F.col("modificationTime").alias("modified_at"), "content")


def extension(name: Column) -> Column:
    """The last extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def skipped(path: Column) -> Column:
    """Why a file with this relative path isn't read: folder, pattern, extension or name; null if it is."""
    name = basename(path)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))), "folder")
        .when(name.rlike(SKIPPED_PATTERN), "pattern")
        .when(extension(name).isin(*SKIPPED_EXTENSIONS), "extension")
        .when(F.lower(name).isin(*SKIPPED_NAMES) | F.lower(name).rlike(r"^\.env(?:\..*)?$"), "name")
    )


def registry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The file kinds by extension and by name, as small tables of fixed size."""
    cols = "file_type string, language string, parser_key string"
    by_ext = spark.createDataFrame([(k, *v) for k, v in EXTENSIONS.items()], f"ext string, {cols}")
    by_name = spark.createDataFrame([(k, *v) for k, v in FILE_NAMES.items()], f"low string, {cols}")
    return by_ext, by_name


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows with ext, name, file_type, language and parser_key by their path.

    The extension wins over the name; what is in neither table is code of the
    language of its extension. Columns of these names in the input are replaced.
    Rows with a null path get null kinds.
    """
    made = ["ext", "name", "file_type", "language", "parser_key"]
    by_ext, by_name = registry(files.sparkSession)
    plain = files.drop(*made).withColumn("name", basename(F.col(path))).withColumn("ext", extension(F.col("name"))).withColumn("__low", F.lower("name"))
    kinds = ["file_type", "language", "parser_key"]
    e = F.broadcast(by_ext.select(F.col("ext"), *[F.col(k).alias(f"__e_{k}") for k in kinds]))
    n = F.broadcast(by_name.select(F.col("low").alias("__low"), *[F.col(k).alias(f"__n_{k}") for k in kinds]))
    bare = F.regexp_replace("ext", r"^\.", "")
    default = {"file_type": F.lit("code"), "language": F.when(bare == "", "unknown").otherwise(bare), "parser_key": F.lit("generic_text")}
    joined = plain.join(e, "ext", "left").join(n, "__low", "left")
    known = F.col(path).isNotNull()
    chosen = [F.when(known, F.coalesce(f"__e_{k}", f"__n_{k}", default[k])).alias(k) for k in kinds]
    rest = [c for c in plain.columns if c not in ("__low",)]
    return joined.select(*rest, *chosen)


def is_binary(content: Column) -> Column:
    """Whether a NUL byte stands in the first 8,000 bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 8000)) > 0


def decoded(content: Column) -> Column:
    """UTF-8 text with what is invalid replaced and without a byte-order mark; null for binary content."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(~is_binary(content), F.regexp_replace(text, r"\A\x{feff}", ""))


def reported(path: Column) -> Column:
    """Whether a report on a tree takes a file: by its ending, unless the name of a skipped folder stands anywhere in its folder's path."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    skipped_, taken = F.lit(False), F.lit(False)
    for mark in REPORT_SKIPPED:
        skipped_ = skipped_ | folder.contains(mark)
    for ending in REPORT_ENDINGS:
        taken = taken | path.endswith(ending)
    return F.coalesce(taken & ~skipped_, F.lit(False))


def report_files(files: DataFrame, path: str = "path") -> DataFrame:
    """The code files that a report reads, with the first ``REPORT_CHARS`` characters of their text; invalid bytes are left out."""
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.where(reported(F.col(path))).withColumn("head", F.substring(text, 1, REPORT_CHARS)).drop("content")
