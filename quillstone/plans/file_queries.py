"""Queries over source trees: classes of files, and what their parsers make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import rules, text
from quillstone.operators import parsers
from quillstone.operators.ranking import latest
from quillstone.plans.catalog import ONCE, query, quoted
from quillstone.plans.text_queries import made_of_chunks
from quillstone.sources import files as source
from quillstone.sources.tables import read_table


def trees(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """One row of each file with these columns, and with its class by its path."""
    return source.classify(latest(read_table(spark, root, "files").select("file_id", "path", "ingested_at", *columns), ["file_id"], "ingested_at"))


_NAME = "list_extract(string_split(path, '/'), -1)"
_EXT = f"lower(regexp_extract({_NAME}, '.(\\.[^.]+)$', 1))"
_VALUES = ", ".join(f"({', '.join(quoted(x) for x in (k, *v))})" for k, v in rules.EXTENSIONS.items())
_NAMES = ", ".join(f"({', '.join(quoted(x) for x in (k, *v))})" for k, v in rules.FILE_NAMES.items())
_CLASSED = (
    f"{ONCE['f']}, e(ext, t, l, p) AS (VALUES {_VALUES}), m(low, t, l, p) AS (VALUES {_NAMES}), b AS (SELECT file_id, path, {_NAME} AS nm, {_EXT} AS ex FROM f),"
    " k AS (SELECT b.file_id, b.path, b.nm, b.ex, coalesce(e.t, m.t, 'code') AS file_type, coalesce(e.l, m.l, nullif(ltrim(b.ex, '.'), ''), 'unknown') AS language, coalesce(e.p, m.p, 'generic_text') AS parser_key"
    " FROM b LEFT JOIN e ON e.ext = b.ex LEFT JOIN m ON m.low = lower(b.nm))"
)


@query(f"WITH {_CLASSED} SELECT file_id, file_type, language, parser_key FROM k")
def classify_files(spark, root):
    return trees(spark, root).select("file_id", "file_type", "language", "parser_key")


_FOLDERS = ", ".join(map(quoted, rules.SKIPPED_FOLDERS))
_SKIP = (
    f"CASE WHEN list_has_any(string_split(path, '/')[:-2], [{_FOLDERS}]) THEN 'folder' WHEN regexp_matches(nm, {quoted(rules.SKIPPED_PATTERN)}) THEN 'pattern'"
    f" WHEN ex IN ({', '.join(map(quoted, rules.SKIPPED_EXTENSIONS))}) THEN 'extension' WHEN lower(nm) IN ({', '.join(map(quoted, rules.SKIPPED_NAMES))}) OR regexp_matches(lower(nm), '^\\.env(?:\\..*)?$') THEN 'name' END"
)


@query(f"WITH {_CLASSED} SELECT {_SKIP} AS reason, file_type, count(*) AS n FROM k GROUP BY ALL")
def skipped_files(spark, root):
    """Files by the reason for which a scan leaves them out, if any, and type."""
    return trees(spark, root).groupBy(source.skipped(F.col("path")).alias("reason"), "file_type").agg(F.count("*").alias("n"))


@query(f"WITH {_CLASSED} SELECT language, count(*) AS n FROM k WHERE {_SKIP} IS NULL GROUP BY language")
def scanned_languages(spark, root):
    kept = trees(spark, root).where(source.skipped(F.col("path")).isNull())
    return kept.groupBy("language").agg(F.count("*").alias("n"))


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all files that a scan takes in, classified, repeated ones included."""
    rows = read_table(spark, root, "files").select("file_id", "path", "length", "ingested_at", "content")
    return source.classify(rows.where(source.skipped(F.col("path")).isNull() & (F.col("length") <= source.MAX_BYTES)))


@query()
def parse_files(spark, root):
    """All chunks of all files that a scan takes in."""
    made = parsers.parse(scanned(spark, root), keep=("ingested_at",))
    narrow = made.select("file_id", "ingested_at", "chunk_id", "chunk_type", "name", "start_line", "end_line", F.length("content").alias("chars"))
    return parsers.newest(narrow, "ingested_at")


@query()
def parse_summary(spark, root):
    """Chunks by language and kind, most first."""
    made = parsers.parse(scanned(spark, root), keep=("ingested_at",)).select("file_id", "ingested_at", "chunk_id", "language", "chunk_type")
    return parsers.newest(made, "ingested_at").groupBy("language", "chunk_type").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


@query(
    f"WITH {ONCE['c']}, s AS (SELECT chunk_key, unnest(regexp_extract_all(content, {quoted(parsers.STATEMENT)})) AS body FROM c WHERE language = 'sql')"
    f" SELECT upper(regexp_extract(trim(body), '^[- \\n]*(\\S+)', 1)) AS verb, count(*) AS n, count(nullif(regexp_extract(body, {quoted(parsers.STATEMENT_NAME)}, 1), '')) AS named FROM s GROUP BY 1"
)
def sql_statements(spark, root):
    found = F.transform(F.regexp_extract_all("content", F.lit(parsers.STATEMENT), F.lit(0)), lambda x: F.struct(F.upper(F.regexp_extract(F.trim(x), r"^[- \n]*(\S+)", 1)).alias("verb"), (F.regexp_extract(x, parsers.STATEMENT_NAME, 1) != "").alias("named")))
    c = made_of_chunks(spark, root, found=F.when(F.col("language") == "sql", found)).select(F.explode("found").alias("s"))
    return c.groupBy(F.col("s.verb").alias("verb")).agg(F.count("*").alias("n"), F.count_if("s.named").alias("named"))


@query(f"WITH {ONCE['c']}, l AS (SELECT chunk_key, regexp_extract_all(content, '(?im)^(FROM|RUN|COPY|ADD|ENV|ARG|WORKDIR|EXPOSE|CMD|ENTRYPOINT|LABEL|VOLUME|USER|HEALTHCHECK|SHELL)\\b') AS x FROM c WHERE file_type = 'infra') SELECT upper(i) AS instruction, count(*) AS n FROM (SELECT unnest(x) AS i FROM l) GROUP BY 1")
def dockerfile_blocks(spark, root):
    names = F.transform(parsers.dockerfile(F.col("content")), lambda p: p["name"])
    made = made_of_chunks(spark, root, names=F.when(F.col("file_type") == "infra", names)).select(F.explode("names").alias("instruction"))
    return made.groupBy("instruction").agg(F.count("*").alias("n"))


@query(f"WITH {ONCE['c']} SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(content)) AS k FROM c WHERE language = 'json' AND chunk_type = 'json_key' AND json_valid(content)) GROUP BY k")
def json_keys(spark, root):
    keys = F.when((F.col("language") == "json") & (F.col("chunk_type") == "json_key"), F.expr("json_object_keys(content)"))
    made = made_of_chunks(spark, root, keys=keys).select(F.explode("keys").alias("key"))
    return made.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT (json_extract_string(props, '$.k'))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def event_props(spark, root):
    e = read_table(spark, root, "events").select(F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {ONCE['c']} SELECT chunk_key, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count, regexp_replace(substring(regexp_replace(regexp_replace(list_extract(string_split(source_file, '/'), -1), '(.)\\.[^.]*$', '\\1'), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), 1, 25), '^$', '') AS stem FROM c WHERE source_file IS NOT NULL")
def chunk_lines(spark, root):
    """Lines of each chunk, and the part of its id that comes from its file's name."""
    stem = F.substring(F.regexp_replace(text.stem(F.col("source_file")), rf"[^{text.WORD}]", "_"), 1, 25)
    count = (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("long")
    c = made_of_chunks(spark, root, line_count=count, stem=stem, named=F.col("source_file").isNotNull())
    return c.where("named").select("chunk_key", "line_count", "stem")


_REPORTED = " AND ".join(f"NOT contains(regexp_extract(path, '^(.*/)?[^/]*$', 1), {quoted(x)})" for x in rules.REPORT_SKIPPED) + " AND (" + " OR ".join(f"ends_with(path, {quoted(x)})" for x in rules.REPORT_ENDINGS) + ")"


@query(f"WITH {ONCE['f']} SELECT file_id, path FROM f WHERE {_REPORTED}")
def report_files(spark, root):
    """The code files that a report on a tree reads."""
    rows = read_table(spark, root, "files").select("file_id", "path", "ingested_at")
    return latest(rows, ["file_id"], "ingested_at").where(source.reported(F.col("path"))).select("file_id", "path")
