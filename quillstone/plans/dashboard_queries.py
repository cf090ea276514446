"""Queries of the dashboard: figures of the chunks, questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import scoring, text
from quillstone.operators import analytics, evaluation
from quillstone.plans.catalog import ONCE, query, quoted
from quillstone.plans.text_queries import nlp
from quillstone.sources.tables import read_table

N = ONCE["n"]


@query(
    f"WITH {N} SELECT count(*) AS chunks, count(DISTINCT coalesce(normalized_lang, language, '')) AS languages, count(DISTINCT source_file) AS files, floor(sum(token_count)::DOUBLE / count(*))::BIGINT AS mean_tokens,"
    " sum(coalesce(len(tags), 0))::BIGINT AS tags, floor(count_if(has_docstring) * 100.0::DOUBLE / count(*))::BIGINT AS documented FROM n"
)
def kpi_row(spark, root):
    n = nlp(spark, root)
    return n.agg(
        F.count("*").alias("chunks"), F.countDistinct(F.coalesce("normalized_lang", "language", F.lit(""))).alias("languages"), F.countDistinct("source_file").alias("files"),
        F.floor(F.sum("token_count").cast("double") / F.count("*")).alias("mean_tokens"), F.sum(F.coalesce(F.greatest(F.size("tags"), F.lit(0)), F.lit(0))).alias("tags"), F.floor(F.count_if("has_docstring") * 100.0 / F.count("*")).alias("documented"),
    )


@query(f"WITH {N} SELECT sum(len(entities))::BIGINT AS entities, sum(segment_count)::BIGINT AS segments, count_if(len(embedding) > 0)::BIGINT AS embedded, count_if(is_translated)::BIGINT AS translated, count(*) AS chunks FROM n")
def pipeline_summary(spark, root):
    n = nlp(spark, root)
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return n.agg(F.sum(size("entities")).alias("entities"), F.sum("segment_count").alias("segments"), F.count_if(F.size("embedding") > 0).alias("embedded"), F.count_if("is_translated").alias("translated"), F.count("*").alias("chunks"))


@query(f"WITH {N} SELECT chunk_type, count(*) AS n FROM n GROUP BY 1 ORDER BY n DESC, chunk_type LIMIT 15")
def type_counts(spark, root):
    return analytics.counts(nlp(spark, root), F.col("chunk_type"), "chunk_type", 15)


@query(f"WITH {N} SELECT coalesce(nullif(normalized_lang, ''), language) AS lang, count(*) AS n FROM n GROUP BY 1")
def lang_counts(spark, root):
    return analytics.counts(nlp(spark, root), F.coalesce(F.nullif("normalized_lang", F.lit("")), F.col("language")), "lang")


@query(f"WITH {N} SELECT file_type, count(*) AS n FROM n GROUP BY 1")
def file_type_counts(spark, root):
    return analytics.counts(nlp(spark, root), F.col("file_type"), "file_type")


@query(
    f"WITH {N}, k AS (SELECT token_count::DOUBLE AS v FROM n WHERE token_count > 0), s AS (SELECT min(v) AS lo, greatest((max(v) - min(v)) / 50, 1e-9::DOUBLE) AS w FROM k)"
    " SELECT least(floor((v - lo) / w), 49)::INTEGER AS bin, round(min(lo) + least(floor((v - lo) / w), 49)::INTEGER * min(w), 4) AS low, count(*) AS n FROM k, s GROUP BY bin, lo, w, v > v, least(floor((v - lo) / w), 49)"
)
def token_hist(spark, root):
    kept = nlp(spark, root).where("token_count > 0")
    return analytics.histogram(kept, F.col("token_count")).select("bin", F.round("low", 4).alias("low"), "n")


@query(
    f"WITH {N}, top AS (SELECT chunk_type FROM n GROUP BY 1 ORDER BY count(*) DESC, chunk_type LIMIT 8) SELECT chunk_type, min(token_count) AS least, quantile_cont(token_count, 0.25)::DOUBLE AS q1, quantile_cont(token_count, 0.5)::DOUBLE AS median,"
    " quantile_cont(token_count, 0.75)::DOUBLE AS q3, max(token_count) AS greatest, count(*) AS n FROM n WHERE chunk_type IN (FROM top) AND token_count IS NOT NULL GROUP BY chunk_type"
)
def token_quartiles(spark, root):
    kept = analytics.most_frequent_kinds(nlp(spark, root).select("chunk_type", "token_count"), "chunk_type", 8)
    return analytics.quartiles(kept, "chunk_type", "token_count")


@query(f"WITH {N} SELECT file_id, round(count_if(coalesce(docstring, '') <> '') * 100.0::DOUBLE / count(*), 1) AS percent, count(*) AS n FROM n GROUP BY file_id ORDER BY percent DESC, file_id LIMIT 20")
def doc_coverage(spark, root):
    return analytics.share_of(nlp(spark, root), "file_id", F.coalesce("docstring", F.lit("")) != "", 20)


_SEARCHED = ["content", "name", "docstring", "source_file", "language", "chunk_type", "parent", "return_type"]


@query(f"WITH {N} SELECT chunk_key FROM n WHERE " + " OR ".join(f"coalesce(regexp_matches({c}::VARCHAR, '(?i)retry|cursor_[0-9]+'), false)" for c in _SEARCHED))
def free_text_search(spark, root):
    return analytics.matching(nlp(spark, root), r"retry|cursor_[0-9]+", _SEARCHED).select("chunk_key")


@query(f"WITH {N}, top AS (SELECT chunk_type FROM n GROUP BY 1 ORDER BY count(*) DESC, chunk_type LIMIT 8) SELECT project, count(*) AS n FROM n WHERE chunk_type IN (FROM top) GROUP BY project")
def top_types_semi(spark, root):
    return analytics.most_frequent_kinds(nlp(spark, root).select("project", "chunk_type"), "chunk_type", 8).groupBy("project").agg(F.count("*").alias("n"))


@query("SELECT project, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM projects p WHERE p.project = d.project AND p.team IS NOT NULL) GROUP BY project")
def unowned_documents(spark, root):
    """Documents of no project, or of one without a team: an anti join."""
    owned = read_table(spark, root, "projects").where("team is not null").select("project")
    return read_table(spark, root, "documents").select("project").join(owned, "project", "left_anti").groupBy("project").agg(F.count("*").alias("n"))


@query(f"WITH {N} SELECT chunk_key, coalesce(len(parameters), 0)::INTEGER AS parameters, lower(has_tests::VARCHAR) IN ('true', '1', 'yes') AS tests, coalesce(TRY_CAST(map_extract_value(extra, 'count') AS DOUBLE), 0.0) AS number, coalesce(source_file, '') AS source_file, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS preview FROM n")
def metadata_rows(spark, root):
    """The flat metadata of each chunk: sizes, flags and numbers from text, no nulls, a preview."""
    n = nlp(spark, root)
    return n.select(
        "chunk_key", F.coalesce(F.greatest(F.size("parameters"), F.lit(0)), F.lit(0)).alias("parameters"), text.truth(F.col("has_tests")).alias("tests"), text.number(F.try_element_at("extra", F.lit("count"))).alias("number"),
        F.coalesce("source_file", F.lit("")).alias("source_file"), text.preview(F.col("content"), 200).alias("preview"),
    )


_ROLE = (
    "CASE WHEN coalesce(role, '') = '' THEN 'user' WHEN contains(lower(trim(role)), 'developer') OR contains(lower(trim(role)), 'engineer') THEN 'developer' WHEN contains(lower(trim(role)), 'manager') THEN 'project manager'"
    " WHEN contains(lower(trim(role)), 'data scien') OR contains(lower(trim(role)), 'ml') THEN 'data scientist' ELSE lower(trim(role)) END"
)


@query(f"SELECT {_ROLE} AS role, suite, count(*) AS n FROM questions GROUP BY ALL")
def question_roles(spark, root):
    return read_table(spark, root, "questions").groupBy(evaluation.role(F.col("role")).alias("role"), "suite").agg(F.count("*").alias("n"))


_STOP = "[" + ", ".join(map(quoted, scoring.STOP_WORDS)) + "]"
_SET = "list_distinct(list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z_][\\p{{L}}\\p{{N}}_]*'), lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains(" + _STOP.replace("{", "{{") + ", w)))"


@query(f"WITH s AS (SELECT item_id, {_SET.format(c='reference_answer')} AS a, {_SET.format(c='question')} AS c FROM questions) SELECT item_id, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, c))::DOUBLE / len(a), 6) ELSE 0.0 END AS overlap FROM s")
def eval_overlap(spark, root):
    """The share of an answer's words that its question has."""
    q = read_table(spark, root, "questions")
    return q.select("item_id", F.round(scoring.overlap(F.col("reference_answer"), F.col("question")), 6).alias("overlap"))


@query(
    f"WITH s AS (SELECT item_id, {_SET.format(c='question')} AS c, list_slice(list_filter(regexp_split_to_array(reference_answer, '\\s+'), lambda w: w <> ''), 1, 120) AS w FROM questions)"
    " SELECT item_id, len(w)::INTEGER AS words, len(list_filter(w, lambda x: list_contains(c, lower(regexp_replace(x, '[^\\p{L}\\p{N}_]', '', 'g')))))::INTEGER AS grounded FROM s"
)
def grounded_tokens(spark, root):
    q = read_table(spark, root, "questions").select("item_id", scoring.grounded(F.col("reference_answer"), F.col("question")).alias("g"))
    return q.select("item_id", F.size("g").alias("words"), F.size(F.filter("g", lambda x: x["matched"])).alias("grounded"))


@query(
    f"WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) AS w FROM questions), k AS (SELECT CASE WHEN regexp_full_match(w, '[A-Za-z_][\\p{{L}}\\p{{N}}_]*') THEN CASE WHEN list_contains({_STOP}, lower(w)) THEN 'stop' ELSE 'word' END"
    " WHEN regexp_full_match(w, '[0-9]+(?:\\.[0-9]+)?') THEN 'num' ELSE 'punct' END AS kind FROM w) SELECT kind, count(*) AS n FROM k GROUP BY kind"
)
def query_token_kinds(spark, root):
    q = read_table(spark, root, "questions").select(F.explode(scoring.query_tokens(F.col("question"))).alias("t"))
    return q.groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {N} SELECT project, chunk_type, count(*) AS n, max(token_count) AS most_tokens FROM n GROUP BY ALL ORDER BY n DESC, project, chunk_type LIMIT 20 OFFSET 10")
def paged_types(spark, root):
    """The second page of a table: rows 11 to 30 by size."""
    per = nlp(spark, root).groupBy("project", "chunk_type").agg(F.count("*").alias("n"), F.max("token_count").alias("most_tokens"))
    return per.orderBy(F.desc("n"), "project", "chunk_type").offset(10).limit(20)


@query(f"WITH {N} SELECT sha256(content) AS digest, count(*) AS n FROM n GROUP BY 1 HAVING count(*) > 1")
def equal_contents(spark, root):
    return nlp(spark, root).groupBy(F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT source, lang, doc_id FROM documents UNION ALL SELECT suite, role, item_id FROM questions")
def union_rows(spark, root):
    d = read_table(spark, root, "documents").select("source", "lang", "doc_id")
    q = read_table(spark, root, "questions").select(F.col("suite").alias("source"), F.col("role").alias("lang"), F.col("item_id").alias("doc_id"))
    return d.unionByName(q)
