"""Queries over the vector collection: ids, search, re-ranking, term vectors and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import analytics, evaluation, feedback, vectors
from quillstone.operators.ranking import numbered
from quillstone.plans.catalog import ONCE, query
from quillstone.plans.text_queries import chunks, nlp
from quillstone.sources.records import indexable
from quillstone.sources.tables import read_table

DIMENSION = 64
#: The log doesn't name the model of its query vectors; only vectors of this one are compared with them.
MODEL = "mini-64"


@query(
    f"WITH {ONCE['c']}, a AS (SELECT chunk_key, project, chunk_id, row_number() OVER (PARTITION BY project, chunk_id ORDER BY chunk_key) AS k FROM c),"
    " b AS (SELECT chunk_key, project, CASE WHEN k > 1 THEN chunk_id || '_' || k ELSE chunk_id END AS id FROM a),"
    " d AS (SELECT chunk_key, project, id, row_number() OVER (PARTITION BY project, id ORDER BY chunk_key) AS k FROM b) SELECT chunk_key, CASE WHEN k > 1 THEN id || '_' || k ELSE id END AS id FROM d"
)
def id_dedup(spark, root):
    """Chunk ids made unique within a project: the n-th of equal ids gets ``_n``, and once more for ids that then meet."""
    out = chunks(spark, root, "project", "chunk_id").select("chunk_key", "project", F.col("chunk_id").alias("id"))
    for _ in range(2):
        out = numbered(out, ["project", "id"], "chunk_key", "k").select("chunk_key", "project", F.when(F.col("k") > 1, F.concat_ws("_", "id", F.col("k").cast("string"))).otherwise(F.col("id")).alias("id"))
    return out.select("chunk_key", "id")


@query(f"WITH {ONCE['c']} SELECT project, count(*) AS ids, sum(n)::BIGINT AS chunks FROM (SELECT project, chunk_id, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY project")
def duplicate_ids(spark, root):
    twice = chunks(spark, root, "project", "chunk_id").groupBy("project", "chunk_id").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("project").agg(F.count("*").alias("ids"), F.sum("n").alias("chunks"))


@query(f"WITH {ONCE['n']} SELECT embedding_model, len(embedding)::INTEGER AS dim, count(*) AS n FROM n WHERE trim(coalesce(cleaned_text, content)) <> '' AND len(embedding) > 0 GROUP BY ALL")
def indexable_rows(spark, root):
    return indexable(nlp(spark, root)).groupBy("embedding_model", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def embedding_norms(spark, root):
    return read_table(spark, root, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


@query(
    "WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT qid, e.vec_id AS id, 1 - list_cosine_similarity(v, e.embedding::DOUBLE[]) AS distance FROM q, embeddings e WHERE e.vec_id <> qid)"
    " SELECT qid, id, round(distance, 5) AS distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INTEGER AS rank FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 10"
)
def knn_cosine_top10(spark, root):
    """The ten nearest other vectors of every vector whose id is divisible by 20, exactly."""
    e = read_table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    asked = e.where("id % 20 = 0").select(F.col("id").alias("qid"), "vec")
    found = vectors.search(e, asked, 11).where("id <> qid")
    return analytics.first_of(found.drop("rank"), ["qid"], F.struct("distance", "id"), 10).select("qid", "id", F.round("distance", 5).alias("distance"), F.col("k").alias("rank"))


def log(spark: SparkSession, root: str) -> DataFrame:
    return feedback.cleaned(read_table(spark, root, "experiences"))


def collection(spark: SparkSession, root: str) -> DataFrame:
    n = indexable(nlp(spark, root), DIMENSION).where(F.col("embedding_model") == MODEL)
    return n.select(F.col("chunk_key").alias("id"), F.lower("project").alias("project"), F.col("embedding").alias("vec"), "source_file", "content")


def hits(spark: SparkSession, root: str, k: int) -> DataFrame:
    """For each query of the log whose id is divisible by 20 the nearest chunks of its project."""
    asked = log(spark, root).where("id % 20 = 0 and qvec is not null").select(F.col("id").alias("qid"), "project", F.col("qvec").alias("vec"))
    return vectors.search(collection(spark, root), asked, k, group="project")


_LOG = (
    "x AS (SELECT * FROM experiences WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),"
    " g AS (SELECT id, lower(trim(project_name)) AS project, reward, query, CASE WHEN json_valid(selected_chunk_ids) THEN list_distinct(list_filter(json_extract_string(selected_chunk_ids, '$[*]'), lambda v: v IS NOT NULL)) END AS ids FROM x)"
)
_ASKED = (
    "x AS (SELECT * FROM experiences WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),"
    " a AS (SELECT id AS qid, lower(trim(project_name)) AS project, CASE WHEN json_valid(query_vector) THEN TRY_CAST(query_vector AS DOUBLE[]) END AS v FROM x WHERE id % 20 = 0)"
)
_HITS = (
    f"{_ASKED}, {ONCE['n']}, i AS (SELECT chunk_key AS id, lower(project) AS project, embedding::DOUBLE[] AS e, source_file, content FROM n WHERE embedding_model = '{MODEL}' AND len(embedding) = {DIMENSION} AND trim(coalesce(cleaned_text, content)) <> ''"
    " AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),"
    f" h AS (SELECT qid, id, 1 - list_cosine_similarity(v, e) AS distance, source_file, content FROM a JOIN i USING (project) WHERE len(v) = {DIMENSION} AND len(list_filter(v, lambda y: y IS NULL)) = 0 AND len(list_filter(v, lambda y: y <> 0)) > 0),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INTEGER AS rank FROM h QUALIFY rank <= 3)"
)


@query(f"WITH {_HITS} SELECT qid, id, round(distance, 5) AS distance, rank FROM k")
def retrieve_top3(spark, root):
    return hits(spark, root, 3).withColumn("distance", F.round("distance", 5))


def candidate_pairs(spark: SparkSession, root: str) -> DataFrame:
    asked = log(spark, root).where("qvec is not null").select(F.col("id").alias("qid"), "qvec")
    own = collection(spark, root).select("id", F.col("vec").cast("array<double>").alias("vec"))
    return hits(spark, root, 10).join(asked, "qid").join(own, "id")


@query()
def rerank_top3(spark, root):
    """The three of ten candidates that a network, fitted to the whole log, scores best."""
    net, _ = vectors.train(feedback.examples(log(spark, root), nlp(spark, root)), 2 * DIMENSION)
    return vectors.rerank(vectors.scores(candidate_pairs(spark, root), net))


@query()
def qnet_train(spark, root):
    """The mean squared error of the network before each step."""
    _, errors = vectors.train(feedback.examples(log(spark, root), nlp(spark, root)), 2 * DIMENSION)
    return spark.createDataFrame([(k, float(e)) for k, e in enumerate(errors, 1)], "step int, error double")


@query(
    f"WITH {_HITS} SELECT qid, string_agg('--- SOURCE ' || rank || ': ' || coalesce(source_file, '') || ' ---' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY rank) AS context,"
    " array_to_string(list_sort(list_distinct(list(list_extract(string_split(source_file, '/'), -1)))), ', ') AS sources, count(*) AS source_count FROM k GROUP BY qid"
)
def answer_contexts(spark, root):
    """For each query of the set the texts of its best three chunks in order, with their files."""
    own = collection(spark, root).select("id", "source_file", "content")
    return evaluation.contexts(hits(spark, root, 3).join(own, "id"))


@query(f"WITH {_LOG} SELECT project, count(*) AS n, round(coalesce(sum(reward::DECIMAL(18,2))::DOUBLE / count(reward), 0.0), 6) AS mean_reward, count_if(reward > 0)::BIGINT AS praised, count_if(reward < 0)::BIGINT AS blamed FROM g GROUP BY project")
def feedback_stats(spark, root):
    return feedback.figures(log(spark, root), "project")


@query(f"WITH {_LOG} SELECT count(*) AS n, round(coalesce(sum(reward::DECIMAL(18,2))::DOUBLE / count(reward), 0.0), 6) AS mean_reward, count_if(reward > 0)::BIGINT AS praised, count_if(reward < 0)::BIGINT AS blamed FROM g")
def feedback_total(spark, root):
    return feedback.figures(log(spark, root))


@query(f"WITH {_LOG} SELECT id, project, reward FROM g ORDER BY id DESC LIMIT 10")
def feedback_recent10(spark, root):
    return log(spark, root).select("id", "project", "reward").orderBy(F.desc("id")).limit(10)


@query(f"WITH {_LOG} SELECT id, project, round((sum(reward::DECIMAL(18,2)) OVER w)::DOUBLE / nullif(count(reward) OVER w, 0), 6) AS mean_so_far FROM g WINDOW w AS (PARTITION BY project ORDER BY id ROWS UNBOUNDED PRECEDING)")
def feedback_running_mean(spark, root):
    from quillstone.operators.ranking import running_mean

    rows = log(spark, root).select("id", "project", "reward")
    return running_mean(rows, ["project"], "id", F.col("reward"), "mean_so_far").select("id", "project", F.round("mean_so_far", 6).alias("mean_so_far"))


@query(f"WITH {_LOG} SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY id DESC)::INTEGER AS back, query FROM g QUALIFY row_number() OVER (PARTITION BY project ORDER BY id DESC) <= 4")
def history_last4(spark, root):
    return feedback.last_of(log(spark, root), ["project"], F.col("id"), 4).select("project", "id", "back", "query")


@query(
    f"WITH {_LOG}, {ONCE['n']}, k AS (SELECT lower(project) AS project, chunk_id, min(chunk_key) AS chunk_key FROM n WHERE chunk_id IS NOT NULL GROUP BY ALL), e AS (SELECT id, project, reward, unnest(ids) AS chunk_id FROM g)"
    " SELECT id, e.chunk_id, k.chunk_key, reward FROM e JOIN k ON k.project = e.project AND k.chunk_id = e.chunk_id"
)
def training_examples(spark, root):
    return feedback.examples(log(spark, root), nlp(spark, root)).select("id", "chunk_id", "chunk_key", "reward")


def log_results(spark: SparkSession, root: str) -> DataFrame:
    """For each entry of the log its sources and how many there are."""
    rows = log(spark, root)
    named = feedback.examples(rows, nlp(spark, root)).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.element_at(F.split("source_file", "/"), -1))), ", ").alias("sources"), F.count("*").alias("source_count"))
    return rows.select("id").join(named, "id", "left").select("id", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("source_count", F.lit(0)).cast("long").alias("source_count"))


_RESULTS = (
    f"{_LOG}, {ONCE['n']}, k AS (SELECT lower(project) AS project, chunk_id, arg_min(source_file, chunk_key) AS f FROM n WHERE chunk_id IS NOT NULL GROUP BY ALL), e AS (SELECT id, project, unnest(ids) AS chunk_id FROM g),"
    " j AS (SELECT id, list_extract(string_split(f, '/'), -1) AS f FROM e JOIN k ON k.project = e.project AND k.chunk_id = e.chunk_id), r AS (SELECT g.id, count(j.id) AS k FROM g LEFT JOIN j ON j.id = g.id GROUP BY g.id)"
)


@query(f"WITH {_RESULTS} SELECT count(*) AS questions, count_if(k > 0)::BIGINT AS sourced, round(sum(k)::DOUBLE / count(*), 1) AS mean_sources, min(k) > 0 AS passed, (SELECT count(DISTINCT f) FROM j) AS files FROM r")
def eval_summary(spark, root):
    return evaluation.summary(log_results(spark, root))


@query(f"WITH {_RESULTS} SELECT id, k AS source_count FROM r")
def source_counts(spark, root):
    return log_results(spark, root).select("id", "source_count")


_TERM_ROWS = f"{ONCE['n']}, w AS (SELECT chunk_key, lower(t) AS term FROM (SELECT chunk_key, unnest(tokens) AS t FROM n) WHERE regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]+')), p AS (SELECT chunk_key, term, count(*) AS tf FROM w GROUP BY ALL)"
_TERMS = f"{_TERM_ROWS}, v AS (SELECT term, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM n)) / (1.0::DOUBLE + count(*))) + 1.0 AS idf FROM p GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 256)"


@query(f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM v")
def tfidf_top_terms(spark, root):
    return vectors.terms(nlp(spark, root), "tokens").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TERMS}, r AS (SELECT chunk_key, term, (ln(tf::DOUBLE) + 1.0) * idf AS w FROM p JOIN v USING (term)) SELECT chunk_key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_key)), 5) AS weight FROM r")
def tfidf_vectors(spark, root):
    return vectors.term_vectors(nlp(spark, root), "chunk_key", "tokens").select("chunk_key", "term", F.round("weight", 5).alias("weight"))


@query()
def pca_2d(spark, root):
    """All vectors on their two main axes."""
    return vectors.principal_axes(read_table(spark, root, "embeddings"), "vec_id", "embedding")[0]


@query()
def pca_variance(spark, root):
    _, shares = vectors.principal_axes(read_table(spark, root, "embeddings"), "vec_id", "embedding")
    return spark.createDataFrame([(k, s) for k, s in enumerate(shares, 1)], "axis int, share double")


@query(f"WITH {_LOG} SELECT project, count(*) AS n, round(coalesce(sum(reward::DECIMAL(18,2))::DOUBLE / nullif(count(reward), 0), 0.0), 6) AS mean_reward, count_if(reward > 0)::BIGINT AS praised, count_if(reward < 0)::BIGINT AS blamed FROM g GROUP BY project")
def feedback_stream(spark, root):
    """The figures of each project from the log as a stream."""
    from quillstone.streaming.feedback import follow

    return follow(spark, f"{root}/experiences.parquet")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 800")
def vector_sample(spark, root):
    """The first vectors of a collection, as a plot takes them."""
    return read_table(spark, root, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(800)


@query(f"WITH {ONCE['n']} SELECT project, count(*) AS n FROM n WHERE project = (SELECT min(project) FROM n) GROUP BY project")
def default_collection(spark, root):
    """The collection that is taken where none is named, the first by name, and its size."""
    sizes = nlp(spark, root).where("project is not null").groupBy("project").agg(F.count("*").alias("n"))
    return sizes.orderBy("project").limit(1)
