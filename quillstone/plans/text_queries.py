"""Queries over texts: cleaning, tokens, tags, scores, entities, languages and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import languages, rules, scoring, text
from quillstone.operators import entities, parsers, segments
from quillstone.operators.ranking import latest, latest_wide
from quillstone.plans.catalog import ONCE, query, quoted
from quillstone.sources.tables import read_table

B = text.BLANKS


def nlp_rows(spark: SparkSession, root: str) -> DataFrame:
    """The enriched chunks with their repeated rows, which are equal: what is made of a row can be made unique afterwards, when it is smaller."""
    return read_table(spark, root, "nlp_chunks")


def once(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["chunk_key"])


def nlp(spark: SparkSession, root: str) -> DataFrame:
    """One row of each enriched chunk, for queries that need few columns of it."""
    return once(nlp_rows(spark, root))


def chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The last taken in row of each chunk with these columns; no other is read."""
    return latest(read_table(spark, root, "chunks").select("chunk_key", "ingested_at", *columns), ["chunk_key"], "ingested_at")


def whole_chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The same for queries whose result is as wide as the texts."""
    return latest_wide(read_table(spark, root, "chunks").select("chunk_key", "ingested_at", *columns), ["chunk_key"], "ingested_at")


def made_of_chunks(spark: SparkSession, root: str, **made: Column) -> DataFrame:
    """What is made of each chunk's columns, of its last taken in row: all rows are worked on where they are, and only the results are compared by key."""
    rows = read_table(spark, root, "chunks").select("chunk_key", "ingested_at", *[c.alias(name) for name, c in made.items()])
    return latest(rows, ["chunk_key"], "ingested_at").drop("ingested_at")


def _re(column: str, form: str, by: str = "''") -> str:
    return f"regexp_replace({column}, {quoted(form)}, {by}, 'g')"


def _strip(column: str) -> str:
    return _re(column, rf"\A[\n{B}]+|[\n{B}]+\z")


def _folded(column: str) -> str:
    out = f"nfc_normalize({column})"
    for k, v in text.FOLDED.items():
        out = f"replace({out}, {quoted(k)}, {quoted(v)})"
    return out


_PLAIN = _re(_re("text", text.ANSI), text.CONTROLS)
_CLEAN = _strip(_re(_re(_folded(_PLAIN), rf"[{B}]+", "' '"), r"\n{3,}", "chr(10) || chr(10)"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, {quoted(text.TOKEN)})) AS BIGINT) AS token_count FROM documents WHERE text IS NOT NULL")
def doc_tokens(spark, root):
    docs = read_table(spark, root, "documents").where("text is not null")
    return docs.select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("token_count"))


@query(f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def doc_clean_text(spark, root):
    docs = read_table(spark, root, "documents")
    return docs.select("doc_id", text.cleaned(F.col("text"), F.lit("doc_section")).alias("cleaned"))


@query(f"SELECT doc_id, {_folded('text')} AS folded FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]')")
def unicode_fold(spark, root):
    docs = read_table(spark, root, "documents").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", text.folded(F.col("text")).alias("folded"))


@query()
def chunk_clean_text(spark, root):
    """Every chunk cleaned as its kind is, with comments removed from code."""
    c = whole_chunks(spark, root, "content", "chunk_type", "language")
    return c.select("chunk_key", text.cleaned(F.col("content"), F.col("chunk_type"), F.col("language"), comments=False).alias("cleaned"))


_LANG = "CASE ltrim(lower(language), '.') " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in sorted(rules.LANGUAGE_NAMES.items())) + " ELSE ltrim(lower(language), '.') END"


@query(f"WITH {ONCE['c']}, l AS (SELECT CASE WHEN coalesce(language, '') = '' THEN NULL ELSE {_LANG} END AS lang FROM c) SELECT lang, count(*) AS n FROM l GROUP BY lang")
def language_names(spark, root):
    return chunks(spark, root, "language").groupBy(text.language_name(F.col("language")).alias("lang")).agg(F.count("*").alias("n"))


_TEXT = "coalesce(nullif(cleaned_text, ''), content)"
_TAG_CASES = ", ".join(f"CASE WHEN regexp_matches({_TEXT}, {quoted(scoring.tag_pattern(t))}) THEN {quoted(t)} END" for t in sorted(rules.TAGS))
_TAGGED = f"{ONCE['n']}, t AS (SELECT chunk_key, list_filter([{_TAG_CASES}], lambda x: x IS NOT NULL) AS tags FROM n)"


def tagged(spark: SparkSession, root: str) -> DataFrame:
    return once(nlp_rows(spark, root).select("chunk_key", scoring.tags(text.first_text(F.col("cleaned_text"), F.col("content"))).alias("tags")))


@query(f"WITH {_TAGGED} SELECT chunk_key, array_to_string(tags, ',') AS tags FROM t")
def tag_assign(spark, root):
    return tagged(spark, root).select("chunk_key", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TAGGED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM t) GROUP BY tag ORDER BY n DESC, tag LIMIT 25")
def tag_top25(spark, root):
    tags = tagged(spark, root).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(25)


@query(
    f"WITH {_TAGGED}, e AS (SELECT chunk_key, unnest(tags) AS tag FROM t), top AS (SELECT tag FROM e GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 10)"
    " SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM e a JOIN e b ON a.chunk_key = b.chunk_key WHERE a.tag IN (FROM top) AND b.tag IN (FROM top) GROUP BY 1, 2"
)
def tag_cooccur(spark, root):
    """How often two of the ten most frequent tags meet; a row has 25 tags at most, so that its pairs are bounded."""
    t = tagged(spark, root)
    top = t.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)
    known = F.broadcast(top.agg(F.collect_set("tag").alias("top")))  # ten tags
    kept = t.crossJoin(known).select(F.array_intersect("tags", "top").alias("tags"))
    pairs = kept.select("tags", F.explode("tags").alias("tag_a")).select("tag_a", F.explode("tags").alias("tag_b"))
    return pairs.groupBy("tag_a", "tag_b").agg(F.count("*").alias("n"))


_DEPTH = (
    "coalesce(list_max([CASE WHEN contains(x, '    ') THEN (length(x) - length(regexp_replace(x, '^[ \\t\\r\\x0b\\x0c]+', ''))) // 4 ELSE length(x) - length(regexp_replace(x, '^[ \\t\\r\\x0b\\x0c]+', '')) END"
    " FOR x IN string_split({t}, chr(10)) IF trim(translate(x, chr(9) || chr(13), '  ')) <> '']), 0)"
)
_SCORED = (
    f"{ONCE['n']}, s AS (SELECT chunk_key, file_id, source_file, {_TEXT} AS t, len(regexp_extract_all({_TEXT}, {quoted(text.TOKEN)})) AS k FROM n),"
    f" z AS (SELECT chunk_key, file_id, source_file, k, round(least(len(regexp_extract_all(t, {quoted(rules.BRANCH_FORM)})) * 0.05::DOUBLE + {_DEPTH.format(t='t')} * 0.05::DOUBLE + ln(1 + k::DOUBLE) / ln(2001::DOUBLE) * 0.5::DOUBLE, 1.0::DOUBLE), 3) AS score FROM s)"
)


def scored(spark: SparkSession, root: str) -> DataFrame:
    t = text.first_text(F.col("cleaned_text"), F.col("content"))
    n = nlp_rows(spark, root).select("chunk_key", "file_id", t.alias("t"))
    k = F.size(text.tokens(F.col("t")))
    return once(n.select("chunk_key", "file_id", scoring.complexity(F.col("t"), k).alias("score")))


@query(f"WITH {_SCORED} SELECT chunk_key, score FROM z")
def complexity_score(spark, root):
    return scored(spark, root).select("chunk_key", "score")


_BAND = "CASE WHEN score <= 0 THEN NULL WHEN score <= 0.2 THEN 'Trivial' WHEN score <= 0.4 THEN 'Simple' WHEN score <= 0.6 THEN 'Moderate' WHEN score <= 0.8 THEN 'Complex' ELSE 'Very Complex' END"


@query(f"WITH {_SCORED}, b AS (SELECT {_BAND} AS band FROM z) SELECT v.band, count(b.band) AS n FROM (VALUES ('Trivial'), ('Simple'), ('Moderate'), ('Complex'), ('Very Complex')) v(band) LEFT JOIN b ON b.band = v.band GROUP BY v.band")
def complexity_bands(spark, root):
    """Chunks in each band, empty bands included."""
    found = scored(spark, root).groupBy(scoring.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(x,) for x in ("Trivial", "Simple", "Moderate", "Complex", "Very Complex")], "band string")
    return names.join(found, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {_SCORED} SELECT file_id, round(avg(score), 4) AS mean_score, max(score) AS max_score, count(*) AS n FROM z GROUP BY file_id ORDER BY mean_score DESC, file_id LIMIT 20")
def complexity_by_file(spark, root):
    per = scored(spark, root).groupBy("file_id").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.max("score").alias("max_score"), F.count("*").alias("n"))
    return per.orderBy(F.desc("mean_score"), "file_id").limit(20)


_DOC, _TEST, _TODO = (f"regexp_matches({_TEXT}, {quoted(x)})" for x in (rules.DOC_FORM, rules.TEST_FORM, rules.TODO_FORM))


@query(f"WITH {ONCE['n']} SELECT file_type, count_if({_DOC} OR coalesce(docstring, '') <> '')::BIGINT AS documented, count_if({_TEST})::BIGINT AS tests, count_if({_TODO})::BIGINT AS todos, count(*) AS n FROM n GROUP BY file_type")
def flags_rollup(spark, root):
    t = text.first_text(F.col("cleaned_text"), F.col("content"))
    n = nlp_rows(spark, root).withColumn("t", t)
    made = n.select("chunk_key", "file_type", scoring.has_documentation(F.col("t"), F.col("docstring")).alias("d"), scoring.has_tests(F.col("t")).alias("x"), scoring.has_todos(F.col("t")).alias("y"))
    return once(made).groupBy("file_type").agg(F.count_if("d").alias("documented"), F.count_if("x").alias("tests"), F.count_if("y").alias("todos"), F.count("*").alias("n"))


@query(f"WITH {ONCE['n']} SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all({_TEXT}, {quoted(rules.PUBLIC_FORM)}, 1))) AS name FROM n) GROUP BY name ORDER BY n DESC, name LIMIT 20")
def api_names(spark, root):
    made = nlp_rows(spark, root).select("chunk_key", scoring.public_names(text.first_text(F.col("cleaned_text"), F.col("content"))).alias("names"))
    names = once(made).select(F.explode("names").alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)


def _starts(form: str, t: str = "t") -> str:
    """SQL for the places of all matches of a form in a column: the lengths of what comes before each."""
    gaps, found = f"regexp_split_to_array({t}, {quoted(form)})", f"regexp_extract_all({t}, {quoted(form)})"
    return f"list_transform(range(1, len({found}) + 1), lambda i: (list_sum(list_transform(list_slice({gaps}, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice({found}, 1, i - 1), lambda g: length(g))), 0))::INTEGER)"


def _rule_sql(k: int, label: str, form: str, groups: int) -> str:
    whole = f"regexp_extract_all(t, {quoted(form)}, 0)"
    if groups == 0:
        texts = whole
    else:
        parts = [f"regexp_extract_all(t, {quoted(form)}, {g})" for g in range(1, groups + 1)]
        zipped = ", ".join([*parts, whole])
        texts = f"list_transform(list_zip({zipped}), lambda z: coalesce({', '.join(f'nullif(z[{g}], {chr(39) * 2})' for g in range(1, groups + 2))}))"
    return f"SELECT chunk_key, {k} AS rule, {quoted(label)} AS label, unnest({texts}) AS x, generate_subscripts({texts}, 1) AS pos FROM s"


_ENTITIES = (
    f"{ONCE['n']}, s AS (SELECT chunk_key, {_TEXT} AS t FROM n), r AS (" + " UNION ALL ".join(_rule_sql(k, *r) for k, r in enumerate(rules.ENTITY_RULES)) + "),"
    " q AS (SELECT chunk_key, rule, label, pos, trim(translate(x, chr(10) || chr(13) || chr(9), '   ')) AS text FROM r),"
    " e AS (SELECT chunk_key, label, text FROM q WHERE length(text) >= 2 QUALIFY row_number() OVER (PARTITION BY chunk_key, label, lower(text) ORDER BY rule, pos) = 1)"
)


def found_entities(spark: SparkSession, root: str) -> DataFrame:
    # equal entities of a chunk become one, those of its repeated rows with them
    return entities.chunk_entities(nlp_rows(spark, root), "chunk_key", text.first_text(F.col("cleaned_text"), F.col("content")))


@query(f"WITH {_ENTITIES} SELECT chunk_key, label, text FROM e")
def ner_all(spark, root):
    return found_entities(spark, root)


@query(f"WITH {_ENTITIES} SELECT label, count(*) AS n, count(DISTINCT text) AS texts FROM e GROUP BY label")
def ner_labels(spark, root):
    return found_entities(spark, root).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query(
    f"WITH {_ENTITIES}, k AS (SELECT label, substring(text, 1, 40) AS text, count(*) AS n FROM e GROUP BY 1, 2), top AS (SELECT label FROM k GROUP BY label ORDER BY sum(n) DESC, label LIMIT 8)"
    " SELECT label, text, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, text)::INTEGER AS rank FROM k WHERE label IN (FROM top) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, text) <= 6"
)
def ner_label_topk(spark, root):
    return entities.top_entities(found_entities(spark, root))


_PLACED = (
    f"{ONCE['n']}, s AS (SELECT chunk_key, {_TEXT} AS t FROM n), r AS ("
    + " UNION ALL ".join(_rule_sql(k, *r).replace(" AS pos FROM s", f" AS pos, unnest({_starts(r[1])}) AS a, unnest(regexp_extract_all(t, {quoted(r[1])})) AS whole FROM s") for k, r in enumerate(rules.ENTITY_RULES))
    + "), q AS (SELECT chunk_key, rule, label, pos, a, a + length(whole) AS b, trim(translate(x, chr(10) || chr(13) || chr(9), '   ')) AS text FROM r)"
)


@query(f"WITH {_PLACED} SELECT chunk_key, text, label, a::INTEGER AS start, b::INTEGER AS \"end\", 1.0::DOUBLE AS score FROM q WHERE length(text) >= 2 QUALIFY row_number() OVER (PARTITION BY chunk_key, label, lower(text) ORDER BY pos) = 1")
def ner_places(spark, root):
    """The entities of each chunk with their places."""
    t = text.first_text(F.col("cleaned_text"), F.col("content"))
    return once(nlp_rows(spark, root).select("chunk_key", entities.entities_with_places(t).alias("e"))).select("chunk_key", F.explode("e").alias("e")).select("chunk_key", "e.*")


_COUNTS = ", ".join(f"{{'n': len(regexp_extract_all(t, {quoted(form)})), 'k': {-k}, 'lang': {quoted(lang)}}}" for k, (lang, form) in enumerate(sorted(rules.SCRIPTS.items())))
_LANGUAGE = (
    "s AS (SELECT doc_id AS id, text AS t FROM documents), m AS (SELECT id, t, list_max([" + _COUNTS + "]) AS top FROM s),"
    " l AS (SELECT id, CASE WHEN coalesce(length(t) < 20, true) OR top.n = 0 THEN 'en' ELSE top.lang END AS lang,"
    " CASE WHEN coalesce(length(t) < 20, true) THEN 1.0::DOUBLE WHEN top.n = 0 THEN 0.5::DOUBLE ELSE round(least(top.n::DOUBLE / greatest(length(t), 1) * 5, 0.95::DOUBLE), 3) END AS conf FROM m)"
)


@query(f"WITH {_LANGUAGE} SELECT id AS doc_id, lang, conf FROM l")
def lang_script_detect(spark, root):
    docs = read_table(spark, root, "documents")
    return docs.select("doc_id", languages.script_language(F.col("text")).alias("l")).select("doc_id", "l.lang", "l.conf")


@query(f"WITH {_LANGUAGE} SELECT lang, count(*) AS n, count_if(lang <> 'en' AND conf >= 0.6)::BIGINT AS gated FROM l GROUP BY lang")
def lang_gate(spark, root):
    """Documents by script, and how many of each would be translated."""
    docs = read_table(spark, root, "documents").select(languages.script_language(F.col("text")).alias("l"))
    gate = languages.translate_gate(F.col("l.lang"), F.col("l.conf"), F.lit("doc_section"))
    return docs.groupBy(F.col("l.lang").alias("lang")).agg(F.count("*").alias("n"), F.count_if(gate).alias("gated"))


@query("WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '\\A\\s+|\\s+\\z', '', 'g')), lambda x: x <> '')) AS body FROM documents) SELECT doc_id, count(*) AS paragraphs, sum(length(body))::BIGINT AS chars FROM p GROUP BY doc_id")
def para_split(spark, root):
    p = read_table(spark, root, "documents").select("doc_id", F.explode(segments.paragraphs(F.col("text"))).alias("body"))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("body")).alias("chars"))


@query(
    "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),"
    " s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 50, 1), 200)) AS i FROM w) SELECT doc_id, i::INTEGER AS first_word, len(list_slice(words, i + 1, i + 250))::INTEGER AS words, length(array_to_string(list_slice(words, i + 1, i + 250), ' '))::INTEGER AS chars FROM s"
)
def sliding_window(spark, root):
    docs = read_table(spark, root, "documents").where("text is not null")
    made = docs.select("doc_id", F.posexplode(segments.word_windows(F.col("text"))).alias("k", "body"))
    return made.select("doc_id", (F.col("k") * 200).cast("int").alias("first_word"), F.size(F.filter(F.split("body", " "), lambda w: w != "")).alias("words"), F.length("body").alias("chars"))


_STRATEGY = "CASE " + " ".join(f"WHEN chunk_type IN ({', '.join(map(quoted, kinds))}) THEN '{name}'" for name, kinds in (("doc", rules.DOC_CHUNKS), ("code", rules.CODE_CHUNKS), ("data", rules.DATA_CHUNKS))) + " ELSE 'fallback' END"

_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"


_DEFINITION = "(?m)" + rules.FUNCTION_FORM.replace(r"\w", r"[\p{L}\p{N}_]") + "|" + rules.CLASS_FORM.replace(r"\w", r"[\p{L}\p{N}_]")
_SEGMENTED = (
    f"{ONCE['n']}, s AS (SELECT chunk_key, chunk_id, coalesce({_TEXT}, '') AS t, {_STRATEGY} AS kind FROM n),"
    f" m AS (SELECT *, CASE WHEN kind = 'doc' THEN {_starts(rules.HEADING_FORM)} END AS heads, CASE WHEN kind = 'doc' THEN {_starts(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')} END AS blanks, CASE WHEN kind = 'code' THEN {_starts(_DEFINITION)} END AS defs, {_starts(chr(92) + 'S+')} AS ws FROM s),"
    " x AS (SELECT chunk_key, chunk_id, t, CASE WHEN kind = 'data' THEN [0] WHEN kind = 'doc' THEN CASE WHEN len(heads) > 0 THEN heads ELSE blanks END WHEN kind = 'code' AND len(defs) > 1 THEN defs END AS cuts,"
    " CASE WHEN kind = 'fallback' OR kind = 'code' AND len(defs) <= 1 THEN CASE WHEN len(ws) = 0 THEN [0] ELSE list_transform(range(0, greatest(len(ws) - 50, 1), 200), lambda i: ws[i + 1]) END END AS wins, ws FROM m),"
    " e AS (SELECT chunk_key, chunk_id, t, ws, wins, CASE WHEN cuts IS NULL THEN NULL WHEN len(cuts) = 0 THEN [0] WHEN cuts[1] > 0 THEN list_concat([0], cuts) ELSE cuts END AS cuts FROM x),"
    " w AS (SELECT chunk_key, chunk_id, t, i, CASE WHEN cuts IS NOT NULL THEN cuts[i] ELSE wins[i] END AS a, CASE WHEN cuts IS NOT NULL THEN coalesce(cuts[i + 1], length(t)) ELSE coalesce(ws[(i - 1) * 200 + 251], length(t)) END AS b"
    " FROM (SELECT *, unnest(range(1, len(coalesce(cuts, wins)) + 1)) AS i FROM e))"
)


@query(f"WITH {_SEGMENTED}, r AS (SELECT chunk_key, coalesce(chunk_id, '') || '__seg_' || i AS segment_id, a::INTEGER AS start_char, b::INTEGER AS end_char, regexp_replace(substring(t, a + 1, b - a), {quoted(chr(92) + 'A' + _WS + '+|' + _WS + '+' + chr(92) + 'z')}, '', 'g') AS text FROM w) SELECT * FROM r WHERE text <> ''")
def segment_spans(spark, root):
    """The segments of each chunk by its strategy, with their places."""
    t = text.first_text(F.col("cleaned_text"), F.col("content"))
    made = nlp_rows(spark, root).select("chunk_key", segments.segments(t, segments.strategy(F.col("chunk_type")), F.col("chunk_id")).alias("s"))
    narrow = made.select("chunk_key", F.posexplode("s").alias("k", "s"))
    # repeated rows are equal, so that their segments are
    return narrow.dropDuplicates(["chunk_key", "k"]).select("chunk_key", "s.segment_id", "s.start_char", "s.end_char", "s.text")


_MARKED = "regexp_replace(text, '([.!?])(\\s+)([A-Z])', '\\1' || chr(1) || '\\3', 'g')"
_WORDS = "list_distinct(regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+'))"
_SENTENCES = (
    f"p AS (SELECT doc_id, text, string_split({_MARKED}, chr(1)) AS x FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, text, x, list_transform(x, lambda s: {_WORDS}) AS v FROM p),"
    " k AS (SELECT doc_id, text, x, list_transform(range(1, len(x)), lambda i: CASE WHEN len(v[i]) > 0 AND len(v[i + 1]) > 0 THEN len(list_intersect(v[i], v[i + 1])) / sqrt(len(v[i])::DOUBLE * len(v[i + 1])) ELSE 0.0::DOUBLE END) AS alike FROM w)"
)


@query(
    f"WITH {_SENTENCES}, e AS (SELECT doc_id, CASE WHEN len(x) < 3 THEN [0, length(text)] ELSE list_concat([0], list_transform(list_filter(range(1, len(x)), lambda i: alike[i] < 0.1), lambda i: list_sum(list_transform(list_slice(x, 1, i), lambda y: length(y) + 1))::BIGINT), [length(text)]) END AS edges FROM k)"
    " SELECT doc_id, i::INTEGER AS k, edges[i]::INTEGER AS start_char, edges[i + 1]::INTEGER AS end_char FROM (SELECT *, unnest(range(1, len(edges))) AS i FROM e)"
)
def similarity_segments(spark, root):
    """Spans of sentences of each document, cut where neighbours have few words in common."""
    docs = read_table(spark, root, "documents").where("text is not null")
    made = docs.select("doc_id", F.posexplode(segments.similarity_cuts(F.col("text"), 0.1)).alias("k", "s"))
    return made.select("doc_id", (F.col("k") + 1).alias("k"), "s.start_char", "s.end_char")


@query(f"WITH {_SENTENCES} SELECT doc_id, i::INTEGER AS k, round(alike[i], 5) AS similarity FROM (SELECT *, unnest(range(1, len(x))) AS i FROM k WHERE len(x) > 1)")
def sentence_similarity(spark, root):
    """How much each sentence of a document and the next have in common."""
    docs = read_table(spark, root, "documents").where("text is not null")
    made = docs.select("doc_id", F.posexplode(segments.neighbour_similarities(segments.sentences(F.col("text")))).alias("k", "s"))
    return made.select("doc_id", (F.col("k") + 1).alias("k"), F.round("s", 5).alias("similarity"))


@query(f"WITH {ONCE['n']} SELECT {_STRATEGY} AS strategy, count(*) AS n FROM n GROUP BY 1")
def segment_strategies(spark, root):
    return nlp(spark, root).groupBy(segments.strategy(F.col("chunk_type")).alias("strategy")).agg(F.count("*").alias("n"))


@query(
    "WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n\\z', ''), chr(10)) END AS x FROM documents WHERE text IS NOT NULL),"
    " s AS (SELECT doc_id, x, unnest(range(0, len(x), 60)) AS i FROM l), b AS (SELECT doc_id, i, len(x) AS k, substring(array_to_string(list_slice(x, i + 1, i + 60), chr(10)), 1, 4000) AS content FROM s)"
    " SELECT doc_id, '__block__' || (i // 60 + 1) AS name, (i + 1)::INTEGER AS start_line, least(i + 60, k)::INTEGER AS end_line, content FROM b WHERE regexp_replace(content, '\\s+', '', 'g') <> ''"
)
def line_blocks(spark, root):
    docs = read_table(spark, root, "documents").where("text is not null")
    made = docs.select("doc_id", F.explode(parsers.line_blocks(F.col("text"))).alias("p"))
    return made.select("doc_id", "p.name", "p.start_line", "p.end_line", "p.content")


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),"
    " h AS (SELECT doc_id, i, regexp_extract(x, '^(#{1,6})[ \\t]+[^\\n]+', 1) AS marks, regexp_replace(regexp_extract(x, '^#{1,6}[ \\t]+([^\\n]+)', 1), '\\A\\s+|\\s+\\z', '', 'g') AS name FROM l WHERE regexp_matches(x, '^#{1,6}[ \\t]+[^ \\t\\r\\n]'))"
    " SELECT doc_id, i::INTEGER AS start_line, length(marks)::INTEGER AS level, name FROM h"
)
def md_sections(spark, root):
    docs = read_table(spark, root, "documents")
    made = docs.select("doc_id", F.explode(parsers.delimited(F.col("text"), r"^#{1,6}[ \t]+[^ \t\r\n][^\n]*")).alias("p"))
    body = F.col("p.body")
    return made.select("doc_id", F.col("p.line").cast("int").alias("start_line"), F.length(F.regexp_extract(body, r"^(#{1,6})", 1)).alias("level"), F.regexp_replace(F.regexp_extract(body, r"^#{1,6}[ \t]+([^\n]+)", 1), r"\A\s+|\s+\z", "").alias("name"))


@query(
    f"WITH {ONCE['c']} SELECT chunk_key, substring(concat_ws(' ' || chr(10), nullif(name, ''), substring(nullif(docstring, ''), 1, 300), nullif(content, '')), 1, 2000) AS embed_text FROM c"
)
def embed_text(spark, root):
    return whole_chunks(spark, root, "name", "docstring", "content").select("chunk_key", text.embedding_text(F.col("name"), F.col("docstring"), F.col("content")).alias("embed_text"))


@query()
def enrich_chunks(spark, root):
    """All steps of the enrichment over all chunks."""
    from quillstone.plans.pipeline import enrich

    made = enrich(whole_chunks(spark, root, "chunk_id", "content", "chunk_type", "language", "docstring"))
    return made.select("chunk_key", "cleaned_text", "token_count", "normalized_lang", F.size("entities").alias("entities"), "segment_count", F.array_join("tags", ",").alias("tags"), "complexity_score", "embedding_dim", "detected_lang", "is_translated")


def _query_rule_sql(k: int, label: str, form: str, group: int) -> str:
    return f"SELECT doc_id, {k} AS rule, {quoted(label)} AS label, unnest(regexp_extract_all(text, {quoted(form)}, {group})) AS x, generate_subscripts(regexp_extract_all(text, {quoted(form)}, {group}), 1) AS pos FROM documents"


@query(
    "WITH r AS (" + " UNION ALL ".join(_query_rule_sql(k, *r) for k, r in enumerate(rules.QUERY_ENTITY_RULES)) + "), e AS (SELECT doc_id, rule, pos, label, trim(x) AS text FROM r WHERE length(x) > 1 QUALIFY row_number() OVER (PARTITION BY doc_id, label, lower(trim(x)) ORDER BY pos) = 1)"
    " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos)::INTEGER AS k, label, text FROM e QUALIFY k <= 12"
)
def query_entities(spark, root):
    """The first twelve entities of each document, by the rules for queries."""
    q = read_table(spark, root, "documents").select("doc_id", F.posexplode(entities.query_entities(F.col("text"))).alias("k", "e"))
    return q.select("doc_id", (F.col("k") + 1).alias("k"), "e.label", "e.text")


_QUERY_COUNTS = ", ".join(f"{{'n': len(regexp_extract_all(t, {quoted(form)})), 'first': -coalesce(nullif(length(regexp_extract(t, {quoted('^((?s:.*?))' + form)}, 1)), NULL), 0), 'lang': {quoted(lang)}}}" for lang, form in sorted(rules.QUERY_SCRIPTS.items()))
_TITLES = "CASE lang " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in sorted(rules.QUERY_LANGUAGES.items())) + " ELSE upper(lang) END"


@query(
    f"WITH s AS (SELECT doc_id, trim(translate(text, chr(10) || chr(13) || chr(9), '   ')) AS t FROM documents), m AS (SELECT doc_id, t, list_max([{_QUERY_COUNTS}]) AS top FROM s),"
    " l AS (SELECT doc_id, CASE WHEN coalesce(t, '') = '' OR top.n = 0 THEN 'en' ELSE top.lang END AS lang, CASE WHEN coalesce(t, '') = '' THEN 1.0::DOUBLE WHEN top.n = 0 THEN 0.5::DOUBLE ELSE round(least(top.n::DOUBLE / greatest(length(t), 1) * 5, 0.95::DOUBLE), 3) END AS conf FROM m)"
    f" SELECT doc_id, lang, {_TITLES} AS name, conf FROM l"
)
def query_languages(spark, root):
    """The language by script, with its name, as a query would be told."""
    docs = read_table(spark, root, "documents")
    return docs.select("doc_id", languages.query_language(F.col("text")).alias("l")).select("doc_id", "l.lang", "l.name", "l.conf")


_COLOUR = "CASE WHEN score IS NULL THEN NULL " + " ".join(f"WHEN score < {bound} THEN {quoted(name)}" for bound, name in rules.COMPLEXITY_COLOURS[:-1]) + f" ELSE {quoted(rules.COMPLEXITY_COLOURS[-1][1])} END"


@query(f"WITH {_SCORED} SELECT {_COLOUR} AS colour, count(*) AS n FROM z GROUP BY 1")
def complexity_colours(spark, root):
    return scored(spark, root).groupBy(scoring.colour(F.col("score")).alias("colour")).agg(F.count("*").alias("n"))


@query(f"WITH {ONCE['n']}, v AS (SELECT chunk_key, substring(concat_ws(' ' || chr(10), nullif(name, ''), substring(nullif(docstring, ''), 1, 300), {_TEXT}), 1, 2000) AS t FROM n) SELECT chunk_key, 2 AS embedding_dim, length(t)::DOUBLE AS characters, (length(t) - length(replace(t, ' ', '')))::DOUBLE AS blanks FROM v")
def embedded_chunks(spark, root):
    """Vectors by a function that is passed in: here one of two figures of a text."""
    from quillstone.plans.pipeline import embed_with

    rows = nlp_rows(spark, root).select("chunk_key", "name", "docstring", "cleaned_text", "content")
    made = embed_with(rows, "figures", lambda texts: [[len(t), t.count(" ")] for t in texts])
    return once(made.select("chunk_key", "embedding_dim", F.get("embedding", 0).cast("double").alias("characters"), F.get("embedding", 1).cast("double").alias("blanks")))


@query(
    f"WITH s AS (SELECT doc_id, text AS t FROM documents WHERE regexp_matches(text, {quoted('(?m)' + parsers.HEADING)})), h AS (SELECT doc_id, t, {_starts('(?m)' + parsers.HEADING)} AS places FROM s),"
    " p AS (SELECT doc_id, i, substring(t, places[i] + 1, coalesce(places[i + 1], length(t)) - places[i]) AS body, substring(t, 1, places[i]) AS before FROM (SELECT *, unnest(range(1, len(places) + 1)) AS i FROM h)),"
    " b AS (SELECT doc_id, i, before, regexp_replace(body, '\\A[\\s\\x0b]+|[\\s\\x0b]+\\z', '', 'g') AS body FROM p)"
    " SELECT doc_id, 'h' || length(regexp_extract(body, '^(#{1,6})', 1)) || '_section' AS kind, regexp_replace(regexp_extract(body, '^#{1,6}\\s+([^\\n]+)', 1), '\\A[\\s\\x0b]+|[\\s\\x0b]+\\z', '', 'g') AS name,"
    " (length(before) - length(replace(before, chr(10), '')) + 1)::INTEGER AS start_line, (length(before) - length(replace(before, chr(10), '')) + 1 + length(body) - length(replace(body, chr(10), '')))::INTEGER AS end_line, substring(body, 1, 4000) AS content FROM b"
    " UNION ALL SELECT doc_id, 'paragraph', 'p' || k, NULL, NULL, substring(x, 1, 4000) FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(translate(x, chr(10) || chr(13) || chr(9), '   ')) <> '') AS l FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, "
    + quoted("(?m)" + parsers.HEADING)
    + ")))"
)
def markdown_pieces(spark, root):
    """Every document cut as Markdown: by its headings, or into paragraphs where it has none."""
    docs = read_table(spark, root, "documents").where("text is not null")
    made = docs.select("doc_id", F.explode(parsers.markdown(F.col("text"))).alias("p"))
    return made.select("doc_id", "p.kind", "p.name", "p.start_line", "p.end_line", "p.content")


def _uncommented(column: str) -> str:
    cases = []
    for forms in sorted(set(rules.COMMENTS.values())):
        out = column
        for form in forms:
            out = _re(out, form, "' '")
        cases.append(f"WHEN lang IN ({', '.join(quoted(k) for k, v in sorted(rules.COMMENTS.items()) if v == forms)}) THEN {out}")
    return f"CASE {' '.join(cases)} ELSE {column} END"


@query(f"WITH {ONCE['c']}, l AS (SELECT chunk_key, content, CASE WHEN coalesce(language, '') = '' THEN NULL ELSE {_LANG} END AS lang FROM c), p AS (SELECT chunk_key, {_uncommented('content')} AS t FROM l) SELECT chunk_key, length(t)::INTEGER AS chars, md5(t) AS digest FROM p")
def comments_removed(spark, root):
    """What is left of each chunk without the comments of its language, by length and digest."""
    t = text.without_comments(F.col("content"), text.language_name(F.col("language")))
    rows = read_table(spark, root, "chunks").select("chunk_key", "ingested_at", t.alias("t"))
    return latest(rows.select("chunk_key", "ingested_at", F.length("t").alias("chars"), F.md5("t").alias("digest")), ["chunk_key"], "ingested_at").drop("ingested_at")


_TWICE = ", ".join(f"CASE WHEN len(regexp_extract_all({_TEXT}, {quoted(scoring.tag_pattern(t))})) >= 2 THEN {quoted(t)} END" for t in sorted(rules.TAGS))


@query(f"WITH {ONCE['n']} SELECT chunk_key, array_to_string(list_filter([{_TWICE}], lambda x: x IS NOT NULL), ',') AS tags FROM n")
def tags_of_two_hits(spark, root):
    """The tags of each chunk of which at least two keywords occur."""
    made = scoring.tags(text.first_text(F.col("cleaned_text"), F.col("content")), least=2)
    return once(nlp_rows(spark, root).select("chunk_key", F.array_join(made, ",").alias("tags")))


_SAFE = "substring(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), 1, 25)"
_STEM = "regexp_replace(list_extract(string_split(source_file, '/'), -1), '(.)\\.[^.]*$', '\\1')"


@query(f"WITH {ONCE['c']} SELECT chunk_key, concat_ws('__', {_SAFE.format(c=_STEM)}, chunk_type, {_SAFE.format(c='name')}, (row_number() OVER (PARTITION BY file_id ORDER BY chunk_key))::VARCHAR) AS id FROM c WHERE source_file IS NOT NULL")
def numbered_ids(spark, root):
    """Ids of chunks by file name, kind, name and place in their file."""
    from quillstone.operators.ranking import numbered

    c = chunks(spark, root, "file_id", "source_file", "chunk_type", "name").where("source_file is not null")
    return numbered(c, ["file_id"], "chunk_key", "k").select("chunk_key", text.chunk_id(F.col("source_file"), F.col("chunk_type"), F.col("name"), F.col("k")).alias("id"))


_JSON_KINDS = "CASE json_type(v) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' ELSE 'int' END"


@query(
    f"WITH {ONCE['c']}, j AS (SELECT chunk_key, content FROM c WHERE language = 'json' AND json_valid(content) AND json_type(content) = 'OBJECT'), k AS (SELECT chunk_key, content, unnest(json_keys(content)) AS name FROM j),"
    f" v AS (SELECT chunk_key, name, json_extract(content, '$.\"' || name || '\"') AS v FROM k) SELECT DISTINCT chunk_key, name, {_JSON_KINDS} AS value_type FROM v"
)
def json_pieces(spark, root):
    """The pieces of each chunk that is a JSON object, by key, with the kinds of their values; a key that comes twice counts once."""
    cut = F.when(F.col("language") == "json", parsers.structured(F.when(F.col("language") == "json", F.col("content")), F.lit("json"), F.lit(".json")))
    found = F.transform(F.filter(cut, lambda p: p["kind"] == "json_key"), lambda p: F.struct(p["name"], p["extra"]["value_type"].alias("value_type")))
    return made_of_chunks(spark, root, found=found).select("chunk_key", F.explode("found").alias("p")).select("chunk_key", "p.name", "p.value_type")
