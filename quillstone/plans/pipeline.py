"""The enrichment of chunks as one plan: clean, entities, segments, tags, vectors, languages; any step can be left out.

The steps are one lineage. Only the vectors need a pass of their own, for the
vocabulary of the whole corpus; the tokens are written to the shared folder for it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import languages, scoring, text
from quillstone.functions.arrow import arrow
from quillstone.operators import entities, segments, vectors
from quillstone.plans.shared import written

STEPS = ("clean", "ner", "chunk", "tag", "embed", "multilingual")


def _text() -> Column:
    return text.first_text(F.col("cleaned_text"), F.col("content"))


def _fixed(df: DataFrame, name: str, made: Column) -> DataFrame:
    """The rows with a column that is computed once, however often it is used later.

    A generator of one row keeps the optimizer from putting the expression into
    each of its uses.
    """
    return df.drop(name).select("*", F.explode(F.array(made)).alias(name))


def clean(df: DataFrame) -> DataFrame:
    df = _fixed(df, "cleaned_text", text.cleaned(F.col("content"), F.col("chunk_type"), F.col("language")))
    df = _fixed(df, "tokens", text.tokens(F.col("cleaned_text")))
    return df.withColumn("normalized_lang", text.language_name(F.col("language"))).withColumn("token_count", F.size("tokens"))


def ner(df: DataFrame) -> DataFrame:
    return df.withColumn("entities", entities.entities_with_places(_text()))


def chunk(df: DataFrame, similarity: bool = False) -> DataFrame:
    """Segments; with ``similarity`` documents without headings are cut where neighbouring sentences differ, not at blank lines."""
    kind = segments.strategy(F.col("chunk_type"))
    if similarity:
        alike = F.when(kind == "doc", segments.neighbour_similarities(segments.sentences(_text())))
        made = segments.alike_segments(_text(), kind, F.col("chunk_id"), alike)
    else:
        made = segments.segments(_text(), kind, F.col("chunk_id"))
    df = df.withColumn("semantic_segments", made)
    return df.withColumn("segment_count", F.size("semantic_segments"))


def tag(df: DataFrame) -> DataFrame:
    t = _text()
    return df.withColumns(
        {
            "tags": scoring.tags(t),
            "complexity_score": F.coalesce(scoring.complexity(t, F.coalesce("token_count", F.lit(0))), F.lit(0.0)),
            "has_docstring": scoring.has_documentation(t, F.col("docstring")),
            "has_tests": scoring.has_tests(t),
            "has_todos": scoring.has_todos(t),
            "api_surface": scoring.public_names(t),
        }
    )


def embed(df: DataFrame, dimension: int = 256) -> DataFrame:
    """Term vectors over the corpus's most frequent terms; an empty vector for a chunk without any of them.

    The vocabulary, of ``dimension`` terms at most, is fitted on all chunks in a
    pass of its own and travels to the tasks; the vectors are made where the rows are.
    """
    words = written(df.select("tokens"), "tokens")
    vocabulary = [(r.term, r.idf) for r in vectors.terms(words, "tokens", dimension).orderBy("term").collect()]
    out = df.withColumn("embedding", vectors.term_embedding(vocabulary)(F.col("tokens")))
    return out.withColumn("embedding_dim", F.size("embedding")).withColumn("embedding_model", F.lit("tfidf"))


#: Rows that an embedding function gets at once.
EMBED_ROWS = 64


def choose_backend(wanted: str, known: dict[str, Callable[[list[str]], list[list[float]]]], order: tuple[str, ...] = ("sentence_transformers", "openai", "cohere", "huggingface")) -> str:
    """The name of the embedding function to take: the wanted one, or with ``auto`` the first of the order that is known; ``tfidf`` where there is none."""
    names = [n for n in order if n in known] if wanted == "auto" else [wanted] if wanted in known else []
    return names[0] if names else "tfidf"


def embed_with(df: DataFrame, name: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors by a given function from texts to vectors, which gets ``EMBED_ROWS`` texts at once in the tasks; rows of a call that fails get empty vectors."""

    @arrow("array<float>")
    def vectors_of(texts: pd.Series) -> pd.Series:
        made: list[list[float]] = []
        for a in range(0, len(texts), EMBED_ROWS):
            part = [t or "" for t in texts[a : a + EMBED_ROWS]]
            try:
                got = [list(map(float, v)) for v in model(part)]
                made += got if len(got) == len(part) else [[] for _ in part]
            except Exception:  # noqa: BLE001 - whatever a foreign function raises, its rows go on without a vector
                made += [[] for _ in part]
        return pd.Series(made)

    named = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("name", "docstring")]
    out = _fixed(df, "embedding", vectors_of(text.embedding_text(*named, _text())))
    return out.withColumn("embedding_dim", F.size("embedding")).withColumn("embedding_model", F.lit(name))


def multilingual(df: DataFrame, translate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The language by script; with a translation function, the translation of what passes the gate."""
    found = languages.script_language(languages.detection_text(F.col("docstring"), _text()))
    df = df.withColumn("__l", found).withColumns({"detected_lang": F.col("__l.lang"), "detected_lang_conf": F.col("__l.conf")}).drop("__l")
    made = F.lit(None).cast("string")
    if translate is not None:
        gate = languages.translate_gate(F.col("detected_lang"), F.col("detected_lang_conf"), F.col("chunk_type"))
        made = F.when(gate, translate(F.substring(_text(), 1, 5000), F.col("detected_lang")))
    df = df.withColumn("translated_text", F.when(F.trim(made) != F.trim(_text()), made))
    return df.withColumn("is_translated", F.col("translated_text").isNotNull())


def enrich(
    chunks: DataFrame,
    skip: tuple[str, ...] = (),
    translate: Callable[[Column, Column], Column] | None = None,
    backend: str = "auto",
    models: dict[str, Callable[[list[str]], list[list[float]]]] | None = None,
    similarity: bool = False,
) -> DataFrame:
    """The chunks with the columns of all steps but the skipped ones.

    Columns of the same names in the input are replaced; every row comes out, repeated ones
    too. A step that needs the columns of a skipped one takes what the input has.
    ``models`` are embedding functions by name, of which ``backend`` chooses one; without one the vectors are term vectors.
    """
    if unknown := set(skip) - set(STEPS):
        raise ValueError(f"no such step: {', '.join(sorted(unknown))}")
    df = chunks
    for name, kind in (("cleaned_text", "string"), ("tokens", "array<string>"), ("token_count", "int")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    chosen = choose_backend(backend, models or {})

    def embedded(d: DataFrame) -> DataFrame:
        return embed(d) if chosen == "tfidf" else embed_with(d, chosen, (models or {})[chosen])

    steps: dict[str, Callable[[DataFrame], DataFrame]] = {"clean": clean, "ner": ner, "chunk": lambda d: chunk(d, similarity), "tag": tag, "embed": embedded, "multilingual": lambda d: multilingual(d, translate)}
    for name in STEPS:
        if name not in skip:
            df = steps[name](df)
    return df
