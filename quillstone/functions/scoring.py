"""Column expressions that tag and score chunks of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.rules import BRANCH_FORM, COMPLEXITY_COLOURS, DOC_FORM, PUBLIC_FORM, TAGS, TEST_FORM, TODO_FORM

STOP_WORDS = (
    "the a an is it in on at to for of and or but with this that are was were be been have has had do does did will would could should may might i you he she we they"
    " what how when where which who not from by as if then so its their"
).split()  # fixed values: words without a topic of their own


def tag_pattern(tag: str) -> str:
    """A tag's keywords as alternatives; they match inside words, too."""
    return "(?i)" + "|".join(re.sub(r"([.(])", r"\\\1", k) for k in TAGS[tag])


def tags(text: Column, least: int = 1) -> Column:
    """The sorted topic tags of which at least so many keywords occur; none for null."""
    if least > 1:
        marks = [F.when(F.regexp_count(text, F.lit(tag_pattern(t))) >= least, F.lit(t)) for t in sorted(TAGS)]
        return F.array_compact(F.array(*marks))
    # one array of rules rather than an expression for each keyword: the generated code stays small enough to be compiled
    rules = F.array(*[F.struct(F.lit(t).alias("tag"), F.array(*map(F.lit, TAGS[t])).alias("words")) for t in sorted(TAGS)])
    hits = F.transform(F.array(F.lower(text)), lambda low: F.filter(rules, lambda r: F.exists(r["words"], lambda w: low.contains(w))))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.transform(hits[0], lambda r: r["tag"]))


def has_documentation(text: Column, docstring: Column) -> Column:
    return F.coalesce(text.rlike(DOC_FORM), F.lit(False)) | (F.coalesce(docstring, F.lit("")) != "")


def has_tests(text: Column) -> Column:
    return F.coalesce(text.rlike(TEST_FORM), F.lit(False))


def has_todos(text: Column) -> Column:
    return F.coalesce(text.rlike(TODO_FORM), F.lit(False))


def public_names(text: Column) -> Column:
    """The sorted distinct names of public definitions; none for null."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PUBLIC_FORM), F.lit(1))))
    return F.coalesce(found, F.array().cast("array<string>"))


def depth(text: Column) -> Column:
    """The deepest indentation of a line that isn't blank, in steps of four blanks or in single characters."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: F.trim(F.translate(x, "\t\r", "  ")) != "")
    steps = F.transform(kept, lambda x: F.when(F.contains(x, F.lit("    ")), F.floor(_indent(x) / 4)).otherwise(_indent(x)))
    return F.coalesce(F.array_max(steps), F.lit(0)).cast("int")


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^[ \t\r\x0b\x0c]+", ""))


def complexity(text: Column, token_count: Column) -> Column:
    """A number from 0 to 1 for branches, nesting and length, to three places; 0 for an empty text."""
    branches = F.regexp_count(text, F.lit(BRANCH_FORM))
    volume = F.log1p(token_count.cast("double")) / F.log1p(F.lit(2000.0))
    raw = branches * 0.05 + depth(text) * 0.05 + volume * 0.5
    return F.round(F.least(raw, F.lit(1.0)), 3)


def band(score: Column) -> Column:
    """Bands of a fifth each, open below: 0 lies in none."""
    names = ["Trivial", "Simple", "Moderate", "Complex", "Very Complex"]
    out = F.when(score <= 0, F.lit(None).cast("string"))
    for k, name in enumerate(names, 1):
        out = out.when(score <= k / 5, F.lit(name))
    return out


def colour(score: Column) -> Column:
    """The colour of a complexity score; null for null."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, name in COMPLEXITY_COLOURS[:-1]:
        out = out.when(score < bound, F.lit(name))
    return out.otherwise(F.lit(COMPLEXITY_COLOURS[-1][1]))


def word_set(text: Column) -> Column:
    """The distinct words, in lower case, of more than two characters that aren't stop words; none for null."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][\p{L}\p{N}_]*"), F.lit(0)), F.lower)
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def overlap(answer: Column, context: Column) -> Column:
    """The share of an answer's words that its context has; 0 for an answer without words."""
    a, c = word_set(answer), word_set(context)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, c)) / F.size(a)).otherwise(F.lit(0.0))


def grounded(answer: Column, context: Column, most: int = 120) -> Column:
    """Of the first words of an answer, in order, whether the context has each: array<struct<text, matched>>."""
    known = word_set(context)
    parts = F.filter(F.split(answer, r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+"), lambda w: w != "")
    shown = F.slice(parts, 1, most)
    return F.transform(shown, lambda w: F.struct(w.alias("text"), F.array_contains(known, F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))).alias("matched")))


def query_tokens(text: Column) -> Column:
    """The parts of a query between white space, in order, with kind (stop, word, num, punct) and place from 0."""
    gaps = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    ends = F.transform(gaps, lambda g, i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)))

    def part(gap: Column, end: Column) -> Column:
        w = F.regexp_replace(gap, r"^\s+", "")
        named = F.when(F.lower(w).isin(*STOP_WORDS), "stop").otherwise("word")
        kind = F.when(w.rlike(r"^[A-Za-z_][\p{L}\p{N}_]*$"), named).when(w.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), "num").otherwise("punct")
        return F.struct(w.alias("text"), kind.alias("kind"), (end - F.length(w)).alias("pos"))

    return F.zip_with(gaps, ends, part)
