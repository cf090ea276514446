"""Column expressions for cleaning and cutting text. A null text gives null unless said otherwise."""

from __future__ import annotations

import textwrap
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.arrow import arrow
from quillstone.functions.rules import COMMENTS, DOC_CHUNKS, LANGUAGE_NAMES

#: White space other than line feeds, as a regular-expression class that reads alike in every engine.
BLANKS = r"\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Letters, digits and underscores of any script.
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[A-Za-z_][{WORD}]*|[0-9]+(?:\.[0-9]+)?|[^{WORD}\n{BLANKS}]"
ANSI = r"\x1b\[[0-9;]*[mGKHF]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Typographic characters and what stands for them.
FOLDED = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


def strip(c: Column) -> Column:
    """Without white space, line feeds included, at both ends."""
    return F.regexp_replace(c, rf"\A[\n{BLANKS}]+|[\n{BLANKS}]+\z", "")


def without_controls(c: Column) -> Column:
    """Without terminal colours, NULs and control characters; tabs, line feeds and carriage returns stay."""
    return F.regexp_replace(F.regexp_replace(c, ANSI, ""), CONTROLS, "")


@arrow("string")
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(c: Column) -> Column:
    """NFC. Only texts with other than ASCII characters travel to Python."""
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def folded(c: Column) -> Column:
    """NFC, with typographic quotes, dashes and ellipses in ASCII."""
    single = {k: v for k, v in FOLDED.items() if len(v) == 1}
    return F.replace(F.translate(composed(c), "".join(single), "".join(single.values())), F.lit("…"), F.lit("..."))


@arrow("string")
def _dedented(texts: pd.Series) -> pd.Series:
    return texts.map(textwrap.dedent, na_action="ignore")


def dedented(c: Column) -> Column:
    """Without the white space that all lines begin with; blank lines become empty. Only texts that begin with white space or hold blank lines of it travel to Python."""
    return F.coalesce(_dedented(F.when(c.rlike(r"(?m)^[ \t]"), c)), c)


def collapsed(c: Column) -> Column:
    """Runs of blanks become one, three or more line feeds two; the ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, rf"[{BLANKS}]+", " "), r"\n{3,}", "\n\n"))


def without_comments(c: Column, language: Column) -> Column:
    """Each comment form of the language replaced by a blank, in the fixed order; string literals aren't respected."""
    out = c
    for forms in sorted(set(COMMENTS.values())):
        changed = c
        for form in forms:
            changed = F.regexp_replace(changed, form, " ")
        out = F.when(language.isin(*[k for k, v in COMMENTS.items() if v == forms]), changed).otherwise(out)
    return out


def cleaned(c: Column, chunk_type: Column, language: Column | None = None, comments: bool = True) -> Column:
    """The cleaning step: controls, composition, indentation (of other than document chunks), comments if wanted, blanks."""
    text = folded(without_controls(c))
    is_doc = F.coalesce(chunk_type.isin(*DOC_CHUNKS), F.lit(False))
    text = F.when(is_doc, text).otherwise(dedented(F.when(~is_doc, text)))
    if not comments and language is not None:
        text = F.when(is_doc, text).otherwise(without_comments(text, language_name(language)))
    return collapsed(text)


def tokens(c: Column) -> Column:
    """Identifiers, numbers and single marks in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def language_name(c: Column) -> Column:
    """The usual name of a language, by its name or extension; null for null and empty."""
    plain = F.ltrim(F.lower(c), F.lit("."))
    names = F.create_map(*[F.lit(x) for pair in sorted(LANGUAGE_NAMES.items()) for x in pair])
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(F.try_element_at(names, plain), plain))


def chunk_id(path: Column, kind: str | Column, name: Column, counter: Column) -> Column:
    """``stem__kind__name__counter``, with stem and name of at most 25 characters each."""

    def safe(c: Column) -> Column:
        return F.substring(F.regexp_replace(c, rf"[^{WORD}]", "_"), 1, 25)

    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws("__", safe(stem(path)), kind, safe(name), counter.cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def line_of(text: Column, place: Column) -> Column:
    """The number of the line, from 1, on which the character at ``place`` (from 0) stands."""
    return F.regexp_count(F.substring(text, F.lit(1), place), F.lit("\n")) + 1


def preview(c: Column, most: int) -> Column:
    """At most so many characters, with dots if there were more."""
    return F.concat(F.substring(c, 1, most), F.when(F.length(c) > most, "...").otherwise(""))


def first_text(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def embedding_text(name: Column, docstring: Column, text: Column) -> Column:
    """Name, the first 300 characters of the documentation and the text, without what is missing, up to 2,000 characters."""
    parts = [F.nullif(name, F.lit("")), F.substring(F.nullif(docstring, F.lit("")), 1, 300), F.nullif(text, F.lit(""))]
    return F.substring(F.concat_ws(" \n", *parts), 1, 2000)


def truth(c: Column) -> Column:
    """Whether a value of any type spells yes."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def number(c: Column) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def literal_list(c: Column) -> Column:
    """A list that was written with Python's quotes; an empty one if it can't be read."""
    return F.coalesce(F.from_json(F.translate(c, "'", '"'), "array<string>"), F.array().cast("array<string>"))
