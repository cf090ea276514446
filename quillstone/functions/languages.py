"""Column expressions that tell a text's language by its script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.rules import QUERY_LANGUAGES, QUERY_SCRIPTS, SCRIPTS

#: Kinds of chunks that may be translated.
TRANSLATED = "doc_section doc_paragraph html_text notebook_markdown_cell shell_comment markdown rst text".split()


def detection_text(docstring: Column, text: Column) -> Column:
    """Documentation and text, stripped, up to 2,000 characters."""
    return F.substring(F.trim(F.concat(F.coalesce(docstring, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))), 1, 2000)


def script_language(text: Column, least: int = 20) -> Column:
    """struct<lang, conf>: the script with most letters, by name where counts are equal.

    Texts below ``least`` characters, and null, count as English with certainty 1;
    texts without letters of a known script as English with 0.5.
    """
    # the letters other than ASCII, taken out once: for most texts nothing is left to search
    rest = F.array(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    scripts = list(enumerate(sorted(SCRIPTS.items())))
    top = F.transform(rest, lambda r: F.array_max(F.array(*[F.struct(F.regexp_count(r, F.lit(form)).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, form) in scripts])))[0]
    conf = F.round(F.least(top["n"] / F.greatest(F.length(text), F.lit(1)) * 5, F.lit(0.95)), 3)
    short = F.coalesce(F.length(text) < least, F.lit(True))
    lang = F.when(short | (top["n"] == 0), "en").otherwise(top["lang"])
    return F.struct(lang.alias("lang"), F.when(short, 1.0).when(top["n"] == 0, 0.5).otherwise(conf).alias("conf"))


def translate_gate(lang: Column, conf: Column, chunk_type: Column, least: float = 0.6, skip_code: bool = True, only: list[str] | None = None) -> Column:
    """Whether a chunk is to be translated."""
    gate = (lang != "en") & (conf >= least)
    if skip_code:
        gate &= chunk_type.isin(*TRANSLATED)
    if only is not None:
        gate &= lang.isin(*only)
    return F.coalesce(gate, F.lit(False))


def query_language(text: Column) -> Column:
    """struct<lang, name, conf>: the script of a query with most letters, of equal counts the one that comes first, and its name.

    A blank text, and null, counts as English with certainty 1; one without letters of
    a known script as English with 0.5. A language without a name has its code in upper case.
    """
    body = F.trim(F.translate(text, "\n\r\t", "   "))
    rest = F.array(F.regexp_replace(body, r"[\x00-\x7F]+", ""))
    scripts = sorted(QUERY_SCRIPTS.items())
    top = F.transform(rest, lambda r: F.array_max(F.array(*[F.struct(F.regexp_count(r, F.lit(form)).alias("n"), (-F.regexp_instr(r, F.lit(form))).alias("first"), F.lit(lang).alias("lang")) for lang, form in scripts])))[0]
    blank = F.coalesce(body == "", F.lit(True))
    lang = F.when(blank | (top["n"] == 0), "en").otherwise(top["lang"])
    conf = F.when(blank, 1.0).when(top["n"] == 0, 0.5).otherwise(F.round(F.least(top["n"] / F.greatest(F.length(body), F.lit(1)) * 5, F.lit(0.95)), 3))
    return F.struct(lang.alias("lang"), language_title(lang).alias("name"), conf.alias("conf"))


def language_title(lang: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in sorted(QUERY_LANGUAGES.items()) for x in pair])
    return F.coalesce(F.try_element_at(names, lang), F.upper(lang))
