"""Natural language inside source files (problem 3).

Comments and string literals are cut out by the delimiters of a language's family,
those of a language without one by the delimiters that most languages use; a line counts
as prose if it has enough words and is no code, query, path, directive or data. Its
language is told by n-gram profiles: the n-grams of a line are ranked by
frequency and compared with the ranked profile of each language in its script by the sum
of rank differences. A line that fits none well enough is rejected, and so is one that
fits a language best that isn't wanted. Chinese and Japanese, which have no spaces, are told by
their letters. Adjacent comment lines are merged where a line alone is undecided.
Profiles are made from the texts in ``samples`` and hold the n-grams without accents as well.

The work is narrow up to the distinct rows; the file types are joined to these.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.folding import unescape
from quillstone.llm.samples import OTHERS, WANTED
from quillstone.llm.sourcecode import DIRECTIVE, language_of, looks_like_code, pieces

LEAST_WORDS = 5
LEAST_WIDE = 8
#: N-grams of a profile, and of a line at most.
PROFILE, OWN = 2000, 400
#: Characters of an n-gram at most; words of up to so many letters are n-grams as a whole.
GRAM, WORD = 5, 5
#: Mean rank difference, as a share of the greatest one, beyond which a line fits no language.
REJECT = {"latin": 0.8, "cyrillic": 0.9, "devanagari": 0.9}
#: Lead over the next language, as such a share, below which the number of common words decides, and neighbouring lines where that is equal.
LEAD = 0.015
#: Place in a profile up to which a whole word counts as common; prose has some common words, lists of names have none.
COMMON = 1200
SCRIPTS = {"latin": ("en", "fr", "de", "es", "pt", "nl", "it", "sv", "pl", "ca"), "cyrillic": ("ru", "uk", "bg"), "devanagari": ("hi", "mr")}
_SPLIT = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SQL = re.compile(r"(?i)^\s*(?:select\b.*\bfrom\b|insert\s+into\b|update\s+\w+\s+set\b|delete\s+from\b|create\s+(?:table|index|view|or replace)\b|drop\s+table\b|alter\s+table\b|with\s+\w+\s+as\s*\(|merge\s+into\b|grant\s+\w+|explain\b)")
_TOKEN = re.compile(r"\S+")
_NAMED = re.compile(r"^\s*(?:[@\\]\w+(?:\s*\{[^}]*\})?(?:\s+[*&$]?[\w.\[\]]+)?|:\w+(?:\s+[\w.,|\[\] ]+?)?:|[*$&]{0,2}[\w.]+\s*(?:\([^)]*\))?\s*:)\s+(?:[-–—]\s+)?(?=\S)")
_MARK = re.compile(r"^\s*(?:/{2,}!?|/\*+!?|\*+/?|#+!?|-{2,}|;+|%+|=begin|=end|<!--|\"\"\"|''')?\s?")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
#: Words in each script.
_LETTERS = {"latin": _SPLIT, "cyrillic": re.compile(r"[Ѐ-ӿ]+"), "devanagari": re.compile(r"[ऀ-ॣॱ-ॿ]+")}


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower().replace("ß", "ss").replace("’", "'")
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def grams(words: list[str]) -> Counter:
    """The n-grams of words, with a blank at both ends, and the short words as a whole."""
    found: Counter = Counter()
    for w in words:
        w = f" {w} "
        n = len(w)
        for k in range(1, min(n, GRAM) + 1):
            found.update([w[i : i + k] for i in range(n - k + 1)])
        if GRAM < n <= WORD + 2:
            found[w] += 1
    found.pop(" ", None)
    return found


def ranked(counts: Counter, most: int) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], -len(g), g))[:most]


#: Texts of the wanted languages that are also written without their accents.
SAMPLES = {lang: WANTED[lang] for lang in SCRIPTS["latin"] if lang in WANTED}


@lru_cache(1)
def profiles() -> dict[str, tuple[dict[str, int], np.ndarray, list[set[str]]]]:
    """For each script: the number of each n-gram of its languages, a row of places in their profiles for each number, and their common words."""
    made = {}
    for script, langs in SCRIPTS.items():
        numbers: dict[str, int] = {}
        places, common = [], []
        for lang in langs:
            text = {**WANTED, **OTHERS}[lang]
            counts: Counter = Counter()
            for variant in {text.lower(), plain(text)} if script == "latin" else {text.lower()}:
                counts += grams(_LETTERS[script].findall(variant.replace("’", "'")))
            order = ranked(counts, PROFILE)
            places.append({numbers.setdefault(g, len(numbers)): r for r, g in enumerate(order)})
            common.append({g.strip() for g in order[:COMMON] if g.startswith(" ") and g.endswith(" ")})
        rows = np.full((len(numbers) + 1, len(langs)), np.inf)
        for j, of in enumerate(places):
            for number, r in of.items():
                rows[number, j] = r
        made[script] = numbers, rows, common
    return made


def classify(words: list[str], script: str = "latin") -> tuple[str | None, int]:
    """The language whose profile is nearest by rank distance, and its lead over as near ones in common words (1 if there are none); nothing if none is near or the nearest isn't wanted."""
    numbers, rows, common = profiles()[script]
    words = [w.lower() for w in words]
    mine = ranked(grams(words), OWN)
    if not mine:
        return None, 0
    n = len(mine)
    at = np.fromiter((numbers.get(g, len(numbers)) for g in mine), np.int64, n)
    far = np.abs(np.arange(n)[:, None] * (PROFILE / n) - rows[at])
    scores = np.minimum(far, PROFILE).sum(axis=0) / (n * PROFILE)
    known = [sum(w in c or w.split("'")[0] in c for w in words) for c in common]
    near = np.nonzero(scores <= scores.min() + LEAD)[0]
    best = max(near, key=lambda j: (known[j], -scores[j]))
    lang = SCRIPTS[script][best]
    if scores[best] > REJECT[script] or lang not in WANTED or script == "latin" and known[best] < max(1, 0.1 * len(words)):
        return None, 0
    return lang, min((known[best] - known[j] for j in near if j != best), default=1)


def prose_words(line: str) -> list[str]:
    """The words of a line that are words of a language: no names of code, paths, numbers or escapes."""
    found = []
    for t in _TOKEN.findall(line):
        core = t.strip("\"'`“”‘’«»()[]{}<>.,;:!?¿¡…*_-–—")
        if not core or "_" in core or "/" in core or "\\" in core or "=" in core or "(" in core or "://" in core or "@" in core or any(c.isdigit() for c in core):
            continue
        if "." in core[:-1] and not re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]?", core) or re.search(r"[a-zß-ÿ][A-Z]", core):
            continue
        found += [w for w in _SPLIT.findall(core)]
    return found


def line_language(line: str) -> str | None:
    """The language of one line if it is prose: None for anything else, '?' if it is prose but undecided."""
    body = _NAMED.sub("", line, count=1)
    s = body.strip()
    if len(s) < 8 or DIRECTIVE.match(line.strip()) or _SQL.match(s):
        return None
    if not s.isascii():
        kana, han = len(_KANA.findall(s)), len(_HAN.findall(s))
        if kana + han >= LEAST_WIDE:
            return "ja" if kana >= 2 else "zh"
        for script in ("cyrillic", "devanagari"):
            if len(words := _LETTERS[script].findall(s)) >= LEAST_WORDS:
                return classify(words, script)[0]
    words = prose_words(s)
    if len(words) < LEAST_WORDS or looks_like_code(s):
        return None
    tokens = len(_TOKEN.findall(s))
    if tokens < LEAST_WORDS or len(words) < 0.5 * tokens or max(map(len, words)) < 4:
        return None
    lang, lead = classify(words)
    return lang if lang and lead > 0 else "?" if lang else None


_ENCLOSED = re.compile(r"\A(?:\{-|\(\*|<!--)|(?:-\}|\*\)|-->)\Z")


def texts(content: str, lang: str | None) -> Iterator[list[str]]:
    """The comments and literals of a piece of code, each as its lines; adjacent comment lines come together."""
    lang = lang or "any"
    start = 0
    if lang not in ("any", "python", "shell", "ruby", "r", "perl", "sql", "lua"):
        # a chunk may begin inside a block comment
        end, begin = content.find("*/"), content.find("/*")
        if 0 <= end and (begin < 0 or end < begin):
            yield content[:end].split("\n")
            start = end + 2
    elif lang == "python":
        for q in ('"""', "'''"):
            if content.count(q) % 2:
                at = content.find(q)
                line = content[content.rfind("\n", 0, at) + 1 : at]
                after = content[at + 3 : content.find("\n", at) if content.find("\n", at) >= 0 else len(content)]
                if at > 0 and not after.strip() and (line.strip() and not re.search(r"[=(:,]\s*[rbfuRBFU]{0,2}$", line) or not line.strip() and at != len(line)):
                    yield content[:at].split("\n")
                    start = at + 3
                break
    body = content[start:] if start else content
    block: list[str] = []
    last = -2
    for p in pieces(body, lang):
        piece = body[p.start : p.end]
        if p.comment:
            gap = body[last : p.start] if last >= 0 else None
            if block and (gap is None or gap.strip() or gap.count("\n") > 1):
                yield block
                block = []
            block += (_ENCLOSED.sub("", piece) if lang == "any" else piece).split("\n")
            last = p.end
            continue
        if block:
            yield block
            block = []
        last = -2
        inner = re.sub(r"^[rbfuRBFU]{0,2}(\"\"\"|'''|[\"'`])", "", piece, count=1)
        if len(inner) >= 8:
            yield (unescape(inner.rstrip("\"'`")) if "\\" in inner or "&" in inner else inner.rstrip("\"'`")).split("\n")
    if block:
        yield block


def prose_lines(content: str | None, docstring: str | None, lang: str | None, cache: dict[str, str | None]) -> Iterator[tuple[str, str]]:
    """(language, line) of each line of prose. cache: languages by line, emptied when it is large."""
    parts = list(texts(content, lang)) if content else []
    if docstring and docstring.strip():
        parts.append((unescape(docstring) if "\\" in docstring else docstring).split("\n"))
    for part in parts:
        told: list[tuple[str | None, str]] = []
        for raw in part:
            line = _MARK.sub("", raw, count=1).rstrip("*/ \r")
            if len(line) < 8:
                continue
            if line in cache:
                found = cache[line]
            else:
                if len(cache) > 100_000:
                    cache.clear()
                found = cache[line] = line_language(line)
            told.append((found, line))
        for k, (found, line) in enumerate(told):
            if found == "?":  # its neighbours may tell
                near = [f for f, _ in told[max(0, k - 1) : k + 2] if f and f != "?"]
                found = near[0] if near else classify(prose_words(" ".join(x for f, x in told if f == "?")))[0]
            if found:
                yield found, line


def _chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that may belong to code or script files; a chunk's own type can be missing but names no other."""
    own = F.coalesce(F.col("file_type"), F.lit(""))
    return chunks.where(own.isin("code", "script", "") & F.col("chunk_key").isNotNull() & F.col("file_id").isNotNull()).select(
        F.col("chunk_key").cast("long").alias("chunk_key"), F.col("file_id").cast("long").alias("file_id"), "content", "docstring", "language", F.regexp_extract("source_file", r"\.[A-Za-z0-9]+$", 0).alias("ext")
    )


def _in_code_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    code = files.where(F.col("file_type").isin("code", "script")).select(F.col("file_id").cast("long").alias("file_id")).distinct()
    return rows.join(code, "file_id", "left_semi")


def languages(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_key, lang): each language in which a chunk of a code or script file holds prose.

    Languages are en, fr, de, es, pt, ru, zh, ja and hi. Null and empty contents
    and docstrings hold none; chunks without a key or of an unknown file give no
    row. Repeated rows count once. Extra columns are ignored. Empty tables give an
    empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str | None] = {}
        for batch in batches:
            rows = set()
            for key, file, content, doc, language, ext in zip(*(c.to_pylist() for c in batch.columns)):
                rows |= {(key, file, found) for found, _ in prose_lines(content, doc, language_of(language, ext), cache)}
            if rows:
                k, f, lang = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(f, pa.int64()), pa.array(lang)], ["chunk_key", "file_id", "lang"])

    rows = _chunks(chunks).mapInArrow(run, "chunk_key long, file_id long, lang string")
    return _in_code_files(rows, files).select("chunk_key", "lang").distinct()


def shares(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, lang, chars, share): the characters of prose in each language of a file, and their share of its prose.

    A line that stands in several chunks of a file, as overlapping chunks have it,
    counts once. Files without prose give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str | None] = {}
        for batch in batches:
            rows = []
            for _, file, content, doc, language, ext in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(file, found, line.strip()) for found, line in prose_lines(content, doc, language_of(language, ext), cache)]
            if rows:
                f, lang, line = zip(*set(rows))
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(lang), pa.array(line)], ["file_id", "lang", "line"])

    lines = _chunks(chunks).mapInArrow(run, "file_id long, lang string, line string")
    once = _in_code_files(lines.select("file_id", "lang", F.xxhash64("line").alias("line"), F.length("line").alias("n")), files).distinct()
    per = once.groupBy("file_id", "lang").agg(F.sum("n").alias("chars"))
    total = per.groupBy("file_id").agg(F.sum("chars").alias("total"))
    return per.join(total, "file_id").select("file_id", "lang", "chars", F.round(F.col("chars") / F.col("total"), 4).alias("share"))
