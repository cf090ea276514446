"""Files that nobody of a project wrote by hand (problem 5).

Machine-made files are told by a random forest over figures of their text:
compression ratio, entropy of the words, lengths of identifiers, density of
comments and literals, and the shape of the lines. Its labels are header notices:
those of generators and bundlers for machine-made files, those of the project's
own team for hand-written ones. The notices are cut off before the figures are
taken, and only the votes over the figures tell such files: a notice alone makes none.

Copies of third-party files look as if written by hand, so that no figure tells them;
they are a second stage. A body that stands in several projects, or that has a third
party's notice in any copy, is a third party's in all of them, and so is what
lies in the folder of a library that such a notice names. Data saved as code is told
by a rule over the same figures.

The figures are taken in one pass over the files and written to the shared
folder; all that follows works on a few numbers a file.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.sourcecode import BY_EXTENSION, decode, language_of, pieces
from quillstone.plans.shared import written

#: Labelled rows of each class that the forest is fitted on, at most.
FIT_ROWS = 4000
TREES, DEPTH, SEED = 40, 6, 17
#: Share of the trees' votes from which a file counts as machine-made.
VOTES = 0.5
#: Characters without white space from which on equal bodies in several projects are copies and no coincidence. With a third party's notice any body counts.
COPY_CHARS = 200

GENERATED = re.compile(
    r"(?i)(?:^|\W)(?:@generated\b|<auto-?generated|(?:auto(?:matically)?|code|file|source)?[ -]?generated (?:by|from|with|using|automatically|on)\b|autogenerated|auto-generated|this (?:file|code|class) (?:was|is|has been) (?:written|created|generated|produced|emitted|built) (?:automatically|by (?:a|the) \w+)"
    r"|written automatically|generated (?:file|code|source)\b.*\b(?:do not|don't|edit)|(?:do not|don't|never) (?:edit|modify|change)(?: (?:this|it|by hand|manually|directly))?\b.*(?:generat|hand|manual|file)|do not edit\b|changes (?:to this file )?will be (?:lost|overwritten)"
    r"|produced by (?:the )?[\w\-]+ (?:compiler|generator|tool|version)|output of (?:the |a )?(?:build|[\w\-]+ (?:compiler|generator))|regenerate (?:it|this|with)|edit [\w./\-]+ instead|automatisch (?:erzeugt|generiert|erstellt)|(?:fichier|code) (?:produit|généré|genere)|généré automatiquement|ne (?:rien|pas) modifier"
    r"|generado (?:autom|por|con)|archivo generado|no (?:editar|modificar)|gerado (?:autom|por|com)|não (?:editar|modificar)|сгенерирован|создано автоматически|не (?:редактировать|изменять)|自動生成|自动生成|请勿(?:手动)?(?:修改|编辑)|編集しないで|स्वतः (?:निर्मित|जनित))"
)
THIRD = re.compile(
    r"(?i)(?:copyright\b.*\b(?:contributors|authors|developers|foundation|project|inc\b|ltd|gmbh|llc|maintainers)|(?:contributors|authors|maintainers), all rights|part of the [\w.\-]+(?: [\w.\-]+)? (?:library|project|package|framework|toolkit)\b|distributed under|licensed under|released under|spdx-license-identifier|(?:mit|apache|bsd|mpl|gnu|lgpl|gpl|isc)[\w .,\-]* licen[sc]e"
    r"|permission is hereby granted|redistribution and use|see https?://\S+ for the original|vendored (?:from|copy)|copied from|downloaded from|upstream:|original (?:source|author)|this is [\w.\-]+ version \d|third[- ]party)"
)
BANNER = re.compile(r"(?i)^/?\*!|^(?:/\*+|//|#|--)\s*!?\s*[\w.\-/@]+ v\d+\.\d+(?:\.\d+)?\b")
OWN = re.compile(r"(?i)\b(?:internal use only|intern(?:al)? (?:code|only)|confidential|proprietary|the [\w\-]+ team\b|property of)")
ABOUT_GENERATING = re.compile(r"(?i)(?:module|script|class|function|code|tool|helper) (?:that )?(?:writes|creates|emits|makes|produces|checks|reads|skips)|see the template|template below|files that carry")
_VENDOR = re.compile(r"(?:^|/)(?:vendor|vendors|vendored|node_modules|bower_components|third[-_]?party|3rdparty|external|externals|extern|deps)/((?:@[\w.\-]+/)?[\w.\-]+)/")
_COMMENT_LINE = re.compile(r"^\s*(?://|/?\*|#(?!include|define|if|pragma)|--(?!-*\s*$)|;|<!--|\"\"\"|''')")
_WORD = re.compile(rb"(?<![0-9A-Za-z_$])[A-Za-z_$][A-Za-z0-9_$]*")
_ALNUM = bytes(c for c in range(256) if chr(c).isalnum() and c < 128) + b"_"
KEYWORDS = frozenset(b"if else elif for while return function def class switch case try catch except finally throw raise import from require include use const let var func fn fun pub match do begin end then fi done local break continue new this self".split())
FIGURES = ["compressed", "entropy", "name_length", "short_names", "distinct_names", "keywords", "comments", "literals", "line_length", "longest_line", "blank", "digits", "marks", "shapes", "long_lines"]


def notices(text: str) -> tuple[str, str]:
    """The leading comment lines of a file, and what is left."""
    lines = text.split("\n")
    at = 0
    head: list[str] = []
    block = False
    while at < len(lines):
        line = lines[at].strip()
        if block:
            head.append(line)
            block = "*/" not in line
        elif not line or line.startswith("<?php") or line.startswith("#!"):
            pass
        elif _COMMENT_LINE.match(line):
            if line.startswith("/*") and "*/" in line and not line.endswith("*/"):  # code behind a banner
                cut = line.index("*/") + 2
                head.append(line[:cut])
                lines[at] = line[cut:]
                break
            head.append(line)
            block = line.startswith("/*") and "*/" not in line
        else:
            break
        at += 1
    return "\n".join(head), "\n".join(lines[at:])


def notice_kind(head: str) -> str | None:
    """What the header of a file says about it: 'generated', 'third', 'banner', 'own' or nothing."""
    if not head:
        return None
    for line in head.split("\n"):
        if GENERATED.search(line) and not ABOUT_GENERATING.search(line):
            return "generated"
    if BANNER.search(head):
        return "banner"
    for line in head.split("\n"):
        if OWN.search(line):
            return "own"
        if THIRD.search(line):
            return "third"
    return None


def figures(body: str, lang: str | None) -> list[float]:
    """The figures of a text that the forest sees, in the order of FIGURES."""
    raw = body.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    names = _WORD.findall(raw)
    counts = Counter(names)
    total = max(len(names), 1)
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    k = max(len(filled), 1)
    shapes = {x.translate(None, _ALNUM) for x in filled}
    comment = literal = 0
    if lang:
        for p in pieces(body, lang):
            if p.comment:
                comment += p.end - p.start
            else:
                literal += p.end - p.start
    digits = sum(raw.count(d) for d in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))
    space = raw.count(b" ") + raw.count(b"\n") + raw.count(b"\t") + raw.count(b"\r")
    letters = sum(map(len, names))
    long = sum(len(x) for x in filled if len(x) > 300)
    return [
        len(zlib.compress(raw, 1)) / n,
        entropy / math.log2(total + 1),
        letters / total,
        sum(c for w, c in counts.items() if len(w) <= 2) / total,
        len(counts) / total,
        sum(counts.get(w, 0) for w in KEYWORDS) / k,
        comment / max(len(body), 1),
        literal / max(len(body), 1),
        math.log1p(n / k),
        math.log1p(max(map(len, filled), default=0)),
        space / n,
        digits / n,
        max(0, n - letters - space - digits) / n,
        len(shapes) / k,
        long / n,
    ]


def data_like(f: dict[str, F.Column] | dict[str, float]) -> F.Column:
    """Data saved as code: hardly anything but literals and numbers, and hardly a keyword or comment."""
    return ((f["literals"] + f["digits"] + f["marks"]) > 0.62) & (f["keywords"] < 0.12) & (f["comments"] < 0.15) & ((f["digits"] > 0.12) | (f["literals"] > 0.5))


def measured(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(file_id, project, notice, library, body, chars, figures...): one row for each row of code and script files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 + len(FIGURES))]
            for k, project, path, language, ext, content in zip(*(c.to_pylist() for c in batch.columns)):
                text = decode(content or b"").replace("\r\n", "\n")
                head, body = notices(text)
                solid = re.sub(r"\s+", "", body)
                library = _VENDOR.search(path or "")
                first = re.search(r"(?i)part of the ([\w.\-]+) (?:library|project|package|framework|toolkit)|this is ([\w.\-]+) version|^/\*!\s*([\w.\-]+) v|copyright (?:\(c\) )?(?:the )?([\w.\-]+) (?:contributors|authors|maintainers)", head)
                named = next((g for g in first.groups() if g), None) if first else None
                row = [k, project, notice_kind(head), (library[1] if library else named or "").lower() or None, hashlib.blake2b(solid.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), len(solid), *figures(body, language_of(language, ext))]
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * len(FIGURES)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["file_id", "project", "notice", "library", "body", "chars", *FIGURES])

    source = files.where(F.col("file_type").isin("code", "script") & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("file_id"), "project", "path", "language", "ext", "content")
    schema = "file_id long, project string, notice string, library string, body string, chars int, " + ", ".join(f"{c} double" for c in FIGURES)
    return source.mapInArrow(run, schema)


def fitted(rows: DataFrame):
    """A forest fitted on a bounded sample of labelled rows, or None if no row of one of the classes has a label."""
    label = F.when(F.col("notice").isin("generated", "banner"), 1.0).when(F.col("notice") == "own", 0.0)
    labelled = rows.where(F.col("notice").isin("generated", "banner", "own")).withColumn("label", label)
    order = F.xxhash64("file_id")
    parts = [labelled.where(F.col("label") == y).orderBy(order, "file_id").limit(FIT_ROWS) for y in (0.0, 1.0)]
    sample = parts[0].unionByName(parts[1]).select("label", *FIGURES).coalesce(1)
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features", subsamplingRate=0.8)
    return forest.fit(VectorAssembler(inputCols=FIGURES, outputCol="features").transform(sample))


def scored(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(file_id, notice, votes, data, copied, foreign): what tells about the origin of each code or script file."""
    rows = written(measured(files, key), "origin")
    model = fitted(rows)
    if model is None:
        voted = rows.withColumn("votes", F.coalesce(F.col("notice").isin("generated", "banner"), F.lit(False)).cast("double"))
    else:
        voted = model.transform(VectorAssembler(inputCols=FIGURES, outputCol="features").transform(rows)).withColumn("votes", vector_to_array("probability")[1])
    voted = voted.withColumn("data", data_like({c: F.col(c) for c in FIGURES}))
    third = F.coalesce(F.col("notice").isin("third", "banner"), F.lit(False))
    groups = rows.where("chars > 0").groupBy("body").agg((F.min("project") != F.max("project")).alias("spread"), F.max(third).alias("marked"), F.max("chars").alias("n"))
    copied = groups.where(F.col("marked") | (F.col("spread") & (F.col("n") >= COPY_CHARS))).select("body", F.lit(True).alias("copied"))
    # a library is a third party's if any file says so
    libraries = rows.where(third & F.col("library").isNotNull()).select("library").distinct().withColumn("foreign", F.lit(True))
    # rows that can match nothing get keys of their own, so that they don't meet in one task
    own = F.concat(F.lit("-"), F.coalesce(F.col("file_id").cast("string"), F.lit("")))
    keyed = voted.select("file_id", "notice", "votes", "data", F.when(F.col("chars") > 0, F.col("body")).otherwise(own).alias("body"), F.coalesce("library", own).alias("library"))
    out = keyed.join(copied, "body", "left").join(libraries, "library", "left")
    return out.select("file_id", "notice", "votes", "data", F.coalesce("copied", F.lit(False)).alias("copied"), F.coalesce("foreign", F.lit(False)).alias("foreign"))


def not_hand_written(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(file_id): code and script files that were generated, minified, copied from a third party, or are data saved as code.

    Files of other types give no row, nor do rows with a null key. A null or
    empty content is hand-written unless a library's folder says otherwise. Where
    no file has a notice of one of the two kinds, no forest can be fitted and only
    the labelled files have a vote, that of their label; data and copies still come out. Repeated rows of a file count once.
    Extra columns are ignored. An empty table gives an empty table.
    """
    found = scored(files, key)
    return found.where((F.col("votes") >= VOTES) | F.coalesce("data", F.lit(False)) | F.col("copied") | F.col("foreign")).select("file_id").distinct()
