"""Functions paired with their documentation (problem 2).

Python files are parsed into syntax trees, whose function nodes give names, exact
ranges and docstrings. In languages with braces, comments and strings are blanked,
the rest is cut into tokens and their brackets make a tree, in which the productions
of each language tell declarations with their names, modifiers and bodies
(``declarations``). The declarations of languages without braces (shell, SQL, Ruby, Lua, R,
Perl, style sheets), and of files whose brackets don't match or that Python can't parse, are
read by patterns. The documentation
is the docstring or the whole-line comment that ends directly above the
declaration, decorators aside. It is judged by what is left of it without tags,
rulers, directives, placeholders and commented-out code, and without the words of
the function's name.

One narrow stage over the files; repeated rows are dropped at the end, by file
and line, before which nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.declarations import LANGUAGES, declarations, line_finder
from quillstone.llm.sourcecode import BY_EXTENSION, DIRECTIVE, FILLER, PIECES, decode, language_of, looks_like_code, masked, pieces


class Function(NamedTuple):
    name: str
    line: int  # of the name, from 1
    first: int  # of the declaration with its decorators
    last: int
    doc: str


_ID = r"[^\W\d][\w$]*"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|else|do|new|throw|typeof|await|with|match|when|case|sizeof|synchronized|using|lock|fixed|elseif|foreach|and|or|not|super|this|in|of|delete|void|yield)\b)"
_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
#: Declarations of each language; the group n is the name.
DECLARATIONS = {
    "javascript": [
        rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)\s*[<(]",
        rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+?)?=\s*(?:async\s*)?(?:function\b|(?:<[^>\n]*>\s*)?{_ARGS}\s*(?::[^=\n{{]+?)?=>|[\w$]+\s*=>)",
        rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|declare)\s+)*[*#]?{_NOT}(?P<n>[\w$]+)\??\s*(?:<[^>\n]*>)?\s*{_ARGS}\s*(?::\s*[^{{;\n=]+?)?\s*\{{",
        rf"^[ \t]+(?:(?:public|private|protected|static|readonly)\s+)*{_NOT}(?P<n>[\w$]+)\s*(?::[ \t]*(?:async\s+)?function\b|(?::[^=\n]+?)?[=:]\s*(?:async\s*)?{_ARGS}\s*(?::[^=\n{{]+?)?=>)",
    ],
    "java": [
        rf"^[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|override|virtual|async|sealed|internal|extern|unsafe|partial)\s+)*(?:<[^>\n]+>\s*)?(?!(?:return|new|else|throw|case|package|import)\b)[\w.$]+(?:<[^;{{}}()=\n]*>)?(?:\s*\[\])*\s+{_NOT}(?P<n>{_ID})\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+?)?[{{;]",
        rf"^[ \t]*(?:public|protected|private)\s+(?P<n>[A-Z]\w*)\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+?)?\{{",
    ],
    "kotlin": [r"^[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?\s+)*(?:(?:public|private|protected|internal|open|override|abstract|final|inline|suspend|operator|infix|tailrec|external|actual|expect)\s+)*fun\s+(?:<[^>\n]*>\s*)?(?:[\w.<>?, ]+\.)?`?(?P<n>\w+)`?\s*\("],
    "go": [r"^func\s+(?:\([^)\n]*\)\s*)?(?P<n>\w+)\s*[\[(]"],
    "rust": [r"^[ \t]*(?:pub(?:\([^)\n]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\s*)?)?fn\s+(?P<n>\w+)"],
    "php": [r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*(?P<n>\w+)\s*\(", r"^[ \t]*\$(?P<n>\w+)\s*=\s*(?:static\s+)?(?:function|fn)\s*&?\s*\("],
    "c": [rf"^(?!(?:typedef|return|else|struct\s+\w+\s*\{{|enum|#)\b)(?:[A-Za-z_][\w:<>,]*(?:[ \t*&]+|[ \t]*\r?\n(?=[A-Za-z_~])))+[*&]*{_NOT}(?P<n>[A-Za-z_~][\w:~]*)\s*{_ARGS}\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?[{{;]"],
    "ruby": [r"^[ \t]*(?:(?:private|public|protected|module_function|private_class_method)\s+)?def\s+(?:self\.|\w+\.)?(?P<n>\w+[?!=]?)"],
    "shell": [r"^[ \t]*function\s+(?P<n>[\w:.\-]+)\s*(?:\(\s*\))?\s*(?:\{|\n|$)", r"^[ \t]*(?P<n>[\w:.\-]+)\s*\(\s*\)\s*(?:\{|\n|$|\()"],
    "sql": [r"(?i)^[ \t]*create\s+(?:or\s+replace\s+)?(?:definer\s*=\s*\S+\s+)?(?:temporary\s+|temp\s+)?(?:function|procedure)\s+(?:if\s+not\s+exists\s+)?(?:[\w`\[\]]+\.)*[`\[]?(?P<n>\w+)"],
    "python": [r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)"],
    "swift": [r"^[ \t]*(?:@\w+(?:\([^)\n]*\))?\s+)*(?:(?:public|private|internal|open|fileprivate|static|class|override|final|mutating)\s+)*func\s+(?P<n>\w+)"],
    "scala": [r"^[ \t]*(?:(?:private|protected|override|final|implicit|lazy|inline)(?:\[\w+\])?\s+)*def\s+(?P<n>\w+)"],
    "lua": [r"^[ \t]*(?:local\s+)?function\s+(?:\w+[.:])*(?P<n>\w+)\s*\("],
    "perl": [r"^[ \t]*sub\s+(?P<n>\w+)"],
    "r": [r"^[ \t]*(?P<n>[\w.]+)\s*(?:<-|=)\s*function\s*\("],
    "scss": [r"^[ \t]*@(?:mixin|function)\s+(?P<n>[\w\-]+)"],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]
DECLARATIONS["csharp"] = DECLARATIONS["java"]
DECLARATIONS["cpp"] = DECLARATIONS["c"]
_COMPILED = {k: [re.compile(p, re.M) for p in v] for k, v in DECLARATIONS.items()}
_DECORATOR = re.compile(r"^\s*(?:@[\w.$]+|\#!?\[|\[\w+|template\s*<|@\()")
_LINE_MARK = {**dict.fromkeys(("python", "shell", "ruby", "perl", "r"), ("#",)), "php": ("//", "#"), "sql": ("--",), "lua": ("--",)}
_SPACED = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_TAG_LINE = re.compile(
    r"^\s*(?:[@\\]\w+(?:\s*\[[^\]]*\])?(?:\s*\{[^}]*\})?|:\w+(?:\s+[\w.,|\[\] ]+?)?(?:\s+[*$]*\w+)?:)\s*(?P<rest>.*)$"
)
_NAMED_TAG = re.compile(r"^\s*[@\\](?:param|arg|argument|property|prop|tparam|typeparam|throws|exception|raises)\b(?:\s*\{[^}]*\})?(?:\s*\[[^\]]*\])?\s*[&$*.]*[\w.\[\]$]*\s*(?:[-–—:]\s*)?(?P<rest>.*)$")
_FIELD = re.compile(r"^\s{0,12}[*$]{0,2}[\w.]+\s*(?:\([^)]*\))?\s*:\s*(?P<rest>.*)$")
_SECTION = re.compile(r"(?i)^\s*(?:args?|arguments|parameters?|params|returns?|yields?|raises|throws|examples?|notes?|attributes|see also|usage|inputs?|outputs?|paramètres|parámetros|parâmetros|rückgabe)\s*:?\s*-*\s*$")
_STOP = {
    "a", "an", "the", "this", "that", "these", "function", "method", "func", "procedure", "routine", "helper", "of", "for", "to", "and", "in", "on", "it", "is", "does", "do", "will", "we", "get", "gets", "set", "sets", "returns", "return",
    "der", "die", "das", "le", "la", "les", "el", "los", "las", "o", "os", "as", "un", "une", "ein", "eine", "self", "cls",
}
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def _stem(w: str) -> str:
    """A word without the endings that turn a name's verb into a sentence's."""
    for end in ("ing", "es", "s", "ed", "e"):
        if len(w) - len(end) >= 3 and w.endswith(end):
            return w[: -len(end)]
    return w


def says_something(doc: str, name: str) -> bool:
    """Whether documentation tells more than the function's name does."""
    own = {_stem(p.lower()) for p in _SPACED.findall(name)} | {name.lower()}
    found: list[str] = []
    wide = 0
    for raw in doc.replace("\r", "").split("\n"):
        line = re.sub(r"</?\w+[^<>]*>", " ", raw).strip().strip("*#/-=~_+.!|<> \t")
        if not line or DIRECTIVE.match(raw.strip().lstrip("*/# ")) or FILLER.match(line) or _SECTION.match(line):
            continue
        m = _NAMED_TAG.match(raw) or _TAG_LINE.match(raw)
        if not m and (f := _FIELD.match(raw)) and (not f["rest"] or FILLER.match(f["rest"])):
            continue
        rest = m["rest"] if m else line
        if FILLER.match(rest) or re.fullmatch(r"[\w.\[\]<>|, ]*\{[^}]*\}\W*", rest) or not m and looks_like_code(line):
            continue
        wide += len(_WIDE.findall(rest))
        found += re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", " ".join(" ".join(_SPACED.findall(w)) if w.isascii() and ("_" in w or re.search(r"[a-z][A-Z]", w)) else w for w in rest.split()))
    told = [w for w in found if w.lower() not in _STOP and _stem(w.lower()) not in own and w.lower() not in own]
    return wide >= 4 or bool(told) and (len(found) >= 2)


def _above(lines: list[str], first: int, lang: str) -> str:
    """The whole-line comment that ends on the line above line ``first`` (from 1), decorators aside."""
    at = first - 2
    while at >= 0 and _DECORATOR.match(lines[at]):
        at -= 1
    if at < 0:
        return ""
    marks = _LINE_MARK.get(lang, ("//",))
    line = lines[at].strip()
    if line.startswith(marks) and not line.startswith("#!") and not (lang == "php" and line.startswith("#[")):
        start = at
        while start > 0 and lines[start - 1].strip().startswith(marks):
            start -= 1
        return "\n".join(re.sub(r"^\s*(?:/{2,}!?|#+!?|-{2,})\s?", "", x) for x in lines[start : at + 1])
    if lang in ("python", "shell", "perl", "r"):
        return ""
    if line == "=end" and lang == "ruby":
        start = at
        while start > 0 and not lines[start].startswith("=begin"):
            start -= 1
        return "\n".join(lines[start + 1 : at])
    if line.endswith("*/"):
        start = at
        while start >= 0 and "/*" not in lines[start]:
            start -= 1
        if start < 0 or lines[start].split("/*")[0].strip():
            return ""
        body = "\n".join(lines[start : at + 1])
        body = body[body.index("/*") + 2 : body.rindex("*/")].lstrip("*!")
        return "\n".join(re.sub(r"^\s*\*+\s?", "", x) if k else x for k, x in enumerate(body.split("\n")))
    return ""


def _python(text: str, lines: list[str]) -> list[Function] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            found.append(Function(node.name, node.lineno, first, node.end_lineno or node.lineno, ast.get_docstring(node) or ""))
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.stmt, ast.excepthandler, ast.match_case)):
                stack.append(child)
    return found


def _end(mask: str, start: int, lang: str, line: int, lines: list[str]) -> int:
    """The last line of a declaration's body, by braces, by end words or by indentation."""
    if lang in ("python", "ruby", "lua", "scala"):
        indent = len(lines[line - 1]) - len(lines[line - 1].lstrip())
        for k in range(line, len(lines)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                return k + 1 if lines[k].strip().startswith("end") else k
        return len(lines)
    opened = mask.find("{", start)
    closed = mask.find(";", start)
    if opened < 0 or 0 <= closed < opened:
        return line + mask.count("\n", start, closed) if closed >= 0 else line
    depth = 0
    for m in re.compile(r"[{}]").finditer(mask, opened):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return mask.count("\n", 0, m.start()) + 1
    return len(lines)


def functions(text: str, lang: str, ranges: bool = False) -> Iterator[Function]:
    """All functions and methods with their documentation, which may be empty."""
    lines = text.split("\n")
    if lang == "python":
        # a lone carriage return and a form feed end a line for the parser, but none for us
        plain = re.sub(r"\r(?!\n)|\f", " ", text).replace("\r\n", "\n")
        parsed = _python(plain, lines)
        if parsed is not None:
            for f in parsed:
                above = _above(lines, f.first, lang) or (_above(lines, f.line, lang) if f.first != f.line else "")
                yield f._replace(doc=f.doc if says_something(f.doc, f.name) or not above else above)
            return
    if lang not in _COMPILED:
        return
    mask = masked(text, pieces(text, lang))
    declared = declarations(mask, lang) if lang in LANGUAGES else None
    if declared is not None:
        number = line_finder(text)
        seen = set()
        for d in declared:
            line, first = number(d.at), number(d.head)
            if line not in seen:
                seen.add(line)
                doc = _above(lines, first, lang) or (_above(lines, line, lang) if first != line else "")
                yield Function(d.name, line, first, number(d.end), doc)
        return
    seen = set()
    for pattern in _COMPILED[lang]:
        for m in pattern.finditer(mask):
            line = mask.count("\n", 0, m.start("n")) + 1
            if line in seen:
                continue
            seen.add(line)
            head = m.start() + len(m.group()) - len(m.group().lstrip())
            first = mask.count("\n", 0, head) + 1
            doc = _above(lines, first, lang) or (_above(lines, line, lang) if first != line else "")
            if lang == "python" and not says_something(doc, m["n"]):
                if d := re.compile(r"[^\n]*(?:\n[^\n]*?)??:[ \t]*(?:\#[^\n]*)?\r?\n(?:[ \t]*\r?\n)*[ \t]+[rRuU]?(\"\"\"|''')(?P<d>[\s\S]*?)(?:\1|\Z)").match(text, m.start()):
                    doc = d["d"]
            yield Function(m["n"], line, first, _end(mask, m.end("n"), lang, line, lines) if ranges else line, doc)


def _rows(files: DataFrame, key: str) -> DataFrame:
    """Code and script files in the languages that are read, by key, language, extension and content."""
    known = F.lower(F.coalesce("language", F.lit(""))).isin(*PIECES, "bash", "sh", "js", "ts", "py", "") | F.lower(F.coalesce("ext", F.lit(""))).isin(*BY_EXTENSION)
    return files.where(F.col("file_type").isin("code", "script") & known & F.col(key).isNotNull() & (F.length("content") > 0)).select(
        F.col(key).cast("long").alias("file_id"), "language", "ext", "content"
    )


def documented(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(file_id, def_line, name): the functions and methods whose documentation says something.

    def_line is the line of the file, from 1, on which the name is declared. Only
    files of type code and script count; null and empty contents, unknown
    languages and null keys give no rows. Repeated rows of a file count once.
    Files that can't be parsed are read by declarations alone. Extra columns are
    ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for k, language, ext, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if lang := language_of(language, ext):
                    rows |= {(k, f.line, f.name) for f in functions(decode(content), lang) if f.doc and says_something(f.doc, f.name)}
            if rows:
                k, n, name = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(name)], ["file_id", "def_line", "name"])

    return _rows(files, key).mapInArrow(run, "file_id long, def_line int, name string").dropDuplicates(["file_id", "def_line"])


def pairs(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(file_id, def_line, name, first_line, last_line, documentation, code): code and description of each documented function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for k, language, ext, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lang = language_of(language, ext)
                if not lang:
                    continue
                text = decode(content)
                lines = text.split("\n")
                for f in functions(text, lang, True):
                    if f.doc and says_something(f.doc, f.name):
                        for c, v in zip(cols, (k, f.line, f.name, f.first, f.last, f.doc, "\n".join(lines[f.first - 1 : f.last]))):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ["file_id", "def_line", "name", "first_line", "last_line", "documentation", "code"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    schema = "file_id long, def_line int, name string, first_line int, last_line int, documentation string, code string"
    return _rows(files, key).mapInArrow(run, schema).dropDuplicates(["file_id", "def_line"])
