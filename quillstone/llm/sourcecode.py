"""Reading source files: encodings, languages, and the comments and strings in them."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Languages by extension where a file's language is unknown.
BY_EXTENSION = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp",
    ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".sh": "shell", ".bash": "shell", ".sql": "sql", ".css": "css", ".scss": "scss",
    ".scala": "scala", ".swift": "swift", ".lua": "lua", ".r": "r", ".pl": "perl",
}
ALIASES = {"bash": "shell", "sh": "shell", "zsh": "shell", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "c++": "cpp", "c#": "csharp", "golang": "go", "less": "scss"}

_DQ = r'"(?:\\.|[^"\\\n])*"?'
_SQ = r"'(?:\\.|[^'\\\n])*'?"
_CH = r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"
_BLOCK = r"/\*(?:(?!\*/)[\s\S])*(?:\*/)?"
#: Comments (group c) and strings (group s) of each family of languages; names of a family share its delimiters.
_FAMILIES = {
    "slash": (rf"(?P<c>//[^\n]*|{_BLOCK})|(?P<s>{_DQ}|{_CH})", "c cpp java rust csharp scala swift css scss"),
    "kotlin": (rf"(?P<c>//[^\n]*|{_BLOCK})|(?P<s>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|{_DQ}|{_CH})", "kotlin"),
    "script": (rf"(?P<c>//[^\n]*|{_BLOCK})|(?P<s>`(?:\\[\s\S]|[^`\\])*`?|{_DQ}|{_SQ})", "javascript typescript go"),
    "php": (rf"(?P<c>//[^\n]*|\#(?!\[)[^\n]*|{_BLOCK})|(?P<s>\"(?:\\[\s\S]|[^\"\\])*\"?|'(?:\\[\s\S]|[^'\\])*'?)", "php"),
    "hash": (rf"(?P<c>(?<![\w$\{{\"'\\&])\#[^\n]*|^=begin\b[\s\S]*?^=end\b)|(?P<s>\"(?:\\[\s\S]|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)", "shell ruby r perl"),
    "python": (r"(?P<c>\#[^\n]*)|(?P<s>(?:[rbfuRBFU]{0,2})(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*(?:\"\"\")?|'''(?:\\[\s\S]|(?!''')[^\\])*(?:''')?|" + f"{_DQ}|{_SQ}))", "python"),
    # the delimiters that most other languages use; line comments only where nothing but blanks stands before them
    "any": (rf"(?P<c>(?:(?<=\n)|(?<![\s\S]))[ \t]*(?://|\#|--|;|%|')[^\n]*|(?<![:\w])//[^\n]*|(?<=\s)--[ ][^\n]*|{_BLOCK}|<!--[\s\S]*?(?:-->|\Z)|\{{-[\s\S]*?(?:-\}}|\Z)|\(\*[\s\S]*?(?:\*\)|\Z))|(?P<s>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|{_DQ}|(?<!\w){_SQ})", "any"),
    "dash": (rf"(?P<c>--[^\n]*|{_BLOCK})|(?P<s>'(?:''|[^'])*'?|\"(?:\"\"|[^\"\n])*\"?)", "sql lua"),
}
PIECES = {lang: re.compile(p, re.M) for p, langs in _FAMILIES.values() for lang in langs.split()}


class Piece(NamedTuple):
    start: int
    end: int
    comment: bool


def language_of(language: str | None, ext: str | None) -> str | None:
    name = (language or "").lower().strip()
    name = ALIASES.get(name, name)
    return name if name in PIECES and name != "any" else BY_EXTENSION.get((ext or "").lower())


def decode(content: bytes) -> str:
    """Text of a file: by its byte-order mark, else UTF-8, else Western single bytes."""
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace")
    if content.startswith((b"\xff\xfe", b"\xfe\xff")):
        return content.decode("utf-16", "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        if content[1:2] == b"\0" and content[3:4] == b"\0":
            return content.decode("utf-16-le", "replace")
        return content.decode("cp1252", "replace")


def pieces(text: str, lang: str) -> list[Piece]:
    """Comments and string literals in the order of the text."""
    return [Piece(m.start(), m.end(), m.lastgroup == "c") for m in PIECES[lang].finditer(text)]


def masked(text: str, found: list[Piece]) -> str:
    """The text with the inside of comments and strings blanked; places and lines stay the same."""
    out, last = [], 0
    for p in found:
        body = text[p.start : p.end]
        out.append(text[last : p.start])
        out.append(" " * len(body) if "\n" not in body else re.sub(r"[^\n]", " ", body))
        last = p.end
    return "".join([*out, text[last:]])


#: Instructions to tools in comments.
DIRECTIVE = re.compile(
    r"(?i)^\W*(?:@ts-\w+|@flow|@jsx\b|eslint[-\w]*|tslint[:\-]\S*|jshint\b|jslint\b|prettier-ignore|istanbul ignore|c8 ignore|v8 ignore|webpack\w*:|pylint:|pyright:|mypy:|flake8:|noqa\b|nosec\b|type:\s*ignore|fmt:\s*\w+|yapf:|isort:|ruff:"
    r"|pragma\b|nolint|lint:|golint|go:\w+|\+build|cgo\b|shellcheck\b|rubocop:|frozen_string_literal|encoding:|-\*-|vim?:|sonar\w*|nosonar|checkstyle:|spotless:|@formatter:|noinspection|phpcs:|phpstan|psalm|@phpstan|@psalm|clang-format|nolint\w*"
    r"|cppcheck|coverity|lcov_excl|gcov|region\b|endregion\b|\#?region|language=|@suppress\w*|suppress\b|swiftlint:|ktlint|detekt|rustfmt|clippy|allow\(|stylelint|scss-lint|biome-ignore|deno-|!/|\#!|sourcemappingurl|@generated\b|-- ?noqa|sqlfluff|jscpd|cspell)"
)
#: What stands where documentation is missing.
FILLER = re.compile(
    r"(?i)^\W*(?:todo|tbd|tba|fixme|xxx|hack|n/?a|none|null|undocumented|documentation|docs?|doc ?string|description|summary|_summary_|_description_|placeholder|lorem ipsum|add (?:docs?|documentation|description|comment)s?|docs? pending|pending|to be (?:done|documented|written|filled in)"
    r"|missing(?: docs?| documentation)?|no (?:docs?|documentation|description|comment)s?|write (?:me|docs?|this)|fill (?:in|me)|coming soon|empty|\{@?inherit-?doc\}|@?inheritdoc|insert (?:description|docs?) here|see above|ditto|wip|à faire|a faire|à compléter|por hacer|pendiente|fazer|a fazer|сделать|待办|待补充|暂无|未記入|未定)\b[\W_]*"
    r"(?:(?:todo|tbd|add|docs?|documentation|description|comment|here|pending|later|needed|this|me|the|function|method|write|missing|for|now)[\W_]*)*$"
)


def has_prose_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


_CODE_END = re.compile(r"[;{}]\s*$|^[})\]]+[;,]?$|=>\s*\{?$")
_CALL = re.compile(r"^(?:(?:await|return|yield|throw|raise|new|del|echo|print)\s+)?[\w$>.:\->]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;,{:]?$")
_ASSIGN = re.compile(r"^(?:(?:const|let|var|val|final|auto|local|my|int|long|float|double|char|bool|boolean|string|String|\$)\s*)?[\w$.\[\]>\->\"']+\s*(?:[-+*/|&^%]|:)?=\s*\S.*$")
_KEYWORD = re.compile(
    r"^(?:if|elif|else if|while|for|foreach|switch|when|unless|until)\s*[(\[!$]|^(?:if|elif|while|for|with|unless)\b.*:\s*$|^(?:import|from|require|include|using|package|use)\s+[\w.:\"'<{*/]+(?:\s+(?:import|from|as)\b.*)?;?$|^(?:return|break|continue|pass|goto|end|fi|done|esac)\b(?:\s+[\w.$\[\]]+)?;?$"
    r"|^(?:def|func|fn|fun|function|class|struct|interface|enum|type)\s+\w+.*[({:]|^(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)\b.*|^@\w+(?:\([^)]*\))?$|^\}?\s*(?:else|finally|try|do)\s*[:{]|^(?:if|for|while)\b.*\b(?:then|do)$"
)


def looks_like_code(line: str) -> bool:
    """Whether a line of a comment is code that was commented out."""
    s = line.strip()
    if not s or not s.isascii() and not _CODE_END.search(s):
        return False
    if _CALL.match(s) or _KEYWORD.match(s):
        return True
    words = re.findall(r"[A-Za-z]{2,}", s)
    if _ASSIGN.match(s) and not re.match(r"^\w+(?: \w+){2,}", s.split("=")[0]):
        return True
    return bool(_CODE_END.search(s)) and (len(words) < 6 or bool(re.search(r"[=(){}\[\]]", s)))
