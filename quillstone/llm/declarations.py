"""Declarations of functions in languages with braces, from a tree of their tokens.

A text whose comments and strings are blanked is cut into tokens; every bracket knows
its partner, which makes the tokens a tree. A descent through it looks at each list
of parameters and at each word that opens a declaration: the productions of the
language say whether a name before it is declared, where the declaration begins, with
its modifiers and annotations, and with which body it ends.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple


class Declared(NamedTuple):
    name: str
    at: int  # place of the name
    head: int  # place of the declaration's first token
    end: int  # place of its last one


TOKEN = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|=>|->|::|[{}()\[\];=:,<>*&~?!@.#|]")
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Words in front of a list of parameters that declare nothing.
_NEVER = set(
    "if for while switch catch return function else do new throw typeof await with match when case sizeof synchronized using lock fixed elseif foreach and or not super this in of delete void yield".split()
)
_BEFORE = {"return", "new", "else", "throw", "case", "package", "import", "typedef", "goto", "in", "await", "delete", "yield"}
_MODIFIERS = set("export default declare public private protected static async readonly override abstract get set final function const let var".split())
_OPENERS = {"go": "func", "rust": "fn", "kotlin": "fun", "swift": "func", "scala": "def", "php": "function"}
_FRONT = set(
    "pub default const async unsafe extern public private protected internal open override abstract final inline suspend operator infix tailrec external actual expect static class mutating fileprivate implicit lazy".split()
)
LANGUAGES = {"javascript", "typescript", "java", "csharp", "c", "cpp", *_OPENERS}


class _Tree:
    def __init__(self, mask: str):
        self.words: list[str] = []
        self.places: list[int] = []
        for m in TOKEN.finditer(mask):
            self.words.append(m.group())
            self.places.append(m.start())
        self.partner: dict[int, int] = {}
        self.whole = self._match()
        self.mask = mask

    def _match(self) -> bool:
        stack: list[int] = []
        for i, w in enumerate(self.words):
            if w in "([{":
                stack.append(i)
            elif w in _CLOSES:
                if not stack or self.words[stack[-1]] != _CLOSES[w]:
                    return False
                j = stack.pop()
                self.partner[i], self.partner[j] = j, i
        return not stack

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.words) and (self.words[i][0].isalpha() or self.words[i][0] in "_$")

    def before_types(self, i: int) -> int:
        """The token in front of type parameters that end at i, or i itself."""
        if self.word(i) != ">":
            return i
        depth = 0
        while i >= 0 and self.words[i] not in ";{}":
            depth += (self.words[i] == ">") - (self.words[i] == "<")
            i -= 1
            if depth == 0:
                return i
        return -1

    def end_of(self, i: int) -> int | None:
        """Where the body or the semicolon is that follows token i - 1, across a result type or a list of exceptions."""
        while 0 <= i < len(self.words):
            w = self.words[i]
            if w == "{":
                return self.partner[i]
            if w == ";":
                return i
            if w in "=)}]" or w == "=>":
                return None
            i = self.partner[i] + 1 if w in "([" else i + 1
        return None

    def expression_end(self, i: int) -> int:
        """The last token of the expression that begins at i: before a comma or a closing bracket, at a semicolon, or at the end of a line after its first token."""
        last = i
        while i < len(self.words) and self.words[i] not in ",)]}":
            if i > last and "\n" in self.mask[self.places[last] : self.places[i]]:
                break
            last = self.partner[i] if self.words[i] in "([{" else i
            if self.words[i] == ";":
                break
            i = last + 1
        return last

    def line_start(self, i: int) -> bool:
        """Whether only blanks stand before token i on its line."""
        return not self.mask[self.mask.rfind("\n", 0, self.places[i]) + 1 : self.places[i]].strip()


def _script(t: _Tree) -> Iterator[tuple[int, int, int]]:
    """(name, first token, last token) in JavaScript and TypeScript."""

    def first(i: int) -> int:
        while i > 0:
            if t.words[i - 1] in _MODIFIERS:
                i -= 1
            elif t.words[i - 1] in "*#" and t.word(i - 2) in _MODIFIERS:
                i -= 1
            elif t.words[i - 1] == "@":
                i -= 1
            elif t.words[i - 1] == ")" and (d := t.partner[i - 1] - 1) > 0 and t.named(d) and t.word(d - 1) == "@":
                i = d - 1
            elif t.named(i - 1) and t.word(i - 2) == "@":
                i -= 2
            else:
                break
        return i

    def bound(i: int) -> int | None:
        """The name that what begins at token i is bound to, by = or :, if that is a declaration or a member."""
        if t.word(i - 1) == "async":
            i -= 1
        if t.word(i - 1) == "=":
            k = i - 2
            if not (t.named(k) and (t.word(k - 1) in _MODIFIERS or t.line_start(k))):  # a type may stand between the name and =
                while k > 0 and t.words[k] not in ";{}=(" and t.word(k) != ":":
                    k -= 1
                k = k - 1 if t.word(k) == ":" else -1
            if t.named(k) and (t.word(k - 1) in ("const", "let", "var") or t.line_start(first(k)) and t.places[first(k)] and t.mask[t.places[first(k)] - 1] in " \t"):
                return k
        elif t.word(i - 1) == ":" and t.named(i - 2) and t.line_start(i - 2) and t.mask[t.places[i - 2] - 1 : t.places[i - 2]] in (" ", "\t"):
            return i - 2
        return None

    for i, w in enumerate(t.words):
        if w == "=>" and t.named(i - 1) and t.word(i - 2) in ("=", "async"):  # x => ...
            k = bound(i - 1)
            if k is not None and t.word(k - 1) in ("const", "let", "var"):
                yield k, first(k), t.expression_end(i + 1)
        if w != "(":
            continue
        close = t.partner[i]
        n = t.before_types(i - 1)
        after = close + 1
        if t.word(after) == ":":  # a result type up to the arrow or the body
            k = after + 1
            while t.word(k) and t.words[k] not in ("=>", "{", ";", "=", ")", "}"):
                k = t.partner[k] + 1 if t.words[k] in "([" else k + 1
            after = k
        arrow = t.word(after) == "=>"
        last = t.expression_end(after + 1) if arrow else t.partner[after] if t.word(after) == "{" else after
        if n >= 0 and t.words[n] == "function" or t.word(n) == "*" and t.word(n - 1) == "function":
            k = bound(n if t.words[n] == "function" else n - 1)
            if k is not None:
                yield k, first(k), last
        elif t.named(n) and (t.word(n - 1) == "function" or t.word(n - 1) == "*" and t.word(n - 2) == "function"):
            if t.line_start(first(n)):
                yield n, first(n), last
        elif arrow:
            k = bound(n + 1 if t.word(i - 1) == ">" else i)
            if k is not None:
                yield k, first(k), last
        else:
            n = n - 1 if t.word(n) == "?" else n
            if t.named(n) and t.words[n] not in _NEVER and t.word(after) == "{" and t.line_start(first(n)) and t.mask[t.places[first(n)] - 1 : t.places[first(n)]] in (" ", "\t"):
                yield n, first(n), last


def _typed(t: _Tree, lang: str) -> Iterator[tuple[int, int, int]]:
    """(name, first token, last token) in languages that declare a function by its result's type."""
    for i, w in enumerate(t.words):
        n = i - 1
        if w != "(" or not t.named(n) or t.words[n] in _NEVER:
            continue
        end = t.end_of(t.partner[i] + 1)
        if end is None:
            continue
        while t.word(n - 1) in ("::", "~"):
            n -= 1 if t.words[n - 1] == "~" else 2
        k, depth = n - 1, 0
        while k >= 0:
            x = t.words[k]
            if x == ")" and t.named(t.partner[k] - 1) and t.word(t.partner[k] - 2) in ("@", "."):  # an annotation with values
                k = t.partner[k] - 1
                continue
            if x == "]":
                k = t.partner[k] - 1
                continue
            depth += (x == ">") - (x == "<")
            if x in (";", "{", "}", "(", ")", "=", ":", "=>", "->", "!", "|", "#") or x == "," and depth <= 0 or x in _BEFORE:
                break
            k -= 1
        if k >= 0 and t.words[k] not in (";", "{", "}", ":", ")", "#") or k >= 0 and t.words[k] == ":" and lang == "java":
            continue
        head = k + 1
        if k >= 0 and t.words[k] in ":)#" or lang in ("c", "cpp") and not t.line_start(head):
            while head < n and not t.line_start(head):  # what ends a directive or a label
                head += 1
        kinds = t.words[head:n]
        typed = any(x[0].isalpha() or x[0] == "_" for x in kinds if x not in _MODIFIERS) and t.words[n - 1] not in (".", "@", ",")
        made = bool(kinds) and lang not in ("c", "cpp") and set(kinds) <= {"public", "protected", "private"} and t.words[n][0].isupper()
        if made and t.words[end] == ";" or not (typed or made) or not t.line_start(head):
            continue
        if lang in ("c", "cpp") and t.mask[: t.places[head]].rpartition("\n")[2]:
            continue
        yield i - 1, head, end


def _opened(t: _Tree, lang: str) -> Iterator[tuple[int, int, int]]:
    """(name, first token, last token) in languages with a word that opens a function's declaration."""
    opener = _OPENERS[lang]
    for i, w in enumerate(t.words):
        if lang == "php" and w in ("function", "fn") and t.word(i + 1) in ("(", "&"):
            k = i - 2 if t.word(i - 1) == "=" else i - 3 if t.word(i - 1) == "static" and t.word(i - 2) == "=" else -1
            if k >= 0 and t.words[k].startswith("$") and t.line_start(k):
                end = t.end_of(t.partner[i + 1] + 1) if t.word(i + 1) == "(" else None
                yield k, k, i if end is None else end
        if w != opener:
            continue
        head = i
        while head > 0 and (t.words[head - 1] in _FRONT or t.words[head - 1] == ")" and t.word(t.partner[head - 1] - 1) == "pub" or t.words[head - 1] == "]" and t.word(t.partner[head - 1] - 1) in _FRONT):
            head = t.partner[head - 1] - 1 if t.words[head - 1] in ")]" else head - 1
        while head > 1 and lang in ("kotlin", "swift") and (t.word(head - 2) == "@" or t.word(head - 1) == ")" and t.word(t.partner[head - 1] - 2) == "@"):
            head = head - 2 if t.word(head - 2) == "@" else t.partner[head - 1] - 2
        n = i + 1
        if lang == "go" and t.word(n) == "(":
            n = t.partner[n] + 1
        elif t.word(n) in ("<", "&"):
            depth = 0
            while t.word(n):
                depth += (t.words[n] == "<") - (t.words[n] == ">")
                n += 1
                if depth == 0:
                    break
        while lang == "kotlin" and t.named(n) and t.word(n + 1) in (".", "?", "<"):  # the type that is extended
            n += 1
            while t.word(n) and not (t.named(n) and t.word(n - 1) == "."):
                n += 1
        if not t.named(n) or not t.line_start(head):
            continue
        if lang == "go" and (t.mask[: t.places[head]].rpartition("\n")[2] or t.word(n + 1) not in ("(", "[")) or lang in ("php", "kotlin") and t.word(n + 1) not in ("(", "<"):
            continue
        k = n + 1
        while t.word(k) and t.words[k] != "(" and t.words[k] not in "{};=":
            k = t.partner[k] + 1 if t.words[k] == "[" else k + 1
        end = t.end_of(t.partner[k] + 1) if t.word(k) == "(" else None
        if lang in ("go", "kotlin", "swift", "scala") and end is not None and t.words[end] == ";":
            end = None
        yield n, head, t.partner.get(k, n) if end is None else end


def declarations(mask: str, lang: str) -> list[Declared] | None:
    """The functions that a text declares, by the place of their names; None if its brackets don't match."""
    t = _Tree(mask)
    if not t.whole:
        return None
    found = _script(t) if lang in ("javascript", "typescript") else _opened(t, lang) if lang in _OPENERS else _typed(t, lang)
    made = {}
    for n, head, end in found:
        end = min(end, len(t.words) - 1)
        made.setdefault(t.places[n], Declared(t.words[n].lstrip("$") if lang == "php" else t.words[n], t.places[n], t.places[head], t.places[end]))
    return [made[k] for k in sorted(made)]


def line_finder(text: str):
    """A function from a place to the number of its line, from 1."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    return lambda at: bisect_right(starts, at)
