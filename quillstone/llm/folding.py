"""Folding of texts to plain words, shared by the operators that compare wording."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

#: Letters of other scripts that look like a Latin letter, after lower-casing.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
        "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y",
        "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
        "υ": "u", "χ": "x", "ω": "w", "η": "n", "γ": "y", "ı": "i", "ɡ": "g", "ɑ": "a", "ǀ": "l", "ø": "o",
        "ł": "l", "đ": "d", "ß": "ss",
    }
)
_ESCAPED = re.compile(r"\\+(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([nrtfv\"'/`*_]))")
_SURROGATES = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]{0,200})?/?>")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]|\x1b\\[[0-9;]*[A-Za-z]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:[*>#/|]+[ \t]*)?(?=[^\W\d_])")


def _one(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code is None:
        return " " if m[5] in "nrtfv" else m[5]
    n = int(code, 16)
    return chr(n) if n < 0x110000 else " "


def unescape(text: str) -> str:
    """Decodes backslash, character-reference and percent escapes; invisible characters and markup tags vanish."""
    if "\\" in text:
        text = _ESCAPED.sub(_one, text)
        text = _SURROGATES.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16", "replace"), text)
    if "&" in text:
        text = html.unescape(text)
    if "%" in text and len(_PERCENT.findall(text)) > 2:
        text = unquote(text, errors="replace")
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _UNSEEN.sub("", text)


def fold(word: str) -> str:
    """A word without case, accents, punctuation and look-alike letters; may be empty."""
    if word.isascii():
        return "".join(c for c in word.lower() if c.isalnum())
    word = unicodedata.normalize("NFKC", word).casefold().translate(LOOKALIKES)
    return "".join(c for c in unicodedata.normalize("NFD", word) if c.isalnum())


def words(text: str, cache: dict[str, str]) -> list[str]:
    """The folded words of a text in order. cache: folded words by their spelling, emptied when it is large."""
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    found = []
    for w in unescape(text).split():
        f = cache.get(w)
        if f is None:
            if len(cache) > 400_000:
                cache.clear()
            f = cache[w] = fold(w)
        if f:
            found.append(f)
    return found
