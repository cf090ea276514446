"""Credentials in source code and configuration (problem 1).

A text is read line by line where something in it may matter. Values are judged
by the place they stand in (an assignment to a name of a secret, a connection
string, a header, a command's option, a note about a login) or by their own form
(prefixes of issued tokens, key blocks). Encoded literals (base64, hex, percent,
backslash and character-reference escapes) are decoded layer by layer and read
again; binary layers are held against the grammar of private-key containers. A
finding keeps the piece of the text that carries it, so that a secret inside an
encoded literal is redacted by replacing that literal.

One narrow stage: no shuffle but for making the found lines distinct.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.folding import unescape


class Finding(NamedTuple):
    start: int  # of the carrier in the text
    end: int
    kind: str


# --- fixed values: forms of issued tokens, by their prefixes -------------------------------------------------
ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})|(?P<github>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})|(?P<gitlab>gl(?:pat|dt|rt|cbt|ptt|ft|soat)-[A-Za-z0-9_-]{16,})"
    r"|(?P<slack>xox[abeoprs]-[A-Za-z0-9-]{10,}|xapp-\d-[A-Za-z0-9-]{10,})|(?P<stripe>[srp]k_(?:live|test|prod)_[A-Za-z0-9]{10,}|whsec_[A-Za-z0-9]{16,})"
    r"|(?P<sendgrid>SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})|(?P<google>AIza[A-Za-z0-9_-]{30,}|ya29\.[A-Za-z0-9_-]{20,}|GOCSPX-[A-Za-z0-9_-]{20,})"
    r"|(?P<hub>hf_[A-Za-z0-9]{24,})|(?P<package>npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{30,}|rubygems_[a-f0-9]{40,}|dckr_pat_[A-Za-z0-9_-]{20,})"
    r"|(?P<model>sk-(?:proj-|ant-|or-)?[A-Za-z0-9_-]{20,})|(?P<cloud>do[opr]_v1_[a-f0-9]{40,}|shp(?:at|ca|pa|ss)_[a-fA-F0-9]{30,}|hv[sb]\.[A-Za-z0-9_-]{20,}|PMAK-[A-Za-z0-9-]{30,}|key-[a-f0-9]{32}|lin_api_[A-Za-z0-9]{30,}|sq0(?:atp|csp)-[A-Za-z0-9_-]{20,}|AGE-SECRET-KEY-1[A-Z0-9]{40,})"
    r"|(?P<jwt>eyJ[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{8,}\.[A-Za-z0-9_=-]{10,})"
    r"|(?P<dotted>[a-z]{2,6}\.[A-Za-z0-9]{8}\.[0-9a-f]{24,})"
    r")"
)
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----|PuTTY-User-Key-File-\d: ?[\w\-]*")
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----|Private-MAC: ?[0-9a-f]*")
#: What may stand between the lines of a key: line ends, plain or escaped, and the quotes, joining and comment marks around literals.
KEY_GAP = re.compile(r"(?:\\+[nrt]|\\\r?\n|[\s\"'`]|(?:[+.&,;~]|<>)(?=[\s\"'`\\])|(?<=[\s,+(])[bruf]{1,2}(?=[\"'])|(?<=\n)(?:#|//|\*|--|;|>|\|)+(?=[ \t\r\n]))*")
KEY_LINE = re.compile(r"[A-Za-z0-9+/_\-]+={0,2}(?![\w(:.\[=$@%])")
KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|Encryption|Public-Lines|Private-Lines|Key-Derivation|Argon2-[A-Z][a-z]+(?:-[A-Z][a-z]+)?): ?[^\n\\\"']*")
#: Words that name a secret, as folded parts of an identifier.
SECRET_WORDS = {
    "password", "passwd", "passwort", "passphrase", "pwd", "pass", "pw", "secret", "token", "apikey", "kennwort", "senha", "contrasena",
    "contraseña", "clave", "passcode", "pin", "credential", "credentials", "creds", "authtoken", "accesstoken", "passe", "jeton", "hmac",
    "пароль", "密码", "パスワード", "auth", "authkey", "secretkey", "privatekey", "authorization", "bearer", "motdepasse", "parola", "wachtwoord",
}
#: Words that make a key a secret one when they stand before it.
KEY_WORDS = {
    "api", "access", "secret", "private", "signing", "encryption", "storage", "service", "master", "auth", "hmac", "shared", "account",
    "license", "ssh", "crypt", "jwt", "app", "consumer", "deploy", "client", "subscription", "root", "admin", "aes", "rsa", "signer", "hash",
    "write", "server", "cipher", "encrypt", "decrypt", "application", "webhook", "ingest",
}
#: Words at the end of a name that make it the name of something about a secret.
ABOUT = {
    "field", "name", "header", "len", "length", "size", "min", "max", "hash", "hint", "label", "ref", "id", "file", "path", "url", "uri", "type",
    "policy", "prompt", "expiry", "ttl", "count", "digest", "regex", "pattern", "form", "reset", "column", "param", "env", "var", "class", "error",
    "message", "rules", "timeout", "algorithm", "alg", "format", "version", "index", "prefix", "suffix", "placeholder", "strength", "salt",
}
PLACEHOLDER = re.compile(
    r"(?ix)^(?: [*x.\-_\#0?•\s]* | <.*>? | \$.* | \{.* | %.* | \[.* | \(.*\) | @.* | &.* | change.?(?:me|it|this).* | dummy.* | todo.* | tbd | fixme.* | none | null | nil"
    r" | undefined | true | false | your.* | my.?(?:password|secret|token|key) | replace.* | insert.* | enter.* | .*example.* | sample.* | placeholder.* | redacted.* | removed"
    r" | hidden | secret | pass(?:word|wort|wd)? | passphrase | token | api.?key | key | test(?:ing)? | foo(?:bar)? | bar | baz | n/?a | see\b.* | vault.* | arn[:/].* | env[.:(].* | ref[:+].*"
    r" | file:.* | op://.* | ENC\[.* | ENC\(.* | AgA.{80,} | vault:.* | \{SSHA.* | default | unset | empty | string | str | (?:x{3,}|\*{3,}).* | .*(?:x{6,}|\*{4,}).* | 123456.* | abc123"
    r" | process\.env.* | os\.(?:environ|getenv).* | getenv.* | System\.getenv.* | https?://[^@]*$ )$"
)
NAME = r"[\w$.\-]*(?:\[[\"'][\w.\-]+[\"']\])?"
ASSIGN = re.compile(
    r"(?P<name>[\w$.\-]{1,80})(?:[\"'`]\]?|\]?)\s{0,4}(?::\s*[A-Za-z_][\w\[\]<>|. ?]*?(?=\s*=[^=>]))?\s*(?::=|=>|=(?!=)|:(?![:/]))\s{0,8}\(?\s{0,4}(?:[bruf]{1,2}(?=[\"']))?"
    r"(?:(?P<q>\"\"\"|'''|[\"'`])(?P<lit>(?:(?!(?P=q))[^\n\\]|\\.)*)(?P<closed>(?P=q)?)|(?P<bare>[^\s\"'`,;)}\]]{3,}))"
)
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,30}://(?P<user>[^\s/@:\"'<>`|]*):(?P<secret>[^\s/@\"'`<>|]{3,})@[\w.\[\-]")
PARAM = re.compile(r"(?i)[?&;](?:sig|signature|(?:[a-z]+[_-])?(?:api[_-]?)?key|(?:\w+[_-])?token|secret|password|pwd|pass|auth|code|sv_sig|credential)=(?P<secret>[^\s&\"'`<>;)]{8,})")
SCHEME = re.compile(r"(?i)(?<![\w-])(?:bearer|basic|token|apikey|digest)\s+(?P<secret>[A-Za-z0-9+/=._~\-]{8,})")
SQL = re.compile(r"(?i)\b(?:identified\s+(?:with\s+\w+\s+)?by|(?:encrypted\s+)?password|set\s+password\s*=|pwd)\s*(?:=\s*)?(?P<q>['\"])(?P<secret>[^'\"\n]{4,})(?P=q)?")
OPTION = re.compile(
    r"(?:(?<=\s)-u|--user|--proxy-user)[ =]?[\"']?[\w.\-@]+:[\"']?(?P<a>[^\s\"']{4,})|sshpass\s+-p\s*[\"']?(?P<b>[^\s\"']{4,})"
    r"|(?<=\s)--?(?:password|passwd|pass|token|secret|api-key|apikey|passphrase|secret-key|access-token|auth-token|storepass|keypass)[ =][\"']?(?P<c>[^\s\"']{4,})"
    r"|\b(?:mysql|mysqldump|mariadb|psql|redis-cli|ldapsearch|mongo)\b[^\n]*?\s-(?:p|a|w)\s?[\"']?(?P<d>[^\s\"'\-][^\s\"']{5,})"
)
LOGIN = re.compile(
    r"(?i)(?<![\w.])(?:log(?:ged|ging)?[ -]?in|login|user(?:name)?|creds?|credentials?|account|zugang(?:sdaten)?|anmeldung|conn|acc[eè]s|acceso|usu[aá]rio|benutzer|compte|identifiants?|machine"
    r"|password|pw|pass|passwort|kennwort|passwd|pwd|secret|mot de passe|contrase[nñ]a|senha|пароль|доступ|密码|密碼|パスワード|ログイン|पासवर्ड|api[ -]?key|token)(?![\w\-])"
)
#: A comment, a list item, a table row or prose.
NOTE = re.compile(r"^(?!.*(?:ENC\[|Copyright|sealed))\s*(?:#|//|--|/?\*|;|<!--|\||[-+>]\s|\d+[.)]\s|(?:[^=({;]|(?<!\w)\()*$)")
WORD = re.compile(r"[^\s\"'`|,()<>{}\[\]]+")
CARRIER = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
PERCENT = re.compile(r"(?:[A-Za-z0-9_.~\-]|%(?=[0-9A-Fa-f]{2}))+")
PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2}[A-Za-z0-9_.~\-]{0,3}){3}")
ESCAPES = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u\{?[0-9a-fA-F]{4}\}?|&\#x?[0-9a-fA-F]{2,5};|\\[0-7]{3}){3}")
PHRASE = re.compile(r"^[A-Za-z0-9]{3,}(?:[-_.][A-Za-z0-9]{2,}){2,}[-_.]?\d{1,4}$")
#: Words of which a text that the patterns below judge holds one, besides the names of secrets.
_MARKS = (
    "pass", "pwd", "secret", "token", "key", "bearer", "basic ", "auth", "-----begin", "cred", "login", "log in", "zugang", "senha", "contrase",
    "clave", "jeton", "akia", "asia", "glpat", "xox", "xapp", "k_live", "k_test", "k_prod", "hf_", "npm_", "sg.", "aiza", "hmac", "kennwort", "conn",
    "пароль", "доступ", "密码", "密碼", "パスワード", "ログイン", "पासवर्ड", "\\x", "\\u00", "&#", "pw", "sig=", "-u ", "user", "account", "acces", "accès",
    "identifi", "compte", "benutzer", "usuario", "usuário", "machine", "anmeldung", "putty", "\\1", "\\0",
)
#: Commands and options of OPTION and parameters of PARAM.
_COMMANDS = ("mysql", "mariadb", "psql", "redis-cli", "ldapsearch", "mongo", "sshpass", "--user", "--proxy-user", "-u", "code=", "sig=", "signature=", "sv_sig=", "digest", "basic", "salasana", "acceso", "usuário")
#: A text without any of these, in lower case, and without a long run holds nothing to judge. A word that holds another one isn't needed.
_EVERY = sorted({*_MARKS, *_COMMANDS, *SECRET_WORDS})
MARKS = tuple(w for w in _EVERY if not any(x in w for x in _EVERY if x != w))
LONG = re.compile(r"[A-Za-z0-9+/_\-]{20}|://[^\s/@]*:[^\s/@]+@|%[0-9A-Fa-f]{2}[A-Za-z0-9_.~\-]{0,3}%")
SEAM = re.compile(r"([\"'])[ \t]*(?:\+|\.\.|\.|&|<>|~|\\)?[ \t]*\r?\n[ \t]*(?:\+|\.\.|\.|&|<>)?[ \t]*(?:[bruf]{1,2}(?=[\"']))?\1|([\"'])[ \t]*(?:\+|\.\.|\.(?!\.)|&)[ \t]*\2")
LABEL = re.compile(r"(?i)^\s*-?\s*[\"']?(?:name|key)[\"']?\s*:\s*[\"']?(?P<name>[\w.\-]+)")
VALUE = re.compile(r"(?i)^\s*-?\s*[\"']?value[\"']?\s*:\s*[\"']?(?P<secret>[^\s\"',]+)")
_SPLIT = re.compile(r"[A-ZÄÖÜ]?[a-zäöüßéèñçа-я]+|[A-ZÄÖÜ]+(?![a-z])|\d+|[^\W\d_A-Za-z]+")


def maybe(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in MARKS) or LONG.search(text) is not None


def name_kind(name: str) -> str | None:
    """What a name says about its value: 'secret', 'key' (only a random value counts) or nothing."""
    parts = [p.lower() for p in _SPLIT.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts or parts[-1] in ABOUT:
        return None
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    # words that are written together: PGPASSWORD, DBPASS, mytoken
    if last.endswith(("password", "passwd", "passphrase", "secret", "apikey", "authtoken", "passwort")) or re.fullmatch(r"[a-z]{0,6}(?<!by)(?<!com)(?<!tres)(?<!over)(?<!under)(?:pass|pwd)", last):
        return "secret"
    if "".join(parts) in SECRET_WORDS or last in SECRET_WORDS and not (last == "pin" and before):
        return "secret"
    if last == "key" or last == "keys":
        if before in KEY_WORDS:
            return "secret"
        return "key" if not before else None
    if last in ("acces", "access") and "jeton" in parts or last in ("salasana", "secrets", "tokens", "passwords", "header") and len(parts) > 1 and parts[0] == "auth":
        return "secret"
    if last in ("value", "string", "str", "plain", "raw", "old", "new", "prod", "dev", "staging", "primary", "default", "b64", "base64", "hex", "enc") and name_kind("_".join(parts[:-1])):
        return "secret"
    return None


def random_like(v: str) -> bool:
    """Whether a value has the look of a password, token or key rather than of a word or name."""
    if len(v) < 8 or "://" in v:
        return False
    letters, digits = sum(c.isalpha() for c in v), sum(c.isdigit() for c in v)
    if not letters:
        return False
    if PHRASE.match(v):
        return True
    marks = sum(c in "!#$%&*+?^~@=" for c in v)
    if re.fullmatch(r"[A-Za-z]+[_\-.]?\d{1,3}", v) or re.fullmatch(r"v?\d+(?:\.\d+)+\S*", v):
        return False
    if digits:
        return bool(marks or digits >= 2 or any(c.isupper() for c in v[1:]))
    upper = sum(c.isupper() for c in v)
    return letters == len(v) and len(v) >= 10 and 0.2 <= upper / len(v) <= 0.8 or bool(marks) and letters >= 6 and 0 < upper < letters


def wordy(v: str) -> bool:
    """Only words and separators: a name, a path or a reference, but no secret."""
    return bool(re.fullmatch(r"[A-Za-z]+(?:[._\-/ :][A-Za-z]+)*", v)) and not random_like(v)


def _elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill b[at:end] exactly; None if they don't.

    The last one may go on beyond the bytes that are there, if these are cut off.
    """
    found = []
    while at < min(end, len(b)):
        if at + 2 > len(b):
            return found if end > len(b) else None
        tag, n, start = b[at], b[at + 1], at + 2
        if n & 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4:
                return None
            if start + more > len(b):
                return found if end > len(b) else None
            n, start = int.from_bytes(b[start : start + more]), start + more
        if start + n > end:
            return None
        found.append((tag, start, start + n))
        at = start + n
    return found


def private_container(b: bytes, whole: bool = False) -> bool:
    """Whether bytes follow the grammar of a private key: OpenSSH, PKCS#1, PKCS#8, SEC 1, DSA or PKCS#12.

    Every length must add up with the one around it. Without ``whole`` the bytes may
    be cut off, as the first line of a wrapped container is; what is there must fit.
    """
    if b.startswith((b"openssh-key-v1\0", b"PuTTY-User-Key-File-")):
        return True
    if len(b) < 32 or b[0] != 0x30:
        return False
    more = b[1] & 0x7F if b[1] & 0x80 else 0
    size = 2 + more + (int.from_bytes(b[2 : 2 + more]) if more else b[1])
    if more > 4 or size < len(b) or size > len(b) and whole or size < 32:
        return False
    parts = _elements(b, 2 + more, size)
    if not parts or parts[0][0] != 2 or parts[0][2] - parts[0][1] != 1 or len(parts) < 2 or parts[0][1] >= len(b):
        return False
    number, tags, cut = b[parts[0][1]], [t for t, _, _ in parts], size > len(b)
    second = parts[1]
    if number == 0 and set(tags) == {2}:  # PKCS#1 has nine numbers, DSA six; the modulus comes first
        return second[2] - second[1] >= 32 and (cut or len(tags) in (6, 9))
    if number in (0, 1) and second[0] == 0x30:  # PKCS#8: an algorithm's identifier, then the key in an octet string
        inner = _elements(b, second[1], second[2])
        return bool(inner and inner[0][0] == 6) and (tags[2:3] == [4] or cut and len(tags) == 2) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    if number == 1 and second[0] == 4 and second[2] - second[1] in range(20, 80):  # SEC 1: the private value, curve and point
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if number == 3 and second[0] == 0x30:  # PKCS#12: the kind of the content, then its check value
        inner = _elements(b, second[1], second[2])
        return bool(inner and inner[0][0] == 6) and set(tags[2:]) <= {0x30}
    return False


_PRINT = bytes(c for c in range(256) if 32 <= c < 127 or c in (9, 10, 13))


def decoded(piece: str) -> Iterator[bytes]:
    """What a piece may stand for in base64 or hex."""
    if len(piece) % 2 == 0 and len(piece) >= 24 and re.fullmatch(r"[0-9a-fA-F]+", piece):
        yield bytes.fromhex(piece)
        return
    body = piece.rstrip("=")
    if len(body) % 4 == 1:
        return
    try:
        yield base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return


def inside(b: bytes) -> str | None:
    """The kind of the secret that decoded bytes hold, if any."""
    if len(b) < 8:
        return None
    if b.translate(None, _PRINT):
        if private_container(b):
            return "private_key"
        wide = next((c for c, zeros in (("utf-16-le", b[1::2]), ("utf-16-be", b[::2])) if len(b) % 2 == 0 and zeros.count(0) > 0.7 * len(zeros)), None)
        try:
            text = b.decode(wide or "utf-8").removeprefix("\ufeff")
        except UnicodeDecodeError:
            return None
        if not text.translate(_SPACES).isprintable():
            return None
    else:
        text = b.decode("ascii")
    if m := re.fullmatch(r"[\w.@\-]{2,64}:([^\s:/][^\s]{5,})", text.strip()):
        if not PLACEHOLDER.match(m[1]) and (random_like(m[1]) or not wordy(m[1])):
            return "login"
    if re.fullmatch(r"[A-Za-z0-9_./+=!#$%^&*@~\-]{10,}", text) and (random_like(text) or re.fullmatch(r"[0-9a-f]{32,}", text)):
        return "encoded"  # hardly anything but a secret is a random word that was encoded
    found = next(scan(text), None)
    return found.kind if found else None


_SPACES = {9: " ", 10: " ", 13: " "}
#: What stands before a value whose name says that it is no secret: an identifier, a check value, a position.
_NO_SECRET = re.compile(r"(?i)(?:e-?tag|checksum|digest|sha\d*|md5|hash|uuid|guid|(?<![a-z])id|revision|rev|version|build|commit|cursor|nonce|integrity|fingerprint|if-none-match)[\"'\]]{0,2}\s*(?::|=>?|,)\s*(?:W/)?[\"'`]{0,2}$")


def judged(value: str, strict: bool) -> bool:
    if len(value) < 4 or PLACEHOLDER.match(value):
        return False
    return random_like(value) if strict else not wordy(value) and not value.isdigit() and not re.search(r"\s.*\s", value)


def line_findings(line: str, before: str, marked: bool = True) -> Iterator[Finding]:
    """Findings of one line; places are those of the line. marked: whether it has a mark, without which only forms and layers count."""
    for m in ISSUED.finditer(line):
        v = m.group()
        if not re.search(r"(?i)example|x{6,}|\*{3,}|(.)\1{7,}", v):
            yield Finding(m.start(), m.end(), m.lastgroup or "token")
    if "://" in line:
        for m in URL.finditer(line):
            v = m["secret"]
            if not PLACEHOLDER.match(v) and len(v) >= 4 and not (v.isalpha() and v.islower() and len(v) < 9) and not v.isdigit():
                yield Finding(m.start("secret"), m.end("secret"), "connection")
    yield from encoded_findings(line)
    if not marked:
        return
    clean = line.replace('\\"', '"').replace("\\'", "'") if '\\"' in line or "\\'" in line else line
    at = 0
    while m := ASSIGN.search(clean, at):
        kind = name_kind(m["name"])
        at = m.end() if kind else m.end("name") + 1  # a value under another name may hold an assignment
        if not kind:
            continue
        lit = m["lit"] if m["q"] else None
        v = lit if lit is not None else m["bare"]
        strict = kind == "key" or lit is None
        if lit is None and re.match(r"[A-Za-z_$][\w.$>\-]*[(\[]|[A-Za-z_$][\w$]*(?:\.|->|::)[A-Za-z_]\w*$|\$", v):
            continue
        if v.lower().startswith(("bearer ", "basic ", "token ")):
            v = v.split(None, 1)[1] if " " in v.strip() else v
            strict = True
        if judged(v, strict):
            place = line.find(v, max(0, m.start("lit" if lit is not None else "bare") - 2))
            yield Finding(max(place, 0), place + len(v) if place >= 0 else len(line), "password" if kind == "secret" else "key")
    if "://" in line:
        for m in PARAM.finditer(line):
            if judged(m["secret"], True):
                yield Finding(m.start("secret"), m.end("secret"), "parameter")
    for m in SCHEME.finditer(line):
        v = m["secret"]
        if judged(v, True) and not re.fullmatch(r"[a-z]+(?:[._-][a-z0-9]+)*", v) or any(b":" in b and not b.translate(None, _PRINT) for b in decoded(v)):
            yield Finding(m.start("secret"), m.end("secret"), "header")
    for m in SQL.finditer(line):
        if judged(m["secret"], False):
            yield Finding(m.start("secret"), m.end("secret"), "password")
    for m in OPTION.finditer(line):
        g = m.lastgroup
        if judged(m[g], g == "d"):
            yield Finding(m.start(g), m.end(g), "option")
    if (m := VALUE.match(line)) and (n := LABEL.match(before)) and name_kind(n["name"]) and judged(m["secret"], False):
        yield Finding(m.start("secret"), m.end("secret"), "password")
    if (m := LOGIN.search(line)) and NOTE.match(line):
        for w in WORD.finditer(line, m.end()):
            v = w.group().rstrip(".,;:")
            if ":" in v and not v.startswith("http") and re.fullmatch(r"[\w.\-]+:\S+", v):
                v = v.split(":", 1)[1]
            elif "/" in v and re.fullmatch(r"[\w.\-]+/\S+", v) and "." not in v.split("/", 1)[0]:
                v = v.split("/", 1)[1]
            if len(v) >= 8 and "://" not in v and "=" not in v[:-2] and random_like(v) and noted(v) and not PLACEHOLDER.match(v):
                at = line.find(v, w.start())
                yield Finding(at, at + len(v), "login")


def noted(v: str) -> bool:
    """Whether a word in a note is a secret by its own look; names, paths and calls are none."""
    if re.search(r"[(\\]|^[\w.\-]+@[\w.\-]+$|^\w+(?:\.\w+)+$|^[\w.\-]+/[\w./\-]+\.\w{1,5}$|^[\w.\-]*\.(?:example|invalid|test|internal|local|com|org|net)\b", v) and not ISSUED.match(v):
        return False
    if PHRASE.match(v):
        return True
    if re.fullmatch(r"[a-z]+(?:[_\-][a-z0-9]+)*|[A-Z]+(?:_[A-Z0-9]+)*|[a-z]+(?:[A-Z][a-z0-9]+)+", v):
        return False
    return True


def encoded_findings(line: str) -> Iterator[Finding]:
    """Findings in encoded pieces. Each layer is shorter by a quarter at least, so that decoding ends by itself."""
    for m in CARRIER.finditer(line):
        piece = m.group()
        if piece.isalpha():
            continue
        # base64 of text has a letter of each case; a plain word with hyphens doesn't decode to text
        for b in decoded(piece):
            kind = inside(b)
            if kind and not (kind == "encoded" and _NO_SECRET.search(line, max(0, m.start() - 40), m.start())):
                yield Finding(m.start(), m.end(), kind)
    if "%" in line:
        for m in PERCENT.finditer(line):
            if PERCENTS.search(m.group()) and (plain := _settled(m.group(), unescape)) != m.group() and next(scan(plain), None):
                yield Finding(m.start(), m.end(), "encoded")
    runs: list[tuple[int, int]] = []
    for run in ESCAPES.finditer(line):
        # the enclosing literal, or what has no white space, is the carrier
        if runs and run.start() < runs[-1][1]:
            continue
        start = max(line.rfind(c, 0, run.start()) for c in "\"'` \t") + 1
        closing = line[start - 1] if start else ""
        end = line.find(closing, run.end()) if closing in ("'", '"', "`") and closing else -1
        if end < 0:
            end = m.start() if (m := _GAP.search(line, run.end())) else len(line)
        runs.append((max(start, runs[-1][1] if runs else 0), end))
    found = False
    for n, (start, end) in enumerate(runs):
        piece = _settled(line[start:end], _plain)
        if piece == line[start:end]:
            continue
        before = line[runs[n - 1][1] if n else 0 : start]
        after = line[end : runs[n + 1][0] if n + 1 < len(runs) else len(line)]
        inner = scan(before + piece + after)
        if f := next((f for f in inner if f.start < len(before) + len(piece) and f.end > len(before)), None):
            found = True
            yield Finding(start, end, f.kind)
    if runs and not found and (plain := _settled(line, _plain)) != line and (f := next(scan(plain), None)):
        yield from (Finding(start, end, f.kind) for start, end in runs)  # only the parts together make a secret


_GAP = re.compile(r"[\s\"'`]")


def _plain(text: str) -> str:
    return unescape(re.sub(r"\\([0-3][0-7]{2})", lambda m: chr(int(m[1], 8)), text) if "\\" in text else text)


def _settled(text: str, step: Callable[[str], str]) -> str:
    """The text after as many steps as change it; each makes it shorter."""
    while len(plain := step(text)) < len(text):
        text = plain
    return plain


def _lines(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether a mark stands in it, of each line that may hold something, in the order of the text."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: places would not fit
        at = 0
        for line in text.split("\n"):
            if maybe(line):
                yield at, at + len(line), True
            at += len(line) + 1
        return
    found: dict[int, tuple[int, bool]] = {}

    def add(at: int, marked: bool) -> int:
        start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        if marked or start not in found:
            found[start] = (end, marked)
        return end

    for m in LONG.finditer(text):
        add(m.start(), False)
    for mark in MARKS:
        at = low.find(mark)
        while at >= 0:
            at = low.find(mark, add(at, True))
    for start, (end, marked) in list(found.items()):
        # the value of a name on the line before
        if marked and text.find("alue", end + 1, end + 40) >= 0:
            add(end + 1, True)
    for start in sorted(found):
        yield start, *found[start]


def _key_chars(piece: str) -> int | None:
    """How many characters an encoded private key takes by the length in its head; None if its head gives none."""
    hexed = re.fullmatch(r"[0-9a-fA-F]+", piece) is not None
    b = next(decoded(piece[: len(piece) // 4 * 4]), b"")
    if len(b) < 6 or b[0] != 0x30:
        return None
    more = b[1] & 0x7F if b[1] & 0x80 else 0
    size = 2 + more + (int.from_bytes(b[2 : 2 + more]) if more else b[1])
    return 2 * size if hexed else -(-size * 4 // 3)


def key_pieces(text: str, at: int, closed: bool = True) -> list[tuple[int, int]]:
    """The pieces of the key block or of the encoded key that begins at a place: its marks, headers and lines, without what stands between them.

    A block ends with its END line. Where that is missing, or where there is no
    BEGIN line, lines of the key's alphabet belong to it until the length in its head is
    reached, padding comes, or a line is shorter or longer than those before. A BEGIN line without a
    key behind it (a test for such lines, say) gives nothing, unless the text ends there.
    """
    begin, first = BLOCK.match(text, at), at
    closed = closed and begin is not None  # lines of any length up to the END line
    found, have, width, need = [], 0, 0, None
    if begin:
        found.append(begin.span())
        at = begin.end()
    while True:
        start = KEY_GAP.match(text, at).end() if found else at
        if begin and (m := BLOCK_END.match(text, start)):
            return [*found, m.span()] if have else []
        if begin and (m := KEY_HEADER.match(text, start)):
            found.append(m.span())
            at = m.end()
            continue
        m = KEY_LINE.match(text, start)
        if not m or not begin and found and "\n" not in text[at:start] and not re.search(r"\\[nr]|[\"'`]", text[at:start]):
            break
        n = len(m.group())
        closing = closed or begin and BLOCK_END.match(text, KEY_GAP.match(text, m.end()).end())
        if not closing and (have and n > width or not have and n < 16 or have and n < width and begin):
            break
        if need is None and not begin and not found:
            need = _key_chars(m.group())
        found.append(m.span())
        at, have = m.end(), have + n
        if not closing and (m.group().endswith("=") or width and n < width or need is not None and have >= need) and not (begin and need is None):
            break
        width = max(width, n)
    if closed:
        return key_pieces(text, first, False)
    if begin and not have:
        return found if not text[at:].strip(" \t\r\n\"'`,;)\\n") else []
    return found


def scan(text: str) -> Iterator[Finding]:
    """Findings of a text in any order; one place may come more than once."""
    if not maybe(text):
        return
    if "-----BEGIN" in text or "PuTTY" in text:
        rest, last = [], 0
        for m in BLOCK.finditer(text):
            if m.start() >= last and (parts := key_pieces(text, m.start())):
                yield Finding(m.start(), parts[-1][1], "private_key")
                for a, b in parts:  # what stands around the block is judged as well
                    rest += [text[last:a], " " * (b - a)]
                    last = b
        text = "".join([*rest, text[last:]])
    for a, b in wrapped(text):
        joined = re.sub(r"[^A-Za-z0-9+/_\-=]+", "", _WRAP.sub("", text[a:b]))
        for bytes_ in decoded(joined):
            if kind := inside(bytes_):
                yield Finding(a, b, kind)
                text = text[:a] + re.sub(r"[^\n]", " ", text[a:b]) + text[b:]
    cuts: list[tuple[int, int]] = []  # place in the joined text, and how many characters were left out before it
    joined, last, gone = [], 0, 0
    if "\n" in text:
        for m in SEAM.finditer(text):
            joined.append(text[last : m.start()])
            gone += m.end() - m.start()
            cuts.append((m.end() - gone, gone))
            last = m.end()
    whole = "".join([*joined, text[last:]]) if cuts else text
    for at, end, marked in _lines(whole):
        before = whole[whole.rfind("\n", 0, max(at - 1, 0)) + 1 : at - 1] if at else ""
        for f in line_findings(whole[at:end], before, marked):
            a, b = at + f.start, at + f.end
            a, b = a + max((g for p, g in cuts if p <= a), default=0), b + max((g for p, g in cuts if p < b), default=0)
            if f.kind == "private_key" and (parts := key_pieces(text, a)):
                b = max(b, parts[-1][1])
            yield Finding(a, b, f.kind)


#: A line end inside wrapped base64, with the indentation and the comment mark of the next line.
_WRAP = re.compile(r"[ \t]*\r?\n[ \t]*(?:(?:#|//|--|\*|;|>)[ \t]*)?")
_WRAPPED = re.compile(r"(?m)(?<![^\s\"'`=:>|(])(?P<first>[A-Za-z0-9+/_\-]{40,})(?:[ \t]*\r?\n[ \t]*(?:(?:#|//|--|\*|;|>)[ \t]*)?[A-Za-z0-9+/_\-]{4,}={0,2}(?=[ \t]*\r?$|[\"'`,;)]))+")


def wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Pieces of base64 that go on over unquoted lines of one width, the last of which may be shorter."""
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        at, width = m.end("first"), len(m["first"])
        while g := _WRAP.match(text, at):
            line = re.compile(r"[A-Za-z0-9+/_\-]+={0,2}").match(text, g.end())
            if not line or len(line.group()) > width or line.end() > m.end():
                break
            at = line.end()
            if len(line.group()) < width:
                break
        if at > m.end("first"):
            yield m.start(), at


def _pieces(text: str, f: Finding) -> list[tuple[int, int]]:
    """What is redacted of a finding: all of it, but for quotes, joining marks, line ends and indentation inside."""
    if f.kind == "private_key" and (parts := key_pieces(text, f.start)) and parts[-1][1] >= f.end:
        return parts
    found, at = [], f.start
    for m in _INNER.finditer(text, f.start, f.end):
        found.append((at, m.start()))
        at = m.end()
    return [*found, (at, f.end)]


_INNER = re.compile(SEAM.pattern + "|" + _WRAP.pattern)


def redact(text: str, found: list[Finding]) -> str:
    """The text with a typed placeholder for each carrier. Line ends, and the quotes and marks between the literals of a carrier, stay."""
    out, last = [], 0
    for f in sorted(found):
        named = False
        for a, b in _pieces(text, f):
            if b <= last or a == b:
                continue
            out.append(text[last : max(a, last)])
            if not named and a >= last:
                out.append(f"REDACTED_{f.kind.upper()}")
            named, last = True, b
    return "".join([*out, text[last:]])


def find_credentials(df: DataFrame, key: str = "chunk_key", text: str = "content") -> DataFrame:
    """(chunk_key, line_no, kind): the lines on which credentials begin, each once for each kind.

    Lines end at a line feed and count from 1. Null and empty texts hold none;
    rows with a null key are left out. Repeated rows count once. Extra columns
    are ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows |= {(k, t.count("\n", 0, f.start) + 1, f.kind) for f in scan(t)}
            if rows:
                k, n, kind = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(kind)], ["chunk_key", "line_no", "kind"])

    source = df.select(F.col(key).cast("long").alias("chunk_key"), F.col(text).alias("content")).where("chunk_key is not null and content <> ''")
    return source.mapInArrow(run, "chunk_key long, line_no int, kind string").distinct()


def redact_credentials(df: DataFrame, key: str = "chunk_key", text: str = "content") -> DataFrame:
    """(chunk_key, content, credentials): each text with its credentials replaced, and how many there were.

    A row for each row; null texts stay null with 0 credentials. The number of
    lines of a text doesn't change.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                found = list({f for f in scan(t)}) if t else []
                counts.append(len({f.start for f in found}))
                texts.append(redact(t, found) if found else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["chunk_key", "content", "credentials"])

    source = df.select(F.col(key).cast("long").alias("chunk_key"), F.col(text).alias("content"))
    return source.mapInArrow(run, "chunk_key long, content string, credentials int")
