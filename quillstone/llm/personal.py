"""Personal information in free text (problem 8).

Values are found by their form and by the words around them, and validated where
their kind has a check (digit counts, check letters, dates). Numbers are replaced
by a format-preserving pseudonym: a keyed Feistel network permutes the valid values of
a format, walking on until it meets a valid one, so that check digits, dates and
country codes hold, equal values get equal pseudonyms in every document, and no
value can be read back without the key. A phone number is permuted without its
country code and trunk zero, so that its spellings stay linked. Birth dates are
permuted among all dates of two centuries. Addresses, names and e-mail addresses get
a keyed tag instead. Each stands in a typed placeholder.

One narrow stage: no shuffle but for making the found lines distinct.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


class Mention(NamedTuple):
    start: int
    end: int
    kind: str


# --- e-mail --------------------------------------------------------------------------------------------------
_LOCAL = r"[^\W_](?:[\w.+'\-]{0,62}[\w+])?"
_HOST = r"(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.)+[A-Za-z]{2,18}"
EMAIL = re.compile(rf"(?<![\w.+@/\-{{}}$%])({_LOCAL})\s?(?:@|＠|﹫|&\#64;|&\#x40;|&commat;|%40)\s?({_HOST})(?![\w@]|\.\w|-\w|:[\w/~]|\(|/\w+\.git)")
_AT = r"(?:\s?[\[({<]\s?(?:at|a|AT|At|arroba|arobase|ät|@)\s?[\])}>]\s?|\s[\-_]?AT[\-_]?\s|\s?_at_\s?|\s(?:arroba|arobase)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.|punkt|punto|point|ponto)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|punto|point|ponto)\s|\.)"
SPELLED = re.compile(rf"(?<![\w.+@\-])([^\W_][\w+\-]*(?:{_DOT}[\w+\-]+)*){_AT}((?:[^\W_][\w\-]*{_DOT})+[A-Za-z]{{2,18}})(?![\w(]|\.\w)")
SPOKEN = re.compile(r"(?i)(?<![\w.+@\-])([^\W_][\w+\-]*(?:(?:\sdot\s|\.)[\w+\-]+)*)\s(?:at|ät|arroba|chez)\s((?:[^\W_][\w\-]*(?:\sdot\s|\.))*[^\W_][\w\-]*\sdot\s[A-Za-z]{2,18})(?!\w)")
#: Each with what a line must hold: every alternative of its pattern holds it.
SPELT = [(re.compile(r"[\[({<]\s?(?:at|a|AT|At|arroba|arobase|ät|@)\s?[\])}>]|AT|_at_|arroba|arobase"), SPELLED), (re.compile(r"(?i)\sdot\s"), SPOKEN)]
# --- phone ---------------------------------------------------------------------------------------------------
_S = "[ \u00a0\u2009\u202f.\\-]"
_EXT = r"(?:,?[ \u00a0](?:ext\.?|x|Durchwahl|poste|extensión|ramal|доб\.|内线|内線)[ \u00a0]?\d{1,6})?"
PHONES = [
    re.compile(rf"(?<![\w+])\+\d{{1,3}}{_S}?(?:\(0?\d{{1,5}}\)|\d{{1,5}})(?:[ \u00a0\u2009\u202f.\-/]?\d{{1,6}}){{1,5}}(?!\w|[.\-/]\d){_EXT}"),
    re.compile(rf"(?<![\w.\-/+])\((?:0?\d{{2,5}})\){_S}?\d{{3,4}}{_S}?\d{{3,5}}(?![\w\-]){_EXT}"),
    re.compile(rf"(?<![\w.\-/+])00[1-9]\d{{0,2}}{_S}?\d{{2,9}}(?:{_S}\d{{2,6}}){{1,4}}(?!\w|[.\-/]\d){_EXT}"),
    re.compile(rf"(?<![\w.\-/+])0[1-9](?:{_S}\d{{2}}){{4}}(?!\w|[.\-/]\d){_EXT}"),
    re.compile(rf"(?<![\w.\-/+])0\d{{2,4}}/\d{{3,8}}(?:[\- ]\d{{1,5}})?(?!\w|[.\-/]\d){_EXT}"),
    re.compile(rf"(?<![\w.\-/+])0\d{{3,4}}[ \u00a0]\d{{3}}[ \u00a0]?\d{{3,4}}(?!\w|[.\-/]\d){_EXT}"),
    re.compile(rf"(?<![\w.\-/+])\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}(?!\w|[.\-/]\d){_EXT}"),
    re.compile(rf"(?<![\w.\-/+#])555-\d{{4}}(?!\w|[.\-/]\d){_EXT}"),
]
PHONE_CUE = re.compile(
    r"(?i)(?:\b(?:phones?|tel(?:[eé](?:fono?|fone|phone)|efon)?|telefonnummer|mobile?|mobil|handy|cell|call|fax|hotline|pager|whatsapp|on-call number|notruf[\w ]*|rufnummer|portable|celular|m[oó]vil"
    r"|тел(?:ефон)?|电话|手机|電話|携帯|फ़ोन|फोन|मोबाइल)\b\.?|电话|手机|電話|携帯)[^\w+(\n]{0,6}(?:is|number|no\.?|nr\.?)?[^\w+(\n]{0,3}"
    rf"(?P<v>\+?\(?\d[\d \u00a0().\-/]{{5,22}}\d)(?!\w){_EXT}"
)
PHONE_AFTER = re.compile(rf"(?<![\w.\-/+])(?P<v>\+?\(?\d[\d \u00a0().\-/]{{5,22}}\d)(?!\w){_EXT} ?\((?:mobile?|cell|home|work|office|fax|mobil|privat|dienstlich|móvil|celular)\)")
NOT_PHONE = re.compile(r"(?i)(?:\b(?:sku|order|ticket|isbn|issn|ean|invoice|part|serial|article|item|version|build|rev|release|case|bestellung|artikel|commande|pedido|tracking|doi|port|ip|заказ|номер заказа)\b[\s:#.№no]*|[#№v$€£])$")
# --- identity numbers ----------------------------------------------------------------------------------------
ID_CUE = re.compile(
    r"(?i)(?<!\w)(?:ssn|social security(?: (?:no\.?|number|\#))?|passports?(?: (?:no\.?|number|nr\.?|\#))?|passeport|pasaporte|passaporte|reisepass(?:nummer|nr\.?)?|driv(?:er|ing)(?:'?s)? licen[cs]e(?: (?:no\.?|number))?"
    r"|f[üu]hrerschein(?:nummer|nr\.?)?|permis(?: de conduire)?|dni|nie|nif|cpf|rg|cnh|curp|nino|national insurance(?: (?:no\.?|number))?|insee|nir|(?:num[ée]ro|n°|nº|no\.?) de s[ée]curit[ée] sociale|s[ée]curit[ée] sociale|personalausweis(?:nummer|nr\.?)?"
    r"|ausweis(?:nummer|nr\.?)?|steuer-?id(?:nr\.?)?|steuernummer|identifikationsnummer|sozialversicherungsnummer|tax (?:number|id|no\.?)|tin|national id(?:entity)?(?: (?:no\.?|number|card))?|id card(?: (?:no\.?|number))?|identity (?:card|number|no\.?)"
    r"|aadhaar|pan card|carte d'identit[ée]|cédula|c[ée]dula de identidad|bilhete de identidade|cart[ãa]o de cidad[ãa]o|паспорта?|снилс|инн|身份证号?码?|护照号?码?|マイナンバー|個人番号|旅券番号|パスポート番号|आधार(?: संख्या)?|पासपोर्ट)"
    r"[\s:#№=.\-]{1,4}(?:(?:no|nr|number|is|ist|est|es|é|номер|серия)\.?[\s:]{1,2})?(?P<v>(?=(?:[^\n]{0,3}[\dA-Z]))[A-Z0-9][A-Z0-9 \u00a0./\-]{4,24}[A-Z0-9])(?![a-z0-9A-Z])"
)
SSN = re.compile(r"(?<![\w.\-/+#])\d{3}-\d{2}-\d{4}(?![\w\-/]|\.\d)")
CPF = re.compile(r"(?<![\w.\-/+])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w\-])")
DNI = re.compile(r"(?<![\w.\-/+])\d{8}-?[A-HJ-NP-TV-Z](?![\w\-])")
NINO = re.compile(r"(?<![\w.\-/+])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w\-])")
RESIDENT = re.compile(r"(?<![\w.\-/+])[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dX](?![\w\-])")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
RESIDENT_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
# --- addresses -----------------------------------------------------------------------------------------------
_UP = "A-ZÀ-ÖØ-ÞĀŁŚŠŽ"
_CAP = rf"[{_UP}][\w'’.\-]*"
_WAYS = r"(?:Street|St\b\.?|Road|Rd\b\.?|Avenue|Ave\b\.?|Lane|Ln\b\.?|Boulevard|Blvd\b\.?|Court|Ct\b\.?|Terrace|Ter\b\.?|Way|Drive|Dr\b\.?|Place|Pl\b\.?|Square|Sq\b\.?|Close|Crescent|Cres\b\.?|Parkway|Pkwy\b\.?|Row|Walk|Mews|Highway|Hwy\b\.?|Trail|Circle|Grove|Gardens|Quay)"
_CITY = rf"(?:, ?\d{{4,6}} {_CAP}(?: {_CAP})?)"
ADDRESSES = [
    re.compile(rf"(?<![\w.\-])\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,4}}{_WAYS}(?!\w)(?:,? (?:Apt|Suite|Unit|Flat|\#) ?\w{{1,5}})?(?:, {_CAP}(?: {_CAP})?(?: \d{{4,6}})?)?"),
    re.compile(rf"(?<!\w)(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \w{{1,5}}, (?:{_CAP} ?){{1,4}}, (?:\d{{1,4}}\w? )?(?:{_CAP} ){{1,4}}{_WAYS}(?!\w)(?:, {_CAP}(?: {_CAP})?)?"),
    re.compile(r"(?i)(?<!\w)(?:p\.? ?o\.? ?box|post office box|postfach|bo[iî]te postale|b\.p\.|apartado(?: de correos)?|caixa postal|а/я|абонентский ящик|私書箱|邮政信箱|信箱)\s?\d{1,6}(?:, [^\W\d][\w ]{2,24}?\d{4,6})?"),
    re.compile(rf"(?<![\w.\-])(?:[{_UP}][\w.\-]*? ?)?[{_UP}a-zäöü][\wäöüß\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|markt|graben|hof|berg|chaussee|stieg|pfad) \d{{1,4}} ?[a-z]?(?!\w)(?:, ?\d{{5}} {_CAP}(?: {_CAP})?)?"),
    re.compile(rf"(?<!\w)(?:(?:Am|An der|Im|In der|Zum|Zur|Alter?|Alte[ns]?|Neuer?|Unter den|Hinter der|Auf dem|Auf der|Bei der|Große|Kleine)\s)?{_CAP}(?: {_CAP})? \d{{1,4}} ?[a-z]?, ?\d{{5}} {_CAP}(?: {_CAP})?"),
    re.compile(rf"(?i:(?<![\w.\-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-d]\b))?,? (?:rue|avenue|av\.|boulevard|bd\.?|place|impasse|chemin|quai|allée|route|cours|passage|square|sentier|faubourg|villa)) (?:(?:de la|de l['’]|du|des|de|d['’]|le|la|les|aux?|l['’]) ?)?{_CAP}[^\n,;]{{0,30}}?(?=[,.;\n\"]|\s|$){_CITY}?"),
    re.compile(rf"(?<!\w)(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|carrer|ronda|glorieta|rua|travessa|praça|largo|alameda|estrada|rodovia|via|piazza|corso|viale)(?: (?:de|del|da|do|dos|das|la|las|los|el|della|di))* {_CAP}(?: (?:de|del|da|do|la)? ?{_CAP})*,? ?(?:n[º°.o]{{1,2}} ?)?\d{{1,4}}(?!\w)(?:, (?:\d\.?[ºª](?: ?[A-Z])?|bajo|[A-Z]\b|\d{{1,2}}))*{_CITY}?"),
    re.compile(r"(?:ул\.|улица|просп?\.|проспект|пр-т|пер\.|переулок|пл\.|площадь|наб\.|набережная|ш\.|шоссе|бульвар|б-р)\s?[А-ЯЁ][\w\-]+(?: [А-ЯЁ]?[\w\-]+)?,?\s?(?:д\.|дом)?\s?\d{1,4}\w?(?:,\s?(?:к\.|корп\.|стр\.|кв\.|г\.)\s?[\w\-]+)*"),
    re.compile(r"[\u4e00-\u9fff]{2,12}?(?:路|街|大道|巷|弄|胡同)\s?\d{1,5}\s?(?:号|弄|號)(?:[\u4e00-\u9fff]{0,4}\d{1,4}(?:室|楼|号楼|单元|层))*"),
    re.compile(r"(?:〒\s?\d{3}-\d{4}\s?)?[\u4e00-\u9fff\u3040-\u30ffヶ]{1,12}?(?:丁目|町|区|市|村|番町)[\u4e00-\u9fff\u3040-\u30ff]{0,8}\s?\d{1,4}(?:丁目\d{1,3}(?:番(?:地)?\d{0,3}号?|[\-－]\d{1,3})*|[\-－−]\d{1,4}(?:[\-－−]\d{1,4})?|番地?(?:\d{1,3}号)?)|〒\s?\d{3}-\d{4}"),
    re.compile(r"(?:मकान|फ्लैट|प्लॉट|गली)\s?(?:नंबर|संख्या|नं\.?|सं\.?)\s?\d{1,5}[^\n।]{0,40}"),
]
_WAY_WORDS = ("street", "st", "road", "rd", "ave", "lane", "ln", "boulevard", "blvd", "court", "ct", "ter", "way", "drive", "dr", "place", "pl", "square", "sq", "close", "cres", "parkway", "pkwy", "row", "walk", "mews", "highway", "hwy", "trail", "circle", "grove", "gardens", "quay")
_ENGLISH_WAY = re.compile(r"\b(?:" + "|".join(w.capitalize() for w in _WAY_WORDS) + r")")
#: What a line must hold, in lower case, for each of ADDRESSES; for None the test of ``_has`` by its place.
_ADDRESS_MARKS = [
    None,
    ("flat", "apt", "apartment", "unit", "suite", "room"),
    ("box", "postfach", "postale", "b.p.", "apartado", "caixa", "а/я", "ящик", "私書箱", "信箱"),
    ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig", "markt", "graben", "hof", "berg", "chaussee", "stieg", "pfad"),
    None,
    ("rue", "avenue", "av.", "boulevard", "bd", "place", "impasse", "chemin", "quai", "allée", "route", "cours", "passage", "square", "sentier", "faubourg", "villa"),
    ("calle", "c/", "avda", "avenida", "plaza", "paseo", "camino", "carrer", "ronda", "glorieta", "rua", "travessa", "praça", "largo", "alameda", "estrada", "rodovia", "via", "piazza", "corso", "viale"),
    ("ул", "пр", "пер", "пл", "наб", "ш", "бульвар", "б-р"),
    ("路", "街", "大道", "巷", "弄", "胡同"),
    ("丁目", "町", "区", "市", "村", "番", "〒"),
    ("मकान", "फ्लैट", "प्लॉट", "गली"),
]
_CODE_BEFORE_CITY = re.compile(r"\d ?[a-z]?, ?\d{5} ")
_ADDRESS_WORDS = ("address", "adresse", "anschrift", "direcci", "domicilio", "endere", "ship_to", "lives at", "wohnhaft", "адрес", "地址", "住所", "पता")


def _may_hold(k: int, line: str, low: str) -> bool:
    """Whether a line can hold an address of the k-th form at all; a cheap test before the pattern."""
    marks = _ADDRESS_MARKS[k]
    if marks is not None:
        return any(m in low for m in marks)
    return bool(_ENGLISH_WAY.search(line) if k == 0 else _CODE_BEFORE_CITY.search(line))


ADDRESS_CUE = re.compile(
    rf"(?i:(?<!\w)(?:(?:home|mailing|postal|street|shipping|billing|delivery|invoice)? ?address|adresse|anschrift|direcci[oó]n|domicilio|endere[çc]o|ship_to|lives at|wohnhaft|адрес|地址|住所|पता)\s?[:=]\s?)(?P<v>\d{{1,5}}\w? {_CAP}(?: {_CAP}){{0,3}}(?:, {_CAP})+)"
)
# --- names ---------------------------------------------------------------------------------------------------
#: Given names that make two capitalised words a person where nothing else says so.
GIVEN = set(
    "Aoife Andrei Anneke Bao Björn Carmen Chiara Dewi Emre Farid Hugo Ingrid Jonas Kwame Leila Luca Lucía Maren Milan Mira Nadia Noor Oskar Otto Pavel Priya Renata Rosa Sabela Samir Tiago Tomasz Ulla Viktor Wen Yara Zofia Élise"
    " Мирон Ольга Пётр Зоя Иван Мария Анна Сергей Елена Дмитрий Наталья Алексей"
    " Alice Amelia Anna Ana Andreas Antonio Barbara Carlos Charlotte Christian Christine Claire Claudia Daniel David Diego Elena Emily Emma Fatima Felix Francesca Franz Giulia Hannah Hans Helena Igor Isabel Ivan Jan Jean Jennifer"
    " Johanna John José Juan Julia Karin Katarina Klaus Laura Léa Lena Linda Lukas Maria María Marie Mario Martin Mary Mateo Matteo Michael Mohammed Nina Olga Oliver Omar Pablo Patricia Paul Pedro Peter Pierre Rafael Ravi Robert"
    " Sara Sarah Sofia Stefan Susan Sven Thomas Ursula Vera William Yuki".split()
)
_GIVEN_LOW = {g.lower() for g in GIVEN}
_RU = "А-ЯЁ"
_NAME = rf"[{_UP}{_RU}][^\W\d_]+(?:['’\-][^\W\d_]+)*"
_INITIAL = rf"[{_UP}{_RU}]\."
_PARTICLE = r"(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|al|bin|ibn|ter|ten|zu|st\.)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Hr|Fr|M|Mme|Mlle|Sr|Sra|Srta|Dña|Don|Doña|Ing|Dott|г-н|г-жа|Sir|Dame|Rev|Shri|Smt)\b\.?"
_TITLE_SURE = r"(?:Mrs?|Ms|Mx|Dr|Prof|Herrn?|Frau|Mme|Mlle|Sra?|Srta|Doña|г-н|г-жа)\b\.?"
_SHORT = rf"(?:{_TITLE} )*(?:{_NAME}|{_INITIAL})(?: {_INITIAL})*(?: {_PARTICLE})* {_NAME}|(?:{_TITLE} )+(?:{_PARTICLE} )*{_NAME}|(?:{_PARTICLE} )*{_NAME}, (?:{_NAME}|{_INITIAL})(?: {_INITIAL})?(?!\w)"
FULL = rf"(?:{_TITLE} )*(?:{_NAME}|{_INITIAL})(?: {_INITIAL})*(?: {_PARTICLE})*(?: {_NAME})+|(?:{_TITLE} )+(?:{_PARTICLE} )*{_NAME}|(?:{_PARTICLE} )*{_NAME}, (?:{_NAME}|{_INITIAL})(?: {_INITIAL})?(?!\w)"
_LOWW = r"[a-zß-öø-ÿąćęłńśźžа-яё]{2,}(?:['’\-][a-zß-öø-ÿąćęłńśźžа-яё]+)*"
_PLAIN = rf"{_LOWW}(?: [^\W\d_]\.)*(?: {_PARTICLE})*(?: {_LOWW}){{1,2}}|{_LOWW}, {_LOWW}"
_HAN = r"[\u4e00-\u9fff]{2,4}(?:[ \u3000・][\u4e00-\u9fff\u3040-\u30ff]{1,4})?|[\u30a1-\u30fe]{2,8}[ ・][\u30a1-\u30fe]{2,8}|[\u0900-\u097f]{2,} [\u0900-\u097f]{2,}"
_UPW = rf"[{_UP}{_RU}]{{2,}}(?:['’\-][{_UP}{_RU}]+)*"
_SHOUT = rf"(?:{_UPW}|{_INITIAL})(?: {_INITIAL})*(?: (?:VAN|VON|DE|DER|DEN|DEL|DI|DA|DOS|LA))* {_UPW}"
_ANY = rf"(?P<v>{FULL}|{_PLAIN}|{_HAN})"
_NEXT = rf"(?P<v>{_SHOUT}(?!\w)|{_SHORT}|{_PLAIN}|{_HAN})"
#: Two or three capitalised words, with initials and particles, of which none is in capitals only.
_TWO = rf"(?P<v>[{_UP}{_RU}](?:[’'][{_UP}])?[^\W\d_A-Z{_RU}]+(?:['’\-][^\W\d_]+)*(?: {_INITIAL})*(?: {_PARTICLE})*(?: [{_UP}{_RU}](?:[’'][{_UP}])?[^\W\d_A-Z{_RU}]+(?:(?:['’\-]|(?<=Mc)|(?<=Mac))[^\W\d_]+)*){{1,2}})"
#: Verbs of persons, and what stands before a person's name.
_DEEDS = (
    "said", "says", "wrote", "writes", "asked", "asks", "told", "replied", "answered", "emailed", "agreed", "lives", "moved to", "was born", "suggested", "explained", "mentioned", "noticed", "complained", "apologised", "apologized", "retired", "promised",
    "sagte", "sagt", "schrieb", "schreibt", "fragte", "fragt", "antwortete", "wohnt", "meinte", "erklärte", "a dit", "a écrit", "a demandé", "a répondu", "habite", "a expliqué", "dijo", "escribió", "preguntó", "respondió", "vive en", "explicó",
    "disse", "escreveu", "perguntou", "respondeu", "mora em", "explicou", "сказал", "сказала", "написал", "написала", "спросил", "спросила", "ответил", "ответила", "живёт", "живет",
)
_STARTERS = "Then Later Yesterday Today Finally Now Also When Dann Gestern Heute Später Wenn Puis Hier Ensuite Quand Luego Ayer Hoy Cuando Depois Ontem Hoje Quando".split()
_MEETING = (
    "met with", "met", "spoke with", "spoke to", "talked to", "talked with", "according to", "on behalf of", "my colleague", "our colleague", "colleague", "employee", "patient", "tenant", "applicant", "married to", "neighbour", "neighbor", "gesprochen mit", "sprach mit",
    "meine kollegin", "mein kollege", "kollegin", "kollege", "mitarbeiterin", "mitarbeiter", "patientin", "parlé avec", "parlé à", "ma collègue", "mon collègue", "selon", "hablé con", "habló con", "mi colega", "según", "falei com", "falou com", "meu colega", "minha colega", "segundo",
)
_LINKING = set("with to of on en em mit con com avec à a was".split())


def _telling(cues: tuple[str, ...]) -> frozenset[str]:
    """The longest word of each cue, linking words aside; a line without any of them holds none of the cues."""
    return frozenset(max((w for w in cue.split() if w not in _LINKING), key=len) for cue in cues)


_DEED_WORDS, _MEETING_WORDS = _telling(_DEEDS), _telling(_MEETING)
#: Each with what a line must hold: a part of the text in lower case, or one of a set of words.
NAME_CUES = [
    (marks, re.compile(p))
    for marks, p in (
        (("ask ",), rf"(?<!\w)(?:Ask|ask) {_ANY} (?:before|about|for|if|first)\b"),
        (("ansprech", "kontakt", "zuständig", "verantwortlich"), rf"(?<!\w)(?i:ansprechperson|ansprechpartner(?:in)?|kontakt|zuständig|verantwortlich) (?:ist|:) ?{_ANY}"),
        (("voir avec", "contacter", "demander", "adresser"), rf"(?<!\w)(?i:voir avec|contacter|demander à|s'adresser à) {_ANY} (?:pour|en|si|avant)\b"),
        (("preguntar", "consultar", "hablar", "perguntar", "falar", "contactar"), rf"(?<!\w)(?i:preguntar a|consultar con|hablar con|perguntar a|falar com|contactar con) {_ANY} (?:si|se|para|por|antes)\b"),
        (("thank", "merci", "gracias", "obrigado", "danke", " by ", "assigned"), rf"(?<!\w)(?i:thanks to|thank you,?|merci à|gracias a|obrigado a|danke an|reported by|written by|reviewed by|approved by|assigned to) {_ANY}(?: for\b|[.,;)]|$|(?= for| pour| por| für))"),
        (("author", "-by:", "owner", "maintainer", "reviewer", "assignee", "contact", "customer", "patient", "employee", "name", "_by", "assigned_to", "nutzer", "nombre", "nom", "автор", "владелец", "负责人", "作者", "担当", "लेखक"), rf"(?i:@author|(?<!\w)\"?authors?\"?\s?[:=]|\\author\{{|signed-off-by:|co-authored-by:|reviewed-by:|acked-by:|tested-by:|reported-by:|(?<!\w)\"?(?:owner|maintainer|reviewer|assignee|contact|customer|patient|employee|full_?name|first_?name|last_?name|created_by|updated_by|approved_by|assigned_to|nutzer|nombre|nom|автор|владелец|负责人|作者|担当|担当者|लेखक)\"?\s?[:=|])\s?[\"']?{_NEXT}"),
        (("team", "équipe", "equipo", "equipe", "is on "), rf"(?:^|[.!?。।:] |\s){_ANY} (?:left the team|joined the team|is on (?:call|leave|vacation|holiday)|hat das Team verlassen|a quitté l'équipe|ha dejado el equipo|deixou a equipe)\b"),
        (("[",), rf"\[\d\d?:\d\d(?::\d\d)?\] ?<?{_ANY}>?:"),
        (("notes", "protokoll", "minutes", "présent", "attendees", "teilnehmer"), rf"(?i:meeting notes|protokoll|minutes|présents?|attendees|teilnehmer) ?[(:] ?{_ANY}(?=[,;)])"),
        (("dear", "hi ", "hello", "hallo", "bonjour", "hola", "olá", "liebe", "geehrte", "cher", "chère", "estimad", "уважаем", "здравствуйте"), rf"(?i:dear|hi|hello|hallo|bonjour|hola|olá|liebe[r]?|sehr geehrte[r]?|cher|chère|estimad[oa]|уважаем\w+|здравствуйте,?) (?P<v>{FULL})(?=[,!:\n]|$)"),
        # what people do, and whom one meets or names with a role: two capitalised words of any spelling
        (_DEED_WORDS, rf"(?:^|[.!?:;,(\"“] ?|\b(?:and|und|et|y|e|that|dass|que|but|when|as|while|because|{'|'.join(_STARTERS)}) )(?!(?:{'|'.join(_STARTERS)}) ){_TWO} (?:{'|'.join(_DEEDS)})\b"),
        (_MEETING_WORDS, rf"(?<!\w)(?i:{'|'.join(_MEETING)}) {_TWO}(?=[,.;:!?)\n]|$| (?:and|at|in|on|from|about|for|to|who|if|when|before|after|und|am|im|bei|über|et|à|au|sur|y|en|sobre|e|em|na|no)\b)"),
    )
]
BARE = re.compile(rf"(?<![\w@/.+\-&;])(?P<v>(?P<g>{_NAME})(?: {_INITIAL})*(?: {_PARTICLE})* {_NAME}|{_TITLE_SURE} (?:{_INITIAL} ?)*(?:{_PARTICLE} )*{_NAME}|{_NAME}, (?P<h>{_NAME})(?: {_INITIAL})?)(?![\w@]|[.+\-]\w)")
#: The cue of named fields, and the mark that follows a field's name.
_FIELD = next(p for marks, p in NAME_CUES if "author" in marks)
_FIELD_MARK = re.compile(r"[:=|{]|@[aA][uU][tT][hH][oO][rR]")
#: Words that begin no name.
NOT_NAMES = {
    "the", "a", "an", "this", "that", "these", "those", "release", "team", "bot", "platform", "support", "on", "if", "it", "we", "you", "they", "he", "she", "every", "each", "no", "all", "any", "some", "our", "your", "their", "its",
    "unknown", "none", "null", "todo", "tbd", "n", "nobody", "someone", "anyone", "who", "whoever", "der", "die", "das", "ein", "eine", "le", "la", "les", "el", "los", "las", "o", "os", "as", "un", "une", "uma", "um", "and", "or",
    "version", "dependabot", "renovate", "github", "gitlab", "jenkins", "admin", "root", "system", "user", "assistant", "both", "most", "after", "before", "please", "see", "make", "do", "there", "instead", "merged", "callers", "returns",
}
ORGANISATION = re.compile(r"(?i)\b(?:bot|team|gmbh|inc|ltd|llc|group|service|server|scheduler|pipeline|daemon|committee|department|crew|squad|desk|staff|guild|robot|agent|system|platform|release|ci)\b")
#: Five digits close to each other, the fewest that an identity number or a phone number has.
NUMERIC = re.compile(r"\d(?:[^\d\n]{0,6}\d){4}")
_DIGIT = re.compile(r"\d")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CAPITALS = re.compile(rf"[{_UP}{_RU}][^\W\d_]+")
_TITLES = ("Mr", "Ms", "Mx", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Doña", "г-")
LETTERS = re.compile(r"[^\W\d_]")


#: Words of which a line in ASCII holds one if a context of a name or a form of an address can stand in it.
_TELLING = frozenset(
    "ask ansprechperson ansprechpartner ansprechpartnerin kontakt verantwortlich voir contacter demander adresser preguntar consultar hablar perguntar falar contactar thank thanks merci gracias obrigado danke"
    " reported written reviewed approved assigned author authors signed authored acked tested owner maintainer reviewer assignee contact customer patient employee name fullname firstname lastname created updated nutzer nombre nom"
    " team equipe equipo call leave vacation holiday notes protokoll minutes presents present attendees teilnehmer dear hi hello hallo bonjour hola liebe lieber geehrte geehrter cher estimado estimada".split()
)
_TELLING |= frozenset(w for w in _DEED_WORDS | _MEETING_WORDS if w.isascii())
_PLACES = frozenset(w for marks in _ADDRESS_MARKS[:7] if marks for w in marks if w.isalpha() and w.isascii()) | frozenset(_WAY_WORDS) | frozenset("terrace crescent avenue av bd c avda o po address adresse anschrift domicilio endereco ship lives wohnhaft bp".split())
_ENDINGS = ("strasse", "str", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig", "markt", "graben", "hof", "berg", "chaussee", "stieg", "pfad", "direccion")
_PLAIN_WORD = re.compile(r"[a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")


def _named(v: str) -> bool:
    """Whether a text taken by its context is a person's name."""
    v = v.strip()
    first = re.split(r"[ ,]", v, maxsplit=1)[0].rstrip(".").lower()
    if ORGANISATION.search(v) or not LETTERS.search(v):
        return False
    if ord(v[0]) > 0x8FF:
        return True
    if re.match(rf"(?:{_TITLE} )", v):
        return True
    if first in NOT_NAMES and not re.match(r"\w\.", v):
        return False
    ws = re.findall(r"[^\W\d_]+", v)
    low = v == v.lower()
    if low:
        return any(w in _GIVEN_LOW for w in ws[:1] + ws[-1:])
    return bool(re.fullmatch(FULL, v)) or v == v.upper() and len(ws) >= 2


def _digits(v: str) -> int:
    return sum(c.isdigit() for c in v)


def _known_id(v: str) -> bool:
    """Validates a number that stands without a word for its kind."""
    d = re.sub(r"\W", "", v)
    if DNI.fullmatch(v):
        return DNI_LETTERS[int(d[:8]) % 23] == d[8]
    if RESIDENT.fullmatch(v):
        return "10X98765432"[sum(int(c) * w for c, w in zip(d, RESIDENT_WEIGHTS)) % 11] == d[17]
    if CPF.fullmatch(v):
        n = [int(c) for c in d]
        return all((sum(x * w for x, w in zip(n, range(k + 1, 1, -1))) * 10 % 11) % 10 == n[k] for k in (9, 10))
    return True


def line_mentions(line: str) -> Iterator[Mention]:
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    if "@" in line or "＠" in line or "﹫" in line or "&#" in line or "%40" in line or "&commat;" in line:
        for m in EMAIL.finditer(line):
            head = line[: m.start()]
            if m[1].lower() == "git" or re.search(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s\"'<>]*$", head) and "mailto:" not in head[-8:] or re.search(r"(?:\{\{?|\$\{|%)\w*\}?\}?$", head):
                continue
            taken.append(m.span())
            yield Mention(*m.span(), "email")
    low = line.lower()
    for mark, pattern in SPELT:
        if mark.search(line):
            for m in pattern.finditer(line):
                if free(*m.span()) and not m.group().isupper():
                    taken.append(m.span())
                    yield Mention(*m.span(), "email")
    if NUMERIC.search(line):
        for m in ID_CUE.finditer(line):
            v = m["v"]
            words = v.split()
            while words and not any(c.isdigit() for c in words[-1]):
                words.pop()
            if words and _digits(v := v[: v.rindex(words[-1]) + len(words[-1])]) >= 5 and free(m.start("v"), m.start("v") + len(v)):
                taken.append((m.start("v"), m.start("v") + len(v)))
                yield Mention(m.start("v"), m.start("v") + len(v), "id_number")
        for pattern in (SSN, CPF, DNI, NINO, RESIDENT):
            for m in pattern.finditer(line):
                if free(*m.span()) and not NOT_PHONE.search(line[: m.start()]) and _known_id(m.group()):
                    taken.append(m.span())
                    yield Mention(*m.span(), "id_number")
        # the digits of an account number are no phone number
        accounts = [m.span() for m in IBAN.finditer(line) if int("".join(str(int(c, 36)) for c in re.sub(" ", "", m.group()[4:] + m.group()[:4]))) % 97 == 1]
        for pattern in (*PHONES, PHONE_CUE, PHONE_AFTER):
            for m in pattern.finditer(line):
                a, b = m.span("v") if "v" in pattern.groupindex else m.span()
                if free(a, b) and not any(x < b and a < y for x, y in accounts) and 7 <= _digits(m.group()) <= 22 and not NOT_PHONE.search(line[:a]):
                    taken.append((a, b))
                    yield Mention(a, b, "phone")
    ascii_words = _PLAIN_WORD.findall(low) if line.isascii() else None
    place = ascii_words is None or not _PLACES.isdisjoint(ascii_words) or any(w.endswith(_ENDINGS) for w in ascii_words) or "b.p." in low or _CODE_BEFORE_CITY.search(line)
    if place and _DIGIT.search(line):
        for k, pattern in enumerate((*ADDRESSES, ADDRESS_CUE)):
            if not (_may_hold(k, line, low) if k < len(ADDRESSES) else any(w in low for w in _ADDRESS_WORDS)):
                continue
            for m in pattern.finditer(line):
                if free(*m.span()):
                    taken.append(m.span())
                    yield Mention(*m.span(), "address")
    context = ascii_words is None or "[" in line or not _TELLING.isdisjoint(ascii_words)
    all_words = ascii_words if ascii_words is not None else _WORDS.findall(low)
    for marks, pattern in NAME_CUES if context else ():
        if pattern is _FIELD and not _FIELD_MARK.search(line):
            continue
        held = not marks.isdisjoint(all_words) if isinstance(marks, frozenset) else any(x in low for x in marks)
        for m in pattern.finditer(line) if held else ():
            if _named(m["v"]) and free(*m.span("v")):
                taken.append(m.span("v"))
                yield Mention(*m.span("v"), "name")
    if GIVEN.isdisjoint(_CAPITALS.findall(line)) and not any(t in line for t in _TITLES):
        return
    for m in BARE.finditer(line):
        given = m["g"] or m["h"]
        if (given is None or not GIVEN.isdisjoint(given.split("-"))) and free(*m.span("v")) and not ORGANISATION.search(m["v"]):
            taken.append(m.span("v"))
            yield Mention(*m.span("v"), "name")


def mentions(text: str) -> Iterator[tuple[int, Mention]]:
    """Mentions with the number of their line; places are those of the text."""
    at = 0
    for n, line in enumerate(text.split("\n"), 1):
        if line:
            for m in line_mentions(line):
                yield n, Mention(at + m.start, at + m.end, m.kind)
        at += len(line) + 1


# --- pseudonyms ----------------------------------------------------------------------------------------------


def _mix(key: bytes, round_: int, radix: int, half: tuple[int, ...]) -> int:
    seed = bytes((round_, radix, len(half))) + bytes(half)
    return int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=16).digest())


def feistel(symbols: list[int], radix: int, key: bytes, back: bool = False) -> list[int]:
    """A keyed permutation of all sequences of this length over the symbols 0..radix-1; ``back`` undoes it."""
    n = len(symbols)
    if n < 2:
        shift = _mix(key, 255, radix, ()) % radix
        return [(s - shift if back else s + shift) % radix for s in symbols]
    cut = n // 2
    left, right = tuple(symbols[:cut]), tuple(symbols[cut:])

    def number(half: tuple[int, ...]) -> int:
        total = 0
        for s in half:
            total = total * radix + s
        return total

    def spread(value: int, length: int) -> tuple[int, ...]:
        out = []
        for _ in range(length):
            value, s = divmod(value, radix)
            out.append(s)
        return tuple(reversed(out))

    # odd rounds change the left part by the right one, even rounds the right part by the left one
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if r % 2 == 0:
            left = spread((number(left) + sign * _mix(key, r, radix, right)) % radix ** len(left), len(left))
        else:
            right = spread((number(right) + sign * _mix(key, r, radix, left)) % radix ** len(right), len(right))
    return [*left, *right]


def pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """The value with its digits and its Latin letters permuted; separators, case and format stay."""
    out = list(value)
    for alphabet in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        places = [i for i, c in enumerate(value) if c.upper() in alphabet and c.isascii()]
        if places:
            new = feistel([alphabet.index(value[i].upper()) for i in places], len(alphabet), key, back)
            for i, s in zip(places, new):
                out[i] = alphabet[s].lower() if value[i].islower() else alphabet[s]
    return "".join(out)


def permuted(n: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over a square that holds them, walked until it meets one of them again."""
    side = math.isqrt(max(size - 1, 0)) + 1
    width = (side.bit_length() + 7) // 8
    while True:
        left, right = divmod(n, side)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            half = right if r % 2 == 0 else left
            step = int.from_bytes(hashlib.blake2b(bytes((r, width)) + size.to_bytes(16) + half.to_bytes(width), key=key, digest_size=16).digest()) * (-1 if back else 1)
            if r % 2 == 0:
                left = (left + step) % side
            else:
                right = (right + step) % side
        n = left * side + right
        if n < size:
            return n


def _refilled(value: str, symbols: str) -> str:
    """The value with its digits and letters replaced in order; all else stays."""
    new = iter(symbols)
    return "".join(next(new) if c.isalnum() else c for c in value)


def _cpf_checks(base: str) -> str:
    for k in (10, 11):
        base += str(sum(int(x) * w for x, w in zip(base, range(k, 1, -1))) * 10 % 11 % 10)
    return base


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
_NINO_FIRST, _NINO_SECOND = "ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ"


def _day(y: str, m: str, d: str) -> int | None:
    """The number of a date from 1900 to 2099, from 0; None for what is no such date."""
    try:
        n = datetime.date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def _date(n: int) -> datetime.date:
    return datetime.date.fromordinal(_FIRST_DAY + n)


def checked_pseudonym(value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a valid identity number of a known form, again a valid one; None for all others."""
    d = re.sub(r"\W", "", value).upper()

    def moved(n: int, size: int) -> int:
        return permuted(n, size, key, back)

    if DNI.fullmatch(value) and _known_id(value):
        n = moved(int(d[:8]), 10**8)
        return _refilled(value, f"{n:08d}{DNI_LETTERS[n % 23]}")
    if CPF.fullmatch(value) and _known_id(value):
        return _refilled(value, _cpf_checks(f"{moved(int(d[:9]), 10**9):09d}"))
    if RESIDENT.fullmatch(value) and _known_id(value) and (day := _day(d[6:10], d[10:12], d[12:14])) is not None:
        rest, serial = divmod(moved(((int(d[:6]) - 100_000) * _DAYS + day) * 1000 + int(d[14:17]), 900_000 * _DAYS * 1000), 1000)
        region, day = divmod(rest, _DAYS)
        body = f"{region + 100_000}{_date(day):%Y%m%d}{serial:03d}"
        return _refilled(value, body + "10X98765432"[sum(int(c) * w for c, w in zip(body, RESIDENT_WEIGHTS)) % 11])
    if SSN.fullmatch(value) and _issued(d):
        n = moved(int(d), 10**9)
        while not _issued(f"{n:09d}"):
            n = moved(n, 10**9)
        return _refilled(value, f"{n:09d}")
    if NINO.fullmatch(value):
        n = (_NINO_FIRST.index(d[0]) * len(_NINO_SECOND) + _NINO_SECOND.index(d[1])) * 4_000_000 + int(d[2:8]) * 4 + "ABCD".index(d[8])
        head, tail = divmod(moved(n, len(_NINO_FIRST) * len(_NINO_SECOND) * 4_000_000), 4_000_000)
        a, b = divmod(head, len(_NINO_SECOND))
        return _refilled(value, f"{_NINO_FIRST[a]}{_NINO_SECOND[b]}{tail // 4:06d}{'ABCD'[tail % 4]}")
    return None


def _issued(ssn: str) -> bool:
    return ssn[:3] not in ("000", "666") and ssn[0] != "9" and ssn[3:5] != "00" and ssn[5:] != "0000"


#: Country codes of one and of two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_EXTENSION = re.compile(r"[^\d+]*[^\W\d_]")


def phone_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """A phone number with its national digits permuted among those of that length; country code, trunk zero and format stay."""
    stop = m.start() if (m := _EXTENSION.search(value, 3)) else len(value)
    body, extension = value[:stop], value[stop:]
    places = [i for i, c in enumerate(body) if c.isdigit()]
    digits = "".join(body[i] for i in places)
    skip = 0
    if body.lstrip().startswith(("+", "00")):
        skip = 0 if "+" in body else 2
        skip += next((n for n in (1, 2) if digits[skip : skip + n] in _CODES), 3)
    if digits[skip : skip + 1] == "0":
        skip += 1
    own = digits[skip:]
    if not own:
        return pseudonym(value, key, back)
    low = 0 if own[0] == "0" else 10 ** (len(own) - 1)
    new = digits[:skip] + f"{permuted(int(own) - low, 10 ** len(own) - low, key, back) + low:0{len(own)}d}"
    out = list(body)
    for i, c in zip(places, new):
        out[i] = c
    return "".join(out) + re.sub(r"\d+", lambda m: pseudonym(m[0], key, back), extension)


_DATE_FORMS = (
    (re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})"), (1, 3, 4), lambda d, m: f"{d:%Y}{m[2]}{d:%m}{m[2]}{d:%d}"),
    (re.compile(r"(\d{2})([-/.])(\d{2})\2(\d{4})"), (4, 3, 1), lambda d, m: f"{d:%d}{m[2]}{d:%m}{m[2]}{d:%Y}"),
    (re.compile(r"(\d{2})([-/.])(\d{2})\2(\d{4})"), (4, 1, 3), lambda d, m: f"{d:%m}{m[2]}{d:%d}{m[2]}{d:%Y}"),
)


def date_pseudonym(value: str, key: bytes, back: bool = False) -> str | None:
    """Another date in the same form; None for what is no date from 1900 to 2099. Day before month, if that gives a date."""
    for k, (form, groups, shown) in enumerate(_DATE_FORMS):
        m = form.fullmatch(value)
        if m and (n := _day(*(m[g] for g in groups))) is not None:
            n = permuted(n, _DAYS, key, back)
            while k == 2 and _date(n).day <= 12:  # it would be read the other way round
                n = permuted(n, _DAYS, key, back)
            return shown(_date(n), m)
    return None


#: What stands before a birth date.
BORN = re.compile(
    r"(?i)(?<!\w)(?:date of birth|birth ?date|birthday|dob|d\.o\.b\.|born(?: on)?|geburtsdatum|geboren(?: am)?|geb\.|date de naissance|née? le|fecha de nacimiento|nacid[oa] el|data de nascimento|nascid[oa] em|дата рождения|出生日期|生年月日|जन्म ?तिथि)"
    r"[\s:=\"']{1,4}(?P<v>\d{4}([-/.])\d{2}\2\d{2}|\d{2}([-/.])\d{2}\3\d{4})(?!\d)"
)


def birth_dates(text: str) -> Iterator[Mention]:
    """Birth dates, which are pseudonymized beside the five kinds."""
    for m in BORN.finditer(text):
        yield Mention(*m.span("v"), "date")


def placeholder(value: str, kind: str, key: bytes) -> str:
    """A typed placeholder; equal values, in any case and spacing, get equal ones. Numbers and dates keep their format."""
    made: dict[str, Callable[[], str | None]] = {"phone": lambda: phone_pseudonym(value, key), "id_number": lambda: checked_pseudonym(value, key), "date": lambda: date_pseudonym(value, key)}
    if kind in made:
        return f"[{kind.upper()} {made[kind]() or pseudonym(value, key)}]"
    plain = re.sub(r"\W+", " ", value.casefold()).strip()
    return f"[{kind.upper()} {hashlib.blake2b(plain.encode(), key=key, digest_size=6).hexdigest()}]"


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, kind): the lines on which personal information begins, a row for each kind.

    Kinds are email, phone, id_number, address and name. Lines end at a line feed
    and count from 1. Null and empty texts hold none; rows with a null key are
    left out. Repeated rows count once; copies under other keys count each. Extra
    columns are ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows |= {(k, n, m.kind) for n, m in mentions(t)}
            if rows:
                k, n, kind = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(kind)], ["doc_id", "line_no", "kind"])

    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    return source.mapInArrow(run, "doc_id long, line_no int, kind string").distinct()


def pseudonymize(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, mentions): each text with typed placeholders, and how many there are.

    A row for each row; a null text stays null with 0 mentions. ``secret`` keys
    the pseudonyms: with the same secret equal values stay linked.
    """
    seed = hashlib.sha256(secret.encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                found = sorted([*(m for _, m in mentions(t)), *birth_dates(t)]) if t else []
                out, last = [], 0
                for k, m in enumerate(found):
                    if m.start < last:  # a date inside a mention
                        found[k] = None
                        continue
                    out += [t[last : m.start], placeholder(t[m.start : m.end], m.kind, seed)]
                    last = m.end
                texts.append("".join([*out, t[last:]]) if found else t)
                counts.append(len(found) - found.count(None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "mentions"])

    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, text string, mentions int")
