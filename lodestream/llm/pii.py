"""Personal data and secrets, replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import re
import secrets
import sys
import unicodedata
from functools import lru_cache, partial
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import blocks, bound_batches, extended, mapped, table, texts_of
from lodestream.llm.html_text import STOP_WORDS
from lodestream.llm.names import GROUPS, PLACES, is_name
from lodestream.llm.surrogates import Surrogates, _check_digit, folded

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "secret", "document", "birthdate", "address", "person")
#: The setting that holds the key, in hexadecimal digits.
KEY_SETTING = "spark.lodestream.pii.key"

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "alice amelia andrea angela anna barbara carmen carolina caroline catherine charlotte christine claudia diana elena elizabeth emily emma eva francesca gabriela hannah helen ingrid isabel jane jennifer jessica julia karen katharina laura linda lucia margaret maria marie martha mary monica nadia nicole olivia patricia paula petra rachel rebecca sandra sarah silvia sofia sophie stephanie susan teresa ursula valentina vanessa victoria".split(),
    ("latin", "m"): "adam alan albert alexander alfred andreas andrew anthony antonio arthur benjamin carlos charles christian christopher daniel david diego dominik edward eduardo enrique eric fernando francisco frank friedrich gabriel george gustav hans heinrich henry hugo jacques james javier john jonathan jose joseph juan julian jürgen karl kevin klaus louis lucas luis marco mark martin matthew michael miguel nicolas oliver patrick paul pedro peter philip pierre ricardo richard robert samuel stefan stephen thomas tobias victor walter werner william wolfgang".split(),
    ("cyrillic", "f"): "александра алина анастасия анна вера виктория галина дарья екатерина елена ирина ксения людмила марина мария надежда наталья оксана ольга полина светлана татьяна юлия".split(),
    ("cyrillic", "m"): "александр алексей андрей борис виктор владимир георгий григорий дмитрий евгений иван игорь константин максим михаил николай олег павел пётр роман сергей фёдор юрий".split(),
    ("greek", "f"): "αικατερίνη άννα βασιλική γεωργία δήμητρα ελένη ευαγγελία ιωάννα κωνσταντίνα μαρία παναγιώτα σοφία".split(),
    ("greek", "m"): "αθανάσιος βασίλειος γεώργιος δημήτριος ευάγγελος ιωάννης κωνσταντίνος μιχαήλ νικόλαος παναγιώτης σπυρίδων χρήστος".split(),
}
_LIST = {name: tuple(names) for names in GIVEN.values() for name in names}
_FOLDED = {folded(name): names for name, names in _LIST.items()}
_TITLES = "Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Don|Doña|Dr|Prof"

#: Titles before and behind names in scripts without capitals, and the commonest Chinese family names.
_BEFORE = "السيد|السيدة|الدكتور|الدكتورة|الأستاذ|الأستاذة|מר|גברת|גב'|ד\"ר|פרופ'|श्री|श्रीमती"
_BEHIND = "先生|女士|小姐|博士|教授"
_CHINESE = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤張劉陳楊黃趙吳孫馬羅鄭許韓馮鄧"


def _class(category: str) -> str:
    """A class of all characters of a Unicode category."""
    found, out = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == category], []
    for c in found:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


_CAPITAL = _class("Lu")
_NAME = rf"{_CAPITAL}[^\W\d_]+(?:-{_CAPITAL}[^\W\d_]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
#: A keyword and a value: in quotes, or up to white space, a quote, "<" or "&". Behind other words than those for passwords
#: and a colon, a value without quotes is a secret only if it is long or has a digit, a sign or a capital within.
_SECRET = re.compile(
    r"(?<![^\W_])(?:(?P<pass>passwords?|passwd|pwd|passphrase|passcode)|(?:token|secret|api[_ -]?key|access[_ -]?key|secret[_ -]?key|secret[_ -]?access[_ -]?key|private[_ -]?key|auth[_ -]?token|access[_ -]?token))(?![^\W_])"
    r"[\"']?\s{0,4}(?P<sign>[:=])\s{0,4}(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|[\"']?(?P<bare>[^\s\"'<>&]+))",
    re.I,
)
#: A password that is told in a sentence has a digit or sign.
_TOLD = re.compile(r"(?<![^\W_])(?:passwords?|passcode|passphrase|passwort|kennwort|mot de passe|contraseña)\s{1,3}(?:is|was|ist|lautet|est|es)\s{1,3}[\"']?(?P<told>(?=[^\s\"']*[\d!#$%&*@^])[^\s\"']{4,}[^\s\"'.,;:!?)])", re.I)
#: Tokens of three parts in base64; how they begin stays.
_WEB_TOKEN = re.compile(r"(?<![\w-])eyJ(?P<web>[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})", re.A)
_TELLING = re.compile(r".{15}|.*[\d+/_-]|.+[A-Z]")
_BARE_END = re.compile(r"[^\w+/=-]+\Z")
#: Prefixes of keys that services give out; they stay.
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")
#: Behind the prefix 16 characters or more, letters and digits only or with dashes and a digit.
_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(_ISSUED)})(?P<secret>[A-Za-z0-9]{{16,}}(?![A-Za-z0-9_-])|(?=[A-Za-z_-]*\d)[A-Za-z0-9][A-Za-z0-9_-]{{14,}}[A-Za-z0-9]|[A-Za-z0-9]{{16,}}(?![A-Za-z0-9]))")
_IP6 = re.compile(rf"(?<![\w:.])(?=[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f]{{0,4}}:)[0-9A-Fa-f:]{{2,39}}(?:(?<=:){_OCTET}(?:\.{_OCTET}){{3}})?(?!\w|:\w|\.\d)")
_NUMBER = re.compile(
    rf"(?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!\w))"
    rf"|(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4})(?!\w|\.\d))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))"
)
_DIGITS = re.compile(r"\d+")
#: Phone numbers as they are written within a country: with a leading zero and gaps, or anything like it behind a word for it.
_PHONE_WORD = re.compile(r"(?:phone|tel|tél|telephone|téléphone|telefon|teléfono|telefonnummer|mobile|mobil|móvil|portable|handy|cell|fax|call|ring|whatsapp)\.?(?: (?:number|no|nr|me|us|is|at|on|him|her))*\.?[: ]{0,3}\Z", re.I)
_NATIONAL = re.compile(r"(?<![\w.,+/-])(?:0\d(?:[ .-]\d\d){4}|0\d{2}[ -]\d{4}[ -]\d{4}|0\d{3}[ -]\d{3}[ -]\d{4}|0\d{4}[ -]\d{6}|0\d{2,4}[ /-]\d{5,8}|(?P<asked>\(?\d(?:[ ()./-]{0,2}\d){6,13}))(?![\w/-]|[.,]\d)")
#: Words in front of numbers that are no addresses of the network.
_VERSION = re.compile(r"(?<![^\W_])(?:version|ver|v|release|build|section|chapter|§)\.?[ :]{0,2}\Z", re.I)
_CARD_WORD = re.compile(r"(?:card|visa|mastercard|amex|carte|karte|tarjeta|credit|debit)[ \w]{0,12}[.:# ]{0,3}\Z", re.I)
_DOCUMENT = re.compile(r"(?<![^\W_])(?:passport|passeport|reisepass|pasaporte|driver'?s licen[cs]e|identity card)(?: (?:number|no|nr|id))?\.?(?: is)?[:# ]{0,3}(?P<document>(?=[A-Z]{0,8}\d)[A-Z0-9]{6,12})(?![^\W_])", re.I)
_BORN = re.compile(r"(?<![^\W_])(?:born(?: on)?|date of birth|birth ?date|birthday|d\.?o\.?b\.?|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[:, ]{0,3}(?P<birthdate>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\d)", re.I)
#: A number and a street, or a street and a number.
_STREET_WORD = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square|Terrace|Crescent"
_ADDRESS = re.compile(
    rf"(?<![\w.,/-])\d{{1,5}}[A-Za-z]? (?:{_NAME} ){{1,3}}(?:{_STREET_WORD})(?![^\W_])"
    rf"|(?<![\w.,/-])\d{{1,4}},? (?:rue|avenue|boulevard|chemin|allée|impasse|quai) (?:(?:de|du|des|la|le|les) )*{_NAME}(?:[ -]{_NAME})?"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|el|las|los) )*{_NAME}(?: {_NAME})?,? \d{{1,4}}(?!\w)"
    rf"|(?<!\w){_CAPITAL}[^\W\d_]{{2,}}(?:straße|strasse|weg|platz|allee|gasse) \d{{1,4}}[a-z]?(?!\w)"
)
_SOME_STREET = re.compile(rf" (?:{_STREET_WORD})(?![^\W_])|rue |avenue |boulevard |chemin |allée |impasse |quai |Calle |Avenida |Plaza |Paseo |straße |strasse |weg |platz |allee |gasse ")
#: Behind a word that may be a given name, these aren't family names.
_PLACE = frozenset([*PLACES, *GROUPS])
_NO_FAMILY = _PLACE | {"up", "out", "off", "down", "in", "on", "it", "the", "as", "all", "and", "or"}
#: Words before a further word, some of which are given names; what stands before, and whether both have capitals, is
#: looked at afterwards, as a search is fast if it begins with few characters.
_PAIR = re.compile(r"[A-Z\u0080-\uffff][^\W\d_]++(?=(?: \w\.)? \w[^\W\d_])")
_ASCII_PAIR = re.compile(r"[A-Z][A-Za-z]++(?=(?: [A-Z]\.)? [A-Z][A-Za-z])")
_FAMILY = re.compile(rf"(?: {_CAPITAL}\.)? (?P<family>{_NAME})\b")
_TITLE_WORDS = frozenset(_TITLES.split("|"))
_FURTHER = re.compile(r" (?P<word>[^\W\d_]+)")
#: Behind a title a family name, or a given name and a family name.
_TITLED = re.compile(rf"(?:{_TITLES})\.? (?P<first>{_NAME})\b(?:(?: {_CAPITAL}\.)? (?P<second>{_NAME})\b)?")
#: In scripts without capitals a word or two behind a title, or a Chinese name before one.
_OTHERS = re.compile(rf"(?<!\w)(?:{_BEFORE})\.? (?P<first>[^\W\d_]{{2,}})(?: (?P<second>[^\W\d_]{{2,}}))?|(?P<chinese>[{_CHINESE}][一-鿿]{{1,2}}?)(?={_BEHIND})")
_CASELESS = re.compile("[\u0590-\u06ff\u0900-\u097f\u4e00-\u9fff]")
_BARE_NAME = re.compile(rf"(?<![^\W_]){_NAME}(?![^\W_])")
_WORDS = re.compile(r"[^\W\d_]+")
_TOLD_WORDS = ("password", "passcode", "passphrase", "passwort", "kennwort", "mot de passe", "contraseña")
_DOCUMENT_WORDS = ("passport", "passeport", "reisepass", "pasaporte", "licen", "identity card")
_BORN_WORDS = ("born", "birth", "dob", "d.o.b", "geboren", "geburt", "né", "naissance", "nacid", "nacimiento")
_STOP = frozenset(word for words in STOP_WORDS.values() for word in words)


def _numbers(text: str):
    """Matches of _NUMBER, tried only where digits start, or up to two characters before."""
    at = 0
    while digits := _DIGITS.search(text, at):
        at = digits.end()
        for start in range(max(0, digits.start() - 2), digits.start() + 1):
            if m := _NUMBER.match(text, start):
                yield m
                at = m.end()
                break


def _card(m: re.Match, text: str) -> bool:
    """Whether digits that may be a card's are: sixteen without gaps, a right check digit, or a word for it in front."""
    digits = [int(c) for c in m[0] if c.isdecimal()]
    return len(digits) == 16 == len(m[0]) or _check_digit(digits[:-1]) == digits[-1] and len(digits) != 13 or bool(_CARD_WORD.search(text, max(0, m.start() - 30), m.start()))


def _phones(text: str):
    """The spans of numbers as they are written within a country."""
    at = 0
    while digits := _DIGITS.search(text, at):
        at = digits.end()
        start = digits.start() - (text[digits.start() - 1 : digits.start()] == "(")
        if (m := _NATIONAL.match(text, start)) and (not m["asked"] or _PHONE_WORD.search(text, max(0, start - 30), start)):
            if 7 <= sum(map(str.isdecimal, m[0])) <= 14:
                yield m.span()
                at = m.end()


def _secrets(text: str):
    """The spans of values behind keywords."""
    for m in _SECRET.finditer(text):
        group = m.lastgroup
        start, end = m.span(group)
        if group == "bare":
            if over := _BARE_END.search(text, start, end):
                end = over.start()
            if not m["pass"] and m["sign"] == ":" and not _TELLING.match(text, start, end):
                continue
        if end > start:
            yield start, end


def _addresses(text: str):
    """The spans of IPv6 addresses; a full stop or colon behind one isn't part of it."""
    for m in _IP6.finditer(text):
        address = m[0] if m[0].endswith("::") else m[0].rstrip(":")
        try:
            IPv6Address(address)
        except AddressValueError:
            continue
        yield m.start(), m.start() + len(address)


def _without_capitals(text: str, names: set[str]):
    """The spans of these names in scripts without capitals: words, or in Chinese any characters; each is looked at once."""
    sizes = sorted({len(n) for n in names if n[0] in _CHINESE})
    begins = {n[0] for n in names if n[0] in _CHINESE}
    for word in _WORDS.finditer(text):
        if folded(word[0]) in names:
            yield word.span()
        elif sizes:
            for i in range(*word.span()):
                if text[i] in begins:
                    yield from ((i, i + n) for n in sizes if text[i : i + n] in names)


def _identity(kind: str, original: str) -> str:
    """The original as its surrogate depends on it; IPv6 addresses and days may be written in several ways."""
    if kind == "birthdate":
        return re.sub(r"\b0+", "", folded(original))
    return IPv6Address(original).exploded if kind == "ip" and ":" in original else folded(original)


def _begins(text: str, m: re.Match) -> bool:
    """Whether no letter or digit stands before the match."""
    return not m.start() or not text[m.start() - 1].isalnum()


def _checked(kind: str, original: str, new: str, surrogates: Surrogates) -> str:
    """The surrogate, if the way back from it leads to the original, so that no other original has it."""
    back, identity = surrogates.inverse, _identity(kind, original)
    if kind == "ip" and ":" in new:
        again = back.ip6(new)
    elif kind == "person":
        again = back.family(new, _FOLDED)
    else:
        again = getattr(back, kind)(new)
    return new if _identity(kind, again) == identity else surrogates.last_resort(kind, identity)


def _settled(kind: str, original: str, new: str, surrogates: Surrogates) -> str:
    """The surrogate that is given out; an address of letters that have none to stand in for them gets the last resort."""
    if folded(new) != folded(original):
        return _checked(kind, original, new, surrogates)
    return surrogates.last_resort(kind, folded(original)) if kind == "email" and any(map(str.isalpha, original.rpartition("@")[0])) else new


def entities(text: str, surrogates: Surrogates) -> list[tuple[int, int, str, str]]:
    """start, end, kind and surrogate of each entity, in order and without overlaps; the earlier kinds win.

    What has no character to replace, such as a line of dashes to fill in, is no entity.
    """
    found = []
    if "@" in text:
        found += [(*m.span(), "email", surrogates.email(m[0])) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(a, b, "secret", surrogates.secret(text[a:b])) for a, b in _secrets(text)]
    if any(map(text.__contains__, _ISSUED)):
        found += [(*m.span("secret"), "secret", surrogates.secret(m["secret"])) for m in _KEY.finditer(text)]
    if text.count(":") > 1:
        found += [(a, b, "ip", surrogates.ip6(text[a:b])) for a, b in _addresses(text)]
    low = text.lower()
    if any(word in low for word in _TOLD_WORDS):
        found += [(*m.span("told"), "secret", surrogates.secret(m["told"])) for m in _TOLD.finditer(text)]
    if "eyJ" in text:
        found += [(*m.span("web"), "secret", surrogates.secret(m["web"])) for m in _WEB_TOKEN.finditer(text)]
    for m in _numbers(text):
        kind = m.lastgroup
        if not (kind == "card" and not _card(m, text) or kind == "ip" and _VERSION.search(text, max(0, m.start() - 12), m.start())):
            found.append((*m.span(), kind, getattr(surrogates, kind)(m[0])))
    found += [(a, b, "phone", surrogates.phone(text[a:b])) for a, b in _phones(text)]
    for kind, pattern, words in (("document", _DOCUMENT, _DOCUMENT_WORDS), ("birthdate", _BORN, _BORN_WORDS)):
        if any(word in low for word in words):
            found += [(*m.span(kind), kind, getattr(surrogates, kind)(m[kind])) for m in pattern.finditer(text)]
    if _SOME_STREET.search(text):
        found += [(*m.span(), "address", surrogates.address(m[0])) for m in _ADDRESS.finditer(text)]
    for m in (_ASCII_PAIR if text.isascii() else _PAIR).finditer(text):
        if not _begins(text, m) or m[0] != m[0].title() or m[0] in _TITLE_WORDS or not (f := _FAMILY.match(text, m.end())):
            continue
        if (further := _FURTHER.match(text, f.end())) and further["word"].istitle() and folded(further["word"]) in _PLACE:
            continue
        given, family = m[0], f["family"]
        if names := _LIST.get(given.lower()):
            if folded(family) not in _NO_FAMILY:
                found.append((*m.span(), "person", surrogates.given(given, names)))
                found.append((*f.span("family"), "person", surrogates.family(family, _FOLDED)))
        elif family != family.upper() and is_name(given, family, text[max(0, m.start() - 40) : m.start()], text[f.end() : f.end() + 40]):
            found += [(*span, "person", surrogates.family(name, _FOLDED)) for span, name in ((m.span(), given), (f.span("family"), family))]
    for m in filter(partial(_begins, text), _TITLED.finditer(text)):
        for part in ("first", "second"):
            if m[part] and (part == "second" or m["second"] or folded(m["first"]) not in _FOLDED):
                found.append((*m.span(part), "person", surrogates.family(m[part], _FOLDED)))
    if not text.isascii() and _CASELESS.search(text):
        for m in _OTHERS.finditer(text):
            found += [(*m.span(part), "person", surrogates.family(m[part], _FOLDED)) for part in ("first", "second", "chinese") if m[part]]
    # names that were found stand for the same person wherever the document has them alone
    if names := {folded(text[a:b]) for a, b, kind, _ in found if kind == "person"} - _STOP:
        found += [(*m.span(), "person", surrogates.family(m[0], _FOLDED)) for m in _BARE_NAME.finditer(text) if folded(m[0]) in names]
        if plain := {n for n in names if unicodedata.category(n[0]) == "Lo"}:
            found += [(a, b, "person", surrogates.family(text[a:b], _FOLDED)) for a, b in _without_capitals(text, plain)]
    found = [(a, b, kind, _settled(kind, text[a:b], new, surrogates)) for a, b, kind, new in found]
    found = [e for e in found if folded(e[3]) != folded(text[e[0] : e[1]])]
    if len(found) < 2:
        return found
    out, last = [], 0
    for e in sorted(found, key=lambda e: (e[0], e[0] - e[1])):
        if e[0] >= last:
            out.append(e)
            last = e[1]
    return out


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, last = [], 0
    for start, end, _, surrogate in found:
        out += [text[last:start], surrogate]
        last = end
    return "".join([*out, text[last:]])


@lru_cache(maxsize=4)
def _surrogates(key: bytes) -> Surrogates:
    return Surrogates(key)


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's setting KEY_SETTING.

    Where it is unset the session makes a random one, and keeps it while it runs: surrogates then agree within the
    session and can't be undone afterwards. To get the same ones in another run, set a key and keep it secret.
    """
    set_ = spark.conf.get(KEY_SETTING, None)
    if set_:
        return bytes.fromhex(set_)
    sc = spark.sparkContext
    if not hasattr(sc, "_lodestream_key"):
        sc._lodestream_key = secrets.token_bytes(32)
    return sc._lodestream_key


def mapping(documents: DataFrame, key: bytes) -> DataFrame:
    """kind, original, surrogate: each pair once, as folded() has them. It holds the personal data itself."""
    bound_batches(documents.sparkSession)

    def run(batches):
        own = _surrogates(key)
        for batch in batches:
            pairs = {(kind, _identity(kind, text[a:b]), folded(new)) for text in texts_of(batch.column("text")).to_pylist() for a, b, kind, new in entities(text, own)}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs, strict=True)] or [pa.array([], pa.string())] * 3, names=["kind", "original", "surrogate"])

    return documents.select("text").mapInArrow(run, "kind string, original string, surrogate string").distinct()


def collisions(pairs: DataFrame) -> DataFrame:
    """kind and surrogate of which several originals, or which stands for itself: an audit of a mapping()."""
    grouped = pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("originals"), F.max(F.col("original") == F.col("surrogate")).alias("same"))
    return grouped.where("originals > 1 OR same")


def pseudonymised(documents: DataFrame, key: bytes) -> DataFrame:
    """documents with surrogates in text, and entities: kind, start and length in the old text, and the surrogate.

    The same entity gets the same surrogate everywhere (letter case, spaces and dashes between digits, and a phone
    number's country code aside), different ones get different ones of the same format; a given name gets one of the
    same gender and script. That needs no second scan and no shuffle: the surrogates of each kind are a permutation,
    and each one is checked where it is made, by computing the original from it. What fails that is replaced by keyed
    hexadecimal digits. Null texts stay null and hold no entities. Rows are read one by one, so ties, repeated rows and
    other columns change nothing; an own column named entities is replaced.
    """
    bound_batches(documents.sparkSession)
    documents = documents.drop("entities")
    _surrogates(key)  # a wrong key is an error here rather than in the tasks
    plain = documents.columns
    at = plain.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())]))

    def run(batches):
        own = _surrogates(key)
        for batch in batches:
            for part in blocks(batch, "text"):
                texts, found = [], []
                for text in part.column("text").to_pylist():
                    spans = entities(text, own) if text else []
                    texts.append(replaced(text, spans) if spans else text)
                    found.append([{"kind": k, "start": a, "length": b - a, "surrogate": new} for a, b, k, new in spans])
                columns = part.columns
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*plain, "entities"])

    return mapped(documents, run, extended(documents, "entities array<struct<kind:string,start:int,length:int,surrogate:string>>"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return done.select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), *map(count, KINDS))
