"""Keyed surrogates: one-to-one maps of strings onto strings of the same format.

A string's format is the class of each of its characters. Within a format the strings are numbered, and a keyed
permutation of these numbers picks the surrogate. As the surrogate has the same format, different originals never share
one, and as the permutation is a single cycle, none is its own. Who has the key can go back: from each surrogate that is
given out the original is computed again, so two originals of one surrogate would be noticed where they stand.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from datetime import date
from functools import lru_cache
from ipaddress import IPv6Address
from math import isqrt

#: Alphabets whose characters stand in for each other: digits, and by script vowels and consonants.
ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåæéèêëíìîïóòôöõøœúùûü", "çñ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ")
_CLASS = {c: alphabet for alphabet in ALPHABETS for c in alphabet}
HEX = "0123456789abcdef"
#: Characters of the local part of an email that are no letters or digits.
_MARKS = dict.fromkeys("._%+-", "._%+-")
#: Endings of family names by gender, which stay.
ENDINGS = tuple(sorted("ова ева ёва ина ская цкая ая ов ев ёв ин ский цкий ой ый ová ovna eva ova ska cka ski cki".split(), key=len, reverse=True))
#: Words of addresses, which stay.
STREET = frozenset(
    "street st road rd avenue ave lane ln drive dr boulevard blvd court ct square sq way terrace close crescent place apt suite flat no floor rue place chemin allée impasse quai calle avenida plaza paseo camino straße strasse weg platz allee gasse de la le les du des der die das den dem am an im in zum zur von el los las".split()
)
#: Days that stand in for days of birth: from the first of January 1900 on.
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), 200 * 365
#: Domains that are kept for examples.
_EXAMPLES = {("example", last) for last in ("com", "org", "net")}
_PART = 32


@lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    if c == "ς":
        return "σ"
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    return c.lower() if len(c.lower()) == 1 else c


def folded(text: str) -> str:
    """The text as its surrogate depends on it: letter case, final sigmas and the script of digits aside."""
    return text.lower() if text.isascii() else "".join(map(_folded, text))


@lru_cache(maxsize=1 << 16)
def _alphabet(c: str) -> str | None:
    """The characters that stand in for a folded one; those of scripts without a class have their like of 256 code points."""
    if c in _CLASS:
        return _CLASS[c]
    kind = unicodedata.category(c)
    if not c.isalnum() or c == "ß":
        return None
    near = map(chr, range(ord(c) & ~255, (ord(c) | 255) + 1))
    near = [x for x in near if x not in _CLASS and unicodedata.category(x) == kind and _folded(x) == x and len(x.upper()) == 1 and _folded(x.upper()) == x and (kind != "Ll" or x.upper() != x)]
    return "".join(near) if len(near) > 1 and c in near else None


def _like(digit: str, c: str) -> str:
    """The digit in the script of the digit c."""
    return digit if c.isascii() else chr(ord(c) - unicodedata.decimal(c) + int(digit))


class Permutation:
    """A keyed permutation of the numbers below any size, made of one cycle; or the way back."""

    def __init__(self, key: bytes, rounds: int = 6, back: bool = False):
        self.key, self.rounds, self.step = key, rounds, -1 if back else 1

    def _mix(self, tweak: bytes, turn: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|" % (turn, value) + tweak, key=self.key, digest_size=48).digest())

    def _walk(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for turn in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._mix(tweak, turn, left)) % b
            else:
                left = (left + sign * self._mix(tweak, turn, right)) % a
        return left * b + right

    def __call__(self, x: int, size: int, tweak: bytes) -> int:
        """The number after x on the cycle (on the way back: before it); x itself only if size is 1."""
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        y = x
        while True:
            y = self._walk((self._walk(y, a, b, tweak, False) + self.step) % (a * b), a, b, tweak, True)
            if y < size:
                return y


class Surrogates:
    """Replacements by kind, the same for each mention of an entity, in the letter case of the mention.

    ``inverse`` has the same methods, which give the originals of surrogates.
    """

    def __init__(self, key: bytes, back: bool = False):
        if not 1 <= len(key) <= 64:
            raise ValueError("a key has 1 to 64 bytes")
        self.key, self.back, self.permutation = key, back, Permutation(key, back=back)
        self.inverse = self if back else Surrogates(key, True)

    def last_resort(self, kind: str, identity: str) -> str:
        """Of what has no way back: hexadecimal digits, which no two originals share but by chance (1 in 2^64 pairs)."""
        new = hashlib.blake2b(f"{kind}|{identity}".encode(), key=self.key, digest_size=16).hexdigest()
        return f"{new}@example.{identity.rpartition('.')[2]}" if kind == "email" else new

    def string(self, text: str, tweak: str, alphabets: dict[str, str] | None = None) -> str:
        """The text with each character replaced within its class; others stay, and letter case does."""
        classes = _alphabet if alphabets is None else alphabets.get
        out = []
        for at in range(0, len(text), _PART):
            part = text[at : at + _PART]
            low = list(map(_folded, part))
            sets = [classes(c) for c in low]
            size = number = 1
            number = 0
            for c, s in zip(low, sets, strict=True):
                if s:
                    size, number = size * len(s), number * len(s) + s.index(c)
            form = "".join(s[0] if s else c for c, s in zip(low, sets, strict=True))
            if size > 1:
                number = self.permutation(number, size, f"{tweak}|{at}|{form}".encode())
            for i in range(len(part) - 1, -1, -1):
                if s := sets[i]:
                    number, digit = divmod(number, len(s))
                    low[i] = s[digit]
            for i, (c, n) in enumerate(zip(part, low, strict=True)):
                if c.isdecimal():
                    low[i] = _like(n, c)
                elif n == "σ" and c == c.lower() and not text[at + i + 1 : at + i + 2].isalpha() and text[: at + i][-1:].isalpha():
                    low[i] = "ς"
                elif c != c.lower():
                    low[i] = n.upper()
            out += low
        return "".join(out)

    def digits(self, text: str, tweak: str) -> str:
        """The text with its digits replaced, whatever stands between them."""
        new = iter(self.string("".join(c for c in text if c.isdecimal()), tweak))
        return "".join(next(new) if c.isdecimal() else c for c in text)

    def email(self, text: str) -> str:
        """Each domain has one surrogate; its last label stays, as do the domains kept for examples."""
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        last = folded(labels[-1])
        keep = 2 if len(labels) > 1 and (folded(labels[-2]), last) in _EXAMPLES else 1
        for i in range(len(labels) - keep):
            labels[i] = self.string(labels[i], "domain")
            # no other domain becomes one of those for examples
            while i == len(labels) - 2 and (folded(labels[i]), last) in _EXAMPLES:
                labels[i] = self.string(labels[i], "domain")
        new = ".".join(labels)
        alphabets = None if any(map(_alphabet, folded(local))) else _MARKS
        return f"{self.string(local, 'local@' + folded(new if self.back else domain), alphabets)}@{new}"

    def phone(self, text: str) -> str:
        """The last ten digits are replaced together, so that a mention without the country's code gets the same."""
        count = sum(c.isdigit() for c in text)
        skip, at = max(0, count - 10), 0
        while skip:
            skip -= text[at].isdigit()
            at += 1
        return text[:at] + self.digits(text[at:], "phone")

    def card(self, text: str) -> str:
        """All digits but the last; that is as far from the right check digit as before."""
        old = [int(c) for c in text if c.isdecimal()]
        new = [int(c) for c in self.string("".join(map(str, old[:-1])), "card")]
        shift = (old[-1] - _check_digit(old[:-1])) % 10
        digits = iter([*new, (_check_digit(new) + shift) % 10])
        return "".join(_like(str(next(digits)), c) if c.isdecimal() else c for c in text)

    def ip(self, text: str) -> str:
        a, b, c, d = map(int, text.split("."))
        n = self.permutation(a << 24 | b << 16 | c << 8 | d, 1 << 32, b"ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def ip6(self, text: str) -> str:
        """Of an address the same surrogate however it is written, in the shortest form."""
        n = self.permutation(int(IPv6Address(text)), 1 << 128, b"ip6")
        new = IPv6Address(n).compressed
        return new.upper() if text != text.lower() else new

    def ssn(self, text: str) -> str:
        return self.digits(text, "ssn")

    def iban(self, text: str) -> str:
        """The country stays; the check digits are as far from the right ones as before, so other ones stay other ones."""
        plain = folded(text).upper().replace(" ", "")
        body = self.string(plain[4:], "iban" + plain[:2])
        shift = int(plain[2:4]) - _iban_check(plain[:2], plain[4:])
        new = iter(f"{plain[:2]}{(_iban_check(plain[:2], body) + shift) % 100:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def secret(self, text: str) -> str:
        if not all(c in HEX for c in folded(text)):
            new = self.string(text, "secret")
            while all(c in HEX for c in folded(new)):  # these stand for hexadecimal ones
                new = self.string(new, "secret")
            return new
        new = self.string(folded(text), "secret", dict.fromkeys(HEX, HEX))
        return new.upper() if text == text.upper() else new

    def given(self, name: str, names: tuple[str, ...]) -> str:
        """Another name of the same list, which holds names of one gender and script."""
        low = name.lower()
        new = names[self.permutation(names.index(low), len(names), ("given" + names[0]).encode())]
        return new.upper() if name.isupper() and len(name) > 1 else new.title()

    def family(self, name: str, given: dict[str, tuple[str, ...]] | None = None) -> str:
        """A name of the same format that is none of the given names (by their folded form); those have their own surrogates."""
        given = given or {}
        if names := given.get(folded(name)):
            return self.given(name, names)
        end = _ending(name)
        stem = len(name) - len(end)
        new = self.string(name[:stem], "family" + end) + name[stem:]
        # neither a given name nor one of another ending
        while folded(new) in given or _ending(new) != end:
            new = self.string(new[:stem], "family" + end) + name[stem:]
        return new

    def address(self, text: str) -> str:
        """The words for streets and what links words stay; names and numbers are replaced one by one."""
        parts = re.split(r"(\d+|[^\W\d_]+)", text)
        for i in range(1, len(parts), 2):
            low, end = folded(parts[i]), next((w for w in ("straße", "strasse", "weg", "platz", "allee", "gasse") if folded(parts[i]).endswith(w)), "")
            if low not in STREET:
                stem = len(parts[i]) - len(end)
                parts[i] = self.string(parts[i][:stem], "address" + end) + parts[i][stem:]
        return "".join(parts)

    def document(self, text: str) -> str:
        """The number of a passport or the like."""
        return self.string(text, "document")

    def birthdate(self, text: str) -> str:
        """Another day in the same way of writing; a day before 1900 or behind 2099, or that is none, has no surrogate."""
        parts = re.split(r"(\D+)", text)
        year = next((i for i in (0, 4) if len(parts[i]) == 4), None)
        if year is None:
            return text
        # the month is in the middle where the year leads; else it is what cannot be a day, or the second
        day, month = (4, 2) if year == 0 else (0, 2)
        try:
            day_of = date(int(parts[year]), int(parts[month]), int(parts[day])).toordinal() - FIRST_DAY
        except ValueError:
            return text
        if not 0 <= day_of < DAYS:
            return text
        new = date.fromordinal(FIRST_DAY + self.permutation(day_of, DAYS, b"birthdate"))
        for i, n in ((year, new.year), (month, new.month), (day, new.day)):
            parts[i] = str(n).zfill(len(parts[i]) if len(parts[i]) != 1 else 1)
        return "".join(parts)


def _ending(name: str) -> str:
    """The ending that tells the gender of a family name of five letters or more."""
    low = folded(name)
    return next((e for e in ENDINGS if low.endswith(e) and len(low) - len(e) >= 3), "")


def _iban_check(country: str, body: str) -> int:
    """The check digits of an IBAN."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _check_digit(digits: list[int]) -> int:
    """The Luhn check digit behind these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10
