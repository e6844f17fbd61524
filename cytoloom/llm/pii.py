"""Format-preserving Feistel pseudonyms for personal data.

Finds e-mail addresses, IBANs, card numbers, IP addresses, phone numbers, social security numbers and dates, keeps
those that are valid (checksums, ranges, calendar), and replaces each by another valid value of the same format. A
value is a number in a finite domain; a keyed Feistel network over two halves permutes the domain, walking on until
the image lies in the domain again. The same value has the same pseudonym everywhere, whatever its separators, so
records stay linked; whoever has the key can invert it.

What stays: separators, country and network codes, mail domains, the class of an address (private, public, ...), the
checksum's validity. No value is mapped onto itself, but for restricted domains (addresses by class, phone and social
security numbers, dates whose day and month could be swapped), where it happens as often as one in the size of the domain.

Nulls: a null text stays null, with zero counts. Long texts are searched whole. Overlapping finds: the kind listed
first in KINDS wins, then the leftmost. Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready
from .common import fresh

ROUNDS = 8
KINDS = ("email", "iban", "card", "ip", "phone", "ssn", "date")
KEY_SETTING, DEFAULT_KEY = "spark.cytoloom.pii.key", b"replace this key in production"


class Feistel:
    """Keyed permutation of range(size) for any size, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, k: int, half: int, tweak: bytes) -> int:
        data = b"%d|%d|" % (k, half) + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def permute(self, x: int, size: int, tweak: bytes, inside: Callable[[int], bool] | None = None) -> int:
        side = isqrt(max(size - 1, 0)) + 1
        while True:
            left, right = divmod(x, side)
            for k in range(ROUNDS):
                left, right = right, (left + self._round(k, right, tweak)) % side
            x = left * side + right
            if x < size and (inside is None or inside(x)):
                return x

    def invert(self, x: int, size: int, tweak: bytes, inside: Callable[[int], bool] | None = None) -> int:
        side = isqrt(max(size - 1, 0)) + 1
        while True:
            left, right = divmod(x, side)
            for k in reversed(range(ROUNDS)):
                left, right = (right - self._round(k, left, tweak)) % side, left
            x = left * side + right
            if x < size and (inside is None or inside(x)):
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_valid(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def iban_digits(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


#: Lengths of IBANs by country.
IBAN_LENGTHS = dict(pair.split(":") for pair in "AT:20 BE:16 BG:22 CH:21 CY:28 CZ:24 DE:22 DK:18 EE:20 ES:24 FI:18 FR:27 GB:22 GR:27 HR:21 HU:28 IE:22 IS:26 IT:27 LI:21 LT:20 LU:20 LV:21 MC:27 MT:31 NL:18 NO:15 PL:28 PT:25 RO:24 SE:24 SI:19 SK:24 SM:27 TR:26 UA:29 AE:23 SA:24 IL:23".split())


def _ibans(text: str) -> Iterator[tuple[int, str]]:
    """(start, found) of valid IBANs: of a match the part that ends with a token, has a right checksum and the country's
    length, else the longest with a right checksum; the search goes on behind it, or behind the match's country where
    there is none."""
    at = 0
    while m := IBAN.search(text, at):
        found, at, parts = m[0], m.start() + 4, []
        while found:
            bare = found.replace(" ", "")
            if 15 <= len(bare) <= 34 and iban_valid(bare):
                parts.append((len(bare) == int(IBAN_LENGTHS.get(bare[:2], 0)), len(found), found))
            found = found[: max(found.rfind(" "), 0)]
        if parts:
            yield m.start(), max(parts)[2]
            at = m.start() + max(parts)[1]


def _refill(template: str, digits: str) -> str:
    """``template`` with its digits replaced, in order."""
    feed = iter(digits)
    return "".join(next(feed) if c in "0123456789" else c for c in template)


def _mixed(text: str, permute: Callable[[int, int], int]) -> str:
    """Permutes letters within their case and digits, as one number of mixed radix."""
    bases = [(48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else None for c in text]
    value, size = 0, 1
    for c, b in zip(text, bases, strict=True):
        if b:
            value, size = value * b[1] + ord(c) - b[0], size * b[1]
    if size == 1:
        return text
    value = permute(value, size)
    out = []
    for c, b in zip(reversed(text), reversed(bases), strict=True):
        if b:
            value, d = divmod(value, b[1])
            c = chr(b[0] + d)
        out.append(c)
    return "".join(reversed(out))


def _nanp(x: int) -> bool:
    """Of ten digits as a number: area and exchange may not begin with 0 or 1."""
    return x >= 2_000_000_000 and x // 1_000_000 % 10 >= 2


def _ip_class(x: int) -> int:
    a, b = x >> 24, x >> 16 & 255
    if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168:
        return 1
    return 2 if a in (0, 127) or a >= 224 else 3 if a == 169 and b == 254 else 0


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


EPOCH, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
#: English month names.
MONTHS = "January February March April May June July August September October November December".split()

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
IP = re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
NAMED = "|".join(f"{m}|{m[:3]}\\.?" for m in MONTHS) + r"|Sept\.?"
DATE = re.compile(
    r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-])"
    rf"|\b(?:{NAMED}) \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}\b|(?<![\w./-])\d{{1,2}}(?:st|nd|rd|th)?\.? (?:{NAMED}),? \d{{4}}\b"
)


def _named(text: str, name: re.Match, new: datetime.date, padded: bool) -> str:
    """A date with a month's name in the form of ``text``: short or whole name, ordinal ending, order and signs."""
    month = MONTHS[new.month - 1]
    short = name[0] not in MONTHS or name[0] == "May" and text[name.end() : name.end() + 1] == "."
    rest = text[: name.start()] + "@" + text[name.end() :]
    ending = "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    day = f"{new.day:02d}" if padded and re.search(r"(?<!\d)0\d(?!\d)", rest) else str(new.day)
    rest = re.sub(r"\d{4}$", str(new.year), rest)
    rest = re.sub(r"(?<!\d)\d{1,2}(?!\d)(st|nd|rd|th)?", lambda m: day + (ending if m[1] else ""), rest, count=1)
    return rest.replace("@", month[:3] if short else month)


class Pseudonyms:
    """Finds values and gives their pseudonyms; ``invert`` gives the values of pseudonyms."""

    def __init__(self, key: bytes = DEFAULT_KEY, invert: bool = False):
        self.feistel = Feistel(key)
        self.inverse = invert
        self.rules = {"email": (EMAIL, self.email), "iban": (IBAN, self.iban), "card": (CARD, self.card), "ip": (IP, self.ip), "phone": (PHONE, self.phone), "ssn": (SSN, self.ssn), "date": (DATE, self.date)}

    def moved(self, x: int, size: int, tweak: str, inside: Callable[[int], bool] | None = None) -> int:
        """The image of x: a shift between the Feistel permutation and its inverse, which moves every value; in a
        restricted domain the permutation alone."""
        name, f = tweak.encode(), self.feistel
        if inside is not None or size < 2:
            return (f.invert if self.inverse else f.permute)(x, size, name, inside)
        step = 1 + f._round(ROUNDS, size, name) % (size - 1)
        return f.invert((f.permute(x, size, name) + (-step if self.inverse else step)) % size, size, name)

    def email(self, text: str) -> str | None:
        local, _, domain = text.partition("@")
        return f"{_mixed(local, lambda x, n: self.moved(x, n, f'email {len(local)}'))}@{domain}"

    def iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or not iban_valid(bare):
            return None
        account = _mixed(bare[4:], lambda x, n: self.moved(x, n, f"iban {bare[:2]}"))
        feed = iter(bare[:2] + iban_digits(bare[:2], account) + account)
        return "".join(c if c == " " else next(feed) for c in text)

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        payload = digits[0] + f"{self.moved(int(digits[1:-1]), 10**n, f'card {digits[0]} {n}'):0{n}d}"
        return _refill(text, payload + luhn_digit(payload))

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        x = int.from_bytes(bytes(parts), "big")
        kind = _ip_class(x)
        return ".".join(map(str, self.moved(x, 1 << 32, f"ip {kind}", lambda y: _ip_class(y) == kind).to_bytes(4, "big")))

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        plus = text.startswith("+") and not digits.startswith("1")
        if plus:
            if not 8 <= len(digits) <= 15:
                return None
            n = len(digits) - 2
            return _refill(text, digits[:2] + f"{self.moved(int(digits[2:]), 10**n, f'phone {digits[:2]} {n}'):0{n}d}")
        head, x = digits[:-10], int(digits[-10:])
        valid = _nanp(x)
        return _refill(text, head + f"{self.moved(x, 10**10, f'phone {valid}', lambda y: _nanp(y) == valid):010d}")

    def ssn(self, text: str) -> str | None:
        x = int(text.replace("-", ""))
        return _refill(text, f"{self.moved(x, 10**9, 'ssn', _ssn_valid):09d}") if _ssn_valid(x) else None

    def date(self, text: str) -> str | None:
        numbers = [int(x) for x in re.findall(r"\d+", text)]
        name = re.search("[JFMASOND][a-z]+", text)
        sep = "" if name else re.search(r"\D", text)[0]
        first = not name and text[:4].isdecimal()
        # of two numbers apart by slashes or dashes, the second is the day where it can't be a month
        american = not first and sep in ("/", "-") and numbers[1] > 12
        if name:
            (d, y), m = numbers, next(k for k, full in enumerate(MONTHS, 1) if full[:3] == name[0][:3])
        elif first:
            y, m, d = numbers
        elif american:
            m, d, y = numbers
        else:
            d, m, y = numbers
        try:
            x = (datetime.date(y, m, d) - EPOCH).days
        except ValueError:
            return None
        if not 0 <= x < DAYS:
            return None
        padded = all(len(p) == 2 for p in re.findall(r"\d+", text) if len(p) < 4)
        # the image keeps what tells day from month
        twofold = not first and sep in ("/", "-")
        fits = (lambda k: ((EPOCH + datetime.timedelta(k)).day > 12) == (d > 12)) if twofold else None
        new = EPOCH + datetime.timedelta(self.moved(x, DAYS, f"date {twofold and d > 12}", fits))
        if name:
            return _named(text, name, new, padded)
        if first:
            return f"{new.year}{sep}" + sep.join(f"{p:02d}" if padded else str(p) for p in (new.month, new.day))
        pair = (new.month, new.day) if american else (new.day, new.month)
        return sep.join([*(f"{p:02d}" if padded else str(p) for p in pair), str(new.year)])

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every valid value, without overlaps, by start."""
        kinds = KINDS if re.search(r"\d", text) else ("email",)
        taken: list[tuple[int, int, str, str]] = []
        for kind in kinds:
            if kind == "email" and "@" not in text:
                continue
            pattern, change = self.rules[kind]
            fresh_ones = []
            for start, found in _ibans(text) if kind == "iban" else ((m.start(), m[0]) for m in pattern.finditer(text)):
                if (new := change(found)) is not None:
                    fresh_ones.append((start, start + len(found), kind, new))
            if fresh_ones:
                taken = _merge(taken, fresh_ones)
        return taken

    def apply(self, text: str) -> tuple[str, dict[str, int]]:
        out, at, counts = [], 0, dict.fromkeys(KINDS, 0)
        for start, end, kind, new in self.spans(text):
            out += [text[at:start], new]
            at = end
            counts[kind] += 1
        return "".join([*out, text[at:]]) if out else text, counts


def _merge(first: list, second: list) -> list:
    """All of ``first`` and what of ``second`` overlaps none of it; both by start."""
    out, k = [], 0
    for x in second:
        while k < len(first) and first[k][1] <= x[0]:
            out.append(first[k])
            k += 1
        if (k == len(first) or first[k][0] >= x[1]) and (not out or out[-1][1] <= x[0]):
            out.append(x)
    return sorted([*out, *first[k:]])


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, text: str = "text", invert: bool = False) -> DataFrame:
    """``docs`` with the text changed, and n_<kind> int for every kind and n_pii long."""
    names = fresh(docs, *(f"n_{k}" for k in KINDS), "n_pii")
    ready(docs.sparkSession)
    # as Spark resolves names, whatever their letters' case
    place = docs.columns.index(text) if text in docs.columns else [c.lower() for c in docs.columns].index(text.lower())
    text = docs.columns[place]
    docs = docs.withColumn(text, F.col(f"`{text}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, invert)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(place):
                new, n = own.apply(t.as_py()) if t.is_valid else (None, dict.fromkeys(KINDS, 0))
                texts.append(new)
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            columns += [pa.array([n[k] for n in counts], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sum(n.values()) for n in counts], pa.int64())], names=[*batch.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{n}` {'int' if k < len(KINDS) else 'bigint'}" for k, n in enumerate(names)]
    return docs.mapInArrow(run, ", ".join(fields))


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting KEY_SETTING. Without it the queries work with DEFAULT_KEY, which is public: whoever
    reads this file can invert such pseudonyms, and a warning says so."""
    key = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    if key:
        return key.encode()
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms made with the public default key can be inverted by anyone", stacklevel=2)
    return DEFAULT_KEY


def op8_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, the text with pseudonyms, and the counts, one row for each row of ``docs``."""
    return pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key or session_key(docs.sparkSession))
