"""Format-preserving pseudonyms for personal data: keyed Feistel permutations.

Numbers and dates are found by pattern, validated (card check digit, calendar, octet and
area ranges), and permuted by a keyed Feistel network over the set of valid values of
their own format, walking the cycle until the result is valid again. The permutation
depends on key and kind alone, so equal values get equal pseudonyms in every document,
however they are written, different values never collide, and the key holder can undo it:
a day has one pseudonym in all layouts, a phone number one with any spacing, with or
without a bracketed trunk digit, and numbers in North American style are those of code 1.
Days stay in their span of 200 years, and on the same side of 10 in month and day and of
12 in day, so that the result is read in the layout of its source. Letters (of any script)
and digits of the local part of e-mail addresses are permuted within their character
class; ASCII letters link whatever their case. Not recognised: IPv6 addresses, dates with
month names, phone numbers without country code that have neither brackets nor separators
or start with a trunk digit.

A pattern may take more than the value: what follows it in the text is cut off by the
length of the format (IBAN by country, national phone numbers by country code, cards by
check digit), and an invalid find is tried as the other kinds at the same start. The cut
depends on nothing that the permutation changes, so the key holder finds the same values.

Every row is treated by itself; nothing is shuffled. Defined cases: a null text stays
null with no finds; an empty text stays empty; equal rows get equal results; an empty
table gives an empty result; other columns of the input are kept by ``pseudonymise``.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
ERA_YEARS = 200
EMAIL_PIECE = 32
# Patterns of the formats that are recognised.
PATTERNS = {
    "email": r"(?u:(?<![\w.+\u0300-\u036f-])[\w.+\u0300-\u036f-]+@(?:(?:[^\W_]|-)+\.)+[^\W\d_]{2,})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.ASCII)
# all but addresses start with one of these signs
FINDER_WITHOUT_AT = re.compile(r"(?=[A-Z\d+(])(?:" + "|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k != "email") + ")", re.ASCII)
SINGLE = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}
# Characters of an IBAN by country, most digits of a national number by
# country code (15 with the code elsewhere), card lengths as they are tried.
IBAN_LENGTHS = {
    k: int(n) for n, ks in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:HR,LI,LV,CH 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
        "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split()) for k in ks.split(",")
}
NATIONAL = {
    k: int(n) for n, ks in (x.split(":") for x in (
        "8:45,47,65,216,371,372,373,502,503,504,505,506,507,852,853 9:31,32,33,34,41,48,51,56,61,84,212,213,233,244,254,255,256,351,352,353,358,380,385,386,420,421,593,595,971,972 "
        "10:1,7,20,27,30,36,39,40,44,46,52,54,57,58,63,66,64,81,82,90,91,92,234,880 11:49,55,60,86 12:62 13:43"
    ).split()) for k in ks.split(",")
}
# Country codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DIGITS = re.compile(r"\d+", re.ASCII)
TRUNK_DIGIT = re.compile(r"[ .-]?\(\d\)", re.ASCII)
CARD_LENGTHS = (16, 15, 19, 14, 13, 17, 18)


def feistel(value: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A keyed permutation of range(size): alternating Feistel rounds over the two factors
    of the next product a*b >= size, repeated until the value falls below ``size``."""
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    steps = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    while True:
        left, right = divmod(value, b)
        for i in steps:
            seen, width = (right, a) if i % 2 == 0 else (left, b)
            mix = int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{i}|{seen}".encode(), key=key, digest_size=24).digest(), "big") % width
            mix = -mix if undo else mix
            if i % 2 == 0:
                left = (left + mix) % a
            else:
                right = (right + mix) % b
        value = left * b + right
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool], undo: bool = False) -> int:
    """The permutation restricted to valid values (cycle walking from a valid one)."""
    while True:
        value = feistel(value, size, key, tweak, undo)
        if valid(value):
            return value


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def has_check_digit(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def card_ends(text: str) -> list[int]:
    """Numbers of digits at which a card may end in a find, in the order they are tried."""
    ends = {len(re.sub(r"\D", "", text[: m.end()])) for m in re.finditer(r"\d+", text)}
    return [n for n in CARD_LENGTHS if n in ends]


def behind(text: str, digits: int) -> int:
    """Where the first ``digits`` digits of a text end."""
    return [m.end() for m in re.finditer(r"\d", text)][digits - 1]


def card(text: str, key: bytes, undo: bool) -> str | None:
    """A find that is a card as a whole, and not already one at an earlier end."""
    digits = re.sub(r"\D", "", text)
    ends = card_ends(text)
    if len(digits) not in ends or not has_check_digit(digits):
        return None
    first = ends[: ends.index(len(digits))]
    n = len(digits) - 1

    def fine(v: int) -> bool:
        full = (body := f"{v:0{n}d}") + luhn_digit(body)
        return len(set(full)) > 1 and not any(has_check_digit(full[:k]) for k in first)

    if not fine(int(digits[:-1])):
        return None
    tweak = "-".join(["card", *map(str, first)]) + f"{n}" if first else f"card{n}"
    body = f"{walk(int(digits[:-1]), 10**n, key, tweak, fine, undo):0{n}d}"
    return refill(text, body + luhn_digit(body))


def long_number(text: str, key: bytes, undo: bool) -> str | None:
    """Account-like digit runs without a valid check digit stay without one."""
    digits = re.sub(r"\D", "", text)
    n = len(digits)
    ends = sorted({*card_ends(text), n})
    plain = lambda v: not any(luhn_digit((s := f"{v:0{n}d}"[:k])[:-1]) == s[-1] for k in ends)
    if not plain(int(digits)):
        return None
    tweak = f"number{n}" if ends == [n] else "-".join(["number", *map(str, ends)])
    return refill(text, f"{walk(int(digits), 10**n, key, tweak, plain, undo):0{n}d}")


def date(text: str, key: bytes, undo: bool) -> str | None:
    sep = "-" if "-" in text else "." if "." in text else "/"
    parts = text.split(sep)
    year_first = len(parts[0]) == 4
    either = sep != "." and not year_first
    year, month, day = (0, 1, 2) if year_first else (2, 1, 0) if not either or int(parts[0]) > 12 else (2, 0, 1)
    try:
        given = dt.date(int(parts[year]), int(parts[month]), int(parts[day]))
    except ValueError:
        return None
    era = 1900 + (given.year - 1900) // ERA_YEARS * ERA_YEARS
    first, last = dt.date(max(era, 1), 1, 1).toordinal(), dt.date(min(era + ERA_YEARS - 1, 9999), 12, 31).toordinal()

    def read_as(d: dt.date) -> tuple[bool, bool, bool]:
        """What padding and the order of day and month depend on; no layout enters."""
        return d.month < 10, d.day < 10, d.day > 12

    def fine(value: int) -> bool:
        return read_as(dt.date.fromordinal(first + value)) == read_as(given)

    new = dt.date.fromordinal(first + walk(given.toordinal() - first, last - first + 1, key, f"date{era}", fine, undo))
    fields = {year: new.year, month: new.month, day: new.day}
    return sep.join(f"{fields[i]:0{len(parts[i])}d}" for i in range(3))


def ip(text: str, key: bytes, undo: bool) -> str | None:
    try:
        value = int(ipaddress.IPv4Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(feistel(value, 2**32, key, "ip", undo)))


def ssn(text: str, key: bytes, undo: bool) -> str | None:
    def fine(value: int) -> bool:
        area, rest = divmod(value, 10**6)
        return area not in (0, 666) and area < 900 and rest // 10**4 != 0 and rest % 10**4 != 0

    value = int(re.sub(r"\D", "", text))
    if not fine(value):
        return None
    return refill(text, f"{walk(value, 10**9, key, 'ssn', fine, undo):09d}")


def country_code(text: str) -> str:
    """Country codes are prefix-free, so the digits alone tell where the code ends."""
    if not text.startswith("+"):
        return "1"
    digits = re.sub(r"\D", "", text[:12])
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def national_start(text: str) -> int:
    """Where the national digits start: behind country code and bracketed trunk digit."""
    at = behind(text, len(country_code(text))) if text.startswith("+") else 0
    trunk = TRUNK_DIGIT.match(text, at)
    return trunk.end() if trunk else at


def phone_part(text: str) -> str:
    """The longest part of a find, of whole digit groups, that a national number allows."""
    code, start = country_code(text), national_start(text)
    most = NATIONAL.get(code, 15 - len(code))
    ends = [(len(re.sub(r"\D", "", text[start : m.end()])), m.end()) for m in DIGITS.finditer(text, start)]
    fits = [end for n, end in ends if 6 <= n <= most]
    longer = [end for n, end in ends if most < n <= 14]
    return text[: fits[-1] if fits else longer[0]] if fits or longer else text


def phone(text: str, key: bytes, undo: bool) -> str | None:
    """The national digits are permuted; country code and trunk digit stay."""
    start = national_start(text)
    rest = text[start:]
    digits = re.sub(r"\D", "", rest)
    if not 6 <= len(digits) <= 14:
        return None
    n = len(digits)
    return text[:start] + refill(rest, f"{feistel(int(digits), 10**n, key, f'phone{country_code(text)}-{n}', undo):0{n}d}")


def iban(text: str, key: bytes, undo: bool) -> str | None:
    def numeric(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s))

    plain = text.replace(" ", "")
    country, account = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or numeric(account + plain[:4]) % 97 != 1:
        return None
    places = [i for i, c in enumerate(account) if c.isdigit()]
    n = len(places)
    if n == 0:
        return None
    new = f"{feistel(int(''.join(account[i] for i in places)), 10**n, key, f'iban{country}{n}', undo):0{n}d}"
    account = refill(account, new)
    check = f"{98 - numeric(account + country + '00') % 97:02d}"
    rest = iter(country + check + account)
    return "".join(c if c == " " else next(rest) for c in text)


@functools.lru_cache(maxsize=1 << 12)
def alike(c: str) -> str:
    """The characters that may stand for ``c``: its category in its row of 128 code points;
    nothing for punctuation."""
    category = unicodedata.category(c)
    if category[0] not in "LNM":
        return ""
    row = range(ord(c) & ~127, (ord(c) | 127) + 1)
    return "".join(x for x in map(chr, row) if unicodedata.category(x) == category)


def email(text: str, key: bytes, undo: bool) -> str | None:
    """Each letter and digit of the local part stays one of its kind and case; the domain
    and the separators stay, so mail addresses keep their shape. Long local parts are
    permuted in pieces; separators in front are no part of the address."""
    local, _, domain = text.rpartition("@")
    front = local[: len(local) - len(local.lstrip("._+-"))]
    local = local[len(front) :]
    plain = [c.lower() if c.isascii() else c for c in local]
    kinds = [alike(c) for c in plain]
    places = [i for i, k in enumerate(kinds) if len(k) > 1]
    if not places:
        return None
    shape = "".join(k[0] if k else c for k, c in zip(kinds, plain, strict=True))
    out = list(local)
    for s in range(0, len(places), EMAIL_PIECE):
        piece = places[s : s + EMAIL_PIECE]
        size, value = 1, 0
        for i in piece:
            size, value = size * len(kinds[i]), value * len(kinds[i]) + kinds[i].index(plain[i])
        value = feistel(value, size, key, f"email{s}{shape}@{domain.lower()}", undo)
        for i in reversed(piece):
            value, rest = divmod(value, len(kinds[i]))
            new = kinds[i][rest]
            out[i] = new.upper() if local[i].isascii() and local[i].isupper() else new
    return front + "".join(out) + "@" + domain


RULES: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": email, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card, "number": long_number}


@functools.lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, text: str, key: bytes, undo: bool = False) -> str | None:
    """The pseudonym of a find, or None where it is not valid for its kind."""
    return RULES[kind](text, key, undo)


def iban_part(text: str) -> str:
    """A find cut to the length of its country, if a word ends there."""
    length = IBAN_LENGTHS.get(text[:2])
    ends = [i + 1 for i, c in enumerate(text) if c != " "]
    if not length or len(ends) <= length or text[ends[length - 1]] != " ":
        return text
    return text[: ends[length - 1]]


def parts(kind: str, text: str) -> list[tuple[str, str]]:
    """(kind, part): what a find may be, in the order that is tried."""
    if kind == "phone":
        return [(kind, phone_part(text))]
    if kind == "iban":
        return [(kind, iban_part(text))]
    if kind == "card":
        return [*((kind, text[: behind(text, n)]) for n in card_ends(text)), ("number", text)]
    return [(kind, text)]


def accepted(text: str, m: re.Match, key: bytes, undo: bool) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the first valid part at the start of a match."""
    kinds = [m.lastgroup, *(k for k in PATTERNS if k != m.lastgroup)]
    for kind in kinds:
        found = m if kind == m.lastgroup else SINGLE[kind].match(text, m.start())
        if found:
            for as_kind, part in parts(kind, found[0]):
                new = pseudonym(as_kind, part, key, undo)
                if new is not None:
                    return as_kind, m.start() + len(part), new
    return None


def replace(text: str, key: bytes, undo: bool = False) -> tuple[str, Counter]:
    """A text with all valid finds replaced, and their number by kind."""
    found: Counter = Counter()
    out, done, at = [], 0, 0
    finder = FINDER if "@" in text else FINDER_WITHOUT_AT
    while m := finder.search(text, at):
        got = accepted(text, m, key, undo)
        if got is None:
            at = m.start() + 1
            continue
        kind, end, new = got
        found[kind] += 1
        out += [text[done : m.start()], new]
        done = at = end
    return "".join(out) + text[done:], found


def pseudonymise(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_replaced`` and ``kinds`` (count by
    kind) as new columns in place of any of these names."""

    @F.pandas_udf("text string, n_replaced long, kinds map<string, long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [(None, Counter()) if t is None else replace(t, key, undo) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "n_replaced": [sum(c.values()) for _, c in done], "kinds": [dict(c) for _, c in done]})

    kept = docs.drop("n_replaced", "kinds")
    name = "found"
    while name in {c.lower() for c in kept.columns}:
        name += "_"
    return kept.withColumn(name, run("text")).withColumns({k: F.col(name)[k] for k in ("text", "n_replaced", "kinds")}).drop(name)
