"""Personal data: detection, and keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity within all texts of its shape: digits stay digits, letters stay
letters of their script and case, separators stay where they are. Within a shape a permutation cannot map two
entities to one, and it needs no table: the same entity gets the same surrogate in every document, on every
executor, at every run with the same key. Types add what their format asks for: cards keep their first digit
and how far their last digit is off the checksum, account numbers their remainder by 97, phones their country code, addresses
stay in their range, e-mails keep their top-level domain and share surrogates of domains, secrets keep their marker, names
become pronounceable names of the same script, given names with an ending of their gender. What a word of a name becomes
depends on the word alone, not on a title or a place, so a person is the same one wherever they are mentioned.

The key is a secret: who has it can undo the permutations. It is an argument of every function here; queries take it from the
session's spark.turnloom.surrogateKey or, where that is unset, draw one for the application, so that other
applications give other surrogates.

Defined results: a null text stays null, an empty one empty, neither has entities. Texts are read whole, in time linear in their
length. Repeated rows get the same surrogates. Only the text column is read; others may have any name.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop

#: Where the key is looked for, and the keys drawn for applications that name none.
KEY_CONF = "spark.turnloom.surrogateKey"
_DRAWN: dict[str, bytes] = {}
_ROUNDS = 8
#: Characters that are permuted as one number; longer texts go block by block.
_BLOCK = 64
#: Letters up to which a name's word becomes a pronounceable one; longer words keep their length.
NAME_LETTERS = 40
#: How often a surrogate that another entity has is drawn anew before the job gives up.
REDRAWS = 8

# Titles that come before a name, and given names by gender.
TITLES = (
    "Mr", "Mister", "Sir", "Mrs", "Ms", "Miss", "Madam", "Dr", "Prof", "Herr", "Herrn", "Frau", "Monsieur", "Madame", "Mme", "Mlle",
    "Sr", "Señor", "Sra", "Señora", "Srta", "Don", "Doña", "Господин", "Госпожа", "Κύριος", "Κυρία",
)
#: Small words inside a name; they stay.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "zur", "bin", "al", "y")
WOMEN = (
    "mary", "patricia", "jennifer", "linda", "elizabeth", "susan", "jessica", "sarah", "karen", "lisa", "nancy", "emily", "anna", "emma", "julia", "laura", "alice", "jane",
    "marie", "claire", "sophie", "camille", "julie", "maria", "carmen", "ana", "lucia", "elena", "isabel", "sabine", "petra", "ursula", "katrin", "ingrid",
    "анна", "мария", "елена", "ольга", "наталья", "ирина", "μαρία", "ελένη", "άννα", "σοφία",
)
MEN = (
    "james", "robert", "john", "michael", "david", "william", "richard", "thomas", "charles", "daniel", "paul", "mark", "george", "peter", "martin", "adam", "bob", "tom",
    "jean", "pierre", "michel", "philippe", "luc", "jose", "juan", "carlos", "miguel", "luis", "pedro", "hans", "klaus", "stefan", "jürgen", "karl",
    "иван", "алексей", "сергей", "дмитрий", "андрей", "николай", "γιώργος", "δημήτρης", "νίκος", "κώστας",
)
_GIVEN = dict.fromkeys(WOMEN, "f") | dict.fromkeys(MEN, "m")
#: Ends of a given name by script and gender; none is known: no ending.
ENDINGS = {"latin": {"f": "a", "m": "o"}, "cyrillic": {"f": "а", "m": ""}, "greek": {"f": "α", "m": "ος"}}
CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдклмнпрстф", "greek": "βγδκλμνπρστφχ"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = {
    "latin": _LOWER + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])) + "œšžłńśźżąęćčďěňřťůőű",
    "cyrillic": "".join(map(chr, range(0x430, 0x460))),
    "greek": "".join(map(chr, range(0x3AC, 0x3CF))),
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9.-]*")
_LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")
_TOP = re.compile(r"[A-Za-z]{2,}")
_SECRET = re.compile(
    r"\b(?P<aws>AKIA|ASIA)[A-Z0-9]{16}\b"
    r"|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)(?P<to>[\"']?\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_+/.\-]{6,}=*)"
)
_MIXED = re.compile(r"\d|[a-z][A-Z]|[_+/=]|[.\-].*[.\-]")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_CARD = re.compile(r"(?<![\d-])[3-6]\d(?:[ -]?\d){11,17}(?![\d-])")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d)")
#: Lengths of the numbers that issuers give out.
_ISSUED = re.compile(r"3[47]\d{13}|3[0689]\d{12,17}|35\d{14,17}|4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|(?:5[06-9]|6\d)\d{11,17}")
#: Calling codes: 1 and 7, those of two digits, else three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")
_WORD = r"[^\W\d_]+"
_PART = rf"(?:[^\W\d_]\.|{_WORD}(?:[-'’]{_WORD})*)"
_TITLE = "|".join(sorted({*TITLES, *(t.upper() for t in TITLES)}, key=lambda t: (-len(t), t)))
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
_NAME = re.compile(rf"\b(?:{_TITLE})\.? (?P<name>{_SMALL}{_PART}(?: {_SMALL}{_PART}){{0,3}})")
_MENTION = re.compile(rf"(?<!\w){_WORD}(?!\w)")
_HEX = re.compile("[0-9a-f]+")
_HINT = re.compile(r"[0-9@=:]")


def _digest(key: bytes, tweak: str, part: int, value: int, bits: int) -> int:
    """A keyed number of up to `bits` bits."""
    text = f"{len(key)}|{part}|{bits}|{value:x}|{tweak}".encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.shake_256(key + text).digest((bits + 7) // 8), "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on enough bits, walked until it lands inside."""
    if size < 2:
        return value
    half = (max((size - 1).bit_length(), 2) + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(_ROUNDS):
            left, right = right, left ^ _digest(key, tweak, r, right, half)
        value = left << half | right
        if value < size:
            return value


def _alphabet(c: str) -> str:
    """The letters that may stand for c: digits, or letters of its script and case; '' if it stays."""
    if c in _DIGITS:
        return _DIGITS
    if c in _LOWER:
        return _LOWER
    if c in _UPPER:
        return _UPPER
    low = c.lower()
    for letters in _LETTERS.values():
        if low in letters and len(low) == 1:
            return letters if c == low else "".join(x.upper() for x in letters if len(x.upper()) == 1 and x.upper().lower() == x)
    if "\u4e00" <= c <= "\u9fff":
        return _han()
    return ""


@lru_cache(1)
def _han() -> str:
    return "".join(map(chr, range(0x4E00, 0xA000)))


def shape_permute(text: str, key: bytes, tweak: str, free: Callable[[int, str], bool] = lambda i, c: True) -> str:
    """The text with its free characters permuted together within their alphabets; others stay.

    More than a block of them go block by block, each under what the blocks before it became.
    """
    places = [(i, a) for i, c in enumerate(text) if free(i, c) and (a := _alphabet(c)) and c in a]
    out = list(text)
    for i, a in places:
        out[i] = a[0]
    tweak = f"{tweak}|{''.join(out)}"
    if len(places) > _BLOCK:
        tweak = hashlib.sha256(tweak.encode("utf-8", "surrogatepass")).hexdigest()
    for at in range(0, len(places), _BLOCK):
        part = places[at : at + _BLOCK]
        value, size = 0, 1
        for i, a in part:
            value, size = value * len(a) + a.index(text[i]), size * len(a)
        value = permute(value, size, key, tweak)
        for i, a in reversed(part):
            value, digit = divmod(value, len(a))
            out[i] = a[digit]
        tweak = hashlib.sha256(f"{tweak}|{''.join(out[i] for i, _ in part)}".encode("utf-8", "surrogatepass")).hexdigest()
    return "".join(out)


def luhn(digits: str) -> int:
    """Checksum of a card number, 0 if it is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10


def _bare(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def _laid_out(text: str, bare: str) -> str:
    """bare in the layout of text, whose separators stay."""
    chars = iter(bare)
    return "".join(next(chars) if c.isalnum() else c for c in text)


def card(text: str, key: bytes) -> str:
    """First digit and layout stay, the rest is permuted, the last digit is as right or wrong as before. One number in
    two layouts has one surrogate."""
    bare = _bare(text)
    new = shape_permute(bare, key, "card", lambda i, c: 0 < i < len(bare) - 1)[:-1]
    return _laid_out(text, f"{new}{(luhn(bare) - luhn(new + '0')) % 10}")


def card_span(text: str) -> tuple[int, int] | None:
    """The longest run of a text's groups of digits that is a card number: its checksum is right, its length is issued."""
    groups = [m.span() for m in re.finditer(r"\d+", text)]
    spans = [(lo, hi) for k, (lo, _) in enumerate(groups) for _, hi in groups[k:] if hi - lo >= 13]
    fit = [x for x in spans if _ISSUED.fullmatch(bare := _bare(text[slice(*x)])) and not luhn(bare)]
    return max(fit, key=lambda x: x[1] - x[0], default=None)


def phone(text: str, key: bytes) -> str:
    """Country code and layout stay; the national number is permuted, whatever its layout. Ten digits without a country are
    numbers of country 1, as the layouts looked for are those of its plan."""
    bare = _bare(text)
    after = _COUNTRY.match(bare).end() if text.startswith("+") else 0
    country = bare[:after] or ("1" if len(bare) == 10 else "")
    return _laid_out(text, bare[:after] + shape_permute(bare[after:], key, f"phone {country}"))


def ssn(text: str, key: bytes) -> str:
    """Numbers that can have been given out stay such, others stay others."""
    valid = lambda a, g, n: 0 < a < 900 and a != 666 and g > 0 and n > 0
    parts = tuple(map(int, text.split("-")))
    kind = valid(*parts)
    value = parts[0] * 10**6 + parts[1] * 10**4 + parts[2]
    while True:
        value = permute(value, 10**9, key, "ssn")
        area, group, number = value // 10**6, value // 10**4 % 100, value % 10**4
        if valid(area, group, number) == kind:
            return f"{area:03}-{group:02}-{number:04}"


_RANGES = ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (169 << 24 | 254 << 16, 16))


def _range_of(number: int) -> int | None:
    return next((k for k, (base, bits) in enumerate(_RANGES) if number >> bits == base >> bits), None)


def ip(text: str, key: bytes) -> str | None:
    """An address of the same range (private, loopback, public), with leading zeros where there were some; not an address: None."""
    parts = list(map(int, text.split(".")))
    if max(parts) > 255:
        return None
    number = parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]
    kind = _range_of(number)
    if kind is not None:
        base, bits = _RANGES[kind]
        number = base | permute(number - base, 1 << bits, key, f"ip{kind}")
    elif 1 <= parts[0] < 224:
        while True:
            number = permute(number, 1 << 32, key, "ip")
            if 1 << 24 <= number < 224 << 24 and _range_of(number) is None:
                break
    else:
        number = parts[0] << 24 | permute(number & 0xFFFFFF, 1 << 24, key, f"ip first {parts[0]}")
    return ".".join(f"{number >> s & 255:0{len(p) if p[0] == '0' else 1}}" for s, p in zip((24, 16, 8, 0), text.split("."), strict=True))


#: Ranges of addresses that stay among themselves: bits of the prefix and its value; others keep their first eight bits.
_RANGES6 = ((10, 0xFE80 >> 6), (7, 0xFC00 >> 9), (3, 0x2000 >> 13))


def ip6(text: str, key: bytes) -> str | None:
    """An address of the same range, as short or as long as it was; loopback, unspecified and what is no address: None."""
    try:
        number = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if number < 2:
        return None
    fixed = next((bits for bits, value in _RANGES6 if number >> (128 - bits) == value), 8)
    free = 128 - fixed
    top, low = number >> free, number & ((1 << free) - 1)
    low = permute(low, 1 << free, key, f"ip6 {fixed} {top}")
    if top == 0 and low < 2:
        low = permute(low, 1 << free, key, f"ip6 {fixed} {top}")
    new = ipaddress.IPv6Address(top << free | low)
    out = str(new)
    if "::" not in text:
        groups = new.exploded.split(":")
        out = ":".join(groups if all(len(x) == 4 for x in text.split(":")) else [f"{int(x, 16):x}" for x in groups])
    return out.upper() if any(c.isupper() for c in text) else out


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses, found from each @ outwards, so that no part of the text is looked at more than twice."""
    at, before = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > before and _LOCAL.match(text[lo - 1]):
            lo -= 1
        whole = lo == 0 or not _LOCAL.match(text[lo - 1]) or lo == before
        while lo < at and not text[lo].isalnum():
            lo += 1
        if whole and lo < at and not (lo and (text[lo - 1].isalnum() or text[lo - 1] == "_")):
            end, best, pos = _DOMAIN.match(text, at + 1).end(), None, at + 1
            while pos < end:
                stop = text.find(".", pos, end)
                stop = end if stop < 0 else stop
                top = _TOP.match(text, pos, stop)
                if top and pos > at + 1:
                    best = top.end()
                if not _LABEL.fullmatch(text, pos, stop):
                    break
                pos = stop + 1
            if best is not None:
                yield lo, best
                before = best
        before = max(before, at + 1)
        at = text.find("@", at + 1)


def email(text: str, key: bytes) -> str:
    """The labels of the domain are permuted as one, then the local part under its domain, lower or upper case alike; what
    follows the last dot stays, as do the domains reserved for examples."""
    local, domain = text.lower().split("@")
    tail = re.search(r"(?:(?:^|(?<=\.))example)?\.[a-z]{2,}$", domain)
    out = shape_permute(local, key, f"local {domain}") + "@" + shape_permute(domain, key, "domain", lambda i, c: i < tail.start())
    return "".join(b.upper() if a.isupper() else b for a, b in zip(text, out, strict=True))


def secret(text: str, key: bytes) -> str:
    """Lower-case hex stays such, anything else keeps its digits and letters in place."""
    if _HEX.fullmatch(text):
        value = permute(int(text, 16), 16 ** len(text), key, f"hex {len(text)}")
        return f"{value:0{len(text)}x}"
    while True:
        text = shape_permute(text, key, "secret")
        if not _HEX.fullmatch(text):
            return text


def _mod97(account: str, head: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + head)) % 97


def iban(text: str, key: bytes) -> str:
    """Country and layout stay; the account is permuted, and the check digits leave the same remainder by 97 as before."""
    bare = _bare(text)
    country, check, account = bare[:2], bare[2:4], bare[4:]
    account_new = shape_permute(account, key, f"iban {country} {int(check) // 97}")
    digits = (_mod97(account, country + check) - _mod97(account_new, country + "00")) % 97
    return _laid_out(text, f"{country}{digits + 97 * (digits < 2):02}{account_new}")


def script_of(word: str) -> str | None:
    low = word.lower()
    return next((s for s, letters in _LETTERS.items() if all(c in letters for c in low)), None)


@lru_cache(1 << 16)
def name_word(word: str, key: bytes) -> str:
    """A pronounceable name of the same script, one for each word: its number among all words of up to its length
    is permuted within its length and spelled in syllables. A given name whose gender is known gets an ending for it."""
    low, script = word.lower(), script_of(word)
    if script is None:  # hyphens, apostrophes and the dot of an initial stay; a word of another script is permuted within it
        parts = re.split(r"([-'’.])", word)
        return "".join(p if k % 2 else name_word(p, key) if p != word else shape_permute(p, key, "name") for k, p in enumerate(parts)) if len(parts) > 1 else shape_permute(word, key, "name")
    if len(low) > NAME_LETTERS:
        out = shape_permute(low, key, f"name {script}")
        return out.upper() if word.isupper() else out.capitalize()
    letters, value, below = _LETTERS[script], 0, 0
    for c in low:
        value = value * len(letters) + letters.index(c)
    for n in range(1, len(low)):
        below += len(letters) ** n
    number = below + permute(value, len(letters) ** len(low), key, f"name {script} {len(low)}")
    syllables = [c + v for c in CONSONANTS[script] for v in VOWELS[script]]
    spelled = ""
    while True:  # each number has one spelling
        number, at = divmod(number, len(syllables))
        spelled = syllables[at] + spelled
        if not number:
            break
        number -= 1
    spelled += ENDINGS[script].get(_GIVEN.get(low, ""), "")
    return spelled.upper() if word.isupper() and len(word) > 1 else spelled.capitalize()


def name(text: str, key: bytes) -> str:
    return " ".join(w if w in PARTICLES else name_word(w, key) if w else w for w in text.split(" "))


def _titled(text: str) -> list[tuple[int, str]]:
    """(place, name) of capitalised words behind a title."""
    out = []
    for m in _NAME.finditer(text):
        kept, full = [], 0
        for w in m["name"].split(" "):
            if w not in PARTICLES:
                if not w[0].isupper() or full == 3:
                    break
                full += not w.endswith(".")
            kept.append(w)
        while kept and kept[-1] in PARTICLES:
            kept.pop()
        if kept:
            out.append((m.start("name"), " ".join(kept)))
    return out


def _mentions(text: str, known: set[str], most: int) -> Iterator[tuple[int, int]]:
    """Places of known names, the longest at each word, in one walk over the words."""
    words = [m.span() for m in _MENTION.finditer(text)]
    at, longest = 0, max(map(len, known))
    while at < len(words):
        for n in range(min(most, len(words) - at), 0, -1):
            lo, hi = words[at][0], words[at + n - 1][1]
            if hi - lo <= longest and text[lo:hi] in known:
                yield lo, hi
                at += n
                break
        else:
            at += 1


def entities(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, type, surrogate) of what is found in a whole text, in order and without overlaps.

    Where finds overlap, the type named first wins: secret, email, iban, ip, card, ssn, phone, name. A name found behind a
    title is found wherever the text has it, whole or a word of it.
    """
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(lo: int, hi: int, kind: str, make: Callable[[], str | None]) -> None:
        at = bisect(taken, (lo, hi))
        clear = (not at or taken[at - 1][1] <= lo) and (at == len(taken) or hi <= taken[at][0])
        if clear and (new := make()) is not None:
            taken.insert(at, (lo, hi))
            found.append((lo, hi, kind, new))

    if _HINT.search(text):
        for m in _SECRET.finditer(text):
            lo, hi = m.span("value") if m["value"] else (m.end("aws"), m.end())
            if m["aws"] or re.search("[=\"']", m["to"]) or _MIXED.search(m["value"]):
                add(lo, hi, "secret", lambda v=text[lo:hi]: secret(v, key))
        for lo, hi in emails(text):
            add(lo, hi, "email", lambda v=text[lo:hi]: email(v, key))
        if ":" in text:
            for m in _IP6.finditer(text):
                add(*m.span(), "ip", lambda m=m: ip6(m[0], key))
        if re.search(r"\d", text):
            for kind, pattern, make in (("iban", _IBAN, iban), ("ip", _IP, ip)):
                for m in pattern.finditer(text):
                    add(*m.span(), kind, lambda m=m, make=make: make(m[0], key))
            for m in _CARD.finditer(text):
                if span := card_span(m[0]):
                    lo, hi = (m.start() + x for x in span)
                    add(lo, hi, "card", lambda v=text[lo:hi]: card(v, key))
            for m in _SSN.finditer(text):
                add(*m.span(), "ssn", lambda m=m: ssn(m[0], key))
            for m in _PHONE.finditer(text):
                add(*m.span(), "phone", lambda m=m: phone(m[0], key))
    titled = _titled(text)
    if not titled:
        return sorted(found)
    known: set[str] = set()
    for at, words in titled:
        add(at, at + len(words), "name", lambda w=words: name(w, key))
        known.add(words)
        known.update(w for w in words.split(" ") if len(w) > 1 and w not in PARTICLES and not w.endswith("."))
    for lo, hi in _mentions(text, known, max(len(re.findall(_WORD, w)) for w in known)):
        add(lo, hi, "name", lambda w=text[lo:hi]: name(w, key))
    return sorted(found)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else one drawn for the application."""
    named = spark.conf.get(KEY_CONF, None)
    if named:
        return named.encode()
    return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


#: What makes the surrogates of each type.
MAKERS: dict[str, Callable[[str, bytes], str | None]] = {
    "secret": secret, "email": email, "iban": iban, "ip": lambda x, key: (ip6 if ":" in x else ip)(x, key), "card": card, "ssn": ssn, "phone": phone, "name": name,
}


def canonical(kind: str, text: str) -> str:
    """The same text for all spellings of one entity: addresses by their number, e-mails and names without case, the rest without layout."""
    if kind == "ip":
        try:
            return ":".join(f"{int(x, 16):x}" for x in ipaddress.IPv6Address(text).exploded.split(":")) if ":" in text else ".".join(str(int(p)) for p in text.split("."))
        except ValueError:
            return text
    if kind in ("email", "name"):
        return text.lower()
    return "".join(c for c in text if c.isalnum() or c == "+") if kind in ("card", "phone", "iban") else text


def replace(text: str | None, key: bytes, again: dict[tuple[str, str], int] | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates in place, and (type, original, surrogate) of each entity; null stays null.

    again: how often the surrogate of a (type, canonical entity) is drawn anew."""
    if not text:
        return text, []
    out, at, seen = [], 0, []
    for lo, hi, kind, new in entities(text, key):
        if again and (turn := again.get((kind, canonical(kind, text[lo:hi])))):
            new = MAKERS[kind](text[lo:hi], key + f"|again {turn}".encode())
        out += [text[at:lo], new]
        seen.append((kind, text[lo:hi], new))
        at = hi
    return "".join([*out, text[at:]]), seen


_ENTITY = "array<struct<kind:string,original:string,surrogate:string>>"


def surrogates(text: Column, key: bytes, again: dict[tuple[str, str], int] | None = None) -> Column:
    """struct<text string, entities array<struct<kind, original, surrogate>>> of each whole text; null: null and none."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            done = [replace(x, key, again) for x in batch]
            yield pd.DataFrame({"text": [x for x, _ in done], "entities": [[{"kind": k, "original": o, "surrogate": s} for k, o, s in e] for _, e in done]})

    bound_batches()
    return F.pandas_udf(batches, f"text string, entities {_ENTITY}")(text)


def canonical_column(kind: Column, text: Column) -> Column:
    """canonical() in Spark's own functions."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    halves = F.split(F.lower(text), "::")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.when(F.size(halves) > 1, F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right))).otherwise(0))
    six = F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    four = F.regexp_replace(text, r"(^|\.)0+(?=\d)", "$1")
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}+]", "")
    other = F.when(kind.isin("email", "name"), F.lower(text)).when(kind.isin("card", "phone", "iban"), bare).otherwise(text)
    return F.when(kind == "ip", F.when(text.contains(":"), six).otherwise(four)).otherwise(other)


def _distinct(found: DataFrame, column: str) -> DataFrame:
    """(kind, o, surrogate) in canonical form, a row for each; each entity is shuffled once."""
    kind, e = F.col("e.kind"), F.col("e")
    each = found.select(F.explode(column).alias("e"))
    return each.select("e.kind", canonical_column(kind, e["original"]).alias("o"), canonical_column(kind, e["surrogate"]).alias("surrogate")).distinct()


def collisions(found: DataFrame, column: str = "entities") -> DataFrame:
    """(kind, surrogate, originals) of surrogates that stand for more than one entity; none is expected. Spellings of one entity are one."""
    return _distinct(found, column).groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).where("originals > 1")


def settled(make: Callable[[dict[tuple[str, str], int]], DataFrame], column: str = "entities") -> DataFrame:
    """What make({}) gives, written once. If a surrogate in the whole of it stands for two entities, all but the first of them are drawn anew, and
    make gets {(type, canonical entity): how often}: a permutation within a type can't do that, so there is nothing to draw as a rule."""
    again: dict[tuple[str, str], int] = {}
    for turn in range(1, REDRAWS + 2):
        found = cut(make(again))
        shared = collisions(found, column)
        if turn > REDRAWS or shared.isEmpty():
            return found
        each = _distinct(found, column).join(shared, ["kind", "surrogate"])
        first = each.groupBy("kind", "surrogate").agg(F.min("o").alias("first"))
        late = each.join(first, ["kind", "surrogate"]).where("o <> first").select("kind", "o").collect()
        again |= {(r["kind"], r["o"]): turn for r in late}
        drop(found)
    raise AssertionError
