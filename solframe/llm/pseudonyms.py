"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Numbers and dates are found by pattern and kept only if they are valid (check digits, ranges, the calendar). Each is
read as one integer whatever its notation, permuted under a key within the values of the same widths, and written back
in the notation it had: a card number stays a card number with a right check digit, a date stays a date whose day and
month have as many digits as before. The permutation is one to one, so equal values get equal pseudonyms in all
documents and notations, and different ones never meet; with the key it can be undone.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hmac
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

ROUNDS = 8
#: Values whose pseudonyms a worker remembers; it forgets all when full.
MEMO = 100_000
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: Month names, and marks that secrets start with, which stay.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MARKS = ("AKIA", "ASIA", "ghp_", "sk-", "xoxb-")


def _widths(day: dt.date) -> tuple[bool, bool, bool]:
    """Dates of a class have months and days of equal widths, and days that can or cannot be months."""
    return day.month > 9, day.day > 9, day.day > 12


@lru_cache(8)
def _days(widths: tuple[bool, bool, bool]) -> list[int]:
    return [n for n in range(FIRST_DAY, LAST_DAY + 1) if _widths(dt.date.fromordinal(n)) == widths]


class Feistel:
    """Keyed permutations of range(n), for any n."""

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("a key is needed")
        self.key = key

    def _draw(self, tweak: str, step: int, half: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{step}|{half}".encode(), "sha256"), "big")

    def _pass(self, x: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = divmod(x, b)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * self._draw(tweak, step, left)) % b
            else:
                left = (left + sign * self._draw(tweak, step, right)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """The place of x; values of the surrounding rectangle outside range(n) are walked through."""
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        x = self._pass(x, a, b, f"{tweak}|{n}", back)
        while x >= n:
            x = self._pass(x, a, b, f"{tweak}|{n}", back)
        return x


def luhn(digits: str) -> int:
    """Sum that a right number makes divisible by 10."""
    return sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))


def _refill(shape: str, characters: str) -> str:
    """Put characters in the places of the shape's letters and digits."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in shape)


#: Calling codes of one and two digits; those of three digits begin with none of these.
SHORT_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
               "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
CALLING = {*SHORT_CODES, *(str(n) for n in range(200, 1000) if str(n)[0] not in SHORT_CODES and str(n)[:2] not in SHORT_CODES)}
ISSUERS, LEADING = "23456", "123456789"
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Pseudonyms:
    """Finds and replaces. kinds: see KINDS."""

    def __init__(self, key: bytes) -> None:
        self.feistel = Feistel(key)
        self.memo: dict[tuple[str, str], str | None] = {}

    def _alike(self, text: str, kind: str, first: str = "") -> str:
        """Letters become letters of the same case and digits digits; a first character out of `first` stays one of these."""
        value, size = 0, 1
        sets = []
        for i, c in enumerate(text):
            chars = next((s for s in CLASSES if c in s), c)
            if i == 0 and c in first:
                chars = first
            sets.append(chars)
            value, size = value * len(chars) + chars.index(c), size * len(chars)
        value = self.feistel.permute(value, size, f"{kind}|{''.join(str(len(s)) + ',' for s in sets)}")
        out = []
        for chars in reversed(sets):
            value, at = divmod(value, len(chars))
            out.append(chars[at])
        return "".join(reversed(out))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or digits[0] not in ISSUERS or luhn(digits) % 10:
            return None
        body = self._alike(digits[:-1], "card", ISSUERS)
        return _refill(text, body + str(-luhn(body + "0") % 10))

    def number(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        return _refill(text, self._alike(digits, "number", LEADING)) if len(set(digits)) > 1 else None

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        value = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or value(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._alike(plain[4:], "iban" + plain[:2])
        return _refill(text, plain[:2] + f"{98 - value(body + plain[:2] + '00') % 97:02d}" + body)

    def phone(self, text: str) -> str | None:
        """The national number is permuted, whatever stands before it: +, 00 and a country code, or a trunk zero."""
        digits = re.sub(r"\D", "", text)
        abroad = digits[2:] if text.startswith("00") else digits if text.startswith("+") else ""
        lead = 0
        if abroad:
            country = next((c for n in (1, 2, 3) if (c := abroad[:n]) in CALLING), None)
            if country is None:
                return None
            lead = len(digits) - len(abroad) + len(country)
            lead += "(0)" in text and digits[lead : lead + 1] == "0"
        elif digits.startswith("0"):
            lead = 1
        if not 7 <= len(digits) - lead <= 13 or digits[lead] == "0":
            return None
        return _refill(text, digits[:lead] + self._alike(digits[lead:], "phone", LEADING))

    def ssn(self, text: str) -> str | None:
        area, group, serial = re.split("[- ]", text)
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        areas = [a for a in range(1, 900) if a != 666]
        value = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
        value = self.feistel.permute(value, len(areas) * 99 * 9999, "ssn")
        return _refill(text, f"{areas[value // 9999 // 99]:03d}{value // 9999 % 99 + 1:02d}{value % 9999 + 1:04d}")

    def date(self, text: str) -> str | None:
        named = re.search("(?<![A-Za-z0-9])[A-Za-z]+", text)
        parts = re.findall(r"\d+", text)
        try:
            if named:
                month = next(i for i, m in enumerate(MONTHS, 1) if m[:3].lower() == named[0][:3].lower())
                day = dt.date(int(parts[1]), month, int(parts[0]))
            else:
                places = (0, 1, 2) if len(parts[0]) == 4 else (2, 0, 1) if "/" in text and int(parts[0]) <= 12 else (2, 1, 0)
                day = dt.date(*(int(parts[p]) for p in places))
        except ValueError:
            return None
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        widths = _widths(day)
        known = _days(widths)
        at = bisect.bisect_left(known, day.toordinal())
        new = dt.date.fromordinal(known[self.feistel.permute(at, len(known), f"date|{widths}")])
        if named:
            name = MONTHS[new.month - 1]
            name = name if len(named[0]) > 3 or named[0].lower() == "may" else name[:3]
            name = name.upper() if named[0].isupper() else name.lower() if named[0].islower() else name
            numbers = iter((f"{new.day:0{len(parts[0])}d}", f"{new.year:04d}"))
            out = re.sub(r"\d+", lambda _: next(numbers), text).replace(named[0], name)
            return re.sub(r"(?<=\d)(st|nd|rd|th)\b", "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th"), out)
        for p, v in zip(places, (new.year, new.month, new.day)):
            parts[p] = f"{v:0{len(parts[p])}d}"
        it = iter(parts)
        return re.sub(r"\d+", lambda _: next(it), text)

    def ip(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255 or octets[0] in (0, 127):
            return None
        value = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
        while (value >> 24) in (0, 127):
            value = self.feistel.permute(value, 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def ip6(self, text: str) -> str | None:
        try:
            value = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        if value < 2:
            return None
        low = self.feistel.permute(value & (1 << 112) - 1, 1 << 112, f"ip6|{value >> 112}")
        new = f"{(value >> 112) << 112 | low:032x}"  # the first group stays; an address with :: is written out
        groups = ":".join(new[i : i + 4] for i in range(0, 32, 4))
        return groups.upper() if text.isupper() else groups

    def email(self, text: str) -> str | None:
        at = text.rindex(".")
        return self._alike(text[:at], "email") + text[at:]

    def secret(self, text: str) -> str | None:
        mark = next((m for m in MARKS if text.startswith(m)), "")
        return mark + self._alike(text[len(mark) :], "secret")

    def _new(self, kind: str, text: str) -> str | None:
        found = self.memo.get((kind, text), "")
        if found == "":
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[kind, text] = getattr(self, kind)(text)
        return found

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with its pseudonyms, and how many of each kind."""
        counts = dict.fromkeys(KINDS, 0)
        if not text:
            return text, counts
        found: list[tuple[int, int, str]] = []
        for gate, pattern in PATTERNS:
            for m in pattern.finditer(text) if gate(text) else ():
                kind = next(k for k, v in m.groupdict().items() if v is not None)
                start, end = m.span(kind)
                at = bisect.bisect_left(found, (start,))
                if at < len(found) and found[at][0] < end or at and found[at - 1][1] > start:
                    continue  # an earlier pattern has it
                new = self._new(kind, m[kind])
                if new is None and (kind == "card" or kind == "phone" and sum(map(str.isdigit, m[kind])) > 12):
                    kind, new = "number", self._new("number", m[kind])
                if new is not None:
                    counts[kind] += 1
                    found.insert(at, (start, end, new))
        out, at = [], 0
        for start, end, new in found:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), counts


KINDS = ("card", "number", "iban", "phone", "ssn", "date", "ip", "ip6", "email", "secret")
_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
_NAMED = re.compile(rf"\b{_MONTH}\b").search
_DIGIT, _CAPITAL = re.compile(r"\d").search, re.compile(r"[A-Z]{2}\d\d").search
#: Gates are plain searches that most texts fail; patterns restart nowhere inside a run of characters, so they are linear.
PATTERNS: list[tuple[Callable, re.Pattern]] = [
    (lambda t: any(m in t for m in MARKS), re.compile(
        r"(?<![A-Za-z0-9])(?P<secret>(?:AKIA|ASIA)[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xoxb-[A-Za-z0-9-]{16,})(?![A-Za-z0-9])", re.A)),
    (lambda t: "=" in t or ":" in t, re.compile(
        r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?P<secret>[A-Za-z0-9_+/.-]{8,})", re.A)),
    (lambda t: "@" in t, re.compile(r"(?<![A-Za-z0-9._%+-])(?P<email>[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)", re.A)),
    (_CAPITAL, re.compile(r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.A)),
    (lambda t: "::" in t or t.count(":") >= 7, re.compile(r"(?<![\w:.])(?P<ip6>[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:]|\.\d)", re.A)),
    (_NAMED, re.compile(rf"(?<![\w.])(?P<date>\d{{1,2}}(?:st|nd|rd|th)? {_MONTH},? \d{{4}}|{_MONTH} \d{{1,2}}, \d{{4}})(?!\w)", re.A)),
    (_DIGIT, re.compile(
        r"(?<![\w.])(?:(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
        r"|(?P<date>\d{4}([-/])\d{1,2}\3\d{1,2}|\d{1,2}([./])\d{1,2}\4\d{4})(?!(?!T\d\d:?\d\d)\w|[./-]\d)"
        r"|(?P<ssn>\d{3}([- ])\d\d\6\d{4})(?![\w-])"
        r"|(?P<phone>(?:\+|00(?=[1-9]))\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}([-. ])\d{3}\8\d{4}(?![\w-])"
        r"|0[1-9]\d{1,3}([ -])\d{3,4}(?:\9?\d{3,4})(?![\w-])|0[1-9]\d{8,9}(?![\w.-])|[2-9]\d\d[2-9]\d{6}(?![\w.-]))"
        r"|(?P<card>\d(?:[ -]?\d){12,18})(?!\d))", re.A)),
]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, text with pseudonyms, n_<kind> (long) for each of KINDS.

    A null text stays null and an empty one empty, with counts of 0; repeated rows come out alike; an empty table gives
    no rows; other columns play no part. Values in several kinds' form count once, by the first kind that validates
    them; long digit strings without a right check digit are permuted as plain numbers. Dates come year first, day first
    with dots, month or day first with slashes (day first only where it is over 12), or with a month's English name.
    A telephone number's national part gets the same pseudonym in the forms +44 20 ..., +4420..., 0044 20 ... and 020 ...;
    country codes and trunk zeros stay.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonyms(key)
        for batch in slices(batches, 1024):
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                new, n = worker.replace(t)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS)], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
