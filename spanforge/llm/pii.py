"""Format-preserving pseudonyms for personal values, by a keyed Feistel permutation.

A found and validated value is mapped to a number within the set of valid values of its
format, that number is permuted by a Feistel network with a keyed round function
(cycle-walking until it lies in the set again), and the result is written in the value's
own layout. So a card number stays a card number with a right check digit, a date stays
a calendar date in the same notation, and equal values get equal pseudonyms in all
documents and on all machines, without a table and without a shuffle. ``invert`` undoes
it for whoever holds the key.

Formats: e-mail addresses, payment card numbers (13 to 19 digits with a right check
digit), phone numbers of ten digits in North American notation (any area code) and
international ones (``+``, country code, 8 to 15 digits in all; the country code stays),
IPv4 addresses, IBANs (mod 97), social security numbers, calendar dates (year first, day or
month first with a four-digit year, or with the month's English, German, French or Spanish
name; a time of day may follow, as in 2020-01-03T10:00), and secrets (access key ids, values of password, token, secret and key assignments
that hold a digit, or both cases in 16 characters or more, which words of prose do not). A
candidate that fails its validation stays as it is. Not among these formats, and left as they are: dates with
abbreviated months, ordinals or without a year, and IBANs in lower case. Digits become digits and letters letters
of the same case; in strings of 12 characters or more that are numbers to the base 16 both become either.

A date is permuted among the dates whose day and month take as many digits as its own and
whose day is as surely no month (above 12 or not). So each notation of a date, padded or
not, whichever part is first, gives the same new date in its own layout, read back alike.

A card number may have other digits beside it. In a run of digit groups, values of the
other formats are taken first; then of what is left the longest stretches between
separators that have a right check digit. A stretch within a run has at least four digits
in each group but its last, or lists of small numbers would be full of them. A pseudonym
with which another stretch of its run would be read as the card is passed over for the
next, so that ``invert`` reads the same stretches; beside other digits a card may therefore
have another pseudonym than alone.

Cases: null stays null; a text without such values is passed on untouched; repeated
rows are treated alike; an empty table gives no rows; other columns pass through, one
named like a result is replaced.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanforge.llm import kernels as K

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
#: Names of the months, and the two-digit country calling codes (1 and 7 have one digit, all others three).
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
TWO_DIGIT_CODES = (20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98)
KINDS = ("email", "card", "phone", "ip", "iban", "ssn", "date", "named", "secret")


class Feistel:
    """A keyed permutation of 0..size-1 for any size, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        digest = hashlib.blake2b(half.to_bytes((bits + 7) // 8, "little"), key=self.key, person=i.to_bytes(2, "little"), salt=tweak[:16], digest_size=min(64, (bits + 7) // 8 + 8)).digest()
        return int.from_bytes(digest, "little") & ((1 << bits) - 1)

    def apply(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        if not 0 <= x < size:
            raise ValueError("value outside its set")
        if size == 1:
            return 0
        bits = ((size - 1).bit_length() + 1) // 2
        mask = (1 << bits) - 1
        tweak = hashlib.blake2b(tweak + size.to_bytes((size.bit_length() + 7) // 8, "little"), digest_size=16).digest()
        while True:
            a, b = x >> bits, x & mask
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._round(tweak, i, a, bits), a
                else:
                    a, b = b, a ^ self._round(tweak, i, b, bits)
            x = a << bits | b
            if x < size:
                return x


def _date_class(day: datetime.date) -> tuple[int, bool]:
    """What a date's notations show of it beside its digits: whether day and month take two, and whether the day is no month."""
    return (day.day > 9) + (day.day > 12), day.month > 9


_same: dict[tuple[int, bool], list[int]] = {}


def _dates_like(day: datetime.date) -> list[int]:
    """The places of all dates of this one's class, in order."""
    if not _same:
        for x in range(DAYS):
            _same.setdefault(_date_class(datetime.date.fromordinal(FIRST_DAY + x)), []).append(x)
    return _same[_date_class(day)]


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def luhn_valid(text: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    digits = re.sub(r"\D", "", text)
    return luhn_digit(digits[:-1]) == int(digits[-1])


def card_places(run: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Begin and end of the card numbers in a run of digits and separators, the longest taken first, and the stretches
    that would have been taken in place of each if their check digit had been right."""
    places = {m.span(): sum(map(str.isdigit, m[0])) for m in CARD.finditer(run)}
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    for i, (begin, _) in enumerate(groups):
        n = 0
        for first, end in groups[i:]:
            n += end - first
            if 13 <= n <= 19:
                places[begin, end] = n
            if n > 19 or end - first < 4:
                break
    used, failed, found = bytearray(len(run)), {}, []
    for begin, end in sorted(places, key=lambda p: (-places[p], p)):
        if any(used[begin:end]):
            continue
        if luhn_valid(run[begin:end]):
            used[begin:end] = b"\1" * (end - begin)
            found.append((begin, end, [(i, j) for i in range(begin - LONGEST, end) for j in failed.get(i, ()) if j > begin]))
        else:
            failed.setdefault(begin, []).append(end)
    return sorted(found)


def iban_check(country: str, rest: str) -> int:
    """The two check digits of an IBAN as a number."""
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _layout(text: str, digits: str) -> str:
    """``text`` with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _hexadecimal(text: str) -> bool:
    """Whether a long string is a number to the base 16: it has digits and letters, lower-case ones up to f."""
    return len(text) >= 12 and re.fullmatch(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]*", text) is not None


def _classes(text: str) -> tuple[int, int, list[tuple[str, int]]]:
    """A string of ASCII letters and digits as a number, the size of the set of strings of its shape, and the shape."""
    x, size, shape = 0, 1, []
    hexadecimal = _hexadecimal(text)
    for c in text:
        alphabet = "0123456789abcdef" if hexadecimal else next((a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a), c)
        x, size = x * len(alphabet) + alphabet.index(c), size * len(alphabet)
        shape.append(alphabet)
    return x, size, shape


def _spell(x: int, shape: list[str]) -> str:
    out = []
    for alphabet in reversed(shape):
        x, d = divmod(x, len(alphabet))
        out.append(alphabet[d])
    return "".join(reversed(out))


class Pseudonyms:
    """Replaces personal values in texts."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.memo: dict[tuple[str, str], object] = {}

    def _permute(self, x: int, size: int, kind: str) -> int:
        return self.feistel.apply(x, size, kind.encode(), self.back)

    def _string(self, text: str, kind: str) -> str:
        x, size, shape = _classes(text)
        while True:
            x = self._permute(x, size, kind)
            # what has one alphabet for all its characters stays among strings that are read so
            if _hexadecimal(new := _spell(x, shape)) == _hexadecimal(text):
                return new

    def email(self, m: re.Match) -> str | None:
        local, domain = m["email"].rsplit("@", 1)
        if _classes(local)[1] < 10**6:  # too few strings of the local part's shape: the host names take part
            host, dot, top = domain.rpartition(".")
            both = self._string(local + "@" + host, "email")
            return both + dot + top
        return self._string(local, "email") + "@" + domain

    def cards(self, run: str) -> list[tuple[int, int, str]]:
        """Begin, end and pseudonym of each card number in a run of digits and separators."""
        chars, found = list(run), card_places(run)
        for begin, end, rivals in reversed(found) if self.back else found:
            digits = [c for c in chars[begin:end] if c.isdigit()]
            n = len(digits) - 1
            x = int("".join(digits[:-1]))
            while True:
                x = self._permute(x, 10**n, "card")
                body = f"{x:0{n}d}"
                chars[begin:end] = _layout(run[begin:end], body + str(luhn_digit(body)))
                if not any(luhn_valid("".join(chars[i:j])) for i, j in rivals):
                    break
        return [(begin, end, "".join(chars[begin:end])) for begin, end, _ in found]

    def phone(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m["phone"])
        n = len(digits) - 10
        if m["phone"].startswith("+"):
            if not 8 <= len(digits) <= 15 or digits[0] == "0":
                return None
            n = 1 if digits[0] in "17" else 2 if int(digits[:2]) in TWO_DIGIT_CODES else 3
        own = len(digits) - n
        return _layout(m["phone"], f"{digits[:n]}{self._permute(int(digits[n:]), 10**own, 'phone'):0{own}d}")

    def ip(self, m: re.Match) -> str | None:
        octets = [int(o) for o in m["ip"].split(".")]
        if max(octets) > 255:
            return None
        x = self._permute(int.from_bytes(bytes(octets), "big"), 2**32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def iban(self, m: re.Match) -> str | None:
        plain = m["iban"].replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_check(country, rest) != int(check):
            return None
        rest = self._string(rest, "iban")
        new = iter(f"{country}{iban_check(country, rest):02d}{rest}")
        return "".join(c if c == " " else next(new) for c in m["iban"])

    def ssn(self, m: re.Match) -> str | None:
        a, b, c = (int(x) for x in m["ssn"].split("-"))
        if not 0 < a < 900 or a == 666 or not b or not c:
            return None
        x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
        x, c = divmod(self._permute(x, 898 * 99 * 9999, "ssn"), 9999)
        a, b = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"

    def _day(self, year: int, month: int, day: int) -> datetime.date | None:
        """The pseudonym of a date, or nothing if there is no such date in the set."""
        try:
            old = datetime.date(year, month, day)
        except ValueError:
            return None
        x = old.toordinal() - FIRST_DAY
        if not 0 <= x < DAYS:
            return None
        like = _dates_like(old)
        tweak = "date%d%d" % _date_class(old)
        return datetime.date.fromordinal(FIRST_DAY + like[self._permute(bisect.bisect_left(like, x), len(like), tweak)])

    def date(self, m: re.Match) -> str | None:
        parts = re.split(r"[-/.]", m["date"])
        order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
        year, month, day = (int(parts[i]) for i in order)
        if month > 12 and order[0] == 2 and day <= 12:
            order, month, day = (2, 0, 1), day, month
        if (new := self._day(year, month, day)) is None:
            return None
        out = [""] * 3
        for i, v in zip(order, (new.year, new.month, new.day), strict=True):
            out[i] = f"{v:0{len(parts[i])}d}"
        seps = re.findall(r"[-/.]", m["date"])
        return out[0] + seps[0] + out[1] + seps[1] + out[2]

    def named(self, m: re.Match) -> str | None:
        text = m["named"]
        languages = {"english": "en", "american": "en", "german": "de", "french": "fr", "spanish": "es"}
        language = next(k for k in languages if m[k])
        months, name = MONTHS[languages[language]], m[language]
        day, year = re.finditer(r"\d+", text)
        if (new := self._day(int(year[0]), months.index(name) + 1, int(day[0]))) is None:
            return None
        new_day = f"{new.day:0{len(day[0])}d}"
        at = text.index(name)
        edits = sorted([(day.start(), day.end(), new_day), (year.start(), year.end(), str(new.year)), (at, at + len(name), months[new.month - 1])], reverse=True)
        for begin, end, value in edits:
            text = text[:begin] + value + text[end:]
        return text

    def secret(self, m: re.Match) -> str | None:
        key, value = m["key"], m["value"]
        if key:
            return key[:4] + self._string(key[4:], "secret")
        if not (any(map(str.isdigit, value)) or len(value) >= 16 and value.lower() != value != value.upper()):
            return None
        return m["assigned"] + self._string(value, "secret")

    def replace(self, text: str, counts: dict[str, int] | None = None) -> str:
        """The text with all validated values replaced."""
        return "\n".join(self._line(line, counts) if TRIGGER.search(line) else line for line in text.split("\n"))

    def _line(self, line: str, counts: dict[str, int] | None) -> str:
        out, done, at = [], 0, 0
        while m := PATTERN.search(line, at):
            at = m.end()
            for begin, end, kind, new in self._run(line, m) if m.lastgroup == "card" else self._value(m):
                out += line[done:begin], new
                done, at = end, max(at, end)
                if counts is not None:
                    counts[kind] = counts.get(kind, 0) + 1
        return "".join(out) + line[done:]

    def _known(self, kind: str, text: str, make: Callable[[], object]) -> object:
        if (kind, text) not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[kind, text] = make()
        return self.memo[kind, text]

    def _value(self, m: re.Match) -> list[tuple[int, int, str, str]]:
        """Begin, end, kind and pseudonym of the value matched, or nothing where it fails its validation."""
        kind = m.lastgroup if m.lastgroup in KINDS else "secret"
        new = self._known(kind, m[0], lambda: getattr(self, kind)(m))
        return [] if new is None else [(*m.span(), "date" if kind == "named" else kind, new)]

    def _run(self, line: str, m: re.Match) -> list[tuple[int, int, str, str]]:
        """The same for all values in a run of digits: those of other formats, which may end beyond it, and the cards between them."""
        found, at = [], m.start()
        while (other := OTHERS.search(line, at, m.end() + REACH)) and other.start() < m.end():
            at = other.end()
            found += self._value(other)
        cards, at = [], m.start()
        for begin, end in [*(f[:2] for f in found), (m.end(), m.end())]:
            part = line[at:begin]
            cards += [(at + i, at + j, "card", new) for i, j, new in self._known("card", part, lambda: self.cards(part))]
            at = end
        return sorted(found + cards)


TRIGGER = re.compile(r"[0-9@=:]")
DIGITS = r"(?<![\w.-])\d(?:[ -]?\d){12,%s}(?![\w]|-\d)"
#: One card number; characters of the longest; characters that a value which begins in a run of digits may take beyond it.
CARD, LONGEST, REACH = re.compile(DIGITS % "18"), 37, 1000
VALUES = (
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<phone>(?<![\w.+-])(?:(?:(?:\+1|1)[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+(?:\d{8,15}|\d{1,4}(?:[ .-](?:\(\d{1,5}\)[ .-]?)?\d{1,8}){1,6}))(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?![-/.]\d)(?!(?!T\d\d:\d\d)\w))"
    rf"|(?P<named>(?<![\w./-])(?:\d{{1,2}} (?P<english>{'|'.join(MONTHS['en'])}) \d{{4}}|\d{{1,2}}\. (?P<german>{'|'.join(MONTHS['de'])}) \d{{4}}"
    rf"|\d{{1,2}} (?P<french>{'|'.join(MONTHS['fr'])}) \d{{4}}|\d{{1,2}} de (?P<spanish>{'|'.join(MONTHS['es'])}) de \d{{4}}|(?P<american>{'|'.join(MONTHS['en'])}) \d{{1,2}}, \d{{4}})(?!\w))"
    r"|(?P<secret>(?<!\w)(?P<key>(?:AKIA|ASIA)[A-Z0-9]{16})(?!\w)|(?P<assigned>(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\s?[=:]\s?[\"']?)(?P<value>[A-Za-z0-9_\-./+]{6,128}))"
)
PATTERN, OTHERS = re.compile(VALUES + f"|(?P<card>{DIGITS % ''})"), re.compile(VALUES)


def pseudonymize(docs: DataFrame, *, key: bytes | str, text_col: str = "text", keep: list[str] | None = None, count_col: str | None = "n_values", back: bool = False) -> DataFrame:
    """The documents with pseudonyms in ``text_col``, and in ``count_col`` how many values were replaced."""
    spark = docs.sparkSession
    K.set_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c != count_col]
    if text_col not in keep:
        keep.append(text_col)
    key = key.encode() if isinstance(key, str) else key
    inner, place = docs.select(*keep), keep.index(text_col)
    lut = np.zeros(256, bool)
    lut[[*range(0x30, 0x3A), 0x40, 0x3D, 0x3A]] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key, back)
        for batch in batches:
            column = batch.column(place)
            numbers, mask, new = np.zeros(len(column), np.int64), np.zeros(len(column), bool), []
            for i, j, buf, offsets in K.blocks(column):
                some = np.flatnonzero(lut[buf])
                for r in np.unique(np.searchsorted(offsets, some, "right") - 1).tolist() if len(some) else ():
                    counts: dict[str, int] = {}
                    text = work.replace(column[i + r].as_py(), counts)
                    if counts:
                        mask[i + r], numbers[i + r] = True, sum(counts.values())
                        new.append(text)
            if new:
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(new, column.type))
            columns = [*batch.columns[:place], column, *batch.columns[place + 1 :]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers)] if count_col else columns, names=[*keep, count_col] if count_col else keep)

    schema = T.StructType([*inner.schema.fields, *([T.StructField(count_col, T.LongType())] if count_col else [])])
    return inner.mapInArrow(run, schema)
