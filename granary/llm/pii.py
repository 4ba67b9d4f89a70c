"""Personal data replaced by pseudonyms of the same format: a keyed permutation of each kind's valid values.

Every kind maps its valid values to 0 … n-1 and back; a Feistel network over the next power of two, walked until it
falls below n, permutes them. So a pseudonym is a valid value of the same format, equal values have equal
pseudonyms in all documents, different values different ones, and whoever holds the key can map back.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import ipaddress
import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8


class Permutation:
    """A keyed permutation of 0 … size-1 for each tweak (kind and format)."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, number: int, half: int, bits: int) -> int:
        data = f"{tweak}|{number}|{half:x}".encode()
        digest = hashlib.blake2b(data, key=self.key[:64], digest_size=32).digest()
        while len(digest) * 8 < bits:
            digest += hashlib.blake2b(digest[-32:], key=self.key[:64], digest_size=32).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _walk(self, value: int, size: int, tweak: str, back: bool) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        tweak = f"{tweak}|{size}"
        while True:
            left, right = value >> half, value & mask
            for number in range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, ROUNDS - 1 - number, left, half), left
                else:
                    left, right = right, left ^ self._round(tweak, number, right, half)
            value = left << half | right
            if value < size:
                return value

    def forward(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, tweak, back=False)

    def backward(self, value: int, size: int, tweak: str) -> int:
        return self._walk(value, size, tweak, back=True)


def luhn(digits: str) -> int:
    """The sum that a valid card number has as a multiple of ten."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10


def _digits_into(shape: str, digits: str) -> str:
    """The digits in the places that the digits of `shape` have."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _only_digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


Map = Callable[[int, int, str], int]


def card(value: str, permute: Map) -> str | None:
    """13 to 19 digits with a valid check digit; the first digit, which names the network, stays."""
    digits = _only_digits(value)
    if not 13 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
        return None
    size = 10 ** (len(digits) - 2)
    body = digits[0] + str(permute(int(digits[1:-1]), size, f"card{digits[0]}")).zfill(len(digits) - 2)
    check = next(c for c in string.digits if luhn(body + c) == 0)
    return _digits_into(value, body + check)


#: What stands before the number itself: a country code up to a separator, or without one +1 or two digits, or the
#: long-distance 1.
_CODE = re.compile(r"\+\d{1,3}(?=[ .(-])|\+1(?=\d{10}$)|\+\d{2}(?=\d{7,12}$)|1[ .-](?=\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}$)")


def phone(value: str, permute: Map) -> str | None:
    """A number with a country code, or with separators and 10 digits; code and punctuation stay, and a first
    digit of 2 to 9 stays in that range where the number of 10 digits needs it."""
    head = _CODE.match(value)
    rest = value[head.end() :] if head else value
    digits = _only_digits(rest)
    if not 7 <= len(digits) <= 12 or (not head and (len(digits) != 10 or digits[0] in "01")):
        return None
    low, size = 0, 10 ** len(digits)
    if digits[0] not in "01":
        low, size = 2 * 10 ** (len(digits) - 1), 8 * 10 ** (len(digits) - 1)
    new = str(permute(int(digits) - low, size, f"phone{low}") + low).zfill(len(digits))
    return (head.group() if head else "") + _digits_into(rest, new)


def address(value: str, permute: Map) -> str | None:
    """A dotted IPv4 address; 0.0.0.0, broadcast and loopback addresses name no one and stay."""
    parts = [int(p) for p in value.split(".")]
    if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
        return None
    if parts[0] in (0, 127, 255):
        return None
    number = int.from_bytes(bytes(parts), "big")
    # first octets 1 to 254 but for 127, in order
    rank = (parts[0] - 1 - (parts[0] > 127)) << 24 | number & 0xFFFFFF
    new = permute(rank, 253 << 24, "ip")
    first = (new >> 24) + 1
    first += first >= 127
    return ".".join(map(str, (first, new >> 16 & 255, new >> 8 & 255, new & 255)))


def address6(value: str, permute: Map) -> str | None:
    """An IPv6 address in any spelling; the first 16 bits, which tell its kind, stay. Unspecified, loopback and
    link-local addresses name no one and stay."""
    try:
        own = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    if own.is_unspecified or own.is_loopback or own.is_link_local:
        return None
    kind, rest = divmod(int(own), 1 << 112)
    new = str(ipaddress.IPv6Address(kind << 112 | permute(rest, 1 << 112, f"ip6{kind}")))
    return new.upper() if value.isupper() else new


def social(value: str, permute: Map) -> str | None:
    """A US social security number: areas 001 to 899 without 666, no group or serial of zeros."""
    area, group, serial = (int(p) for p in value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    new, tail = divmod(permute(rank, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(new, 99)
    area += 1
    area += area >= 666
    return f"{area:03d}-{group + 1:02d}-{tail + 1:04d}"


def iban(value: str, permute: Map) -> str | None:
    """An account number whose remainder by 97 is 1; country and the kind of each character stay."""
    bare = value.replace(" ", "")
    number = lambda text: int("".join(str(int(c, 36)) for c in text))
    if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    body = spelled(bare[4:], permute, "iban" + bare[:2])
    check = 98 - number(body + bare[:2] + "00") % 97
    rest = iter(bare[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(rest) for c in value)


_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())


def _day(year: int, month: int, day: int, permute: Map) -> datetime.date | None:
    if not 1900 <= year <= 2099 or not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    rank = datetime.date(year, month, day).toordinal() - _DAYS[0]
    return datetime.date.fromordinal(permute(rank, _DAYS[1] - _DAYS[0] + 1, "date") + _DAYS[0])


#: Days after the 12th before each month of 1900 to 2099, and after them.
_LATE = [0, *accumulate(calendar.monthrange(1900 + m // 12, m % 12 + 1)[1] - 12 for m in range(2400))]


def _late_day(year: int, month: int, day: int, permute: Map) -> datetime.date | None:
    """The same for a day after the 12th, whose pseudonym is one too: written day first it can't be read another way."""
    if not 1900 <= year <= 2099 or not 1 <= month <= 12 or not 13 <= day <= calendar.monthrange(year, month)[1]:
        return None
    rank = permute(_LATE[(year - 1900) * 12 + month - 1] + day - 13, _LATE[-1], "late")
    at = bisect_right(_LATE, rank) - 1
    return datetime.date(1900 + at // 12, at % 12 + 1, 13 + rank - _LATE[at])


def date(value: str, permute: Map) -> str | None:
    """A day from 1900 to 2099 as year-month-day, day.month.year, month/day/year or, where that is none, day/month/year; the
    order, separators and padding stay, so one day has one pseudonym in every spelling of the first three."""
    parts = re.findall(r"\d+", value)
    marks = re.findall(r"\D", value)
    order = "ymd" if len(parts[0]) == 4 else "mdy" if marks[0] == "/" else "dmy"
    if marks[0] != marks[1]:
        return None
    at = dict(zip(order, map(int, parts), strict=True))
    new = _day(at["y"], at["m"], at["d"], permute)
    if new is None and order == "mdy":
        order, new = "dmy", _late_day(at["y"], at["d"], at["m"], permute)
    if new is None:
        return None
    padded = any(len(p) == 2 and p[0] == "0" for p in parts) or order == "ymd"
    texts = {"y": f"{new.year}", "m": f"{new.month:02d}" if padded else f"{new.month}", "d": f"{new.day:02d}" if padded else f"{new.day}"}
    return marks[0].join(texts[c] for c in order)


def spelled(value: str, permute: Map, tweak: str) -> str:
    """Digits become digits, letters letters of the same case, all other characters stay."""
    kinds = [(string.digits, 10), (string.ascii_lowercase, 26), (string.ascii_uppercase, 26)]
    found = [next(((a, n) for a, n in kinds if c in a), None) for c in value]
    rank, size = 0, 1
    for c, kind in zip(value, found, strict=True):
        if kind:
            rank, size = rank * kind[1] + kind[0].index(c), size * kind[1]
    if size == 1:
        return value
    shape = "".join("-" if k is None else k[0][0] for k in found)
    rank = permute(rank, size, tweak + shape)
    out = []
    for c, kind in zip(reversed(value), reversed(found), strict=True):
        if kind:
            rank, at = divmod(rank, kind[1])
            c = kind[0][at]
        out.append(c)
    return "".join(reversed(out))


def mail(value: str, permute: Map) -> str:
    """Local part and domain names change letter by letter; the last label stays."""
    local, _, domain = value.rpartition("@")
    names, dot, last = domain.rpartition(".")
    return spelled(local, permute, "mail") + "@" + spelled(names, permute, "host") + dot + last


def secret(value: str, permute: Map) -> str:
    """The characters of a key or password; a known prefix or the name before it stays."""
    head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)|(?i:[a-z_ -]*?(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[:=]\s*[\"']?)", value)
    cut = head.end() if head else 0
    return value[:cut] + spelled(value[cut:], permute, "secret" + value[:cut].lower()[:4])


KINDS: dict[str, tuple[str, Callable[[str, Map], str | None]]] = {
    "mail": (r"[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", mail),
    "secret": (
        r"(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9_-]{16,}|\bxox[abprs]-[A-Za-z0-9-]{10,}"
        r"|(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key))\s*[:=]\s*(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})",
        secret,
    ),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    "ip6": (r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9A-Fa-f]{1,4}|(?<=::))(?![\w:]|\.\d)", address6),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    "date": (r"(?<![\d./-])(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?![\d/-]|\.\d)", date),
    "card": (r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)", card),
    "phone": (
        r"(?<![\w.+-])(?:\+\d{9,15}|\+\d{1,3}[ .-]\d{7,12}|1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"
        r"|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3})(?![\d-]|\.\d)",
        phone,
    ),
}
#: Kinds whose match may take in a number or word behind the value or before it, and what a value inside a match that
#: is none must look like.
PARTS = {
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z]{2}\d{2}[A-Z0-9]{11,30}"),
    "card": re.compile(r"[3-6]\d{3}([ -])\d{4}\1\d{4}\1\d{1,7}|3\d{3}([ -])\d{6}\2\d{5}|[3-6]\d{12,18}"),
    "phone": re.compile(
        r"\+\d{1,3}[ .-]\d{7,12}|(?:(?:\+\d{1,3}|1)[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){3,5}"),
}
#: Texts without any of these hold nothing to look at.
_SIGNS = re.compile(r"\d|@|=|:")


def _values(text: str, kind: str, permute: Map) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the valid values of a kind. Where a match is no value, what it has up to a border of its
    groups is tried, longer parts first; then the search goes on behind its first group, but for phone numbers, which any
    row of numbers would yield. Such parts must look like PARTS."""
    pattern, change = KINDS[kind]
    own, part, at, failed = re.compile(pattern), PARTS.get(kind), 0, 0
    while match := own.search(text, at):
        start, end = match.span()
        whole = [] if part and start < failed and not part.fullmatch(match.group()) else [end]
        borders = [start + m.start() for m in _BORDER.finditer(match.group())][::-1] if part else []
        for stop in whole + [b for b in borders if part.fullmatch(text, start, b)]:
            if (new := change(text[start:stop], permute)) is not None:
                yield start, stop, new
                at = stop
                break
        else:
            border = _BORDER.search(text, start, end) if part and kind != "phone" else None
            at = border.end() if border else max(end, at + 1)
            failed = max(failed, end)


_BORDER = re.compile(r"(?<=[\w)])[ .-]")


def pseudonymise(text: str, permutation: Permutation, kinds: tuple[str, ...] = tuple(KINDS)) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every valid value replaced, and (kind, start, end) of each in the text before. Of values that
    overlap the one that starts first counts, then the one whose kind is named first."""
    if not _SIGNS.search(text):
        return text, []
    hits = [
        (start, rank, end, kind, new)
        for rank, kind in enumerate(kinds) for start, end, new in _values(text, kind, permutation.forward)
    ]
    out, spans, done = [], [], 0
    for start, _, end, kind, new in sorted(hits):
        if start >= done:
            out += [text[done:start], new]
            spans.append((kind, start, end))
            done = end
    return "".join(out) + text[done:], spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def with_pseudonyms(docs: DataFrame, secret_key: bytes, *, text: str = "text", spans: str = "pii") -> DataFrame:
    """`docs` with pseudonyms in `text` and `spans`, where in the text before they stood (code points). Null texts
    stay null, with no spans. One pass without a shuffle; a clashing column is replaced."""
    columns = [c for c in docs.columns if c != spans]
    schema = T.StructType([*docs.select(*columns).schema, T.StructField(spans, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(secret_key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, found = [], []
            for value in batch.column(text):
                value = value.as_py()
                new, hits = (None, []) if value is None else pseudonymise(value, permutation)
                texts.append(new)
                found.append([dict(zip(("kind", "start", "end"), h, strict=True)) for h in hits])
            arrays = [batch.column(c) if c != text else pa.array(texts, pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, kind)], [*columns, spans])

    return docs.select(*columns).mapInArrow(run, schema)
