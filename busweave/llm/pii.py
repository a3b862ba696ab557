"""Format-preserving pseudonyms for personal data.

Values are found by pattern, checked (card numbers by their check digit, IBANs
by mod 97, dates by the calendar, addresses and numbers by their ranges) and
replaced by a keyed Feistel permutation of their own format: the same value gets
the same pseudonym in every document, different values stay different, and a
pseudonym passes the same check.  Nothing is shared between tasks but the key.

Defined results: null stays null, empty stays empty; equal rows give equal rows;
an empty table gives no rows; other columns pass through, but for those named
like a count (``n_<kind>``), which it replaces.  A permutation may map a value of a
small format to itself, as any one-to-one mapping may.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from busweave.llm.words import slices

KEY = "pseudonym key: pass your own"
ROUNDS = 10

# Patterns of the kinds, tried in this order.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\w/.-])(?:(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>\d{4}))(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\+\d{8,14})(?![\w-]|\.\d)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])",
}
KINDS = tuple(PATTERNS)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


class Feistel:
    """Keyed permutations of digit strings of one radix and length."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _f(self, tweak: str, turn: int, value: int, size: int) -> int:
        data = f"{tweak}|{turn}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") % size

    def digits(self, values: list[int], radix: int, tweak: str) -> list[int]:
        """A permutation of all strings of this length over ``radix`` symbols."""
        n = len(values)
        if n == 0:
            return []
        if n == 1:
            return [(values[0] + 1 + self._f(tweak, 0, radix, radix - 1)) % radix]
        split = n // 2
        number = 0
        for v in values:
            number = number * radix + v
        base, top = radix ** (n - split), radix**split
        left, right = divmod(number, base)
        for turn in range(ROUNDS):
            if turn % 2:
                right = (right + self._f(tweak, turn, left, base)) % base
            else:
                left = (left + self._f(tweak, turn, right, top)) % top
        number = left * base + right
        out = []
        for _ in range(n):
            number, v = divmod(number, radix)
            out.append(v)
        return out[::-1]

    def number(self, value: int, size: int, tweak: str) -> int:
        """A permutation of 0..size-1 by cycle walking over a power of two."""
        bits = max(2, (size - 1).bit_length())
        while True:
            word = self.digits([(value >> b) & 1 for b in range(bits)], 2, tweak)
            value = sum(bit << b for b, bit in enumerate(word))
            if value < size:
                return value

    def classes(self, text: str, tweak: str) -> str:
        """Digits, small and capital letters permuted in their places."""
        out = list(text)
        for name, symbols in (("0", "0123456789"), ("a", _LETTERS), ("A", _LETTERS.upper())):
            places = [i for i, c in enumerate(text) if c in symbols]
            found = self.digits([symbols.index(text[i]) for i in places], len(symbols), f"{tweak}{name}{len(places)}")
            for i, v in zip(places, found, strict=True):
                out[i] = symbols[v]
        return "".join(out)


def _luhn(digits: list[int]) -> int:
    """Check digit that completes ``digits``."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _fill(text: str, digits: list[int]) -> str:
    rest = iter(digits)
    return "".join(str(next(rest)) if c.isdigit() else c for c in text)


def _card(f: Feistel, match) -> str | None:
    digits = [int(c) for c in match[0] if c.isdigit()]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or _luhn(digits[:-1]) != digits[-1]:
        return None
    body = f.digits(digits[:-1], 10, f"card{len(digits)}")
    return _fill(match[0], [*body, _luhn(body)])


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _mod97(plain[4:] + plain[:4]) == 1


def _ibans(pattern: re.Pattern, text: str):
    """Valid numbers; the pattern may run on into capitals behind one, so shorter ends count too."""
    at = 0
    while found := pattern.search(text, at):
        ends = [found.end(), *(found.start() + m.start() for m in reversed([*re.finditer(" ", found[0])]))]
        end = next((e for e in ends if _iban_valid(text[found.start() : e])), None)
        if end:
            yield re.compile(r"[A-Z0-9 ]+").fullmatch(text, found.start(), end)
        at = end or found.start() + 1


def _iban(f: Feistel, match) -> str:
    plain = match[0].replace(" ", "")
    body = f.classes(plain[4:], f"iban{plain[:2]}")
    new = iter(f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in match[0])


def _ssn_valid(d: list[int]) -> bool:
    area = d[0] * 100 + d[1] * 10 + d[2]
    return area not in (0, 666) and area < 900 and any(d[3:5]) and any(d[5:])


def _ssn(f: Feistel, match) -> str | None:
    digits = [int(c) for c in match[0] if c.isdigit()]
    if not _ssn_valid(digits):
        return None
    digits = f.digits(digits, 10, "ssn")
    while not _ssn_valid(digits):
        digits = f.digits(digits, 10, "ssn")
    return _fill(match[0], digits)


def _date(f: Feistel, match) -> str | None:
    year, a, b = (int(match[x] or match[y]) for x, y in (("y", "y2"), ("m", "m2"), ("d", "d2")))
    month, day, swapped = a, b, False
    if not match["y"] and month > 12 >= day:
        month, day, swapped = day, month, True
    if not (1900 <= year < 2100 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    place = f.number(datetime.date(year, month, day).toordinal() - _FIRST_DAY, _DAYS, "date")
    new = datetime.date.fromordinal(place + _FIRST_DAY)
    sep = match["s"] or match["s2"]
    two = lambda v: f"{v:02d}"
    if match["y"]:
        return sep.join((str(new.year), two(new.month), two(new.day)))
    parts = (new.month, new.day) if swapped else (new.day, new.month)
    return sep.join((two(parts[0]), two(parts[1]), str(new.year)))


def _ip(f: Feistel, match) -> str | None:
    parts = [int(p) for p in match[0].split(".")]
    if max(parts) > 255 or any(p != "0" and p[0] == "0" for p in match[0].split(".")):
        return None
    return ".".join(map(str, f.digits(parts, 256, "ip")))


def _phone(f: Feistel, match) -> str | None:
    text = match[0]
    head = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    kept, rest = (head[0], text[head.end() :]) if head else ("", text)
    digits = [int(c) for c in rest if c.isdigit()]
    if not 7 <= len(digits) <= 14:
        return None
    return kept + _fill(rest, f.digits(digits, 10, f"phone{len(digits)}"))


def _email(f: Feistel, match) -> str:
    local, _, domain = match[0].partition("@")
    *labels, top = domain.split(".")
    return f.classes(local, "local") + "@" + ".".join([*(f.classes(x, "label") for x in labels), top])


_REPLACE = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}
_SCAN = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS.items()]
_HINT = re.compile(r"[0-9@]")


def pseudonymise(text: str, f: Feistel) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms and the number of values by kind."""
    if not _HINT.search(text):
        return text, {}
    taken, counts = [], {}
    for kind, pattern in _SCAN:
        for match in _ibans(pattern, text) if kind == "iban" else pattern.finditer(text):
            new = _REPLACE[kind](f, match)
            if new is not None:
                taken.append((match.start(), match.end(), new, kind))
    out, at = [], 0
    rank = {kind: i for i, kind in enumerate(KINDS)}
    for start, end, new, kind in sorted(taken, key=lambda t: (t[0], rank[t[3]])):
        if start >= at:
            out += [text[at:start], new]
            at = end
            counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]), counts


def _run(key: str, text: str, passed: list[str], out: list[str]):
    def run(batches):
        f = Feistel(key)
        for batch in batches:
            for part in slices(batch, text):
                done = [(None, {}) if t is None else pseudonymise(t, f) for t in part.column(text).to_pylist()]
                counts = [pa.array([d[1].get(kind, 0) for d in done], pa.int64()) for kind in KINDS]
                new = pa.array([d[0] for d in done], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[new if c == text else part.column(c) for c in passed], *counts], names=[*passed, *out]
                )

    return run


def pseudonyms(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """Rows of ``docs`` with ``text`` replaced and n_<kind> per kind."""
    out = [f"n_{kind}" for kind in KINDS]
    passed = [c for c in docs.columns if c not in out]
    schema = T.StructType([docs.schema[c] for c in passed])
    for name in out:
        schema = schema.add(name, "long")
    return docs.select(*passed).mapInArrow(_run(key, text, passed, out), schema)


def op6_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = pseudonyms(docs)
    total = sum((F.col(f"n_{kind}") for kind in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    return rows.select("doc_id", "text", total.alias("n_replaced"), *[f"n_{kind}" for kind in KINDS])


QUERIES = {"op6_pii_pseudonyms": op6_pii_pseudonyms}
