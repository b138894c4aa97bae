"""Personal data as format-preserving Feistel pseudonyms.

Values that pass their type's test (check digits, ranges, calendar) are ranked among the values of their format,
permuted there by a keyed Feistel network with cycle walking, and written in the same format. Equal values hence get
equal pseudonyms in every document, and whoever holds the key can invert them.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized

ROUNDS = 8


class Feistel:
    """A keyed permutation of range(n) for any n and tweak."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8 + 8
        digest = hashlib.blake2b(b"%d:%d:" % (i, value) + tweak, key=self.key, digest_size=min(64, size)).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, tweak: bytes, inverse: bool = False) -> int:
        """A permutation that leaves no value in its place (if n is over 1): one step along a keyed cycle of them all."""
        step = -1 if inverse else 1
        return self.walk((self.walk(value, n, tweak) + step) % n, n, tweak, True)

    def walk(self, value: int, n: int, tweak: bytes, inverse: bool = False) -> int:
        """The Feistel network, applied until the value is in range."""
        if not 0 <= value < n:
            raise ValueError("value out of range")
        if n == 1:
            return 0
        bits = max(2, (n - 1).bit_length())
        low = bits // 2
        high = bits - low
        while True:  # under 4 times on average
            a, b, wide, narrow = value >> low, value & ((1 << low) - 1), high, low
            if not inverse:
                for i in range(ROUNDS):
                    a, b, wide, narrow = b, a ^ self._round(tweak, i, b, wide), narrow, wide
            else:
                for i in reversed(range(ROUNDS)):
                    a, b, wide, narrow = b ^ self._round(tweak, i, a, narrow), a, narrow, wide
            value = (a << low) | b
            if value < n:
                return value


def mixed(digits: Sequence[int], bases: Sequence[int]) -> tuple[int, int]:
    """A number and its range from digits of different bases."""
    value, n = 0, 1
    for d, b in zip(digits, bases, strict=True):
        value, n = value * b + d, n * b
    return value, n


def unmixed(value: int, bases: Sequence[int]) -> list[int]:
    out = []
    for b in reversed(bases):
        value, d = divmod(value, b)
        out.append(d)
    return out[::-1]


def luhn(digits: Sequence[int]) -> int:
    """The check digit that follows digits."""
    total = sum(2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(digits)))
    return -total % 10


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789", "abcdef", "ABCDEF")
#: How a card number may begin (from and to, in the digits given), by its number of digits.
ISSUERS = {
    13: [("4", "4")],
    14: [("300", "305"), ("36", "36"), ("38", "39")],
    15: [("34", "34"), ("37", "37")],
    16: [("2221", "2720"), ("3528", "3589"), ("4", "4"), ("51", "55"), ("6011", "6011"), ("62", "62"), ("644", "659")],
    17: [("62", "62")],
    18: [("62", "62")],
    19: [("4", "4"), ("62", "62"), ("6011", "6011"), ("644", "659")],
}
AREAS = [x for x in range(1, 900) if x != 666]
#: What the pattern of card numbers takes though it may be a phone number.
PHONE = re.compile(r"(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-][0-9]{2,4}){2,4}")

#: A number as it is dialled inside a country: 0, the area's code, the number.
NATIONAL, DIALLED = re.compile(r"0[1-9][0-9]{1,3}[ /-][0-9]{5,8}"), re.compile(r"0[0-9]{2,4}[ /-][0-9]{5,8}")


class Pseudonyms:
    """Replaces the values that it finds in a text. Types: email, phone, card, ssn, iban, ip, ip6, date, secret.

    Each type has a method that names a valid value's format (None for a value that fails the type's test) and one that
    permutes the values of some larger set; the permutation is applied until the format is the value's own again. Hence
    each format is permuted by itself, and a pseudonym is found and inverted as what it stands for."""

    def __init__(self, key: bytes, inverse: bool = False) -> None:
        self.feistel, self.inverse = Feistel(key), inverse
        patterns = {
            "email": r"(?<![\w.%+-])[\w.%+-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])",
            "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)(?P<quote>[\"']?)[A-Za-z0-9_\-+/]{8,}(?P=quote)",
            "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
            "date": r"(?<![\w.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w\-/]|\.[0-9])",
            "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
            "ip6": r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.[0-9])",
            "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
            "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
            "phone": r"(?<![\w.+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\w|\.[0-9])|(?<![\w.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w.+-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![\w-]|\.[0-9])",
        }
        self.kinds = list(patterns)
        self.find = re.compile("|".join(f"(?P<{k}>{p})" for k, p in patterns.items()))
        self.hint = re.compile(r"[0-9@]|(?i:passw|pwd|secret|token|api.?key)")

    def _permute(self, digits: Sequence[int], bases: Sequence[int], tweak: str) -> list[int]:
        value, n = mixed(digits, bases)
        return unmixed(self.feistel.permute(value, n, tweak.encode(), self.inverse), bases)

    def _chars(self, kind: str, text: str, keep: int = 0, classes: Sequence[str] = CLASSES) -> str:
        """Permute the ASCII letters and digits from position keep on, each within its class; all else stays."""
        spots = [(i, next((c for c in classes if text[i] in c), "")) for i in range(keep, len(text))]
        spots = [(i, c) for i, c in spots if c]
        if not spots:
            return text
        sizes = [len(c) for _, c in spots]
        out = list(text)
        for (i, c), d in zip(spots, self._permute([c.index(text[i]) for i, c in spots], sizes, f"{kind}:{text[:keep]}:{','.join(map(str, sizes))}"), strict=True):
            out[i] = c[d]
        return "".join(out)

    def email_format(self, text: str) -> str:
        return ""

    def email(self, text: str, form: object = None) -> str:
        local, _, domain = text.partition("@")
        return f"{self._chars('email', local)}@{domain}"

    def secret_format(self, text: str) -> str:
        return ""

    def secret(self, text: str, form: object = None) -> str:
        if text.startswith("AKIA"):
            # Letters and digits may change places: one alphabet.
            alphabet = CLASSES[2] + CLASSES[0]
            return "AKIA" + "".join(alphabet[d] for d in self._permute([alphabet.index(c) for c in text[4:]], [36] * 16, "secret:AKIA"))
        head = re.match(r"[^=:]*[=:]\s*[\"']?", text)
        start = head.end() if head else 0
        return text[:start] + self._chars("secret", text[start:])

    def _country(self, text: str) -> int:
        """How much of a phone number is its country's code, or the 0 before its area's; that stays."""
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        return country.end() if country else int(bool(DIALLED.fullmatch(text)))  # whatever the permutation makes of it

    def phone_format(self, text: str) -> bool | str | None:
        """Whether it is a valid North American number: area and exchange don't start with 0 or 1; of a number that begins
        with 0 and its area's code, that."""
        if NATIONAL.fullmatch(text):
            return "national" if sum(c.isdigit() for c in text) >= 9 else None
        digits, keep = [c for c in text if c.isdigit()], self._country(text)
        if not 9 <= len(digits) <= 15:
            return None
        local = [c for c in text[keep:] if c.isdigit()]
        return len(local) == 10 and text[:keep] in ("", "+1") and local[0] > "1" and local[3] > "1"

    def phone(self, text: str, form: object = None) -> str:
        return self._chars("phone", text, self._country(text))

    def ssn_format(self, text: str) -> str | None:
        a, b, c = map(int, text.split("-"))
        return None if a in (0, 666) or a > 899 or not b or not c else ""

    def ssn(self, text: str, form: object = None) -> str:
        a, b, c = map(int, text.split("-"))
        x, y, z = self._permute([AREAS.index(a), b - 1, c - 1], [len(AREAS), 99, 9999], "ssn")
        return f"{AREAS[x]:03}-{y + 1:02}-{z + 1:04}"

    def card_format(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        begins = [(a, b) for a, b in ISSUERS.get(len(digits), []) if a <= digits[: len(a)] <= b]
        right = begins and luhn([int(c) for c in digits[:-1]]) == int(digits[-1]) and len(set(digits)) > 1
        return f"{begins[0][0]}:{len(os.path.commonprefix(begins[0]))}" if right else None

    def card(self, text: str, form: str) -> str:
        """Keeps the digits that all numbers of the issuer share and sets the check digit."""
        digits = [int(c) for c in text if c.isdigit()]
        kept = int(form.split(":")[1])
        new = [*digits[:kept], *self._permute(digits[kept:-1], [10] * (len(digits) - kept - 1), f"card:{digits[:kept]}")]
        new.append(luhn(new))
        left = iter(new)
        return "".join(str(next(left)) if c.isdigit() else c for c in text)

    def _iban_check(self, country: str, body: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97

    def iban_format(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        return "" if 15 <= len(plain) <= 34 and self._iban_check(plain[:2], plain[4:]) == int(plain[2:4]) else None

    def iban(self, text: str, form: object = None) -> str:
        plain = text.replace(" ", "")
        body = self._chars("iban" + plain[:2], plain[4:])
        left = iter(f"{plain[:2]}{self._iban_check(plain[:2], body):02}{body}")
        return "".join(c if c == " " else next(left) for c in text)

    def ip6_format(self, text: str) -> str | None:
        """Which groups begin with a 0 that could be left out. Three groups and a digit at least: other code has double colons."""
        groups = [g for g in text.split(":") if g]
        if len(groups) < 3 or not any(c.isdigit() for c in text):
            return None
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return "".join("0" if len(g) > 1 and g[0] == "0" else "1" for g in groups)

    def ip6(self, text: str, form: object = None) -> str:
        return self._chars("ip6", text, classes=HEX)

    def ip_format(self, text: str) -> str | None:
        return None if any(int(p) > 255 or p != str(int(p)) for p in text.split(".")) else ""

    def ip(self, text: str, form: object = None) -> str:
        """Each number keeps its count of digits."""
        parts = text.split(".")
        first, sizes = [{1: 0, 2: 10, 3: 100}[len(p)] for p in parts], [{1: 10, 2: 90, 3: 156}[len(p)] for p in parts]
        new = self._permute([int(p) - f for p, f in zip(parts, first, strict=True)], sizes, f"ip:{sizes}")
        return ".".join(str(d + f) for d, f in zip(new, first, strict=True))

    def _dated(self, text: str, order: str) -> dt.date | None:
        named = dict(zip(order, map(int, re.split("[^0-9]", text)), strict=True))
        try:
            return dt.date(named["y"], named["m"], named["d"])
        except ValueError:
            return None

    def date_format(self, text: str) -> tuple[str, int, list[int], list[bool] | None] | None:
        """Order, century, and the digits of day and month; where one stands without a leading zero, also which have
        one. d/m/y is read day first, or month first where only that is a date."""
        parts = re.split("[^0-9]", text)
        for order in ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"] if "/" in text else ["dmy"]:
            if day := self._dated(text, order):
                widths = [len(p) for p in parts]
                return order, (day.year - 1) // 100, widths, [p[0] == "0" for p in parts] if 1 in widths else None
        return None

    def date(self, text: str, form: tuple[str, int, list[int], object]) -> str:
        """A real date becomes another one of its century (the years 1901 to 2000, say), written in the same order."""
        order, century, widths, _ = form
        first = dt.date(century * 100 + 1, 1, 1)
        last = dt.date(min(first.year + 99, 9999), 12, 31)
        new = first + dt.timedelta(self._permute([(self._dated(text, order) - first).days], [(last - first).days + 1], f"date:{order}:{first.year}")[0])
        values = {"y": new.year, "m": new.month, "d": new.day}
        return next(c for c in text if not c.isdigit()).join(f"{values[k]:0{w}}" for k, w in zip(order, widths, strict=True))

    def read(self, kind: str, text: str) -> tuple[str, object] | None:
        """The type and the format of what the pattern of a type has found."""
        found = getattr(self, f"{kind}_format")(text)
        if found is None and kind == "card" and PHONE.fullmatch(text):
            kind, found = "phone", self.phone_format(text)
        return None if found is None else (kind, found)

    def pseudonym(self, kind: str, text: str) -> tuple[str, str] | None:
        """The type of a found value and what replaces it; None for one that fails the test."""
        found = self.read(kind, text)
        if found is None:
            return None
        while True:
            text = getattr(self, found[0])(text, found[1])
            if self.read(kind, text) == found:
                return found[0], text

    def apply(self, text: str) -> tuple[str, Counter[str]]:
        """The text with pseudonyms, and how many values of each type were replaced."""
        found: Counter[str] = Counter()
        if not self.hint.search(text):
            return text, found

        def swap(m: re.Match[str]) -> str:
            new = self.pseudonym(next(k for k in self.kinds if m[k] is not None), m[0])
            if new is None or new[1] == m[0]:  # nothing in it to permute
                return m[0]
            found[new[0]] += 1
            return new[1]

        return self.find.sub(swap, text), found


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, text, n_replaced, kinds), text with pseudonyms.

    kinds lists the types with their counts, sorted, as `card:1,email:2`. A null text stays null, with none replaced;
    null ids are kept; repeated rows give equal rows; an empty table gives an empty result; whole texts are read, however
    long; other columns aren't read, whatever their names. What fails its type's test (a wrong check digit, no issuer, no
    calendar day) is left as it is. With inverse, pseudonyms turn back into the values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonyms(key, inverse)
        for batch in batches:
            for part in sized(batch, "text", rows=1000):
                texts, counts, kinds = [], [], []
                for x in part.column("text").to_pylist():
                    new, found = worker.apply(x) if x is not None else (None, Counter())
                    texts.append(new)
                    counts.append(sum(found.values()))
                    kinds.append(",".join(f"{k}:{n}" for k, n in sorted(found.items())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], ["doc_id", "text", "n_replaced", "kinds"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, n_replaced long, kinds string")
