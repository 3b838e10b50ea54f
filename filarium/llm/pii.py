"""Personal data: validated numbers, addresses and dates become pseudonyms of the same format.

A value is a place in the set of its format's valid values, and a keyed Feistel network permutes
that set. Equal values so become equal pseudonyms in every document, different ones stay
different, and the holder of the key can go back. Check digits are made anew and separators stay,
so a pseudonym passes the checks that the value passed. Values outside their format, such as card
numbers with a wrong check digit, are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROUNDS = 8
KINDS = ["card", "iban", "ssn", "phone", "ip", "email", "date"]

# Lengths of IBANs by country, month names.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22,
               "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

FIRST_DAY, DAYS = date(1900, 1, 1), 73_049

_PATTERN = re.compile(r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-]))
  | (?P<iban>(?<!\w)[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]){11,26}(?!\w))
  | (?P<date>(?<![\w/.-])(?:(?P<y1>(?:19|20)\d\d)(?P<s1>[-/.])(?P<m1>\d\d)(?P=s1)(?P<d1>\d\d)
      |(?P<d2>\d\d)(?P<s2>[-/.])(?P<m2>\d\d)(?P=s2)(?P<y2>(?:19|20)\d\d)
      |(?P<m3>""" + "|".join(MONTHS) + r""")[ ](?P<d3>\d{1,2}),[ ](?P<y3>(?:19|20)\d\d))(?![\w/-]|\.\d))
  | (?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
  | (?P<phone>(?<![\w(])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)
      |(?<!\w)\+1\d{10}(?!\w)|\+[2-9]\d(?:[ .-]?\d){7,11}(?!\w))
  | (?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))
""", re.VERBOSE | re.ASCII)


class Feistel:
    """Keyed permutation of the integers below any size."""

    def __init__(self, key: bytes, decrypt: bool = False):
        self.key, self.decrypt = hashlib.sha256(key).digest(), decrypt

    def _mask(self, kind: bytes, step: int, half: int, modulus: int) -> int:
        text = b"%b|%d|%d|%d" % (kind, step, modulus, half)
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "little") % modulus

    def _once(self, kind: bytes, value: int, a: int, b: int) -> int:
        """Permute the numbers below a * b."""
        left, right = divmod(value, b)
        sizes = (a, b)
        for step in range(ROUNDS):
            s = ROUNDS - 1 - step if self.decrypt else step
            if s % 2:
                mask = self._mask(kind, s, left, sizes[1])
                right = (right - mask if self.decrypt else right + mask) % sizes[1]
            else:
                mask = self._mask(kind, s, right, sizes[0])
                left = (left - mask if self.decrypt else left + mask) % sizes[0]
        return left * b + right

    def __call__(self, kind: str, value: int, size: int, valid: Callable[[int], bool] = lambda v: True) -> int:
        """Permute the valid numbers below ``size``; walks on from what is not one of them."""
        a = _root(size)
        b = -(-size // a)
        tweak = b"%b|%d" % (kind.encode(), size)
        while True:
            value = self._once(tweak, value, a, b)
            if value < size and valid(value):
                return value


def _root(size: int) -> int:
    """Least integer whose square is at least the size."""
    x = isqrt(size)
    return x if x * x == size else x + 1


def luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _mixed(text: str) -> tuple[int, int]:
    """Number of a text among those of its format (digits for digits, letters for letters of its case), and their count."""
    value, size = 0, 1
    for c in text:
        base = 10 if "0" <= c <= "9" else 26 if c.isalpha() else 1
        value = value * base + (int(c) if base == 10 else (ord(c) | 32) - 97 if base == 26 else 0)
        size *= base
    return value, size


def _unmixed(value: int, like: str) -> str:
    out = []
    for c in reversed(like):
        base = 10 if "0" <= c <= "9" else 26 if c.isalpha() else 1
        value, d = divmod(value, base)
        out.append(str(d) if base == 10 else chr(d + (65 if c.isupper() else 97)) if base == 26 else c)
    return "".join(reversed(out))


def _refill(like: str, symbols: str) -> str:
    """The symbols at the places of ``like`` that hold letters or digits."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in like)


def _start(text: str, symbols: int) -> str:
    """The start of a text that holds so many letters and digits; the whole text if it has fewer."""
    at = [i for i, c in enumerate(text) if c.isalnum()]
    return text[:at[symbols - 1] + 1] if symbols <= len(at) else text


class Pseudonyms:
    def __init__(self, key: bytes, decrypt: bool = False):
        self.permute = Feistel(key, decrypt)

    def card(self, m: re.Match) -> str | None:
        """New text of the shortest start of the match that is a card number and ends at a separator or with the match.

        The shortest one, because what follows must not decide: a pseudonym beside other digits is found again.
        """
        ends = [e for e in range(13, len(m[0])) if m[0][e] in " -"] + [len(m[0])]
        numbers = [n for n in (re.sub(r"\D", "", m[0][:e]) for e in ends) if len(n) >= 13]
        right = lambda n: luhn(n[:-1]) == int(n[-1])
        d = next((n for n in numbers if right(n) and int(n)), None)
        if d is None:
            return None
        shorter = [len(n) for n in numbers if len(n) < len(d)]
        # the first digit tells the scheme and stays; no shorter start of the pseudonym is a card number
        body = lambda v: d[0] + str(v).zfill(len(d) - 2)
        rest = self.permute("card" + d[0], int(d[1:-1]), 10 ** (len(d) - 2), lambda v: not any(right(body(v)[:n]) for n in shorter))
        return _refill(_start(m[0], len(d)), body(rest) + str(luhn(body(rest))))

    def iban(self, m: re.Match) -> str | None:
        """New text of the match's start of the country's length, if that is an IBAN and a word ends there."""
        used = _start(m[0], IBAN_LENGTH.get(m[0][:2], 99))
        plain = used.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if IBAN_LENGTH.get(country) != len(plain) or m[0][len(used):][:1].isalnum() or _iban_check(country, rest) != int(check):
            return None
        value, size = _mixed(rest)
        new = _unmixed(self.permute("iban" + country + re.sub("[A-Z]", "A", re.sub(r"\d", "0", rest)), value, size), rest)
        return _refill(used, f"{country}{_iban_check(country, new):02d}{new}")

    @staticmethod
    def _ssn_ok(v: int) -> bool:
        area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    def ssn(self, m: re.Match) -> str | None:
        v = int(m[0].replace("-", ""))
        return _refill(m[0], f"{self.permute('ssn', v, 10 ** 9, self._ssn_ok):09d}") if self._ssn_ok(v) else None

    def phone(self, m: re.Match) -> str | None:
        d = re.sub(r"\D", "", m[0])
        if m[0].startswith("+") and d[0] != "1":
            return _refill(m[0], d[:2] + str(self.permute("phone" + d[:2], int(d[2:]), 10 ** (len(d) - 2))).zfill(len(d) - 2))
        return _refill(m[0], d[:-10] + str(self.permute("phone", int(d[-10:]), 10 ** 10)).zfill(10))

    def ip(self, m: re.Match) -> str | None:
        parts = [int(x) for x in m[0].split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
            return None
        return ".".join(map(str, self.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32).to_bytes(4, "big")))

    def email(self, m: re.Match) -> str | None:
        local, domain = m[0].rsplit("@", 1)
        value, size = _mixed(local)
        form = re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", local)))
        return f"{_unmixed(self.permute('email' + domain.lower() + form, value, size), local)}@{domain}"

    def date(self, m: re.Match) -> str | None:
        y, mo, d = (next(m[g + i] for i in "123" if m[g + i]) for g in "ymd")
        try:
            day = date(int(y), MONTHS.index(mo) + 1 if mo in MONTHS else int(mo), int(d))
        except ValueError:
            return None
        new = FIRST_DAY + timedelta(self.permute("date", (day - FIRST_DAY).days, DAYS))
        if m["y1"]:
            return f"{new.year}{m['s1']}{new.month:02d}{m['s1']}{new.day:02d}"
        if m["y2"]:
            return f"{new.day:02d}{m['s2']}{new.month:02d}{m['s2']}{new.year}"
        return f"{MONTHS[new.month - 1]} {new.day}, {new.year}"

    def text(self, text: str, count: dict[str, int]) -> str:
        out, done, at = [], 0, 0
        while m := _PATTERN.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            new = getattr(self, kind)(m)
            if new is None:
                # what only looks like an IBAN, of no known country, does not hide what follows its first four characters
                at = m.start() + 4 if kind == "iban" and m[0][:2] not in IBAN_LENGTH else m.end()
                continue
            # of cards and ibans a start of the match may be used; the search goes on after it
            at = m.start() + len(new) if kind in ("card", "iban") else m.end()
            out += [text[done:m.start()], new]
            done = at
            count[kind] = count.get(kind, 0) + 1
        return "".join([*out, text[done:]])


def pseudonymise(docs: DataFrame, key: bytes, decrypt: bool = False) -> DataFrame:
    """Per row: doc_id, text with pseudonyms, and the number replaced of each kind.

    Null texts stay null. ``decrypt`` takes a table of pseudonyms back to the values.
    """
    def run(batches):
        work = Pseudonyms(key, decrypt)
        for t in batches:
            ids, texts = (t.column(t.schema.get_field_index(c)) for c in ("doc_id", "text"))
            some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_numpy(zero_copy_only=False)
            for at in range(0, t.num_rows, 256):
                out, counts = texts.slice(at, 256).to_pylist(), []
                for i, hit in enumerate(some[at:at + 256]):
                    counts.append({})
                    if hit:
                        out[i] = work.text(out[i], counts[i])
                cols = [pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(out, pa.string()), *cols],
                                                 names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
