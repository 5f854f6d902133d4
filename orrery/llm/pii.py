"""Format-preserving Feistel pseudonyms of personal data in texts.

Detected values are validated (card numbers by Luhn's digit, account numbers by their remainder, dates by the calendar, addresses
by range ...) and replaced by a keyed permutation of the values of the same format: digits become digits and letters letters,
separators, case and lengths stay, and the result is valid again. Equal values give equal pseudonyms in every document, different
values different ones, and whoever has the key can undo it (``reveal``).

The permutation is a Feistel network of ``ROUNDS`` rounds on the integers below the format's size: the number is split as a * b,
each round adds a keyed hash of one half to the other, and numbers beyond the format are walked through again (cycle walking).
Values of more than ``LONG`` characters are split into two halves of characters instead, and each round adds a keyed stream of the
one half to the other, character by character, so that time grows with the length alone.
Addresses and secrets written differently only in case are different values.

The key is an argument. ``setting_key`` takes it from the session's ``spark.orrery.pii.key``; only the query and a pipeline whose
session has no such setting use the demonstration key, which anyone can read here.

Edge cases: a null text stays null; an empty text stays empty; values that fail validation and look like no other kind stay;
values and texts of any length are taken whole, in time that grows in proportion; repeated rows are kept; an empty table gives no
rows; other columns are ignored or carried.
"""

from __future__ import annotations

import calendar
import hashlib
import math
import re
import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import read, small

ROUNDS = 8
#: Characters from which a value is permuted in halves of characters.
LONG = 64
#: The demonstration query's key.
KEY = b"orrery demonstration key"
KEY_SETTING = "spark.orrery.pii.key"
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
_DAYS = (LAST_DAY - FIRST_DAY).days + 1


def setting_key(spark: SparkSession) -> bytes:
    """The key of the session's setting; without one the demonstration key, with a warning."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        warnings.warn(f"{KEY_SETTING} is not set; pseudonyms are made with the public demonstration key", stacklevel=2)
    return found.encode() if found else KEY


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1; ``back`` undoes it."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def f(i: int, half: int, n: int) -> int:
        message = f"{tweak}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=key, digest_size=16).digest(), "big") % n

    while True:
        left, right = divmod(x, b)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if i % 2:
                right = (right + (-1 if back else 1) * f(i, left, b)) % b
            else:
                left = (left + (-1 if back else 1) * f(i, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def _walk(step: Callable[[str], str], value: str, valid: Callable[[str], bool]) -> str:
    """The first valid value on the permutation's cycle through a valid one; still a permutation of the valid values."""
    while not valid(value := step(value)):
        pass
    return value


def permute_characters(values: np.ndarray, sizes: np.ndarray, key: bytes, tweak: str, back: bool = False) -> np.ndarray:
    """A keyed permutation of the vectors with 0 <= values < sizes, in time that grows with their length."""
    out, middle = values.astype(np.int64), len(values) // 2
    halves = (slice(0, middle), slice(middle, None))
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        mine, other = halves[i % 2], halves[1 - i % 2]
        seed = hashlib.blake2b(f"{tweak}|{i}|".encode() + out[other].astype(np.uint8).tobytes(), key=key).digest()
        stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * len(out[mine])), dtype="<u4").astype(np.int64)
        out[mine] = (out[mine] - stream if back else out[mine] + stream) % sizes[mine]
    return out


def _digits(text: str, key: bytes, tweak: str, back: bool) -> str:
    if len(text) > LONG:
        got = permute_characters(np.frombuffer(text.encode(), dtype=np.uint8) - 48, np.full(len(text), 10), key, f"{tweak}{len(text)}", back)
        return (got + 48).astype(np.uint8).tobytes().decode()
    return str(permute(int(text), 10 ** len(text), key, f"{tweak}{len(text)}", back)).zfill(len(text)) if text else text


def _refill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


#: First code point and number of the characters that are permuted among themselves.
_KINDS = ((48, 10), (97, 26), (65, 26))
_BASE, _SIZE = (np.zeros(128, dtype=np.int64) for _ in range(2))
for _first, _count in _KINDS:
    _BASE[_first : _first + _count], _SIZE[_first : _first + _count] = _first, _count


def _characters(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Digits, lower-case and upper-case letters of ASCII are permuted within their kinds, all at once; the rest stays."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    plain = np.minimum(points, 127)
    base, size = _BASE[plain], np.where(points < 128, _SIZE[plain], 0)
    own = np.flatnonzero(size)
    shape = "".join(chr(b) if n else "-" for b, n in zip(base.tolist(), size.tolist(), strict=True))
    tweak = f"{tweak}|{shape}|{''.join(c for c, n in zip(text, size.tolist(), strict=True) if not n)}"
    values = points[own] - base[own]
    if len(own) > LONG:
        values = permute_characters(values, size[own], key, tweak, back)
    else:
        x, whole = 0, math.prod(size[own].tolist())
        for v, n in zip(values.tolist(), size[own].tolist(), strict=True):
            x = x * n + v
        x = permute(x, whole, key, tweak, back)
        values = []
        for n in reversed(size[own].tolist()):
            x, digit = divmod(x, n)
            values.append(digit)
        values = np.array(values[::-1], dtype=np.int64)
    out = points.copy()
    out[own] = base[own] + values
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def is_card(text: str) -> bool:
    d = _only_digits(text)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def _card(text: str, key: bytes, back: bool) -> str | None:
    if not is_card(text):
        return None
    d = _only_digits(text)
    # the first digit tells the kind of card
    payload = d[0] + _digits(d[1:-1], key, f"card{d[0]}", back)
    return _refill(text, payload + luhn_digit(payload))


def _number(text: str, key: bytes, back: bool) -> str | None:
    """Long numbers that aren't valid cards: customer, account, document numbers. They never turn into valid cards."""
    d = _only_digits(text)
    return None if is_card(d) else _refill(text, _walk(lambda x: _digits(x, key, "number", back), d, lambda x: not is_card(x)))


def _iban_digits(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def is_iban(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and _iban_digits(plain[:2], plain[4:]) == plain[2:4]


def _iban(text: str, key: bytes, back: bool) -> str | None:
    if not is_iban(text):
        return None
    plain = text.replace(" ", "").upper()
    country, body = plain[:2], plain[4:]
    body = _characters(body, key, f"iban{country}", back)
    it = iter(country + _iban_digits(country, body) + body)
    return "".join(c if c == " " else (y if c.isupper() or c.isdigit() else y.lower()) for c in text for y in [c if c == " " else next(it)])


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    d = _only_digits(text)
    return _refill(text, _walk(lambda x: _digits(x, key, "ssn", back), d, _ssn_valid)) if _ssn_valid(d) else None


def _phone(text: str, key: bytes, back: bool) -> str | None:
    d = _only_digits(text)
    if not 7 <= len(d) <= 15:
        return None
    # the country code stays; area and subscriber numbers don't begin with 0 or 1 where they didn't before
    head = len(d) - 10 if len(d) > 10 else 0
    rest = d[head:]
    kept = lambda x: all((a in "01") == (b in "01") for a, b in zip(x[::3][:2], rest[::3][:2], strict=True))
    return _refill(text, d[:head] + _walk(lambda x: _digits(x, key, f"phone{d[:head]}", back), rest, kept))


def _ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ipv6(text: str, key: bytes, back: bool) -> str | None:
    return _characters_hex(text, key, "ipv6", back) if text.count(":") >= 2 and any(c in "0123456789" for c in text) else None


def _characters_hex(text: str, key: bytes, tweak: str, back: bool) -> str:
    digits = "".join(c for c in text if c in "0123456789abcdefABCDEF")
    upper = any(c in "ABCDEF" for c in text)
    lower = any(c in "abcdef" for c in text)
    if not (upper or lower) or (upper and lower):  # decimal digits alone stay decimal
        return _characters(text, key, tweak, back)
    n = len(digits)
    shape = "".join("x" if c in "0123456789abcdefABCDEF" else c for c in text) if n < len(text) else str(n)

    def one_case(x: str) -> bool:
        return any(c.isalpha() for c in x)

    def step(x: str) -> str:
        if n <= LONG:
            return f"{permute(int(x, 16), 16**n, key, f'{tweak}|{shape}|{upper}', back):0{n}x}"
        values = np.array([int(c, 16) for c in x])
        return "".join(map("0123456789abcdef".__getitem__, permute_characters(values, np.full(n, 16), key, f"{tweak}|{shape}|{upper}", back).tolist()))

    new = _walk(step, digits.lower(), one_case)
    it = iter(new.upper() if upper else new)
    return "".join(next(it) if c in "0123456789abcdefABCDEF" else c for c in text)


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    labels = domain.split(".")
    return f"{_characters(local, key, 'email', back)}@{'.'.join([*(_characters(x, key, 'domain', back) for x in labels[:-1]), labels[-1]])}"


def _named_secret(text: str, key: bytes, back: bool) -> str | None:
    return _secret(text, key, back) if any("0" <= c <= "9" for c in text) else None


def _secret(text: str, key: bytes, back: bool) -> str | None:
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", text):
        return _characters_hex(text, key, "secret", back)
    m = re.match(r"(?:sk|pk|rk)[-_](?:live|test)[-_]|gh[pousr]_|github_pat_|xox[abprs]-|AKIA|ASIA|AIza|eyJ|sk-", text)
    head = m.end() if m else 0
    return text[:head] + _characters(text[head:], key, "secret", back)


_MONTHS = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if name}


def _date(kind: str) -> Callable[[str, bytes, bool], str | None]:
    def run(text: str, key: bytes, back: bool) -> str | None:
        parts = re.split(r"([^0-9A-Za-z]+)", text)
        order = {"ymd": (0, 1, 2), "dmy": (2, 1, 0), "mdy": (2, 0, 1)}[kind]
        fields, seps = parts[::2], parts[1::2]
        y, m, d = (fields[i] for i in order)
        try:
            month = int(m) if m.isdigit() else _MONTHS[m.lower()]
            day = (date(int(y), month, int(d)) - FIRST_DAY).days
        except (ValueError, KeyError):
            return None
        if not 0 <= day < _DAYS:
            return None
        got = FIRST_DAY + timedelta(days=permute(day, _DAYS, key, "date", back))
        # fields of one digit tell that the format has no leading zeros
        padded = [len(x) == 2 for x in fields]
        out = [""] * 3
        out[order[0]] = f"{got.year:04d}"
        long = m.isalpha() and len(m) > 3
        out[order[1]] = (calendar.month_name if long else calendar.month_abbr)[got.month] if not m.isdigit() else f"{got.month:02d}" if padded[order[1]] else str(got.month)
        out[order[2]] = f"{got.day:02d}" if padded[order[2]] else str(got.day)
        return out[0] + seps[0] + out[1] + seps[1] + out[2]

    return run


_month = "|".join(sorted({m.capitalize() for m in _MONTHS}, key=lambda x: (-len(x), x)))
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
#: Kind, pattern, and what replaces a value (None: not valid, look further). Earlier kinds go first at the same place.
KINDS: tuple[tuple[str, str, Callable[[str, bytes, bool], str | None]], ...] = (
    ("email", rf"{_LOCAL}+{_DOMAIN}", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("ipv4", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _ipv4),
    ("date", r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}(?![0-9])", _date("ymd")),
    ("date", r"(?<![0-9])(?:19|20)[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}(?![0-9])", _date("ymd")),
    ("date", r"(?<![0-9])(?:19|20)[0-9]{2}\.[0-9]{1,2}\.[0-9]{1,2}(?![0-9])", _date("ymd")),
    ("date", r"(?<![0-9])[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}(?![0-9])", _date("dmy")),
    ("date", r"(?<![0-9])[0-9]{1,2}([/-])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9])", _date("dmy")),
    ("date", r"(?<![0-9])[0-9]{1,2}([/-])[0-9]{1,2}\1(?:19|20)[0-9]{2}(?![0-9])", _date("mdy")),
    ("date", rf"(?<![0-9])[0-9]{{1,2}} (?:{_month}) (?:19|20)[0-9]{{2}}(?![0-9])", _date("dmy")),
    ("date", rf"(?<![A-Za-z])(?:{_month}) [0-9]{{1,2}},? (?:19|20)[0-9]{{2}}(?![0-9])", _date("mdy")),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", _ssn),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", _card),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])", _phone),
    ("phone", r"(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", _phone),
    ("phone", r"(?<![0-9A-Za-z.-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9])", _phone),
    ("secret", r"(?<![A-Za-z0-9])(?:(?:sk|pk|rk)[-_](?:live|test)[-_]|gh[pousr]_|github_pat_|xox[abprs]-|AKIA|ASIA|AIza|sk-)[A-Za-z0-9_-]{12,}", _secret),
    ("secret", r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?)[\"']?\s*(?:=|:|=>)\s*[\"']?(?P<v>[^\s\"',;]{6,})", _named_secret),
    ("secret", r"(?<=[\"'=: ])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}(?=[\"'\s,;]|$)", _secret),
    ("secret", r"(?<![A-Za-z0-9])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,}(?![A-Za-z0-9])", _secret),
    ("ipv6", r"(?<![A-Za-z0-9:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![A-Za-z0-9:])", _ipv6),
    ("number", r"(?<![0-9A-Za-z.,])[0-9]{9,}(?![0-9A-Za-z]|[.,][0-9])", _number),
)
_PATTERNS = [re.compile(p) for _, p, _ in KINDS]
_ANY = re.compile("[0-9@]")
_AT_DOMAIN = re.compile(_DOMAIN)
#: Groups that a value within a match may begin or end with.
_GROUP = re.compile("[0-9A-Za-z]{3,}")


def _mail_spans(text: str) -> Iterator[tuple[int, int]]:
    """Mailboxes, looked for from each @ outwards: what may stand before one holds no @, so nothing is read twice."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        domain = _AT_DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
        last = domain.end() if domain else at + 1
        at = text.find("@", last)


def _grouped_spans(pattern: re.Pattern, valid: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Values written in groups: of a match that isn't valid the valid runs of its groups, the longest first one, and on behind it."""

    def run(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        while m := pattern.search(text, at):
            start, end = m.span()
            at = max(start + 1, end)
            if valid(m[0]):
                yield start, end
                continue
            groups = [(start + g.start(), start + g.end()) for g in _GROUP.finditer(m[0])]
            found = next(((a, b) for i, (a, _) in enumerate(groups) for _, b in reversed(groups[i:]) if pattern.fullmatch(text[a:b]) and valid(text[a:b])), None)
            if found:
                yield found
                at = found[1]
            elif len(groups) > 1:  # a value may begin at a later group and go on behind the match
                at = groups[1][0]

    return run


def _spans(kind: str, pattern: re.Pattern, replace: Callable[[str, bytes, bool], str | None]) -> Callable[[str], Iterator[tuple[int, int]]]:
    if kind == "email":
        return _mail_spans
    if kind in ("card", "iban"):
        return _grouped_spans(pattern, is_card if kind == "card" else is_iban)
    value = "v" if "v" in pattern.groupindex else 0
    return lambda text: (m.span(value) for m in pattern.finditer(text))


_FINDERS = [_spans(kind, pattern, replace) for (kind, _, replace), pattern in zip(KINDS, _PATTERNS, strict=True)]


def find(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, replacement) of the values in a text, apart and in order."""
    if not _ANY.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for (kind, _, replace), spans in zip(KINDS, _FINDERS, strict=True):
        for start, end in spans(text):
            if taken.find(1, start, end) >= 0:
                continue
            value = text[start:end]
            new = _replacement(replace, value, key, back) if len(value) <= LONG else replace(value, key, back)
            if new is not None:
                found.append((start, end, kind, new))
                taken[start:end] = b"\1" * (end - start)
    return sorted(found)


@lru_cache(maxsize=1 << 16)
def _replacement(replace: Callable[[str, bytes, bool], str | None], value: str, key: bytes, back: bool) -> str | None:
    return replace(value, key, back)


def pseudonymise(text: str | None, key: bytes = KEY, back: bool = False) -> tuple[str | None, Counter]:
    """The text with its values replaced, and how many of each kind."""
    found = find(text, key, back) if text else []
    if not found:
        return text, Counter()
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), Counter(kind for _, _, kind, _ in found)


def reveal(value: str, kind: str, key: bytes = KEY) -> str | None:
    """The value that has this pseudonym."""
    for name, pattern, replace in KINDS:
        if name == kind and ("(?P<v>" in pattern or re.fullmatch(pattern, value)) and (old := replace(value, key, True)) is not None:
            return old
    return None


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, text (with pseudonyms), n_values, kinds (found kinds, sorted, comma-joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [pseudonymise(t, key) for t in batch.column(1).to_pylist()]
            columns = [pa.array([t for t, _ in got], pa.string()), pa.array([sum(c.values()) for _, c in got], pa.int64()), pa.array([",".join(sorted(c)) for _, c in got], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "text", "n_values", "kinds"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text string, n_values long, kinds string")


def replace_texts(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with pseudonyms in their texts and n_chars counted anew; columns as given."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns = dict(zip(names, batch.columns, strict=True))
            texts = [pseudonymise(t, key)[0] for t in columns["text"].to_pylist()]
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)


def op8_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise_documents(read(spark, sf_dir, "documents"), KEY)
