"""PII: format-preserving Feistel pseudonyms.

Each validated value is numbered within the set of values of its format, the number is permuted by a
keyed Feistel network (walking the cycle until it lies in the set again), and the result is written in
the same format. Equal values get equal pseudonyms in every document; different ones never collide, and
who has the key can undo them. Numbers grouped like a card's whose check digit is wrong are a kind of their own,
``card_like``: their pseudonyms have a wrong check digit too.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from bisect import bisect
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import documents, map_arrow

ROUNDS = 8
#: Kind, start, end and pseudonym.
Spans = Iterator[tuple[str, int, int, str]]
#: For tests and trials only; queries say so when they use it.
TEST_KEY = b"lodeweave: replace this key in production"
KEY_SETTING = "spark.lodeweave.piiKey"
#: Letters and digits that are permuted as one number; longer values are chained.
SEGMENT = 48


def _digest(data: bytes, key: bytes, label: bytes, width: int) -> bytes:
    """``width`` pseudorandom bytes."""
    if width <= 64:
        return hashlib.blake2b(data, key=key, salt=label, digest_size=max(8, width)).digest()
    return hashlib.shake_256(hashlib.blake2b(data, key=key, salt=label).digest()).digest(width)


def permute(n: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] = lambda _: True, inverse: bool = False) -> int:
    """A keyed permutation of those of 0..size-1 for which ``valid`` holds; ``n`` must be one of them. ``key``: 64 bytes at most."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    label = hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()
    f = lambda i, x: int.from_bytes(_digest(x.to_bytes(width, "big") + bytes([i]), key, label, width), "big") & mask
    x = n
    while True:
        left, right = x >> half, x & mask
        if inverse:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ f(i, left), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ f(i, right)
        x = left << half | right
        if x < size and valid(x):
            return x


def _jumble(chars: str, key: bytes, tweak: str, inverse: bool) -> str:
    """ASCII letters and digits permuted as one number of mixed radix; the case of letters stays."""
    first = ["0" if c <= "9" else "A" if c <= "Z" else "a" for c in chars]
    n, size = 0, 1
    for c, s in zip(chars, first, strict=True):
        base = 10 if s == "0" else 26
        n, size = n * base + ord(c) - ord(s), size * base
    n = permute(n, size, key, tweak, inverse=inverse)
    out = []
    for s in reversed(first):
        n, c = divmod(n, 10 if s == "0" else 26)
        out.append(chr(ord(s) + c))
    return "".join(reversed(out))


def jumbled(chars: str, key: bytes, tweak: str, inverse: bool = False) -> str:
    """A keyed permutation of the strings of ASCII letters and digits with the same classes in the same places.

    Up to SEGMENT characters are one number. Longer ones go by segments, in time linear in the length: forward, each
    segment's tweak being a digest of the segments before it, and backward again, so that every character counts everywhere.
    """
    if len(chars) <= SEGMENT:
        return _jumble(chars, key, tweak, inverse)
    parts = [chars[i : i + SEGMENT] for i in range(0, len(chars), SEGMENT)]

    def walk(parts: list[str], name: str) -> list[str]:
        seen, out = hashlib.blake2b(f"{tweak}:{len(chars)}:{name}".encode(), digest_size=16), []
        for x in parts:
            y = _jumble(x, key, f"chain:{seen.hexdigest()}", inverse)
            seen.update((x if inverse else y).encode())
            out.append(y)
        return out

    if inverse:
        return "".join(walk(walk(parts[::-1], "back")[::-1], "forth"))
    return "".join(walk(walk(parts, "forth")[::-1], "back")[::-1])


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(twice[int(d)] for d in digits[-2::-2])) % 10 == 0


def put(shape: str, chars: str, where: Callable[[str], bool] = str.isdigit) -> str:
    """``shape`` with the characters of a kind, digits by default, replaced in order."""
    it = iter(chars)
    return "".join(next(it) if where(c) else c for c in shape)


def _email(m: re.Match, key: bytes) -> Spans:
    """Letters and digits of the part before the @; case, punctuation and the domain stay."""
    local = m.group(1)
    shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", local)))
    if len(shape) > SEGMENT:
        shape = hashlib.blake2b(shape.encode(), digest_size=16).hexdigest()
    yield "email", m.start(1), m.end(), put(local, jumbled("".join(filter(str.isalnum, local)), key, "email:" + shape), str.isalnum) + m.group(2)


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = m.group().split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


#: Length of the IBANs of each country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _ibans(m: re.Match, key: bytes) -> Spans:
    """What has the country's length, then all that the pattern took. No cut goes between two digits or two letters."""
    text, a = m.group(), m.start()
    at = [i for i, c in enumerate(text) if c != " "]
    n = IBAN_LENGTHS.get(text[:2], len(at))
    if n < len(at):
        end = at[n - 1] + 1
        if (text[end] == " " or text[end].isdigit() != text[end - 1].isdigit()) and (new := _iban(text[:end], key)) is not None:
            yield "iban", a, a + end, new
    if (new := _iban(text, key)) is not None:
        yield "iban", a, m.end(), new


def _iban(text: str, key: bytes) -> str | None:
    """Digits of the account part (letters where it has none), check digits made anew; country, other letters and spacing stay."""
    flat = text.replace(" ", "")
    check = lambda body, cc: int("".join(str(int(c, 36)) for c in body + cc + "00")) % 97
    if not 15 <= len(flat) <= 34 or 98 - check(flat[4:], flat[:2]) != int(flat[2:4]):
        return None
    kind = str.isdigit if any(c.isdigit() for c in flat[4:]) else str.isalpha
    body = put(flat[4:], jumbled("".join(filter(kind, flat[4:])), key, "iban:" + re.sub("[0-9]", "0", flat[4:] if kind is str.isdigit else "") + flat[:2]), kind)
    return put(text, f"{flat[:2]}{98 - check(body, flat[:2]):02d}{body}", lambda c: c != " ")


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _day(y: str, mo: str, d: str) -> int | None:
    try:
        day = datetime.date(int(y), int(mo), int(d)).toordinal()
    except ValueError:
        return None
    return day - FIRST_DAY if FIRST_DAY <= day <= LAST_DAY else None


def _date(m: re.Match, key: bytes) -> str | None:
    """A real day of 1900 to 2099; pseudonyms are days of those years in the same layout.

    With the year last, day and month are taken before month and day. Layouts share no text, so that different dates
    never collide: month and day is left with the days above 12, and the widths and leading zeros of the parts stay.
    """
    g, size = m.groupdict(), LAST_DAY - FIRST_DAY + 1
    if g["y"]:
        if (day := _day(g["y"], g["m"], g["d"])) is None:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permute(day, size, key, "date"))
        return f"{new.year:04d}{g['s']}{new.month:02d}{g['s']}{new.day:02d}"
    a, b, sep = g["d2"], g["m2"], g["s2"]
    day, month_first = _day(g["y2"], b, a), False
    if day is None:
        day, month_first = _day(g["y2"], a, b), True
    if day is None:
        return None
    padded = len(a) == len(b) == 2
    layout = "" if padded else "".join("1" if len(x) == 1 else "0" if x[0] == "0" else "2" for x in (a, b))
    fits = lambda new, old: padded or (new < 10 and len(old) == 1) or (len(old) == 2 and (new < 10) == (old[0] == "0"))

    def parts(n: int) -> tuple[int, int, int]:
        x = datetime.date.fromordinal(FIRST_DAY + n)
        return (x.month, x.day, x.year) if month_first else (x.day, x.month, x.year)

    def valid(n: int) -> bool:
        one, two, _ = parts(n)
        return fits(one, a) and fits(two, b) and (not month_first or two > 12)

    tweak = "date" + ":mdy" * month_first + f":{layout}" * bool(layout)
    one, two, year = parts(permute(day, size, key, tweak, valid if month_first or layout else lambda _: True))
    return f"{one:0{len(a)}d}{sep}{two:0{len(b)}d}{sep}{year:04d}"


def _ssn(m: re.Match, key: bytes) -> str | None:
    ok = lambda n: 1 <= n // 1_000_000 < 900 and n // 1_000_000 != 666 and n // 10_000 % 100 > 0 and n % 10_000 > 0
    n = int(m.group().replace("-", ""))
    return put(m.group(), f"{permute(n, 10**9, key, 'ssn', ok):09d}") if ok(n) else None


def _cards(m: re.Match, key: bytes) -> Spans:
    """Four groups of four before what the pattern took, and where neither check digit is right, four later groups.

    Numbers with a wrong check digit come last, in the same order.
    """
    text, a = m.group(), m.start()
    spans = [(0, len(text))]
    if [len(g) for g in re.split("[ -]", text)][:4] == [4] * 4:
        spans = [(0, 19), *spans] if len(text) > 19 else spans
        later = [(5, 24)] if len(text) == 24 else []
    else:
        later = []
    right = lambda i, j: luhn("".join(c for c in text[i:j] if c.isdigit()))
    wrong = [] if later else spans  # 20 digits are no card
    found = [("card", i, j) for i, j in [*spans, *later] if right(i, j)] + [("card_like", i, j) for i, j in wrong if not right(i, j) and (not text[i:j].isdigit() or ISSUERS.fullmatch(text[i:j]))]
    for kind, i, j in found:
        if (new := _card(text[i:j], key)) is not None:
            yield kind, a + i, a + j, new


def _card(text: str, key: bytes) -> str | None:
    """13 to 19 digits: the first stays; where the check digit is right, the pseudonym's is, else it is not."""
    digits = "".join(c for c in text if c.isdigit())
    if not 13 <= len(digits) <= 19:
        return None
    first, rest, right = digits[0], digits[1:], luhn(digits)
    width = len(rest)
    n = permute(int(rest), 10**width, key, f"card:{first}:{right}", lambda x: luhn(f"{first}{x:0{width}d}") == right)
    return put(text, f"{first}{n:0{width}d}")


#: Calling codes of two digits (fixed values); 1 and 7 have one, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _calling_code(digits: str) -> str:
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3]


def _phone(m: re.Match, key: bytes) -> str | None:
    """The country code (with +), a trunk prefix (0) and the layout stay. The number in its country decides, so that all layouts of it link; ten digits without a code are a number of +1."""
    text = m.group()
    digits = "".join(c for c in text.replace("(0)", "") if c.isdigit())
    code = _calling_code(digits) if text[0] == "+" else ""
    number = digits[len(code) :]
    if not 7 <= len(number) <= 14:
        return None
    n = permute(int(number), 10 ** len(number), key, f"phone:{code or ('1' if len(number) == 10 else '')}:{len(number)}")
    at = text.find("(0)")
    slots = text if at < 0 else text[:at] + "(\0)" + text[at + 3 :]
    return put(slots, code + f"{n:0{len(number)}d}").replace("(\0)", "(0)")


#: First digits and lengths of card numbers by issuer (fixed values).
ISSUERS = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}|3[47][0-9]{13}|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12,15}|(?:36|38|30[0-5])[0-9]{11,17}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|(?:50|5[6-9]|6[0-9])[0-9]{11,17}")


def whole(kind: str, make: Callable[[re.Match, bytes], str | None]) -> Callable[[re.Match, bytes], Spans]:
    """All that the pattern took, or nothing."""
    return lambda m, key: ((kind, m.start(), m.end(), new) for new in (make(m, key),) if new is not None)


#: In order of precedence: the family, its pattern, and for a match the valid spans, the best first.
FAMILIES: list[tuple[str, str, Callable[[re.Match, bytes], Spans]]] = [
    ("email", r"(?<![A-Za-z0-9._%+-])[._%+-]*+([A-Za-z0-9][A-Za-z0-9._%+-]*+)(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", _email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _ibans),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", whole("ip", _ip)),
    ("date", r"(?<![0-9./-])(?:(?P<y>[0-9]{4})(?P<s>[-/.])(?P<m>[0-9]{2})(?P=s)(?P<d>[0-9]{2})|(?P<d2>[0-9]{2}|(?<!\+)[0-9])(?P<s2>[-/.])(?P<m2>[0-9]{1,2})(?P=s2)(?P<y2>[0-9]{4}))(?![0-9]|[./-][0-9])", whole("date", _date)),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])", whole("ssn", _ssn)),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])", whole("phone", _phone)),
    ("card", r"(?<![0-9A-Za-z+])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?)(?![0-9A-Za-z])", _cards),
    ("phone", r"(?<![0-9A-Za-z])(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])", whole("phone", _phone)),
]
KINDS = ["email", "iban", "ip", "date", "ssn", "card", "card_like", "phone"]
DIGIT_RUN = re.compile(r"[0-9][0-9 .()/-]{4,}[0-9]|[A-Z]{2}[0-9]{2}")


class Pseudonymiser:
    """``key``: any bytes but none; all of it counts, whatever its length."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.blake2b(key).digest()
        self.families = [(family, re.compile(pattern, re.A), spans) for family, pattern, spans in FAMILIES]

    def apply(self, text: str) -> tuple[str, list[tuple[int, str, int]]]:
        """The new text, and the spans (start, kind, end) of the old one that were replaced."""
        with_at, with_digits = "@" in text, DIGIT_RUN.search(text) is not None
        taken: list[tuple[int, str, int, str]] = []
        for family, pattern, spans in self.families:
            if not (with_at if family == "email" else with_digits):
                continue
            pos, found = 0, []
            while m := pattern.search(text, pos):
                pos = m.start() + 1 if family == "iban" else m.end()  # a wrong IBAN may have swallowed a right one
                for kind, a, b, new in spans(m, self.key):
                    at = bisect(taken, (a, "~"))
                    if (not at or taken[at - 1][2] <= a) and (at == len(taken) or b <= taken[at][0]):
                        found.append((a, kind, b, new))
                        pos = b
                        break
            taken = sorted(taken + found)
        out, at = [], 0
        for a, _, b, new in taken:
            out += [text[at:a], new]
            at = b
        out.append(text[at:])
        return "".join(out), [(a, kind, b) for a, kind, b, _ in taken]


@lru_cache(maxsize=2)
def pseudonymiser(key: bytes) -> Pseudonymiser:
    return Pseudonymiser(key)


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with ``text_col`` pseudonymised, and ``pii``: array of (kind, start, end) in the old text.

    A null text stays null with no spans, an empty one empty; an empty table gives an empty one. Lengths change only
    where an IP address is written longer or shorter. Very long texts and values take time linear in their length.
    Repeated rows give equal results. A column ``pii`` in ``df`` is replaced, others stay. No key: ValueError. A map over the scan.
    """
    pseudonymiser(key)
    own = [c for c in df.columns if c != "pii"]
    at = own.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pseudonymiser(key)
        for batch in batches:
            found = [p.apply(t) if t is not None else (None, []) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in s] for _, s in found], kind)]
            columns[at] = pa.array([t for t, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "pii"])

    part = df.select(*own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
    return map_arrow(part, run, f"{schema}, pii array<struct<kind:string,start:bigint,end:bigint>>")


def key_of(spark: SparkSession, test: bool = False) -> bytes:
    """The key that KEY_SETTING names; where there is none, ValueError, or the public TEST_KEY with a warning if ``test`` asks for it."""
    if key := spark.conf.get(KEY_SETTING, ""):
        return key.encode()
    if not test:
        raise ValueError(f"{KEY_SETTING} is not set")
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms by the public test key can be undone by anyone", stacklevel=2)
    return TEST_KEY


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by pseudonyms, with counts and spans. Without a key in the session this is a trial with the test key."""
    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key_of(spark, test=True))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        F.size("pii").cast("long").alias("n_pii"),
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",").alias("spans"),
        "text",
    )
