"""Pseudonyms against a second, plain way to find and to make them, and on values that once stopped the job."""

import hashlib
import random
import re
import string
import time

import pytest

from lodeweave.llm import pii
from lodeweave.llm import queries as Q

KEY = b"a key of tests"


def feistel(n, size, tweak, fits=lambda x: True):
    """The same permutation, written over lists of rounds."""
    key, bits = hashlib.blake2b(KEY).digest(), len(bin(size - 1)) - 2
    half = max(1, -(-bits // 2))
    width = -(-half // 8)
    salt = hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()
    while True:
        sides = [n // 2**half, n % 2**half]
        for i in range(8):
            h = hashlib.blake2b(sides[1].to_bytes(width, "big") + bytes([i]), key=key, salt=salt, digest_size=max(8, width)).digest()
            sides = [sides[1], sides[0] ^ (int.from_bytes(h, "big") % 2**half)]
        n = sides[0] * 2**half + sides[1]
        if n < size and fits(n):
            return n


def checks(digits):
    """Luhn, by table of doubled digits."""
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_card(rng, right):
    while True:
        old = (str(rng.randint(1, 9)) if right else "4") + "".join(rng.choices(string.digits, k=15))  # with a wrong check digit only an issuer's number counts
        if checks(old) == right:
            new = old[0] + f"{feistel(int(old[1:]), 10**15, f'card:{old[0]}:{right}', lambda x: checks(old[0] + f'{x:015d}') == right):015d}"
            return "card" if right else "card_like", old, new


def plain_iban(rng):
    cc, n = rng.choice([("DE", 18), ("FR", 23), ("BE", 12)])
    body = "".join(rng.choices(string.digits, k=n))
    full = lambda b: cc + f"{98 - int(b + ''.join(str(ord(c) - 55) for c in cc) + '00') % 97:02d}" + b
    return "iban", full(body), full(f"{feistel(int(body), 10**n, 'iban:' + '0' * n + cc):0{n}d}")


def plain_email(rng):
    local = rng.choice(string.ascii_lowercase) + "".join(rng.choices(string.ascii_letters + string.digits + "._+", k=rng.randint(0, 12)))
    digits, bases = [], []
    for c in local:
        for kind in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
            if c in kind:
                digits.append(kind.index(c))
                bases.append(kind)
    n, size = 0, 1
    for d, b in zip(digits, bases, strict=True):
        n, size = n * len(b) + d, size * len(b)
    shape = "".join("0" if c in string.digits else "a" if c in string.ascii_lowercase else "A" if c in string.ascii_uppercase else c for c in local)
    n, out = feistel(n, size, "email:" + shape), []
    for b in reversed(bases):
        out.append(b[n % len(b)])
        n //= len(b)
    return "email", local + "@x-1.example.org", "".join(out.pop() if c.isalnum() else c for c in local) + "@x-1.example.org"


def plain_ssn(rng):
    fits = lambda n: 0 < n // 10**6 < 900 and n // 10**6 != 666 and n // 10**4 % 100 and n % 10**4
    while not fits(n := rng.randrange(10**9)):
        pass
    show = lambda x: f"{x // 10**6:03d}-{x // 10**4 % 100:02d}-{x % 10**4:04d}"
    return "ssn", show(n), show(feistel(n, 10**9, "ssn", fits))


def plain_ip(rng):
    parts = [rng.randrange(256) for _ in range(4)]
    n = feistel(((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3], 2**32, "ip")
    return "ip", ".".join(map(str, parts)), ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def plain_phone(rng):
    a, b = f"{rng.randrange(200, 1000)}", f"{rng.randrange(1000, 10000)}"
    n = f"{feistel(int('487' + a + b), 10**10, 'phone:1:10'):010d}"
    return "phone", f"+1 (487) {a}-{b}", f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}"


def planted(seed):
    """A text, its planted values as (start, kind, end), and the text that must come out."""
    rng, old, new, spans, at = random.Random(seed), [], [], [], 0
    for _ in range(rng.randint(0, 12)):
        word = "".join(rng.choices("abcdeéß ", k=rng.randint(1, 20))) + rng.choice([" ", "\n", ": "])
        kind, a, b = rng.choice([lambda r: plain_card(r, True), lambda r: plain_card(r, False), plain_iban, plain_email, plain_ssn, plain_ip, plain_phone])(rng)
        spans.append((at + len(word), kind, at + len(word) + len(a)))
        old += [word, a, " ist "]
        new += [word, b, " ist "]
        at += len(word) + len(a) + 5
    return "".join(old), spans, "".join(new)


def test_planted_values_against_the_plain_way(spark):
    cases = [planted(i) for i in range(300)]
    got = pii.pseudonymise(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string"), KEY).collect()
    for r in got:
        old, spans, new = cases[r.doc_id]
        assert [(x.start, x.kind, x.end) for x in r.pii] == spans and r.text == new, old


@pytest.mark.parametrize("size", [2, 3, 10, 1000, 2**32, 26**9, 10**30, 26**48, 1 << 1200])
def test_permutations_have_an_inverse(size):
    rng, even = random.Random(size), lambda n: n % 2 == 0
    key = hashlib.blake2b(KEY).digest()
    for n in {0, size - 1, *(rng.randrange(size) for _ in range(20))}:
        assert pii.permute(pii.permute(n, size, key, "t"), size, key, "t", inverse=True) == n
        if even(n):
            x = pii.permute(n, size, key, "t", even)
            assert even(x) and pii.permute(x, size, key, "t", even, inverse=True) == n
    if size <= 1000:
        assert sorted(pii.permute(n, size, key, "t") for n in range(size)) == list(range(size))


@pytest.mark.parametrize("n", [1, 47, 48, 49, 96, 230, 1000])
def test_long_names_have_an_inverse(n):
    rng, key = random.Random(n), hashlib.blake2b(KEY).digest()
    text = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    new = pii.jumbled(text, key, "t")
    assert (new != text or n == 1) and pii.jumbled(new, key, "t", inverse=True) == text
    assert all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(text, new, strict=True))
    if n > pii.SEGMENT:  # one character changes all segments
        other = pii.jumbled(("b" if text[0] != "b" else "c") + text[1:], key, "t") if text[0].islower() else pii.jumbled(text[:-1] + ("0" if text[-1] != "0" else "1"), key, "t")
        assert all(new[i : i + 40] != other[i : i + 40] for i in range(0, n - 40, 48))


def test_rows_that_stopped_the_job(spark):
    long_name, digitless = "a" * 230 + "@x.org", "GB93ABCDEFAAAAAA, 12345678"
    texts = [long_name, "b" * 100_000 + "@x.org", digitless, "7" * 1_000_000, "1" + " . " * 300_000, "@" * 100_000, "a@b." + "1." * 100_000, "." * 100_000 + "a.b@x.org", "A1" * 200_000]
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    assert time.monotonic() - began < 60
    kinds = [[x.kind for x in got[i].pii] for i in range(len(texts))]
    assert kinds == [["email"], ["email"], ["iban"], [], [], [], [], ["email"], []]
    assert got[0].text != long_name and len(got[1].text) == 100_006 and got[1].text.endswith("@x.org")
    body = got[2].text[4:16]
    assert body.isalpha() and body != digitless[4:16] and int("".join(str(int(c, 36)) for c in body + got[2].text[:4])) % 97 == 1
    assert pii.Pseudonymiser(KEY).apply("..a.b@x.org")[1] == [(2, "email", 11)]


def test_many_values_take_time_in_proportion():
    p, text = pii.Pseudonymiser(KEY), " ".join(f"u{i}@x.org +1 (487) 555-{i % 9000 + 1000}" for i in range(60_000))
    began = time.monotonic()
    assert len(p.apply(text)[1]) == 120_000 and time.monotonic() - began < 60


def test_the_whole_key_counts(spark):
    a, b = pii.Pseudonymiser(b"k" * 64 + b"1"), pii.Pseudonymiser(b"k" * 64 + b"2")
    assert a.apply("x@y.org")[0] != b.apply("x@y.org")[0] != pii.Pseudonymiser(b"k" * 64).apply("x@y.org")[0]
    with pytest.raises(ValueError):
        pii.Pseudonymiser(b"")
    with pytest.raises(ValueError):
        pii.key_of(spark)


def test_query_says_that_the_key_is_public(spark, small):
    with pytest.warns(UserWarning, match="test key"):
        Q.QUERIES["op6_pii"](spark, small)
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        p = pii.Pseudonymiser(b"own")
        assert pii.key_of(spark) == b"own"
        for r in Q.QUERIES["op6_pii"](spark, small).limit(50).collect():
            assert r.n_pii == len(r.spans.split(",")) if r.spans else r.n_pii == 0
            assert p is not None
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_phones_link_in_all_layouts():
    """The country code stays, and every layout of a number gets the digits of the same pseudonym."""
    p = pii.Pseudonymiser(b"key")
    digits = lambda t: re.sub(r"\D", "", t.replace("(0)", ""))
    for code, layouts in {
        "49": ["+4930123456789", "+49 30 123456789", "+49 (0)30 123456789", "+49-30-1234-56789", "+49.30.123456789"],
        "1": ["+14155552671", "+1 415 555 2671", "+1 (415) 555-2671", "+1-415-555-2671"],
        "353": ["+353861234567", "+353 86 123 4567"],
        "7": ["+79161234567", "+7 916 123 45 67"],
    }.items():
        seen = set()
        for text in layouts:
            new, spans = p.apply(f"call {text} now")
            assert [(kind, f"call {text} now"[a:b]) for a, kind, b in spans] == [("phone", text)], text
            got = new[5:-4]
            assert got.startswith("+" + code) and re.sub(r"\d", "9", got) == re.sub(r"\d", "9", text) and got != text
            seen.add(digits(got))
        assert len(seen) == 1, seen
    assert digits(p.apply("(415) 555-2671")[0]) == digits(p.apply("415-555-2671")[0]) == digits(p.apply("+14155552671")[0])[1:]
    assert p.apply("+49 3012 3456 7890 1")[1][0][1] == "phone"


def test_plain_numbers_are_no_cards():
    p = pii.Pseudonymiser(b"key")
    for text in ("9783161484101", "1700000000001", "1234567890123456", "0000000000000001"):  # a book, a time, counters
        assert p.apply(text)[0] == text or p.apply(text)[1][0][1] == "card"
    assert p.apply("1700000000000")[0] == "1700000000000"
    assert p.apply("4111111111111112")[1][0][1] == "card_like" and p.apply("4111111111111111")[1][0][1] == "card"
