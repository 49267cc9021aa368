"""Pseudonyms against a plain program: same candidates, arithmetic by whole numbers, texts put together one by one."""

import hashlib
from datetime import date, timedelta

import regex
from llm_helpers import given

from bidmatrix.llm import pii

SECRET = pii.Key().secret


def feistel(left, right, a, b, kind):
    for i in range(pii.ROUNDS):
        half = right if i % 2 == 0 else left
        noise = int(hashlib.sha256(f"{SECRET}|{kind}|{a}|{b}|{i}|{half}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + noise % a) % a
        else:
            right = (right + noise % b) % b
    return left, right


def permuted(number, kind):
    half = len(number) // 2
    rest = len(number) - half
    left, right = feistel(int(number[:half]), int(number[half:]), 10**half, 10**rest, kind)
    return f"{left:0{half}d}{right:0{rest}d}"


def only_digits(s):
    return "".join(c for c in s if c in "0123456789")


def refill(layout, number):
    it = iter(number)
    return "".join(next(it) if c in "0123456789" else c for c in layout)


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10


def card(value):
    number = only_digits(value)
    if luhn(number):
        return None
    payload = permuted(number[:-1], "card")
    return refill(value, payload + str(-luhn(payload + "0") % 10))


def run(value):
    sign, blocks, out, n, i = value[4], value.replace("-", " ").split(" "), [], 0, 0
    while i < len(blocks):
        new = card(" ".join(blocks[i : i + 4])) if i + 4 <= len(blocks) else None
        out += [new.replace(" ", sign)] if new else [blocks[i]]
        n, i = n + bool(new), i + (4 if new else 1)
    return sign.join(out), n


def as_number(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))


def iban(value):
    compact = value.replace(" ", "")
    if as_number(compact) % 97 != 1 or not 15 <= len(compact) <= 34:
        return None
    body = compact[4:]
    if len(only_digits(body)) >= 2:
        body = refill(body, permuted(only_digits(body), "iban"))
    check = 98 - as_number(f"{compact[:2]}00{body}") % 97
    return refill(value, only_digits(f"{check:02d}{body}"))


def ip(value):
    a, b, c, d = map(int, value.split("."))
    if max(a, b, c, d) > 255:
        return None
    left, right = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def day(value):
    sign = regex.search("[-/.]", value).group()
    parts = value.split(sign)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            found = date(*[int(parts[i]) for i in order])
        except ValueError:
            continue
        epoch = date(1800, 1, 1)
        cycle, inside = divmod((found - epoch).days, 146097)
        left, right = feistel(inside // 773, inside % 773, 189, 773, "date")
        new = epoch + timedelta(days=left * 773 + right + cycle * 146097)
        named = (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")
        return sign.join(named[order.index(i)] for i in range(3))
    return None


def ssn(value):
    area, group, serial = map(int, value.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    left, right = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    area = left + 1 + (left + 1 >= 666)
    return f"{area:03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"


TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone(value):
    number = only_digits(value)
    width = 0 if value[0] != "+" else 1 if number[0] in "17" else 2 if number[:2] in TWO else 3
    told = regex.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
    for code in (width, len(told.group(1)) if told else 0):
        if 7 <= len(number) - code <= 14:
            return refill(value, number[:code] + permuted(number[code:], "phone"))
    return None


def digest(value, kind):
    return hashlib.sha256(f"{SECRET}|{kind}|{value.lower()}".encode()).hexdigest()


def token(value):
    wide = digest(value, "token")
    wide = (wide + wide[::-1])[: len(value)]
    return wide if regex.search("[a-f]", value) else wide.upper()


def one(value):
    """A candidate's text and how many values were replaced in it."""
    fits = lambda pattern: regex.fullmatch(pattern, value)
    if fits("[0-9]{4}([ -][0-9]{4}){4,}"):
        return run(value)
    if "@" in value:
        d = digest(value, "mail")
        new = f"u{d[:12]}@m{d[12:20]}.example.org"
    elif fits("[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"):
        new = iban(value) or (token(value) if fits("[0-9A-F]{32,}") else None)
    elif fits("[0-9A-Fa-f]{32,}") and regex.search("[A-Fa-f]", value):
        new = token(value)
    elif fits(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"):
        new = ip(value)
    elif fits(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}"):
        new = day(value)
    elif fits("[0-9]{3}-[0-9]{2}-[0-9]{4}"):
        new = ssn(value)
    elif fits(r"[+(].*|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"):
        new = phone(value)
    else:
        new = card(value)
    return (value, 0) if new is None else (new, 1)


def plain(text):
    out, n, at = [], 0, 0
    for m in regex.finditer(pii.CANDIDATE, text):
        new, k = one(m.group())
        out, n, at = out + [text[at : m.start()], new], n + k, m.end()
    return "".join(out) + text[at:], n


CARDS = ["4111 1111 1111 1111", "5500-0000-0000-0004", "3782 822463 10005"]
TEXTS = [
    "2024 4111 1111 1111 1111", "2024-2025-5500-0000-0000-0004", "4111 1111 1111 1111 4111 1111 1111 1111 2024", "1 2024 2025 2026 3782 822463 10005",
    "1234 5678 9012 3456 7890 1234", "2023 2024 4111 1111 1111 1111 5500 0000 0000 0004 12", "on 29/02/1984, 2/13/2001, 13/13/2001 and 2001-02-30",
    "666-12-3456 899-01-0001 900-01-0001", "+9 123 4567", "+35 1 912 345 678", "(0171) 555 1234", "212-555-7713", "255.255.255.255 256.1.1.1",
    "GB82WEST12345698765432 DE89 3704 0044 0532 0130 00", "mail A.b+c@Ex.org", "DEADBEEF" * 4 + "1", *CARDS,
    "4111 1111 1111 1111 2024-01-31", "2024 4111 1111 1111 1111 2024.a@b.org 2024 4111 1111 1111 1111abc",
]


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n_found"]) for r in pii.pseudonymise(docs).orderBy("doc_id").collect()]


def test_pseudonyms_against_a_plain_program(spark):
    texts = TEXTS + [r["text"] for r in given(spark, "documents").collect() if r["text"]]
    got = replaced(spark, texts)
    wrong = [(t[:200], g, plain(t)) for t, g in zip(texts, got) if g != plain(t)]
    assert wrong == [] and sum(n for _, n in got) > 20


def test_cards_behind_other_blocks_are_found(spark):
    alone = dict(zip(CARDS, (new for new, _ in replaced(spark, CARDS))))
    texts = [f"{before}{card[4]}{card}" for card in CARDS[:2] for before in ("2024", "2024 2025".replace(" ", card[4]), "0001")]
    assert [(new.endswith(alone[t[-19:]]), n) for t, (new, n) in zip(texts, replaced(spark, texts))] == [(True, 1)] * len(texts)


def test_phones_are_linked_whatever_their_layout(spark):
    codes = [c for listed in pii.PHONE_DIGITS.values() for c in listed.split()]
    most = {c: n for n, listed in pii.PHONE_DIGITS.items() for c in listed.split()}
    number = {c: "1512345678901"[: most[c]] for c in codes}
    spaced = replaced(spark, [f"+{c} {number[c][:3]} {number[c][3:]}" for c in codes])
    compact = replaced(spark, [f"+{c}{number[c]}" for c in codes])
    assert [only_digits(a) for a, _ in spaced] == [only_digits(b) for b, _ in compact]
    assert all(n == 1 and new.startswith(f"+{c} ") and only_digits(new) != c + number[c] for c, (new, n) in zip(codes, spaced))
