"""Format-preserving pseudonyms of personal numbers, dates and addresses, as column functions only.

Candidates are cut out of a text by one expression, and each is checked: Luhn digit of card numbers, mod-97
of IBANs, ranges of IP octets, parts of social security numbers, calendar of dates. What does not check out
stays as it is. A valid number's digits go through a keyed Feistel permutation of all numbers of that length
and come back into its own layout, with its check digits worked out again; a date is permuted among the days
of its 400 years; an address (mail, secret token) is replaced by a keyed digest in its layout. The same
value gives the same pseudonym everywhere, two values never share one (digests aside), and without the key
the way back is closed.

Cases: null and empty texts stay. Repeated rows are treated alike. Very long texts are treated whole, row by
row. Overlapping candidates count from the left; an IBAN's length follows from its country, a phone number's
from its calling code where that is listed, so neither takes in what follows it. In a run of blocks of four
digits, any four neighbours that check out are a card. An empty table gives an empty result. Columns of the input
named n_found are replaced; all others pass through.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


@dataclass(frozen=True)
class Key:
    secret: str = "replace-in-production"


#: Lengths of IBANs by country, the registry's and those in use beside it.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
#: Most digits of a number after a country's calling code.
PHONE_DIGITS = {
    7: "354", 8: "45 47 65 386 852", 9: "27 31 32 33 34 36 40 41 48 51 56 61 66 94 351 353 380 385 420 421 886 971 972",
    10: "1 7 20 30 44 46 52 57 60 63 64 81 84 90 91 92 98", 11: "39 49 54 55 82 86 352", 12: "62 358", 13: "43",
}


def _iban(length: int, countries: str) -> str:
    """An IBAN of one length, in groups of four or without."""
    fours, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


# candidates: fixed expressions, tried in this order at each place

_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_IBAN_LISTED = "|".join(_iban(n, c) for n, c in IBAN_COUNTRIES.items())
_IBAN_OTHER = f"(?!{'|'.join(IBAN_COUNTRIES.values()).replace(' ', '|')})" + "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"  # in one piece
_IBAN = rf"(?<![\p{{L}}\p{{N}}])(?:{_IBAN_LISTED}|{_IBAN_OTHER})(?![\p{{L}}\p{{N}}])"
_TOKEN = r"(?<![\p{L}\p{N}])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_YMD = r"(?<![0-9])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])"
_DMY = r"(?<![0-9])[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# a phone number ends where another kind begins after a blank, and with a group of digits
_OTHER_KIND = (
    r"(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9]{13,19}(?![0-9])"
    r"|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
    r"|[0-9A-Fa-f]{32}|[\p{L}\p{N}._%+-]++@"
)
_GAP = rf"(?: (?!{_OTHER_KIND})|[.-])?"
_PHONE_LISTED = "|".join(
    f"(?:{codes.replace(' ', '|')})(?:[ .-]?[0-9]){{7}}(?:{_GAP}[0-9]){{0,{most - 7}}}(?![0-9])" for most, codes in PHONE_DIGITS.items()
)
_PHONE = (
    rf"(?<![\p{{L}}\p{{N}}])(?:\+[0-9]{{1,3}}[ .-]?)?\([0-9]{{2,4}}\)[ .-]?[0-9]{{3,4}}{_GAP}[0-9]{{3,4}}(?![0-9])"
    rf"|(?<![\p{{L}}\p{{N}}])\+(?:{_PHONE_LISTED}|[0-9]{{1,3}}(?:[ .-]?[0-9]){{4}}(?:{_GAP}[0-9]){{0,10}}(?![0-9]))"
    r"|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
)
# blocks of four digits are taken as a whole run, in which any four neighbours may be a card
_BLOCK = (
    r"(?![0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])"
    r"|[0-9A-Fa-f]{32}|[\p{L}\p{N}._%+-]++@)[0-9]{4}(?![0-9])"
)
_CARD = (
    rf"(?<![0-9])(?:[0-9]{{13,19}}(?![0-9])|{_BLOCK}([ -]){_BLOCK}(?:\3{_BLOCK}){{2,}}|[0-9]{{4}}([ -])[0-9]{{6}}\4[0-9]{{5}}(?![0-9]))"
)
#: Calling codes by their number of digits: all that are not listed here have three.
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CANDIDATE = "|".join((_MAIL, _IBAN, _TOKEN, _IP, _YMD, _DMY, _SSN, _PHONE, _CARD))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def big(value: Column) -> Column:
    return value.cast("bigint")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: Key, kind: Column | str) -> Column:
    """The pair (left, right), permuted among all pairs below the sizes: struct of left and right."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def noise(i: Column, half: Column) -> Column:
        told = F.concat_ws("|", F.lit(key.secret), kind, left_size.cast("string"), right_size.cast("string"), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("bigint")

    def turn(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0,
            F.struct(((acc["left"] + noise(i, acc["right"]) % left_size) % left_size).alias("left"), acc["right"].alias("right")),
        ).otherwise(
            F.struct(acc["left"].alias("left"), ((acc["right"] + noise(i, acc["left"]) % right_size) % right_size).alias("right"))
        )

    start = F.struct(big(left).alias("left"), big(right).alias("right"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)


def ten_to(n: Column) -> Column:
    """10**n exactly, for n up to 18."""
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(number: Column, key: Key, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among all of its length."""
    half = F.floor(F.length(number) / 2).cast("int")
    rest = (F.length(number) - half).cast("int")
    mixed = feistel(F.substring(number, F.lit(1), half), F.substring(number, half + 1, rest), ten_to(half), ten_to(rest), key, kind)
    return let(mixed, lambda m: F.concat(F.lpad(m["left"].cast("string"), half, "0"), F.lpad(m["right"].cast("string"), rest, "0")))


def refill(layout: Column, number: Column) -> Column:
    """layout with its digits replaced, in order, by those of number."""
    step = lambda acc, c: F.when(
        F.rlike(c, F.lit("^[0-9]$")),
        F.struct(F.concat(acc["out"], F.substring(number, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at")),
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(layout, ""), start, step)["out"]


# checks and pseudonyms by kind

def luhn_sum(number: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""
    doubled = F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])

    def step(acc: Column, i: Column) -> Column:
        digit = F.substring(number, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.get(doubled, digit)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step)


def card(value: Column, key: Key) -> Column:
    def of(number: Column) -> Column:
        payload = F.substring(number, F.lit(1), F.length(number) - 1)
        sealed = lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))
        fresh = let(permute_digits(payload, key, "card"), sealed)
        return F.when(luhn_sum(number) % 10 == 0, refill(value, fresh))

    return let(digits(value), of)


def mod97(compact: Column) -> Column:
    """An IBAN's characters from the fifth on, then its first four, as a number modulo 97."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, (acc * 100 + letter) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def iban(value: Column, key: Key) -> Column:
    def of(compact: Column) -> Column:
        body = F.substring(compact, F.lit(5), F.length(compact))
        fresh = F.when(F.length(digits(body)) >= 2, refill(body, permute_digits(digits(body), key, "iban"))).otherwise(body)
        country = F.substring(compact, F.lit(1), F.lit(2))
        check = lambda b: F.lpad((98 - mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0")
        whole = let(fresh, lambda b: digits(F.concat(check(b), b)))
        return F.when((mod97(compact) == 1) & F.length(compact).between(15, 34), refill(value, whole))

    return let(F.regexp_replace(value, " ", ""), of)


def ip(value: Column, key: Key) -> Column:
    def of(octets: Column) -> Column:
        at = lambda i: F.get(octets, F.lit(i))
        mixed = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), key, "ip")
        parts = lambda m: F.concat_ws(".", *[x.cast("string") for h in ("left", "right") for x in (F.floor(m[h] / 256), m[h] % 256)])
        return F.when(F.forall(octets, lambda o: o <= 255), let(mixed, parts))

    return let(F.transform(F.split(value, r"\."), lambda o: o.cast("int")), of)


#: Days of 400 years of the calendar, as a product, and a day on which such a span starts.
_CYCLE, _ONE, _OTHER, _EPOCH = 146097, 189, 773, "1800-01-01"


def permute_day(day: Column, key: Key) -> Column:
    """A date, permuted among the 400 years from 1800 (or the 400 before, or after, and so on)."""
    since = F.datediff(day, F.lit(_EPOCH).cast("date"))
    inside = F.pmod(since, F.lit(_CYCLE))
    mixed = feistel(F.floor(inside / _OTHER), inside % _OTHER, F.lit(_ONE), F.lit(_OTHER), key, "date")
    moved = let(mixed, lambda m: m["left"] * _OTHER + m["right"])
    return F.date_add(F.lit(_EPOCH).cast("date"), (moved + since - inside).cast("int"))


def date(value: Column, key: Key) -> Column:
    """A date in any of three orders; two-digit parts come back with two digits."""
    sign = F.regexp_extract(value, "[-/.]", 0)

    def of(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i))
        real = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
        out = lambda pattern: lambda day: F.regexp_replace(F.date_format(permute_day(day, key), pattern), "-", sign)
        ymd, dmy, mdy = real(at(0), at(1), at(2)), real(at(2), at(1), at(0)), real(at(2), at(0), at(1))
        first_is_year = F.length(at(0)) == 4
        return (
            F.when(first_is_year & ymd.isNotNull(), let(ymd, out("yyyy-MM-dd")))
            .when(~first_is_year & dmy.isNotNull(), let(dmy, out("dd-MM-yyyy")))
            .when(~first_is_year & mdy.isNotNull(), let(mdy, out("MM-dd-yyyy")))
        )

    return let(F.split(value, "[-/.]"), of)


def ssn(value: Column, key: Key) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999: permuted among just those."""
    areas, serials = 898, 99 * 9999

    def of(parts: Column) -> Column:
        at = lambda i: F.get(parts, F.lit(i)).cast("int")
        valid = at(0).between(1, 899) & (at(0) != 666) & (at(1) >= 1) & (at(2) >= 1)
        place = at(0) - 1 - (at(0) > 666).cast("int")
        mixed = feistel(place, (at(1) - 1) * 9999 + at(2) - 1, F.lit(areas), F.lit(serials), key, "ssn")

        def written(m: Column) -> Column:
            area = m["left"] + 1 + (m["left"] + 1 >= 666).cast("int")
            group, serial = F.floor(m["right"] / 9999) + 1, m["right"] % 9999 + 1
            return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group, 2), (serial, 4))])

        return F.when(valid, let(mixed, written))

    return let(F.split(value, "-"), of)


def phone(value: Column, key: Key) -> Column:
    """The digits after the calling code, whatever the layout; a code that none can have counts up to its separator."""

    def behind(code: Column, number: Column) -> Column:
        rest = F.substring(number, F.length(code) + 1, F.length(number))
        return let(rest, lambda r: F.when(F.length(r).between(7, 14), refill(value, F.concat(code, permute_digits(r, key, "phone")))))

    def of(number: Column) -> Column:
        told = F.regexp_extract(value, r"^\+([0-9]{1,3})(?=[ .(-])", 1)
        code = F.when(F.startswith(value, F.lit("+")), F.regexp_extract(number, CALLING_CODE, 0)).otherwise("")
        return F.coalesce(let(code, lambda c: behind(c, number)), let(told, lambda c: behind(c, number)))

    return let(digits(value), of)


def card_run(value: Column, key: Key) -> Column:
    """A run of blocks of four digits with its cards replaced, from the left: struct of out (null: none) and n."""

    def of(blocks: Column) -> Column:
        sign, n_blocks = F.substring(value, 5, 1), F.size(blocks)

        def step(acc: Column, i: Column) -> Column:
            own = F.when(acc["skip"] == 0, card(F.array_join(F.slice(blocks, i, 4), " "), key))
            fresh = F.when(i + 3 <= n_blocks, own)
            return let(fresh, lambda new: F.struct(
                F.when(new.isNotNull(), F.concat(acc["parts"], F.array(F.translate(new, " ", "-"))))
                .when(acc["skip"] > 0, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.get(blocks, i - 1)))).alias("parts"),
                F.when(new.isNotNull(), 3).otherwise(F.greatest(acc["skip"] - 1, F.lit(0))).alias("skip"),
                (acc["n"] + new.isNotNull().cast("int")).alias("n"),
            ))

        start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("skip"), F.lit(0).alias("n"))
        done = F.aggregate(F.sequence(F.lit(1), n_blocks), start, step)
        return let(done, lambda d: F.struct(
            F.when(d["n"] > 0, F.replace(F.array_join(d["parts"], "-"), F.lit("-"), sign)).alias("out"), d["n"].alias("n")
        ))

    return let(F.split(value, "[ -]"), of)


def digest(value: Column, key: Key, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key.secret), F.lit(kind), F.lower(value)), 256)


def mail(value: Column, key: Key) -> Column:
    return let(digest(value, key, "mail"), lambda d: F.concat(F.lit("u"), F.substring(d, 1, 12), F.lit("@m"), F.substring(d, 13, 8), F.lit(".example.org")))


def token(value: Column, key: Key) -> Column:
    """Hex digits of the same number and case."""
    wide = let(digest(value, key, "token"), lambda d: F.substring(F.concat(d, F.reverse(d)), F.lit(1), F.length(value)))
    return F.when(F.rlike(value, F.lit("[a-f]")), wide).otherwise(F.upper(wide))


def pseudonym(value: Column, key: Key = Key()) -> Column:
    """Pseudonym of a candidate, or null if it is not valid."""
    looks = lambda pattern: F.rlike(value, F.lit(f"^(?:{pattern})$"))
    return (
        F.when(F.contains(value, F.lit("@")), mail(value, key))
        .when(looks(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"), F.coalesce(iban(value, key), F.when(looks("[0-9A-F]{32,}"), token(value, key))))
        .when(looks(r"[0-9A-Fa-f]{32,}") & F.rlike(value, F.lit("[A-Fa-f]")), token(value, key))
        .when(looks(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), ip(value, key))
        .when(looks(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}"), date(value, key))
        .when(looks(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), ssn(value, key))
        .when(looks(r"[+(].*|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"), phone(value, key))
        .otherwise(card(value, key))
    )


def replacement(value: Column, key: Key) -> Column:
    """Struct of out, a candidate's pseudonym (null if it is not valid), and n, how many values that replaces."""
    single = let(pseudonym(value, key), lambda new: F.struct(new.alias("out"), new.isNotNull().cast("int").alias("n")))
    return F.when(F.rlike(value, F.lit("^[0-9]{4}(?:[ -][0-9]{4}){4,}$")), card_run(value, key)).otherwise(single)


def pseudonymise(docs: DataFrame, key: Key = Key()) -> DataFrame:
    """docs with pseudonyms in their texts, and n_found, how many."""
    docs = docs.drop("n_found")
    candidate = F.lit(CANDIDATE)

    def replaced(found: Column) -> Column:
        fresh = F.transform(found, lambda m: replacement(m, key))
        between = F.split("text", CANDIDATE, -1)
        shown = lambda new: F.zip_with(new, found, lambda a, b: F.coalesce(a["out"], b))
        joined = lambda new: F.concat(
            F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), shown(new), lambda a, b: F.concat(a, b)), ""),
            F.element_at(between, -1),
        )
        return let(fresh, lambda new: F.struct(
            joined(new).alias("text"), F.aggregate(new, F.lit(0), lambda n, x: n + x["n"]).alias("n")
        ))

    # most texts hold neither a digit nor an at sign
    maybe = F.rlike("text", F.lit("[0-9@]"))
    found = F.when(maybe, F.regexp_extract_all("text", candidate, F.lit(0)))
    done = docs.withColumn("pii_found", found)
    done = done.withColumn("pii_done", F.when(F.size("pii_found") > 0, replaced(F.col("pii_found"))))
    out = [F.coalesce(F.col("pii_done.text"), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    n_chars = F.when(F.col("pii_done").isNotNull(), F.length("pii_done.text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    if n_chars is not None:
        out = [n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, out)]
    return done.select(*out, F.coalesce("pii_done.n", F.lit(0)).alias("n_found"))
