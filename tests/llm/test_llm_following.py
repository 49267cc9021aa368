"""A valid value is replaced, and alike, whatever follows it."""

import pytest

from bidmatrix.llm import pii

VALUES = {
    "ES": "ES91 2100 0418 4502 0005 1332", "BE": "BE68 5390 0754 7034", "AT": "AT61 1904 3002 3457 3201",
    "NO": "NO93 8601 1117 947", "FR": "FR14 2004 1010 0505 0001 3M02 606", "GB": "GB82WEST12345698765432",
    "phone de": "+49 1512 3456789", "phone es": "+34 612 345 678", "phone us": "+1 (212) 555-7713", "phone br": "+1 212-555-7713",
    "phone other": "+999 123 4567", "phone fr": "+33 6 12 34 56 78",
    "card": "4111 1111 1111 1111", "amex": "3782 822463 10005", "ssn": "123-45-6789", "date": "2024-01-31", "ip": "97.51.17.173",
    "mail": "ci.34@mail7.example.com", "token": "9233a8ecf7c5b09fe5949719b6b82bc439e9329b",
}
#: What follows, and how many values it holds itself.
AFTER = [("BIC: CAIXESBB", 0), ("VAT 12", 0), ("ON", 0), ("and more", 0), ("7a@b.org", 1)] + [(v, 1) for v in VALUES.values()]
#: A number without a kind of its own; codes that are not listed cannot tell a year from a group of digits.
NUMBERS = ("2024", "12", "123")


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n_found"]) for r in pii.pseudonymise(docs).orderBy("doc_id").collect()]


def test_every_kind_before_every_other(spark):
    names = list(VALUES)
    alone = dict(zip(names, replaced(spark, [VALUES[k] for k in names])))
    assert all(n == 1 and new != VALUES[k] for k, (new, n) in alone.items())
    cases = [(k, after, 1 + n) for k in names for after, n in AFTER]
    cases += [(k, after, 1) for k in names if k != "phone other" for after in NUMBERS]
    out = replaced(spark, [f"{VALUES[k]} {after}" for k, after, _ in cases])
    wrong = [(k, after, new, n) for (k, after, want), (new, n) in zip(cases, out) if n != want or not new.startswith(f"{alone[k][0]} ")]
    assert wrong == []


@pytest.mark.parametrize("text", ("ES91 2100 0418 4502 0005 1333 BIC", "+49 12 4111", "AB12 3456 7890 1234 5678"))
def test_invalid_values_stay(spark, text):
    assert replaced(spark, [text]) == [(text, 0)]
