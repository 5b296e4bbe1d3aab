"""Check digits and term lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import checks
from cloakframe.functions.detect import CHECKED_RULES, ENTITY_ELEMENTS, TextConfig
from cloakframe.operators import text as tx

RIGHT = {
    "luhn": ["4111 1111 1111 1111", "5500000000000004", "6011-0009-9013-9424"],
    "mod97": ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"],
    "verhoeff": ["2363", "1428570"],
    "weighted11": ["943 476 5919", "401 023 2137"],
    "mod36": ["27AAPFU0939F1ZV", "29AAGCB7383J1Z4"],
    "base58check": ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "1111111111111111111114oLvT2"],
}


@pytest.mark.parametrize("name", sorted(RIGHT))
def test_known_numbers_and_single_errors(name):
    """Published examples pass, and no other character at any one place does."""
    check = checks.CHECKS[name]
    alphabet = {"mod36": checks.BASE36, "base58check": checks.BASE58}.get(name, "0123456789")
    for number in RIGHT[name]:
        assert check(number)
        for i, c in enumerate(number):
            if c in alphabet:
                wrong = [number[:i] + x + number[i + 1 :] for x in alphabet if x != c]
                assert not any(map(check, wrong)) or name == "weighted11" and i == len(number) - 1


@pytest.mark.parametrize(("name", "form"), [("rrn", "{:06d}-1{:06d}"), ("tnin", "1-{0:04d}-{1:05d}-{2:02d}-")])
def test_one_check_digit_in_ten_is_right(name, form):
    pick, check = random.Random(1), checks.CHECKS[name]
    for _ in range(50):
        number = form.format(pick.randrange(10**4), pick.randrange(10**5), pick.randrange(100))
        stem = number[:-1] if name == "rrn" else number
        assert sum(check(stem + str(d)) for d in range(10)) == 1


def test_verhoeff_finds_swaps():
    number = "1428570"
    assert not any(checks.verhoeff(number[:i] + number[i + 1] + number[i] + number[i + 2 :]) for i in range(6) if number[i] != number[i + 1])


def test_other_checks():
    assert checks.octets("255.0.10.1") and not checks.octets("256.0.10.1") and not checks.octets("999.999.999.999")
    assert checks.issued_ssn("123-45-6789") and not any(map(checks.issued_ssn, ("000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000")))
    assert checks.calendar("2024-02-29") and checks.calendar("2024-02-29T23:59") and not checks.calendar("2023-02-29") and not checks.calendar("2024-01-01 24:00")


def test_terms_equal_their_patterns():
    """One pass of the automaton finds what each list's pattern finds, whatever touches or overlaps."""
    finders = tx._finders(TextConfig(rules=CHECKED_RULES, threshold=0.3))
    pick = random.Random(2)
    terms = [t for f in finders for t in f[5]]
    for _ in range(300):
        text = "".join(pick.choice([pick.choice(terms), " ", " ", "_", "é", ",", "New", "s", "1", "York "]) for _ in range(30))
        listed = tx._terms(tuple((i, f[5]) for i, f in enumerate(finders) if f[5])).find(text)
        for i, f in enumerate(finders):
            if f[5]:
                assert listed.get(i, []) == [m.span() for m in f[1].finditer(text)], (f[0], text)


def test_entities_found_and_wrong_numbers_left(spark):
    texts = {
        "CREDIT_CARD": "4111 1111 1111 1111", "IP_ADDRESS": "10.0.0.255", "SOCIAL_SECURITY_ID": "123-45-6789", "BANK_ACCOUNT": "DE89370400440532013000",
        "CRYPTO_ADDRESS": "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "NATIONAL_ID": "2341 2341 2346", "HEALTH_CARE_ID": "943 476 5919", "IN_GSTIN": "27AAPFU0939F1ZV",
        "KR_RRN": "900101-1234568", "TH_TNIN": next(f"1-1017-00203-45-{d}" for d in range(10) if checks.tnin(f"1-1017-00203-45-{d}")), "IN_VOTER": "ABC1234567", "IN_VEHICLE_REGISTRATION": "MH 12 AB 1234", "TAX_ID": "12-3456789",
        "PASSPORT": "passport no. A1234567", "MAC_ADDRESS": "00:1B:44:11:3A:B7", "DATETIME": "2024-02-29T10:15", "DOB": "born on 1980-01-31", "AMOUNT": "$1,250.00",
        "CURRENCY_SYMBOL": "€", "AGE": "42 years old", "USERNAME": "username=ana_x", "ORGANIZATION": "Blue River Ltd", "PERSON": "Dr. Ada Lovelace",
        "CURRENCY_CODE": "USD", "CURRENCY_NAME": "rupees", "GENDER": "female", "TITLE": "Prof", "LOCATION": "New Zealand", "EMAIL_ADDRESS": "a.b@example.org",
        "URL": "www.example.com", "PHONE_NUMBER": "+1 (555) 123-4567", "ACCOUNT_NUMBER": "123-4567", "PASSWORD": 'password = "x1"', "DRIVER_LICENSE": "1234567",
    }
    config = TextConfig(rules=CHECKED_RULES, threshold=0.3)
    assert set(texts) == {r.entity for r in CHECKED_RULES} <= set(ENTITY_ELEMENTS) and len(texts) == 34
    rows = spark.createDataFrame([(e, f"see {t}, so") for e, t in texts.items()] + [("", None), ("", "")], "kind string, text string")
    found = {(r.kind, r.entity, r.start_index, r.end_index) for r in tx.find_spans(rows, "kind", "text", config).collect()}
    assert {(e, e, 4, 4 + len(t)) for e, t in texts.items()} <= found
    wrong = ["4111 1111 1111 1112", "999.999.999.999", "DE88370400440532013000", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "2341 2341 2347", "943 476 5918", "27AAPFU0939F1ZW", "900101-1234569", "2023-02-29"]
    left = tx.find_spans(spark.createDataFrame([(w,) for w in wrong], "text string"), "text", "text", config)
    assert left.where(~F.col("entity").isin("DRIVER_LICENSE", "IN_VOTER")).collect() == []
    shown = spark.createDataFrame([("call Dr. Ada Lovelace in Paris",)], "text string").select(tx.redact("text", TextConfig(rules=CHECKED_RULES, method="mask")))
    assert re.fullmatch(r"call #{16} in #{5}", shown.first()[0])
