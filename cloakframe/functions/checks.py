"""Check digits and other tests that a candidate must pass before it counts as an identifier.

Each check reads its candidate once, from one end to the other, as a small automaton whose state is a number: the sum,
remainder or group element so far.  Punctuation between digits is skipped.  They run on the few candidates that a pattern
has found, in the task that found them."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable

# --- fixed values: published check-digit schemes -------------------------------------------------------
VERHOEFF_TURN = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)  # the permutation applied once more at each place
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
# ------------------------------------------------------------------------------------------------------


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def luhn(text: str) -> bool:
    """Payment cards: from the right every second digit doubled, its digits summed; the sum ends in 0."""
    total = 0
    for place, digit in enumerate(reversed(_digits(text))):
        twice = digit * 2
        total += (twice - 9 if twice > 9 else twice) if place % 2 else digit
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Bank accounts (IBAN): country and check digits moved behind, letters as 10 to 35, remainder 1."""
    rest = 0
    for c in text[4:] + text[:4]:
        value = BASE36.index(c)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def dihedral(a: int, b: int) -> int:
    """Product in the group of the pentagon's turns (0-4) and flips (5-9)."""
    if a < 5:
        return (a + b) % 5 if b < 5 else (a + b) % 5 + 5
    return (a - b) % 5 + 5 if b < 5 else (a - b) % 5


def verhoeff(text: str) -> bool:
    """National identity numbers: digits from the right, turned once more at each place, multiply to the unit."""
    state = 0
    for place, digit in enumerate(reversed(_digits(text))):
        for _ in range(place % 8):
            digit = VERHOEFF_TURN[digit]
        state = dihedral(state, digit)
    return state == 0


def weighted11(text: str) -> bool:
    """Health numbers of ten digits: weights 10 to 2, the last digit is 11 minus the remainder by 11 (11 counts as 0)."""
    digits = _digits(text)
    return (11 - sum(d * (10 - i) for i, d in enumerate(digits[:9])) % 11) % 11 == digits[9]


def rrn(text: str) -> bool:
    """Resident registration numbers of thirteen digits."""
    digits = _digits(text)
    return (11 - sum(d * w for d, w in zip(digits, RRN_WEIGHTS)) % 11) % 10 == digits[12]


def tnin(text: str) -> bool:
    """Thirteen-digit national numbers: weights 13 to 2."""
    digits = _digits(text)
    return (11 - sum(d * (13 - i) for i, d in enumerate(digits[:12])) % 11) % 10 == digits[12]


def mod36(text: str) -> bool:
    """Goods-and-services tax numbers: characters in base 36, every second doubled, digits in base 36 summed."""
    total = 0
    for place, c in enumerate(text[:-1]):
        value = BASE36.index(c) * (1 + place % 2)
        total += value // 36 + value % 36
    return BASE36[-total % 36] == text[-1]


def base58check(text: str) -> bool:
    """Cryptocurrency addresses: 25 bytes, the last four of which begin the double SHA-256 of the others."""
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    if value >> 200 or len(text) - len(text.lstrip("1")) != 25 - (value.bit_length() + 7) // 8:
        return False
    raw = value.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def octets(text: str) -> bool:
    return all(int(x) < 256 for x in text.split("."))


def issued_ssn(text: str) -> bool:
    """Areas 000, 666 and 900 on, group 00 and serial 0000 are never issued."""
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def calendar(text: str) -> bool:
    """A day of the calendar, and a time of the day if there is one."""
    try:
        datetime.datetime.fromisoformat(text)
    except ValueError:
        return False
    return True


CHECKS: dict[str, Callable[[str], bool]] = {
    f.__name__: f for f in (luhn, mod97, verhoeff, weighted11, rrn, tnin, mod36, base58check, octets, issued_ssn, calendar)
}
