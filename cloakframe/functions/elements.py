"""Data elements: which characters of a value are transformed, and how many are needed."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import lru_cache

# --- fixed values: alphabets must match for tokens to match; a digit's value is its index -------------
DIGITS = string.digits
LOWER = string.ascii_lowercase
UPPER = string.ascii_uppercase

ALPHABETS = {
    "ssn": DIGITS,
    "email": DIGITS + LOWER + "._-+",
    "name": LOWER + UPPER,
    "phone": DIGITS,
    "ccn": DIGITS,
    "alnum": DIGITS + LOWER + UPPER,
    "digits": DIGITS,
}

DEFAULT_ELEMENT = "ssn"  # used when neither the row nor the call names an element
DOMAIN_FLOOR = 1_000_000  # FF3-1: radix ** length must reach this
# ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Element:
    name: str
    alphabet: str
    min_length: int
    max_length: int

    @property
    def radix(self) -> int:
        return len(self.alphabet)

    @property
    def holds_domain(self) -> bool:
        """E-mail: everything from the last ``@`` on stays in clear."""
        return self.name == "email"


@lru_cache(maxsize=None)
def element(name: str) -> Element:
    """Look an element up; an unknown name is an error before any job starts."""
    if name not in ALPHABETS:
        raise ValueError(f"unknown data element {name!r}; known: {sorted(ALPHABETS)}")
    alphabet = ALPHABETS[name]
    bits = math.log2(len(alphabet))
    return Element(
        name,
        alphabet,
        min_length=math.ceil(round(math.log2(DOMAIN_FLOOR) / bits, 9)),
        max_length=2 * math.floor(96 / bits),
    )
