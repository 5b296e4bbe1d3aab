"""Tokens in a value's own type: the token of a date is a date, of an integer an integer, of a double a double.

A value is the rank in a bounded domain, and the token the value of the enciphered rank.  FF3-1 works on all strings of a
length, which are more than the domain has; an enciphered rank outside is enciphered again until it falls inside
(cycle walking).  That is a permutation of the domain, undone by walking the other way, and takes but a few turns, since
each domain fills a good part of its strings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ff3 import FF3Cipher
from .fpe import _cipher
from .keys import TokenKey, key_or_session

_U = np.uint64
FIRST_DAY, LAST_DAY = -719_162, 2_932_896  # 0001-01-01 and 9999-12-31, in days from 1970-01-01
SMALL = 10**6  # FF3-1 needs a million strings, so integers of up to six digits share a domain
_INFINITE = 0x7FF << 52  # the bits of positive infinity; finite numbers are below
_SIGN = _U(1 << 63)


def _walk_all(groups: list[tuple[np.ndarray, int, int]], cipher: FF3Cipher, encrypting: bool) -> list[np.ndarray]:
    """Of each (ranks, size, length) the permutation of 0 to size - 1; a rank is ``length`` digits of the cipher's radix.
    All domains walk in step, since a turn of a few ranks costs about as much as one of a thousand."""
    out = [ranks.astype(_U) for ranks, _, _ in groups]
    outside = {g: np.arange(len(ranks)) for g, (ranks, _, _) in enumerate(groups) if len(ranks)}
    while outside:
        moved = cipher.apply_numbers([out[g][rows] for g, rows in outside.items()], [groups[g][2] for g in outside], encrypting)
        for (g, rows), new in zip(list(outside.items()), moved):
            out[g][rows] = new
            outside[g] = rows[new >= _U(groups[g][1])]
            if not len(outside[g]):
                del outside[g]
    return out


def _walk(ranks: np.ndarray, size: int, length: int, cipher: FF3Cipher, encrypting: bool) -> np.ndarray:
    return _walk_all([(ranks, size, length)], cipher, encrypting)[0]


def _dates(days: np.ndarray, ciphers: Callable[[int], FF3Cipher], encrypting: bool) -> np.ndarray:
    if len(days) and (days.min() < FIRST_DAY or days.max() > LAST_DAY):
        raise ValueError("a date outside the years 1 to 9999 has no token")
    return (_walk(days - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, 7, ciphers(10), encrypting).astype(np.int64) + FIRST_DAY).astype(np.int32)


def _integers(values: np.ndarray, ciphers: Callable[[int], FF3Cipher], encrypting: bool) -> np.ndarray:
    """Numbers of up to six digits and sign among themselves; longer ones keep sign and number of digits."""
    out, cipher = values.copy(), ciphers(10)
    lowest = values == np.iinfo(np.int64).min  # has no positive counterpart; its own token
    size = np.abs(np.where(lowest, 0, values))
    small = (size < SMALL) & ~lowest
    places, groups = [small], [(values[small] + (SMALL - 1), 2 * SMALL - 1, 7)]
    for digits in range(7, 20):
        low, high = 10 ** (digits - 1), min(10**digits, 2**63)
        band = (size >= low) & (size <= high - 1)
        if band.any():
            places.append(band)
            groups.append((size[band] - low, high - low, digits))
    first, *rest = _walk_all(groups, cipher, encrypting)
    out[small] = first.astype(np.int64) - (SMALL - 1)
    for band, (_, _, digits), moved in zip(places[1:], groups[1:], rest):
        out[band] = np.sign(values[band]) * (moved.astype(np.int64) + 10 ** (digits - 1))
    return out


def _doubles(values: np.ndarray, ciphers: Callable[[int], FF3Cipher], encrypting: bool) -> np.ndarray:
    """Any finite number becomes any other; infinities and NaN stay, as they tell of no one."""
    bits = values.view(_U)
    size = bits & ~_SIGN
    finite = size < _U(_INFINITE)
    rank = size[finite] + np.where(bits[finite] & _SIGN, _U(_INFINITE), _U(0))
    moved = _walk(rank, 2 * _INFINITE, 64, ciphers(2), encrypting)
    out = bits.copy()
    out[finite] = np.where(moved >= _U(_INFINITE), (moved - _U(_INFINITE)) | _SIGN, moved)
    return out.view(np.float64)


_KINDS = {
    "date": (T.DateType(), pa.int32(), _dates),
    "bigint": (T.LongType(), pa.int64(), _integers),
    "double": (T.DoubleType(), pa.float64(), _doubles),
}
KINDS = tuple(_KINDS)


def transform_typed(values: pa.Array, kind: str, key: TokenKey, encrypting: bool) -> pa.Array:
    """One Arrow array of dates, integers or doubles; a repeated value is worked once a batch, nulls stay."""
    _, stored, move = _KINDS[kind]
    coded = values.dictionary_encode()
    distinct = coded.dictionary.cast(stored).to_numpy(zero_copy_only=False).copy()
    moved = move(distinct, lambda radix: _cipher(key.key_bytes, key.tweak_bytes, radix), encrypting)
    return pa.array(moved, stored).cast(values.type).take(coded.indices)


def _typed(value: Column | str, kind: str, key: TokenKey | None, encrypting: bool) -> Column:
    if kind not in _KINDS:
        raise ValueError(f"type must be one of {KINDS}, got {kind!r}")
    key = key_or_session(key)

    @F.arrow_udf(_KINDS[kind][0])
    def moved(values: pa.Array) -> pa.Array:
        return transform_typed(values, kind, key, encrypting)

    return moved((F.col(value) if isinstance(value, str) else value).cast(kind))


def encipher(value: Column | str, kind: str, key: TokenKey | None = None) -> Column:
    """Token of a date, bigint or double in the same type; NULL stays NULL.  Equal values have equal tokens, different
    ones different tokens."""
    return _typed(value, kind, key, True)


def decipher(token: Column | str, kind: str, key: TokenKey | None = None) -> Column:
    """Inverse of :func:`encipher` under the same key."""
    return _typed(token, kind, key, False)
