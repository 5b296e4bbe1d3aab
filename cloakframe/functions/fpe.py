"""Format-preserving tokens as Spark columns.

``encrypt`` / ``decrypt`` / ``reprotect`` return ordinary deterministic columns, so Catalyst still pushes
filters and limits below them.  Inside a task an Arrow batch is handled as one byte buffer: the characters
of the element's alphabet are gathered by payload length, transformed as a digit matrix and put back in
place.  Offsets never change, since a token has its value's length.  Repeated values of a batch are
transformed once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .elements import DEFAULT_ELEMENT, Element, element
from .ff3 import FF3Cipher
from .keys import TokenKey, key_or_session, tweak_pair

OVERLONG = ("error", "null")
_STRUCTURAL = 255


@lru_cache(maxsize=64)
def _cipher(key: bytes, tweak: bytes, radix: int) -> FF3Cipher:
    return FF3Cipher(key, tweak, radix)


@lru_cache(maxsize=None)
def _byte_maps(alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte -> digit value or ``_STRUCTURAL``, digit value -> byte).  Alphabets are ASCII, so bytes of
    multi-byte characters are always structural."""
    symbols = np.frombuffer(alphabet.encode("ascii"), dtype=np.uint8)
    digit = np.full(256, _STRUCTURAL, dtype=np.uint8)
    digit[symbols] = np.arange(len(symbols))
    return digit, symbols


def _payload_positions(data: np.ndarray, offsets: np.ndarray, spec: Element) -> np.ndarray:
    """Positions of the transformed characters in a batch's byte buffer."""
    member = _byte_maps(spec.alphabet)[0][data] != _STRUCTURAL
    if spec.holds_domain:
        signs = np.flatnonzero(data == ord("@"))
        if len(signs):
            last = signs[np.maximum(np.searchsorted(signs, offsets[1:]) - 1, 0)]
            inside = (last >= offsets[:-1]) & (last < offsets[1:])
            # +1 where a held-out domain starts, -1 where its value ends
            steps = np.zeros(len(data) + 1, dtype=np.int8)
            steps[last[inside]] = 1
            np.add.at(steps, offsets[1:][inside], -1)
            member &= np.cumsum(steps[:-1]) == 0
    return np.flatnonzero(member)


def _transform_distinct(
    values: pa.Array, spec: Element, key: TokenKey, encrypting: bool, overlong: str
) -> pa.Array:
    values = values.cast(pa.string())
    if len(values) == values.null_count:
        return values
    _, raw_offsets, raw_data = values.buffers()
    ends = np.frombuffer(raw_offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(raw_data, dtype=np.uint8)[ends[0] : ends[-1]] if raw_data else np.empty(0, np.uint8)
    offsets = (ends - ends[0]).astype(np.int64)

    digit_of, symbol_of = _byte_maps(spec.alphabet)
    positions = _payload_positions(data, offsets, spec)
    starts = np.searchsorted(positions, offsets)
    lengths = np.diff(starts)
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    lengths[~valid] = 0

    too_long = lengths > spec.max_length
    if too_long.any():
        if overlong == "error":
            raise ValueError(f"{spec.name}: payload longer than {spec.max_length} characters")
        valid &= ~too_long
    out = data.copy()
    cipher = _cipher(key.key_bytes, key.tweak_bytes, spec.radix)
    places = [
        positions[starts[np.flatnonzero(lengths == length)] + np.arange(length)[:, None]]
        for length in np.unique(lengths[(lengths >= spec.min_length) & ~too_long])
    ]
    for where, digits in zip(places, cipher.apply([digit_of[data[p]] for p in places], encrypting)):
        out[where] = symbol_of[digits]

    validity = None if valid.all() else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(
        pa.string(), len(values), [validity, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)]
    )


def transform(values: pa.Array, name: str, key: TokenKey, encrypting: bool, overlong: str = "error") -> pa.Array:
    """Encrypt or decrypt one Arrow array; repeated values are worked on once."""
    coded = values.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = coded.dictionary
    if 2 * len(distinct) > len(values):
        done = _transform_distinct(values, element(name), key, encrypting, overlong)
    elif len(distinct) <= RECALLED_VALUES:
        done = _recalled(distinct, name, key, encrypting, overlong).take(coded.indices)
    else:
        done = _transform_distinct(distinct, element(name), key, encrypting, overlong).take(coded.indices)
    return done.cast(values.type)


RECALLED_VALUES = 2_000  # a column this poor in values keeps its results from batch to batch
_recall: dict[tuple, dict[str, str | None]] = {}


def _recalled(distinct: pa.Array, name: str, key: TokenKey, encrypting: bool, overlong: str) -> pa.Array:
    known = _recall.setdefault((name, key.key, key.tweak, encrypting, overlong), {})
    wanted = distinct.to_pylist()
    missing = [v for v in wanted if v not in known]
    if missing:
        done = _transform_distinct(pa.array(missing, pa.string()), element(name), key, encrypting, overlong)
        if len(known) + len(missing) > 10 * RECALLED_VALUES:
            known.clear()
            return _transform_distinct(distinct, element(name), key, encrypting, overlong)
        known.update(zip(missing, done.to_pylist()))
    return pa.array([known[v] for v in wanted], pa.string())


def transform_mixed(
    values: pa.Array, names: pa.Array, default: str, key: TokenKey, encrypting: bool, overlong: str
) -> pa.Array:
    """Rows of several elements in one batch; each element is one pass, order is kept."""
    values = values.cast(pa.string())
    names = pc.fill_null(names.cast(pa.string()), default)
    coded = pc.if_else(pc.equal(names, ""), default, names).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    parts, order = [], []
    for code, name in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        picked = values.take(pa.array(rows))
        if picked.null_count < len(picked):  # an element that only labels NULLs is never looked up
            picked = transform(picked, name, key, encrypting, overlong)
        parts.append(picked)
        order.append(rows)
    if not parts:
        return values
    back = np.argsort(np.concatenate(order), kind="stable")
    return pa.concat_arrays(parts).take(pa.array(back))


def _check_policy(overlong: str) -> None:
    if overlong not in OVERLONG:
        raise ValueError(f"overlong must be one of {OVERLONG}, got {overlong!r}")


def _keyed(value, name, key, tweak, encrypting, default, overlong) -> Column:
    _check_policy(overlong)
    key = key_or_session(key).with_tweak(tweak)
    fallback = default or DEFAULT_ELEMENT
    element(fallback if name is None or isinstance(name, Column) else name)
    value = F.col(value) if isinstance(value, str) else value

    if isinstance(name, Column):

        @F.arrow_udf(T.StringType())
        def mixed(values: pa.Array, names: pa.Array) -> pa.Array:
            return transform_mixed(values, names, fallback, key, encrypting, overlong)

        return mixed(value.cast("string"), name)

    fixed = fallback if name is None else name

    @F.arrow_udf(T.StringType())
    def single(values: pa.Array) -> pa.Array:
        return transform(values, fixed, key, encrypting, overlong)

    return single(value.cast("string"))


def encrypt(
    value: Column | str,
    name: str | Column | None = None,
    key: TokenKey | None = None,
    *,
    external_tweak: bytes | None = None,
    default: str | None = None,
    overlong: str = "error",
) -> Column:
    """Deterministic token of the same shape.  ``name`` is an element, or a column naming one per row;
    a missing or empty name falls back to ``default``, then to ``ssn``.  Values whose payload is below the
    element's floor come back unchanged (see ``native.passes_through``); NULL stays NULL.  A payload
    above the FF3-1 bound fails the job, or becomes NULL with ``overlong="null"``."""
    return _keyed(value, name, key, external_tweak, True, default, overlong)


def decrypt(
    value: Column | str,
    name: str | Column | None = None,
    key: TokenKey | None = None,
    *,
    external_tweak: bytes | None = None,
    default: str | None = None,
    overlong: str = "error",
) -> Column:
    """Inverse of :func:`encrypt` under the same element, key and tweak."""
    return _keyed(value, name, key, external_tweak, False, default, overlong)


def reprotect(
    value: Column | str,
    old_name: str,
    new_name: str,
    old_key: TokenKey | None = None,
    new_key: TokenKey | None = None,
    *,
    old_external_tweak: bytes | None = None,
    new_external_tweak: bytes | None = None,
    overlong: str = "error",
) -> Column:
    """Move tokens to another element, key or tweak in one pass; the clear value never leaves the task."""
    _check_policy(overlong)
    tweak_pair(old_external_tweak, new_external_tweak)
    element(old_name), element(new_name)
    before = key_or_session(old_key).with_tweak(old_external_tweak)
    after = key_or_session(new_key or old_key).with_tweak(new_external_tweak)
    value = F.col(value) if isinstance(value, str) else value

    @F.arrow_udf(T.StringType())
    def move(values: pa.Array) -> pa.Array:
        clear = transform(values, old_name, before, False, overlong)
        return transform(clear, new_name, after, True, overlong)

    return move(value)


def token_of(term: str | None, name: str, key: TokenKey | None = None) -> str | None:
    """Token of one search term, computed on the driver so that a plan only ever sees a literal."""
    return transform(pa.array([term], pa.string()), name, key_or_session(key), True)[0].as_py()
