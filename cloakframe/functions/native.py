"""Column functions that need no Python: everything here is plain Catalyst."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fpe, typed as typed_tokens
from .elements import ALPHABETS, DEFAULT_ELEMENT, element
from .keys import TokenKey, hmac_secret

# --- fixed values -------------------------------------------------------------------------------------
MASKS = {"ssn": "***-**-****", "email": "***@***", "name": "***"}
STATUS = {"protect": 6, "unprotect": 8, "reprotect": 50}
TOO_SHORT, TOO_LONG = 22, 23
UNKNOWN_ELEMENT = 2
NO_VALUE = 0  # nothing was given, so nothing was done
HMAC_TOKEN_LENGTH = 16
NOOP_PREFIX = "noop_"
# (pattern, shape) in order of preference; the first that yields a date wins; months and days may have one digit
DATE_FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyy/d/M", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"),
]
CHARSETS = ("UTF-8", "UTF-16LE", "UTF-16BE")
# ------------------------------------------------------------------------------------------------------


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def payload(value: Column | str, name: str) -> Column:
    """The part of a value an element works on: an e-mail's local part, else the whole value."""
    value = _c(value)
    return F.regexp_replace(value, r"@[^@]*$", "") if element(name).holds_domain else value


def payload_length(value: Column | str, name: str) -> Column:
    """How many characters of the value belong to the element's alphabet."""
    part = payload(value, name)
    return F.length(part) - F.length(F.translate(part, element(name).alphabet, ""))


def passes_through(value: Column | str, name: str) -> Column:
    """True where a value is too short for FF3-1 and is therefore returned unchanged."""
    return payload_length(value, name) < element(name).min_length


def keeps_clear_letters(value: Column | str) -> Column:
    """True where an e-mail's local part holds capitals: they are outside the alphabet and stay clear."""
    return payload(value, "email").rlike("[A-Z]")


def hmac_token(value: Column | str, secret: str | None = None) -> Column:
    """First 16 hex digits of HMAC-SHA256, entirely in the JVM; the secret is the session's if none is given.
    The padded key becomes a plan literal, so use :func:`hmac_token_private` where plans are visible to others."""
    key = hmac_secret(secret).encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    text = _c(value).cast("string").cast("binary")
    digest = F.sha2(F.concat(F.lit(inner), text), 256)
    return F.substring(F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256), 1, HMAC_TOKEN_LENGTH)


def hmac_function(secret: str):
    """The same token as an Arrow function that holds the key in its closure."""
    key = secret.encode()

    @F.arrow_udf(T.StringType())
    def token(values: pa.Array) -> pa.Array:
        coded = values.cast(pa.string()).dictionary_encode()  # a repeated value is worked once a batch
        done = [
            None if v is None else _hmac.digest(key, v.encode(), "sha256").hex()[:HMAC_TOKEN_LENGTH]
            for v in coded.dictionary.to_pylist()
        ]
        return pa.array(done, pa.string()).take(coded.indices)

    return token


def hmac_token_private(value: Column | str, secret: str | None = None) -> Column:
    """Same token, with the key in the function's closure instead of the plan."""
    return hmac_function(hmac_secret(secret))(_c(value))


def noop(value: Column | str, prefixed: bool = False) -> Column:
    """Identity, or the value behind ``noop_``; NULL stays NULL."""
    return F.concat(F.lit(NOOP_PREFIX), _c(value)) if prefixed else _c(value)


def mask(name: str) -> Column:
    return F.lit(MASKS.get(name, "***"))


def protect_with_status(value: Column | str, name: str, key: TokenKey | None = None, operation: str = "protect") -> Column:
    """``STRUCT<value, code>`` per row.  Too short passes through with code 22; too long gives NULL and
    code 23; NULL stays NULL with code 0; anything else carries the operation's success code."""
    if operation not in ("protect", "unprotect"):
        raise ValueError(f"operation must be protect or unprotect, got {operation!r}")
    run = fpe.encrypt if operation == "protect" else fpe.decrypt
    return F.struct(
        run(value, name, key, overlong="null").alias("value"),
        status_code(value, name, operation).alias("code"),
    )


def protect_each_with_status(
    value: Column | str, names: Column | str, key: TokenKey | None = None, operation: str = "protect", default: str = DEFAULT_ELEMENT
) -> Column:
    """``STRUCT<value, code>`` under each row's own element.  An element that is not known gives NULL and code 2 instead
    of a failed job, whatever the other rows hold; a missing or empty one is ``default``.  Else as
    :func:`protect_with_status`."""
    if operation not in ("protect", "unprotect"):
        raise ValueError(f"operation must be protect or unprotect, got {operation!r}")
    element(default)
    chosen = F.coalesce(F.nullif(_c(names), F.lit("")), F.lit(default))
    known = chosen.isin(*ALPHABETS)
    run = fpe.encrypt if operation == "protect" else fpe.decrypt
    done = run(F.when(known, _c(value)), F.when(known, chosen), key, default=default, overlong="null")
    code = F.when(_c(value).isNull(), NO_VALUE)
    for name in ALPHABETS:
        code = code.when(chosen == name, status_code(value, name, operation))
    return F.struct(done.alias("value"), code.otherwise(UNKNOWN_ELEMENT).alias("code"))


def reprotect_with_status(
    value: Column | str, old_name: str, new_name: str, old_key: TokenKey | None = None, new_key: TokenKey | None = None
) -> Column:
    """``STRUCT<value, code>`` per token moved to another element or key; code 50 where it was.  A token too
    short or too long for either element keeps the codes of :func:`protect_with_status`."""
    moved = fpe.reprotect(value, old_name, new_name, old_key, new_key, overlong="null")
    before, after = status_code(value, old_name, "reprotect"), status_code(value, new_name, "reprotect")
    return F.struct(moved.alias("value"), F.when(before == STATUS["reprotect"], after).otherwise(before).alias("code"))


def status_code(value: Column | str, name: str, operation: str = "protect") -> Column:
    length = payload_length(value, name)
    return (
        F.when(_c(value).isNull(), NO_VALUE)
        .when(length < element(name).min_length, TOO_SHORT)
        .when(length > element(name).max_length, TOO_LONG)
        .otherwise(STATUS[operation])
    )


def parse_date(value: Column | str, strict: bool = False) -> Column:
    """First of ten formats that fits; none gives NULL, or fails the job when ``strict``."""
    value = _c(value)
    tries = [F.try_to_timestamp(F.when(value.rlike(shape), value), F.lit(fmt)).cast("date") for fmt, shape in DATE_FORMATS]
    parsed = F.coalesce(*tries)
    if not strict:
        return parsed
    problem = F.raise_error(F.concat(F.lit("no known date format: "), value))
    return F.when(value.isNotNull() & parsed.isNull(), problem).otherwise(parsed)


def _check_charset(charset: str) -> str:
    if charset not in CHARSETS:
        raise ValueError(f"charset must be one of {CHARSETS}, got {charset!r}")
    return charset


def text_to_base64(value: Column | str, charset: str = "UTF-8") -> Column:
    """Encode text in a charset, then as base64 on one line."""
    encoded = F.base64(F.encode(_c(value), _check_charset(charset)))
    return F.regexp_replace(encoded, r"[\r\n]", "")


def base64_to_text(value: Column | str, charset: str = "UTF-8") -> Column:
    return F.decode(F.unbase64(_c(value)), _check_charset(charset))


# -- typed values --------------------------------------------------------------------------------------

# type -> element whose alphabet carries its text form
TYPE_ELEMENTS = {"string": "alnum", "bigint": "digits", "double": "digits", "date": "digits", "binary": "alnum"}


def _as_text(value: Column, kind: str) -> Column:
    return F.decode(value, "UTF-8") if kind == "binary" else value.cast("string")


def protect_typed(value: Column | str, kind: str, name: str | None = None, key: TokenKey | None = None) -> Column:
    """``STRUCT<token STRING, typed>``, ``typed`` being the token in the value's own type and ``token`` its text.  A date's
    token is a date, a number's a number (see :mod:`.typed`).  With an element ``name`` the value's text is transformed by
    that element instead; then ``token`` is always whole, and ``typed`` set where that loses nothing (0123 is not an
    integer's text)."""
    if kind not in TYPE_ELEMENTS:
        raise ValueError(f"type must be one of {sorted(TYPE_ELEMENTS)}, got {kind!r}")
    if name is None and kind in typed_tokens.KINDS:
        typed = typed_tokens.encipher(_c(value), kind, key)
        return F.struct(typed.cast("string").alias("token"), typed.alias("typed"))
    token = fpe.encrypt(_as_text(_c(value), kind), name or TYPE_ELEMENTS[kind], key)
    typed = F.encode(token, "UTF-8") if kind == "binary" else token.try_cast(kind)
    return F.struct(token.alias("token"), F.when(_as_text(typed, kind) == token, typed).alias("typed"))


def unprotect_typed(token: Column | str, kind: str, name: str | None = None, key: TokenKey | None = None) -> Column:
    """Clear value in its own type, from the token as text or in its type; ``name`` as for :func:`protect_typed`."""
    if kind not in TYPE_ELEMENTS:
        raise ValueError(f"type must be one of {sorted(TYPE_ELEMENTS)}, got {kind!r}")
    if name is None and kind in typed_tokens.KINDS:
        return typed_tokens.decipher(_c(token).cast(kind), kind, key)
    clear = fpe.decrypt(_c(token), name or TYPE_ELEMENTS[kind], key)
    return F.encode(clear, "UTF-8") if kind == "binary" else clear.cast(kind)
