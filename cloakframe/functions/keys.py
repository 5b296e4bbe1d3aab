"""Key material.  Values never appear in plans, column names or ``repr``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

# --- fixed values: demo key and tweak, so published example tokens can be reproduced ------------------
DEMO_KEY = "EF4359D8D580AA4F7F036D6F04FC6A94"
DEMO_TWEAK = "D8E7920AFA330A"
# ------------------------------------------------------------------------------------------------------

KEY_CONF = "spark.cloakframe.secret.key"  # "secret" makes Spark redact the value in its UI
TWEAK_CONF = "spark.cloakframe.secret.tweak"
HMAC_CONF = "spark.cloakframe.secret.hmacKey"

_KEY_LENGTHS = (32, 48, 64)
_TWEAK_LENGTH = 14


def _hex_bytes(text: str, lengths: tuple[int, ...], what: str) -> bytes:
    if len(text) not in lengths:
        allowed = "/".join(str(n) for n in lengths)
        raise ValueError(f"{what} must be {allowed} hex characters, got {len(text)}")
    try:
        return bytes.fromhex(text)
    except ValueError:
        raise ValueError(f"{what} must be hexadecimal") from None


@dataclass(frozen=True)
class TokenKey:
    """FF3-1 key (AES-128/192/256) and 56-bit tweak, both as hex text; validated on creation."""

    key: str = field(default=DEMO_KEY, repr=False)
    tweak: str = field(default=DEMO_TWEAK, repr=False)

    def __post_init__(self):
        _hex_bytes(self.key, _KEY_LENGTHS, "key")
        _hex_bytes(self.tweak, (_TWEAK_LENGTH,), "tweak")

    @property
    def key_bytes(self) -> bytes:
        return bytes.fromhex(self.key)

    @property
    def tweak_bytes(self) -> bytes:
        return bytes.fromhex(self.tweak)

    def with_tweak(self, external_tweak: bytes | None) -> "TokenKey":
        """Same key under a caller-supplied 7-byte tweak."""
        if external_tweak is None:
            return self
        if not isinstance(external_tweak, bytes):
            raise ValueError(f"external tweak must be bytes, got {type(external_tweak).__name__}")
        return replace(self, tweak=external_tweak.hex().upper())

    @classmethod
    def from_session(cls, spark: SparkSession) -> "TokenKey":
        """Key named by the session, or the demo key where the session names none."""
        return cls(spark.conf.get(KEY_CONF, DEMO_KEY), spark.conf.get(TWEAK_CONF, DEMO_TWEAK))


def key_or_session(key: TokenKey | None) -> TokenKey:
    """The key given, else the active session's, so that columns, SQL functions and streams agree."""
    if key is not None:
        return key
    spark = SparkSession.getActiveSession()
    return TokenKey() if spark is None else TokenKey.from_session(spark)


def hmac_secret(secret: str | None = None, key: TokenKey | None = None) -> str:
    """The secret given, else the active session's, else the token key."""
    if secret is not None:
        return secret
    spark = SparkSession.getActiveSession()
    own = None if spark is None else spark.conf.get(HMAC_CONF, None)
    return key_or_session(key).key if own is None else own


def tweak_pair(old: bytes | None, new: bytes | None) -> None:
    """A re-protection takes both tweaks or neither."""
    if (old is None) != (new is None):
        raise ValueError("old and new external tweak must be given together")
