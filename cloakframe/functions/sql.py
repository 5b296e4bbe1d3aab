"""The column functions under names for SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fpe, native
from .elements import DEFAULT_ELEMENT, element
from . import keys
from .keys import TokenKey


def register(
    spark: SparkSession, key: TokenKey | None = None, default: str = DEFAULT_ELEMENT, hmac_secret: str | None = None
) -> None:
    """Register for this session: ``fpe_encrypt(value, element)``, ``fpe_decrypt(value, element)``,
    ``hmac_token(value)`` and ``noop(value)``.  A NULL element means ``default``; keys not given come from
    the session."""
    key = key or TokenKey.from_session(spark)
    element(default)

    @F.arrow_udf(T.StringType())
    def encrypt(values: pa.Array, names: pa.Array) -> pa.Array:
        return fpe.transform_mixed(values, names, default, key, True, "error")

    @F.arrow_udf(T.StringType())
    def decrypt(values: pa.Array, names: pa.Array) -> pa.Array:
        return fpe.transform_mixed(values, names, default, key, False, "error")

    secret = keys.hmac_secret(hmac_secret, key)
    spark.udf.register("fpe_encrypt", encrypt)
    spark.udf.register("fpe_decrypt", decrypt)
    spark.udf.register("hmac_token", native.hmac_function(secret))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION noop(value STRING) RETURNS STRING RETURN value")
