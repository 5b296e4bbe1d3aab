"""Tokens in a value's own type: permutations of their domains, undone under the same key only."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakframe.functions import ff3, native, typed
from cloakframe.functions.keys import TokenKey

DEMO, OTHER = TokenKey(), TokenKey("00112233445566778899AABBCCDDEEFF")


def moved(values, kind, encrypting=True, key=DEMO):
    return typed.transform_typed(values, kind, key, encrypting)


def test_whole_domain_of_short_integers_is_permuted():
    every = np.arange(-(typed.SMALL - 1), typed.SMALL)
    tokens = moved(pa.array(every), "bigint")
    assert (np.sort(tokens.to_numpy()) == every).all()
    assert (moved(tokens, "bigint", False).to_numpy() == every).all()
    assert (tokens.to_numpy() == every).mean() < 1e-4


def test_whole_calendar_is_permuted():
    every = np.arange(typed.FIRST_DAY, typed.LAST_DAY + 1, dtype=np.int32)
    days = pa.array(every).cast(pa.date32())
    tokens = moved(days, "date")
    assert tokens.type == pa.date32() and (np.sort(tokens.cast(pa.int32()).to_numpy()) == every).all()
    assert moved(tokens, "date", False).equals(days)
    with pytest.raises(ValueError, match="years 1 to 9999"):
        moved(pa.array([typed.LAST_DAY + 1], pa.int32()).cast(pa.date32()), "date")


def test_long_integers_keep_sign_and_length():
    pick = np.random.default_rng(1)
    values = [s * int(pick.integers(10 ** (k - 1), min(10**k, 2**63 - 1))) for k in range(7, 20) for s in (1, -1) for _ in range(200)]
    values += [10**k for k in range(6, 19)] + [10**k - 1 for k in range(7, 19)] + [2**63 - 1, -(2**63 - 1), -(2**63)]
    tokens = moved(pa.array(values), "bigint").to_pylist()
    assert len(set(tokens)) == len(set(values)) and all(len(str(t)) == len(str(v)) for t, v in zip(tokens, values))
    assert moved(pa.array(tokens), "bigint", False).to_pylist() == values
    assert moved(pa.array(tokens), "bigint", False, OTHER).to_pylist() != values


def test_doubles_stay_finite():
    pick = np.random.default_rng(2)
    bits = pick.integers(0, 1 << 63, 5000).view(np.float64)
    values = np.concatenate([bits[np.isfinite(bits)], -bits[np.isfinite(bits)], [0.0, -0.0, 5e-324, 1.7976931348623157e308, 19.99]])
    tokens = moved(pa.array(values), "double")
    assert np.isfinite(tokens.to_numpy()).all() and len(set(tokens.to_numpy().view(np.uint64))) == len(set(values.view(np.uint64)))
    assert (moved(tokens, "double", False).to_numpy().view(np.uint64) == values.view(np.uint64)).all()
    special = moved(pa.array([float("inf"), float("-inf"), float("nan"), None]), "double").to_pylist()
    assert special[0] == float("inf") and special[1] == float("-inf") and np.isnan(special[2]) and special[3] is None


def test_columns_nulls_and_repeats(spark):
    rows = [(datetime.date(2024, 2, 29), 7, 1.5), (None, None, None), (datetime.date(2024, 2, 29), 7, 1.5), (datetime.date(1, 1, 1), -7, -0.0)]
    df = spark.createDataFrame(rows, "d date, n long, x double")
    kinds = {"d": "date", "n": "bigint", "x": "double"}
    held = df.select("*", *[native.protect_typed(c, k).alias(f"{c}_p") for c, k in kinds.items()])
    assert {f: t for f, t in held.select("d_p.typed", F.col("n_p.typed").alias("m"), F.col("x_p.typed").alias("y")).dtypes} == {"typed": "date", "m": "bigint", "y": "double"}
    back = held.select(*[native.unprotect_typed(f"{c}_p.token", k).alias(c) for c, k in kinds.items()])
    assert [tuple(r) for r in back.collect()] == rows
    tokens = held.collect()
    assert tokens[0].d_p == tokens[2].d_p and tokens[1].n_p.typed is None and all(r.d_p.token == str(r.d_p.typed) for r in tokens if r.d)
    with pytest.raises(ValueError, match="type must be"):
        typed.encipher("d", "timestamp")


@pytest.mark.parametrize("radix, length", [(2, 64), (2, 33), (10, 7), (10, 13), (10, 18), (10, 19), (36, 11)])
def test_numbers_are_moved_as_their_digits(radix, length):
    """The cipher on numbers equals the cipher on digit strings, groups of rows in step."""
    rng = np.random.default_rng(length)
    digits = rng.integers(0, radix, (length, 300)).astype(np.uint8)
    if radix**length > 1 << 64:
        digits[-1] = 0
    numbers = np.array([sum(int(d) * radix**i for i, d in enumerate(column)) for column in digits.T], dtype=np.uint64)
    key = bytes.fromhex("EF4359D8D580AA4F7F036D6F04FC6A94"), bytes.fromhex("D8E7920AFA330A")
    for encrypting in (True, False):
        wanted = ff3.FF3Cipher(*key, radix).apply([digits], encrypting)[0]
        whole = np.array([sum(int(d) * radix**i for i, d in enumerate(column)) for column in wanted.T], dtype=object)
        moved = ff3.FF3Cipher(*key, radix).apply_numbers([numbers, numbers[:7]], [length, length], encrypting)[0]
        assert [int(m) for m in moved] == [int(w) % (1 << 64) for w in whole]


def test_domains_walk_in_step(monkeypatch):
    """Numbers of many lengths take as many turns of the cipher as the length that takes most, not as all together."""
    calls = []
    apply = ff3.FF3Cipher.apply_numbers
    monkeypatch.setattr(ff3.FF3Cipher, "apply_numbers", lambda self, groups, *a: calls.append(len(groups)) or apply(self, groups, *a))
    values = pa.array([int(v) for n in range(7, 19) for v in np.random.default_rng(n).integers(10 ** (n - 1), 10**n, 200)])
    tokens = moved(values, "bigint")
    assert calls[0] == 12 and len(calls) <= 15
    assert moved(tokens, "bigint", False).equals(values)
