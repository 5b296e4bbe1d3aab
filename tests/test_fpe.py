"""Cipher, tokens and column functions: published vectors, round trips, limits."""

import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions import ff3, fpe, keys, native, sql
from cloakframe.functions.aes import encrypt_blocks, expand_key
from cloakframe.functions.elements import ALPHABETS, element
from cloakframe.functions.keys import TokenKey

KEY = TokenKey()

VECTORS = [
    ("ssn", "123-45-6789", "516-91-2276"),
    ("email", "john.smith.42@example.com", "0u3w.ylwumnik@example.com"),
    ("ssn", "000-00-0001", "865-17-6500"),
    ("ssn", "987-65-4321", "176-43-2567"),
    ("digits", "1990-01-31", "0804-22-26"),
    ("ccn", "4111 1111 1111 1111", "6492 5673 1277 7498"),
    ("email", "emily.brown.1000000@corner.example", "6_e2ytkw798x3_ufz+4@corner.example"),
    ("email", "a.b.c.99@test.org", "dikvk8v7@test.org"),
    ("name", "John Smith", "zzoo xrefY"),
    ("name", "Emily Rodriguez", "scqcR fnJUdnCBJ"),
    ("alnum", "Ab3-Zz9x", "2PY-xJj5"),
    ("ssn", "12", "12"),
    ("ssn", "", ""),
    ("ssn", None, None),
]


def run(values, name, encrypting=True, key=KEY, overlong="error"):
    return fpe.transform(pa.array(values, pa.string()), name, key, encrypting, overlong).to_pylist()


@pytest.mark.parametrize(
    "key, expected",
    [
        (bytes(range(16)), "69c4e0d86a7b0430d8cdb78070b4c55a"),
        (bytes(range(24)), "dda97ca4864cdfe06eaf70a0ec0d7191"),
        (bytes(range(32)), "8ea2b7ca516745bfeafc49904b496089"),
    ],
)
def test_aes_standard_examples(key, expected):
    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), "<u4").astype(np.uint32)
    out = encrypt_blocks([block[j : j + 1] for j in range(4)], expand_key(key))
    assert b"".join(c.astype("<u4").tobytes() for c in out).hex() == expected


@pytest.mark.parametrize("name, clear, token", VECTORS)
def test_vectors(name, clear, token):
    assert run([clear], name) == [token]
    assert run([token], name, encrypting=False) == [clear]


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_every_length_of_every_element(name):
    spec = element(name)
    values = []
    for n in range(1, spec.max_length + 1):
        values += [spec.alphabet[0] * n, spec.alphabet[-1] * n, "".join(spec.alphabet[(7 * i + n) % spec.radix] for i in range(n))]
    tokens = run(values, name)
    assert run(tokens, name, encrypting=False) == values
    assert [len(t) for t in tokens] == [len(v) for v in values]
    for value, token in zip(values, tokens):
        assert (value == token) or len(value) >= spec.min_length
        assert set(token) <= set(spec.alphabet)


def by_definition(cipher_key, radix, digits, encrypt=True):
    """FF3-1 one value at a time, straight from the standard, with Python integers."""
    keys, n = expand_key(cipher_key.key_bytes[::-1]), len(digits)
    tweak = int.from_bytes(cipher_key.tweak_bytes, "big")
    left, right = (tweak >> 28) << 4, ((tweak & 0xFFFFFF) << 8) | (((tweak >> 24) & 0xF) << 4)
    u = (n + 1) // 2
    number = lambda part: sum(d * radix**i for i, d in enumerate(part))
    a, b = list(digits[:u]), list(digits[u:])
    for i in range(8) if encrypt else range(7, -1, -1):
        m, w = (u, right) if i % 2 == 0 else (n - u, left)
        source, target = (b, a) if encrypt else (a, b)
        block = number(source).to_bytes(12, "little") + (w ^ i).to_bytes(4, "little")
        state = [np.frombuffer(block[4 * j : 4 * j + 4], "<u4").astype(np.uint32) for j in range(4)]
        y = int.from_bytes(b"".join(c.astype("<u4").tobytes() for c in encrypt_blocks(state, keys)), "little")
        c = (number(target) + (y if encrypt else -y)) % radix**m
        moved = [c // radix**k % radix for k in range(m)]
        a, b = (b, moved) if encrypt else (moved, a)
    return a + b


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(ALPHABETS)), st.data())
def test_batches_equal_the_definition(name, data):
    spec = element(name)
    values = data.draw(
        st.lists(st.text(spec.alphabet, min_size=spec.min_length, max_size=spec.max_length), min_size=1, max_size=5)
    )
    expected = [
        "".join(spec.alphabet[d] for d in by_definition(KEY, spec.radix, [spec.alphabet.index(c) for c in v])) for v in values
    ]
    plain = "digits" if name in ("ssn", "phone", "ccn") else name
    suffix = "@x.org" if name == "email" else ""
    assert run([v + suffix for v in values], plain) == [e + suffix for e in expected]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(ALPHABETS)), st.lists(st.one_of(st.none(), st.text(max_size=30))))
def test_round_trip_and_skeleton_of_any_text(name, values):
    tokens = run(values, name, overlong="null")
    assert run(tokens, name, encrypting=False, overlong="null") == tokens or len(tokens) == len(values)
    members = set(element(name).alphabet)
    back = run(tokens, name, encrypting=False, overlong="null")
    for value, token, clear in zip(values, tokens, back):
        if token is not None:
            assert clear == value
            assert [c if c not in members else "" for c in value] == [c if c not in members else "" for c in token]


def test_tables_give_the_same_tokens_as_direct_rounds():
    digits = np.random.default_rng(1).integers(0, 10, (9, 3000), dtype=np.uint8)
    cipher = ff3.FF3Cipher(KEY.key_bytes, KEY.tweak_bytes, 10)
    before = cipher.apply([digits], True)[0]
    for _ in range(40):
        after = cipher.apply([digits], True)[0]
    assert cipher._tables and (before == after).all()


def test_injective_on_a_whole_domain():
    values = [f"{i:06d}" for i in range(0, 1_000_000, 7)]
    assert len(set(run(values, "digits"))) == len(values)


def test_repeated_values_take_the_remembered_path():
    values = ["John Smith", "Jane Doe", None, "John Smith"] * 50
    assert run(values, "name") == [run([v], "name")[0] for v in values]
    assert run(values, "name") == run(values, "name")


def test_sliced_arrays():
    values = pa.array(["000-00-0001", "123-45-6789", None, "987-65-4321"])
    assert fpe.transform(values[1:], "ssn", KEY, True).to_pylist() == ["516-91-2276", None, "176-43-2567"]


def test_overlong_payload():
    with pytest.raises(ValueError, match="longer than 56"):
        run(["1" * 57], "digits")
    assert run(["1" * 57, "123456"], "digits", overlong="null")[0] is None
    assert run(["1" * 57, "123456"], "digits", overlong="null")[1] is not None


def test_floor_and_bound_per_radix():
    assert {n: (element(n).min_length, element(n).max_length) for n in ("digits", "email", "name", "alnum")} == {
        "digits": (6, 56), "email": (4, 36), "name": (4, 32), "alnum": (4, 32),
    }


def test_unknown_element_fails_before_any_job():
    with pytest.raises(ValueError, match="unknown data element"):
        fpe.encrypt("x", "not_a_thing")
    with pytest.raises(ValueError, match="unknown data element"):
        fpe.token_of("xxxxxxxxxx", "not_a_thing")


def test_unknown_element_in_a_column_fails_the_job(spark):
    df = spark.createDataFrame([("xxxxxxxxxx", "not_a_thing")], "v string, e string")
    with pytest.raises(Exception, match="unknown data element"):
        df.select(fpe.encrypt("v", F.col("e"))).collect()


@pytest.mark.parametrize("key, tweak", [("AB", "D8E7920AFA330A"), ("Z" * 32, "D8E7920AFA330A"), ("A" * 32, "D8E7920AFA330A00")])
def test_key_and_tweak_are_checked(key, tweak):
    with pytest.raises(ValueError):
        TokenKey(key, tweak)


@pytest.mark.parametrize("length", [32, 48, 64])
def test_all_key_sizes(length):
    key = TokenKey("0123456789ABCDEF" * (length // 16))
    tokens = run(["123-45-6789"], "ssn", key=key)
    assert run(tokens, "ssn", encrypting=False, key=key) == ["123-45-6789"]


def test_key_is_not_shown(spark):
    assert KEY.key not in repr(KEY)
    plan = spark.range(1).select(fpe.encrypt(F.lit("123-45-6789"), "ssn"), native.hmac_token_private(F.lit("x"), "hidden-secret"))
    shown = plan._jdf.queryExecution().toString()
    assert KEY.key not in shown and "hidden-secret" not in shown


def test_tweaks_come_in_pairs():
    with pytest.raises(ValueError, match="together"):
        fpe.reprotect("v", "ssn", "ssn", old_external_tweak=b"1234567")
    with pytest.raises(ValueError, match="bytes"):
        fpe.encrypt("v", "ssn", external_tweak="1234567")


def test_mixed_elements_keep_order_and_default(spark):
    rows = [(i, e, v) for i, (e, v, _) in enumerate(VECTORS)] + [(99, None, "123-45-6789")]
    df = spark.createDataFrame(rows, "i int, e string, v string").coalesce(1)
    got = {r["i"]: r["t"] for r in df.withColumn("t", fpe.encrypt("v", F.col("e"))).collect()}
    assert got == {**{i: t for i, (_, _, t) in enumerate(VECTORS)}, 99: "516-91-2276"}


def test_status_codes(spark):
    df = spark.createDataFrame([("12",), ("123456",), ("1" * 57,), (None,)], "v string")
    got = [tuple(r[0]) for r in df.select(native.protect_with_status("v", "digits")).collect()]
    assert got == [("12", 22), (run(["123456"], "digits")[0], 6), (None, 23), (None, 0)]


def test_strict_dates(spark):
    df = spark.createDataFrame([("12/25/2023",), ("25/12/2023",), ("20231225",), ("2023/25/12",)], "v string")
    assert {str(r[0]) for r in df.select(native.parse_date("v", strict=True)).collect()} == {"2023-12-25"}
    with pytest.raises(Exception, match="no known date format"):
        spark.createDataFrame([("soon",)], "v string").select(native.parse_date("v", strict=True)).collect()


def test_typed_token_is_only_given_when_nothing_is_lost(spark):
    df = spark.range(100_000_000, 100_000_400).select(native.protect_typed("id", "bigint").alias("p"))
    for token, typed in (tuple(r[0]) for r in df.collect()):
        assert (typed is None) == token.startswith("0")


def test_bytes_round_trip(spark):
    df = spark.createDataFrame([(bytearray("Größe 12345".encode()),)], "v binary")
    held = df.select("v", native.protect_typed("v", "binary")["token"].alias("t"))
    row = held.select("v", native.unprotect_typed("t", "binary").alias("back")).first()
    assert row["v"] == row["back"]


def test_capitals_of_an_email_stay_clear(spark):
    df = spark.createDataFrame([("John.smith@x.org",)], "v string")
    row = df.select(fpe.encrypt("v", "email").alias("t"), native.keeps_clear_letters("v").alias("k")).first()
    assert row["t"][0] == "J" and row["k"]


def test_pure_catalyst_hmac_equals_the_private_one(spark):
    df = spark.createDataFrame([("ä",), ("",), (None,), (string.printable,)], "v string")
    for key in ("short", "k" * 100):
        rows = df.select(native.hmac_token("v", key), native.hmac_token_private("v", key)).collect()
        assert all(r[0] == r[1] for r in rows)


def test_sql_functions_take_bare_nulls(spark):
    from cloakframe.functions import sql

    sql.register(spark, default="digits")
    row = spark.sql("SELECT fpe_encrypt('1990-01-31', NULL) a, fpe_encrypt(NULL, 'ssn') b, noop(NULL) c, hmac_token(NULL) d").first()
    assert tuple(row) == ("0804-22-26", None, None, None)


def test_the_session_key_holds_everywhere(spark):
    spark.conf.set(keys.KEY_CONF, "0123456789ABCDEF0123456789ABCDEF")
    try:
        sql.register(spark)
        df = spark.createDataFrame([("123-45-6789",)], "v string")
        row = df.select(fpe.encrypt("v", "ssn").alias("t"), fpe.encrypt("v", "ssn", TokenKey()).alias("demo")).first()
        again = df.selectExpr("fpe_encrypt(v, 'ssn') AS t").first()
        assert row.t == again.t == fpe.token_of("123-45-6789", "ssn") != row.demo
        hmac = df.select(native.hmac_token("v").alias("a"), native.hmac_token_private("v").alias("b"), F.expr("hmac_token(v)").alias("c")).first()
        assert hmac.a == hmac.b == hmac.c
    finally:
        spark.conf.unset(keys.KEY_CONF)
        sql.register(spark)
    assert df.select(fpe.encrypt("v", "ssn")).first()[0] == row.demo


def test_unknown_element_of_a_row_is_a_status(spark):
    rows = [("123-45-6789", "ssn"), ("123-45-6789", "nothing"), ("12", "ssn"), (None, "nothing"), ("123-45-6789", None), ("123-45-6789", ""), ("1" * 60, "ssn")]
    df = spark.createDataFrame(rows, "v string, e string")
    told = [tuple(r[0]) for r in df.select(native.protect_each_with_status("v", "e")).collect()]
    assert [c for _, c in told] == [6, 2, 22, 0, 6, 6, 23]
    assert told[0][0] == told[4][0] == told[5][0] != "123-45-6789" and told[1][0] is told[3][0] is told[6][0] is None and told[2][0] == "12"
    with pytest.raises(ValueError, match="unknown data element"):
        native.protect_each_with_status("v", "e", default="nothing")


def test_wide_values_cut_only_the_value(spark):
    """Any width, with texts of other lengths and scripts; only the value is cut, and a table of one file is spread."""
    from cloakframe.operators import tokens as tk
    from cloakframe.plans import QUERIES

    values = ["abc", "é漢", "x" * 40, "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for width in (0, 7, 30, 1_000_000, 2_000_005):
        chunk = lambda v, n: (v * (n // max(len(v), 1) + 1))[:n]
        wide = tk.wide_values(df, F.col("v"), width)
        wanted = [None if v is None else chunk(v, 1_000_000) * (width // 1_000_000) + chunk(v, width % 1_000_000) for v in values]
        assert [r.wide for r in wide.collect()] == wanted
    assert "substring(repeat" not in wide._jdf.queryExecution().optimizedPlan().toString()
    plan = QUERIES["wide_values"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
