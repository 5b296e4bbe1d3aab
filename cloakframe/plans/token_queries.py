"""Queries on tokens: round trips, shape, analytics without decryption, search, placement."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from ..functions import fpe, native, sql
from ..functions.keys import DEMO_KEY, KEY_CONF, TokenKey
from ..operators import search, tokens as tk
from ..sources.pii import pii_from, with_branch
from ..operators.govern import entitlements, token_pair
from ..session import shared_folder, shared_path, spread
from ..sources.tables import create_table_as, table
from .base import PEOPLE, people, people_sql, query

_stored: dict[tuple, str] = {}


def stored_tokens(spark, folder):
    """The people's tokens as a stored table, which is what a search or a join on tokens reads: a token
    computed inside the query would be computed again for every filter that Catalyst infers from it.  It is
    written once for a session, folder and key."""
    clear = people(spark, folder)
    at = (spark.sparkContext.applicationId, shared_folder(spark), folder, TokenKey.from_session(spark))
    if at not in _stored:
        path = shared_path(spark, "tokens")
        create_table_as(tk.tokenize_table(clear), path)
        _stored[at] = path
    return spark.read.schema(clear.schema).parquet(_stored[at])


KNOWN_SSN = "633-63-8963"  # customer 7
ROTATED = TokenKey(key="0123456789ABCDEF0123456789ABCDEF0123456789ABCDEF", tweak="00112233445566")


@query(f"{PEOPLE} SELECT * FROM people")
def roundtrip_all(spark, folder):
    return tk.detokenize_table(tk.tokenize_table(people(spark, folder)))


@query(
    f"""{PEOPLE} SELECT id, regexp_replace(ssn, '[0-9]', '9', 'g') AS ssn_shape,
    regexp_replace(name, '[A-Za-z]', 'a', 'g') AS name_shape, regexp_replace(dob, '[0-9]', '9', 'g') AS dob_shape,
    CAST(length(email) AS INTEGER) AS email_length, regexp_extract(email, '@.*$') AS email_domain, false AS any_clear FROM people"""
)
def token_shape(spark, folder):
    clear = people(spark, folder)
    tokens = tk.tokenize_table(clear.select("*", *[F.col(c).alias(f"clear_{c}") for c in ("name", "email", "ssn")]))
    same = (F.col("name") == F.col("clear_name")) | (F.col("email") == F.col("clear_email")) | (F.col("ssn") == F.col("clear_ssn"))
    return tokens.select(
        "id",
        F.regexp_replace("ssn", "[0-9]", "9").alias("ssn_shape"),
        F.regexp_replace("name", "[A-Za-z]", "a").alias("name_shape"),
        F.regexp_replace("dob", "[0-9]", "9").alias("dob_shape"),
        F.length("email").alias("email_length"),
        F.regexp_extract("email", "@.*$", 0).alias("email_domain"),
        same.alias("any_clear"),
    )


@query(
    f"""{PEOPLE} SELECT id, ssn AS ssn_clear, ssn AS ssn_roundtrip, email AS email_clear, email AS email_roundtrip
    FROM people ORDER BY id LIMIT 3"""
)
def roundtrip_sample(spark, folder):
    clear = people(spark, folder)
    sample = tk.roundtrip_sample(clear, tk.tokenize_table(clear))
    return sample.drop("ssn_tokenized", "email_tokenized")


@query(f"{PEOPLE} SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS checked FROM people")
def roundtrip_audit(spark, folder):
    clear = people(spark, folder)
    return tk.roundtrip_audit(clear, tk.tokenize_table(clear))


@query(
    f"""{PEOPLE} SELECT count(DISTINCT ssn) AS distinct_ssn, count(DISTINCT name) AS distinct_name,
    count(DISTINCT email) AS distinct_email, count(DISTINCT dob) AS distinct_dob FROM people"""
)
def token_distinct(spark, folder):
    return tk.distinct_tokens(tk.tokenize_table(people(spark, folder)), ["ssn", "name", "email", "dob"])


@query(f"{PEOPLE} SELECT count(DISTINCT ssn) AS distinct_ssn, count(DISTINCT name) AS distinct_name FROM people")
def distinct_after_decrypt(spark, folder):
    return tk.distinct_after_decrypt(tk.tokenize_table(people(spark, folder)), ["ssn", "name"])


@query(f"{PEOPLE} SELECT name, count(*) AS people, min(id) AS first_id FROM people GROUP BY name")
def token_groups(spark, folder):
    """Group on tokens, decrypt one value per group."""
    grouped = tk.tokenize_table(people(spark, folder), {"name": "name"}).groupBy("name").agg(
        F.count("*").alias("people"), F.min("id").alias("first_id")
    )
    return grouped.withColumn("name", fpe.decrypt("name", "name"))


@query(
    f"""{PEOPLE} SELECT id % 4 AS branch, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders JOIN people ON o_custkey = id GROUP BY 1"""
)
def token_join(spark, folder):
    """Two tables tokenized apart join on the token of a personal number."""
    customers = stored_tokens(spark, folder).select("id", "ssn")
    bought = pii_from(table(spark, folder, "orders"), "o_custkey", keep=("o_totalprice",)).select("ssn", "o_totalprice")
    purchases = create_table_as(tk.tokenize_table(bought), shared_path(spark, "purchases"))
    joined = purchases.join(customers, "ssn")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return joined.groupBy((F.col("id") % 4).alias("branch")).agg(F.count("*").alias("orders"), F.sum(cents).alias("cents"))


@query(f"{PEOPLE} SELECT id, email FROM people WHERE ssn = '{KNOWN_SSN}'")
def search_term(spark, folder):
    found = search.search_term(stored_tokens(spark, folder), "ssn", KNOWN_SSN)
    return found.select("id", fpe.decrypt("email", "email").alias("email"))


@query(f"{PEOPLE} SELECT count(*) AS hits FROM people WHERE ssn = '{KNOWN_SSN}'")
def search_decrypted(spark, folder):
    found = search.search_decrypted(stored_tokens(spark, folder), "ssn", KNOWN_SSN)
    return found.agg(F.count("*").alias("hits"))


@query(f"{PEOPLE} SELECT count(*) AS hits FROM people WHERE ssn = '{KNOWN_SSN}'")
def search_token(spark, folder):
    token = fpe.token_of(KNOWN_SSN, "ssn")
    found = search.search_token(stored_tokens(spark, folder), "ssn", token)
    return found.agg(F.count("*").alias("hits"))


@query(f"{PEOPLE} SELECT id, name FROM people WHERE name IN ('Lisa Smith', 'Emma Doe', 'Nobody Here')")
def search_few(spark, folder):
    hits = stored_tokens(spark, folder).filter(search.token_predicate("name", "in", ["Lisa Smith", "Emma Doe", "Nobody Here"]))
    return hits.select("id", fpe.decrypt("name", "name").alias("name"))


@query(
    f"""WITH people AS ({people_sql()}), wanted AS ({people_sql('supplier', 's_suppkey')})
    SELECT id, ssn FROM people WHERE ssn IN (SELECT ssn FROM wanted)"""
)
def search_many(spark, folder):
    """The terms are a table: everyone who is also a supplier."""
    terms = pii_from(table(spark, folder, "supplier"), "s_suppkey").select("ssn")
    found = search.search_terms(stored_tokens(spark, folder), "ssn", terms, "ssn")
    return found.select("id", fpe.decrypt("ssn", "ssn").alias("ssn"))


_FIRST_100 = f"{PEOPLE} SELECT id, ssn FROM people ORDER BY id LIMIT 100"


@query(_FIRST_100)
def limit_before_decrypt(spark, folder):
    return tk.limit_then_decrypt(tk.tokenize_table(people(spark, folder)), "ssn", 100)


@query(_FIRST_100)
def limit_after_decrypt(spark, folder):
    return tk.decrypt_then_limit(tk.tokenize_table(people(spark, folder)), "ssn", 100)


_HOUSEHOLDS = f"""WITH people AS ({people_sql(keep=', c_mktsegment')})
    SELECT id, ssn FROM people WHERE c_mktsegment = 'HOUSEHOLD'"""


@query(_HOUSEHOLDS)
def filter_before_decrypt(spark, folder):
    tokens = tk.tokenize_table(people(spark, folder, ("c_mktsegment",)), {"ssn": "ssn"})
    return tk.filter_then_decrypt(tokens, "ssn", F.col("c_mktsegment") == "HOUSEHOLD").select("id", "ssn")


@query(_HOUSEHOLDS)
def filter_after_decrypt(spark, folder):
    tokens = tk.tokenize_table(people(spark, folder, ("c_mktsegment",)), {"ssn": "ssn"})
    return tk.decrypt_then_filter(tokens, "ssn", F.col("c_mktsegment") == "HOUSEHOLD").select("id", "ssn")


_CONDITIONAL = f"""{PEOPLE} SELECT id % 2 AS parity, count(*) AS people, count(*) FILTER (WHERE id % 2 = 0) AS in_clear,
    CAST(sum(length(ssn)) AS BIGINT) AS total_length FROM people GROUP BY 1"""


def _conditional(spark, folder, shape):
    clear = people(spark, folder).select("id", "ssn", F.col("ssn").alias("known"))
    chosen = shape(tk.tokenize_table(clear, {"ssn": "ssn"}), "ssn", F.col("id") % 2 == 0)
    return chosen.groupBy((F.col("id") % 2).alias("parity")).agg(
        F.count("*").alias("people"),
        F.count_if(F.col("ssn") == F.col("known")).alias("in_clear"),
        F.sum(F.length("ssn")).alias("total_length"),
    )


@query(_CONDITIONAL)
def decrypt_where(spark, folder):
    return _conditional(spark, folder, tk.decrypt_where)


@query(_CONDITIONAL)
def decrypt_case(spark, folder):
    return _conditional(spark, folder, tk.decrypt_case)


@query(_CONDITIONAL)
def decrypt_hoisted(spark, folder):
    return _conditional(spark, folder, tk.decrypt_hoisted)


@query(f"{PEOPLE} SELECT CAST(sum(length(ssn)) AS BIGINT) AS total_length FROM people WHERE id % 2 = 0")
def filter_then_apply(spark, folder):
    even = tk.filter_then_decrypt(tk.tokenize_table(people(spark, folder), {"ssn": "ssn"}), "ssn", F.col("id") % 2 == 0)
    return tk.forced_length(even, F.col("ssn"))


@query(f"""{PEOPLE} SELECT CAST(sum(length(ssn)) AS BIGINT) AS ssn, CAST(sum(length(email)) AS BIGINT) AS email,
    CAST(sum(length(name)) AS BIGINT) AS name FROM people""")
def forced_lengths(spark, folder):
    tokens = tk.tokenize_table(people(spark, folder))
    return tokens.agg(*[F.sum(F.length(fpe.decrypt(c, c))).alias(c) for c in ("ssn", "email", "name")])


@query(
    """SELECT CAST(copy AS INTEGER) AS copy, count(*) AS rows, max(c_custkey) AS last_id FROM customer,
    (SELECT unnest(range(1, 5)) AS copy) WHERE copy <= 3 OR c_custkey IN
    (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT (SELECT count(*) // 2 FROM customer)) GROUP BY copy"""
)
def replicated_rows(spark, folder):
    """The customer table three and a half times over."""
    customers = table(spark, folder, "customer").select("c_custkey")
    have = customers.count()
    copies = tk.replicate(customers, 3 * have + have // 2, "c_custkey")
    return copies.groupBy("copy").agg(F.count("*").alias("rows"), F.max("c_custkey").alias("last_id"))


@query(f"{PEOPLE} SELECT count(*) AS rows, CAST(sum(50000) AS BIGINT) AS characters FROM people")
def wide_values(spark, folder):
    # a small table's file is one task, and a row becomes 50,000 characters
    narrow = spread(people(spark, folder).select("id", "ssn"), "id").select("ssn")
    wide = tk.wide_values(narrow, F.col("ssn"), 50_000)
    return wide.agg(F.count(native.noop("wide")).alias("rows"), F.sum(F.length("wide")).alias("characters"))


@query(f"{PEOPLE} SELECT count(CASE WHEN id % 3 <> 0 THEN ssn END) AS transformed FROM people")
def count_transformed(spark, folder):
    some = people(spark, folder).withColumn("ssn", F.when(F.col("id") % 3 != 0, F.col("ssn")))
    return tk.count_transformed(some, fpe.encrypt("ssn", "ssn"))


@query(f"{PEOPLE} SELECT id, ssn AS clear, ssn AS token FROM people WHERE id % 4 IN (0, 1) ORDER BY id LIMIT 1")
def entitled_token_pair(spark, folder):
    clear = people(spark, folder)
    tokens = with_branch(tk.tokenize_table(clear))
    pair = token_pair(clear, tokens, entitlements(spark, "analyst"), "analyst")
    return pair.withColumn("token", fpe.decrypt("token", "ssn"))


@query(
    f"""{PEOPLE}, sizes AS (SELECT c AS "column", count(*) AS total, sum(octet_length(encode(v))) AS bytes, any_value(argument) AS argument
      FROM (SELECT 'ssn' AS c, ssn AS v, 3 AS argument FROM people UNION ALL SELECT 'email', email, 5 FROM people
            UNION ALL SELECT 'name', name, 4 FROM people UNION ALL SELECT 'dob', dob, 6 FROM people) GROUP BY c),
    averaged AS (SELECT "column", total, CAST(bytes AS DOUBLE) / CAST(total AS DOUBLE) AS average_bytes, argument FROM sizes),
    packed AS (SELECT *, CAST(floor(261900 / (average_bytes + argument + 6 + 2)) AS BIGINT) AS rows_per_request FROM averaged)
    SELECT "column", total, average_bytes, rows_per_request,
           CAST(ceil(CAST(total AS DOUBLE) / rows_per_request) AS BIGINT) AS requests,
           rows_per_request * average_bytes / 1000000 AS reply_mb FROM packed"""
)
def wire_profile(spark, folder):
    return tk.wire_profile(tk.tokenize_table(people(spark, folder)), ["ssn", "email", "name", "dob"])


@query(
    """SELECT CAST(0 AS BIGINT) AS over_rows, CAST(0 AS BIGINT) AS over_bytes, count(*) AS rows,
    CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents"""
)
def size_batches(spark, folder):
    """Documents packed into batches of at most 50 rows and 20,000 bytes; a larger document goes alone."""
    packed = tk.size_batches(table(spark, folder, "documents").select("doc_id", "text"), "text", 50, 20_000)
    batches = packed.groupBy("batch_partition", "batch").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")
    )
    return batches.agg(
        F.count_if(F.col("n") > 50).alias("over_rows"), F.count_if((F.col("b") > 20_000) & (F.col("n") > 1)).alias("over_bytes"),
        F.sum("n").alias("rows"), F.sum("b").alias("bytes"),
    )


# -- column functions ----------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT 'p_name' AS "column", 'name' AS element, p_name AS v, 4 AS need, '[^a-zA-Z]' AS other FROM part
      UNION ALL SELECT 'p_brand', 'digits', p_brand, 6, '[^0-9]' FROM part
      UNION ALL SELECT 'p_type', 'alnum', p_type, 4, '[^0-9a-zA-Z]' FROM part)
    SELECT "column", element, count(v) AS present,
      count(*) FILTER (WHERE length(regexp_replace(v, other, '', 'g')) < need) AS passed_through,
      CAST(0 AS BIGINT) AS with_capitals FROM v GROUP BY 1, 2"""
)
def short_values(spark, folder):
    return tk.short_value_report(table(spark, folder, "part"), {"p_name": "name", "p_brand": "digits", "p_type": "alnum"})


@query(
    """SELECT p_partkey, p_brand, CAST(length(regexp_replace(p_brand, '[^0-9]', '', 'g')) AS INTEGER) AS payload,
    length(regexp_replace(p_brand, '[^0-9]', '', 'g')) < 6 AS short, p_brand AS token_roundtrip,
    CASE WHEN length(regexp_replace(p_brand, '[^0-9]', '', 'g')) < 6 THEN p_brand END AS unchanged FROM part"""
)
def pass_through(spark, folder):
    short = native.passes_through("p_brand", "digits")
    token = fpe.encrypt("p_brand", "digits")
    return table(spark, folder, "part").select(
        "p_partkey", "p_brand", native.payload_length("p_brand", "digits").alias("payload"), short.alias("short"),
        fpe.decrypt(token, "digits").alias("token_roundtrip"), F.when(short, token).alias("unchanged"),
    )


def hmac_sql(value: str) -> str:
    key = DEMO_KEY.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value})))), 1, 16)"


@query(f"{PEOPLE} SELECT id, {hmac_sql('ssn')} AS ssn_token, {hmac_sql('email')} AS email_token FROM people")
def hmac_tokens(spark, folder):
    return people(spark, folder).select(
        "id", native.hmac_token("ssn").alias("ssn_token"), native.hmac_token_private("email", DEMO_KEY).alias("email_token")
    )


@query(f"SELECT doc_id, {hmac_sql('text')} AS token FROM documents")
def hmac_documents(spark, folder):
    """Whole texts, accents included."""
    return table(spark, folder, "documents").select("doc_id", native.hmac_token("text").alias("token"))


@query(
    f"""{PEOPLE} SELECT id, CASE WHEN id % 3 <> 0 THEN email END AS plain,
    CASE WHEN id % 3 <> 0 THEN 'noop_' || email END AS prefixed FROM people"""
)
def noop_values(spark, folder):
    some = people(spark, folder).withColumn("email", F.when(F.col("id") % 3 != 0, F.col("email")))
    return some.select("id", native.noop("email").alias("plain"), native.noop("email", prefixed=True).alias("prefixed"))


@query(f"{PEOPLE} SELECT id, CASE WHEN id % 3 <> 0 THEN ssn END AS ssn, CASE WHEN id % 5 = 0 THEN '' ELSE name END AS name FROM people")
def null_and_empty(spark, folder):
    gaps = people(spark, folder).select(
        "id", F.when(F.col("id") % 3 != 0, F.col("ssn")).alias("ssn"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.col("name")).alias("name"),
    )
    return tk.detokenize_table(tk.tokenize_table(gaps))


_MIXED = f"""{PEOPLE}, mixed AS (SELECT id, 'email' AS element, email AS v FROM people UNION ALL SELECT id, 'name', name FROM people
    UNION ALL SELECT id, NULL, ssn FROM people UNION ALL SELECT id, 'digits', dob FROM people)"""


@query(f"{_MIXED} SELECT id, element, v AS value, CAST(length(v) AS INTEGER) AS token_length FROM mixed")
def mixed_elements(spark, folder):
    """Elements mixed in one column; a missing element means the default."""
    stacked = people(spark, folder).select(
        "id", F.expr("stack(4, 'email', email, 'name', name, CAST(NULL AS STRING), ssn, 'digits', dob) AS (element, v)")
    )
    token = fpe.encrypt("v", F.col("element"))
    return stacked.withColumn("token", token).select(
        "id", "element", fpe.decrypt("token", F.col("element")).alias("value"), F.length("token").alias("token_length")
    )


@query(f"{PEOPLE} SELECT id, ssn AS clear, true AS moved FROM people")
def rotate_key(spark, folder):
    """Tokens moved to another key, tweak and element in one pass."""
    tokens = tk.tokenize_table(people(spark, folder), {"ssn": "ssn"}).select("id", "ssn")
    rotated = tokens.withColumn("new", fpe.reprotect("ssn", "ssn", "digits", new_key=ROTATED))
    return rotated.select("id", fpe.decrypt("new", "digits", ROTATED).alias("clear"), (F.col("new") != F.col("ssn")).alias("moved"))


@query(f"{PEOPLE} SELECT CAST(0 AS BIGINT) AS mismatches, count(*) AS checked, count(*) AS other_than_demo FROM people")
def session_key(spark, folder):
    """A key set for the session holds for columns, SQL functions and search terms alike; the demo key is not used."""
    spark.conf.set(KEY_CONF, ROTATED.key)
    try:
        sql.register(spark)
        tokens = people(spark, folder).select("ssn", fpe.encrypt("ssn", "ssn").alias("token"))
    finally:
        both = tokens.selectExpr("ssn", "token", "fpe_decrypt(token, 'ssn') AS back")
        spark.conf.unset(KEY_CONF)
        sql.register(spark)
    demo = fpe.encrypt("ssn", "ssn", TokenKey())
    return both.agg(
        F.count_if(F.col("back") != F.col("ssn")).alias("mismatches"), F.count("*").alias("checked"),
        F.count_if(F.col("token") != demo).alias("other_than_demo"),
    )


@query(
    f"""{PEOPLE} SELECT bits, count(*) AS people, CAST(0 AS BIGINT) AS mismatches FROM people, (SELECT unnest([128, 192, 256]) AS bits) GROUP BY bits"""
)
def key_lengths(spark, folder):
    """Round trips under keys of the three lengths."""
    clear = people(spark, folder).select("ssn")
    parts = []
    for bits in (128, 192, 256):
        key = TokenKey(key=(DEMO_KEY * 2)[: bits // 4])
        back = fpe.decrypt(fpe.encrypt("ssn", "ssn", key), "ssn", key)
        parts.append(clear.agg(F.lit(bits).alias("bits"), F.count("*").alias("people"), F.count_if(back != F.col("ssn")).alias("mismatches")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{PEOPLE} SELECT id, CASE WHEN id % 3 <> 0 THEN ssn END AS value FROM people")
def blank_elements(spark, folder):
    """An empty element means the default, as a missing one does; one that is unknown labels only NULLs here, and so
    is never looked up."""
    label = F.when(F.col("id") % 3 == 0, "no such element").when(F.col("id") % 3 == 1, "")
    rows = people(spark, folder).select("id", label.alias("e"), F.when(F.col("id") % 3 != 0, F.col("ssn")).alias("ssn"))
    token = rows.select("id", "e", fpe.encrypt("ssn", F.col("e")).alias("t"))
    return token.select("id", fpe.decrypt("t", "ssn").alias("value"))


@query(f"{PEOPLE} SELECT id, ssn AS clear, false AS same_token FROM people")
def external_tweak(spark, folder):
    tweak = bytes.fromhex("0A0B0C0D0E0F10")
    both = people(spark, folder).select(
        "id", fpe.encrypt("ssn", "ssn").alias("standard"), fpe.encrypt("ssn", "ssn", external_tweak=tweak).alias("tweaked")
    )
    return both.select(
        "id", fpe.decrypt("tweaked", "ssn", external_tweak=tweak).alias("clear"),
        (F.col("standard") == F.col("tweaked")).alias("same_token"),
    )


@query(
    """SELECT o_orderkey, o_orderkey + 100000000 AS number, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price,
    true AS typed_is_safe FROM orders"""
)
def typed_values(spark, folder):
    """Integers, dates and floating-point numbers protected through their text form and restored."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") + 100_000_000).alias("number"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").alias("price"),
    )
    held = rows.select(
        "o_orderkey", native.protect_typed("number", "bigint").alias("n"), native.protect_typed("day", "date").alias("d"),
        native.protect_typed("price", "double").alias("p"),
    )
    return held.select(
        "o_orderkey", native.unprotect_typed("n.token", "bigint").alias("number"), native.unprotect_typed("d.token", "date").alias("day"),
        native.unprotect_typed("p.token", "double").alias("price"),
        (F.col("n.typed").isNull() | (F.col("n.typed").cast("string") == F.col("n.token"))).alias("typed_is_safe"),
    )


@query(
    """SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, true AS typed, 1::BIGINT AS tokens, 0::BIGINT AS lost FROM orders GROUP BY 1"""
)
def typed_dates(spark, folder):
    """Orders by day, grouped on the day's token, which is itself a date, and restored after the grouping."""
    rows = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("clear")).withColumn("token", native.protect_typed("clear", "date")["typed"])
    days = rows.groupBy("token").agg(F.count("*").alias("orders"), F.min("clear").alias("least"), F.max("clear").alias("most"))
    back = days.withColumn("day", native.unprotect_typed("token", "date"))
    lost = F.count_if(~(F.col("least").eqNullSafe(F.col("day")) & F.col("most").eqNullSafe(F.col("day")))).alias("lost")
    return back.groupBy("day").agg(F.sum("orders").alias("orders"), F.bool_and(F.col("token").isNotNull()).alias("typed"), F.count("*").alias("tokens"), lost)


@query(
    """SELECT l_orderkey, l_partkey AS small, l_orderkey * 1000003 - 500000000 AS large, l_extendedprice AS price, true AS typed, true AS same_length, count(*) AS n
    FROM lineitem GROUP BY ALL"""
)
def typed_integers(spark, folder):
    """Small and large integers and doubles joined into groups by tokens of their own type, and restored."""
    clear = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_partkey").cast("bigint").alias("small"), (F.col("l_orderkey").cast("bigint") * 1_000_003 - 500_000_000).alias("large"),
        F.col("l_extendedprice").cast("double").alias("price"),
    )
    kinds = {"small": "bigint", "large": "bigint", "price": "double"}
    held = clear.select("l_orderkey", "large", *[native.protect_typed(c, k)["typed"].alias(f"{c}_token") for c, k in kinds.items()])
    length = lambda c: F.length(F.abs(c).cast("string"))
    kept = F.when(F.abs("large") >= 10**6, length(F.col("large")) == length(F.col("large_token"))).otherwise(True)
    groups = held.withColumn("same_length", kept).groupBy("l_orderkey", *[f"{c}_token" for c in kinds]).agg(F.count("*").alias("n"), F.bool_and("same_length").alias("same_length"))
    typed = reduce(and_, (F.col(f"{c}_token").isNotNull() for c in kinds))
    return groups.select("l_orderkey", *[native.unprotect_typed(f"{c}_token", k).alias(c) for c, k in kinds.items()], typed.alias("typed"), "same_length", "n")


@query("SELECT o_orderkey, o_orderpriority AS text, o_clerk_like AS data, true AS typed_is_safe FROM (SELECT *, 'clerk' || o_custkey AS o_clerk_like FROM orders)")
def typed_texts(spark, folder):
    """Text and binary values protected and restored in their own types."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("text"), F.encode(F.concat(F.lit("clerk"), "o_custkey"), "UTF-8").alias("data")
    )
    held = rows.select("o_orderkey", native.protect_typed("text", "string").alias("t"), native.protect_typed("data", "binary").alias("d"))
    return held.select(
        "o_orderkey", native.unprotect_typed("t.token", "string").alias("text"),
        F.decode(native.unprotect_typed("d.token", "binary"), "UTF-8").alias("data"),
        (F.decode("d.typed", "UTF-8").eqNullSafe(F.col("d.token")) & F.col("t.typed").eqNullSafe(F.col("t.token"))).alias("typed_is_safe"),
    )


@query(
    """SELECT o_orderkey, form, CAST(o_orderdate AS DATE) AS day FROM orders, (SELECT unnest(['y-m-d', 'y.m.d', 'm/d/y']) AS form)"""
)
def unpadded_dates(spark, folder):
    """Months and days of one digit."""
    forms = {"y-m-d": "yyyy-M-d", "y.m.d": "yyyy.M.d", "m/d/y": "M/d/yyyy"}
    written = table(spark, folder, "orders").select(
        "o_orderkey",
        F.explode(F.array(*[F.struct(F.lit(n).alias("form"), F.date_format("o_orderdate", f).alias("text")) for n, f in forms.items()])).alias("w"),
    )
    return written.select("o_orderkey", "w.form", native.parse_date("w.text", strict=True).alias("day"))


@query(
    f"""{PEOPLE}, tried AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '12-3' WHEN id % 4 = 2 THEN repeat('7', 60) ELSE ssn END AS v FROM people)
    SELECT step, CASE WHEN v IS NULL THEN 0 WHEN length(v) < 6 THEN 22 WHEN length(v) > 56 THEN 23 WHEN step = 'unprotect' THEN 8 ELSE 50 END AS code,
      count(*) AS n FROM tried, (SELECT unnest(['unprotect', 'reprotect']) AS step) GROUP BY 1, 2"""
)
def status_of_tokens(spark, folder):
    """Codes of reading tokens back and of moving them to another key: 8 and 50, 22 and 23, and 0 for nothing."""
    case = F.col("id") % 4
    value = F.when(case == 1, "12-3").when(case == 2, "7" * 60).when(case == 3, F.col("ssn"))
    tried = people(spark, folder).select(value.alias("v"))
    results = {
        "unprotect": native.protect_with_status("v", "ssn", operation="unprotect"),
        "reprotect": native.reprotect_with_status("v", "ssn", "digits", new_key=ROTATED),
    }
    parts = [tried.select(F.lit(step).alias("step"), r.alias("r")) for step, r in results.items()]
    return parts[0].unionByName(parts[1]).groupBy("step", F.col("r.code").alias("code")).agg(F.count("*").alias("n"))


_DUCK_FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%Y/%d/%m", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%Y%m%d", "%d.%m.%Y", "%Y.%m.%d"]
_SPARK_FORMATS = [re.sub(r"\b([Md])\b", r"\1\1", f) for f, _ in native.DATE_FORMATS]


@query(
    f"""WITH written AS (SELECT o_orderkey, CASE o_orderkey % 11
      {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_DUCK_FORMATS))} ELSE 'soon' END AS text FROM orders)
    SELECT o_orderkey, text, CAST(coalesce({', '.join(f"try_strptime(text, '{f}')" for f in _DUCK_FORMATS)}) AS DATE) AS day FROM written"""
)
def parsed_dates(spark, folder):
    """Dates written in ten formats and one that is none; the first format that fits wins."""
    orders = table(spark, folder, "orders")
    text = F.lit("soon")
    for i, fmt in enumerate(_SPARK_FORMATS):
        text = F.when(F.col("o_orderkey") % 11 == i, F.date_format("o_orderdate", fmt)).otherwise(text)
    written = orders.select("o_orderkey", text.alias("text"))
    return written.select("*", native.parse_date("text").alias("day"))


@query(
    """SELECT doc_id, to_base64(encode(text)) AS encoded, text AS utf8, text AS utf16le, text AS utf16be,
    true AS same_length FROM documents"""
)
def charset_codecs(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = docs.select(
        "doc_id", native.text_to_base64("text").alias("encoded"), native.text_to_base64("text", "UTF-16LE").alias("le"),
        native.text_to_base64("text", "UTF-16BE").alias("be"),
    )
    return coded.select(
        "doc_id", "encoded", native.base64_to_text("encoded").alias("utf8"),
        native.base64_to_text("le", "UTF-16LE").alias("utf16le"), native.base64_to_text("be", "UTF-16BE").alias("utf16be"),
        (F.length("le") == F.length("be")).alias("same_length"),
    )


@query(
    """WITH cards AS (SELECT o_orderkey, (4000 + o_orderkey % 1000) || s || (1000 + o_custkey % 9000) || s ||
        (1000 + (o_orderkey * 7919) % 9000) || s || (1000 + (o_orderkey * 104729) % 9000) AS card
      FROM (SELECT *, (['', ' ', '-'])[CAST(o_orderkey % 3 AS INTEGER) + 1] AS s FROM orders))
    SELECT o_orderkey, card, regexp_replace(card, '[0-9]', '9', 'g') AS shape FROM cards"""
)
def card_numbers(spark, folder):
    """Card numbers with and without separators; the separators stay in place."""
    key = F.col("o_orderkey")
    groups = [4000 + key % 1000, 1000 + F.col("o_custkey") % 9000, 1000 + (key * 7919) % 9000, 1000 + (key * 104729) % 9000]
    text = [g.cast("string") for g in groups]
    sign = F.get(F.array(F.lit(""), F.lit(" "), F.lit("-")), (key % 3).cast("int"))
    cards = table(spark, folder, "orders").select(
        "o_orderkey", F.concat(text[0], sign, text[1], sign, text[2], sign, text[3]).alias("card")
    )
    tokens = cards.select("o_orderkey", fpe.encrypt("card", "ccn").alias("token"))
    return tokens.select("o_orderkey", fpe.decrypt("token", "ccn").alias("card"), F.regexp_replace("token", "[0-9]", "9").alias("shape"))


@query(
    """WITH sized AS (SELECT doc_id, length(regexp_replace(text, '[^0-9a-zA-Z]', '', 'g')) AS alnum,
        length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, text FROM documents),
      coded AS (SELECT 'alnum' AS element, CASE WHEN alnum < 4 THEN 22 WHEN alnum > 32 THEN 23 ELSE 6 END AS code FROM sized
        UNION ALL SELECT 'digits', CASE WHEN digits < 6 THEN 22 WHEN digits > 56 THEN 23 ELSE 6 END FROM sized)
    SELECT element, code, count(*) AS texts, CASE WHEN code = 23 THEN 0 ELSE count(*) END AS with_value FROM coded GROUP BY element, code"""
)
def status_codes(spark, folder):
    """Whole documents as values: most are beyond what FF3-1 can hold, and say so."""
    docs = table(spark, folder, "documents")
    results = [
        docs.select(F.lit(e).alias("element"), native.protect_with_status("text", e).alias("r")) for e in ("alnum", "digits")
    ]
    both = results[0].unionByName(results[1])
    return both.groupBy("element", F.col("r.code").alias("code")).agg(
        F.count("*").alias("texts"), F.count("r.value").alias("with_value")
    )


@query(
    f"""{PEOPLE}, named AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' WHEN id % 7 = 2 THEN 'no such element' WHEN id % 7 = 3 THEN 'SSN' ELSE 'ssn' END AS element,
      CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN '12-3' ELSE ssn END AS v FROM people)
    SELECT coalesce(element, '(none)') AS element, CASE WHEN v IS NULL THEN 0 WHEN element IN ('no such element', 'SSN') THEN 2 WHEN length(v) < 6 THEN 22 ELSE 6 END AS code,
      count(*) AS n, count(CASE WHEN element IN ('no such element', 'SSN') THEN NULL ELSE v END) AS with_value, true AS restored FROM named GROUP BY 1, 2"""
)
def unknown_elements(spark, folder):
    """Rows whose element does not exist get a status; the job and the other rows go on."""
    seventh, fifth = F.col("id") % 7, F.col("id") % 5
    name = F.when(seventh == 1, "").when(seventh == 2, "no such element").when(seventh == 3, "SSN").when(seventh > 3, "ssn")
    rows = people(spark, folder).select(name.alias("element"), F.when(fifth == 1, "12-3").when(fifth > 1, F.col("ssn")).alias("v"))
    held = rows.withColumn("r", native.protect_each_with_status("v", "element"))
    back = held.withColumn("b", native.protect_each_with_status("r.value", "element", operation="unprotect"))
    right = F.bool_and((F.col("r.code") == native.UNKNOWN_ELEMENT) | F.col("b.value").eqNullSafe(F.col("v"))).alias("restored")
    return back.groupBy(F.coalesce("element", F.lit("(none)")).alias("element"), F.col("r.code").alias("code")).agg(
        F.count("*").alias("n"), F.count("r.value").alias("with_value"), right
    )
