"""Queries through entitlements: masks, row filters, governed views, lookups, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fpe, sql
from ..operators import govern
from ..operators.tokens import tokenize_table
from ..session import shared_path
from ..sources.pii import with_branch
from ..sources.tables import create_table_as, table
from .base import PEOPLE, people, people_sql, query
from .token_queries import hmac_sql, stored_tokens

USER = "analyst"


def branched(spark, folder):
    return with_branch(stored_tokens(spark, folder))


def uneven_policy(spark):
    """Flags that differ by branch, a duplicate grant and another user's grant."""
    parts = [
        govern.entitlements(spark, USER, (0,)),
        govern.entitlements(spark, USER, (1,), ssn=False, email=True),
        govern.entitlements(spark, USER, (1,), ssn=False, email=True),
        govern.entitlements(spark, "other", (2,), email=True),
    ]
    policy = parts[0]
    for p in parts[1:]:
        policy = policy.unionByName(p)
    return policy


@query(
    f"""{PEOPLE} SELECT '{USER}' AS user_email, CAST(b AS INTEGER) AS branch_id, true AS can_see_ssn, false AS can_see_email,
    true AS can_see_name, (SELECT count(*) FROM people WHERE id % 4 = b) AS rows_in_branch FROM (SELECT unnest([0, 1]) AS b)"""
)
def entitled_branches(spark, folder):
    rows = branched(spark, folder).groupBy("branch_id").agg(F.count("*").alias("rows_in_branch"))
    return govern.entitlements(spark, USER).join(rows, "branch_id")


_MASKED = f"""{PEOPLE} SELECT id, CAST(id % 4 AS INTEGER) AS branch_id,
    CASE WHEN id % 4 IN (0, 1) THEN ssn ELSE '***-**-****' END AS ssn FROM people"""


@query(_MASKED)
def mask_one_column(spark, folder):
    return govern.mask_one(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(_MASKED)
def mask_one_union(spark, folder):
    return govern.mask_one_union(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(_MASKED)
def mask_one_case(spark, folder):
    return govern.mask_one_case(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(f"{PEOPLE} SELECT id, CAST(id % 4 AS INTEGER) AS branch_id, ssn FROM people WHERE id % 4 IN (0, 1)")
def row_filter(spark, folder):
    return govern.filter_rows(branched(spark, folder), govern.entitlements(spark, USER), USER)


_THREE = f"""{PEOPLE} SELECT id, CAST(id % 4 AS INTEGER) AS branch_id, ssn, '***@***' AS email, name FROM people
    WHERE id % 4 IN (0, 1)"""


@query(_THREE)
def mask_three_columns(spark, folder):
    return govern.governed_view(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(_THREE)
def mask_three_case(spark, folder):
    return govern.governed_view_case(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(
    f"""{PEOPLE} SELECT id, CAST(id % 4 AS INTEGER) AS branch_id, CASE id % 4 WHEN 0 THEN ssn ELSE '***-**-****' END AS ssn,
    CASE id % 4 WHEN 1 THEN email ELSE '***@***' END AS email, name FROM people WHERE id % 4 IN (0, 1)"""
)
def grants_by_row(spark, folder):
    """Uneven grants: the flag of the row's own branch decides; duplicates do not multiply rows."""
    return govern.governed_view(branched(spark, folder), uneven_policy(spark), USER, scope="row")


@query(f"{PEOPLE} SELECT id, CAST(id % 4 AS INTEGER) AS branch_id, ssn, email, name FROM people WHERE id % 4 IN (0, 1)")
def grants_by_user(spark, folder):
    """Uneven grants: a flag granted anywhere counts everywhere."""
    return govern.governed_view(branched(spark, folder), uneven_policy(spark), USER, scope="user")


@query(
    f"""{PEOPLE} SELECT id, CAST(id % 4 AS INTEGER) AS branch_id, CASE WHEN id % 3 = 0 THEN '***-**-****' ELSE ssn END AS ssn,
    '***@***' AS email, name FROM people WHERE id % 4 IN (0, 1)"""
)
def nulls_as_masks(spark, folder):
    gaps = branched(spark, folder).withColumn("ssn", F.when(F.col("id") % 3 != 0, F.col("ssn")))
    return govern.governed_view(gaps, govern.entitlements(spark, USER), USER, mask_nulls=True)


@query(f"{PEOPLE} SELECT CAST(id % 4 AS INTEGER) AS branch_id, count(*) AS rows FROM people WHERE id % 4 = 0 GROUP BY 1")
def visible_rows(spark, folder):
    """Rows where the uneven policy grants the personal number."""
    seen = govern.visible_rows(branched(spark, folder), uneven_policy(spark), USER, "ssn")
    return seen.groupBy("branch_id").agg(F.count("*").alias("rows"))


_NAMES = f"{PEOPLE} SELECT id, name FROM people WHERE id % 4 IN (0, 1)"


@query(_NAMES)
def decode_distinct(spark, folder):
    return govern.decode_distinct(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(_NAMES)
def decode_every(spark, folder):
    return govern.decode_every(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(_NAMES)
def decode_by_share(spark, folder):
    return govern.decode(branched(spark, folder), govern.entitlements(spark, USER), USER)


@query(_NAMES)
def decode_by_sketch(spark, folder):
    """The choice is made from sketches by branch, stored beside the token table."""
    rows = branched(spark, folder)
    sketches = create_table_as(govern.branch_sketches(rows), shared_path(spark, "sketches"))
    return govern.decode(rows, govern.entitlements(spark, USER), USER, sketches=sketches)


@query(f"{PEOPLE} SELECT id, CAST(id % 4 AS INTEGER) AS branch_id, ssn FROM people WHERE ssn = '100-10-1000' AND id % 4 IN (0, 1)")
def lookup_by_token(spark, folder):
    """One person's record (customer 0), if the user may see it."""
    view = govern.lookup_view(branched(spark, folder), govern.entitlements(spark, USER), USER)
    return view.filter(F.col("ssn_token") == fpe.token_of("100-10-1000", "ssn")).drop("ssn_token")


@query(
    f"""{PEOPLE} SELECT 'mask' AS shapes, CAST(0 AS BIGINT) AS mismatches, count(*) AS compared FROM people
    UNION ALL SELECT 'three', 0, count(*) FROM people WHERE id % 4 IN (0, 1)
    UNION ALL SELECT 'distinct', 0, count(*) FROM people WHERE id % 4 IN (0, 1)
    UNION ALL SELECT 'unlike', count(*), count(*) FROM people"""
)
def equivalence_audit(spark, folder):
    """Fast shapes against slow ones, and one pair that differs everywhere to show that the audit sees it."""
    rows, policy = branched(spark, folder), govern.entitlements(spark, USER)
    pairs = {
        "mask": (govern.mask_one(rows, policy, USER), govern.mask_one_case(rows, policy, USER), ["ssn"]),
        "three": (govern.governed_view(rows, policy, USER), govern.governed_view_case(rows, policy, USER), ["ssn", "email", "name"]),
        "distinct": (govern.decode_distinct(rows, policy, USER), govern.decode_every(rows, policy, USER), ["name"]),
        "unlike": (rows.select("id", "ssn"), people(spark, folder).select("id", "ssn"), ["ssn"]),
    }
    audits = [govern.equivalence_audit(l, r, c).select(F.lit(n).alias("shapes"), "*") for n, (l, r, c) in pairs.items()]
    result = audits[0]
    for audit in audits[1:]:
        result = result.unionByName(audit)
    return result


@query(
    """WITH l AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem), r AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber <> 2
        UNION ALL SELECT l_orderkey, l_partkey, l_quantity + 1 FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 50 = 0
        UNION ALL SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 50 <> 0 AND l_orderkey % 70 <> 0),
    nets AS (SELECT l_orderkey, sum(s) AS net, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) AS b
        FROM (SELECT *, 1 AS s FROM l UNION ALL SELECT *, -1 FROM r) GROUP BY l_orderkey, l_partkey, l_quantity),
    keys AS (SELECT greatest(sum(greatest(net, 0)), sum(greatest(-net, 0))) AS off, greatest(sum(a), sum(b)) AS held FROM nets GROUP BY l_orderkey)
    SELECT 'itself' AS against, 0::BIGINT AS mismatches, count(*) AS compared FROM l
    UNION ALL SELECT 'edited', CAST(sum(off) AS BIGINT), CAST(sum(held) AS BIGINT) FROM keys"""
)
def repeated_keys_audit(spark, folder):
    """Order lines by order, which stands on several rows: against themselves, and with lines changed and lines missing."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    second, order = F.col("l_linenumber") == 2, F.col("l_orderkey")
    edited = lines.where(~second | (order % 50 == 0) | (order % 70 != 0)).withColumn("l_quantity", F.col("l_quantity") + F.when(second & (order % 50 == 0), 1).otherwise(0))
    audits = [
        govern.equivalence_audit(lines, other, ["l_partkey", "l_quantity"], "l_orderkey").select(F.lit(name).alias("against"), "*")
        for name, other in (("itself", lines.repartition(3, "l_partkey")), ("edited", edited))
    ]
    return audits[0].unionByName(audits[1])


@query(
    """SELECT user_email, element, operation, count(*) AS requests, user_email <> 'stranger' AND (operation = 'protect'
      OR user_email = 'other' OR element <> 'email' OR user_email = 'analyst') AND (user_email <> 'narrow' OR operation = 'protect' OR element = 'name') AS allowed
    FROM (SELECT (['analyst', 'other', 'narrow', 'stranger'])[CAST(o_orderkey % 4 AS INTEGER) + 1] AS user_email,
                 (['ssn', 'email', 'name'])[CAST(o_custkey % 3 AS INTEGER) + 1] AS element,
                 (['protect', 'unprotect', 'reprotect'])[CAST((o_orderkey // 4) % 3 AS INTEGER) + 1] AS operation FROM orders)
    GROUP BY user_email, element, operation"""
)
def access_check(spark, folder):
    """Every order is a request by some user for an element and an operation."""
    policy = uneven_policy(spark).unionByName(govern.entitlements(spark, "narrow", (3,), ssn=False))

    def pick(values, at):
        return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))

    requests = table(spark, folder, "orders").select(
        pick(("analyst", "other", "narrow", "stranger"), F.col("o_orderkey") % 4).alias("user_email"),
        pick(("ssn", "email", "name"), F.col("o_custkey") % 3).alias("element"),
        pick(govern.OPERATIONS, F.floor(F.col("o_orderkey") / 4) % 3).alias("operation"),
    )
    checked = govern.check_access(requests, govern.access_rules(policy))
    return checked.groupBy("user_email", "element", "operation", "allowed").agg(F.count("*").alias("requests"))


@query(
    f"""{PEOPLE} SELECT id, regexp_replace(ssn, '[0-9]', '9', 'g') AS shape, ssn, true AS same_token,
    {hmac_sql('email')} AS email_token, name AS name FROM people"""
)
def sql_functions(spark, folder):
    """The functions registered for SQL, over a view of a stored token table."""
    sql.register(spark)
    stored_tokens(spark, folder).createOrReplaceTempView("cloak_tokens")
    return spark.sql(
        """SELECT id, regexp_replace(ssn, '[0-9]', '9') AS shape, fpe_decrypt(ssn, NULL) AS ssn,
        fpe_encrypt(fpe_decrypt(email, 'email'), 'email') = email AS same_token,
        hmac_token(fpe_decrypt(email, 'email')) AS email_token, noop(fpe_decrypt(name, 'name')) AS name FROM cloak_tokens"""
    )


# -- a table of another shape: five governed columns, own branch name, columns that nobody governs --------

_STAFF_ELEMENTS = {"name": "name", "email": "email", "ssn": "ssn", "dob": "digits", "phone": "phone"}
_STAFF_MASKS = {"phone": "(hidden)", "dob": "****-**-**"}
_STAFF_SQL = f"""WITH staff AS (SELECT *, CAST(id % 4 AS INTEGER) AS region, CAST(2000000000 + id * 37 AS VARCHAR) AS phone FROM ({people_sql(keep=', c_mktsegment')}) AS p)
    SELECT id, CASE WHEN region = 0 THEN name ELSE '***' END AS name, CASE WHEN region = 1 THEN email ELSE '***@***' END AS email,
      CASE WHEN region = 0 THEN ssn ELSE '***-**-****' END AS ssn, CASE WHEN region = 1 THEN dob ELSE '****-**-**' END AS dob,
      c_mktsegment, region, CASE WHEN region = 1 THEN phone ELSE '(hidden)' END AS phone FROM staff WHERE region IN (0, 1)"""


def _staff(spark, folder):
    """Tokens of customers with a phone number, a segment and a region, and the grants on them."""
    clear = people(spark, folder, ("c_mktsegment",)).select(
        "*", (F.col("id") % 4).cast("int").alias("region"), (2_000_000_000 + F.col("id") * 37).cast("string").alias("phone")
    )
    held = tokenize_table(clear, _STAFF_ELEMENTS)
    flags = {0: ("name", "ssn"), 1: ("email", "dob", "phone")}
    policy = None
    for region, seen in flags.items():
        row = spark.range(1).select(
            F.session_user().alias("user_email"), F.lit(region).alias("region"),
            *[F.lit(c in seen).alias(f"can_see_{c}") for c in _STAFF_ELEMENTS],
        )
        policy = row if policy is None else policy.unionByName(row)
    return held, policy


@query(_STAFF_SQL)
def governed_columns(spark, folder):
    """Any columns by their elements, with own masks and branch name; ungoverned columns stay."""
    held, policy = _staff(spark, folder)
    return govern.governed_view(held, policy, F.session_user(), _STAFF_ELEMENTS, masks=_STAFF_MASKS, branch="region", keep=None)


@query(_STAFF_SQL.replace("WHERE region IN (0, 1)", "WHERE region IN (0, 1) AND c_mktsegment = 'BUILDING'"))
def governed_sql_view(spark, folder):
    """The same as a view that SQL filters."""
    held, policy = _staff(spark, folder)
    govern.create_governed_view(
        spark, "governed_staff", held, policy, columns=_STAFF_ELEMENTS, masks=_STAFF_MASKS, branch="region", keep=None
    )
    return spark.sql("SELECT * FROM governed_staff WHERE c_mktsegment = 'BUILDING'")
