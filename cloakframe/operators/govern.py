"""Row- and column-level access over token tables, driven by an entitlement table.

Entitlements: (user_email, branch_id, can_see_<column> BOOLEAN ...).  They are reduced to one row per
branch before any join, so a duplicate grant cannot multiply rows.  The join side is a user's branches;
its size is left to Catalyst, which broadcasts it when small.  Decryption comes last, and a value nobody
may see reaches the function only as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fpe, native
from ..functions.keys import TokenKey
from ..session import settle
from .tokens import element_of_column

GOVERNED = ("ssn", "email", "name")


def entitlements(
    spark: SparkSession, user: str | None = None, branches: tuple[int, ...] = (0, 1), **flags: bool
) -> DataFrame:
    """Grants of one user over some branches: ssn and name in clear, e-mail masked, unless told otherwise.
    Without ``user`` the session's own user is entered."""
    grants = {"ssn": True, "email": False, "name": True, **flags}
    who = F.lit(user) if user is not None else F.session_user()
    return spark.range(1).select(
        who.alias("user_email"),
        F.explode(F.array(*[F.lit(b) for b in branches])).alias("branch_id"),
        *[F.lit(v).alias(f"can_see_{c}") for c, v in grants.items()],
    )


def grants_of(policy: DataFrame, user: str | Column, columns: tuple[str, ...] = GOVERNED, branch: str = "branch_id") -> DataFrame:
    """One row per branch the user may see, flags combined over duplicate grants.  ``user`` may be a column
    such as ``session_user()``."""
    return (
        policy.filter(F.col("user_email") == user)
        .groupBy(branch)
        .agg(*[F.coalesce(F.bool_or(f"can_see_{c}"), F.lit(False)).alias(f"can_see_{c}") for c in columns])
    )


def _branches(policy: DataFrame, user: str, column: str | None = None) -> DataFrame:
    granted = grants_of(policy, user)
    return (granted.filter(f"can_see_{column}") if column else granted).select("branch_id")


def _decoded(column: str, granted: Column, key: TokenKey | None, name: str | None = None, mask: str | None = None) -> Column:
    """Clear value where granted (NULL stays NULL), mask elsewhere."""
    name = name or element_of_column(column)
    hidden = native.mask(name) if mask is None else F.lit(mask)
    return F.when(granted, fpe.decrypt(F.when(granted, F.col(column)), name, key)).otherwise(hidden)


def visible_rows(df: DataFrame, policy: DataFrame, user: str, column: str | None = None) -> DataFrame:
    """Rows of the user's branches, or of those where ``column`` is granted.  Nothing is decrypted."""
    return df.join(_branches(policy, user, column), "branch_id", "left_semi")


def mask_one_case(df: DataFrame, policy: DataFrame, user: str, column: str = "ssn", key: TokenKey | None = None) -> DataFrame:
    """All rows, one column masked, in the left-join-and-CASE shape: every row is decrypted.  Kept as the
    comparison for :func:`mask_one`."""
    granted = F.col(f"can_see_{column}")
    joined = df.join(grants_of(policy, user, (column,)), "branch_id", "left")
    clear = fpe.decrypt(column, element_of_column(column), key)
    return joined.select("id", "branch_id", F.when(granted, clear).otherwise(native.mask(column)).alias(column))


def mask_one_union(df: DataFrame, policy: DataFrame, user: str, column: str = "ssn", key: TokenKey | None = None) -> DataFrame:
    """All rows, one column masked: entitled rows decrypted, the rest given the mask.  Scans twice."""
    granted = _branches(policy, user, column)
    clear = df.join(granted, "branch_id", "left_semi").select(
        "id", "branch_id", fpe.decrypt(column, element_of_column(column), key).alias(column)
    )
    hidden = df.join(granted, "branch_id", "left_anti").select("id", "branch_id", native.mask(column).alias(column))
    return clear.unionByName(hidden)


def mask_one(df: DataFrame, policy: DataFrame, user: str, column: str = "ssn", key: TokenKey | None = None) -> DataFrame:
    """All rows, one column masked, in one scan: the grant decides inside the function's argument."""
    granted = F.coalesce(F.col(f"can_see_{column}"), F.lit(False))
    joined = df.join(grants_of(policy, user, (column,)), "branch_id", "left")
    return joined.select("id", "branch_id", _decoded(column, granted, key).alias(column))


def filter_rows(df: DataFrame, policy: DataFrame, user: str, column: str = "ssn", key: TokenKey | None = None) -> DataFrame:
    """Only rows where the column is granted, decrypted."""
    return visible_rows(df, policy, user, column).select(
        "id", "branch_id", fpe.decrypt(column, element_of_column(column), key).alias(column)
    )


def governed_view(
    df: DataFrame, policy: DataFrame, user: str | Column, columns: tuple[str, ...] | dict[str, str] = GOVERNED, scope: str = "row",
    mask_nulls: bool = False, key: TokenKey | None = None, *, masks: dict[str, str] | None = None,
    branch: str = "branch_id", keep: tuple[str, ...] | None = ("id",),
) -> DataFrame:
    """The user's rows, each governed column clear or masked.

    ``columns`` may map each column to its element; ``masks`` may give a column its own mask.  ``keep`` names the
    ungoverned columns to show beside the branch, None all of them, in the table's order.  ``scope="row"`` takes the
    flag of the row's own branch; ``scope="user"`` a flag granted on any branch.  A NULL value stays NULL;
    ``mask_nulls`` shows the mask instead."""
    elements = dict(columns) if isinstance(columns, dict) else {c: element_of_column(c) for c in columns}
    granted = grants_of(policy, user, tuple(elements), branch)
    flags = {c: f"can_see_{c}" for c in elements}
    if scope == "user":
        anywhere = granted.agg(*[F.bool_or(f).alias(f) for f in flags.values()]).first()
        granted = granted.select(branch, *[F.lit(bool(anywhere[f])).alias(f) for f in flags.values()])
    elif scope != "row":
        raise ValueError(f"scope must be row or user, got {scope!r}")
    # the grants come under names of their own, so a table may have columns named like flags
    joined = df.join(granted.withColumnsRenamed({f: f"_granted_{c}" for c, f in flags.items()}), branch)
    shown = {c: _decoded(c, F.col(f"_granted_{c}"), key, e, (masks or {}).get(c)) for c, e in elements.items()}
    if mask_nulls:
        hidden = {c: F.lit(masks[c]) if c in (masks or {}) else native.mask(e) for c, e in elements.items()}
        shown = {c: F.coalesce(v, hidden[c]) for c, v in shown.items()}
    if keep is None:
        return joined.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in df.columns])
    return joined.select(*keep, branch, *[v.alias(c) for c, v in shown.items()])


def create_governed_view(spark: SparkSession, name: str, df: DataFrame, policy: DataFrame, user: str | Column | None = None, **shape) -> None:
    """The same as a temporary view for SQL; without ``user`` it shows what the session's own user may see."""
    governed_view(df, policy, F.session_user() if user is None else user, **shape).createOrReplaceTempView(name)


def governed_view_case(
    df: DataFrame, policy: DataFrame, user: str, columns: tuple[str, ...] = GOVERNED, key: TokenKey | None = None
) -> DataFrame:
    """One plain CASE per column; every visible row is decrypted.  Comparison for :func:`governed_view`."""
    joined = df.join(grants_of(policy, user, columns), "branch_id")
    return joined.select(
        "id", "branch_id",
        *[
            F.when(F.col(f"can_see_{c}"), fpe.decrypt(c, element_of_column(c), key))
            .otherwise(native.mask(element_of_column(c))).alias(c)
            for c in columns
        ],
    )


def decode_every(df: DataFrame, policy: DataFrame, user: str, column: str = "name", key: TokenKey | None = None) -> DataFrame:
    """Entitled rows decrypted row by row.  A task still works once on a value repeated in its batch."""
    return visible_rows(df, policy, user, column).select("id", fpe.decrypt(column, element_of_column(column), key).alias(column))


def decode_distinct(df: DataFrame, policy: DataFrame, user: str, column: str = "name", key: TokenKey | None = None) -> DataFrame:
    """Entitled rows, each distinct token decrypted once and joined back.  Pays off when values are few."""
    rows = visible_rows(df, policy, user, column).select("id", F.col(column).alias("token"))
    decoded = rows.select("token").distinct().withColumn(column, fpe.decrypt("token", element_of_column(column), key))
    joined = rows.join(decoded, rows["token"].eqNullSafe(decoded["token"]))
    return joined.select("id", column)


DISTINCT_SHARE = 0.01  # below this share of distinct values the join back is cheaper than decoding


def branch_sketches(df: DataFrame, column: str = "name", branch: str = "branch_id") -> DataFrame:
    """(branch, total, sketch): values and a HyperLogLog sketch of the distinct tokens of each branch, to be stored
    beside the token table.  Sketches of several branches unite, so the rows that a user may see need not be read to know
    how many values they hold; a branch that grows gets a sketch of the new rows, united likewise."""
    return df.groupBy(branch).agg(F.count(column).alias("total"), F.hll_sketch_agg(column).alias("sketch"))


def decode(
    df: DataFrame, policy: DataFrame, user: str, column: str = "name", key: TokenKey | None = None, sketches: DataFrame | None = None
) -> DataFrame:
    """Decode row by row, unless the rows the user may see hold more distinct values than a worker remembers
    and these are a small share of them: then join back.  The same rows either way.  With stored ``sketches``
    (:func:`branch_sketches`) the choice reads these, a row a branch; without, it counts over the entitled rows first."""
    if sketches is None:
        seen = visible_rows(df, policy, user, column).agg(F.approx_count_distinct(column).alias("distinct"), F.count(column).alias("total")).first()
    else:
        united = visible_rows(sketches, policy, user, column).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("total").alias("total"))
        seen = united.select(F.hll_sketch_estimate("sketch").alias("distinct"), F.coalesce("total", F.lit(0)).alias("total")).first()
    join_back = fpe.RECALLED_VALUES < seen["distinct"] < DISTINCT_SHARE * seen["total"]
    return (decode_distinct if join_back else decode_every)(df, policy, user, column, key)


def lookup_view(df: DataFrame, policy: DataFrame, user: str, column: str = "ssn", key: TokenKey | None = None) -> DataFrame:
    """Entitled rows with the token beside the clear value.  A filter on ``<column>_token`` is pushed below
    the decryption and into the scan, so a point lookup decrypts one row."""
    return visible_rows(df, policy, user, column).select(
        "id", "branch_id", F.col(column).alias(f"{column}_token"),
        fpe.decrypt(column, element_of_column(column), key).alias(column),
    )


def token_pair(clear: DataFrame, tokens: DataFrame, policy: DataFrame, user: str, column: str = "ssn") -> DataFrame:
    """One (clear, token) pair from an entitled branch: the smallest id."""
    entitled = visible_rows(tokens, policy, user).select("id", F.col(column).alias("token"))
    return clear.select("id", F.col(column).alias("clear")).join(entitled, "id").orderBy("id").limit(1)


AUDIT_BUCKETS = 4096


def _digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of each bucket of keys the number of rows and two sums of row hashes: equal multisets of rows have equal sums, in
    whatever order they stand, and partial sums add up before they are shuffled."""
    wide = lambda *seed: F.sum(F.xxhash64(*seed, *columns).cast("decimal(38,0)"))
    return rows.groupBy("_bucket").agg(F.count("*").alias("n"), wide().alias("one"), wide(F.lit(1)).alias("other"))


def equivalence_audit(left: DataFrame, right: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Whether two results are the same multiset of rows: ``mismatches`` and ``compared`` (NULL equals NULL).

    Both sides are summed to a digest for each bucket of keys, and only the rows of buckets whose digests differ are
    brought together, so equal results shuffle sums and no rows.  A key may stand on several rows: of its rows
    on either side those without an equal partner count, the larger number of both; compared are its rows on the side that has more.
    So one row a key gives the keys that differ or are missing, of all keys.  The digests are worked out at once."""
    sides = {
        name: df.select(key, *columns).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(AUDIT_BUCKETS)))
        for name, df in (("l", left), ("r", right))
    }
    told = {name: _digests(rows, [key, *columns]).select("_bucket", F.struct("n", "one", "other").alias(name)) for name, rows in sides.items()}
    buckets = settle(told["l"].join(told["r"], "_bucket", "full_outer").withColumn("_same", F.col("l").eqNullSafe(F.col("r"))), "digests")
    same = buckets.where("_same").agg(F.coalesce(F.sum("l.n"), F.lit(0)).alias("same"))
    differing = buckets.where("NOT _same").select("_bucket")
    open_rows = [rows.join(differing, "_bucket", "left_semi").drop("_bucket").withColumn("_net", F.lit(sign)) for rows, sign in zip(sides.values(), (1, -1))]
    nets = open_rows[0].unionByName(open_rows[1]).groupBy(key, *columns).agg(
        F.sum("_net").alias("_net"), F.count_if(F.col("_net") > 0).alias("_l"), F.count_if(F.col("_net") < 0).alias("_r")
    )
    keys = nets.groupBy(key).agg(
        F.greatest(F.sum(F.greatest("_net", F.lit(0))), F.sum(F.greatest(-F.col("_net"), F.lit(0)))).alias("_off"),
        F.greatest(F.sum("_l"), F.sum("_r")).alias("_rows"),
    )
    counts = keys.agg(F.coalesce(F.sum("_off"), F.lit(0)).alias("mismatches"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("_compared"))
    return counts.join(same).select("mismatches", (F.col("_compared") + F.col("same")).alias("compared"))


OPERATIONS = ("protect", "unprotect", "reprotect")


def access_rules(policy: DataFrame, columns: tuple[str, ...] = GOVERNED) -> DataFrame:
    """(user_email, element, operation, allowed): protecting is open to any listed user, reading back and
    re-protecting need the column's flag on some branch."""
    flags = policy.groupBy("user_email").agg(*[F.bool_or(f"can_see_{c}").alias(c) for c in columns])
    return flags.select(
        "user_email",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(element_of_column(c)).alias("element"), F.lit(o).alias("operation"),
                        (F.lit(True) if o == "protect" else F.col(c)).alias("allowed"),
                    )
                    for c in columns
                    for o in OPERATIONS
                ]
            )
        ).alias("rule"),
    ).select("user_email", "rule.*")


def check_access(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests (user_email, element, operation) with ``allowed``; anything without a rule is refused."""
    known = rules.groupBy("user_email", "element", "operation").agg(F.bool_or("allowed").alias("allowed"))
    joined = requests.join(known, ["user_email", "element", "operation"], "left")
    return joined.withColumn("allowed", F.coalesce("allowed", F.lit(False)))
