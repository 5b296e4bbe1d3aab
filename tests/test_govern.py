"""Access rules, and plans that keep values away from the decryption."""

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import fpe
from cloakframe.operators import govern, search, tokens as tk
from cloakframe.session import shared_path
from cloakframe.sources.pii import mock_pii, with_branch
from cloakframe.sources.tables import create_table_as

USER = "u"


@pytest.fixture(scope="module")
def clear(spark):
    return mock_pii(spark, 400).cache()


@pytest.fixture(scope="module")
def held(spark, clear):
    return with_branch(create_table_as(tk.tokenize_table(clear), shared_path(spark, "held")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicate_grants_do_not_multiply_rows(spark, held):
    policy = govern.entitlements(spark, USER)
    doubled = policy.unionByName(policy)
    for view in (govern.mask_one, govern.mask_one_union, govern.filter_rows, govern.governed_view, govern.decode_distinct, govern.lookup_view):
        assert view(held, doubled, USER).count() == view(held, policy, USER).count()


def test_no_grant_shows_nothing(spark, held):
    policy = govern.entitlements(spark, "someone else")
    assert govern.governed_view(held, policy, USER).count() == 0
    assert {r["ssn"] for r in govern.mask_one(held, policy, USER).collect()} == {"***-**-****"}
    assert govern.governed_view(held, policy, USER, scope="user").count() == 0


def test_scope_must_be_known(spark, held):
    with pytest.raises(ValueError):
        govern.governed_view(held, govern.entitlements(spark, USER), USER, scope="all")


def test_only_granted_values_reach_the_function(spark, held, clear):
    """Ungranted tokens that cannot be decrypted at all would fail the job if they were touched."""
    broken = held.withColumn("ssn", F.when(F.col("branch_id") == 3, F.lit("9" * 60)).otherwise(F.col("ssn")))
    policy = govern.entitlements(spark, USER)
    assert govern.mask_one(broken, policy, USER).count() == 400
    assert len(govern.mask_one(broken, policy, USER).collect()) == 400
    with pytest.raises(Exception, match="longer than 56"):
        govern.mask_one_case(broken, policy, USER).collect()
    chosen = tk.decrypt_where(broken, "ssn", F.col("branch_id") != 3)
    assert len(chosen.collect()) == 400


def test_term_search_reaches_the_file_scan(held):
    found = search.search_term(held, "ssn", "123-45-6789")
    assert "EqualTo(ssn,516-91-2276)" in plan(found) and "ArrowEvalPython" not in plan(found)


def test_lookup_decrypts_below_nothing(spark, held, clear):
    row = clear.filter("id = 8").first()
    token = fpe.token_of(row["ssn"], "ssn")
    view = govern.lookup_view(held, govern.entitlements(spark, USER), USER).filter(F.col("ssn_token") == token)
    text = plan(view)
    assert f"EqualTo(ssn,{token})" in text
    assert [(r["id"], r["ssn"]) for r in view.collect()] == [(8, row["ssn"])]


def test_limit_and_filter_go_below_the_decryption(held):
    limited = plan(held.select(fpe.decrypt("ssn", "ssn")).limit(5))
    assert limited.index("ArrowEvalPython") < limited.index("LocalLimit") if "LocalLimit" in limited else "CollectLimit" in limited
    filtered = plan(tk.decrypt_then_filter(held, "ssn", F.col("id") == 5))
    assert "EqualTo(id,5)" in filtered


def test_small_entitlements_are_broadcast_by_size(spark, held):
    text = plan(govern.governed_view(held, govern.entitlements(spark, USER), USER))
    assert "BroadcastHashJoin" in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = govern.governed_view(held, govern.entitlements(spark, USER), USER)
        assert "BroadcastHashJoin" not in plan(large)
        assert large.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_equality_on_tokens():
    for operator in ("<", ">=", "like", "between"):
        with pytest.raises(ValueError, match="only = and IN"):
            search.token_predicate("ssn", operator, "1")


def test_audit_sees_missing_and_different_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    right = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (4, "d")], "id int, v string")
    row = govern.equivalence_audit(left, right, ["v"]).first()
    assert (row["mismatches"], row["compared"]) == (2, 4)


def test_decode_chooses_by_stored_sketches(spark, clear, monkeypatch):
    """With sketches the table is not read to choose; both choices give the same rows."""
    held = with_branch(tk.tokenize_table(clear))
    policy, sketches = govern.entitlements(spark, USER), govern.branch_sketches(held).cache()
    assert sketches.agg(F.sum("total")).first()[0] == 400
    want = sorted(map(tuple, govern.decode_every(held, policy, USER).collect()))
    for remembered, share, joined in ((2_000, 0.01, False), (2, 0.9, True)):
        monkeypatch.setattr(govern.fpe, "RECALLED_VALUES", remembered)
        monkeypatch.setattr(govern, "DISTINCT_SHARE", share)
        shown = govern.decode(held, policy, USER, sketches=sketches)
        assert sorted(map(tuple, shown.collect())) == want
        assert ("Aggregate" in shown._jdf.queryExecution().optimizedPlan().toString()) >= joined
    never = held.withColumn("name", F.raise_error(F.lit("the table was read")).cast("string"))
    govern.decode(never, policy, USER, sketches=sketches)  # choosing alone reads nothing of it
    with pytest.raises(Exception, match="the table was read"):
        govern.decode(never, policy, USER)


def test_audit_of_repeated_keys(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, None), (None, "x"), (2, None)]
    table = spark.createDataFrame(rows, "id int, v string")
    audit = lambda other: tuple(govern.equivalence_audit(table, spark.createDataFrame(other, "id int, v string"), ["v"]).first())
    assert audit(rows[::-1]) == (0, 6)
    assert audit([*rows, (1, "b")]) == (1, 7) and audit(rows[1:]) == (1, 6)
    assert audit([(1, "a"), (1, "c"), (1, "b"), *rows[3:]]) == (1, 6)
    assert audit([]) == (6, 6) and tuple(govern.equivalence_audit(table.limit(0), table.limit(0), ["v"]).first()) == (0, 0)


def test_equal_results_bring_no_rows_together(spark):
    """Only digests of buckets meet: the join that fetches rows gets no bucket to fetch."""
    rows = spark.range(20_000).selectExpr("id", "id % 7 AS v")
    one_off = rows.withColumn("v", F.when(F.col("id") == 77, 9).otherwise(F.col("v")))
    audit = govern.equivalence_audit(rows, one_off, ["v"])
    assert tuple(audit.first()) == (1, 20_000)
    assert tuple(govern.equivalence_audit(rows, rows.orderBy("v"), ["v"]).first()) == (0, 20_000)
    buckets = [p for p in audit.inputFiles() if "digests" in p]
    held = spark.read.parquet(*buckets)
    assert 4000 < held.count() <= govern.AUDIT_BUCKETS and held.where("NOT _same").count() == 1


def test_unlisted_requests_are_refused(spark):
    rules = govern.access_rules(govern.entitlements(spark, USER))
    requests = spark.createDataFrame(
        [(USER, "ssn", "unprotect"), (USER, "email", "unprotect"), (USER, "email", "protect"), ("x", "ssn", "protect")],
        "user_email string, element string, operation string",
    )
    assert sorted((r[0], r[1], r[2], r[3]) for r in govern.check_access(requests, rules).collect()) == [
        (USER, "email", "protect", True), (USER, "email", "unprotect", False), (USER, "ssn", "unprotect", True), ("x", "ssn", "protect", False),
    ]


def test_session_user_is_entered_without_a_name(spark):
    assert {r[0] for r in govern.entitlements(spark).select("user_email").collect()} == {spark.range(1).select(F.session_user()).first()[0]}


@pytest.mark.parametrize("rows", [0, 7, 400, 1000, 1200])
def test_replicate_gives_exactly_that_many(clear, rows):
    copies = tk.replicate(clear.select("id"), rows)
    assert copies.count() == rows
    assert copies.distinct().count() == rows


@pytest.mark.parametrize("kind", ["int", "string"])
def test_replicate_by_repeated_and_textual_keys(spark, kind):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "id int").select(F.col("id").cast(kind))
    rows = tk.replicate(df, 6).collect()
    assert len(rows) == 6 and sorted(str(r["id"]) for r in rows if r["copy"] == 2) == ["1", "1"]


def test_replicate_makes_no_long_array(spark, monkeypatch):
    monkeypatch.setattr(tk, "_COPIES_AT_ONCE", 3)
    rows = tk.replicate(spark.range(2), 15).collect()
    assert sorted((r["id"], r["copy"]) for r in rows) == [(0, c) for c in range(1, 9)] + [(1, c) for c in range(1, 8)]


def test_packs_are_those_of_a_loop_over_the_rows(spark):
    sizes = [(i * 7919) % 61 for i in range(900)] + [500, 0, 0, 500]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "i int, v string").coalesce(1)
    got = [r["batch"] for r in sorted(tk.size_batches(df, "v", 9, 150).collect(), key=lambda r: r["i"])]
    want, number, rows, used = [], 0, 0, 0
    for n in sizes:
        if rows and (rows == 9 or used + n > 150):
            number, rows, used = number + 1, 0, 0
        rows, used = rows + 1, used + n
        want.append(number)
    assert got == want


def test_governed_columns_of_another_shape(spark):
    df = spark.createDataFrame([(1, "030 1234567", 7, None, True)], "key int, phone string, unit int, note string, can_see_phone boolean")
    held = tk.tokenize_table(df, {"phone": "phone"})
    for seen, shown in ((True, "030 1234567"), (False, "?")):
        policy = spark.createDataFrame([(USER, 7, seen)], "user_email string, unit int, can_see_phone boolean")
        view = govern.governed_view(held, policy, USER, {"phone": "phone"}, masks={"phone": "?"}, branch="unit", keep=None)
        assert view.columns == df.columns and tuple(view.first()) == (1, shown, 7, None, True)
    with pytest.raises(ValueError, match="no element is known"):
        govern.governed_view(held, policy, USER, ("note",), branch="unit")


def test_batches_keep_to_their_budget(spark):
    df = spark.createDataFrame([(i, "x" * (i * 37 % 90)) for i in range(500)] + [(900, "y" * 500), (901, None)], "i int, v string").repartition(3)
    rows = tk.size_batches(df, "v", 10, 200).collect()
    assert len(rows) == 502
    batches = {}
    for r in rows:
        batches.setdefault((r["batch_partition"], r["batch"]), []).append(len(r["v"] or ""))
    assert all(len(b) <= 10 and (sum(b) <= 200 or len(b) == 1) for b in batches.values())


def test_mock_people_depend_on_the_seed(spark):
    one, two = mock_pii(spark, 50, seed=1), mock_pii(spark, 50, seed=2)
    assert one.collect() == mock_pii(spark, 50, seed=1).collect() != two.collect()
    pattern = r"^\d{3}-\d{2}-\d{4}$"
    assert one.filter(F.col("ssn").rlike(pattern)).count() == 50
    assert one.agg(F.min("dob")).first()[0] >= "1950-01-01"
