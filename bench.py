"""Headline workloads.  Prints one JSON line; every time is the median of three runs after a warm-up.

The token table has a million distinct people derived from the customer table and is stored before the
clock starts, as are log and text tables, which come as given.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import cloakframe
from cloakframe.functions import fpe, native
from cloakframe.operators import govern, search, service_logs, text, tokens
from cloakframe.plans import QUERIES
from cloakframe.plans.service_queries import service_log
from cloakframe.plans.text_queries import REDACT
from cloakframe.session import shared_path, spread
from cloakframe.sources.pii import pii_from, with_branch
from cloakframe.sources.tables import create_table_as, table

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ROWS = 1_000_000
RUNS = 3
USER = "analyst"

# rows/s, or seconds on a million rows, published for the same step
PUBLISHED_RATE = {"noop": 403_075, "hmac": 214_505, "decrypt_ssn": 26_002}
PUBLISHED_SECONDS = {
    "search_decrypt_column": 20.72, "search_term": 2.38, "search_token": 0.77, "mask_one": 0.79, "mask_one_case": 25.78,
    "mask_three": 1.59, "mask_three_case": 50.74, "row_filter": 0.96, "decode_distinct": 0.95, "decode_every": 13.46,
    "lookup_by_token": 1.79, "limit_before_decrypt": 0.97, "distinct_tokens": 0.34, "distinct_after_decrypt": 7.56,
    "filter_before_decrypt": 0.57,
}


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def workloads(spark):
    customers = table(spark, FOLDER, "customer").select("c_custkey")
    have = customers.count()
    copies = tokens.replicate(customers, max(ROWS, have), "c_custkey")
    clear = pii_from(copies.withColumn("person", F.col("copy") * have + F.col("c_custkey")), "person").repartition(2 * CPUS)
    folder = shared_path(spark, "bench")
    clear = create_table_as(clear, f"{folder}/clear")
    held = create_table_as(tokens.tokenize_table(clear), f"{folder}/tokens")
    branched = with_branch(held)
    policy = govern.entitlements(spark, USER)
    pair = clear.orderBy("id").first()
    token = fpe.token_of(pair["ssn"], "ssn")
    log = service_logs.per_row_costs(service_log(spark, FOLDER))
    docs = spread(table(spark, FOLDER, "documents").select("doc_id", "text"), "doc_id")

    def total(df, value):
        return lambda: tokens.forced_length(df, value).collect()

    yield "noop", total(clear, native.noop("ssn"))
    yield "hmac", total(clear, native.hmac_token("ssn"))
    for column, name in tokens.TABLE_ELEMENTS.items():
        yield f"encrypt_{column}", total(clear, fpe.encrypt(column, name))
        yield f"decrypt_{column}", total(held, fpe.decrypt(column, name))
    # names as they are hold a hundred distinct values, which workers remember; these are all different
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    named = clear.select(F.concat("name", F.lit(" "), letters).alias("v"))
    yield "encrypt_name_distinct", total(named, fpe.encrypt("v", "name"))
    yield "search_decrypt_column", lambda: search.search_decrypted(held, "ssn", pair["ssn"]).count()
    yield "search_term", lambda: search.search_term(held, "ssn", pair["ssn"]).count()
    yield "search_token", lambda: search.search_token(held, "ssn", token).count()
    yield "mask_one", lambda: consume(govern.mask_one(branched, policy, USER))
    yield "mask_one_case", lambda: consume(govern.mask_one_case(branched, policy, USER))
    yield "mask_three", lambda: consume(govern.governed_view(branched, policy, USER))
    yield "mask_three_case", lambda: consume(govern.governed_view_case(branched, policy, USER))
    yield "row_filter", lambda: consume(govern.filter_rows(branched, policy, USER))
    yield "decode_distinct", lambda: consume(govern.decode_distinct(branched, policy, USER))
    yield "decode_every", lambda: consume(govern.decode_every(branched, policy, USER))
    yield "lookup_by_token", lambda: govern.lookup_view(branched, policy, USER).filter(F.col("ssn_token") == token).collect()
    yield "limit_before_decrypt", lambda: tokens.limit_then_decrypt(held, "ssn", 100).collect()
    yield "distinct_tokens", lambda: tokens.distinct_tokens(held, ["ssn"]).collect()
    yield "distinct_after_decrypt", lambda: tokens.distinct_after_decrypt(held, ["ssn"]).collect()
    few = F.col("id") % 1000 == 0  # the published query's own filter
    yield "filter_before_decrypt", lambda: consume(tokens.filter_then_decrypt(held, "ssn", few))
    yield "log_summary", lambda: consume(service_logs.summarise(log, ["mode"]))
    yield "log_concurrency", lambda: consume(service_logs.concurrency(log, ["mode"]))
    yield "redact_documents", lambda: consume(docs.select("doc_id", text.redact("text", REDACT)))
    for name in ("merged_spans", "conversation_risk", "ranked_configs", "medians_by_group", "window_lines"):
        yield name, lambda name=name: consume(QUERIES[name](spark, FOLDER))


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    cloakframe.attach(spark)
    seconds = {}
    for name, run in workloads(spark):
        run()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    whole_table = [n for n in seconds if n in PUBLISHED_RATE or n.startswith(("encrypt_", "decrypt_"))]
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "rows": ROWS, "cpus": CPUS,
                "rows_per_second": {n: round(ROWS / seconds[n]) for n in whole_table},
                "times_published": {
                    **{n: round(ROWS / seconds[n] / r, 2) for n, r in PUBLISHED_RATE.items()},
                    **{n: round(s / seconds[n], 2) for n, s in PUBLISHED_SECONDS.items()},
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
