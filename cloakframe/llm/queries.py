"""The numbered queries over the given tables, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import attach
from . import diagrams, divergence, fingerprint, lines, mixing, near, quality, sharding, simhash, toxicity, transducer, urls, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(attach(spark), folder)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return run

    return register


@query()
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_slots(table(spark, folder, "documents"), shards=40)


@query()
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    config = near.NearConfig(shingle=3, similarity=Fraction(85, 100))
    return near.near_groups(table(spark, folder, "documents"), config)


@query()
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.get("passes", F.lit(0))["position"].alias("position"),
        F.get("passes", F.lit(1))["position"].alias("second_position"),
    ).orderBy("position", "doc_id")


@query()
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, folder, "labels")))


@query()
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query()
def op9_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_neighbours(table(spark, folder, "documents"))


@query()
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_pages(table(spark, folder, "pages"))
    return warc.read_archives(spark, archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """A page is labelled by the quality of the document that its url numbers."""
    pages = table(spark, folder, "pages")
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]{1,18})[^/0-9?#]*/?([?#].*)?$', 1) AS bigint)")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("good"))
    labelled = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "good")
    return urls.judge_urls(pages, labelled)


LINES_SQL = f"""
WITH lines AS (SELECT doc_id, source, i, trim(line) AS line
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
          FROM documents) AS cut
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
bad AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= {lines.LineConfig.sites}),
marked AS (SELECT lines.*, bad.line IS NOT NULL AS gone FROM lines LEFT JOIN bad USING (line)),
told AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_gone, list(i) FILTER (gone) AS places, bool_and(gone) AS whole FROM marked GROUP BY doc_id),
done AS (SELECT doc_id, source, coalesce(n, 0) AS n_lines, CASE WHEN whole THEN 0 ELSE coalesce(n_gone, 0) END AS n_removed,
    CASE WHEN whole OR places IS NULL THEN text ELSE array_to_string(list_transform(list_filter(
        list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1)), lambda z: NOT list_contains(places, z[2])),
        lambda z: z[1]), chr(10)) END AS cleaned
    FROM documents LEFT JOIN told USING (doc_id))
SELECT doc_id, source, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(cleaned) AS BIGINT) AS n_kept_chars,
    md5(cleaned) AS kept_md5 FROM done"""


@query(LINES_SQL)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(table(spark, folder, "documents"), counts=True)
    return cleaned.select(
        "doc_id", "source", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_kept_chars"),
        F.md5(F.col("text").cast("binary")).alias("kept_md5"),
    )


@query()
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = transducer.Vocabulary.read()
    return transducer.encode_documents(table(spark, folder, "documents"), vocabulary, ids=False, digest=True)


@query()
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))


@query()
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return diagrams.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, folder, "documents"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _inverted_sql(knots, share: str) -> str:
    """mixing.invert_demand in SQL, operation by operation."""
    area, pieces = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((area, t0, t1, w0, w1))
        area += (t1 - t0) * (w0 + w1) / 2
    double = lambda x: f"CAST({x!r} AS DOUBLE)"
    demand = f"least(greatest({share}, {double(0.0)}), {double(1.0)}) * {double(area)}"
    cases = ""
    for start, t0, t1, w0, w1 in pieces:
        end, slope = start + (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = f"greatest({demand} - {double(start)}, {double(0.0)})"
        root = f"sqrt(greatest({double(w0 * w0)} + {rest} * {double(2 * slope)}, {double(0.0)}))"
        cases += f" WHEN {demand} < {double(end)} AND {rest} > 0 THEN {double(t0)} + {rest} * 2 / ({root} + {double(w0)}) WHEN {demand} < {double(end)} THEN {double(t0)}"
    return f"CASE{cases} ELSE {double(knots[-1][0])} END"


def _position_sql(number: int) -> str:
    words = f"greatest(least(want - (start + source_size * {number}), size), 0)"
    share = f"(CAST(start + source_size * {number} AS DOUBLE) + CAST({words} AS DOUBLE) / 2) / target"
    turns = " ".join(f"WHEN {i} THEN {_inverted_sql(knots, share)}" for i, knots in enumerate(mixing.SCHEDULES))
    return f"CASE WHEN {words} > 0 THEN CASE source_rank % {len(mixing.SCHEDULES)} {turns} END END"


ORACLES["op4_mixing"] = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(([{', '.join(map(str, mixing.WEIGHTS))}])[source_rank % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight,
    CAST(source_size * {mixing.REPEATS} AS DOUBLE) AS cap FROM sources),
filling AS (SELECT *, cap / weight AS whole, coalesce(sum(cap) OVER below, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS open,
    CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.BUDGET} AS budget FROM weighed
    WINDOW below AS (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, max(CASE WHEN (budget - capped) / open < whole THEN (budget - capped) / open END) OVER () AS level FROM filling),
targets AS (SELECT source, source_size, source_rank, CASE WHEN level IS NULL OR weight * level >= cap THEN cap ELSE weight * level END AS target FROM levels),
placed AS (SELECT doc_id, size, source_size, source_rank, target, CAST(floor(target) AS BIGINT) AS want,
    CAST(coalesce(sum(size) OVER (PARTITION BY source_rank ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
    CAST({' + '.join(f'greatest(least(want - (start + source_size * {i}), size), 0)' for i in range(mixing.REPEATS))} AS BIGINT) AS taken,
    coalesce({_position_sql(0)}, {_position_sql(1)}) AS position, CASE WHEN {_position_sql(0)} IS NOT NULL THEN {_position_sql(1)} END AS second_position FROM placed"""

# All pairs that share a shingle are counted, which the small tables allow.
ORACLES["op8_minhash_near_dedup"] = f"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_WORDS}) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM cut),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS c FROM held AS a JOIN held AS b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * c >= 85 * (n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) AS least USING (doc_id)"""


def _urls_sql() -> str:
    """urls.judge_urls over the tables: a page goes down level by level until its node cannot be parted."""
    c = urls.UrlConfig()
    number = r"TRY_CAST(nullif(regexp_extract(url, '/([0-9]{1,18})[^/0-9?#]*/?([?#].*)?$', 1), '') AS BIGINT)"
    shape = r"""CASE WHEN regexp_matches(stem, '^[0-9]+$') THEN '{0}' WHEN regexp_matches(stem, '[0-9]') THEN '{a0}' ELSE '{a}' END || ending"""
    counts = ", ".join(
        f"count(good) OVER (PARTITION BY host, template{by}) AS {n}_m, sum(good) OVER (PARTITION BY host, template{by}) AS {n}_g"
        for n, by in (("all", ""), ("name", ", segment"), ("shape", ", shape"))
    )
    apart = lambda n: (
        f"{n}_m >= {c.support} AND all_m > {n}_m AND abs({n}_g / {n}_m - all_g / all_m) > CAST({c.apart} AS DOUBLE) * sqrt(all_g / all_m * (1 - all_g / all_m) * (CAST(1.0 AS DOUBLE) / {n}_m))"
    )
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(urls.RULES, key=lambda r: -len(r.name))
    )
    allowed = " ".join(f"WHEN '{r.name}' THEN {str(r.allow).lower()}" for r in urls.RULES)
    return f"""WITH RECURSIVE split AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {_LETTERS}) AS host,
        regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, {number} AS doc_id FROM pages),
    named AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, good FROM split
        LEFT JOIN (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id) AS g USING (doc_id)),
    walk AS (SELECT page_id, host, path, good, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, 0 AS level, '' AS template, false AS ended FROM named
        UNION ALL SELECT page_id, host, path, good, segments, level + 1, template || CASE WHEN NOT parted THEN repeat('/*', len(segments) - level)
            WHEN {apart("name")} THEN '/' || segment WHEN {apart("shape")} THEN '/' || shape ELSE '/*' END, NOT parted
        FROM (SELECT *, all_m > {c.support} AND all_g > 0 AND all_g < all_m AS parted FROM (SELECT *, {counts} FROM (SELECT *, {shape} AS shape FROM (
            SELECT *, segments[level + 1] AS segment, regexp_replace(segments[level + 1], '\\.[A-Za-z]{{1,5}}$', '') AS stem, regexp_extract(segments[level + 1], '(\\.[A-Za-z]{{1,5}})$', 1) AS ending
            FROM walk WHERE NOT ended AND level < len(segments)))))),
    placed AS (SELECT page_id, host, path, good, template, CASE {fits} END AS rule FROM walk WHERE ended OR level = len(segments)),
    judged AS (SELECT *, (coalesce(sum(good) OVER node, 0) + {c.prior} * coalesce(avg(good) OVER (), 1)) / (count(good) OVER node + {c.prior}) >= {c.purity} AS pure
        FROM placed WINDOW node AS (PARTITION BY host, template))
    SELECT page_id, host, path, template, rule, CASE WHEN coalesce(CASE rule {allowed} END, pure) THEN 'allow' ELSE 'block' END AS verdict FROM judged"""


ORACLES["op2_url_filters"] = _urls_sql()

_PAGES = "(SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS size FROM pages)"

ORACLES["op1_warc"] = f"""
WITH told AS (SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM {_PAGES}),
kept AS (SELECT payload_digest, max(page_id) AS kept FROM told WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY payload_digest),
placed AS (SELECT told.*, CASE WHEN kept IS NOT NULL AND kept IS DISTINCT FROM page_id AND payload_bytes >= {warc.REVISIT_BYTES}
    THEN kept END AS refers_to FROM told LEFT JOIN kept USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM placed"""

# Every step of all orders from the masks of single documents.
ORACLES["op12_filter_audit"] = f"""
WITH cut AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failing AS (SELECT cut.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    map {{'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
        'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(min(cut.doc_id) OVER (PARTITION BY text) < cut.doc_id, false)}} AS fails
    FROM cut LEFT JOIN marks ON cut.doc_id = marks.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails),
steps AS (SELECT filter_order, step, filter_order[step] AS f, string_split(filter_order[1:step - 1], '') AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, filter_order, step, f, sum(CASE WHEN open AND NOT fails[f] THEN n ELSE 0 END) AS kept, sum(CASE WHEN open AND fails[f] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN NOT open AND fails[f] THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails[f] AND len(list_filter(map_values(fails), lambda v: v)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN open AND fails[f] THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN open AND fails[f] THEN toxic ELSE 0 END) AS toxic_lost
    FROM (SELECT *, len(list_filter(before, lambda b: b <> '' AND fails[b])) = 0 AS open FROM masks, steps) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told"""

# Each group against each kept term of its language, whether it has it or not.
ORACLES["op11_source_divergence"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_LETTERS}) AS text FROM documents),
held AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS whole FROM held GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.DivergenceConfig.documents}),
counts AS (SELECT lang, source, term, count(*) AS n FROM held SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, CAST(sum(whole) AS HUGEINT) AS total FROM kept GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(langs.total, 0) AS lang_total, coalesce(s.n, 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) AS g LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM counts GROUP BY ALL) AS s USING (lang, source)),
shares AS (SELECT lang, groups.source, term, coalesce(counts.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(counts.n, 0) + 1) // (total + v) AS p,
    1 + 1000000000::HUGEINT * (whole + 1) // (lang_total + v) AS q FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shares AS x JOIN shares AS y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) AS d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.DivergenceConfig.top}"""
