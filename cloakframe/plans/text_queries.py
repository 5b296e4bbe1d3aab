"""Queries on free text and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions.detect import CHECKED_RULES, ENTITY_ELEMENTS, TextConfig, element_of
from ..operators import guardrails as gr, text as tx
from ..session import spread
from ..sources.tables import table
from .base import query

LABELS = {
    "EMAIL_ADDRESS": "EMAIL", "CREDIT_CARD": "CARD", "IP_ADDRESS": "IP", "PHONE_NUMBER": "PHONE",
    "PASSWORD": "SECRET", "ACCOUNT_NUMBER": "ACCOUNT",
}
REDACT = TextConfig(labels=LABELS)
MASK = TextConfig(labels=LABELS, method="mask", masking_char="*")
LOW = TextConfig(threshold=0.3)


_D = "list_transform(regexp_extract_all(hit, '[0-9]'), lambda c: CAST(c AS INTEGER))"
_WEIGHED = "list_sum(list_transform(list_zip({0}[1:{1}], {2}), lambda z: z[1] * z[2]))"


def _turned() -> str:
    """The permutation of verhoeff() applied 0 to 7 times, as a list of lists."""
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([checks.VERHOEFF_TURN[x] for x in rows[-1]])
    return str(rows)


def _value(c: str) -> str:
    return f"(strpos('{checks.BASE36}', {c}) - 1)"


#: The checks of functions.checks in SQL, on a column ``hit``.  Base58Check needs whole numbers of 200 bits, which SQL lacks.
CHECK_SQL = {
    "luhn": f"""list_sum(list_transform(list_zip(list_reverse({_D}), range(len({_D}))),
        lambda z: CASE WHEN z[2] % 2 = 0 THEN z[1] WHEN z[1] > 4 THEN 2 * z[1] - 9 ELSE 2 * z[1] END)) % 10 = 0""",
    "mod97": f"""list_reduce(list_concat([0::BIGINT], list_transform(string_split(hit[5:] || hit[:4], ''), lambda c: CAST({_value("c")} AS BIGINT))),
        lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1""",
    "verhoeff": f"""list_reduce(list_concat([0], list_transform(list_zip(list_reverse({_D}), range(len({_D}))), lambda z: ({_turned()})[z[2] % 8 + 1][z[1] + 1])),
        lambda a, b: CASE WHEN a < 5 THEN (a + b) % 5 + CASE WHEN b < 5 THEN 0 ELSE 5 END ELSE (a - b + 10) % 5 + CASE WHEN b < 5 THEN 5 ELSE 0 END END) = 0""",
    "weighted11": f"(11 - {_WEIGHED.format(_D, 9, 'range(10, 1, -1)')} % 11) % 11 = ({_D})[10]",
    "rrn": f"(11 - {_WEIGHED.format(_D, 12, list(checks.RRN_WEIGHTS))} % 11) % 10 = ({_D})[13]",
    "tnin": f"(11 - {_WEIGHED.format(_D, 12, 'range(13, 1, -1)')} % 11) % 10 = ({_D})[13]",
    "mod36": f"""(36 - list_sum(list_transform(list_zip(string_split(hit[:14], ''), range(14)), lambda z: {_value("z[1]")} * (1 + z[2] % 2) // 36 + {_value("z[1]")} * (1 + z[2] % 2) % 36)) % 36) % 36
        = {_value("hit[15]")}""",
    "octets": "list_max(list_transform(string_split(hit, '.'), lambda x: CAST(x AS INTEGER))) < 256",
    "issued_ssn": "hit[1:3] NOT IN ('000', '666') AND hit[1:3] < '900' AND hit[5:6] <> '00' AND hit[8:11] <> '0000'",
    "calendar": "TRY_CAST(hit[1:10] AS DATE) IS NOT NULL AND (length(hit) = 10 OR (hit[12:13] < '24' AND hit[15:16] < '60'))",
}


def _checked_sql(config: TextConfig) -> str:
    """Whether a hit passes its rule's check."""
    cases = " ".join(f"WHEN rule = {i} THEN {CHECK_SQL[r.check]}" for i, r in enumerate(config.active) if r.check)
    return f"CASE {cases} ELSE true END" if cases else "true"


def spans_sql(config: TextConfig, texts: str = "documents") -> str:
    """Spans by pure SQL: offsets are running lengths of the pieces between and the matches before."""
    rules = " UNION ALL ".join(
        f"""SELECT doc_id, '{r.entity}' AS entity, CAST({r.score} AS DOUBLE) AS score, {i} AS rule,
        regexp_extract_all(text, '{r.pattern.replace("'", "''")}') AS hits,
        string_split_regex(text, '{r.pattern.replace("'", "''")}') AS gaps FROM {texts}"""
        for i, r in enumerate(config.active)
    )
    return f"""found AS ({rules}),
    numbered AS (SELECT doc_id, entity, score, rule, k, hits[k] AS hit,
        CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) AS BIGINT)
        + CAST(coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS place
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM found WHERE len(hits) > 0)),
    spans AS (SELECT doc_id, entity, CAST(place AS INTEGER) AS start_index, CAST(place + length(hit) AS INTEGER) AS end_index, score,
        CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rule, k) - 1 AS INTEGER) AS arrival FROM numbered WHERE {_checked_sql(config)})"""


_COLLECTED = """collected AS (SELECT doc_id, start_index, end_index, arg_max(entity, [score, -arrival]) AS entity,
        max(score) AS score, min(arrival) AS arrival FROM spans GROUP BY doc_id, start_index, end_index)"""

_MERGED = """reaching AS (SELECT *, max(end_index) OVER (PARTITION BY doc_id ORDER BY start_index, end_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM collected),
    islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_index > reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY start_index, end_index) AS island FROM reaching),
    lists AS (SELECT doc_id, min(start_index) AS start_index, max(end_index) AS end_index, max(score) AS score,
        list({'label': entity, 'score': score} ORDER BY start_index DESC, arrival) AS pieces FROM islands GROUP BY doc_id, island),
    merged AS (SELECT doc_id, start_index, end_index, score,
        list_reduce(pieces, lambda a, p: {'label': CASE WHEN a.label = p.label THEN p.label
            WHEN a.score > p.score OR (a.score = p.score AND a.label < p.label) THEN a.label || '|' || p.label
            ELSE p.label || '|' || a.label END, 'score': greatest(a.score, p.score)}).label AS entity FROM lists)"""


def _rewritten_sql(config: TextConfig, replacement: str) -> str:
    """Texts rebuilt from merged spans; ``replacement`` is SQL over (entity, start_index, end_index)."""
    return f"""WITH {spans_sql(config)}, {_COLLECTED}, {_MERGED},
    pieces AS (SELECT doc_id, start_index, end_index, {replacement} AS new FROM merged JOIN documents USING (doc_id)),
    kept AS (SELECT *, lag(end_index, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_index) AS prior,
        end_index = max(end_index) OVER (PARTITION BY doc_id) AS final FROM pieces WHERE new IS NOT NULL),
    built AS (SELECT doc_id, string_agg(substr(text, CAST(prior AS BIGINT) + 1, start_index - prior) || new ||
        CASE WHEN final THEN substr(text, CAST(end_index AS BIGINT) + 1) ELSE '' END, '' ORDER BY start_index) AS text
        FROM kept JOIN documents USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, coalesce(built.text, documents.text) AS text FROM documents LEFT JOIN built USING (doc_id)"""


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


@query(f"WITH {spans_sql(TextConfig())} SELECT * FROM spans")
def pii_spans(spark, folder):
    return tx.find_spans(_documents(spark, folder), "doc_id", "text")


#: All checked rules that SQL can say: Base58Check is left to the tests.
CHECKED = TextConfig(rules=tuple(r for r in CHECKED_RULES if r.check != "base58check"), threshold=0.3)


@query(f"WITH {spans_sql(CHECKED)} SELECT * FROM spans")
def pii_spans_checked(spark, folder):
    """33 kinds of entities; card numbers, accounts and the like only with right check digits."""
    return tx.find_spans(_documents(spark, folder), "doc_id", "text", CHECKED)


# identifiers of every customer, with whatever check digits the key gives: about one in ten is right

@query(
    f"""WITH parts AS (SELECT c_custkey AS doc_id, lpad(CAST((c_custkey * 1000003 + 12345) % 10000000000000 AS VARCHAR), 13, '0') AS d FROM customer),
    texts AS (SELECT doc_id, 'card 4' || d || d[1:2] || ', IBAN DE' || d || d[1:7] || ', id 2' || d[1:3] || ' ' || d[4:7] || ' ' || d[10:13]
      || ', health ' || d[5:7] || ' ' || d[8:10] || ' ' || d[10:13] || ', RRN ' || d[1:6] || '-1' || d[8:13] || ', TNIN 1-' || d[2:5] || '-' || d[6:10] || '-' || d[11:12] || '-' || d[13]
      || ', GSTIN 29ABCDE' || d[10:13] || 'F1Z' || d[13] || ', host ' || d[8:10] || '.1.2.3, SSN ' || d[1:3] || '-' || d[9:10] || '-' || d[10:13] || ', on 19' || d[12:13] || '-' || d[11:12] || '-31' AS text FROM parts),
    {spans_sql(CHECKED, "texts")} SELECT doc_id, entity, start_index, end_index FROM spans"""
)
def checked_identifiers(spark, folder):
    """Ten kinds of identifiers of every customer in a text each, with the check digits that the key happens to give."""
    d = F.lpad(((F.col("c_custkey") * 1000003 + 12345) % 10_000_000_000_000).cast("string"), 13, "0")
    cut = lambda a, b: F.substring("d", a, b - a + 1)
    text = F.concat(
        F.lit("card 4"), "d", cut(1, 2), F.lit(", IBAN DE"), "d", cut(1, 7), F.lit(", id 2"), cut(1, 3), F.lit(" "), cut(4, 7), F.lit(" "), cut(10, 13),
        F.lit(", health "), cut(5, 7), F.lit(" "), cut(8, 10), F.lit(" "), cut(10, 13), F.lit(", RRN "), cut(1, 6), F.lit("-1"), cut(8, 13),
        F.lit(", TNIN 1-"), cut(2, 5), F.lit("-"), cut(6, 10), F.lit("-"), cut(11, 12), F.lit("-"), cut(13, 13), F.lit(", GSTIN 29ABCDE"), cut(10, 13), F.lit("F1Z"), cut(13, 13),
        F.lit(", host "), cut(8, 10), F.lit(".1.2.3, SSN "), cut(1, 3), F.lit("-"), cut(9, 10), F.lit("-"), cut(10, 13), F.lit(", on 19"), cut(12, 13), F.lit("-"), cut(11, 12), F.lit("-31"),
    )
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), d.alias("d")).select("doc_id", text.alias("text"))
    return tx.find_spans(spread(rows, "doc_id"), "doc_id", "text", CHECKED).select("doc_id", "entity", "start_index", "end_index")


@query(f"WITH {spans_sql(LOW)} SELECT entity, count(*) AS spans, count(DISTINCT doc_id) AS texts FROM spans GROUP BY entity")
def pii_spans_low_threshold(spark, folder):
    spans = tx.find_spans(_documents(spark, folder), "doc_id", "text", LOW)
    return spans.groupBy("entity").agg(F.count("*").alias("spans"), F.count_distinct("doc_id").alias("texts"))


@query(f"WITH {spans_sql(LOW)}, {_COLLECTED} SELECT * FROM collected")
def collected_spans(spark, folder):
    return tx.collect_spans(tx.find_spans(_documents(spark, folder), "doc_id", "text", LOW), "doc_id")


@query(f"WITH {spans_sql(LOW)}, {_COLLECTED}, {_MERGED} SELECT doc_id, entity, start_index, end_index, score FROM merged")
def merged_spans(spark, folder):
    """Found, collected and merged in place; no shuffle of spans."""
    return tx.find_merged(_documents(spark, folder), "doc_id", "text", LOW)


@query(f"WITH {spans_sql(LOW)}, {_COLLECTED}, {_MERGED} SELECT doc_id, entity, start_index, end_index, score FROM merged")
def merged_span_table(spark, folder):
    """The same from a table of spans, which may come from other detectors."""
    spans = tx.find_spans(_documents(spark, folder), "doc_id", "text", LOW)
    return tx.merge_spans(tx.collect_spans(spans, "doc_id"), "doc_id")


_SHOWN = "CASE entity " + " ".join(f"WHEN '{e}' THEN '{label}'" for e, label in LABELS.items())


ORACLE_REDACTED = _rewritten_sql(
    REDACT,
    f"""CASE WHEN contains(entity, '|') THEN '[' || array_to_string(list_transform(string_split(entity, '|'),
    lambda e: {_SHOWN.replace('CASE entity', 'CASE e')} ELSE e END), '|') || ']'
    ELSE '[' || ({_SHOWN} END) || ']' END""",
)


@query(ORACLE_REDACTED)
def redacted_texts(spark, folder):
    return _documents(spark, folder).select("doc_id", tx.redact("text", REDACT).alias("text"))


@query(_rewritten_sql(MASK, "repeat('*', end_index - start_index)"))
def masked_texts(spark, folder):
    return _documents(spark, folder).select("doc_id", tx.redact("text", MASK).alias("text"))


@query(_rewritten_sql(TextConfig(), "CASE WHEN contains(entity, '|') THEN '[' || entity || ']' END"))
def unlabelled_texts(spark, folder):
    """No labels configured: only merged spans are redacted, under their raw names."""
    return _documents(spark, folder).select("doc_id", tx.redact("text", TextConfig()).alias("text"))


# a secret with more than 32 letters and digits is beyond what FF3-1 can hold
_TOO_LONG = """(entity = 'PASSWORD' AND length(regexp_replace(substr(text, start_index + 1, end_index - start_index),
    '[^0-9a-zA-Z]', '', 'g')) > 32)"""


@query(
    f"""WITH restored AS ({_rewritten_sql(REDACT, f"CASE WHEN {_TOO_LONG} THEN repeat('#', end_index - start_index) END")}),
    {spans_sql(REDACT)}, {_COLLECTED}, {_MERGED},
    tagged AS (SELECT doc_id, sum(CASE WHEN {_TOO_LONG} THEN 0 ELSE 2 * length(string_split(entity, '|')[1]) + 5 END) AS grown,
        count(*) FILTER (WHERE {_TOO_LONG}) AS failures FROM merged JOIN documents USING (doc_id)
      WHERE string_split(entity, '|')[1] IN ({', '.join(f"'{e}'" for e in LABELS)}) GROUP BY doc_id)
    SELECT doc_id, text AS restored, CAST(coalesce(grown, 0) AS BIGINT) AS grown, coalesce(failures, 0) AS failures
    FROM restored LEFT JOIN tagged USING (doc_id)"""
)
def protected_texts(spark, folder):
    """Spans tokenized inside tags and read back: the text returns, and only the tags add length.  A span
    too long to tokenize is masked and counted."""
    held = _documents(spark, folder).select("doc_id", "text", tx.protect("text", REDACT).alias("p"))
    return held.select(
        "doc_id", tx.unprotect("p.text").alias("restored"),
        (F.length("p.text") - F.length("text")).cast("long").alias("grown"), F.col("p.failures").cast("long").alias("failures"),
    )


@query(
    """SELECT doc_id, '[PASSWORD]' || repeat('x', 40) || '[/PASSWORD] ' || lang AS text, CAST(1 AS BIGINT) AS failures FROM documents"""
)
def overlong_tags(spark, folder):
    """A tag with more than a token can hold stays as it is and is counted."""
    tagged = F.concat(F.lit("[PASSWORD]"), F.repeat(F.lit("x"), 40), F.lit("[/PASSWORD] "), F.col("lang"))
    read = table(spark, folder, "documents").select("doc_id", tx.unprotect_counted(tagged).alias("r"))
    return read.select("doc_id", "r.text", F.col("r.failures").cast("long").alias("failures"))


_ELEMENTS = " ".join(f"WHEN '{e}' THEN '{d}'" for e, d in ENTITY_ELEMENTS.items())


@query(f"WITH {spans_sql(LOW)} SELECT CASE entity {_ELEMENTS} END AS element, count(*) AS spans FROM spans GROUP BY 1")
def elements_found(spark, folder):
    spans = tx.find_spans(_documents(spark, folder), "doc_id", "text", LOW)
    return spans.groupBy(element_of("entity").alias("element")).agg(F.count("*").alias("spans"))


# -- conversations -------------------------------------------------------------------------------------

# words that occur in the given conversations, so that every outcome occurs
WATCHED = (
    gr.MessageRule("german", r"\b(?:und|der|die)\b", 0.4, "German function words"),
    gr.MessageRule("french", r"\b(?:les|une|dans)\b", 0.6, "French function words"),
    gr.MessageRule("english", r"\b(?:that|with|the)\b", 0.5, "English function words"),
    gr.MessageRule("question", r"\?", 0.9, "asks something"),
    *gr.MESSAGE_RULES,
)

_MESSAGES = f"""messages AS (SELECT conv_id AS conversation, conv_id || '-' || turn AS id,
      CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'ai' WHEN 'system' THEN 'context' END AS "from",
      CASE role WHEN 'user' THEN 'ai' WHEN 'assistant' THEN 'user' WHEN 'system' THEN 'ai' END AS "to", text AS content FROM conversations)"""


def _scanned_sql(limit: str = "0.5", source: str = "messages", extra: str = "") -> str:
    hits = ", ".join(
        f"CASE WHEN regexp_matches(content, '{r.pattern}') THEN CAST({r.score} AS DOUBLE) END" for r in WATCHED
    )
    count = " + ".join(f"CAST(regexp_matches(content, '{r.pattern}') AS INTEGER)" for r in WATCHED)
    return f"""scanned AS (SELECT conversation, id, score, matched{extra}, CASE WHEN score IS NULL THEN 'skipped'
      WHEN score >= {limit} THEN 'rejected' ELSE 'approved' END AS outcome
      FROM (SELECT *, CASE WHEN "from" <> 'context' THEN coalesce(greatest({hits}), 0) END AS score,
        CASE WHEN "from" <> 'context' THEN {count} ELSE 0 END AS matched FROM {source}))"""


def _scanned(messages, **options):
    return gr.scan_messages(messages, WATCHED, F.col("from") != "context", **options)


def _conversations(spark, folder):
    return gr.as_messages(table(spark, folder, "conversations"))


@query(f"WITH {_MESSAGES}, {_scanned_sql()} SELECT conversation, id, outcome, score, matched FROM scanned")
def message_risk(spark, folder):
    scanned = _scanned(_conversations(spark, folder))
    return scanned.select("conversation", "id", "outcome", "score", F.size("processors").alias("matched"))


@query(
    f"""WITH {_MESSAGES}, {_scanned_sql()} SELECT conversation, CASE WHEN bool_or(outcome = 'rejected') THEN 'rejected' ELSE 'approved' END AS outcome,
    coalesce(max(score), 0) AS score, count(*) FILTER (WHERE outcome = 'rejected') AS rejected_count, count(*) AS messages
    FROM scanned GROUP BY conversation"""
)
def conversation_risk(spark, folder):
    return gr.batch_risk(_scanned(_conversations(spark, folder)))


@query(f"WITH {_MESSAGES}, {_scanned_sql()} SELECT conversation, id, score FROM scanned WHERE outcome = 'rejected'")
def rejected_messages(spark, folder):
    return gr.rejected_messages(_scanned(_conversations(spark, folder)))


@query(
    f"""WITH {_MESSAGES}, models AS (SELECT r_name AS domain, lower(r_name) || '-model' AS model_name,
        0.3 + 0.2 * r_regionkey AS threshold FROM region WHERE r_regionkey < 4),
      placed AS (SELECT messages.*, r_name AS domain, model_name, threshold FROM messages
        JOIN region ON r_regionkey = conversation % 5 LEFT JOIN models ON domain = r_name),
      {_scanned_sql('coalesce(threshold, 0.5)', 'placed', ', domain, model_name')}
    SELECT domain, model_name, outcome, count(*) AS messages FROM scanned GROUP BY domain, model_name, outcome"""
)
def domain_risk(spark, folder):
    """Each conversation belongs to a domain whose model sets the limit; one domain has no model."""
    region = table(spark, folder, "region").withColumn("r_regionkey", F.col("r_regionkey").cast("long"))
    models = region.filter("r_regionkey < 4").select(
        F.col("r_name").alias("domain"), F.concat(F.lower("r_name"), F.lit("-model")).alias("model_name"),
        (F.lit(0.3) + F.lit(0.2) * F.col("r_regionkey")).alias("threshold"),
    )
    messages = _conversations(spark, folder).withColumn("r_regionkey", F.col("conversation") % 5)
    placed = messages.join(region, "r_regionkey").withColumnRenamed("r_name", "domain")
    limits = gr.with_domain_threshold(placed, models)
    scanned = _scanned(limits, threshold=F.coalesce("threshold", F.lit(gr.REJECT_FROM)))
    return scanned.groupBy("domain", "model_name", "outcome").agg(F.count("*").alias("messages"))


@query(
    """SELECT "from", "to", problem, count(*) AS messages FROM (SELECT
      CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'ai' END AS "from",
      CASE role WHEN 'user' THEN 'ai' WHEN 'assistant' THEN 'user' END AS "to",
      CASE WHEN role = 'system' THEN 'unknown role' WHEN length(repeat(text, 20)) > 10024 THEN 'content too long' END AS problem
      FROM conversations) GROUP BY 1, 2, 3"""
)
def message_problems(spark, folder):
    """Messages twenty times over, with a role nobody knows, against the scanner's request rules."""
    odd = table(spark, folder, "conversations").withColumns(
        {"text": F.repeat("text", F.lit(20)), "role": F.when(F.col("role") == "system", "robot").otherwise(F.col("role"))}
    )
    return gr.as_messages(odd).groupBy("from", "to", "problem").agg(F.count("*").alias("messages"))
