"""The pipeline's stages, and the queries that SQL can say."""

from collections import Counter

import pytest
import sentencepiece

import __spark_entry__ as entry
import brute
import corpus_pipeline
from cloakframe.llm import mixing, quality, transducer
from cloakframe.llm.lines import LineConfig
from cloakframe.llm.mixing import WEIGHTS
from cloakframe.llm.queries import ORACLES, QUERIES
from conftest import DOCS
from oracle import connect, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    columns, rows = spark_rows(QUERIES[name](spark, folder))
    assert (columns, rows) == sql_rows(connect(folder), ORACLES[name])


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


def test_stages_return_documents(spark, folder, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, none):
        stage = start
        for number, (_, function) in enumerate(corpus_pipeline.STAGES):
            out = function(spark, stage, folder)
            if number < 4:
                assert out.columns == [f.split()[0] for f in DOCS.split(", ")]
            stage = out
        stage.count()


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.n_tokens == len(r.ids) and r.exact for r in rows) and len({r.position for r in rows}) == len(rows)


def test_positions_are_the_curriculum(spark, folder, tmp_path):
    """Sorted by position, the last stage's rows are the readings of the plan in training order."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = mixing.mix_plan(docs).selectExpr("doc_id", "inline(passes)").collect()
    want = [r.doc_id for r in sorted(plan, key=lambda r: (r.position, r.doc_id))]
    corpus_pipeline.mix_sources(spark, docs, folder).write.parquet(str(tmp_path / "stream"))
    stream = spark.read.parquet(str(tmp_path / "stream"))
    assert [r.doc_id for r in corpus_pipeline.encode(spark, stream, folder).orderBy("position").collect()] == want


def test_a_corpus_loaded_twice_leaves_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: sorted(map(repr, df.collect()))
    once = rows(corpus_pipeline.near_dedup(spark, docs, folder))
    assert rows(corpus_pipeline.near_dedup(spark, docs.unionByName(docs), folder)) == once


def test_operators_leave_the_session_as_it_was(spark, folder):
    settings = lambda: {r.key: r.value for r in spark.sql("SET").collect()}
    before = settings()
    for name, query in QUERIES.items():
        query(spark, folder).count()
        assert settings() == before, name


def clean_lines(rows):
    """Line dedup of (doc_id, text, source) rows in plain Python: doc_id -> text."""
    config, sites = LineConfig(), {}
    cut = {d: (t or "").split("\n") for d, t, _ in rows}
    for doc, _, source in rows:
        for line in cut[doc]:
            if brute.words(line):
                sites.setdefault(line.strip(" "), set()).add(source)
    bad = {line for line, held in sites.items() if len(held) >= config.sites}
    out = {}
    for doc, text, _ in rows:
        lines = [x for x in cut[doc] if brute.words(x)]
        gone = [x for x in lines if x.strip(" ") in bad]
        out[doc] = text if len(gone) == len(lines) or not gone else "\n".join(x for x in cut[doc] if not (brute.words(x) and x.strip(" ") in bad))
    return out


def test_each_stage_against_plain_python(spark, folder):
    """Every stage of the pipeline, over all that the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]

    good = stages[0](spark, docs, folder).cache()
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(docs, model).collect() if r.kept}
    assert {d for d, _, _ in rows(good)} == kept and set(rows(good)) <= set(rows(docs))
    for doc, text, _ in rows(docs):
        w = brute.words(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert doc not in kept or not (len(w) < 20 or 100 * len(covered) > 30 * len(w))

    cleaned = stages[1](spark, good, folder).cache()
    assert {d: t for d, t, _ in rows(cleaned)} == clean_lines(rows(good))

    single = stages[2](spark, cleaned, folder).cache()
    components = brute.near_components([(d, t) for d, t, _ in rows(cleaned)], 5, 4, 5)
    assert {d for d, _, _ in rows(single)} == {d for d, (_, c) in components.items() if d == c}

    stream, words = stages[3](spark, single, folder).cache(), Counter()
    sizes, texts = Counter(), {d: t for d, t, _ in rows(single)}
    for _, text, source in rows(single):
        sizes[source] += len(brute.words(text))
    for doc, text, source in rows(stream):
        words[source] += len(brute.words(text))
        assert texts[doc].startswith(text)
    assert words == {s: int(t) for s, t in brute.mix_targets(sizes, WEIGHTS).items()}

    library = sentencepiece.SentencePieceProcessor(model_file=transducer.MODEL)
    encoded = Counter((r.doc_id, tuple(r.ids)) for r in stages[4](spark, stream, folder).collect())
    assert encoded == Counter((d, tuple(library.encode(t))) for d, t, _ in rows(stream))
