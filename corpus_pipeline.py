"""A training corpus in five stages, from raw documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of documents, and every stage takes docs with further columns too.
No documents give none at any stage; what the stages do with nulls, empty texts, ties and repeated rows stands with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import lines, mixing, near, quality, transducer
from cloakframe.llm.common import table
from cloakframe.session import attach, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score below the threshold go; a score at the threshold stays.  Null and empty
    texts have no words and go.  Each row is judged by itself, so repeated rows stay or go together."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites are taken out of the texts; no row goes.  Null and empty texts stay as they are, a null
    source is a site of its own, equal texts lose the same lines."""
    return lines.remove_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingle sets of similarity 0.8 or more one row stays: the smallest doc_id,
    null last, then the smallest hash of the text.  Texts without words are linked with nothing; of rows equal in doc_id
    and text one stays."""
    return near.keep_one(docs, near.NearConfig())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents as often and as far as their sources' targets take them, sorted by training position,
    equal positions by doc_id.  Texts without words are never taken; a null source is a source; repeated rows take their
    own places."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position, doc_id, lang, source, n_tokens, ids, n_chars, ids_md5 and exact of every reading of the stream.

    Sorting by position gives the training order.  The ids are decoded again: ``exact`` says that the text came back.  Null and
    empty texts have no ids, and are exact.  Repeated rows agree but for their position."""
    keep = ("position", "doc_id", "lang", "source")
    return transducer.encode_documents(mixing.with_stored_order(docs), transducer.Vocabulary.read(), keep=keep, digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("sentencepiece encoding and decoding", encode),
]

#: Hashed n-grams, sketches, minimum hashes and shortest paths cannot be said in SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table of documents."""
    attach(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = settle(docs, f"stage{number}")
    return docs
