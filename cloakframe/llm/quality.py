"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Unigrams and bigrams of letter and punctuation runs are hashed to a fixed number of buckets.  Raw counts are taken
over all documents, the target's over all trusted ones.  A document's score is the mean of log(p_target / p_raw) over
its n-grams, and every document is held against one threshold, set where all labelled documents are parted best; for
that a trusted one is scored by the target without its own n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, bounded_sample, running_total
from .words import SPACE, Texts, Words, chunks, cut, mix64, ngrams

_U = np.uint64

#: Fixed by the rules: symbols counted, window length in words, least words, most repeated words in percent.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

#: Classes of bytes for the n-grams: 0 white space, 1 letters, digits and all of other scripts, 2 ASCII punctuation.
RUNS = np.array([0 if SPACE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
#: All but the line feed is one class: lines.
LINES = (np.arange(256) != 10).astype(np.uint8)


@dataclass(frozen=True)
class QualityConfig:
    """``buckets`` of the hash; ``smoothing`` is added to every bucket.  All labelled documents are used, unless a caller
    with more of them than wanted bounds them: then at most ``trusted_rows`` + ``tuning_rows`` labelled 1 and
    ``tuning_rows`` labelled 0, in hash order of doc_id."""

    buckets: int = 1 << 16
    trusted_rows: int | None = None
    tuning_rows: int | None = None
    smoothing: float = 1.0


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    threshold: float


def _per_text_distinct(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys of texts: how often each stands in its own text, number of keys and of distinct keys by text."""
    own = mix64(keys + (owner.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    _, place, inverse, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    return times[inverse], np.bincount(owner, minlength=texts), np.bincount(owner[place], minlength=texts)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    count = len(texts)
    data = texts.data
    out = {
        "n_words": np.diff(words.first),
        "word_chars": texts.per_text(((data & 0xC0) != 0x80) & ~SPACE[data]),
        "n_symbols": texts.per_text(SYMBOLS[data]),
    }
    lines = cut(texts, LINES)
    filled = np.concatenate(([0], np.cumsum(~SPACE[data])))
    kept = filled[lines.ends] > filled[lines.starts]
    _, all_lines, distinct = _per_text_distinct(lines.hashes[kept], lines.text_of()[kept], count)
    out["n_dup_lines"] = all_lines - distinct
    windows, whole = ngrams(words, WINDOW)
    begins = np.flatnonzero(whole)
    times, _, _ = _per_text_distinct(windows[begins], words.text_of()[begins], count)
    again = begins[times > 1]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    out["n_repeat_words"] = covered[words.first[1:]] - covered[words.first[:-1]]
    return out


def failed_base(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def _features(texts: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and the text each is of."""
    runs = cut(texts, RUNS)
    owner = runs.text_of()
    pairs, whole = ngrams(runs, 2)
    keys = np.concatenate((mix64(runs.hashes), pairs[whole])) % _U(buckets)
    return keys.astype(np.int64), np.concatenate((owner, owner[whole]))


def _mean_weight(texts: Texts, weights: np.ndarray) -> np.ndarray:
    keys, owner = _features(texts, len(weights))
    total = np.bincount(owner, weights=weights[keys], minlength=len(texts))
    return total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, texts in chunks(batch.column("text")):
            counts += np.bincount(_features(texts, buckets)[0], minlength=buckets)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])


def ngram_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Counts over all of ``docs``: a task sends a row a bucket, and one number a bucket comes to the driver."""
    sent = docs.select("text").mapInArrow(lambda it: _counted(it, buckets), "bucket long, n long")
    out = np.zeros(buckets)
    for bucket, n in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def _judged(batches: Iterator[pa.RecordBatch], model: QualityModel, passed: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in chunks(batch.column("text")):
            base = base_counts(texts, cut(texts))
            failed = failed_base(base)
            score = _mean_weight(texts, model.weights)
            columns = [batch.column(c).slice(begin, len(texts)) for c in passed]
            columns += [pa.array(base[c].astype(np.int64)) for c in BASE]
            columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= model.threshold))]
            yield pa.RecordBatch.from_arrays(columns, [*passed, *BASE, "base_failed", "llr", "kept"])


JUDGED = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, llr double, kept boolean"


def judge(docs: DataFrame, model: QualityModel, keep: str = "doc_id") -> DataFrame:
    """Column ``keep`` of every document with its counts, score and verdict.  Null text counts as empty: 0 words,
    base_failed.  Every row is judged by itself, so repeated rows agree; other columns are left behind."""
    return docs.select(keep, "text").mapInArrow(
        lambda it: _judged(it, model, [keep]), f"`{keep}` {docs.schema[keep].dataType.simpleString()}, {JUDGED}"
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that pass, all their columns as they were, in one pass without a shuffle.  Null and empty texts have no
    words and go; a score at the threshold passes; repeated rows agree; no rows give none."""

    def passing(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                failed = failed_base(base_counts(texts, cut(texts)))
                kept = ~failed & (_mean_weight(texts, model.weights) >= model.threshold)
                yield batch.slice(begin, len(texts)).filter(pa.array(kept))

    return docs.mapInArrow(passing, docs.schema)


def _both_ways(batches: Iterator[pa.RecordBatch], weights: np.ndarray, target: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Scores of the documents that pass the base rules, as they count if not trusted and if trusted: a trusted one's own
    n-grams are taken out of ``target`` (smoothed counts) first."""
    buckets, total = len(weights), target.sum()
    for batch in batches:
        for begin, texts in chunks(batch.column("text")):
            keys, owner = _features(texts, buckets)
            held = np.bincount(owner, minlength=len(texts))
            _, inverse, times = np.unique(owner * np.int64(buckets) + keys, return_inverse=True, return_counts=True)
            with np.errstate(divide="ignore", invalid="ignore"):  # the target need not hold the n-grams of one that is not trusted
                less = np.bincount(owner, weights=np.log1p(-times[inverse] / target[keys]), minlength=len(texts))
                rest = np.log1p(-held / total)
            score = _mean_weight(texts, weights)
            trusted = score + less / np.maximum(held, 1) - rest
            passed = pa.array(~failed_base(base_counts(texts, cut(texts))))
            columns = [batch.column("doc_id").slice(begin, len(texts)), pa.array(score), pa.array(trusted)]
            yield pa.RecordBatch.from_arrays([c.filter(passed) for c in columns], ["doc_id", "other", "trusted"])


#: Bits of a filter of doc_ids, 8 MB however many there are, and of a piece of it, 4 KB.
BITS, PIECE_SHIFT = 1 << 26, 15


def _likely(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``marks``: all that are, and of the others those that share a bit of a
    filter of bounded size, so a join by shuffle moves few texts only to drop them.  If the ids are not integers of one
    type, which hash alike, all rows."""
    kind = docs.schema["doc_id"].dataType
    if kind != marks.schema["doc_id"].dataType or not isinstance(kind, IntegralType):
        return docs
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    piece, place = F.shiftright(bit, PIECE_SHIFT), bit.bitwiseAND((1 << PIECE_SHIFT) - 1)
    pieces = (
        marks.select(piece.alias("__piece"), place.alias("__place"))
        .repartition("__piece")
        .groupBy("__piece")
        .agg(F.bitmap_construct_agg("__place").alias("__bits"))
    )
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10)
    held = F.getbit(byte.cast("int"), place.bitwiseAND(7).cast("int")) == 1
    return docs.join(F.broadcast(pieces), piece == F.col("__piece")).where(held).select(docs.columns)


def _chosen(one_each: DataFrame, config: QualityConfig) -> DataFrame:
    """(doc_id, label) of all labelled documents, or of as many of each label as the bounds allow."""
    tuning, trusted = config.tuning_rows, config.trusted_rows
    for label, rows in ((0, tuning), (1, None if None in (trusted, tuning) else trusted + tuning)):
        if rows is not None:
            of_label = F.col("label") == label
            one_each = one_each.where(~of_label).unionByName(bounded_sample(one_each.where(of_label), rows, "doc_id"))
    return one_each


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """``labels`` has doc_id and quality (1 trusted, 0 not); a document with both counts as 0, null labels do not
    count.  Without trusted labels all n-grams weigh nothing, without both labels the base rules alone decide."""
    one_each = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    )
    scratch = Scratch(docs.sparkSession)
    # labels grow with the documents, so what is right for few of them is not chosen: the joins are by shuffle at every size;
    # only texts that make the target are moved, and none is stored
    marks = scratch.settle(_chosen(one_each, config), "marks")
    good, docs = marks.where("label = 1"), docs.select("doc_id", "text")
    target = ngram_counts(_likely(docs, good).join(good.hint("merge"), "doc_id"), config.buckets) + config.smoothing
    raw = ngram_counts(docs, config.buckets) + config.smoothing
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if target.sum() == config.smoothing * config.buckets:
        weights = np.zeros(config.buckets)
    ways = _likely(docs, marks).mapInArrow(
        lambda it: _both_ways(it, weights, target),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, other double, trusted double",
    )
    llr = F.when(F.col("label") == 1, F.col("trusted")).otherwise(F.col("other"))
    scored = ways.join(marks.hint("merge"), "doc_id").select("label", llr.alias("llr"))
    threshold = best_threshold(scratch.settle(scored, "scored"))
    scratch.drop()
    return QualityModel(weights, threshold)


CELLS = 1 << 14  # cells of scores in a unit, which are put in order on their own


def best_threshold(scored: DataFrame) -> float:
    """Half way between the two neighbouring scores (``llr``) that part the labels with the best mean of both hit rates; of
    equally good places the lowest, so that in doubt documents stay.  Rows are counted by score and running totals taken
    cell by cell, so no task and not the driver holds all scores."""
    good, bad = scored.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not good or not bad:
        return float("-inf")
    places = scored.groupBy("llr").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    cell = F.floor(F.col("llr") * CELLS)
    below = running_total(running_total(places, [], ["llr"], "good", "good_below", cell), [], ["llr"], "bad", "bad_below", cell)
    balance = (F.lit(good) - F.col("good_below")) / F.lit(good) + F.col("bad_below") / F.lit(bad)
    best = below.orderBy(balance.desc(), "llr").first()["llr"]
    before = scored.where(F.col("llr") < best).agg(F.max("llr")).first()[0]
    return best if before is None else (before + best) / 2
