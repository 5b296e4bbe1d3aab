"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings (so that inflected forms meet), hashed to buckets.  Buckets are kept that
labelled documents tie to a label, alone or in a pair with any other: a first machine is fitted on those with a tie of their own, and
every pair of frequent buckets is tested for what it leaves unexplained.  The machine learns a weight for each kept bucket and, through
factors, for each pair of them, so that two terms together can weigh more or less than both alone.  It is fitted
on a bounded labelled sample; documents are scored in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bounded_sample
from .words import Texts, chunks, cut, mix64, powers, _BASE, _INVERSE, _byte_values

_U = np.uint64


@dataclass(frozen=True)
class ToxicityConfig:
    """``train_rows`` bounds the labelled sample, taken in hash order of doc_id.  ``beginnings`` are the
    bytes taken of a word besides the whole.  A bucket in ``least_documents`` of the sample or more is kept if its own
    tie is ``least_tie`` standard deviations or more, or if it is in a pair whose tie chance would not give once among
    all pairs tested.  ``pair_tasks`` is how many tasks share the pairs."""

    train_rows: int = 40_000
    buckets: int = 1 << 20
    beginnings: tuple[int, ...] = (4, 5, 6)
    least_documents: int = 8
    least_tie: float = 5.0
    factors: int = 8
    epochs: int = 30
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7
    pair_tasks: int = 48


@dataclass(frozen=True)
class ToxicityModel:
    place: np.ndarray  # of each bucket among the terms, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    beginnings: tuple[int, ...]


def _terms(texts: Texts, buckets: int, beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word beginning, repeats and all."""
    words = cut(texts, LETTERS, fold=True)
    owner, keys = words.text_of(), [mix64(words.hashes)]
    size = len(texts.data)
    sums = np.zeros(size + 1, _U)
    if size:
        np.cumsum(_byte_values(True)[texts.data] * powers(_BASE, size), out=sums[1:])
        back = powers(_INVERSE, size)[words.starts]
        for length in beginnings:
            ends = np.minimum(words.starts + length, words.ends)
            keys.append(mix64((sums[ends] - sums[words.starts]) * back + _U(length)))
    return np.tile(owner, len(keys)), (np.concatenate(keys) % _U(buckets)).astype(np.int64)


#: Terms are runs of letters, digits and bytes of other scripts.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)], np.uint8)


def _distinct(owner: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owner * width + key)
    return pairs // width, pairs % width


def _frequencies(batches: Iterator[pa.RecordBatch], config: ToxicityConfig) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each bucket, and the sum of their hashes: buckets that agree in all three
    are in the same documents."""
    held, marks = np.zeros((2, config.buckets), np.int64), np.zeros(config.buckets, _U)
    for batch in batches:
        label, mark = batch.column("label").to_numpy(), mix64(batch.column("mark").to_numpy().view(_U))
        for begin, texts in chunks(batch.column("text")):
            owner, key = _distinct(*_terms(texts, config.buckets, config.beginnings), config.buckets)
            np.add.at(marks, key, mark[begin + owner])
            for value in (0, 1):
                held[value] += np.bincount(key[label[begin + owner] == value], minlength=config.buckets)
    filled = np.flatnonzero(held.sum(axis=0))
    columns = [pa.array(filled), pa.array(held[0][filled]), pa.array(held[1][filled]), pa.array(marks[filled].view(np.int64))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "clean", "toxic", "mark"])


def _placed(texts: Texts, place: np.ndarray, beginnings: tuple[int, ...], terms: int) -> tuple[np.ndarray, np.ndarray]:
    owner, key = _terms(texts, len(place), beginnings)
    at = place[key]
    chosen = at >= 0
    return _distinct(owner[chosen], at[chosen].astype(np.int64), max(terms, 1))


def _machine(owner: np.ndarray, term: np.ndarray, texts: int, bias: float, weights: np.ndarray, factors: np.ndarray):
    """bias + sum of weights + sum of factor products over all pairs of a text's terms; and the factor sums."""
    linear = np.bincount(owner, weights=weights[term], minlength=texts)
    sums = np.zeros((texts, factors.shape[1]))
    squares = np.zeros(texts)
    for f in range(factors.shape[1]):
        v = factors[term, f]
        sums[:, f] = np.bincount(owner, weights=v, minlength=texts)
        squares += np.bincount(owner, weights=v * v, minlength=texts)
    return bias + linear + ((sums**2).sum(axis=1) - squares) / 2, sums


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _train(owner: np.ndarray, term: np.ndarray, label: np.ndarray, terms: int, config: ToxicityConfig):
    """Logistic loss, AdaGrad over shuffled blocks of documents; the seed makes reruns agree."""
    draw = np.random.default_rng(config.seed)
    rate = float(np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3))
    bias, weights, factors = np.log(rate / (1 - rate)), np.zeros(terms), draw.normal(0, 0.01, (terms, config.factors))
    g_bias, g_weights, g_factors = 1e-6, np.full(terms, 1e-6), np.full((terms, config.factors), 1e-6)
    first = np.searchsorted(owner, np.arange(len(label) + 1))
    for _ in range(config.epochs):
        order = draw.permutation(len(label))
        for at in range(0, len(order), 512):
            block = order[at : at + 512]
            sizes = first[block + 1] - first[block]
            line = np.repeat(first[block] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            own, t = np.repeat(np.arange(len(block)), sizes), term[line]
            x, sums = _machine(own, t, len(block), bias, weights, factors)
            off = (_chance(x) - label[block]) / len(block)
            grad = off.sum()
            g_bias += grad * grad
            bias -= config.rate * grad / np.sqrt(g_bias)
            used, back = np.unique(t, return_inverse=True)
            grad = np.bincount(back, weights=off[own], minlength=len(used)) + config.decay * weights[used]
            g_weights[used] += grad * grad
            weights[used] -= config.rate * grad / np.sqrt(g_weights[used])
            for f in range(config.factors):
                v = factors[used, f]
                grad = np.bincount(back, weights=off[own] * (sums[own, f] - factors[t, f]), minlength=len(used)) + config.decay * v
                g_factors[used, f] += grad * grad
                factors[used, f] -= config.rate * 0.5 * grad / np.sqrt(g_factors[used, f])
    return float(bias), weights, factors


def _surprise(total: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Bennett's bound for a sum of independent terms of at most 1 with this variance, as minus the logarithm of the chance.  Together
    convex and homogeneous, so that of a sum it is at most the sum of those of its terms."""
    ratio = np.abs(total) / variance
    return variance * ((1 + ratio) * np.log1p(ratio) - ratio)


def _ceilings(batches: Iterator[pa.RecordBatch], place: np.ndarray, beginnings: tuple[int, ...], terms: int, rows: np.ndarray, off: np.ndarray, spread: np.ndarray):
    """Of each term, the sum of its documents' surprises to either side: no pair of it can have more."""
    held, single = np.zeros((2, terms)), _surprise(off, spread)
    for batch in batches:
        at = np.searchsorted(rows, batch.column("row").to_numpy())
        for begin, texts in chunks(batch.column("text")):
            owner, term = _placed(texts, place, beginnings, terms)
            doc = at[begin + owner]
            for side in (0, 1):
                held[side] += np.bincount(term, weights=single[doc] * ((off[doc] > 0) == side), minlength=terms)
    filled = np.flatnonzero(held.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(held[0][filled]), pa.array(held[1][filled])], ["term", "below", "above"])


def _paired(numbers: np.ndarray, tasks: int, limit: float, first: np.ndarray, terms: np.ndarray, off: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Terms, numbered by falling frequency, of the pairs whose sum of ``off``, what is left unexplained, surprises by ``limit``.
    Task k tests terms k, k + tasks, ... with all more frequent ones, which stand before them in a document."""
    many = int(terms.max()) + 1 if len(terms) else 0
    found = np.zeros(many, bool)
    order = np.argsort(terms, kind="stable")
    ends = np.searchsorted(terms[order], np.arange(many + 1))
    for number in numbers:
        for term in range(int(number), many, tasks):
            places = np.sort(order[ends[term] : ends[term + 1]])
            doc = np.searchsorted(first, places, side="right") - 1
            before = places - first[doc]
            total, variance = np.zeros(term), np.zeros(term)
            cuts = np.searchsorted(np.cumsum(before), np.arange(1, int(before.sum()) // _VISITS + 1) * _VISITS)
            for part in np.split(np.arange(len(places)), cuts):
                size = before[part]
                line = np.arange(size.sum()) + np.repeat(first[doc[part]] - (np.cumsum(size) - size), size)
                other = terms[line]
                total += np.bincount(other, weights=np.repeat(off[doc[part]], size), minlength=term)
                variance += np.bincount(other, weights=np.repeat(spread[doc[part]], size), minlength=term)
            met = np.flatnonzero(variance)
            tied = met[_surprise(total[met], variance[met]) >= limit]
            found[tied] = True
            found[term] |= len(tied) > 0
    return np.flatnonzero(found)


#: Pairs that are counted at once.
_VISITS = 1 << 20


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """``labels`` has doc_id and toxic (0 or 1); a document with both counts as 1, nulls do not count.  Without
    labels every document scores one half; with one label only, near that label."""
    one_each = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    # At most train_rows ids are sent to every task, a bound that does not grow with the data.
    ids = bounded_sample(one_each, config.train_rows, "doc_id")
    scratch = Scratch(docs.sparkSession)
    sample = scratch.settle(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label", F.monotonically_increasing_id().alias("row")), "labelled")

    counted = sample.select("text", "label", F.xxhash64("doc_id").alias("mark")).mapInArrow(
        lambda it: _frequencies(it, config), "bucket long, clean long, toxic long, mark long"
    )
    held = counted.groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("mark")
    )
    seen = sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {r["label"]: r["n"] for r in seen}
    n0, n1 = max(size.get(0, 0), 1), max(size.get(1, 0), 1)
    both = F.col("clean") + F.col("toxic")
    share = (both + 1) / F.lit(float(n0 + n1 + 2))
    tie = F.abs(F.col("toxic") / F.lit(float(n1)) - F.col("clean") / F.lit(float(n0))) / F.sqrt(share * (1 - share) * F.lit(1 / n0 + 1 / n1))
    # Buckets in the same documents (a word and its beginnings, mostly) are one term here, by falling frequency.  There are at
    # most ``buckets`` of them, and no more than the sample has words.
    same = F.pmod("mark", F.lit(str(2**64)).cast("decimal(38,0)"))
    terms = (
        held.where(both >= config.least_documents)
        .select("bucket", "clean", "toxic", both.alias("both"), (tie >= config.least_tie).alias("strong"), same.alias("mark"))
        .groupBy("clean", "toxic", "both", "strong", "mark").agg(F.sort_array(F.collect_list("bucket")).alias("members"))
        .select("both", "strong", "members").toArrow()
    )
    rank = pa.compute.sort_indices(terms.append_column("least", pa.compute.list_element(terms["members"], 0)), [("both", "descending"), ("least", "ascending")])
    terms = terms.take(rank).combine_chunks()
    members, kept = terms["members"].to_pylist(), terms["strong"].to_numpy()

    def where(chosen: np.ndarray) -> np.ndarray:
        """Place of each bucket that stands for a chosen term among these, in their order, or -1."""
        place = np.full(config.buckets, -1, np.int32)
        place[[members[i][0] for i in chosen]] = np.arange(len(chosen))
        return place

    def gathered(chosen: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """doc_id, label and row of the sample by doc_id; where each one's terms begin; and its terms, numbered as chosen."""
        place, many, beginnings = where(chosen), len(chosen), config.beginnings

        def placed(batches):
            for batch in batches:
                for begin, texts in chunks(batch.column("text")):
                    owner, term = _placed(texts, place, beginnings, many)
                    first = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(first), pa.array(term.astype(np.int32)))
                    own = batch.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([*own.select(["doc_id", "label", "row"]).columns, lists], ["doc_id", "label", "row", "terms"])

        id_type = docs.schema["doc_id"].dataType.simpleString()
        rows = sample.mapInArrow(placed, f"doc_id {id_type}, label int, row long, terms array<int>").toArrow()
        rows = rows.sort_by([("doc_id", "ascending"), ("row", "ascending")]).combine_chunks()
        lists = rows["terms"].combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
        return rows.drop_columns("terms"), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), lists.flatten().to_numpy()

    def trained(chosen: np.ndarray):
        """A machine over all buckets of the chosen terms; row, label and given chance of each document of the sample."""
        rows, first, found = gathered(chosen)
        width = np.array([len(members[i]) for i in chosen], np.int64)
        wide = width[found]
        owner = np.repeat(np.repeat(np.arange(len(rows)), np.diff(first)), wide)
        term = np.repeat((np.cumsum(width) - width)[found] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        label = rows["label"].to_numpy().astype(float)
        machine = _train(owner, term, label, int(width.sum()), config)
        return machine, rows["row"].to_numpy(), label, _chance(_machine(owner, term, len(label), *machine)[0])

    chosen = np.flatnonzero(kept)
    machine, row, label, chance = trained(chosen)
    base = label.mean() if len(label) else 0.0
    if 0 < base < 1:
        off, spread = label - chance, np.maximum(chance * (1 - chance), base * (1 - base))
        # One in the number of pairs, each tested to both sides.
        limit = float(np.log(max(len(members), 2) ** 2))
        order = np.argsort(row)
        by_row, every = (row[order], off[order], spread[order]), where(np.arange(len(members)))
        many, beginnings = len(members), config.beginnings
        ceilings = sample.select("row", "text").mapInArrow(
            lambda it: _ceilings(it, every, beginnings, many, *by_row), "term long, below double, above double"
        )
        ceilings = ceilings.groupBy("term").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
        # The millionth is for the order of the sums.
        open_ = np.sort(ceilings.where(F.greatest("below", "above") >= limit * (1 - 1e-6)).select("term").toArrow()["term"].to_numpy())
        if len(open_) > 1:
            _, first, found = gathered(open_)
            sent = docs.sparkSession.sparkContext.broadcast((first, found, off, spread))
            tasks = min(config.pair_tasks, len(open_))

            def paired(batches):
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(_paired(batch.column("id").to_numpy(), tasks, limit, *sent.value))], ["term"])

            told = docs.sparkSession.range(0, tasks, 1, tasks).mapInArrow(paired, "term long").distinct().toArrow()["term"].to_numpy()
            sent.destroy()
            more = np.union1d(chosen, open_[told])
            if len(more) > len(chosen):
                chosen = more
                machine = trained(chosen)[0]
    scratch.drop()
    place = np.full(config.buckets, -1, np.int32)
    strong = [bucket for i in chosen for bucket in members[i]]
    place[strong] = np.arange(len(strong))
    return ToxicityModel(place, *machine, config.beginnings)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every document; null and empty texts get the score of no terms.  Rows are scored by
    themselves, so repeated rows agree.  Other columns are left behind."""

    def scored(batches):
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                owner, term = _placed(texts, model.place, model.beginnings, len(model.weights))
                x, _ = _machine(owner, term, len(texts), model.bias, model.weights, model.factors)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(texts)), pa.array(_chance(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
