"""Mixing sources to target weights along a time-varying curriculum.

A source's schedule says how its weight runs over training time 0..1 (linear between knots).  Its integral is the
source's cumulative demand; the demand inverted at a document's place in its source's stream is the document's
training position.  Everything is DataFrame arithmetic: one narrow row a document decides, text is moved only by
the final range sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .common import running_total, word_count

#: Fixed by the mix: sources in code point order weigh these in turn, share 150 % of all words, and none is
#: repeated more than twice.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
REPEATS = 2

#: Weight schedules as (time, relative weight) knots, taken in turn like the weights: steady, fading, rising.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.25), (0.75, 1.0), (1.0, 2.0)),
)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS
) -> DataFrame:
    """Words to take of each source: (source, source_size) -> (+ source_rank from 0, target double).

    Sharing by weight, stopping each source at ``repeats`` times its size and resharing what is left until none is
    above, ends where one level L gives every source min(repeats * size, weight * L).  Sources sorted by
    repeats * size / weight fill up in that order, so L follows from running sums.  The table has a row a source."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("__full", "source_rank")
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weigh = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_rank") % len(weights))
    cap = (F.col("source_size") * repeats).cast("double")
    ranked = sizes.withColumn("source_rank", F.row_number().over(rank) - 1)
    filled = (
        ranked.withColumn("__weight", weigh)
        .withColumn("__cap", cap)
        .withColumn("__full", F.col("__cap") / F.col("__weight"))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(below), F.lit(0.0)))
        .withColumn("__open", F.sum("__weight").over(every) - F.coalesce(F.sum("__weight").over(below), F.lit(0.0)))
        .withColumn("__budget", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("__level", (F.col("__budget") - F.col("__capped")) / F.col("__open"))
        # the first source, in filling order, that the level leaves below its cap sets the level for all after it;
        # later ones would only give lower levels
        .withColumn("__level", F.max(F.when(F.col("__level") < F.col("__full"), F.col("__level"))).over(every))
    )
    open_share = F.col("__weight") * F.col("__level")
    target = F.when(F.col("__level").isNull() | (open_share >= F.col("__cap")), F.col("__cap")).otherwise(open_share)
    return filled.select("source", "source_size", "source_rank", target.alias("target"))


def invert_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which a source whose weight runs through ``knots`` has served ``share`` (0..1) of its demand."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((area, t0, t1, w0, w1))
        area += (t1 - t0) * (w0 + w1) / 2
    if area <= 0:
        raise ValueError("a schedule needs a positive weight somewhere")
    demand = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(area)
    time = F.lit(float(knots[-1][0]))
    for start, t0, t1, w0, w1 in reversed(pieces):
        end, slope = start + (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        rest = F.greatest(demand - F.lit(start), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
        lasted = F.try_divide(rest * 2, root + F.lit(w0))
        time = F.when((demand < F.lit(end)) & (rest > 0), F.lit(t0) + lasted).when(demand < F.lit(end), F.lit(t0)).otherwise(time)
    return time


def positions(schedules: Sequence[Sequence[tuple[float, float]]], share: Column, rank: Column) -> Column:
    turn = rank % len(schedules)
    cases = [(turn == i, invert_demand(share, knots)) for i, knots in enumerate(schedules)]
    return reduce(lambda done, case: done.when(*case), cases[1:], F.when(*cases[0]))


def mix_plan(
    docs: DataFrame,
    keep: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    repeats: int = REPEATS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, source_rank, taken, passes.

    A source's documents stand in the order of the MD5 digests of their ids (of their content, where null) and are read round and round until the target is
    reached; the document at its end is cut there, so a source's words are exactly floor(target).  ``passes`` lists
    (pass, words, position) in order.  Null text or text without words: size 0, nothing taken, no passes.  A null
    source is a source of its own, last in order.  Repeated rows take their own places.  No rows, no plan.
    ``keep`` names further columns of ``docs`` to carry along as ``__kept_<name>``."""
    rows = docs.select(
        "doc_id",
        "source",
        word_count("text").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).cast("binary")).alias("__place"),
        F.xxhash64("text").alias("__content"),
        *[F.col(f"`{c}`").alias(f"__kept_{c}") for c in keep],
    )
    sizes = docs.select("source", word_count("text").alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, repeats).withColumnRenamed("source", "__source")
    # a row for each source, stored, so that Catalyst knows the size: few sources are broadcast and move no text
    targets = settle(targets, "targets")
    rows = rows.join(targets, on=F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # a source's order is that of the ids' digests; their first three digits make the buckets
    order, bucket = ["__place", "doc_id", "__content", "size"], F.substring("__place", 1, 3)
    placed = running_total(rows, ["source_rank"], order, "size", "__start", bucket)
    want = F.floor("target").cast("long")
    numbers = F.sequence(F.lit(0), F.lit(repeats - 1))

    def one(number: Column) -> Column:
        begin = F.col("__start") + F.col("source_size") * number
        words = F.least(F.greatest(want - begin, F.lit(0).cast("long")), F.col("size"))
        share = F.try_divide(begin + words / 2, F.col("target"))
        return F.struct(
            number.alias("pass"), words.alias("words"), positions(schedules, share, F.col("source_rank")).alias("position")
        )

    listed = placed.withColumn("passes", F.filter(F.transform(numbers, one), lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return listed.withColumn("taken", taken).drop("__start", "__place", "__content")


def mixed(docs: DataFrame, **plan) -> DataFrame:
    """The training stream itself: the columns of ``docs``, one row for each reading of a document, in order of
    position over range partitions.  A reading cut by the end of its source's target holds that many words of the
    text, white space between them as it was.  Columns named doc_id, source and text are needed; others stay."""
    own = docs.columns
    others = [c for c in own if c not in ("doc_id", "source")]
    planned = mix_plan(docs, keep=others, **plan)
    readings = planned.select("doc_id", "source", "size", *[f"`__kept_{c}`" for c in others], F.explode("passes").alias("__reading"))
    words = F.col("__reading.words")
    cut = F.when(words == F.col("size"), F.col("__kept_text")).otherwise(first_words(F.col("__kept_text"), words))
    return (
        readings.withColumn("__kept_text", cut)
        .withColumn("__position", F.col("__reading.position"))
        .orderBy("__position", "doc_id")
        .select(*[F.col(c) if c in ("doc_id", "source") else F.col(f"`__kept_{c}`").alias(c) for c in own])
    )


def with_stored_order(docs: DataFrame, into: str = "position") -> DataFrame:
    """The rows with their place in a table as Spark wrote it: the number of the part times 2**40 plus the row in it.  Of a
    range-sorted table, as :func:`mixed` makes it, that is its order, which a scan alone does not keep.  Rows that come from no
    file are numbered in the order of their partitions.  A column named ``into`` is replaced."""
    part = F.regexp_extract("_metadata.file_name", r"part-([0-9]+)", 1).cast("long")
    try:
        return docs.withColumn(into, F.shiftleft(part, 40) + F.col("_metadata.row_index"))
    except AnalysisException:
        return docs.withColumn(into, F.monotonically_increasing_id())


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word."""
    words = F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)")), F.lit(1), count.cast("int"))
    return F.array_join(words, "")
