"""Filter interaction audit by decision diagrams.

Every document's failed filters are one mask; a part (a language) is at most 32 masks with counts.  From these a
diagram is built whose nodes ask one filter each, whose leaves hold counts, and in which equal branches are one
node.  Neighbouring levels are swapped until every order of the filters has stood at the top once.  In a given
order the path on which every filter so far has passed holds the audit: what leaves it at a node is removed there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, text_or_empty

#: Fixed by the contract of the audit.
FILTERS = "ABCDE"
ODD_CHARACTER = "[#$%&*|]"

Weight = tuple[int, int, int]  # documents, good ones, toxic ones


def failed_filters(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: A under 100 words, B under 80 % distinct words, C over 10 % capitals
    A-Z, D an odd character.  An empty text fails A alone."""
    words = F.transform(
        F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
        lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")),
    )[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    failed = F.transform(
        F.array(words),
        lambda n: F.when(n["all"] < 100, 1).otherwise(0)
        + F.when(n["distinct"].cast("long") * 100 < n["all"].cast("long") * 80, 2).otherwise(0),
    )[0]
    return failed + F.when(capitals * 100 > F.char_length(text) * 10, 4).otherwise(0) + F.when(text.rlike(ODD_CHARACTER), 8).otherwise(0)


class Diagram:
    """A count-weighted decision diagram.  A node is (branch that passes, branch that fails, weight); a leaf has no
    branches.  Equal nodes are one, so a swap works on each once.  ``order`` names the filter of each level."""

    def __init__(self, weights: dict[int, Weight]):
        self.order = list(FILTERS)
        self._nodes: dict[tuple, tuple] = {}
        self.root = self._built(weights, 0, 0)

    def _node(self, passes, fails, weight: Weight) -> tuple:
        key = (id(passes), id(fails), weight)
        return self._nodes.setdefault(key, (passes, fails, weight))

    def _branch(self, passes: tuple, fails: tuple) -> tuple:
        return self._node(passes, fails, tuple(a + b for a, b in zip(passes[2], fails[2])))

    def _built(self, weights: dict[int, Weight], level: int, mask: int) -> tuple:
        if level == len(FILTERS):
            return self._node(None, None, weights.get(mask, (0, 0, 0)))
        return self._branch(self._built(weights, level + 1, mask), self._built(weights, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below it."""
        done: dict[int, tuple] = {}

        def swapped(node: tuple, depth: int) -> tuple:
            if id(node) not in done:
                passes, fails, _ = node
                if depth == level:
                    new = self._branch(self._branch(passes[0], fails[0]), self._branch(passes[1], fails[1]))
                else:
                    new = self._branch(swapped(passes, depth + 1), swapped(fails, depth + 1))
                done[id(node)] = new
            return done[id(node)]

        self.root = swapped(self.root, 0)
        self.order[level : level + 2] = self.order[level : level + 2][::-1]

    def all_pass(self) -> Iterator[tuple[str, Weight, Weight]]:
        """(filter, kept, removed) along the path on which all filters so far have passed."""
        node = self.root
        for name in self.order:
            passes, fails, _ = node
            yield name, passes[2], fails[2]
            node = passes


def neighbour_swaps(size: int) -> list[int]:
    """Places to swap with their right neighbours, one after the other, so that every order comes up once: the last
    element runs through each order of the others, to the front and back in turn."""
    swaps: list[int] = []
    for n in range(2, size + 1):
        to_front, to_back = list(range(n - 2, -1, -1)), list(range(n - 1))
        longer = to_front[:]
        for i, inner in enumerate(swaps):
            at_front = i % 2 == 0
            longer += [inner + at_front, *(to_back if at_front else to_front)]
        swaps = longer
    return swaps


STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def _audit(table: pa.Table) -> pa.Table:
    """All steps of one part from its masks."""
    rows = table.to_pylist()
    weights = {r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows}
    diagram, found = Diagram(weights), []
    for swap in [None, *neighbour_swaps(len(FILTERS))]:
        if swap is not None:
            diagram.swap(swap)
        order = "".join(diagram.order)
        found += [(order, step + 1, name, kept, removed) for step, (name, kept, removed) in enumerate(diagram.all_pass())]
    failing = {f: sum(w[0] for m, w in weights.items() if m >> i & 1) for i, f in enumerate(FILTERS)}
    alone = {f: weights.get(1 << i, (0,))[0] for i, f in enumerate(FILTERS)}
    shapley = {f: sum(removed[0] for _, _, name, _, removed in found if name == f) for f in FILTERS}
    names = [c.split()[0] for c in STEPS.split(", ")]
    columns = zip(
        *(
            (rows[0]["part"], order, step, kept[0], gone[0], failing[f] - gone[0], alone[f], gone[1], gone[2], shapley[f])
            for order, step, f, kept, gone in found
        )
    )
    types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail just these filters.

    A text is a repeat (filter E) if a smaller doc_id has the same; so of equal texts only the rows of the smallest
    doc_id pass.  A null doc_id neither fails E nor makes others fail it.  Rows are counted by text digest and id before
    copies meet, and copies meet as one row for each part and label, so a text on a third of all rows is no hot key."""
    flags = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"__{c}") for c in ("quality", "toxic")]
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__label_id")).agg(*flags)
    text = text_or_empty("text")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        failed_filters(text).alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    counted = rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # null ids meet no label; the digest spreads them over the join's tasks
    apart = F.when(F.col("id").isNull(), F.col("digest"))
    held = counted.withColumn("apart", F.coalesce(apart, F.lit(b""))).join(
        marked.withColumn("apart", F.lit(b"")).withColumnRenamed("__label_id", "id"), ["id", "apart"], "left"
    )
    held = held.withColumns({"good": F.coalesce("__quality", F.lit(0)), "toxic": F.coalesce("__toxic", F.lit(0))})
    groups = held.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("passing", F.col("no_id") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    told = groups.select("part", "good", "toxic", F.explode(both).alias("m")).where("m.n > 0")
    weigh = lambda c: F.sum(F.col("m.n") * F.col(c)).alias(c)
    return told.groupBy("part", F.col("m.mask").alias("mask")).agg(F.sum("m.n").alias("n"), weigh("good"), weigh("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step; see :data:`STEPS`.

    Needs doc_id, text and lang, and of labels doc_id, quality and toxic; other columns are left behind.  Null and empty
    lang are one part, null text is empty.  Repeated rows are documents of their own with the same id.  A document
    is good or toxic if any of its label rows says so; labels of no document do not count.  No rows, no parts."""
    return failure_masks(docs, labels).groupBy("part").applyInArrow(_audit, STEPS)
