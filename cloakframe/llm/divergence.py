"""Source divergence audit: how far the sources of a language are apart in the terms that they use.

Texts become term counts in one Arrow pipeline (lower-case, split, dictionary, hash group-by) inside the tasks, which
merge their counts before a row leaves them.  Counts are dealt out by language and term, so every shard holds whole
columns of the (source x term) table.  A shard's divergences are sums over its own terms; sums of shards add up."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, text_or_empty

#: Fixed by the contract: what stands between terms, and the scale of the shares.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE_STEPS, SCALE_STEP = 3, 1000  # 1,000,000,000 in steps whose products stay within 64 bits

BLOCK = 1 << 20  # bytes of text split at a time
HELD = 200_000  # merged counts a task holds before they leave it
CELLS = 1 << 19  # (term, source) cells of a block of divergences


@dataclass(frozen=True)
class DivergenceConfig:
    """Terms in ``documents`` rows of a language or more are kept; the ``top`` terms of a group are told.  ``shards``
    by term and tiles of about ``tile`` sources say how the work is dealt out, and change no result."""

    documents: int = 3
    top: int = 200
    shards: int = 64
    tile: int = 128


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, texts) of about BLOCK bytes.  A longer text is cut where a term ends, each piece
    being a block of its own under the same number."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = int(ends[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(ends, before + BLOCK, "right")), begin + 1)
        if int(ends[begin]) - before <= BLOCK:
            yield begin, texts.slice(begin, end - begin)
            begin = end
            continue
        text, at, gap = texts[begin].as_py(), 0, re.compile(BETWEEN)
        while at < len(text):
            cut = gap.search(text, at + BLOCK // 4)
            stop = cut.end() if cut else len(text)
            yield begin, pa.array([text[at:stop]])
            at = stop
        begin += 1


def _merged(tables: list[pa.Table], keys: list[str]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns([*keys, "n", "docs"])


def _block_counts(owners: np.ndarray, texts: pa.Array) -> pa.Table:
    """(owner, term, n) of a block of texts."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    terms, owner = pc.list_flatten(parts), pa.array(owners).take(pc.list_parent_indices(parts))
    some = pc.not_equal(terms, "")
    coded = terms.filter(some).dictionary_encode()
    counted = pa.table({"owner": owner.filter(some), "code": coded.indices}).group_by(["owner", "code"]).aggregate([([], "count_all")])
    return pa.table(
        {"owner": counted["owner"], "term": pa.chunked_array([coded.dictionary]).take(counted["code"]), "n": counted["count_all"], "docs": pa.array(np.ones(len(counted), np.int64))}
    )


def _by_source(counts: pa.Table, batch: pa.RecordBatch) -> pa.Table:
    """Counts of single texts added up by language, source and term."""
    owner = counts["owner"]
    named = pa.table({"lang": batch.column("lang").take(owner.combine_chunks()), "source": batch.column("source").take(owner.combine_chunks()), "term": counts["term"], "n": counts["n"], "docs": counts["docs"]})
    return _merged([named], ["lang", "source", "term"])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows, merged as far as HELD rows allow."""
    keys, held, size = ["lang", "source", "term"], [], 0
    for batch in batches:
        pending: list[pa.Table] = []  # of a text in pieces
        last = -1
        for first, texts in _blocks(batch.column("text")):
            counts = _block_counts(np.arange(first, first + len(texts)), texts)
            if first == last:  # a further piece: a term counts as one document of the text
                counts = pa.concat_tables([pending.pop(), counts]).group_by(["owner", "term"]).aggregate([("n", "sum"), ("docs", "max")])
                counts = counts.rename_columns(["owner", "term", "n", "docs"])
            pending, last = [*pending, counts], first
            if len(pending) > 1:
                held.append(_by_source(pending.pop(0), batch))
                size += len(held[-1])
            if size > HELD:
                held = [_merged(held, keys)]
                size = len(held[0])
                if size > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=20_000)
                    size = 0
        for counts in pending:
            held.append(_by_source(counts, batch))
            size += len(held[-1])
    if held:
        yield from _merged(held, keys).to_batches(max_chunksize=20_000)


def kept_counts(docs: DataFrame, config: DivergenceConfig) -> DataFrame:
    """(lang, source, term, n, whole, lead): occurrences of kept terms in each group that has them, in the whole
    language, and whether this row is the one that stands for the term in its language."""
    text = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text_or_empty("text").alias("text"))
    partial = text.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    # dealt out once, by language and term: sums by source and by term both find their rows together
    counts = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    told = counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("whole"),
        (F.min("source").over(of_term) == F.col("source")).alias("lead"),
    )
    return told.where(F.col("docs") >= config.documents).drop("docs")


def group_sizes(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, sources) of every group that occurs: its kept occurrences, and its
    language's kept terms, occurrences and number of sources.  A row a group."""
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("lead"))
    groups = every.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "lead"])
    langs = groups.groupBy("lang").agg(F.sum("lead").alias("terms"), F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"))
    return groups.drop("lead").join(langs, "lang")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), exactly, for totals up to 9 * 10^15."""
    rest, done = count + 1, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        done, rest = done * SCALE_STEP + F.call_function("div", rest, total), rest % total
    return done + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    rest, done = count + 1, np.zeros(1, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        done, rest = done * SCALE_STEP + rest // total, rest % total
    return done + 1


def _term_rows(counts: DataFrame, groups: DataFrame, config: DivergenceConfig) -> DataFrame:
    rows = counts.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total") + F.col("terms")), share(F.col("whole"), F.col("lang_total") + F.col("terms"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    valued = rows.withColumn("value", F.expr("(p - q) * (p - q) div q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = valued.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


class _Shard:
    """The sources of one language (or of two tiles of it) with the sums of their divergences over one shard of terms.
    Terms that only other tiles have are no rows; to each pair they all give what the counts zero and zero give, so a
    shard adds what its own terms have beyond that, and the first shard that value for all ``terms``."""

    def __init__(self, lang: str, terms: int, tiles: tuple[int, int], first: bool, entries: pa.Array):
        self.lang, self.sources = lang, entries.field("source")
        self.plain = terms if first else 0
        self.total = entries.field("n").to_numpy(zero_copy_only=False) + terms
        tile = entries.field("tile").to_numpy(zero_copy_only=False)
        one, other = (tile == t for t in tiles)
        # whom each source is held against: in one tile all the others, in two those of the other tile
        self.against = [np.flatnonzero((other if one[i] else one) & (np.arange(len(tile)) != i)) for i in range(len(tile))]
        self.sums = [np.zeros(len(a), np.int64) for a in self.against]

    def add(self, lists: pa.Array) -> None:
        """A row a term: the sources that have it, with counts."""
        entries = lists.flatten()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.plain -= len(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        column = pc.index_in(entries.field("source"), value_set=self.sources).to_numpy(zero_copy_only=False)
        count = entries.field("n").to_numpy(zero_copy_only=False)
        step = max(1, CELLS // len(self.total))
        for begin in range(0, len(sizes), step):
            inside = (row >= begin) & (row < begin + step)
            block = np.zeros((len(self.total), min(step, len(sizes) - begin)), np.int64)
            block[column[inside], row[inside] - begin] = count[inside]
            p = _shares(block, self.total[:, None])
            for i, against in enumerate(self.against):
                if len(against):
                    q = p[against]
                    self.sums[i] += ((p[i] - q) ** 2 // q).sum(axis=1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        absent = _shares(np.zeros(1, np.int64), self.total) if self.total.all() else np.ones(len(self.total), np.int64)
        for i, against in enumerate(self.against):
            if len(against):
                self.sums[i] += self.plain * ((absent[i] - absent[against]) ** 2 // absent[against])
                held = pa.array([self.lang] * len(against)), pa.array([self.sources[i].as_py()] * len(against))
                yield pa.RecordBatch.from_arrays([*held, self.sources.take(pa.array(against)), pa.array(self.sums[i])], ["lang", "source", "item", "value"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each shard in a partition.  A shard's first row is its header: the sources with their totals."""
    shard = None
    for batch in batches:
        head = np.flatnonzero(batch.column("header").to_numpy(zero_copy_only=False))
        if shard is not None and (not len(head) or head[0]):
            shard.add(batch.column("entries").slice(0, head[0] if len(head) else batch.num_rows))
        for at, following in zip(head, [*head[1:], batch.num_rows]):
            if shard is not None:
                yield from shard.rows()
            own = batch.slice(at, 1)
            shard = _Shard(own["lang"][0].as_py(), own["terms"][0].as_py(), (own["one"][0].as_py(), own["other"][0].as_py()), own["shard"][0].as_py() == 0, own["entries"].flatten())
            if following > at + 1:
                shard.add(batch.column("entries").slice(at + 1, following - at - 1))
    if shard is not None:
        yield from shard.rows()


def _pair_rows(counts: DataFrame, groups: DataFrame, config: DivergenceConfig) -> DataFrame:
    tiles = F.ceil(F.col("sources") / config.tile).cast("int")
    placed = groups.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.hash("source"), F.col("tiles")))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("one"), F.greatest(t, "tile").alias("other"))))
    key = ["lang", "one", "other", "shard"]
    entry = F.struct("source", "n", "tile").alias("entry")
    shards = F.sequence(F.lit(0), F.lit(config.shards - 1))
    heads = placed.select("lang", "source", F.col("total").alias("n"), "terms", "tile", F.lit(None).cast("string").alias("term"), F.explode(shards).alias("shard"), "tiles")
    rows = counts.join(placed.select("lang", "source", "tile", "tiles"), ["lang", "source"]).select(
        "lang", "source", "n", F.lit(0).cast("long").alias("terms"), "tile", "term", F.pmod(F.xxhash64("term"), F.lit(config.shards)).cast("int").alias("shard"), "tiles"
    )
    dealt = (
        heads.unionByName(rows).select("lang", "shard", "term", "terms", entry, meets.alias("m"))
        .select("lang", "m.one", "m.other", "shard", "term", "terms", "entry").repartition(*key)
        .groupBy(*key, "term").agg(F.collect_list("entry").alias("entries"), F.max("terms").alias("terms"))
        .withColumn("header", F.col("term").isNull()).sortWithinPartitions(*key, F.desc("header"), "term")
    )
    sums = dealt.select("lang", "one", "other", "shard", "header", "terms", "entries").mapInArrow(_pair_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))


def source_divergence(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """lang, source, part, item, value and rank: of each group (language, source) its divergence from every other source of
    the language (part ``pair``), and the kept terms that it has above the language's share (part ``term``), the best
    ``top``; values are exact integers, equal ones in order of the items' UTF-8.

    Needs lang, source and text; null is the empty string in each, other columns are left behind.  Repeated rows are
    documents of their own.  A language without kept terms has pairs of value 0; a source alone in its language has no
    pairs; no rows, no result.  Pairs are as many as the sources of a language squared, which is the result asked for."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.settle(kept_counts(docs, config), "counts")
    groups = scratch.settle(group_sizes(docs, counts), "groups")
    return _pair_rows(counts, groups, config).unionByName(_term_rows(counts, groups, config))
