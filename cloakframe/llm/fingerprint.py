"""Document fingerprints: a homomorphic multiset hash.

A text is the multiset of its paragraphs, the lines that are not empty.  Each whole paragraph is hashed, every byte of
it, to a wide vector: a count and four lanes over 64 bits.  For likeness its words are also taken in pieces of eight, each
of them 128 lanes of +1 or -1.  The fingerprint is the sum of all vectors, the first modulo 2**64, the others modulo 2**32.
So the order of paragraphs does not matter, equal multisets have equal fingerprints and others different ones, a paragraph is
put in or taken out by adding or subtracting its own fingerprint, and the difference of two fingerprints tells how much of
the two multisets differs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import text_or_empty
from .words import Texts, chunks, cut, mix64, powers, _BASE, _INVERSE, _byte_values

_U = np.uint64
PIECE_WORDS = 8
WIDE = 4
LANES = 128
BYTES = 8 * (1 + WIDE) + 4 * LANES
BLOCK = 1 << 15  # pieces whose lanes are added at a time
_SALTS = mix64(np.arange(1, WIDE + 3, dtype=_U) * _U(0xA0761D6478BD642F))


def _span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span from running sums over all bytes, with the span's length."""
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix64(raw + mix64((ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15)))


def _paragraphs(texts: Texts, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every paragraph: what stands between line feeds, if anything."""
    change = np.zeros(len(texts.data) + 1, bool)
    feeds = np.flatnonzero(texts.data == 10)
    change[feeds] = change[feeds + 1] = change[texts.offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    filled = texts.data[starts] != 10
    starts, ends = starts[filled], ends[filled]
    return _span_hashes(sums, starts, ends), np.searchsorted(texts.offsets, starts, "right") - 1


def _pieces(texts: Texts, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every piece, from its first word to its last with what stands between."""
    words = cut(texts)
    if not len(words.hashes):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    feeds = np.concatenate(([0], np.cumsum(texts.data == 10)))
    owner = words.text_of()
    line = feeds[words.starts] + owner  # grows with every line feed and with every text
    opens = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    number = np.arange(len(line)) - np.repeat(opens, np.diff(np.append(opens, len(line))))
    begin = np.flatnonzero(number % PIECE_WORDS == 0)
    last = np.append(begin[1:], len(line)) - 1
    return _span_hashes(sums, words.starts[begin], words.ends[last]), owner[begin]


def fingerprints(column: pa.Array) -> np.ndarray:
    """Fingerprints of a string column as rows of BYTES bytes; null is the empty text, all zeros."""
    out = np.zeros((len(column), BYTES), np.uint8)
    for at, texts in chunks(column):
        if not len(texts.data):
            continue
        sums = np.zeros(len(texts.data) + 1, _U)
        np.cumsum(_byte_values(False)[texts.data] * powers(_BASE, len(texts.data)), out=sums[1:])
        hashes, owner = _paragraphs(texts, sums)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        wide = [np.diff(first).astype(_U)]
        for salt in _SALTS[:WIDE]:
            added = np.concatenate((np.zeros(1, _U), np.cumsum(mix64(hashes + salt), dtype=_U)))
            wide.append(added[first[1:]] - added[first[:-1]])
        hashes, owner = _pieces(texts, sums)
        signs = np.zeros((len(texts), LANES), np.int64)
        for begin in range(0, len(hashes), BLOCK):
            some, of = hashes[begin : begin + BLOCK], owner[begin : begin + BLOCK]
            bits = np.unpackbits(np.stack([mix64(some + salt) for salt in _SALTS[WIDE:]], axis=1).view(np.uint8), axis=1)
            opens = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            sizes = np.diff(np.append(opens, len(of)))
            signs[of[opens]] += 2 * np.add.reduceat(bits, opens, axis=0, dtype=np.int64) - sizes[:, None]
        rows = out[at : at + len(texts)]
        rows[:, : 8 * (1 + WIDE)] = np.stack(wide, axis=1).view(np.uint8)
        rows[:, 8 * (1 + WIDE) :] = signs.astype(np.uint32).view(np.uint8)
    return out


def _lanes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.ascontiguousarray(rows)
    return np.ascontiguousarray(rows[:, : 8 * (1 + WIDE)]).view(_U), np.ascontiguousarray(rows[:, 8 * (1 + WIDE) :]).view(np.uint32)


def merged(one: np.ndarray, other: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of the paragraphs of both texts together, or (sign -1) of the first without those of the other."""
    (a, b), (c, d) = _lanes(one), _lanes(other)
    wide, narrow = (a + c, b + d) if sign > 0 else (a - c, b - d)
    return np.concatenate((wide.view(np.uint8), narrow.view(np.uint8)), axis=1)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, else 1 - |difference|^2 / (|one|^2 + |other|^2) over the narrow lanes, within 0..1:
    of two texts of equal length without repeats about the share of paragraphs they have in common."""
    a, b = (_lanes(x)[1].view(np.int32) for x in (one, other))
    apart = ((a.astype(float) - b) ** 2).sum(axis=1)
    whole = (a.astype(float) ** 2).sum(axis=1) + (b.astype(float) ** 2).sum(axis=1)
    share = np.clip(1 - apart / np.maximum(whole, 1), 0, 1)
    return np.where((one == other).all(axis=1), 1.0, np.where(whole > 0, share, 0.0))


def _binary(rows: np.ndarray) -> pa.Array:
    ends = np.arange(0, (len(rows) + 1) * BYTES, BYTES, dtype=np.int32)[: len(rows) + 1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column: pa.Array) -> np.ndarray:
    """Bytes of a column of fingerprints without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[0] + len(column) * BYTES].reshape(len(column), BYTES)


@F.arrow_udf(T.BinaryType())
def fingerprint(text: pa.Array) -> pa.Array:
    return _binary(fingerprints(text))


@F.arrow_udf(T.BinaryType())
def fingerprint_with(held: pa.Array, text: pa.Array) -> pa.Array:
    """The fingerprint after the paragraphs of ``text`` are added."""
    return _binary(merged(_rows(held), fingerprints(text)))


@F.arrow_udf(T.BinaryType())
def fingerprint_without(held: pa.Array, text: pa.Array) -> pa.Array:
    """The fingerprint after the paragraphs of ``text`` are taken out."""
    return _binary(merged(_rows(held), fingerprints(text), -1))


_COMPARED = T.StructType(
    [T.StructField("edited", T.BinaryType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
)


@F.arrow_udf(_COMPARED)
def _compared(own: pa.Array, edited: pa.Array, following: pa.Array) -> pa.Array:
    one, two, three = _rows(own), fingerprints(edited), _rows(following)
    columns = [_binary(two), pa.array(likeness(one, two)), pa.array(likeness(one, three))]
    return pa.StructArray.from_arrays(columns, ["edited", "near_edited", "near_next"])


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are <= key; in two steps, so that many bounds stay cheap."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every, coarse = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    at = F.size(F.filter(coarse, lambda b: b <= key)) * step
    return at + F.size(F.filter(F.slice(every, at + 1, F.lit(step)), lambda b: b <= key))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document beside the next one by doc_id, compared by fingerprint.

    The edited text is the own one with its last quarter (code points, rounded down) replaced by as many from the
    start of the next document, or all it has; the last document's next is the first.  Null text is empty.  Rows are
    dealt out by ranges of doc_id, one shuffle of the texts; the first document of each range is also put at the end
    of the range before, so no window spans ranges.  Equal doc_ids stand in order of their content's hash, null ids come last, in
    the same order.  A single document is its own next; repeated rows are neighbours.  doc_id is a number.  Other columns
    are left behind; no rows, no rows."""
    spark = docs.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    own_content = F.xxhash64(text_or_empty("text"))
    without = ranges + 1 + 32 + F.shiftright(own_content, 58)  # null ids: 64 ranges of the content's hash
    placed = F.when(F.col("doc_id").isNotNull(), _range_of(F.col("doc_id"), sorted(set(cuts or [])))).otherwise(without)
    texts = docs.select(
        "doc_id", text_or_empty("text").alias("text"), own_content.alias("__content"), placed.cast("int").alias("__range")
    )
    # The first document of each range: 64 more rows than there are shuffle partitions at most.
    first = F.min(F.struct("doc_id", "__content")).alias("head")
    heads = sorted(texts.groupBy("__range").agg(first).select("__range", "head.*").collect(), key=lambda r: r["__range"])
    before = [(heads[i - 1][0], *head) for i, head in enumerate(heads)]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    moved = spark.createDataFrame(before, f"__into int, __from int, __head {id_type}, __first long")
    is_head = (F.col("__content") == F.col("__first")) & F.col("doc_id").eqNullSafe(F.col("__head"))
    copies = (
        texts.join(F.broadcast(moved), (F.col("__range") == F.col("__from")) & is_head)
        .select("doc_id", "text", "__content", F.col("__into").alias("__range"), F.lit(1).alias("__copy"))
    )
    rows = texts.withColumn("__copy", F.lit(0)).unionByName(copies).withColumn("__own", fingerprint("text"))
    order = Window.partitionBy("__range").orderBy("__copy", F.col("doc_id").asc_nulls_last(), "__content")
    length = F.char_length("text")
    tail = F.floor(length / 4).cast("int")
    paired = (
        rows.withColumn("__next", F.lead("text").over(order)).withColumn("__after", F.lead("__own").over(order))
        .where("__copy = 0")
        .withColumn("__edited", F.concat(F.substring("text", F.lit(1), length - tail), F.substring("__next", F.lit(1), tail)))
    )
    done = paired.withColumn("__found", _compared("__own", "__edited", "__after"))
    return done.select(
        "doc_id",
        length.cast("long").alias("n_chars"),
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.hex("__own")).alias("fingerprint"),
        F.lower(F.hex("__found.edited")).alias("edited_fingerprint"),
        "__found.near_edited",
        "__found.near_next",
    )
