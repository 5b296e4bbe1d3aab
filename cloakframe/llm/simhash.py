"""SimHash near-duplicates: fingerprints of 64 bits, linked within a Hamming distance by vantage-point trees.

A node of the tree has a vantage point and a radius; its points part into those within the radius and those beyond.
By the triangle inequality two points within ``distance`` of each other differ by no more than that in their distance
to the vantage point, so a pair that the radius parts has its inner point at most ``distance - 1`` inside the boundary.
Points that near to it go to both branches, and then every linked pair is together in at least one branch of each
node, down to a leaf.  The upper levels, grown on a bounded sample, deal distinct fingerprints out to shards; within a
shard the same rule goes on until few are left, which are compared exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, bounded_sample
from .near import connect

_U = np.uint64
SEED = 42
BLOCK = 1 << 20  # bytes of a text cut into words at a time
SHINGLES = 1 << 16  # hashes whose bits are counted at a time


@dataclass(frozen=True)
class SimConfig:
    """``shingle`` words make an element; fingerprints that differ in ``distance`` bits or less are linked.  The upper
    tree is grown on ``sample`` distinct fingerprints (8 bytes each, the only thing the driver holds) until a shard has about ``shard`` of them, or there
    are ``tasks`` shards for each shuffle partition.  Within a shard ``leaf`` or fewer are compared directly.  All but the
    first two only say how the work is dealt out."""

    shingle: int = 3
    distance: int = 2
    sample: int = 1 << 17
    shard: int = 1 << 12
    tasks: int = 4
    leaf: int = 1024


def _words(text: str) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words of a text, in blocks; a word is never cut.  bytes.split() parts at just the six characters."""
    data = text.encode()
    begin = 0
    while len(data) - begin > BLOCK:
        end = begin + BLOCK
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[begin:end].lower().split()
        begin = end
    yield data[begin:].lower().split()


def simhash(text: str | None, size: int) -> int:
    """The fingerprint of a text; 0 without words.  Shingles count as often as they occur."""
    ones, count, tail = np.zeros(64, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for block in _words(text or ""):
        words = tail + block
        for begin in range(0, len(words) - size + 1, SHINGLES):
            some = words[begin : begin + SHINGLES + size - 1]
            hashes = np.array([hashed(b" ".join(s), SEED) for s in zip(*(some[k:] for k in range(size)))], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            count += len(hashes)
        tail = words[max(0, len(words) - size + 1) :]
    if not count:
        return hashed(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((simhash(t.as_py(), size) for t in batch.column("text")), _U, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])


def _vantage(points: np.ndarray, distance: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part the points, or None if none tried does.  What counts is the work of comparing
    each branch with itself, the sum of both squares: it must fall, so that however much the branches of a dense cluster
    overlap, all of them together never cost more than the points compared directly."""
    best = None
    tried = points[np.linspace(0, len(points) - 1, 5).astype(int)]
    far = points[np.argmax(np.bitwise_count(points ^ tried[2]))]
    for vantage in (far, *tried):
        held = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65)).astype(float)
        inner = held[:64]  # within r
        outer = len(points) - np.concatenate((np.zeros(distance), held))[:64]  # beyond r - distance
        work = inner**2 + outer**2
        radius = int(np.argmin(work))
        if best is None or work[radius] < best[0]:
            best = float(work[radius]), vantage, radius
    return best[1:] if best[0] < 0.9 * len(points) ** 2 else None


def _branches(points: np.ndarray, vantage: np.uint64, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go to the inner and to the outer branch."""
    apart = np.bitwise_count(points ^ vantage)
    return apart <= radius, apart > radius - distance


def grow(sample: np.ndarray, shards: int, distance: int) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer) of the upper tree; a branch below zero is the shard -1 - branch."""
    least = max(2, len(sample) // shards)
    nodes: list[tuple] = []
    leaves = 0

    def grown(points: np.ndarray) -> int:
        nonlocal leaves
        parted = _vantage(points, distance) if len(points) > least else None
        if parted is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(())
        inner, outer = _branches(points, *parted, distance)
        nodes[at] = (*parted, grown(points[inner]), grown(points[outer]))
        return at

    grown(sample)
    return nodes


def _routed(batches: Iterator[pa.RecordBatch], nodes: list[tuple], distance: int) -> Iterator[pa.RecordBatch]:
    """(shard, fingerprint) of every shard whose region a fingerprint lies in or overlaps."""
    for batch in batches:
        waiting = [(0 if nodes else -1, batch.column("fingerprint").to_numpy(zero_copy_only=False).view(_U))]
        while waiting:
            at, points = waiting.pop()
            if not len(points):
                continue
            if at < 0:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), -1 - at, np.int32)), pa.array(points.view(np.int64))], ["shard", "fingerprint"])
                continue
            vantage, radius, inner, outer = nodes[at]
            to_inner, to_outer = _branches(points, vantage, radius, distance)
            waiting += [(inner, points[to_inner]), (outer, points[to_outer])]


class _Groups:
    """Union-find over the points of one shard."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, x: int, others: np.ndarray) -> None:
        roots = {self.root(int(o)) for o in others} | {self.root(x)}
        self.parent[list(roots)] = min(roots)


def _direct(points: np.ndarray, places: np.ndarray, groups: _Groups, distance: int) -> None:
    """Every point against all after it, one row of distances at a time."""
    for i in range(len(points) - 1):
        near = np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= distance)
        if len(near):
            groups.link(int(places[i]), places[i + 1 + near])


def link_shard(points: np.ndarray, config: SimConfig) -> np.ndarray:
    """For each of the distinct points the smallest place that it is linked to, within these points."""
    groups = _Groups(len(points))
    waiting = [np.arange(len(points))]
    while waiting:
        places = waiting.pop()
        own = points[places]
        parted = _vantage(own, config.distance) if len(places) > config.leaf else None
        if parted is None:
            _direct(own, places, groups, config.distance)
            continue
        waiting += [places[b] for b in _branches(own, *parted, config.distance)]
    return np.array([groups.root(i) for i in range(len(points))], np.int64)


def _shard_links(table: pa.Table, config: SimConfig) -> pa.Table:
    """A spanning forest of the links among the fingerprints of a shard, not all their pairs."""
    points = np.sort(table.column("fingerprint").to_numpy().view(_U))
    roots = link_shard(points, config)
    linked = roots != np.arange(len(points))
    return pa.table({"a": points[linked].view(np.int64), "b": points[roots[linked]].view(np.int64)})


def near_fingerprints(docs: DataFrame, config: SimConfig = SimConfig()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Texts are taken whole; null, empty and blank ones have the fingerprint zero and are linked like any other.  Rows of
    equal fingerprint are one point of the tree, whatever their number.  component_id is the smallest doc_id reachable, null
    ids aside (null if there is no other).  Repeated rows agree; other columns are left behind; no rows, no rows."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.settle(docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprints(it, config.shingle), f"doc_id {kind}, fingerprint long"), "fingerprints")
    points = scratch.settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    known = points.count()
    most = config.tasks * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = bounded_sample(points.select("fingerprint"), config.sample, "fingerprint").toArrow().column("fingerprint")
    nodes = grow(np.sort(sample.to_numpy().view(_U)), max(1, min(most, known // config.shard)), config.distance)
    routed = points.select("fingerprint").mapInArrow(lambda it: _routed(it, nodes, config.distance), "shard int, fingerprint long")
    links = scratch.settle(routed.groupBy("shard").applyInArrow(lambda t: _shard_links(t, config), "a long, b long"), "links")
    roots = connect(links, scratch, "roots")
    labelled = points.join(roots, points["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = labelled.join(smallest, "root").select("fingerprint", "component_id")
    told = rows.join(of_point, "fingerprint")
    return told.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
