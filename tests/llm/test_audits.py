"""Source divergence, filter interactions and SimHash near-duplicates against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from cloakframe.llm import diagrams, divergence, simhash
from conftest import DOCS

LABELS = "doc_id long, quality int, toxic int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# --- divergence


def divergences(docs, top=200):
    """docs: (text, lang, source) -> rows of the contract."""
    counts, spread = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall(brute.ascii_lower(text))
        counts[lang or "", source or ""].update(terms)
        spread[lang or ""].update(set(terms))
    rows = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in spread[lang].items() if n >= 3)
        sources = [s for x, s in counts if x == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(held):
            total = sum(held[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (held[t] + 1) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                rows += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(rows)


def told(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("config", [divergence.DivergenceConfig(), divergence.DivergenceConfig(tile=3, shards=5, top=7)])
def test_divergence_of_documents(spark, folder, config, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 64)  # many blocks
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert told(divergence.source_divergence(docs, config)) == divergences(rows, config.top)


def test_divergence_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    assert told(divergence.source_divergence(odd)) == divergences(rows)
    assert divergence.source_divergence(none).count() == 0
    wordless = spark.createDataFrame([(1, "1 2", "en", s, 1) for s in "ab"], DOCS)
    assert [r[2:] for r in told(divergence.source_divergence(wordless))] == [("pair", "b", 0, 1), ("pair", "a", 0, 1)]


def test_texts_in_pieces_and_merges(monkeypatch):
    """A text longer than a block counts each term as one document; merged and unmerged counts agree."""
    import pyarrow as pa

    pick = random.Random(3)
    texts = ["".join(pick.choice("ab é,漢 .") for _ in range(n)) for n in (0, 5, 4000, 30, 900)]
    batch = pa.record_batch({"lang": ["x", "y", "x", "x", "y"], "source": ["s"] * 5, "text": texts})

    def counted():
        total = defaultdict(lambda: [0, 0])
        for out in divergence._partial_counts(iter([batch, batch])):
            for r in out.to_pylist():
                total[r["lang"], r["term"]][0] += r["n"]
                total[r["lang"], r["term"]][1] += r["docs"]
        return dict(total)

    want = defaultdict(lambda: [0, 0])
    for lang, text in zip(["x", "y", "x", "x", "y"] * 2, texts * 2):
        for term, n in Counter(TERM.findall(text)).items():
            want[lang, term][0] += n
            want[lang, term][1] += 1
    assert counted() == want
    for name, value in (("BLOCK", 64), ("HELD", 6)):
        monkeypatch.setattr(divergence, name, value)
        assert counted() == want


def test_shares_are_exact(spark):
    cases = [(0, 1), (6, 7), (10**15 - 1, 10**15), (123456789, 987654321012), (2, 3 * 10**14)]
    rows = spark.createDataFrame(cases, "c long, t long").select(divergence.share(F.col("c"), F.col("t"))).collect()
    want = [1 + 10**9 * (c + 1) // t for c, t in cases]
    assert [r[0] for r in rows] == want
    assert divergence._shares(np.array([c for c, _ in cases]), np.array([t for _, t in cases])).tolist() == want


# --- filters


def audits(docs, labels):
    """docs: (doc_id, text, lang)."""
    first, masks = {}, []
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    marked = lambda doc, at: any(x[at] == 1 for x in labels if x[0] == doc and doc is not None)
    for doc, text, lang in docs:
        text = text or ""
        w = brute.words(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and first[text] < doc,
        }
        masks.append((lang or "", {f for f, x in fails.items() if x}, marked(doc, 1), marked(doc, 2)))
    rows, shapley = [], Counter()
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            open_rows = own
            for i, f in enumerate(order):
                gone = [m for m in open_rows if f in m[0]]
                open_rows = [m for m in open_rows if f not in m[0]]
                failing = sum(f in m[0] for m in own)
                shapley[part, f] += len(gone)
                rows.append((part, order, i + 1, len(open_rows), len(gone), failing - len(gone), sum(m[0] == {f} for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_filters_of_documents(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, diagrams.filter_audit(docs, labels).collect())) == audits(rows, marks)


def test_filters_of_odd_rows(spark, odd, none):
    marks = [(5, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 1)]
    labels = spark.createDataFrame(marks, LABELS)
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang").collect()]
    assert sorted(map(tuple, diagrams.filter_audit(odd, labels).collect())) == audits(rows, marks)
    assert diagrams.filter_audit(none, labels).count() == 0
    assert diagrams.filter_audit(odd, labels.limit(0)).count() == 600 * len({r[2] or "" for r in rows})


def test_swaps_reach_every_order():
    pick = random.Random(1)
    weights = {m: (pick.randrange(9), pick.randrange(3), 0) for m in pick.sample(range(32), 20)}
    diagram, seen = diagrams.Diagram(weights), {"ABCDE"}
    for swap in diagrams.neighbour_swaps(5):
        diagram.swap(swap)
        seen.add("".join(diagram.order))
        passed = set(weights)
        for f, kept, removed in diagram.all_pass():
            gone = {m for m in passed if m >> "ABCDE".index(f) & 1}
            passed -= gone
            assert (kept, removed) == tuple(tuple(sum(weights[m][i] for m in ms) for i in range(3)) for ms in (passed, gone))
    assert len(seen) == 120


# --- fingerprints


def fingerprint(text, size=3):
    w = brute.words(brute.ascii_lower(text))
    held = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in held]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, distance=2):
    """(doc_id, text) -> sorted (doc_id, fingerprint, component) by comparing all with all."""
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance):
            a, b = group[i], group[j]
            if a != b:
                group = [a if g == b else g for g in group]
    least = defaultdict(list)
    for (doc, _), g in zip(rows, group):
        least[g] += [doc] * (doc is not None)
    return sorted(((d, f"{int(p):016x}", min(least[g], default=None)) for (d, _), p, g in zip(rows, prints, group)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("config", [simhash.SimConfig(), simhash.SimConfig(sample=60, shard=20, leaf=4), simhash.SimConfig(shard=8, distance=9, leaf=2)])
def test_near_fingerprints_of_documents(spark, folder, config):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(simhash.near_fingerprints(docs, config)) == near(rows, config.distance)


def test_near_fingerprints_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(simhash.near_fingerprints(odd)) == near(rows)
    assert simhash.near_fingerprints(none).count() == 0


def test_dense_cluster_costs_no_more_than_direct_comparison():
    """Thousands of points a few bits from each other, where every radius leaves much of them in both branches."""
    import time

    pick = np.random.default_rng(0)
    bit = lambda n: np.uint64(1) << pick.integers(0, 64, n).astype(np.uint64)
    points = np.unique(np.uint64(0x0123456789ABCDEF) ^ bit(9000) ^ bit(9000) ^ bit(9000))
    begin = time.perf_counter()
    roots = simhash.link_shard(points, simhash.SimConfig(leaf=64))
    assert len(points) > 6000 and (roots == 0).all() and time.perf_counter() - begin < 20


def test_text_in_blocks(monkeypatch):
    pick = random.Random(5)
    texts = ["".join(pick.choice("aB é 漢\t\n") for _ in range(n)) for n in (0, 1, 2, 7, 50, 900)] + [" ", "x" * 500, "one two"]
    want = [fingerprint(t) for t in texts]
    assert [simhash.simhash(t, 3) for t in texts] == want
    monkeypatch.setattr(simhash, "BLOCK", 5)
    monkeypatch.setattr(simhash, "SHINGLES", 3)
    assert [simhash.simhash(t, 3) for t in texts] == want


@pytest.mark.parametrize("seed", range(4))
def test_tree_loses_no_link(seed):
    """Random points, chains and a dense cluster; shards as the upper tree deals them out, linked one by one."""
    import pyarrow as pa

    pick = np.random.default_rng(seed)
    bit = lambda n: np.uint64(1) << pick.integers(0, 64, n).astype(np.uint64)
    points = pick.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near_by = points[:400] ^ bit(400) ^ bit(400)
    dense = points[7] ^ bit(600) ^ bit(600) ^ bit(600)
    points = np.unique(np.concatenate([points, near_by, near_by[:200] ^ bit(200), dense, [np.uint64(0)]]))
    config = simhash.SimConfig(leaf=8)
    nodes = simhash.grow(points[::3], 16, config.distance)
    shards = defaultdict(list)
    for out in simhash._routed(iter([pa.record_batch({"fingerprint": points.view(np.int64)})]), nodes, config.distance):
        for r in out.to_pylist():
            shards[r["shard"]].append(r["fingerprint"])
    groups = simhash._Groups(len(points))
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    for members in shards.values():
        links = simhash._shard_links(pa.table({"fingerprint": members}), config)
        assert len(links) < len(members)
        for r in links.to_pylist():
            groups.link(place[r["a"]], np.array([place[r["b"]]]))
    exact = simhash._Groups(len(points))
    simhash._direct(points, np.arange(len(points)), exact, config.distance)
    assert len(shards) > 8 and [groups.root(i) for i in range(len(points))] == [exact.root(i) for i in range(len(points))]
