"""Quality, toxicity, fingerprints, lines, near duplicates and tokens against plain Python."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import brute
from conftest import LONG, PROSE
from cloakframe.llm import common, fingerprint as fp, lines, near, quality, toxicity, transducer, words
from cloakframe.llm.queries import QUERIES


def base(text):
    w, filled = brute.words(text), [x for x in (text or "").split("\n") if brute.words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(filled) - len(set(filled)), len(covered)


def check_quality(rows, texts):
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_words_and_ngrams():
    texts = ["", " a  b\tc ", "é漢 \n x", "A b", " "]
    ((begin, chunk),) = words.chunks(pa.array(texts))
    cut = words.cut(chunk)
    assert begin == 0 and np.diff(cut.first).tolist() == [len(brute.words(t)) for t in texts]
    assert chunk.characters().tolist() == [len(t) for t in texts]
    folded = words.cut(chunk, fold=True)
    assert len(set(folded.hashes.tolist())) == len({w for t in texts for w in brute.words(brute.ascii_lower(t))})
    assert list(words.chunks(pa.array([], pa.string()))) == []


def test_op6_whole_table(spark, folder, documents):
    rows = QUERIES["op6_quality_rules"](spark, folder).collect()
    assert len(rows) == len(documents)
    check_quality(rows, {d: t for d, t, _ in documents})


def test_quality_parts_junk_from_prose(spark):
    draw = random.Random(5)
    vocabulary = PROSE.split()
    good = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(120)]
    junk = [" ".join(f"{w}{draw.choice(['###', '$$', '|||'])}" for w in draw.choices(vocabulary, k=60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 180, 2)], "doc_id long, quality int")
    config = quality.QualityConfig(buckets=1 << 12, trusted_rows=40, tuning_rows=30)
    kept = {r.doc_id: r.kept for r in quality.judge(docs, quality.fit(docs, labels, config)).collect()}
    assert all(kept[i] == (i < 120) for i in range(1, 180, 2))  # none of these was labelled


def test_quality_model_of_all_labels(spark, folder):
    """Every labelled document counts: weights and threshold as from plain counts, each trusted text scored without its own."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in held}
    buckets = 1 << 12

    def counts(text):
        return np.bincount(quality._features(next(words.chunks(pa.array([text])))[1], buckets)[0], minlength=buckets)

    own = {d: counts(t) for d, t in held.items()}
    target, raw = sum(own[d] for d, m in marks.items() if m == 1) + 1.0, sum(own.values()) + 1.0
    model = quality.fit(docs, labels, quality.QualityConfig(buckets=buckets))
    assert np.allclose(model.weights, np.log(target / target.sum()) - np.log(raw / raw.sum()), rtol=0, atol=1e-12)
    failed = {r.doc_id for r in quality.judge(docs, model).where("base_failed").collect()}
    scores = []
    for d, mark in marks.items():
        if d not in failed:
            known = target - own[d] if mark == 1 else target
            weights = np.log(known / known.sum()) - np.log(raw / raw.sum())
            scores.append((float(own[d] @ weights / own[d].sum()), mark))
    good, bad = sum(m == 1 for _, m in scores), sum(m == 0 for _, m in scores)
    rate = lambda at: sum(s >= at for s, m in scores if m == 1) / good + sum(s < at for s, m in scores if m == 0) / bad
    assert good and bad and abs(rate(model.threshold) - max(rate(s) for s, _ in scores)) < 1e-12


def test_quality_fit_stores_no_text(spark, folder, monkeypatch):
    """What is stored on the way is a row of numbers a document, and only texts that make the target are joined."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    stored, counted, settle, ngram_counts = [], [], common.Scratch.settle, quality.ngram_counts
    monkeypatch.setattr(common.Scratch, "settle", lambda self, df, name: stored.extend(df.dtypes) or settle(self, df, name))
    monkeypatch.setattr(quality, "ngram_counts", lambda df, buckets: counted.append(df.count()) or ngram_counts(df, buckets))
    quality.fit(docs, labels, quality.QualityConfig(buckets=256))
    assert stored and not [c for c, kind in stored if kind == "string"]
    assert counted == [docs.join(labels.where("quality = 1"), "doc_id").count(), docs.count()]


def test_quality_filter_of_ids_loses_none(spark, monkeypatch):
    """Few bits let more rows through, never fewer; ids of two types, which hash apart, are not filtered."""
    ids = [(None, "n"), *((i * 7919 - 10**9, str(i)) for i in range(3000)), (-(10**9), "again")]
    docs = spark.createDataFrame(ids, "doc_id long, text string")
    marks = docs.where("doc_id % 3 = 0").select("doc_id").distinct()
    wanted = sorted(docs.join(marks, "doc_id").collect())
    for bits, most in ((1 << 26, len(wanted) + 10), (1 << 16, 1300), (1 << 3, len(ids))):
        monkeypatch.setattr(quality, "BITS", bits)
        likely = quality._likely(docs, marks)
        assert sorted(likely.join(marks, "doc_id").collect()) == wanted and likely.count() <= most
        assert likely.columns == docs.columns
    assert quality._likely(docs, marks.limit(0)).count() == 0
    for kind in ("int", "string"):
        other = marks.select(marks.doc_id.cast(kind).alias("doc_id"))
        assert quality._likely(docs, other).count() == len(ids)
    texts = [(i, f"{PROSE} {PROSE} {i}") for i in range(30)]
    models = [
        quality.fit(
            spark.createDataFrame(texts, f"doc_id {of_docs}, text string"),
            spark.createDataFrame([(i, i % 2) for i in range(20)], f"doc_id {of_labels}, quality int"),
            quality.QualityConfig(buckets=256),
        )
        for of_docs, of_labels in (("long", "long"), ("long", "int"))
    ]
    assert (models[0].weights == models[1].weights).all() and models[0].threshold == models[1].threshold


def test_best_threshold_without_a_list(spark):
    """Running totals over cells give the place that sorting all scores gives, ties and equal scores included."""
    rnd = random.Random(5)
    for n in (2, 3, 40, 400):
        rows = [(i % 2, round(rnd.gauss(i % 2, 2), 1) + 0.0) for i in range(n)]
        good, bad = (sorted(s for m, s in rows if m == k) for k in (1, 0))
        places = sorted({s for _, s in rows})
        balance = [sum(g >= p for g in good) / len(good) + sum(b < p for b in bad) / len(bad) for p in places]
        at = balance.index(max(balance))
        wanted = places[0] if at == 0 else (places[at - 1] + places[at]) / 2
        assert quality.best_threshold(spark.createDataFrame(rows, "label int, llr double")) == wanted
    assert quality.best_threshold(spark.createDataFrame([(1, 0.5)], "label int, llr double")) == float("-inf")


def test_quality_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, None), (9, 0), (None, 1), (404, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels, quality.QualityConfig(buckets=256))
    rows = quality.judge(odd.where("doc_id IS NOT NULL"), model).collect()
    check_quality(rows, {r.doc_id: r.text for r in odd.collect()})
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {None, 5, 6, 7, 4, 9}
    empty = quality.fit(none, labels.limit(0))
    assert quality.judge(none, empty).count() == 0 and quality.keep_good(odd, empty).count() > 0


def test_op10_learns_on_the_training_part_only(spark, folder):
    rows = QUERIES["op10_toxicity"](spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (brute.crc(str(r.doc_id)) % 4 == 2) for r in rows)


def test_factorization_machine_learns_an_interaction(spark):
    """Two words that are harmless alone and toxic together: no additive weights can say that at once."""
    draw, rows, labels = random.Random(3), [], []
    vocabulary = [f"plain{i:03d}" for i in range(40)]
    for i in range(1600):
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        text = draw.choices(vocabulary, k=8) + ["zxinsult"] * insult + ["qwgroup"] * group
        draw.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(labels[:1200], "doc_id long, toxic int")
    model = toxicity.fit(docs, train, toxicity.ToxicityConfig(buckets=1 << 14, least_tie=3.0))
    right = [(r.score >= 0.5) == bool(labels[r.doc_id][1]) for r in toxicity.score(docs, model).collect() if r.doc_id >= 1200]
    assert sum(right) / len(right) > 0.97


@pytest.mark.parametrize("fillers", [40, 400])
def test_words_with_no_tie_of_their_own_are_learned(spark, fillers):
    """Toxic are texts with just one of two words: neither word alone tells anything."""
    draw, rows, labels = random.Random(4), [], []
    vocabulary = [f"plain{i:03d}" for i in range(fillers)]
    for i in range(2400):
        one, other = i % 2, i // 2 % 2
        text = draw.choices(vocabulary, k=8) + ["zxinsult"] * one + ["qwgroup"] * other
        draw.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(one != other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:2000], "doc_id long, toxic int"))
    right = [(r.score >= 0.5) == bool(labels[r.doc_id][1]) for r in toxicity.score(docs, model).collect() if r.doc_id >= 2000]
    assert sum(right) / len(right) > 0.97


def test_toxicity_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (8, None), (9, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def check_neighbours(rows, docs):
    docs = sorted(docs)
    told = {r.doc_id: r for r in rows}
    for i, (doc, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        k, r = len(text) // 4, told[doc]
        edited = text[: len(text) - k] + following[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.fingerprints(pa.array([text]))[0].tobytes().hex()
        assert r.edited_fingerprint == fp.fingerprints(pa.array([edited]))[0].tobytes().hex()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_op9_whole_table(spark, folder, documents):
    rows = QUERIES["op9_document_fingerprints"](spark, folder).collect()
    assert len(rows) == len(documents)
    check_neighbours(rows, [(d, t) for d, t, _ in documents])
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95


def test_op9_odd_and_empty(spark, odd, none):
    assert fp.edited_neighbours(odd).count() == odd.count()
    distinct = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    docs = spark.createDataFrame(list(distinct.items()), "doc_id long, text string")
    check_neighbours(fp.edited_neighbours(docs).collect(), list(distinct.items()))
    assert fp.edited_neighbours(none).count() == 0
    assert fp.edited_neighbours(docs.limit(1)).count() == 1


def test_fingerprints_are_homomorphic(spark):
    a, b = "first paragraph here\n\nsecond one", "third paragraph\nfirst paragraph here"
    of = lambda t: fp.fingerprints(pa.array([t]))
    assert (fp.merged(of(a), of(b)) == of(a + "\n" + b)).all()
    assert (of("x y\nz") == of("z\nx y")).all() and (of("x y\nz") != of("x z\ny")).any()
    assert (fp.merged(of(a + "\n" + b), of(b), -1) == of(a)).all()
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        fp.fingerprint("a").alias("own"), fp.fingerprint_without(fp.fingerprint_with(fp.fingerprint("a"), "b"), "b").alias("back")
    ).first()
    assert row.own == row.back
    assert fp.likeness(of(a), of(a))[0] == 1 and fp.likeness(of(""), of(a))[0] == 0


def plain_fingerprint(text):
    """(multiset of paragraphs, multiset of pieces) of a text."""
    paragraphs = Counter(p for p in text.split("\n") if p)
    pieces = Counter()
    for line in text.split("\n"):
        found = list(brute.WORD.finditer(line))
        pieces.update(line[found[i].start() : found[min(i + 7, len(found) - 1)].end()] for i in range(0, len(found), 8))
    return paragraphs, pieces


def test_fingerprints_are_equal_just_for_equal_multisets():
    """Against sums made by plain Python of single paragraphs and pieces; orders, cuts and white space tell apart."""
    draw = random.Random(8)
    eight = lambda: " ".join(f"w{draw.randrange(50)}" for _ in range(8))
    a, b = eight(), eight()
    texts = ["", a, f"{a} {b}", f"{b} {a}", f"{a}\n{b}", f"{b}\n{a}", f"{a}  {b}", f"{a}\t{b}", f"{a}\n\n{b}", f"{a} {b} ", " ", "x", "x\nx", "é漢\n漢é"]
    texts += ["\n".join(draw.choices([a, b, "x", " ", "", "y z"], k=draw.randrange(12))) for _ in range(200)]
    prints = fp.fingerprints(pa.array(texts))
    of = {}
    for text, row in zip(texts, prints):
        paragraphs, pieces = plain_fingerprint(text)
        assert of.setdefault(frozenset(paragraphs.items()), row.tobytes()) == row.tobytes()
        wide, lanes = fp._lanes(row[None])
        assert wide[0, 0] == sum(paragraphs.values())
        alone = fp._lanes(fp.fingerprints(pa.array(list(paragraphs) or [""])))[0]
        assert (wide[0] == sum((alone[i] * np.uint64(n) for i, n in enumerate(paragraphs.values())), np.zeros(1 + fp.WIDE, np.uint64))).all()
        alone = fp._lanes(fp.fingerprints(pa.array(list(pieces) or [""])))[1].view(np.int32)
        assert (lanes.view(np.int32)[0] == sum((alone[i] * n for i, n in enumerate(pieces.values())), np.zeros(fp.LANES, np.int32))).all()
    assert len(set(of.values())) == len(of)


@pytest.mark.parametrize("times", [1 << 15, 1 << 16, 1 << 17])
def test_likeness_of_long_repetitive_texts(times):
    line = "the same line again\n"
    text, longer = line * times, line * (times + 1)
    one, two, edited = fp.fingerprints(pa.array([text, longer, text[: len(text) * 3 // 4] + "another line here\n" * (times // 4)]))[:, None]
    assert fp.likeness(one, two)[0] > 0.999 and 0.5 < fp.likeness(one, edited)[0] < 1 and (one != two).any()


def test_likeness_estimates_the_common_share():
    draw = random.Random(1)
    parts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(6)) for _ in range(400)]
    whole, half = "\n".join(parts[:200]), "\n".join(parts[100:300])
    one, two = fp.fingerprints(pa.array([whole, half]))[:, None]
    assert fp.likeness(one, two)[0] == pytest.approx(0.5, abs=0.2)


def test_boilerplate_goes_and_documents_stay(spark):
    footer = "Subscribe to our newsletter and accept all cookies to go on reading this page"
    own = [(i, f"{PROSE} Number {i}.\n{footer}\n\nAnd an own ending {i * 7} here.", f"site{i % 9}") for i in range(18)]
    copies = [(100 + i, PROSE + " A copied text.\nIt has two lines.", f"site{i}") for i in range(9)]
    rare = [(200 + i, f"{PROSE} Rare {i}.\nA line on four sites only", f"site{i}") for i in range(4)]
    docs = spark.createDataFrame(own + copies + rare, "doc_id long, text string, source string")
    texts = {d: t for d, t, _ in own + copies + rare}
    sent, joined = (sorted(map(repr, lines.remove_boilerplate(docs, lines.LineConfig(sent=n), counts=True).collect())) for n in (10, 0))
    assert sent == joined
    for r in lines.remove_boilerplate(docs, counts=True).collect():
        want = "\n".join(x for x in texts[r.doc_id].split("\n") if x != footer) if r.doc_id < 100 else texts[r.doc_id]
        assert r.text == want and r.n_removed == (1 if r.doc_id < 100 else 0)


def test_short_pages_lose_boilerplate_and_copies_stay(spark):
    """Pages over 80 % of which is boilerplate, at both ends or doubled, keep just their own line."""
    top, end = "The and attion to thanedble the, anea. Eriner thanea.", "In in oredble ea enshst edenen thhaea eringble instan."
    pages = [(i, f"{top}\nOwn {i}.\n\n{end if i % 2 else top}", f"site{i % 9}") for i in range(18)]
    copies = [(100 + i, f"{top}\n{end}", f"site{i}") for i in range(9)]
    docs = spark.createDataFrame(pages + copies, "doc_id long, text string, source string")
    told = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_boilerplate(docs, counts=True).collect()}
    assert told == {i: (f"Own {i}.\n", 2) for i in range(18)} | {d: (t, 0) for d, t, _ in copies}


def test_text_of_many_boilerplate_lines(spark):
    """A hundred thousand shared lines in one text cost one pass over it, not one for each line."""
    shared = [f"shared line number {i}" for i in range(100_000)]
    docs = [(i, "\n".join([f"own line of {i}", *shared, "", f"own end of {i}"]), f"site{i}") for i in range(5)]
    rows = lines.remove_boilerplate(spark.createDataFrame(docs, "doc_id long, text string, source string"), counts=True).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in rows} == {(i, f"own line of {i}\n\nown end of {i}", 100_002, 100_000) for i in range(5)}


def test_far_and_near_counts_agree_with_exact_ones(spark):
    """Lines on 1 to 60 sites: sketches and exact counts together decide as exact counts would."""
    rows = [(i * 100 + s, f"{PROSE} {i} {s}\nshared line number {i}", f"site{s}") for i in range(1, 61) for s in range(i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    config = lines.LineConfig(sites=30)
    gone = {r.doc_id // 100 for r in lines.remove_boilerplate(docs, config, counts=True).where("n_removed > 0").collect()}
    assert gone == set(range(30, 61))


def test_lines_odd_and_empty(odd, none):
    out = lines.remove_boilerplate(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))
    assert lines.remove_boilerplate(none).count() == 0


def check_near(spark, docs, shingle, part, whole, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    config = near.NearConfig(shingle=shingle, similarity=Fraction(part, whole), **options)
    rows = near.near_groups(df, config).collect()
    want = brute.near_components(docs, shingle, part, whole)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return df, config, want


def test_op8_whole_table(spark, folder, documents):
    rows = QUERIES["op8_minhash_near_dedup"](spark, folder).collect()
    want = brute.near_components([(d, t) for d, t, _ in documents], 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def edited(draw, tokens, times):
    tokens = list(tokens)
    for _ in range(times):
        tokens[draw.randrange(len(tokens))] = f"e{draw.randrange(10**6)}"
    return tokens


def test_large_group_of_near_copies_by_prefix_join(spark):
    """A hub with copies, strays that only copies of theirs reach, and chains; buckets beyond ``small``."""
    draw = random.Random(11)
    hub = [f"w{draw.randrange(500)}" for _ in range(150)]
    docs = [" ".join(hub)]
    for _ in range(70):
        copy = edited(draw, hub, draw.choice((1, 2, 4, 5, 6, 8)))
        docs.append(" ".join(copy))
        if draw.random() < 0.5:
            docs.append(" ".join(edited(draw, copy, draw.choice((1, 2, 3)))))
    docs += [f"lonely text {i} " + " ".join(f"x{i}y{j}" for j in range(30)) for i in range(5)] + ["one two", "ONE two", "", None, " "]
    df, config, want = check_near(spark, list(enumerate(docs)), 3, 85, 100, small=4)
    kept = {r.doc_id for r in near.keep_one(df, config).collect()}
    assert kept == {d for d, (_, c) in want.items() if d == c}


def test_near_odd_and_empty(spark, odd, none):
    rows = near.near_groups(odd).collect()
    assert len(rows) == odd.count()
    of = {r.doc_id: r for r in rows}
    assert of[6].component_id == 5 and not of[6].kept and of[5].kept and of[1].component_id == 1 and of[1].n_shingles == 0
    twins = [(1, PROSE), (1, PROSE), (1, PROSE + " more"), (2, PROSE), (3, "other words"), (3, None), (3, None), (None, PROSE)]
    left = near.keep_one(spark.createDataFrame(twins, "doc_id long, text string")).collect()
    assert len(left) == 3 and [r.doc_id for r in left].count(1) == 1 and {(r.doc_id, r.text) for r in left} > {(3, "other words"), (3, None)}
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()}
    assert near.near_groups(none).count() == 0 and near.keep_one(none).count() == 0


def test_super_minhash_estimates_similarity():
    draw = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8):
        common, own = round(1000 * share), 1000 - round(1000 * share)
        pool = np.unique(draw.integers(1, 2**63, 3000, np.uint64))
        one, two = np.sort(pool[: common + own // 2]), np.sort(np.concatenate((pool[:common], pool[-(own - own // 2) :])))
        signs = near.super_minhash(np.concatenate((one, two)), np.array([0, len(one), len(one) + len(two)]), 192)
        assert (signs[0] == signs[1]).mean() == pytest.approx(share, abs=0.12)
    few = near.super_minhash(np.array([7], np.uint64), np.array([0, 1]), 192)
    assert sorted((few[0] >> np.uint64(32)).tolist()) == list(range(192))  # one element fills each slot in its own round


def test_tokens_equal_the_library(spark, folder, documents):
    vocabulary = transducer.Vocabulary.read()
    library = sentencepiece.SentencePieceProcessor(model_file=transducer.MODEL)
    machine, draw = transducer.Transducer(vocabulary), random.Random(9)
    letters = "ab c  \n\t▁éß漢字😀xyz12  the in er .,!"
    texts = [t for _, t, _ in documents] + ["".join(draw.choices(letters, k=draw.randrange(50))) for _ in range(800)]
    for text in texts:
        ids = machine.encode(text).tolist()
        assert ids == library.encode(text)
        assert machine.decode(ids) == text.replace("▁", " ") == library.decode(ids)
    small = transducer.Transducer(vocabulary, remembered=10)
    assert all((small.encode(t) == machine.encode(t)).all() for t in texts[:20])
    rows = QUERIES["op7_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(documents) and all(r.exact for r in rows)
    of = {d: t for d, t, _ in documents}
    assert all(r.n_tokens == len(machine.encode(of[r.doc_id])) for r in rows)


def _field(number, value):
    """A protocol-buffer field of bytes."""
    size, out = len(value), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + out + bytes([size]) + value


@pytest.mark.parametrize("squeeze", [False, True])
def test_character_maps_equal_the_library(tmp_path, documents, squeeze):
    """The given pieces behind the library's own rule set, which reads several characters at a time."""
    with open(transducer.MODEL, "rb") as file:
        data = file.read()
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    packed = dict(transducer._fields(next(v for k, v in transducer._fields(rules) if k == 3)))[2]
    spec = _field(2, packed) + bytes([3 << 3, 1, 4 << 3, squeeze])
    model = tmp_path / "mapped.model"
    model.write_bytes(data + _field(3, spec))  # a later field is merged into the earlier one
    library = sentencepiece.SentencePieceProcessor(model_file=str(model))
    machine, draw = transducer.Transducer(transducer.Vocabulary.read(str(model))), random.Random(4)
    letters = "ab  \n\t\u00a0\u3000▁Ａﬁ①¨é漢が\u3099か\u0301e\u200b½\u1100\u1161각x.,"
    texts = [t or "" for _, t, _ in documents][:60] + ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(1500)] + [" ", "\u200b", "  ▁ "]
    assert len(machine.vocabulary.characters) > 1000
    for text in texts:
        assert machine.encode(text).tolist() == library.encode(text), repr(text)


def test_long_part_without_spaces():
    """A megabyte without a space is one part; twice the text takes about twice the time."""
    import time

    machine, draw = transducer.Transducer(transducer.Vocabulary.read()), random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=transducer.MODEL)
    text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz漢字0123456789+/", k=1_000_000))
    machine.encode(text[:20_000])
    begin = time.perf_counter()
    ids = machine.encode(text)
    assert time.perf_counter() - begin < 30
    assert machine.encode(text[:3_000]).tolist() == library.encode(text[:3_000]) and machine.decode(ids.tolist()) == text


def test_unigram_weights_take_the_lightest_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab", "abb"]
    scores = [0.0, -3.0, -2.0, -2.0, -2.5, -2.2, -5.0, -9.0]
    kinds = [transducer.UNKNOWN] + [transducer.NORMAL] * 7
    machine = transducer.Transducer(transducer.Vocabulary(tuple(pieces), tuple(scores), tuple(kinds), transducer.UNIGRAM, True, False))

    def lightest(text):
        if not text:
            return 0.0, []
        found = [(w - scores[i], [i, *rest]) for p, i in machine.ids.items() if text.startswith(p) for w, rest in [lightest(text[len(p) :])]]
        return min(found, default=(float("inf"), []))

    for text in ("ab", "abb", "a ab b", "aabbab"):
        assert machine.shortest_path(machine.normalise(text)) == lightest(machine.normalise(text))[1]
    assert machine.encode("aça").tolist() == [5, 0, 2]


def test_tokens_odd_and_empty(spark, odd, none):
    vocabulary = transducer.Vocabulary.read()
    encoded = transducer.encode_documents(odd, vocabulary, keep=("doc_id", "label"), digest=True)
    rows = encoded.collect()
    assert len(rows) == odd.count() and all(r.exact == (r.doc_id != 7) for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in transducer.decode_documents(encoded, vocabulary).collect()}
    assert back[4] == LONG and back[1] == "" and back[5] == PROSE
    assert transducer.encode_documents(none, vocabulary).count() == 0
