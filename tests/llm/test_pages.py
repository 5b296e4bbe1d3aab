"""WARC archives and URL filters."""

import hashlib
import io
import math
import re
import struct
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from cloakframe.llm import urls, warc
from cloakframe.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, payload string, digest string, kept long"
BIG = "<p>" + "x" * 2000


def told(pages):
    """The contract in plain Python; page_ids may repeat."""
    largest = {}
    for page, html in pages:
        data = (html or "").encode()
        if page is not None:
            largest[data] = max(page, largest.get(data, page))
    out = []
    for page, html in pages:
        data = (html or "").encode()
        kept = largest.get(data)
        other = len(data) >= 1000 and kept is not None and page != kept
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", kept if other else None))
    return sorted(out, key=repr)


def round_trip(spark, rows):
    pages = spark.createDataFrame([(p, None, h, "x", "y", 1) for p, h in rows], PAGES)
    archives = warc.write_pages(pages, warc.WarcConfig(archive_bytes=4000))
    back = warc.read_archives(spark, archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == told(rows)
    texts = defaultdict(list)
    for page, html in rows:
        texts[page].append((html or "").encode())
    assert all(bytes(r.payload) in texts[r.page_id] for r in back if r.record_type == "response")
    return archives


def test_round_trip_with_revisits(spark):
    rows = [(i, f"<html>{i}" + "ab" * (i * 37 % 900)) for i in range(60)]
    rows += [(100, BIG), (103, BIG), (101, BIG), (200, "short"), (201, "short"), (7, None), (8, ""), (None, BIG), (None, "null id")]
    rows += [(300, "é漢" * 400), (301, "é漢" * 400), (302, "y" * 999), (303, "y" * 999), (304, "z" * 1000), (305, "z" * 1000), (5, "\r\n\r\nWARC/1.1\r\n")]
    archives = round_trip(spark, rows)
    assert archives.count() > 3 and archives.agg(F.sum("records")).first()[0] == len(rows)


def test_ties_repeats_long_and_none(spark):
    round_trip(spark, [(1, BIG), (1, BIG), (0, BIG), (2, "q" * 3_000_000)])
    round_trip(spark, [(None, BIG), (None, BIG)])
    pages = spark.createDataFrame([], PAGES)
    assert warc.read_archives(spark, warc.write_pages(pages)).count() == 0


def record(**changed):
    headers = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "1970-01-01T00:00:00Z"} | changed
    return warc.frame_record([(k.replace("_", "-"), v) for k, v in headers.items() if v], b"body")


@pytest.mark.parametrize(
    "bad, said",
    [
        (b"WARC/0.9\r\n\r\n", "header"),
        (record(**{"WARC-Date": ""}), "missing"),
        (record(**{"WARC-Type": "other"}), "unknown"),
        (record()[:-5] + b"\r\n\r\n", "Content-Length"),
        (record() + b"x", "Content-Length"),
        (record().replace(b"WARC-Date:", b"WARC-Date"), "without a name"),
    ],
)
def test_bad_records_are_refused(bad, said):
    with pytest.raises(ValueError, match=said):
        warc.split_record(bad)
    assert warc.split_record(record())[1] == b"body"


def archive(dictionary=b"", *frames):
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(frames)


def test_frames():
    samples = [f"sample {i} of a text that repeats {i % 7}".encode() * 3 for i in range(400)]
    raw = zstandard.train_dictionary(2048, samples).as_bytes()
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    frames = [coder.compress(s) for s in samples]
    for block in (1, 7, 1 << 16):
        read = lambda data: list(warc.read_frames(io.BytesIO(data), block))  # noqa: B023, E731
        assert read(archive(raw, *frames)) == samples
        assert read(archive(zstandard.ZstdCompressor().compress(raw), *frames)) == samples  # packed dictionary
        assert read(archive()) == []
        for wrong in (b"", b"12345678", archive(raw)[:-3], archive(raw, *frames)[:-3], archive(raw, b"not a frame")):
            with pytest.raises((ValueError, zstandard.ZstdError)):
                read(wrong)


def test_lenient_reading_tells_what_is_wrong(spark, tmp_path):
    coder = zstandard.ZstdCompressor()
    (tmp_path / "a.warc.zst").write_bytes(archive(b"", coder.compress(record()), coder.compress(b"junk"), coder.compress(record())))
    (tmp_path / "b.warc.zst").write_bytes(b"no archive")
    paths = spark.createDataFrame([(str(tmp_path / f"{x}.warc.zst"),) for x in "ab"] + [(None,)], "path string")
    rows = warc.read_archives(spark, paths, strict=False).collect()
    assert sorted((r.error is None, r.path[-10]) for r in rows) == [(False, "a"), (False, "b"), (True, "a"), (True, "a")]
    with pytest.raises(Exception, match="no WARC/1.1 header|does not begin"):
        warc.read_archives(spark, paths).collect()


def test_op1_whole_table(spark, folder):
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()]
    rows = QUERIES["op1_warc"](spark, folder).collect()
    assert sorted(map(tuple, rows), key=repr) == told(pages)


def split(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", ""
    rest = url[m.end() :]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def shape(s):
    ending = re.search(r"\.[A-Za-z]{1,5}$", s)
    stem = s[: ending.start()] if ending else s
    kind = "{0}" if re.fullmatch("[0-9]+", stem) else "{a0}" if re.search("[0-9]", stem) else "{a}"
    return kind + (ending[0] if ending else "")


def brute_urls(pages, labels, config=urls.UrlConfig()):
    good = {}
    for page, value in labels:
        if page is not None and value is not None:
            good[page] = min(value, good.get(page, 1))
    rows = []
    for page, url in pages:
        host, path = split(url)
        cut = [s for s in path.split("/") if s]
        rows.append([page, host, path, cut, "", good.get(page)])
    for level in range(max((len(r[3]) for r in rows), default=0)):
        def apart(key):
            branch, node = defaultdict(list), defaultdict(list)
            for r in rows:
                if len(r[3]) > level and r[5] is not None:
                    branch[r[1], r[4], key(r[3][level])].append(r[5])
                    node[r[1], r[4]].append(r[5])
            out = set()
            for k, v in branch.items():
                whole = node[k[:2]]
                p = sum(whole) / len(whole)
                if config.support <= len(v) < len(whole) and abs(sum(v) / len(v) - p) > config.apart * math.sqrt(p * (1 - p) / len(v)):
                    out.add(k)
            return out

        literal, shapes = apart(lambda s: s), apart(shape)
        for r in rows:
            if len(r[3]) > level:
                s = r[3][level]
                r.append("/" + s if (r[1], r[4], s) in literal else "/" + shape(s) if (r[1], r[4], shape(s)) in shapes else "/*")
            else:
                r.append("")
        for r in rows:
            r[4] += r.pop()
    held = defaultdict(list)
    for r in rows:
        held[r[1], r[4]] += [r[5]] if r[5] is not None else []
    every = [r[5] for r in rows if r[5] is not None]
    overall = sum(every) / len(every) if every else 1.0
    out = []
    for page, host, path, _, template, _ in rows:
        v, rule = held[host, template], rule_of(host, path)
        allow = rule.allow if rule else (sum(v) + config.prior * overall) / (len(v) + config.prior) >= config.purity
        out.append((page, host, path, template, rule and rule.name, "allow" if allow else "block"))
    return sorted(out, key=repr)


def test_templates_against_brute_force(spark):
    pages, labels = [], []
    for i in range(900):
        branch = ("spam", "blog", "news", "wiki")[i % 4]
        url = f"https://Shop.example.org/{branch}/{i}.html?x={i}" if i % 3 else f"http://other.test/{'tag' if i % 2 else 'id'}/{i}/a/b/c/d{i % 5}/e#f"
        pages.append((i, url))
        if i % 2 or i % 5 == 0:
            labels.append((i, int(not (branch == "spam" and i % 3))))
    odd = [None, "", "no scheme/path", "http://", "://x", "HTTP://A.B?q", "http://h#f", "http://example.net", "http://example.net/", "http://sub.example.net/en/x",
           "http://notexample.net/en/", "http://EXAMPLE.com/de/é?a://b/c", "http://x.org/fr/1", "http://org/fr/", "a\nb://c\nd/e\nf?g"]
    pages += [(2000 + i, u) for i, u in enumerate(odd)] + [(None, "http://x.org/1"), (3, pages[3][1])]
    labels += [(5, 0), (5, 1), (None, 1), (7, None), (10**6, 0)]
    frame = spark.createDataFrame([(p, u, 1, "x") for p, u in pages], "page_id long, url string, good int, template string")
    rows = urls.judge_urls(frame, spark.createDataFrame(labels, "page_id long, good int"))
    got = sorted((tuple(r) for r in rows.select("page_id", "host", "path", "template", "rule", "verdict").collect()), key=repr)
    want = brute_urls(pages, labels)
    assert got == want
    assert {v for _, h, p, t, _, v in got if p.startswith("/spam/")} == {"block"}
    assert {v for _, h, p, t, _, v in got if p.startswith("/blog/")} == {"allow"}


def test_deep_branches_are_parted(spark):
    """Good and bad pages that differ in their tenth segment alone, and one very long url."""
    stem = "http://deep.example/" + "/".join(f"s{i}" for i in range(9))
    pages = [(i, f"{stem}/{'good' if i % 2 else 'bad'}/x/{i}") for i in range(300)]
    pages.append((300, "http://deep.example/" + "seg/" * 20_000))
    labels = [(i, i % 2) for i in range(280)]
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    rows = {r.page_id: r for r in urls.judge_urls(*frames).collect()}
    assert all(rows[i].verdict == ("allow" if i % 2 else "block") for i in range(300))
    assert rows[299].template == "/*" * 9 + "/good/*/*" and rows[300].template == "/*" * 20_000
    brute = brute_urls(pages[:300], labels)
    assert sorted((tuple(r) for i, r in rows.items() if i < 300), key=repr) == sorted(((p, h, path, t, r, v) for p, h, path, t, r, v in brute), key=repr)


def test_no_pages_no_labels(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good int")
    assert urls.judge_urls(none, labels).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.judge_urls(one, labels).first().verdict == "allow"


def test_op2_whole_table(spark, folder):
    df = QUERIES["op2_url_filters"](spark, folder)
    assert "Python" not in df._jdf.queryExecution().toString()
    pages = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    labels = []
    for page, url in pages:
        number = re.search(r"/([0-9]{1,18})[^/0-9?#]*/?([?#].*)?$", url)
        if number and int(number[1]) in quality:
            labels.append((page, quality[int(number[1])]))
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute_urls(pages, labels)
