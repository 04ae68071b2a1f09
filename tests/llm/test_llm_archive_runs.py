"""The web archive, fill-in-the-middle and periodic runs against plain-Python versions."""

import base64
import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from corpusloom.llm import fillmiddle, ntt, runs, warc  # noqa: E402
from corpusloom.llm.queries import QUERIES  # noqa: E402
from corpusloom.llm.registry import table  # noqa: E402
from corpusloom.llm.wavelet import WaveletMatrix  # noqa: E402
from corpusloom.storage import new_path  # noqa: E402

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TEXTS = [
    None, "", " ", "a", "é", "one two", "x" * 3000, "日本 é🙂 words\nand 12 lines\n\n" * 30, "holds <S> a mark",
    "<<P", "P>S>M> <P<S<M", "tail of letters", "\x00\x1f tab\tand\r\nreturn ", "the cat sat " * 20,
    "a b c d e f " * 9 + "g " + "a b " * 40, "w " * 23, "w " * 24, " ".join(map(str, range(400))),
    (" ".join(map(str, range(100))) + " ") * 3, ("x x x y " * 8 + "z ") * 5,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Texts under ids of all remainders, a null id and repeated rows; names clash with helpers."""
    rows = [(d, t, 7, "s", 1) for k, t in enumerate(TEXTS) for d in (k, 100 + 7 * k)]
    rows += [(None, TEXTS[13], 7, "s", 1)] * 2 + [(1, TEXTS[1], 7, "s", 1)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n long, _x string, _k0 int").repartition(3).cache()


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill in the middle

def middle_filled(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1 << 21, 50])
def test_fill_in_middle(odd, chunk):
    made = fillmiddle.fill_in_middle(odd, chunk=chunk)
    got = _rows(made, "doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output")
    want = [(r.doc_id, *middle_filled(r.doc_id, r.text)) for r in odd.collect()]
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back(odd):
    made = fillmiddle.fill_in_middle(odd, ["doc_id", "text"], plain_percent=0, spm_percent=50)
    back = made.select("form", F.coalesce("text", F.lit("")).alias("text"),
                       fillmiddle.restored(F.col("output"), F.col("form")).alias("back"))
    assert back.where("text <> back OR back IS NULL").count() == 0
    assert back.where("form <> 'plain'").count() > 30


def test_no_cut_when_nothing_is_drawn(spark):
    assert fillmiddle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wavelet_ranks():
    values = np.random.default_rng(1).integers(0, 16, 1000)
    matrix = WaveletMatrix(values, 4)
    places = np.array([0, 1, 63, 64, 65, 500, 999, 1000])
    for v in range(16):
        assert matrix.rank(v, places).tolist() == [(values[:p] == v).sum() for p in places]
    assert WaveletMatrix(values[:0], 4).rank(3, np.array([0])).tolist() == [0]


# Periodic runs

def plain_runs(words, least=24, copies=3):
    out = {}
    for q in range(1, len(words) // copies + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, copies * q):
                out.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(r):
    n, kinds = r.randrange(0, 400), r.choice([1, 2, 2, 3, 5, 50])
    words = [f"w{r.randrange(kinds)}" for _ in range(n)]
    for _ in range(r.randrange(0, 4)):
        a, b = sorted((r.randrange(n + 1), r.randrange(n + 1)))
        p = r.randrange(1, max(2, (b - a) // 2 + 1))
        for i in range(a + p, b):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_runs(spark, odd, chunk):
    r = random.Random(5)
    made = [(1000 + i, " ".join(random_words(r))) for i in range(150)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    found = runs.periodic_runs(docs, ["doc_id", "text"], chunk=chunk)
    several = 0
    for row in found.collect():
        words = brute.spaces_words(row.text)
        want = plain_runs(words)
        several += len(want) > 1
        assert [tuple(x) for x in row.runs] == want
        assert (row.n_words, row.collapsed) == (len(words), collapsed(words, want))
    assert several > 10 and found.count() == docs.count()


def test_other_limits(spark):
    r = random.Random(6)
    texts = [(i, " ".join(random_words(r))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for least, copies in ((40, 3), (24, 5)):
        for row in runs.periodic_runs(docs, least=least, copies=copies).collect():
            assert [tuple(x) for x in row.runs] == plain_runs(texts[row.doc_id][1].split(), least, copies)
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, copies=2)


def test_long_texts_with_one_long_run():
    for words, want in (([1] * 60_000, [(0, 60_000, 1)]),
                        ([1] * 9_000 + [2] + [1] * 9_000, [(0, 9_000, 1), (9_001, 18_001, 1)]),
                        ([*range(9_000)] * 4, [(0, 36_000, 9_000)]), ([*range(40_000)], [])):
        x = np.array(words, np.uint64)
        s, e, q = runs.find_runs(x, np.zeros(len(x), np.int64), 1)
        assert list(zip(s.tolist(), e.tolist(), q.tolist(), strict=True)) == want


def test_differences_are_exact():
    rng = np.random.default_rng(3)
    for top in (1, 40_000, 1 << 30):  # one, two and three primes
        windows = rng.integers(0, min(top, 3) + 1, (6, 40)) * (top // min(top, 3))
        blocks = windows[np.arange(6)[:, None], np.arange(8) + rng.integers(0, 33, 6)[:, None]]
        blocks[5] = top
        lags = np.stack([windows[:, k:k + 8] for k in range(33)], 1)
        assert (ntt.zero_differences(blocks, windows, top) == (lags == blocks[:, None]).all(2)).all()
    with pytest.raises(ValueError):
        ntt.zero_differences(np.zeros((1, 8), np.int64), np.zeros((1, 9), np.int64), 1 << 50)


def test_transforms_invert():
    rng = np.random.default_rng(4)
    for prime, root in ntt.PRIMES:
        rows = rng.integers(0, prime, (3, 64)).astype(np.uint64)
        plan = ntt.Transform(64, prime, root)
        assert (plan.backward(plan.forward(rows)) == rows).all()


def looped_words(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs_row(doc_id, text):
    words = looped_words(doc_id, brute.spaces_words(text))
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha(lines),
            sha(collapsed(words, found)))


def test_runs_query(spark, odd):
    docs = table(spark, SF_MORE, "documents")
    got = QUERIES["op13_periodic_runs"](spark, SF_MORE)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    want = [runs_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert _rows(got, *got.columns) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 30
    changed = odd.select("doc_id", "text", runs.looped().alias("new"))
    for r in changed.collect():
        words = brute.spaces_words(r.text)
        assert brute.spaces_words(r.new) == looped_words(r.doc_id, words)
    best = spark.createDataFrame([([(0, 30, 10), (5, 24, 8), (9, 48, 16)],), ([],)],
                                 runs.T.StructType().add("runs", runs.T.ArrayType(runs._RUN_TYPE)))
    assert [r[0] and tuple(r[0]) for r in best.select(runs.strongest()).collect()] == [(0, 30, 10), None]


def test_runs_of_an_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Web archive

PAGES = [(5, "http://a/1", "<p>one</p>"), (3, "http://a/2 b\r\nEvil: 1", "<p>one</p>"), (9, None, "<p>one</p>"),
         (4, "http://b", None), (8, "http://b", ""), (None, "http://c", "<p>one</p>"), (None, "http://c", "tail\r\n\r\n"),
         (7, "http://d", "é日本🙂"), (7, "http://d", "é日本🙂"), (7, "http://e", "other"),
         (6, "http://f", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n"), (2, "http://g", "x" * 100_000)]


def parsed(data):
    """The records of a WARC file, read by the lengths their headers give."""
    at, out = 0, []
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:stop].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        header = dict(x.split(": ", 1) for x in lines[1:] if x)
        size = int(header["Content-Length"])
        out.append((header, data[stop:stop + size]))
        assert data[stop + size:stop + size + 4] == b"\r\n\r\n"
        at = stop + size + 4
    return out


def archived(pages, min_bytes):
    firsts = {}
    for k, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        firsts.setdefault(html or "", k)
    out, seen = [], set()
    for k, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (html or "").encode()
        revisit = len(raw) >= min_bytes and raw in seen
        seen.add(raw)
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", firsts[html or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES],
                                 "page_id long, url string, html string, digest string, _n int").repartition(3)


@pytest.mark.parametrize("min_bytes", [0, 8])
def test_archive(spark, pages, min_bytes, tmp_path):
    path = new_path(spark)
    warc.write_archive(pages, path, min_bytes=min_bytes)
    records = warc.read_archive(spark, path)
    assert _rows(records, "key", "payload_bytes", "payload_digest", "record_type", "refers_to") == archived(
        PAGES, min_bytes)
    assert sorted(bytes(r.payload) for r in records.collect()) == sorted((h or "").encode() for _, _, h in PAGES)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in PAGES})
    # The files that a WARC reader sees.
    warc.write_warc(records, f"{tmp_path}/warc")
    files = [f for f in os.listdir(f"{tmp_path}/warc") if f.startswith("part-")]
    found = [x for f in files for x in parsed(open(f"{tmp_path}/warc/{f}", "rb").read())]
    assert len(found) == len(PAGES) and len({h["WARC-Record-ID"] for h, _ in found}) == len(PAGES)
    names = {h["WARC-Record-ID"]: h for h, _ in found}
    for header, block in found:
        body = block[block.index(b"\r\n\r\n") + 4:]
        sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        if header["WARC-Type"] == "response":
            assert header["WARC-Payload-Digest"] == sha1
        else:
            first = names[header["WARC-Refers-To"]]
            assert body == b"" and first["WARC-Type"] == "response"
            assert first["WARC-Payload-Digest"] == header["WARC-Payload-Digest"]
            assert first.get("WARC-Target-URI") == header.get("WARC-Refers-To-Target-URI")
    assert {h.get("WARC-Target-URI") for h, _ in found} >= {None, "http://a/2%20b%0D%0AEvil:%201"}


def test_damaged_archives_are_errors(spark, pages):
    for damage in (lambda p: p.withColumn("payload", F.lit(b"forged")), lambda p: p.where("false")):
        path, other = new_path(spark), new_path(spark)
        warc.write_archive(pages, path)
        damage(spark.read.parquet(f"{path}/payloads")).write.parquet(f"{other}/payloads")
        spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
        with pytest.raises(PySparkException):
            warc.read_archive(spark, other).select("payload_digest").collect()


def test_an_empty_archive(spark, pages):
    path = new_path(spark)
    warc.write_archive(pages.where("false"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_a_payload_on_many_records(spark):
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.lit("http://h").alias("url"), F.when(
        F.col("id") % 3 == 1, "same").otherwise(F.col("id").cast("string")).alias("html"))
    path = new_path(spark)
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path).groupBy("record_type", "refers_to").count().collect()
    assert sorted((tuple(r) for r in got), key=repr) == [("response", None, 2001), ("revisit", 1, 999)]
    assert spark.read.parquet(f"{path}/payloads").count() == 2001
