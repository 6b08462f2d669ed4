"""Runs of words, fill-in-the-middle and archives against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusfold.llm import fim, queries, runs, warc


def plain_runs(x, least):
    """Every period by comparison; a stretch counts if none of the smaller periods has it."""
    x, n, out = np.asarray(x), len(x), []
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= q and b - a + q >= least:
                part = x[a:b + q]
                if not any(q % p == 0 and (part[p:] == part[:-p]).all() for p in range(1, q)):
                    out.append((int(a), int(b - a + q), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_of_small_alphabets(least):
    rng = random.Random(least)
    for k in range(300):
        n, letters = rng.randrange(0, 60), rng.choice([1, 2, 3, 4])
        x = [rng.randrange(letters) for _ in range(n)]
        if k % 3 == 0 and n:
            x = (x[:rng.randrange(1, 9)] * n)[:n]
        if k % 5 == 0:
            x = x + x[:n // 2] + x
        assert runs.find_runs(np.array(x, np.int64), least) == plain_runs(x, least), x


def test_runs_of_fibonacci_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert runs.find_runs(np.array(b), 4) == plain_runs(b, 4)
    assert runs.find_runs(np.zeros(20000, np.int64), 12) == [(0, 20000, 1)]
    assert len(runs.squares(b)) < len(b)  # fewer runs than words


def plain_report(i, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len(words)
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = plain_runs([code[w] for w in words], 12)
    drop = {k for s, m, q in found for k in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
    return (i, len(found), *longest, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_report(spark, sf_dir, docs, odd):
    planted = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    more = spark.createDataFrame([(i, t) for i in planted for t in (None, "", "one", "a b c d e f g\th\ni j", "x " * 50)], "doc_id long, text string")
    for df in (docs, odd, more):
        want = sorted((plain_report(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted(map(tuple, runs.run_report(df).collect()), key=str) == want
    got = queries.queries()["op11_periodic_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.filter("n_runs > 0").count() > 5
    assert runs.run_report(odd.filter("false")).count() == 0


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end", "clash"), (2, None, "x")], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in runs.collapse_runs(df).collect()}
    assert got[1].collapsed == "start a b c end" and [tuple(r) for r in got[1].runs] == [(1, 30, 3)] and got[1].n_words == 32
    assert (got[2].collapsed, got[2].runs, got[2].n_words) == ("", [], 0)


def plain_middle(i, text):
    t = text or ""
    units, k = [], 0
    while k < len(t):
        e = k + 1
        if t[k].isascii() and t[k].isalpha():
            while e < len(t) and t[e].isascii() and t[e].isalpha():
                e += 1
        units.append(t[k:e])
        k = e
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, sha(t), sha(t))
    if h[3] % 100 < 20:
        return (i, n, "spm", len(parts[0]), len(parts[1]), sha(f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"), sha(t))
    return (i, n, "psm", len(parts[0]), len(parts[1]), sha(f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"), sha(t))


def test_fill_in_middle(spark, docs, odd):
    evil = ["<P>", "a<S>b", "<M", "<<<<", "S>M>P>", "<S <P <M", "a\nb\r\n\x00c", "😀é<😀", "<P", ">", "x" * 30000 + "<S" * 3000]
    more = spark.createDataFrame([(i * 7 + k, t) for i, t in enumerate(evil) for k in range(12)], "doc_id long, text string")
    seen = set()
    for df in (docs, odd, more):
        want = sorted((plain_middle(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted(map(tuple, fim.fim_report(df).collect()), key=str) == want
        seen |= {r[2] for r in want}
    assert seen == {"plain", "psm", "spm"}
    assert fim.fim_report(odd.filter("false")).count() == 0


def test_another_layout(spark):
    layout = fim.Layout("<|pre|>", "<|suf|>", "<|mid|>", r"\w++|\W", 100, 50, "other")
    df = spark.createDataFrame([(i, f"some text {i} with <P> and é") for i in range(40)], "doc_id long, text string")
    out = fim.fill_in_middle(df, layout).withColumn("back", fim.restore(F.col("output"), F.col("form"), layout)).join(df, "doc_id").collect()
    assert {r.form for r in out} == {"psm", "spm"} and all(r.back == r.text for r in out)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n int")


@pytest.mark.parametrize("heavy", [1, 1000])
def test_archives(spark, heavy, tmp_path):
    """Groups of copies from two to many, through both joins; separators of the format inside payloads, hostile urls, nulls."""
    copies = ["", None, "copy", "é😀", "\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n\r\n", "tail\r\n\r\n"]
    rows = [(i, f"http://x/{i}", copies[i % 7] if i % 3 else f"only {i}", "a", 1) for i in range(200)]
    rows += [(1000, "http://x/\r\nWARC-Type: evil y", "last\r\n\r\nWARC/1.1\r\n", "a", 1), (1001, None, "copy", "a", 1), (None, "u", "copy", "a", 1), (None, "u", "null only", "a", 1), (None, "v", "null only", "a", 1)]
    rows += [(1, "http://x/1", copies[1], "b", 2), (1002, "http://x/z", "twice", "b", 2), (1002, "http://x/z", "twice", "b", 2)]
    pages = pages_of(spark, rows)
    before, warc.HEAVY = warc.HEAVY, heavy
    try:
        for least in (0, 5):
            path = str(tmp_path / f"a{least}")
            warc.write_archives(pages, path, least, date="2024-01-01T00:00:00Z")
            got = warc.resolve(warc.read_archives(spark, path)).collect()
            first = {}
            for i, _, x, _, _ in rows:
                x = (x or "").encode()
                if i is not None and len(x) >= least:
                    first[x] = min(i, first.get(x, i))
            want = []
            for i, _, x, _, _ in rows:
                x = (x or "").encode()
                again = first.get(x, i) != i
                want.append((i, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "revisit" if again else "response", first[x] if again else None))
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
            full = warc.read_archives(spark, path, payloads=True).collect()
            assert sorted(r.payload for r in full if r.record_type == "response") == sorted((x or "").encode() for (_, _, x, _, _), w in zip(rows, want) if w[3] == "response")
            assert all(r.declared_digest == r.payload_digest for r in full if r.record_type == "response")
            assert {r.target_uri for r in full if r.page_id == "1000"} == {"http://x/%0D%0AWARC-Type:%20evil%20y"}
    finally:
        warc.HEAVY = before


def test_archive_format(spark, tmp_path):
    """The files are gzip streams of records that a reader by Content-Length accepts."""
    import gzip

    warc.write_archives(pages_of(spark, [(1, "u", "same", "", 0), (2, "u", "same", "", 0), (3, "w", "é", "", 0)]), str(tmp_path / "a"))
    n = 0
    for f in (tmp_path / "a").glob("part-*"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            block, data = data[:size], data[size:]
            assert block.startswith(b"HTTP/1.1 200 OK\r\n") and data.startswith(b"\r\n\r\n")
            if fields[b"WARC-Type"] == b"revisit":
                assert fields[b"WARC-Profile"].endswith(b"identical-payload-digest") and block.endswith(b"\r\n\r\n")
            data = data[4:]
            n += 1
    assert n == 3


def test_cut_archive_and_missing_original(spark, tmp_path):
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort"
    (tmp_path / "x.gz").write_bytes(gzip.compress(record))
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, str(tmp_path / "x.gz")).collect()
    lone = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <b>\r\nX-Page-ID: 4\r\nWARC-Refers-To: <a>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "y.gz").write_bytes(gzip.compress(lone))
    assert [tuple(r) for r in warc.resolve(warc.read_archives(spark, str(tmp_path / "y.gz"))).collect()] == [(4, None, None, "revisit", None)]


def test_archives_of_an_empty_table(spark):
    assert warc.archive_report(pages_of(spark, []).filter("false")).count() == 0
