"""Operators 11 to 13 against brute force and SQL, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stockroom.llm import importance, periodic, registry, url_filter, words
from tests.test_queries import oracle, rows  # noqa: F401

SCHEMA = "doc_id long, text string"
EDGE = [None, "", "a", " \n\t", "x" * 70_000, "same text here", "same text here", "é" * 500, "a a a a a a a", "  İSTANBUL ẞ A1-b2\x00c "]


@pytest.fixture(scope="module")
def edge(spark):
    ids = [None if k == 2 else 5 if k == 6 else k for k in range(len(EDGE))]
    names = ("score", "rank", "runs", "collapsed", "weight", "n_words", "bucket", "start", "__extra")
    return spark.createDataFrame(list(zip(ids, EDGE)), SCHEMA).withColumns({c: F.lit("clash") for c in names})


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_url_filter"])
def test_matches_sql(spark, small, oracle, name):  # noqa: F811
    got, want = registry.QUERIES[name](spark, small).toPandas(), oracle.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


# importance resampling


def test_crcs_of_substrings_follow_from_prefixes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1023, 1024, 1025, 9000):
        data = rng.integers(0, 256, n, dtype=np.uint8)
        start = rng.integers(0, n + 1, 200)
        end = np.minimum(start + rng.integers(0, 5000, 200), n)
        assert importance.Prefixes(data).crcs(start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def plain_features(text, shape):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(own[k : k + n]) for n in range(shape.shortest, shape.longest + 1) for k in range(len(own) - n + 1)]
    return own, [zlib.crc32(g.encode()) % shape.buckets for g in grams]


def test_resampling_equals_brute_force(spark):
    rng, shape = random.Random(5), importance.Features(1, 3, 97)
    text = lambda: "".join(rng.choice(["Wort", "word ", "é", "Ü-", " 12", "\n", "z", ". "]) for _ in range(rng.randrange(120)))
    docs = [(k, text()) for k in range(150)] + [(7, "word z"), (None, text() + " a b c d e f"), (151, None)]
    target = [(0, text()), (1, None), (2, "word word word Wort")]
    seen, theirs = Counter(), Counter()
    for counter, table in ((seen, docs), (theirs, target)):
        for _, t in table:
            counter.update(plain_features(t, shape)[1])
    S, T = sum(seen.values()) + 97, sum(theirs.values()) + 97
    gain = {b: math.floor(1000 * math.log((theirs[b] + 1) * S / ((seen[b] + 1) * T))) for b in range(97)}
    want = []
    for i, t in docs:
        own, features = plain_features(t, shape)
        h = int(hashlib.sha256(f"9:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features)
        want.append([i, len(own), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    enough = sorted((r for r in want if r[1] >= 5), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(enough):
        r.append(k + 1 if k < len(enough) * 30 // 100 else None)
    want = [r if len(r) == 6 else [*r, None] for r in want]
    d, t = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(target, SCHEMA)
    g = importance.gains(d, t, shape)
    got = importance.drawn(importance.scored(d, g, shape, seed=9), 30, 5).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(repr, map(list, got))) == sorted(map(repr, want))
    kept = importance.resampled(d, t, 30, 5, shape, seed=9)
    assert kept.columns == ["doc_id", "text"] and sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r[0]) for r in want if r[5])


def test_resampling_edges(spark, edge):
    gain = importance.gains(edge, edge.limit(0))
    out = importance.drawn(importance.scored(edge, gain), 50, 1)
    assert out.count() == len(EDGE) and len(set(out.columns)) == len(out.columns) and dict(out.dtypes)["rank"] == "bigint"
    ranks = sorted(r["rank"] for r in out.collect() if r["rank"])
    assert ranks == [1, 2, 3]  # of seven texts with a word
    empty = edge.limit(0)
    assert importance.drawn(importance.scored(empty, importance.gains(empty, empty))).count() == 0
    assert importance.resampled(empty, edge).count() == 0
    kept = importance.resampled(edge, edge, 100, 1)
    assert kept.columns == edge.columns and kept.count() == 7


# URL filter


def plain_verdict(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_BYTES, 0])
def test_urls_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "net", "x-y", "é"]) for _ in range(rng.randrange(1, 5)))
    path = lambda: rng.choice(["", "/", "/en", "/en/", "/de/p/", "/é/"])
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((host(), path()) for _ in range(120))}.values())
    odd = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.COM/en/?q=http://b.com/", "a://b.com#/en/", "ftp://com:80/en/", "x\n://net\n/en/", "http://" + "a." * 20_000 + "com/en/"]
    urls = [f"http://{host()}{path()}{rng.choice(['', 'x/y', '?q=1', '#t', '/'])}".replace("a", rng.choice(["a", "A"])) for _ in range(400)] + odd
    pages = spark.createDataFrame([(k % 300, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_filter.judged(pages, spark.createDataFrame(rules, "action string, host string, path string"))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k % 300, u, *plain_verdict(u, rules))) for k, u in enumerate(urls))


def test_no_list_and_no_pages(spark):
    rules = spark.createDataFrame([("block", None, "/"), ("allow", "com", None)], "action string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judged(pages, rules).collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0), rules).count() == 0
    both = spark.createDataFrame([("allow", "COM", "/"), ("block", "com", "/")], "action string, host string, path string")
    assert {r.verdict for r in url_filter.judged(pages.limit(1), both).collect()} == {"block"}


def test_filter_passes_few_that_are_not_listed(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("k"))
    bloom = url_filter.BlockedBloom(keys, 20_000)
    of = lambda c: bloom.holds(url_filter.hashes(c))
    assert keys.where(of(F.col("k"))).count() == 20_000
    assert keys.where(of(F.concat("k", F.lit("x")))).count() < 200


# periodic runs


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < n and w[i] == w[i - q]:
                i += 1
            start, length = s - q, i - s + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k - z] for k in range(start + z, i)) for z in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_text(rng):
    letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 2, 3, 5, 26])]
    w = [rng.choice(letters) for _ in range(rng.randrange(30))]
    for _ in range(rng.randrange(6)):
        period = [rng.choice(letters) for _ in range(rng.randrange(1, 25))]
        at = rng.randrange(len(period))
        w += [period[(at + k) % len(period)] for k in range(rng.randrange(1, 9 * len(period)))] + [rng.choice("abxyz") for _ in range(rng.randrange(4))]
    return " ".join(w[:12] * rng.randrange(1, 9) + w if rng.random() < 0.2 else w)


def test_runs_equal_brute_force():
    rng, total = random.Random(2), 0
    for _ in range(150):
        texts = [odd_text(rng) for _ in range(rng.randrange(1, 9))] + [None, "", " \n"]
        for t, got in zip(texts, periodic.batch_runs(words.split(pa.array(texts, pa.string()), words.NOT_BLANK))):
            want = plain_runs((t or "").split())
            assert got == want, t
            total += len(want)
    assert total > 1000


def test_long_texts_of_few_words():
    rng = random.Random(1)
    for t in ("a " * 100_000, "a a b " * 30_000, " ".join(rng.choice("ab") for _ in range(100_000)), " ".join(str(k % 1000) for k in range(100_000))):
        runs = periodic.batch_runs(words.split(pa.array([t]), words.NOT_BLANK))[0]
        n = len(t.split())
        assert all(length >= max(6, 4 * q) and start + length <= n for start, length, q in runs)
    assert runs == [(0, 100_000, 1000)]


def plain_query(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [odd_text(rng) for _ in range(120)] + [None, "", "\x00 \x85 \u2003", "é é é é é é é"] + [" ".join(f"w{rng.randrange(9)}" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, runs string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([plain_query(k, t) for k, t in enumerate(texts)] + [plain_query(3, texts[3])], key=repr)


def test_runs_edges(spark, edge):
    out = periodic.found_runs(edge, keep=("doc_id", "runs", "__extra"))
    assert out.columns == ["doc_id", "__extra", "runs", "collapsed"] and out.count() == len(EDGE)
    assert [r.collapsed for r in out.where(F.size("runs") > 0).collect()] == ["a"]
    assert periodic.found_runs(edge.limit(0)).count() == 0
