"""Periodic runs, importance resampling and URL filters against brute force, and awkward rows."""

import math
import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavelstream.llm import importance, periodic_runs, queries, url_filter


def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, [1], 0.5, "x", 2) for i, t in rows], "doc_id long, text string, row int, runs array<int>, score double, tie string, bucket int")


def plain_runs(words):
    """By the definition: all maximal stretches of each period, kept if that period is their smallest."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            body, length = words[i : j + q], j + q - i
            if length >= max(6, 4 * q) and not any(body[p:] == body[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def codes(words):
    return periodic_runs._codes([w.encode() for w in words])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=8), st.sampled_from(["", "c", "ab"]))
def test_runs_equal_the_definition(parts, between):
    words = list(between.join(body * times for body, times in parts))
    assert periodic_runs.runs_of(codes(words)) == plain_runs(words)


@pytest.mark.parametrize("seed", range(6))
def test_long_periods_are_found_by_their_probes(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(4):
        words += rng.choices("abcdefgh"[: rng.choice([2, 8])], k=rng.randrange(200))
        period = rng.choices("abcdefgh"[: rng.choice([2, 8])], k=rng.choice([31, 32, 33, 60, 127, 150]))
        words += (period * 6)[: len(period) * rng.randrange(3, 5) + rng.randrange(200)]
    assert periodic_runs.runs_of(codes(words)) == plain_runs(words)


def test_long_texts_take_time_in_proportion(spark):
    rng = random.Random(1)
    texts = ["a " * 400_000, "a b " * 200_000, " ".join(rng.choices("ab", k=300_000)), " ".join(str(k) for k in range(300_000)) + " x y" * 5]
    found = periodic_runs.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r["strongest"]) for r in found[:2]] == [(0, 400_000, 1), (0, 400_000, 2)]
    assert [len(found[k]["runs"]) for k in (0, 1, 3)] == [1, 1, 1] and tuple(found[3]["strongest"]) == (300_000, 10, 2)
    assert found[0]["collapsed"] == "a" and found[1]["collapsed"] == "a b"


ROWS = [(1, "x x x x x x y"), (1, "x x x x x x y"), (2, None), (3, ""), (4, " \t\n "), (None, "a b a b a b a b a"), (5, "é\u00a0é é\u00a0é é\u00a0é é\u00a0é é\u00a0é é\u00a0é"), (6, "one two")]


def test_runs_of_awkward_rows(spark):
    found = periodic_runs.periodic_runs(docs(spark, ROWS))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed", "strongest"]
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())
    want = [("1", 7, [(0, 6, 1)], "x y")] * 2 + [(k, 0, [], "") for k in "234"] + [("5", 6, [(0, 6, 1)], "é\u00a0é"), ("6", 2, [], "one two"), ("None", 9, [(0, 9, 2)], "a b")]
    assert got == want
    assert periodic_runs.periodic_runs(docs(spark, [])).collect() == []


def test_runs_query_equals_the_contract(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices("abc" if k % 3 else [str(x) for x in range(50)], k=rng.randrange(90)))) for k in range(150)] + [(7, None), (400, "")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc_id, len(runs), *four, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest()))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def plain_resample(documents, target, percent=25, least=20):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for rows, counts in ((documents, s), ([(0, x) for x in target], t)):
        for _, text in rows:
            np.add.at(counts, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    found = []
    for doc_id, text in documents:
        n_words, buckets = features(text)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        found.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    able = sorted((x for x in found if x[4] >= least), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    ranks = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return sorted(str((*x[:4], ranks.get(id(x)))) for x in found)


def test_resampling_equals_the_contract(spark):
    rng = random.Random(2)
    vocabulary = ["The", "été", "naïve", "x1", "A-b", "日本", "data", "model", "of", "İ"]
    rows = [(k * 10**12 - 10**13, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for k in range(300)] + [(5, None), (6, ""), (None, "the data " * 30)]
    target = ["data of the model " * 5, None, ""]
    found = importance.resample(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    got = sorted(str(tuple(r)) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == plain_resample(rows, target)


def test_resampling_of_awkward_rows(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(docs(spark, []), target).collect() == []
    text = "a b c d e f g h i j k l m n o p q r s t u"
    same = importance.resample(docs(spark, [(1, text)] * 41 + [(None, text)] * 3), spark.createDataFrame([], "text string")).collect()
    assert len(same) == 44 and sorted(r["rank"] for r in same if r["rank"]) == list(range(1, 12))
    assert importance.resample(docs(spark, [(1, text)] * 3), target).where("rank IS NOT NULL").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1) | st.integers(-2, 2), st.integers(-3, 3)), min_size=1, max_size=30), st.data())
def test_radix_selection_finds_the_kth(spark, pairs, data):
    k = data.draw(st.integers(1, len(pairs)))
    rows = spark.createDataFrame(pairs, "a long, b long")
    turned = [F.col(c).bitwiseXOR(F.lit(-(2**63))) for c in ("a", "b")]
    assert tuple(x - 2**63 for x in importance.kth_key(rows, turned, k)) == sorted(pairs)[k - 1]


RULES = [*queries.URL_RULES, ("Deep.Example.net", "", "block"), ("example.org", "/a", "allow"), ("example.org", "/a", "block"), (None, "/", "block"), ("org", "/a/b", "allow")]


def plain_verdict(url, listed):
    at = (url or "").find("://")
    tail = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule_host, rule_path, verdict in RULES:
        rule_host = (rule_host or "").lower()
        if rule_host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            fits.append((len(rule_host + rule_path), len(rule_host), rule_host + rule_path, verdict))
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if host and (host.removeprefix("www.") + path.rstrip("/")) in listed else "allow"


URLS = [
    "http://www.example.com/en/x", "HTTP://M.Example.COM/en/", "https://example.com/en", "https://example.com/en/?q", "https://notexample.com/en/", "http://com/", "http://com", "http://a.net/es/1#f",
    "http://a.net/fr", "http://a.net/fr/", "https://x.deep.example.net", "https://deep.example.net?x://y/", "ftp://www.listed.org/p/", "ftp://listed.org/p//?z", "http://listed.org/p/q", "no scheme", "", None,
    "http:///path", "http://h#/es/", "http://.net/es/", "http://a..net/es/", "http://net./es/", "http://x.example.org/a/b/c", "x://y://z.com/", "http://é.com/ü/", "http://" + "a." * 3000 + "com/" + "b/" * 3000,
]


@pytest.mark.parametrize("most_blocks", [1, 2**17])
def test_verdicts_equal_the_definition(spark, most_blocks):
    """Also with a filter of one block, which lets nearly everything through to the join."""
    listed = ["listed.org/p", "www.listed.org/p", None, "listed.org/p", *[f"h{k}.org/" for k in range(300)]]
    pages = spark.createDataFrame([(k // 2, u, 1, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, row int, key string, block string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_filter.judge_urls(pages, rules, spark.createDataFrame([(u,) for u in listed], "url string"), most_blocks=most_blocks)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(k // 2, *plain_verdict(u, set(listed))) for k, u in enumerate(URLS)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_url_filter_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    no_urls = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, none, no_urls).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), none, no_urls).collect() == []


def test_the_filter_keeps_all_listed_and_few_others(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert url_filter.possible_hits(listed, listed).count() == 20_000
    assert url_filter.possible_hits(others, listed).count() < 200


def test_the_url_filter_runs_without_python_workers(spark):
    plan = queries.op13_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
