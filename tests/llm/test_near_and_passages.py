"""SimHash links, components, fingerprints and repeated passages against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavelstream.llm import fingerprint, simhash, substring_dedup
from gavelstream.llm.common import least_hashed
from gavelstream.llm.components import connected_components

WORDS = [f"word{k}" for k in range(300)]


def slow_factors(rows, size=13):
    """The greedy parse by definition, from the whole texts."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").split()
        for s in range(len(words) - size + 1):
            first.setdefault(tuple(words[s : s + size]), (i, s))
    texts = {i: (t or "").split() for i, t in rows}
    out = {}
    for i, words in texts.items():
        hit = [first[tuple(words[s : s + size])] for s in range(len(words) - size + 1)]
        parse, p = [], 0
        while p < len(hit):
            source, o = hit[p]
            if source >= i:
                p += 1
                continue
            k = next((n for n in range(1, len(hit) - p) if hit[p + n] != (source, o + n)), len(hit) - p)
            n = 0
            while n < 2 * (k + size - 1) and p + n < len(words) and o + n < len(texts[source]) and words[p + n] == texts[source][o + n]:
                n += 1
            parse.append((p, n, source, o))
            p += n - size + 1
        out[i] = parse
    return out


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, fp int, packed binary")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [1, 4, 7])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = [m % 2**64 for m in simhash.covering_masks(radius)]
    rng = random.Random(1)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not difference & m for m in masks)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB cé\t\n.", max_size=60))
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (None, 5)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_bounded_sample_takes_the_least_places(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "shiftrightunsigned(xxhash64(id), 1) AS place", "'clash' AS most").repartition(7)
    want = sorted(r["place"] for r in rows.collect())
    assert [r["place"] for r in least_hashed(rows, F.col("place"), 300).collect()] == want[:300]
    assert least_hashed(rows, F.col("place"), 9000).count() == 5000 and least_hashed(rows.where("false"), F.col("place"), 5).count() == 0


@pytest.mark.parametrize("most", [5, 40, 100_000])
def test_most_frequent_shingles(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "FREQUENT", most)
    counts = {k: 4 + k * k for k in range(60)}
    found = simhash._most_frequent(spark.createDataFrame(list(counts.items()), "shingle long, count long"))
    assert len(found) <= most and found.tolist() == sorted(sorted(counts)[60 - len(found) :]) and len(found) >= min(most, 60) / 2


def test_components_of_a_large_star(spark):
    """A centre with very many leaves, and leaves that are linked to each other."""
    links = spark.range(1, 30_000).selectExpr("if(id % 2 = 0, id, 30000) AS a", "if(id % 2 = 0, 30000, id) AS b")
    links = links.unionByName(spark.range(40_000, 40_500).selectExpr("id AS a", "id + 1 AS b")).unionByName(links.limit(50))
    found = connected_components(links)
    assert found.count() == 30_000 + 501
    assert found.groupBy("root").count().orderBy("root").collect() == [(1, 30_000), (40_000, 501)]


@pytest.mark.parametrize("limit", [20000, 4])
def test_links_connect_what_is_near(spark, limit):
    rng = random.Random(7)
    fps = {0}
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 9, 30])):
            fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, bucket_limit=limit).collect()
    near = [(a, b) for k, a in enumerate(fps) for b in fps[:k] if ((a ^ b) % 2**64).bit_count() <= 4]
    assert roots([(r["a"], r["b"]) for r in found], fps) == roots(near, fps)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices(WORDS, k=250)) for _ in range(6)]
    rows = []
    for k in range(40):
        words = base[k % 6].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(250)] = "changed"
        rows.append((100 - k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one"), (204, "ONE"), (None, base[0]), (205, base[1]), (205, base[1]), (206, "word " * 20000)]
    found = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    near = [(k, j) for k in range(len(rows)) for j in range(k) if (fps[k] ^ fps[j]).bit_count() <= 4]
    root = roots(near, range(len(rows)))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root[k]] = min(i, ids.get(root[k], i))
    want = [(i, f - 2**64 if f >= 2**63 else f, ids[root[k]]) for k, ((i, _), f) in enumerate(zip(rows, fps))]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    kept = simhash.drop_near_duplicates(docs(spark, [r for r in rows if r[0] is not None]))
    assert {r["doc_id"] for r in kept.collect()} == set(ids.values())
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        words = rng.choices([f"v{k}_{j % 150}" for j in range(400)] + WORDS, k=rng.choice([60, 300, 900]))
        for _ in range(rng.choice([1, 2, 8])):
            edited = list(words)
            for _ in range(rng.randint(0, len(words) // 60)):
                edited[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(edited)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE two"), (504, "two one"), (505, "a b " * 9000), (506, "b a " * 9000), (None, rows[0][1]), (507, rows[0][1])]
    sets = {i: set(simhash.shingle_set((t or "").encode())) for i, t in rows if i is not None}
    alike = [(a, b) for b in sets for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = [(r["a"], r["b"]) for r in simhash.similar_pairs(docs(spark, rows)).collect()]
    assert set(found) <= set(alike)
    found_root, true_root = roots(found, sets), roots(alike, sets)
    assert found_root == true_root
    kept = simhash.drop_similar_documents(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", *{str(r) for r in found_root.values()}])
    assert simhash.drop_similar_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [12, 90])
def test_no_copy_of_an_original_is_lost(spark, copies):
    rng = random.Random(copies)
    original = rng.choices([f"o{k}" for k in range(5000)], k=300)
    rows = [(1000, " ".join(original))]
    for k in range(copies):
        words = list(original)
        for at in rng.sample(range(300), 5):
            words[at] = f"new{k}_{at}"
        rows.append((k, " ".join(words)))
    assert [r["doc_id"] for r in simhash.drop_similar_documents(docs(spark, rows)).collect()] == [0]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=300), st.sets(st.integers(0, 400), max_size=90), st.sampled_from([0.5, 0.8, 0.95]))
def test_parities_never_part_similar_sets(a, edits, similarity):
    sets = [np.array(sorted(s), np.int64) * 7919 for s in (a, a ^ edits)]
    cells = [simhash.parity(s) for s in sets]
    sizes = [len(s) for s in sets]
    by_pair = simhash._may_be_similar(cells[0], sizes[0], cells[1], sizes[1], similarity)
    assert bool(simhash.possible_forest(cells, np.array(sizes), similarity)[0]) == (by_pair and min(sizes) >= similarity * max(sizes) - 1e-9)
    if len(a - edits) >= similarity * len(a | edits):
        assert by_pair


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(simhash, "BLOCK_NODES", 16)
    test_no_copy_of_an_original_is_lost(spark, 90)


def test_copies_behind_a_text_of_the_same_words(spark):
    rng = random.Random(9)
    lines = [" ".join(rng.choices(WORDS, k=6)) for _ in range(50)]
    orders = [rng.sample(lines, 50) for _ in range(2)]
    near = [*orders[1][:-2], orders[1][-1], orders[1][-2]]
    rows = [(1, " ".join(orders[0])), (2, " ".join(orders[1])), (3, " ".join(near)), (4, " ".join(orders[1]).upper())]
    assert len({frozenset(t.lower().split()) for _, t in rows}) == 1
    assert sorted(r["doc_id"] for r in simhash.drop_similar_documents(docs(spark, rows)).collect()) == [1, 2]


def slow_removal(rows, size=13):
    first = {}
    for i, t in rows:
        words = (t or "").split()
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in rows:
        words = (t or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            if first[tuple(words[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [rng.choices(WORDS, k=rng.randint(13, 60)) for _ in range(8)]
    rows = []
    for i in rng.sample(range(1000), 60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choices(WORDS, k=rng.randint(0, 30))
            p = rng.choice(passages)
            start = rng.randint(0, len(p) - 1)
            words += p[start : start + rng.randint(1, 60)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(2000, None), (2001, ""), (2002, "x " * 12), (2003, "x " * 13), (2004, "x " * 40), (2005, rows[0][1])]
    found = substring_dedup.remove_repeated_passages(docs(spark, rows)).collect()
    want = slow_removal(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found} == want
    assert {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in found} == slow_factors(rows)


def test_passages_of_rows_without_id(spark):
    text = " ".join(WORDS[:20])
    found = substring_dedup.remove_repeated_passages(docs(spark, [(1, text), (None, text), (None, text), (2, text), (2, text)])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in found) == [(False, 0), (False, 20), (False, 20), (True, 0), (True, 0)]
    assert substring_dedup.remove_repeated_passages(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_packed_arrays_come_back(n):
    arrays = [np.arange(n, dtype=np.uint64) << np.uint64(40), -np.arange(n, dtype=np.int64), (np.arange(2 * n) % 3).astype(np.uint8)]
    back = substring_dedup._unzip(substring_dedup._zip(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))


def test_factors_are_verified_and_pass_on(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    sources = substring_dedup.Sources([])
    sources.places, sources.words = {7: np.array([5 << 32 | 3])}, {7: [[w.encode() for w in words]]}
    own = [w.encode() for w in ["x", *words[:40], "y", *words[50:]]]
    runs = [(1, 3, 4, 7, 5 << 32 | 3), (20, 9, 4, 7, 5 << 32 | 22), (44, 1, 4, 7, 5 << 32 | 20)]
    # the first run reaches 30 words; from the cut window on the second one goes on; the third is no match
    assert substring_dedup.parse(own, runs, sources, 13) == [(1, 30, 4, 3), (20, 21, 4, 22)]
    # with a hash that tells nothing, texts decide
    monkeypatch.setattr(substring_dedup, "ASKERS", 2)
    rows = [(k, " ".join([f"own{k}"] * 3 + words[k : k + 30])) for k in range(12)]
    found = substring_dedup.remove_repeated_passages(docs(spark, rows).repartition(6)).collect()
    assert {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in found} == slow_factors(rows)


def test_fingerprints_add_and_subtract():
    a, b = b"one two three four five six\nseven eight\n", b"nine ten\neleven twelve thirteen\n"
    fa, fb, both, swapped = fingerprint.fingerprints([a, b, a + b, b + a])[:, None]
    assert (fingerprint.combined(fa, fb) == both).all() and (both == swapped).all()
    assert (fingerprint.combined(both, fb, -1) == fa).all()
    assert fingerprint.likeness(fa, fa)[0] == 1.0


def test_fingerprint_is_the_same_in_any_company():
    texts = [b"", b" x", b"\n", b"a\nb", "é ü\tö".encode(), b"w " * 100_000, b"a\nb"]
    together = fingerprint.fingerprints(texts)
    alone = np.concatenate([fingerprint.fingerprints([t]) for t in texts])
    assert (together == alone).all() and (together[3] == together[6]).all()


def test_long_repetition_does_not_wrap():
    ones = fingerprint.fingerprints([b"one line of words\n" * n for n in (2, 4, 20_000, 40_000, 65_536)])
    for a, b, n in ((0, 1, 2), (2, 3, 2), (3, 4, 65_536 / 40_000)):
        assert fingerprint.likeness(ones[a : a + 1], ones[b : b + 1])[0] == pytest.approx(1 - (n - 1) ** 2 / (1 + n * n), abs=1e-6)


def test_only_paragraphs_are_a_multiset():
    words = b"abc de fg hi jk lm no pq rs tu vw xy za bc de fg".split()
    rng = random.Random(4)
    line = b" ".join(words)
    same, other = fingerprint.fingerprints([line + b"\n\nabc", b"abc\n" + line]), [b"\n".join(words), b"\t".join(words), b" ".join(words[::-1]), b" ".join(rng.sample(words, len(words))), line[:24] + b"\n" + line[25:]]
    assert (same[0] == same[1]).all()
    assert len({f.tobytes() for f in fingerprint.fingerprints([line, *other])}) == 1 + len(other)


def slow_pieces(text):
    """A text's pieces by definition: within each line, words and what precedes them, cut where the rule says."""
    from collections import Counter

    found = Counter()
    for line in text.split(b"\n"):
        cuts = [k for k, c in enumerate(line) if c in b" \t\x0b\x0c\r" and k >= 2 and (line[k - 1] * 7 + line[k - 2]) % 3 == 0]
        before = None
        for s, e in zip([0, *(k + 1 for k in cuts)], [*cuts, len(line)]):
            if s < e:
                found[line[s:e], before] += 1
                before = line[s:e], line[s - 1 : s]
    return found


def test_likeness_follows_the_pieces():
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 30))]
        texts += ["\n".join(lines).encode(), "\n".join(rng.sample(lines, max(1, len(lines) * 3 // 4))).encode()]
    found = fingerprint.fingerprints(texts)
    errors = []
    for a in range(0, 24, 2):
        for b in (a + 1, (a + 2) % 24):
            x, y = slow_pieces(texts[a]), slow_pieces(texts[b])
            exact = 1 - sum((x[p] - y[p]) ** 2 for p in x | y) / sum(n * n for n in (*x.values(), *y.values()))
            errors.append(fingerprint.likeness(found[a : a + 1], found[b : b + 1])[0] - exact)
    assert max(map(abs, errors)) < 0.3 and abs(np.mean(errors)) < 0.05


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_ranges_equal_a_plain_search(spark, n):
    cuts = sorted(random.Random(n).sample(range(300), n))
    found = spark.range(300).select("id", fingerprint._range_of("id", cuts).alias("r")).collect()
    assert all(r["r"] == np.searchsorted(cuts, r["id"], "right") for r in found)


def test_edited_texts_follow_the_ids(spark):
    rows = [(30, "abcdefgh"), (10, "wxyz"), (20, None), (40, "x"), (None, "last one"), (25, "q" * 30000)]
    found = {r["doc_id"]: r for r in fingerprint.edit_likeness(docs(spark, rows).repartition(3)).collect()}
    import hashlib

    order = [10, 20, 25, 30, 40, None]
    text = {i: t or "" for i, t in rows}
    for i, after in zip(order, order[1:] + order[:1]):
        n = len(text[i]) // 4
        edited = text[i][: len(text[i]) - n] + text[after][:n]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["n_chars"] == len(text[i])
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    assert fingerprint.edit_likeness(docs(spark, [])).count() == 0
    assert fingerprint.edit_likeness(docs(spark, [(1, "a b")])).first()["near_next"] == 1.0
    assert fingerprint.edit_likeness(docs(spark, [(1, "a"), (1, "a"), (1, "b")])).count() == 3
