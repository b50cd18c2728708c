"""Shingles that many texts share in the near-duplicate stage."""

import random

import numpy as np
from test_near_and_passages import docs, roots, test_no_copy_of_an_original_is_lost

from gavelstream.llm import simhash


def test_shingles_of_some_dozens_of_texts_make_no_groups(spark):
    """Texts that each share two shingles with others hang together as a whole; each shingle alone gives few pairs."""
    shared = [(s, node, place, 300) for s in range(20) for place, node in enumerate(range(s * 40, s * 40 + 60))]
    met = simhash._meetings(spark.createDataFrame(shared, "shingle long, node long, place int, n int"), 0.8).collect()
    assert not any(r["common"] for r in met)
    assert len(met) == 20 * 60 * 59 // 2 and len({(r["a"], r["b"], r["i"], r["j"]) for r in met}) == len(met)


def test_pairs_in_parts_are_all_pairs(monkeypatch):
    rng = random.Random(2)
    sizes = np.array([2, 2, 3, 9, 40, 1, 9, 2])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = np.concatenate([np.sort([rng.randrange(80, 120) for _ in range(k)]) for k in sizes])
    rows = (np.array(rng.sample(range(10**6), len(n))), np.arange(len(n)), n)
    want = {tuple(sorted((int(rows[0][x]), int(rows[0][y])))) for s, k in zip(starts, sizes) for x in range(s, s + k) for y in range(x + 1, s + k) if n[x] >= 0.8 * n[y]}
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(simhash, "PAIRS", most)
        parts = list(simhash._candidates(rows, starts, sizes, 0.8))
        found = [(int(a), int(b)) for part in parts for a, b in zip(part[0], part[1])]
        assert len(found) == len(want) and {*found} == want
        assert most == 1 << 20 or max(len(p[0]) for p in parts) <= max(most, 40 * 39 // 2)


def test_a_group_beyond_pairs_is_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(simhash, "BLOCK_NODES", 32)
    test_no_copy_of_an_original_is_lost(spark, simhash.COMMON + 20)


def test_hashes_of_shingles_tell_them_apart():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(300)] + ["a", "a a", "A a a", "a a a a a", "a a a a a a"]
    words = {t: t.lower().split() for t in texts}
    shingles = {t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t, w in words.items()}
    hashed = {t: set(simhash.shingle_set(t.encode())) for t in texts}
    assert all(len(hashed[a] & hashed[b]) == len(shingles[a] & shingles[b]) for a in texts for b in texts)
    assert simhash.shingle_set(b" \t") == []


def test_similar_texts_over_common_lines(spark):
    """Copies of texts that are made of lines which very many others have."""
    lines = [" ".join(f"l{k}_{j}" for j in range(7)) for k in range(6)]
    rows = [(k, " ".join([*random.Random(k // 2).sample(lines, 5), *(f"x{k // 2}_{j}" for j in range(12)), *([f"y{k}"] if k % 2 else [])])) for k in range(300)]
    sets = {i: set(simhash.shingle_set(t.encode())) for i, t in rows}
    alike = [(a, b) for b in sets for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = [(r["a"], r["b"]) for r in simhash.similar_pairs(docs(spark, rows)).collect()]
    assert alike and set(found) <= set(alike) and roots(found, sets) == roots(alike, sets)
