"""Near copies are found through their SimHash fingerprints, and checked exactly."""

import random

from gavelstream.llm import simhash


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without what shared shingles find: texts within four bits are linked if they are similar, and only then."""
    found = simhash._meetings
    monkeypatch.setattr(simhash, "_meetings", lambda prefixes, similarity: found(prefixes, similarity).where("a is null"))
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    edited = [*words[:2000], "other", *words[2001:]]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(rng.sample(words, 4000))), (4, "one two three four"), (5, "one two three four " * 9)]
    fps = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert (fps[0] ^ fps[1]).bit_count() <= 4 < (fps[0] ^ fps[2]).bit_count()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_similar_documents(docs).collect()) == [1, 3, 4, 5]
