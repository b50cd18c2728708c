"""Exact dedup and source mixing against brute force, with the awkward rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gavelstream.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, len long, head string, rank int"


def table(spark, rows):
    """(doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "h", 2) for i, t, s in rows], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


AWKWARD = [
    (5, "a  b\tc", "x"), (3, "a b c", "x"), (9, "a b c", "y"), (4, "a b d", "x"), (7, None, "x"), (8, "", None), (None, "a b c", "y"), (2, " ", "x"),
    (2, " ", "x"), (11, "w " * 30000, "x"), (12, "w " * 30000, "y"), (13, "prefix " * 60 + "one", "x"), (14, "prefix " * 60 + "two", "x"), (None, "only", "y"),
]


def test_groups_equal_brute_force(spark):
    found = exact_dedup.exact_duplicates(table(spark, AWKWARD), hash_all=True).collect()
    assert len(found) == len(AWKWARD)
    groups = {}
    for i, t, _ in AWKWARD:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, _ in AWKWARD:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_drop_keeps_columns_and_first_rows(spark):
    docs = table(spark, [r for r in AWKWARD if r[0] is not None])
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3, 4, 7, 11, 13, 14]


def test_rows_that_share_an_id_go_by_their_own_texts(spark):
    rows = [(1, "first", "x"), (2, "second", "x"), (2, "first", "x"), (2, "first", "y"), (3, "second", "x"), (None, "second", "x"), (None, "alone", "x")]
    kept = exact_dedup.drop_exact_duplicates(table(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, "first"), (2, "second"), (None, "alone")]))


def test_unhashed_rows_are_alone(spark):
    found = exact_dedup.exact_duplicates(table(spark, AWKWARD)).where("full_hash IS NULL").collect()
    assert all(r["group_size"] == 1 and r["kept"] for r in found)


def test_empty_table(spark):
    empty = table(spark, [])
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert mixing.mix(empty).documents.count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def targets(sizes, weights=(1, 2, 3), most=3):
    """Sizes by source in order; capped shares by repeated sharing."""
    total, weight = sum(sizes), [weights[k % len(weights)] for k in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > most * sizes[k]}
        for k in over or open_:
            out[k] = most * sizes[k] if over else level * weight[k]
        left -= sum(out[k] for k in over)
        open_ -= over or open_
    return out


@pytest.mark.parametrize("sizes", [[100, 10, 10], [5, 1, 500, 40, 3], [7], [1, 1, 1, 1], [0, 10, 1]])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(chr(97 + k) if k < len(sizes) - 1 or k == 0 else None, s) for k, s in enumerate(sizes)], "source string, source_size long")
    found = {r["rank"]: r["target"] for r in mixing.source_targets(rows, (1, 2, 3), 3).collect()}
    assert [found[k] for k in range(len(sizes))] == pytest.approx(targets(sizes))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_permutation(spark, size):
    df = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(5)).alias("p"))
    assert sorted(r["p"] for r in df.collect()) == list(range(size))


def mixed_rows():
    return [(k, " ".join(f"w{k}_{j}" for j in range(40 + 13 * k % 90)), None if k % 7 == 0 else f"s{k % 3}") for k in range(120)] + [(200, None, "s1"), (201, "", "s2"), (202, "w " * 3000, "s0"), (None, "a b c", "s0")]


def test_mixture(spark):
    docs = table(spark, mixed_rows())
    found = mixing.mix(docs, block_words=8, shard_slots=64).documents.collect()
    assert len(found) == 124
    by_source = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        by_source.setdefault(r["source"], [r["target"], 0, r["source_size"], 0])
        by_source[r["source"]][1] += r["taken"]
        by_source[r["source"]][3] += r["size"]
    assert all(size == total for _, _, size, total in by_source.values())
    assert sum(t for t, *_ in by_source.values()) == pytest.approx(sum(r["size"] for r in found))
    for target, taken, *_ in by_source.values():
        assert taken == pytest.approx(target, rel=0.03)
    again = mixing.mix(docs.repartition(3), block_words=8, shard_slots=64).documents.collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_slots_follow_the_shares(spark):
    mixture = mixing.mix(table(spark, mixed_rows()), block_words=8, shard_slots=64)
    slots = mixture.slots.collect()
    assert sorted(s["slot"] for s in slots) == list(range(len(slots)))
    used = {}
    for s in slots:
        used.setdefault((s["source"], s["epoch"]), []).append(s["block"])
    assert all(len(b) == len(set(b)) for b in used.values())  # a block once per epoch


def test_mixed_documents_hold_the_taken_words(spark):
    docs = table(spark, [r for r in mixed_rows() if r[0] is not None])
    mixture = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block_words=8, shard_slots=64).documents.collect()}
    for name in ("_id", "_size", "mine", "ROW", "pieces"):
        docs = docs.withColumn(name, F.lit("kept"))
    mixed = mixing.mixed_documents(docs, block_words=8, shard_slots=64)
    assert mixed.columns == docs.columns and mixed.where("_id != 'kept' or mine != 'kept' or row != 'kept'").isEmpty()
    words, texts = {}, {i: t for i, t, _ in mixed_rows()}
    for r in mixed.collect():
        own = r["text"].split()
        assert r["n_chars"] == len(r["text"]) and set(own) <= set(texts[r["doc_id"]].split())
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(own)
    assert words == {i: n for i, n in mixture.items() if n}
