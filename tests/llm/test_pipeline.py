"""The corpus pipeline and the registered queries, at the smallest scale."""

import hashlib

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest

import __spark_entry__
from gavelstream.llm import bpe, mixing, simhash, toxicity
from gavelstream.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_stages_do_what_their_operators_say(spark, stages):
    docs, clean, single, distinct, mixed, tokens = stages
    model = toxicity.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in stages]
    assert ids[1] == {i for i, s in scores.items() if s < 0.7}
    first = {}
    for r in clean.orderBy("doc_id").collect():
        first.setdefault(" ".join((r["text"] or "").replace("\x0b", " ").replace("\x0c", " ").split()), r["doc_id"])
    assert ids[2] == set(first.values())
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"].encode())) for r in single.collect()}
    linked = {b for b in sets for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert ids[3] == set(sets) - linked
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(distinct).documents.collect()}
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in tokens.collect()) == want


def test_run_equals_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, found.collect())) == sorted(map(str, stages[-1].collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_a_row_for_each_input_row(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    table = "pages" if name.startswith("op10") else "documents"
    assert found.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_registered(spark):
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        want = connection.sql(sql)
        got = QUERIES[name](spark, SF_DIR).select(*want.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_tokenizer_is_read_from_its_path():
    assert len(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))) == 50256


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, equal ids with other texts, and clashing names."""
    text = " ".join(f"word{k * k % 91}" for k in range(80))
    rows = [
        (1, text, "a"), (1, text, "a"), (1, "entirely other words " * 20, "b"), (2, text + " more", "a"), (None, text, None), (None, None, None), (3, None, "a"), (4, "", "b"), (5, " \t\n", None),
        (6, "long " * 100_000 + "end", "b"), (7, " ".join(str(k) for k in range(150_000)), "a"), (8, "kurz", ""), (9, "kurz", ""), (10, "Kurz", None),
    ]
    docs = spark.createDataFrame([(i, t, None, s, None, 1, "x", [2], 0.5, b"z") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, mine string, ids array<int>, score double, hash binary")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents"))
    for start in (spark.read.parquet(str(tmp_path / "documents")), spark.read.parquet(str(tmp_path / "documents")).limit(0)):
        docs, kept = start, []
        for name, stage in corpus_pipeline.STAGES:
            folder = str(tmp_path / f"{name}-{len(kept)}-{start.isEmpty()}")
            stage(spark, docs, SF_DIR).write.parquet(folder)
            docs = spark.read.parquet(folder)
            kept.append(docs.select("doc_id").collect())
        ids = [sorted(str(r["doc_id"]) for r in k) for k in kept]
        if start.isEmpty():
            assert ids == [[]] * 5
            continue
        assert ids[0] == sorted(str(r[0]) for r in rows)
        # of equal texts the smallest id stays, with the rows that repeat it; null and white texts: 3 for the empty ones, 5 for the space
        assert ids[1] == sorted(map(str, [1, 1, 1, 2, 3, 5, 6, 7, 8, 10]))
        # 2 has nearly the shingles of 1, 10 those of 8 in lower case, 5 none as 3 has none
        assert ids[2] == sorted(map(str, [1, 1, 1, 3, 6, 7, 8]))
        assert {int(i) for i in ids[3]} <= {1, 6, 7, 8} and len(ids[4]) == len(ids[3])


def test_rows_that_repeat_an_id_and_a_size_are_mixed_each_by_itself(spark, tmp_path):
    rows = [(1, " ".join(f"{c}{k}" for k in range(80)), "s") for c in "abc"] + [(None, "x y z " * 30, "s"), (2, "t " * 50, None), (2, "t " * 50, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    taken = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs, block_words=8).documents.collect())
    mixed = mixing.mixed_documents(docs, block_words=8).collect()
    by_text = {}
    for r in mixed:
        first = (str(r["doc_id"]), r["text"].split()[0][0])
        by_text[first] = by_text.get(first, 0) + len(r["text"].split())
    ones = sorted(n for (i, _), n in by_text.items() if i == "1")
    assert ones == [n for i, n in taken if i == "1" and n]
    assert sum(by_text.values()) == sum(n for _, n in taken)
