"""Toxic passages by maximum-scoring segments.

Words whose use tells toxic from clean documents get log-odds of either sign,
with a Dirichlet prior; every other word costs what the words between the
marked ones of a toxic passage tell against one. A linear scan finds every
maximal segment of a text's words. The best segment of a clean text of n words has an extreme-value
distribution, P(S >= x) = 1 - exp(-K n exp(-lambda x)); a segment whose expected
number of chance occurrences is small is a toxic passage, and a document's
score is calibrated from that evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import least_hashed, small_batches, text_or_empty

_WORDS = re.compile(r"\w+").findall


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text leaves remainder 1 modulo 3 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Word log-odds of either sign, the cost of other words, the extreme-value parameters and the calibration."""

    odds: dict[str, float]
    cost: float
    scale: float  # lambda
    log_k: float
    weights: tuple[float, float, float]

    def evidence(self, score: float, n_words: int) -> float:
        """Minus the logarithm of the number of segments this good expected by chance in n_words."""
        return min(60.0, max(-30.0, self.scale * score - self.log_k - math.log(max(n_words, 1))))

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        return maximal_segments([(k, s) for k, w in enumerate(words) if (s := self.odds.get(w))], self.cost)

    def score(self, best: float, strong: int) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * best + c * math.log1p(strong)))))


def maximal_segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (start, end, score), end exclusive, in linear time.

    hits are the words with scores of their own (position, score), in order;
    every word between costs `cost`. A segment ends where going on would not
    win back what the words between cost, and segments that together score more
    than either are one.
    """
    stack: list[list[float]] = []  # start, end, total before it, total at its end
    total, last = 0.0, 0
    for at, score in hits:
        total -= cost * (at - last)
        before, total, last = total, total + score, at + 1
        if score <= 0:
            continue
        item = [at, at + 1, before, total]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= item[2]:
                k -= 1
            if k < 0 or stack[k][3] >= item[3]:
                stack.append(item)
                break
            item = [stack[k][0], item[1], stack[k][2], item[3]]
            del stack[k:]
    return [(int(s), int(e), high - low) for s, e, low, high in stack]


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, text, toxic of at most max_rows labelled rows that are not held out, least hash first; equal texts once, with the label of the smallest doc_id."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = least_hashed(known, F.shiftrightunsigned(F.xxhash64("doc_id"), 1), max_rows)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # max_rows bounds the side that is broadcast
    first = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", F.col("toxic").cast("int").alias("toxic"))).alias("first"))
    return first.select("first.doc_id", "text", "first.toxic")


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = set(_WORDS(text.lower()))
            words += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20000, prior: float = 100.0, least_z: float = 6.0, cost: float = 0.2) -> Model:
    """Fit the model on at most max_rows labelled rows that are not held out.

    A word's odds come from the documents that hold it, with a Dirichlet prior
    of `prior` documents spread as the sample's. It keeps them if it stands
    least_z standard deviations from its expected share, on either side; at so
    many, only words of several documents can. The other words' cost is fitted:
    passages are found at a first cost, and the share of toxic words in them,
    against that in clean documents, says what a word without mark is worth.
    max_rows bounds the model and what the driver sees. Without rows of both
    kinds the model scores every text alike, by the known share.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, max_rows).persist()
    try:
        n_all, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        n_clean = n_all - n_toxic
        share = (n_toxic + 1) / (n_all + 2)
        flat = Model({}, cost, 1.0, 0.0, (math.log(share / (1 - share)), 0.0, 0.0))
        if not n_toxic or not n_clean:
            return flat
        words = sample.select("text", "toxic").mapInArrow(_document_words, "word string, toxic int")
        counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        rate = n_toxic / n_all
        z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
        weight = F.col("n") / n_all * prior
        clean = F.col("n") - F.col("t")
        odds = F.log((F.col("t") + weight) / (n_toxic + prior - F.col("t"))) - F.log((clean + weight) / (n_clean + prior - clean))
        kept = counts.withColumn("z", z).where(F.abs("z") >= least_z).select("word", odds.alias("odds"))
        table = {r["word"]: float(r["odds"]) for r in kept.collect()}
        if not any(x > 0 for x in table.values()):
            return flat

        draft = Model(table, cost, 1.0, 0.0, (0.0, 0.0, 0.0))
        draft = replace(draft, cost=_fitted_cost(draft, sample))
        rows = sample.select("text", "toxic").mapInArrow(_draft_rows(draft), "toxic int, n_words long, best double, scores array<double>").collect()
        hits = sample.where("toxic = 0").select("text").mapInArrow(_hits(draft), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    finally:
        sample.unpersist()
    by_score: Counter = Counter()
    for r in hits:
        by_score[table[r["word"]]] += r["n"]
    return _calibrated(draft, rows, by_score)


def _fitted_cost(draft: Model, sample: DataFrame) -> float:
    """Minus the log-odds of a word without toxic mark, inside the best passages of toxic rows against clean rows; half a word of each kind is assumed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, marked = [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = _WORDS(text.lower())
                if toxic:
                    start, end, _ = max(draft.passages(words), key=lambda p: p[2], default=(0, 0, 0.0))
                    words = words[start:end]
                seen.append(len(words))
                marked.append(sum(draft.odds.get(w, 0.0) > 0 for w in words))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(seen, pa.int64()), pa.array(marked, pa.int64())], ["toxic", "seen", "marked"])

    found = sample.select("text", "toxic").mapInArrow(run, "toxic int, seen long, marked long").groupBy("toxic").agg(F.sum("seen").alias("seen"), F.sum("marked").alias("marked")).collect()
    plain = {r["toxic"]: (r["seen"] - r["marked"] + 0.5) / (r["seen"] + 1) for r in found}
    return min(5.0, max(0.05, math.log(plain.get(0, 1.0) / plain.get(1, 0.5))))


def _draft_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, best, scores = [], [], []
            for text in batch.column("text").to_pylist():
                words = _WORDS(text.lower())
                found = [s for _, _, s in model.passages(words)]
                sizes.append(len(words))
                best.append(max(found, default=0.0))
                scores.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(best, pa.float64()), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "n_words", "best", "scores"])

    return run


def _hits(model: Model):
    """How often each word with odds stands in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(w for text in batch.column("text").to_pylist() for w in _WORDS(text.lower()) if w in model.odds)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def _calibrated(draft: Model, rows: list, hits: dict[float, int]) -> Model:
    """Extreme-value parameters from the clean rows, whose words with odds are hits (score: number), then a logistic fit of the labels on the evidence."""
    clean = [r for r in rows if not r["toxic"]]
    n_clean = sum(r["n_words"] for r in clean)
    # a clean word's score: the hits seen, half a hit at the mean score of toxic words, else the cost
    mean = float(np.mean([x for x in draft.odds.values() if x > 0]))
    scores, shares = np.array([*hits, mean]), np.array([*hits.values(), 0.5]) / (n_clean + 1)
    rest = max(0.0, 1 - shares.sum())

    def excess(x: float) -> float:
        return float((shares * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(-x * draft.cost) - 1)

    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 50:
        high *= 1.5
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    scale = (low + high) / 2
    chance = sum(r["n_words"] * math.exp(-min(700.0, scale * r["best"])) for r in clean)
    model = Model(draft.odds, draft.cost, scale, math.log(max(len(clean), 1) / max(chance, 1.0)), (0.0, 0.0, 0.0))

    best = [model.evidence(r["best"], r["n_words"]) for r in rows]
    strong = [sum(model.evidence(s, r["n_words"]) > 0 for s in r["scores"]) for r in rows]
    x = np.column_stack([np.ones(len(rows)), best, np.log1p(strong)])
    y = np.array([r["toxic"] for r in rows], float)
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.odds, model.cost, model.scale, model.log_k, tuple(map(float, w)))


def score_toxicity(docs: DataFrame, model: Model, least_evidence: float = 3.0) -> DataFrame:
    """doc_id, score (0 to 1), passages for each row of docs.

    passages are the segments whose evidence is least_evidence or more: word
    positions start and end (exclusive), score and evidence. Only the text is
    read. Null and empty texts have no passage and the score of no evidence;
    rows that repeat a doc_id give a row each; a null doc_id stays null; extra
    columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, score double, passages array<struct<start:int,end:int,score:double,evidence:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evidence", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                words = _WORDS(text.lower())
                own = [(s, e, x, model.evidence(x, len(words))) for s, e, x in model.passages(words)]
                best = max((o[3] for o in own), default=model.evidence(0.0, len(words)))
                scores.append(model.score(best, sum(o[3] > 0 for o in own)))
                found.append([dict(zip(("start", "end", "score", "evidence"), o)) for o in own if o[3] >= least_evidence])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                words = _WORDS((text or "").lower())
                evidence = [model.evidence(s, len(words)) for _, _, s in model.passages(words)]
                best = max(evidence, default=model.evidence(0.0, len(words)))
                keep.append(model.score(best, sum(e > 0 for e in evidence)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
