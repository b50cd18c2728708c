"""Importance resampling towards a target distribution, over hashed word features.

Feature counts of the corpus and of the target give each bucket a gain; a
document's weight is the mean gain of its features. A Gumbel number from its id
is added, and the greatest scores are drawn: that samples without replacement
in proportion to the exponentials of the weights. The cut is found by radix
selection over the digits of (score, doc_id), so that only drawn rows are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import LAST_ID, small_batches, stash, text_or_empty

BUCKETS = 10_000
#: A digit of the radix selection: its counts are what reaches the driver.
DIGIT_BITS = 12

#: A-Z as a-z, letters, digits and whatever is not ASCII as they are, all else as white space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def feature_buckets(words: list[bytes], n_buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each two consecutive words: their CRC-32 modulo n_buckets.

    A pair's CRC goes on from its first word's.
    """
    single = list(map(crc32, words))
    pairs = map(crc32, [b" " + w for w in words[1:]], single)
    return np.fromiter((*single, *pairs), np.int64, max(0, 2 * len(words) - 1)) % n_buckets


def feature_counts(rows: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts += np.bincount(feature_buckets(words_of(text), n_buckets), minlength=n_buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    texts = rows.select(text_or_empty().cast("binary").alias("text"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths: the smoothed log ratio of its share in the target and in the corpus.

    One number per bucket comes to the driver, however large the corpus is.
    """
    counts = feature_counts(corpus, n_buckets).withColumnRenamed("n", "s").join(feature_counts(target, n_buckets).withColumnRenamed("n", "t"), "bucket", "full")
    s, t = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
    for row in counts.collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"] or 0, row["t"] or 0
    of_target, of_corpus = float(s.sum() + n_buckets), float(t.sum() + n_buckets)
    ratios = ((float(b) + 1) * of_target / ((float(a) + 1) * of_corpus) for a, b in zip(s.tolist(), t.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios])


def gumbel(doc_id: int | None, seed: int) -> int:
    """A Gumbel number in thousandths, from the seed and the id alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """doc_id, tie, n_words, n_features, weight, score for each row of docs; tie is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, features, weights, scores = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                found = gains[feature_buckets(words, len(gains))]
                weight = int(found.sum()) // len(found) if len(found) else 0
                sizes.append(len(words))
                features.append(len(found))
                weights.append(weight)
                scores.append(weight + gumbel(doc_id, seed))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, features, weights, scores)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *numbers], ["doc_id", "tie", "n_words", "n_features", "weight", "score"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, n_words long, n_features long, weight long, score long")


def _digit(key: Column, shift: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND(2**DIGIT_BITS - 1)


def kth_key(rows: DataFrame, keys: list[Column], k: int) -> list[int]:
    """The k-th smallest (from 1) combination of some long keys, each compared as an unsigned number.

    Digit by digit, from the highest that differs: rows that share the digits
    found so far are counted by the next one, and the k-th is among those of
    one digit. Each step is a grouping with partial sums, whose 4,096 counts at
    most reach the driver.
    """
    found: list[int] = []
    left = rows.select(*[key.alias(f"k{n}") for n, key in enumerate(keys)])
    for n in range(len(keys)):
        key = F.col(f"k{n}")
        # as signed numbers with the highest bit turned, unsigned ones compare right
        turned = key.bitwiseXOR(F.lit(-(2**63)))
        low, high = (x + 2**63 for x in left.agg(F.min(turned), F.max(turned)).first())
        differing = (low ^ high).bit_length()
        top = -(-differing // DIGIT_BITS) * DIGIT_BITS
        prefix = low >> top << top
        for shift in range(top - DIGIT_BITS, -1, -DIGIT_BITS):
            counts = sorted(left.groupBy(_digit(key, shift).alias("digit")).count().collect())
            for digit, count in counts:
                if k <= count:
                    break
                k -= count
            left = left.where(_digit(key, shift) == digit)
            prefix |= digit << shift
        found.append(prefix)
    return found


def _signed(number: int) -> int:
    return number - 2**64 if number >= 2**63 else number


def draw_highest(rows: DataFrame, k: int) -> DataFrame:
    """rows (written: score, doc_id, tie, row) with rank: 1 to k for the highest scores, else null.

    Equal scores go by the smaller doc_id (null last), then by tie, then by row,
    which tells all rows apart, so that no group of equal ones is too large to
    be divided. Ranks come from ranges: each is sorted by itself, and the rows
    before it are counted.
    """
    id_or_last = F.coalesce("doc_id", F.lit(LAST_ID))
    # from the highest score down, and from the smallest id up, as unsigned numbers
    keys = [F.bitwise_not(F.col("score").bitwiseXOR(F.lit(-(2**63)))), id_or_last.bitwiseXOR(F.lit(-(2**63)))]
    unranked = F.lit(None).cast("long").alias("rank")
    if k <= 0:
        return rows.select("*", unranked)
    cut, cut_id = kth_key(rows, keys, k)
    score, last = _signed(~cut & (2**64 - 1) ^ 2**63), _signed(cut_id ^ 2**63)
    drawn = (F.col("score") > score) | ((F.col("score") == score) & (id_or_last <= last))
    order = [F.col("score").desc(), id_or_last.asc(), F.col("tie").asc(), F.col("row").asc()]
    # the number of a row: the range above, the place in the range below
    sorted_rows = rows.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = stash(sorted_rows, "drawn")
    part = F.shiftrightunsigned("_at", 33)
    before, starts = 0, {}
    for number, count in sorted(sorted_rows.groupBy(part.alias("part")).count().collect()):
        starts[number] = before
        before += count
    first = F.array(*[F.lit(starts.get(n, 0)).cast("long") for n in range(max(starts) + 1)])
    rank = F.get(first, part.cast("int")) + F.col("_at").bitwiseAND(2**33 - 1) + 1
    ranked = sorted_rows.withColumn("rank", F.when(rank <= k, rank)).drop("_at")
    return ranked.unionByName(rows.where(~drawn).select("*", unranked))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, n_buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs.

    Of the N rows with at least least_words words, floor(percent * N / 100) are
    drawn: those of the highest score, ranked from 1 on. `target` has a column
    text, whose distribution the drawn rows should come near.

    Null and empty texts have no words, no features and weight 0; a null doc_id
    has a Gumbel number of its own and comes last among equal scores. Rows that
    repeat a doc_id are rows of their own; of equal scores and ids a hash of the
    text decides, and of rows that are equal in all of that any may come first.
    Other columns are ignored, whatever their names. An empty table of documents
    gives an empty one; an empty target gives every bucket no features.
    """
    small_batches(docs.sparkSession)
    gains = bucket_gains(docs, target, n_buckets)
    rows = stash(scored(docs, gains, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    ranked = draw_highest(able, percent * able.count() // 100)
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
