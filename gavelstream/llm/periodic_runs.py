"""Periodic runs of words: bit planes of word ids, XORed with themselves at each lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import WORD, small_batches, text_or_empty

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: From this lag on a lag's bits are compared only where its probes agree.
PROBED = 32
#: Probes a lag; a run of LEAST_PERIODS periods holds three times as many in a row.
PROBES = 4
#: Word positions probed at once.
BLOCK = 2_000_000

RUNS = "array<struct<start:long,length:long,period:long>>"


def bit_planes(codes: np.ndarray) -> list[int]:
    """Bit b of all codes as one integer, the first code lowest, for each b."""
    n_planes = max(1, int(codes.max()).bit_length())
    return [int.from_bytes(np.packbits(((codes >> b) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(n_planes)]


def zero_stretches(mismatch: int, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal stretches of at least so many zeros among the lowest n bits.

    Bits are ANDed with themselves shifted by doubling steps, until each that is
    left stands for `least` matches from it on.
    """
    same, have = ~mismatch & ((1 << n) - 1), 1
    while same and have < least:
        step = min(have, least - have)
        same &= same >> step
        have += step
    if not same:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.unpackbits(np.frombuffer(same.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits.view(np.int8), prepend=0, append=0))
    return edges[0::2], edges[1::2] - 1 + least


def _probed_lags(codes: np.ndarray, lags: np.ndarray, owner: np.ndarray, periods: np.ndarray) -> Iterator[int]:
    """Of lags within a factor of two, those that can have a run.

    A run of four periods at lag q agrees at 3q places in a row, so at twelve
    probes in a row that lie q // 4 apart. Twelve that lie in one known run
    whose period divides q say nothing new: what holds them has that period.
    """
    n, row = len(codes), PROBES * len(codes) // int(lags[0]) + 2 * PROBES
    for at in range(0, len(lags), max(1, BLOCK // row)):
        part = lags[at : at + max(1, BLOCK // row)][:, None]
        step = part // PROBES
        places = np.arange(row)[None, :] * step
        inside = places + part < n
        agree = inside & (codes[np.where(inside, places, 0)] == codes[np.where(inside, places + part, 0)])
        agree = agree[:, :-1] & agree[:, 1:]
        agree = agree[:, :-2] & agree[:, 2:]
        agree = agree[:, :-4] & agree[:, 4:]
        agree = agree[:, :-4] & agree[:, 4:]
        rows, firsts = np.nonzero(agree)
        q, begin = part[rows, 0], firsts * step[rows, 0]
        end = begin + (3 * PROBES - 1) * step[rows, 0] + q
        known = (owner[begin] >= 0) & (owner[begin] == owner[end])
        known[known] = q[known] % periods[owner[begin[known]]] == 0
        yield from np.unique(q[~known]).tolist()


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run as (start, length, smallest period), by start, then period.

    A stretch that a lag finds after a smaller one did has that smaller period.
    """
    n = len(codes)
    longest = n // LEAST_PERIODS
    if n < LEAST_WORDS:
        return []
    planes = bit_planes(codes)
    found: dict[tuple[int, int], int] = {}
    owner, periods = np.full(n, -1), []

    def at_lag(q: int) -> None:
        mismatch = 0
        for plane in planes:
            mismatch |= plane ^ (plane >> q)
        starts, ends = zero_stretches(mismatch, n - q, max(LEAST_WORDS, LEAST_PERIODS * q) - q)
        for start, end in zip(starts.tolist(), (ends + q).tolist()):
            if (start, end) not in found:
                found[start, end] = q
                if end - start >= LEAST_PERIODS * PROBED:
                    owner[start:end] = len(periods)
                    periods.append(q)

    for q in range(1, min(PROBED, longest + 1)):
        at_lag(q)
    low = PROBED
    while low <= longest:
        lags = np.arange(low, min(2 * low, longest + 1))
        for q in list(_probed_lags(codes, lags, owner, np.array(periods or [1]))):
            at_lag(q)
        low *= 2
    return sorted((start, end - start, q) for (start, end), q in found.items())


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return words if kept.all() else [words[k] for k in np.flatnonzero(kept).tolist()]


def _codes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _run_lists(per_document: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([run for runs in per_document for run in runs], np.int64).reshape(-1, 3)
    offsets = np.cumsum([0, *map(len, per_document)]).astype(np.int32)
    fields = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, sizes, bodies = [], [], []
        for text in batch.column("text").to_pylist():
            words = text.split()
            runs = runs_of(_codes(words))
            found.append(runs)
            sizes.append(len(words))
            bodies.append(b" ".join(without_repeats(words, runs)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), _run_lists(found), pa.array(bodies, pa.binary())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed, strongest for each row of docs.

    Words are what white space separates, numbered from 0. A run is a stretch
    of consecutive words with smallest period q and at least max(6, 4q) words
    that no neighbouring word extends; runs are ordered by start, then period.
    `collapsed` is the text without the words that a run has after its first q,
    joined by one space. `strongest` is the run with the greatest length over
    period (ties: smallest start, then period), null without runs.

    Null and empty texts have no words, no runs and an empty `collapsed`. Rows
    that repeat a doc_id, or have none, give a row each; other columns are
    ignored, whatever their names; an empty table gives an empty one. A text
    takes memory in proportion to its words and is a row of its own, so that
    nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    # bytes, as their split() knows just the white space meant here
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    found = texts.mapInArrow(_find, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
    return found.select("doc_id", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"), _strongest().alias("strongest"))


def _strongest() -> Column:
    def stronger(best: Column, run: Column) -> Column:
        ahead, behind = run["length"] * best["period"], best["length"] * run["period"]
        first = F.struct(run["start"].alias("start"), run["period"].alias("period")) < F.struct(best["start"].alias("start"), best["period"].alias("period"))
        return F.when((ahead > behind) | ((ahead == behind) & first), run).otherwise(best)

    return F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), stronger))


def plant_repeats(docs: DataFrame) -> DataFrame:
    """docs with periodic words in the texts of some documents, in the way that the query's contract lays down.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10), documents of
    h % 10 = 0 repeat, from word a = g % n on, their next 1 + floor((n - a) /
    (3 + g % 8)) words. A null doc_id or text stays as it is.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    # the words are a column first, so that the text is split once
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"))
    return chosen.select("doc_id", F.when(F.size("_words") > 0, F.array_join(planted(F.col("_words")), " ")).otherwise(F.col("text")).alias("text"))
