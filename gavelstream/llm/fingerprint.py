"""Homomorphic multiset hash of a text's paragraphs.

A paragraph is a line that is not empty. Every piece of a paragraph, with the
piece before it in the paragraph, hashes to a wide vector, and a text's
fingerprint is the sum of its pieces' vectors modulo powers of two: two lanes of
full hashes modulo 2**64, which tell multisets of paragraphs apart, and 128
lanes of plus or minus one modulo 2**32, whose distances also tell how alike
two multisets are. The order of the paragraphs does not matter, nor do empty
ones; paragraphs are added or taken out by adding or subtracting their
fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.llm.common import LAST_ID, small_batches, text_or_empty

#: Lanes modulo 2**32, and the bytes of a fingerprint.
LANES = 128
WIDTH = 16 + 4 * LANES
#: Bytes of text hashed at once, and pieces summed at once.
BLOCK_BYTES, BLOCK_PIECES = 1 << 16, 1 << 14

_RANDOM = np.random.default_rng(20240101)
_BYTES = _RANDOM.integers(0, 2**64, (2, 256), np.uint64)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=4)
def _power_table(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 2**64))
    return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, b, np.uint64)))) for b in (base, inverse))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n modulo 2**64, and their inverses."""
    power, inverse = _power_table(base, max(BLOCK_BYTES, 1 << n.bit_length()))
    return power[: n + 1], inverse[: n + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece of the texts that bounds cuts data into.

    A paragraph ends at a line end. Within it a piece ends at white space after
    about every third word, as the two bytes before the white space say, so that
    an edit changes only the pieces it touches.
    """
    space = np.flatnonzero(_SPACE[data])
    inside = space - bounds[np.searchsorted(bounds, space, "right") - 1] >= 2  # the two bytes are the text's own
    before = data[np.maximum(space - 1, 0)].astype(np.int32) * 7 + data[np.maximum(space - 2, 0)]
    cut = (data[space] == 0x0A) | (inside & (before % 3 == 0))
    at = space[cut]
    # a cut ends a piece before it and starts one after it; so do the texts' own bounds
    ends = np.sort(np.concatenate((at, bounds[1:])), kind="stable")
    starts = np.sort(np.concatenate((at + 1, bounds[:-1])), kind="stable")
    full = starts < ends
    return starts[full], ends[full]


def _begins(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each piece is the first of its paragraph: at the text's start or after a line end, however much white space is cut away between."""
    lines = np.concatenate(([0], np.cumsum(data == 0x0A)))[starts]
    follows = (lines[1:] == lines[:-1]) & (first[1:] == first[:-1])
    return np.concatenate(([True], ~follows))


def _sum_blocks(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.uint8)
    strong, wide = out[:, :16].view(np.uint64), out[:, 16:].view(np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends = _pieces(data, bounds)
    if not len(starts):
        return out
    owner = np.searchsorted(bounds, starts, "right") - 1
    begins = _begins(data, starts, bounds[owner])
    hashes = np.empty((len(starts), 2), np.uint64)
    for k, base in enumerate(_BASES):
        power, inverse = _powers(base, len(data))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[k][data] * power[:-1], dtype=np.uint64)))
        alone = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        # a piece within a paragraph is told by the one before it and the white space between; pieces lie side by side
        before = np.concatenate(([np.uint64(0)], alone[:-1])) + _BYTES[k][data[np.maximum(starts - 1, 0)]]
        hashes[:, k] = np.where(begins, alone, _mix(alone * base + before))
    for k in range(0, len(starts), BLOCK_PIECES):
        h, o = hashes[k : k + BLOCK_PIECES], owner[k : k + BLOCK_PIECES]
        first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        counts = np.diff(np.append(first, len(o)))
        strong[o[first]] += np.add.reduceat(h, first, axis=0)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 16), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.uint16)
        wide[o[first]] += 2 * ones.astype(np.uint32) - counts.astype(np.uint32)[:, None]
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of WIDTH bytes for each UTF-8 text; an empty text has zeros."""
    parts, block, size = [], [], 0
    for text in texts:
        if block and size + len(text) > BLOCK_BYTES:
            parts.append(_sum_blocks(block))
            block, size = [], 0
        block.append(text)
        size += len(text)
    return np.concatenate([*parts, _sum_blocks(block)])


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of a's multisets with b's put in (sign 1) or taken out (sign -1)."""
    out = np.empty_like(a)
    for part, kind in ((slice(0, 16), np.uint64), (slice(16, WIDTH), np.uint32)):
        x, y = (np.ascontiguousarray(f[:, part]).view(kind) for f in (a, b))
        out[:, part] = (x + y if sign > 0 else x - y).view(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How alike the multisets are, 0 to 1: one less the squared distance over the sum of squares, from the wide lanes.

    Right for up to 2**31 pieces a text, as lanes are read with a sign.
    """
    x, y, d = (np.ascontiguousarray(f[:, 16:]).view(np.int32).astype(np.float64) for f in (a, b, combined(a, b, -1)))
    total = (x * x).sum(1) + (y * y).sum(1)
    alike = 1 - (d * d).sum(1) / np.where(total > 0, total, 1)
    return np.where((a == b).all(1), 1.0, np.clip(alike, 0, 1))


def multiset_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (binary) for each row; null and empty texts have zeros."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = fingerprints(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


def _range_of(column: str, cuts: list[int]) -> Column:
    """How many of the rising cuts are at most the column's value, found in two steps of about the square root of their number."""
    side = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[k : k + side] for k in range(0, len(cuts), side)]
    if not parts:
        return F.lit(0)
    heads = F.array(*[F.lit(p[0]) for p in parts])
    own = F.array(*[F.array(*[F.lit(c) for c in p]) for p in parts])
    part = F.size(F.filter(heads, lambda c: c <= F.col(column)))
    within = F.size(F.filter(F.get(own, part - 1), lambda c: c <= F.col(column)))
    return F.when(part == 0, 0).otherwise((part - 1) * side + within)


def with_next(docs: DataFrame, visit, schema: str, ranges_per_partition: int = 4) -> DataFrame:
    """Run visit(rows, following) over all rows in doc_id order; following[i] is the row after rows[i].

    Rows are (doc_id, text). The last row is followed by the first; null ids
    come last, and rows with equal ids are ordered by a hash of their text.
    Ids are cut into ranges at quantiles, as many as a few per shuffle
    partition; a range's first row is sent along to the range before it, so
    that only one shuffle moves the texts and a task holds one batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("rank"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    n = ranges_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("rank", [k / n for k in range(1, n)], 0.2 / n)))
    rows = rows.withColumn("range", _range_of("rank", [min(int(c), LAST_ID) for c in cuts]))

    # at most one row for each range
    firsts = rows.groupBy("range").agg(F.min(F.struct("rank", "tie")).alias("first"))
    order = Window.orderBy("range")
    last_range = F.max("range").over(Window.partitionBy())
    firsts = firsts.select(F.col("first.rank").alias("rank"), F.col("first.tie").alias("tie"), F.coalesce(F.lag("range").over(order), last_range).alias("before"))
    sent = rows.join(F.broadcast(firsts), ["rank", "tie"], "left")
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("sent")), F.struct(F.col("before").alias("range"), F.lit(True).alias("sent")))
    sent = sent.select("rank", "tie", "doc_id", "text", F.inline(F.filter(places, lambda p: p["range"].isNotNull())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("range", "sent", "doc_id", "text")))
            pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[1] and a[0] == b[0]]
            if pairs:
                yield visit([a[2:] for a, _ in pairs], [b[2:] for _, b in pairs])
            held = held[-1:]

    laid = sent.repartition("range").sortWithinPartitions("range", "sent", "rank", "tie")
    return laid.select("range", "sent", "doc_id", "text").mapInArrow(run, schema)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next text's are.

    Returns doc_id, n_chars, fingerprint, edited_fingerprint (binary),
    edited_sha256, near_edited, near_next. The edit replaces the last quarter
    (rounded down) of the code points by the first as many of the next document.
    Null texts are empty; rows that repeat a doc_id give a row each, in the
    order of with_next; a lone row is followed by itself; extra columns are
    ignored; an empty table gives an empty one.
    """
    import hashlib

    def visit(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        edited, raw = [], []
        for (_, text), (_, after) in zip(rows, following):
            n = len(text) // 4
            edited.append((text[: len(text) - n] + after[:n]).encode())
            raw.append(text.encode())
        known: dict[bytes, int] = {}
        ask = [known.setdefault(t, len(known)) for t in (*raw, *(t.encode() for _, t in following))]
        own = fingerprints(list(known))
        mine, nexts, theirs = own[ask[: len(rows)]], own[ask[len(rows) :]], fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([len(t) for _, t in rows], pa.int64()),
                pa.array([f.tobytes() for f in mine], pa.binary()),
                pa.array([f.tobytes() for f in theirs], pa.binary()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                pa.array(likeness(mine, theirs)),
                pa.array(likeness(mine, nexts)),
            ],
            ["doc_id", "n_chars", "fingerprint", "edited_fingerprint", "edited_sha256", "near_edited", "near_next"],
        )

    schema = "doc_id long, n_chars long, fingerprint binary, edited_fingerprint binary, edited_sha256 string, near_edited double, near_next double"
    return with_next(docs, visit, schema)
