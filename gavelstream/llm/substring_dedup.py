"""Duplicate passages by relative Lempel-Ziv parsing against the earlier documents.

The reference is every document; its index is a table of word windows, each
with the earliest place that holds it, dealt by hash into blocks. A document
asks every block about its windows and is then factored from left to right: at
the first window that an earlier document holds, the factor is the longest match
with that document's own text, as far as it was sent along. The next factor may
start up to a window's length less one before the end of the last, as windows
across the boundary have been looked up too, so that a passage that goes on in
another document is not lost. The factors, all verified word by word, are what
is removed.

Only windows that can repeat are indexed: each window has one anchor, its least
hashed five-word seed, so equal windows have equal anchors, and an anchor that
one document alone holds leads to no duplicate.

Documents travel in batches of about half a megabyte. A batch asks each index block
about its distinct hashes in one packed row, and gets one packed row back, so a
passage that a third of all documents hold costs a number per batch, not per
document; so does the text of a source that many batches ask for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import fixed_splits, from_files, small_batches, text_or_empty

#: Bytes of text hashed at once, and in a batch.
BLOCK_BYTES, BATCH_BYTES = 1 << 17, 1 << 19
#: Batches that ask one source batch in a row.
ASKERS = 1000
SEED_WORDS = 5

_RANDOM = np.random.default_rng(4711)
_BYTES = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, b, np.uint64)))) for b in (_BASE, inverse))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes."""
    total = words[: len(words) - n + 1] * _STEPS[0]
    for k in range(1, n):
        total += words[k : len(words) - n + 1 + k] * _STEPS[k]
    return _mix(total)


class Windows:
    """The windows of some texts: hash, text and word position of each, and its anchor."""

    def __init__(self, texts: list[bytes], size: int):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
        space = _SPACE[data]
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
        if len(data) and not space[0]:
            starts = np.concatenate(([0], starts))
        owner = np.searchsorted(bounds, starts, "right") - 1
        power, inverse = _powers(max(BLOCK_BYTES, 1 << len(data).bit_length()))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)))
        words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        self.n_words = np.bincount(owner, minlength=len(texts))
        if len(words) < size:
            self.at = self.owner = self.anchor_at = np.empty(0, np.int64)
            self.words, self.anchors, self.size, self.first = words, np.empty(0, np.uint64), size, np.zeros(len(texts), np.int64)
            return
        seeds = _runs(words, SEED_WORDS)
        span = size - SEED_WORDS + 1
        n = len(words) - size + 1
        least, at = seeds[:n].copy(), np.arange(n)
        for k in range(1, span):
            better = seeds[k : n + k] < least
            least = np.where(better, seeds[k : n + k], least)
            at = np.where(better, np.arange(k, n + k), at)
        inside = owner[:n] == owner[size - 1 :]
        self.at = np.flatnonzero(inside)
        self.owner, self.anchors, self.anchor_at = owner[self.at], least[self.at], at[self.at]
        self.words, self.size = words, size
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))[:-1]

    def hashes(self, chosen: np.ndarray) -> np.ndarray:
        at = self.at[chosen]
        total = self.words[at] * _STEPS[0]
        for k in range(1, self.size):
            total += self.words[at + k] * _STEPS[k]
        return _mix(total)


_KINDS = [np.dtype(k) for k in ("<u8", "<i8", "u1")]
_HEAD = struct.Struct("<BI")
#: Bytes from which a row is worth compressing; with very many index blocks rows are a few numbers long.
_SMALL = 128


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each by byte plane, which compresses better than whole ones."""
    heads, planes = [bytes([len(arrays)])], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        heads.append(_HEAD.pack(_KINDS.index(x.dtype), len(x)))
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    raw = b"".join((*heads, *planes))
    return b"\0" + raw if len(raw) < _SMALL else b"\1" + zstandard.ZstdCompressor(level=1).compress(raw)


def _unzip(data: bytes) -> list[np.ndarray]:
    raw, out = data[1:] if data[0] == 0 else zstandard.ZstdDecompressor().decompress(data[1:]), []
    at = 1 + raw[0] * _HEAD.size
    for k in range(raw[0]):
        code, n = _HEAD.unpack_from(raw, 1 + k * _HEAD.size)
        kind = _KINDS[code]
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _delta(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; np.cumsum takes them back."""
    return np.diff(x, prepend=x.dtype.type(0))


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(batch, ids, texts): rows in order, about BATCH_BYTES at a time.

    The number follows from the scan's partition and the rows before, so every
    pass over the same files numbers them alike.
    """
    ids, texts, held, made, at = [], [], 0, 0, 0
    for batch in batches:
        at = batch.column("at")[0].as_py() if batch.num_rows else at
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            ids.append(i)
            texts.append(text)
            held += len(text)
            if held >= BATCH_BYTES:
                yield (at << 32) + made, np.array(ids), texts
                ids, texts, held, made = [], [], 0, made + 1
    if ids:
        yield (at << 32) + made, np.array(ids), texts


def _slices(texts: list[bytes], size: int) -> Iterator[tuple[int, Windows]]:
    """Windows of a batch's texts, about BLOCK_BYTES at a time, with the number of texts before."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= BLOCK_BYTES or k == len(texts) - 1:
            yield start, Windows(texts[start : k + 1], size)
            start, held = k + 1, 0


def _by_block_of(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, ...]:
    """The block of each hash, and their order by block and hash with the start and end of each block in it."""
    block = hashes % np.uint64(n_blocks)
    order = np.lexsort((hashes, block))
    block = block[order]
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.empty(0, np.int64)
    return block, order, starts, np.append(starts[1:], len(block)).astype(np.int64)


def _asked(number: int, n_blocks: int, hashes: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A batch's rows to the index blocks: its hashes in rising order, with what goes with each."""
    block, order, starts, ends = _by_block_of(hashes, n_blocks)
    hashes, more = hashes[order], [x[order] for x in more]
    packed = [_zip(_delta(hashes[s:e]), *[x[s:e] for x in more]) for s, e in zip(starts, ends)]
    return _rows(block[starts].astype(np.int32), [number] * len(packed), packed)


def _rows(blocks, batches, packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(batches, pa.int64()), pa.array(packed, pa.binary())], ["block", "batch", "packed"])


_ROWS = "block int, batch long, packed binary"
#: Bits left out of an anchor on its way; equal anchors stay equal, and few others become so.
_SHORT = np.uint64(16)


def _ask_anchors(size: int, n_blocks: int):
    """Each batch's distinct anchors, and whether two of its documents hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, texts in _batched(batches):
            anchors, owners = [], []
            for before, w in _slices(texts, size):
                at, first = np.unique(w.anchor_at, return_index=True)
                anchors.append(w.anchors[first] >> _SHORT)
                owners.append(ids[w.owner[first] + before])
            anchor, least, most = _extremes(np.concatenate(anchors), np.concatenate(owners))
            yield _asked(number, n_blocks, anchor, (least != most).astype(np.uint8))

    return run


def _extremes(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, and the least and greatest id of each."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hashes)) - 1 if len(first) else first
    return hashes[first], ids[first], ids[last]


def _by_block(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """answer(batch numbers, packed rows) for each index block; a block's rows follow each other."""
    last, numbers, packed = None, [], []
    for batch in batches:
        for block, number, data in zip(*(batch.column(c).to_pylist() for c in ("block", "batch", "packed"))):
            if block != last and numbers:
                yield from answer(last, numbers, packed)
                numbers, packed = [], []
            last = block
            numbers.append(number)
            packed.append(data)
    if numbers:
        yield from answer(last, numbers, packed)


def _answered(block: int, numbers: list[int], sizes: list[int], chosen: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The chosen entries of each batch's row, sent back to it."""
    ends = np.cumsum(sizes)
    blocks, to, packed = [], [], []
    for number, s, e in zip(numbers, ends - sizes, ends):
        own = chosen[s:e]
        if own.any():
            hashes, *more = (x[s:e][own] for x in columns)
            blocks.append(block)
            to.append(number)
            packed.append(_zip(_delta(hashes), *more))
    if packed:
        yield _rows(blocks, to, packed)


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors that two documents hold, in one batch or in two."""

    def answer(block: int, numbers: list[int], packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unzip(p) for p in packed]
        hashes, shared = (np.concatenate(x) for x in zip(*[(np.cumsum(h, dtype=np.uint64), f) for h, f in parts]))
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated = (counts > 1) | (np.bincount(inverse, shared, len(counts)) > 0)
        yield from _answered(block, numbers, [len(h) for h, _ in parts], repeated[inverse], [hashes])

    yield from _by_block(batches, answer)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, ids, texts in _batched(batches):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_zip(ids.astype(np.int64), lengths)], pa.binary()), pa.array([body], pa.binary())], ["batch", "index", "body"])


def _unpacked(index: bytes, body: bytes) -> tuple[np.ndarray, list[bytes]]:
    ids, lengths = _unzip(index)
    raw, ends = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(lengths.sum()) + 1), np.cumsum(lengths)
    return ids, [raw[s:e] for s, e in zip((ends - lengths).tolist(), ends.tolist())]


def _windows_asked(ids: np.ndarray, texts: list[bytes], anchors: list[bytes], size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All windows over repeated anchors (hash, row, word position), and each distinct one with its earliest document and place.

    Of a distinct window: hash, in rising order, least doc_id, place (row and
    position), and whether another of the batch's doc_ids holds it.
    """
    wanted = np.sort(np.concatenate([np.cumsum(_unzip(a)[0], dtype=np.uint64) for a in anchors]))
    hashes, rows, positions = [], [], []
    for before, w in _slices(texts, size):
        chosen = np.flatnonzero(_among(w.anchors >> _SHORT, wanted))
        owner = w.owner[chosen]
        hashes.append(w.hashes(chosen))
        rows.append(owner + before)
        positions.append(w.at[chosen] - w.first[owner])
    hashes, rows, positions = map(np.concatenate, (hashes, rows, positions))
    place = rows.astype(np.int64) << 32 | positions
    order = np.lexsort((place, ids[rows], hashes))
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(order) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1 if len(first) else first
    least, most = order[first], order[last]
    return [hashes, rows, positions], [hashes[least], ids[rows[least]], place[least], (ids[rows[least]] != ids[rows[most]]).astype(np.uint8)]


def _ask_windows(size: int, n_blocks: int):
    """Each batch's distinct windows over repeated anchors, with the earliest of its documents that hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, index, body, anchors in zip(*(batch.column(c).to_pylist() for c in ("batch", "index", "body", "anchors"))):
                _, distinct = _windows_asked(*_unpacked(index, body), anchors, size)
                yield _asked(number, n_blocks, *distinct)

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which windows a smaller doc_id than some of the batch's holds, with the earliest document, its batch and its place there."""

    def answer(block: int, numbers: list[int], packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unzip(p) for p in packed]
        sizes = [len(h) for h, *_ in parts]
        hashes, least, place, shared = (np.concatenate(x) for x in zip(*[(np.cumsum(h, dtype=np.uint64), i, p, f) for h, i, p, f in parts]))
        at = np.repeat(np.array(numbers, np.int64), sizes)
        order = np.lexsort((place, at, least, hashes))
        new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(order) else np.empty(0, bool)
        source = np.empty(len(order), np.int64)
        source[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        hit = (least[source] < least) | (shared > 0)
        blocks, to, found = [], [], []
        for number, s, e in zip(numbers, np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            own = source[s:e][hit[s:e]]
            if len(own):
                blocks.append(block)
                to.append(number)
                found.append(_zip(np.packbits(hit[s:e]), least[own], at[own], place[own]))
        if found:
            yield _rows(blocks, to, found)

    yield from _by_block(batches, answer)


#: A run is a stretch of hits whose earliest places go on in one document.
_RUN = ("row", "start", "windows", "source", "at", "place")


def _located(size: int, n_blocks: int):
    """Each batch's runs, and the stretches of text to ask other batches for, in one packed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = [], []
            for number, index, body, anchors, answers in zip(*(batch.column(c).to_pylist() for c in ("batch", "index", "body", "anchors", "answers"))):
                ids, texts = _unpacked(index, body)
                runs = runs_of(ids, *_windows_asked(ids, texts, anchors, size), answers, n_blocks)
                numbers.append(number)
                found.append(_zip(*runs, *_stretches(runs, size)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], ["batch", "found"])

    return run


def _asked_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch that a batch asks for text."""
    for batch in batches:
        for number, found in zip(batch.column("batch").to_pylist(), batch.column("found").to_pylist()):
            at, place, words = _unzip(found)[len(_RUN) :]
            to, first = np.unique(at, return_index=True)
            ends = np.append(first[1:], len(at))
            packed = [_zip(place[s:e], words[s:e]) for s, e in zip(first, ends)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(to), pa.int64()), pa.array(to, pa.int64()), pa.array(packed, pa.binary())], ["batch", "to", "stretches"])


def runs_of(ids: np.ndarray, all_windows: list[np.ndarray], distinct: list[np.ndarray], answers: list[dict], n_blocks: int) -> list[np.ndarray]:
    """Arrays of _RUN, by row and start."""
    hashes, rows, positions = all_windows
    block, order, starts, ends = _by_block_of(distinct[0], n_blocks)
    known = {int(block[s]): order[s:e] for s, e in zip(starts, ends)}
    hit = np.zeros(len(order), bool)
    values = np.zeros((3, len(order)), np.int64)
    for answer in answers:
        asked = known[answer["block"]]
        bits, *columns = _unzip(answer["packed"])
        own = asked[np.unpackbits(bits, count=len(asked)).astype(bool)]
        hit[own] = True
        values[:, own] = columns
    entry = np.searchsorted(distinct[0], hashes)
    chosen = np.flatnonzero(hit[entry])
    chosen = chosen[values[0, entry[chosen]] < ids[rows[chosen]]]
    chosen = chosen[np.lexsort((positions[chosen], rows[chosen]))]
    row, start, (source, at, place) = rows[chosen], positions[chosen], values[:, entry[chosen]]
    goes_on = (np.diff(row) == 0) & (np.diff(start) == 1) & (np.diff(at) == 0) & (np.diff(place) == 1)
    first = np.flatnonzero(np.concatenate(([True], ~goes_on))) if len(chosen) else np.empty(0, np.int64)
    return [row[first].astype(np.int64), start[first].astype(np.int64), np.diff(np.append(first, len(chosen))), source[first], at[first], place[first]]


def _reach(windows: np.ndarray, size: int):
    """How many words of its source a run can become a factor of: those of its windows, and as many again."""
    return 2 * (windows + size - 1)


def _stretches(runs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Batch of sources, place and words of the stretches that the runs need, by batch and place, joined where they overlap."""
    _, _, windows, _, at, place = runs
    order = np.lexsort((place, at))
    at, start, end = at[order], place[order], place[order] + _reach(windows[order], size)
    first = []
    for s, e in zip((bounds := np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(at)]))), bounds[1:]):
        furthest = np.maximum.accumulate(end[s:e])
        own = start[s:e]
        # places of different documents lie far apart
        first.append(s + np.flatnonzero(np.concatenate(([True], (own[1:] > furthest[:-1]) | (own[1:] >> 32 != own[:-1] >> 32)))[: e - s]))
    first = np.concatenate(first) if len(at) else np.empty(0, np.int64)
    return at[first], start[first], np.maximum.reduceat(end, first) - start[first] if len(at) else end


def _send_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of text that other batches asked a batch for."""
    for batch in batches:
        for number, index, body, askers in zip(*(batch.column(c).to_pylist() for c in ("to", "index", "body", "askers"))):
            _, texts = _unpacked(index, body)
            words: dict[int, list[bytes]] = {}
            numbers, packed = [], []
            for asker in askers:
                places, counts = _unzip(asker["stretches"])
                parts = []
                for place, n in zip(places.tolist(), counts.tolist()):
                    row, start = place >> 32, place & 0xFFFFFFFF
                    if row not in words:
                        words[row] = texts[row].split()
                    parts.append(b" ".join(words[row][start : start + n]))
                numbers.append(asker["batch"])
                packed.append(_zip(places, np.frombuffer(b"\n".join(parts), np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([number] * len(numbers), pa.int64()), pa.array(packed, pa.binary())], ["batch", "to", "stretches"])


class Sources:
    """The stretches of source text that a batch was sent."""

    def __init__(self, sent: list[dict]):
        self.places, self.words = {}, {}
        for part in sent:
            places, text = _unzip(part["stretches"])
            self.places[part["to"]] = places
            self.words[part["to"]] = [s.split() for s in text.tobytes().split(b"\n")]

    def text(self, at: int, place: int) -> tuple[list[bytes], int]:
        """The stretch that holds a place, and where in it."""
        k = int(np.searchsorted(self.places[at], place, "right")) - 1
        return self.words[at][k], place - int(self.places[at][k])


def parse(words: list[bytes], runs: list[tuple[int, int, int, int, int]], sources: Sources, size: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, source, source_start) of a document's words, in words.

    runs are (start, windows, source, at, place) by start. A factor starts at
    the first looked-up window from which it can, and is the longest match with
    the source's text, up to the run's reach. The next one starts where the
    windows begin that its end cuts, or later.
    """
    out, least = [], 0
    for start, windows, source, at, place in runs:
        p = max(start, least)
        while p < start + windows:
            own, k = sources.text(at, place + p - start)
            n = matching(words, p, own, k, _reach(start + windows - p, size))
            if n >= size:
                out.append((p, n, source, (place & 0xFFFFFFFF) + p - start))
                least = p + n - size + 1
            p = max(p + 1, least)
    return out


def matching(a: list[bytes], i: int, b: list[bytes], j: int, most: int) -> int:
    """How many words agree from a[i] and b[j] on, at most `most`."""
    n, step = 0, 16
    most = min(most, len(a) - i, len(b) - j)
    while n < most:
        if a[i + n : i + min(n + step, most)] == b[j + n : j + min(n + step, most)]:
            n = min(n + step, most)
            step *= 2
        elif step > 1:
            step = max(1, step // 4)
        else:
            break
    return n


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
_CUT = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:int,length:int,source:long,source_start:int>>"


def _cut_rows(ids, texts: list[list[bytes]], factors: list[list[tuple[int, int, int, int]]]) -> pa.RecordBatch:
    counts, removed, kept = [], [], []
    for words, own in zip(texts, factors):
        counts.append(len(words))
        if own:
            stay = bytearray(b"\1" * len(words))
            for start, length, *_ in own:
                stay[start : start + length] = bytes(length)
            words = [w for w, s in zip(words, stay) if s]
        removed.append(counts[-1] - len(words))
        kept.append(b" ".join(words))
    found = [[{"start": s, "length": n, "source": d, "source_start": o} for s, n, d, o in own] for own in factors]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, _FACTORS)],
        ["doc_id", "n_words", "n_removed", "kept", "factors"],
    )


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for index, body, found, sent in zip(*(batch.column(c).to_pylist() for c in ("index", "body", "found", "sent"))):
                ids, texts = _unpacked(index, body)
                words = [t.split() for t in texts]
                factors: list = [[] for _ in texts]
                if sent:
                    sources, columns = Sources(sent), [x.tolist() for x in _unzip(found)[: len(_RUN)]]
                    by_row: dict[int, list[tuple]] = {}
                    for row, *rest in zip(*columns):
                        by_row.setdefault(row, []).append(tuple(rest))
                    for row, own in by_row.items():
                        factors[row] = parse(words[row], own, sources, size)
                yield _cut_rows(ids, words, factors)

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield _cut_rows(batch.column("doc_id").to_pylist(), [t.split() for t in texts], [[]] * batch.num_rows)


def remove_repeated_passages(docs: DataFrame, window_words: int = 13, n_blocks: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept, factors for each row of docs.

    Words are runs of what is not white space. Every word that a window of
    window_words consecutive words covers goes if the window's words also start
    in a document with a smaller doc_id; kept joins the others by one space.
    factors are the repeated passages: start and length in words, and the doc_id
    and word position of the earlier document that holds them in one piece, which
    is the earliest that holds the factor's first window. Windows are judged on
    the input, not on what is left.

    Null and empty texts have no words. A row with a null doc_id is kept whole
    and takes nothing from others, as it is neither earlier nor later. Rows that
    repeat a doc_id don't remove each other's words. Extra columns are ignored;
    an empty table gives an empty one. Windows are looked up by 64-bit hashes
    and then compared word by word: nothing goes that is not repeated, and a
    repeat is overlooked only where another window of an earlier document has
    its hash.

    docs is read more than once and must give the same rows in the same order
    each time, as files do; what comes from elsewhere is written first, and what
    joins or groups rows of files is the caller's to write.
    n_blocks is the number of index blocks, unset that of shuffle partitions or
    two for each split of the input, as a task holds a block's hashes.
    """
    spark = docs.sparkSession
    small_batches(spark, size="8m")
    fixed_splits(spark)
    docs = from_files(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    n_blocks = n_blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    named = docs.where("doc_id is not null").withColumn("at", F.spark_partition_id())

    def through_index(asked: DataFrame, answer, answers: Column) -> DataFrame:
        dealt = asked.repartition(n_blocks, "block").sortWithinPartitions("block")
        return dealt.mapInArrow(answer, _ROWS).groupBy("batch").agg(F.collect_list(answers).alias("answers"))

    repeated = through_index(named.mapInArrow(_ask_anchors(window_words, n_blocks), _ROWS), _answer_anchors, F.col("packed"))
    repeated = repeated.withColumnRenamed("answers", "anchors").hint("merge")
    # the texts cross the shuffle once, compressed; Spark reuses that exchange for the other joins
    # (the filter is what inner joins would add, and an exchange without it would be another one)
    packed = named.mapInArrow(_pack_texts, "batch long, index binary, body binary").where("batch IS NOT NULL")
    asking = packed.join(repeated, "batch")
    asked = asking.select("batch", "index", "body", "anchors").mapInArrow(_ask_windows(window_words, n_blocks), _ROWS)
    hits = through_index(asked, _answer_windows, F.struct("block", "packed"))
    located = asking.join(hits.hint("merge"), "batch").select("batch", "index", "body", "anchors", "answers")
    located = located.mapInArrow(_located(window_words, n_blocks), "batch long, found binary").where("batch IS NOT NULL").repartition("batch")

    # a source that very many batches ask for answers them some at a time
    asked = located.mapInArrow(_asked_text, "batch long, to long, stretches binary")
    turns = asked.groupBy("to").agg(F.ceil(F.count("*") / ASKERS).alias("turns"))
    asked = asked.join(turns.hint("merge"), "to").withColumn("turn", F.pmod(F.xxhash64("batch"), "turns"))
    asked = asked.groupBy("to", "turn").agg(F.collect_list(F.struct("batch", "stretches")).alias("askers"))
    # by the batch's own name, as a new one would be a new exchange
    sent = packed.join(asked.hint("merge"), packed["batch"] == asked["to"]).select("to", "index", "body", "askers")
    sent = sent.mapInArrow(_send_text, "batch long, to long, stretches binary").groupBy("batch").agg(F.collect_list(F.struct("to", "stretches")).alias("sent"))

    runs = located.join(sent.hint("merge"), "batch")
    cut = packed.join(runs.hint("merge"), "batch", "left").select("index", "body", "found", "sent").mapInArrow(_cut(window_words), _CUT)
    return cut.unionByName(docs.where("doc_id is null").mapInArrow(_whole, _CUT))
