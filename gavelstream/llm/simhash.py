"""SimHash near-duplicates, found through covering locality-sensitive hashing.

Every bit gets a vector over radius + 1 binary dimensions; table v keeps the
bits whose vector has an odd inner product with v. At most `radius` vectors
span less than the whole space, so some v is orthogonal to those of all
differing bits: in that table the two fingerprints are equal. No pair within
the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import small_batches, stash, text_or_empty
from gavelstream.llm.components import connected_components

BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 16384


@lru_cache(maxsize=8)
def covering_masks(radius: int, family: int = 0) -> list[int]:
    """One mask of kept bits, as a signed 64-bit number, for each of the 2 ** (radius + 1) - 1 tables.

    Bits take vectors a step apart. Any step is certain to find the pairs; the
    first under which every table keeps enough bits also tells others apart.
    Another family lays the bits out in another order.
    """
    span = 2 ** (radius + 1) - 1

    def masks(step: int) -> list[int]:
        vectors = [(bit * (family * 26 + 1) + family) % BITS * step % span + 1 for bit in range(BITS)]
        return [sum(1 << bit for bit, v in enumerate(vectors) if (v & table).bit_count() % 2) for table in range(1, span + 1)]

    kept = lambda step: min(m.bit_count() for m in masks(step))
    step = next((s for s in range(1, span) if kept(s) >= BITS * 3 // 8), None) or max(range(1, span), key=kept)
    return [m - 2**64 if m >= 2**63 else m for m in masks(step)]


def _words(text: bytes) -> list[bytes]:
    """bytes.lower and bytes.split treat exactly A-Z and the ASCII white space."""
    return text.lower().split()


def _hashes(words: list[bytes], shingle_words: int, seed: int) -> tuple[Iterator[np.ndarray], int]:
    """The unsigned hashes of all shingles, in blocks, and their number; the whole sequence is one if it has fewer words."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    blocks = ((starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist()) for k in range(0, len(starts), BLOCK))
    return (np.array([digest(joined[s:e], seed) for s, e in zip(*block)], np.uint64) for block in blocks), len(starts)


def fingerprint(text: bytes, shingle_words: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a UTF-8 text."""
    return _fingerprint(_words(text), shingle_words, seed)


def _fingerprint(words: list[bytes], shingle_words: int = 4, seed: int = 42) -> int:
    return _majority(*_hashes(words, shingle_words, seed)) if words else 0


def _majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The bits that are set in over half of n hashes."""
    counts = np.zeros(BITS, np.int64)
    for hashes in blocks:
        rows = hashes.view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row; null and empty texts have 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Members of a bucket that are joined by shortest links.
TREE = 48


def _shortest_tree(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Prim's algorithm over the distances up to the radius."""
    near, source = np.full(len(fps), BITS + 1), np.zeros(len(fps), np.int64)
    left, at = np.ones(len(fps), bool), 0
    members, sources = [], []
    for _ in range(len(fps) - 1):
        left[at] = False
        distance = np.bitwise_count((fps ^ fps[at]).view(np.uint64))
        closer = distance < near
        near[closer], source[closer] = distance[closer], at
        at = int(np.argmin(np.where(left, near, BITS + 2)))
        if near[at] <= radius:
            members.append(fps[at : at + 1])
            sources.append(fps[source[at] : source[at] + 1])
    return members, sources


def _forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs (members, the one they were found from), each within the radius, that join whatever of fps is connected.

    Up to TREE members are joined by a tree of shortest links. The search among
    more starts in one order everywhere and takes all that are near at once, so
    that the buckets of a large group give few different pairs.
    """
    if len(fps) <= TREE:
        return _shortest_tree(fps, radius)
    return _star(fps, radius)


def _star(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As _forest, by a search in one order everywhere."""
    rest, members, sources = fps[np.argsort(fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))], [], []
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            at = open_.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= radius
            if near.any():
                new, rest = rest[near], rest[~near]
                open_ += list(new)
                members.append(new)
                sources.append(np.full(len(new), at))
    return members, sources


def links(fps: DataFrame, radius: int = 4, bucket_limit: int = 20000) -> DataFrame:
    """a, b: pairs that connect all fingerprints (distinct, column fp) within the radius of each other.

    Buckets are read as runs of a sorted partition. A bucket gives a spanning
    forest of its links, not its pairs. One with more than bucket_limit
    fingerprints is cut by a second family of masks, under which again every
    pair within the radius meets; what still is larger is compared block against
    block, each pair of blocks in a group of its own, so that no task holds the
    bucket.
    """

    def emit(a, b, slot=None, key=None) -> pa.RecordBatch:
        n = len(a)
        over = [pa.array(slot, pa.int32()), pa.array(key, pa.int64())] if slot is not None else [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *over], ["a", "b", "slot", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, key, fp = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        spilling: tuple | None = None
        for batch in batches:
            more = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "key", "fp")]
            slot, key, fp = (np.concatenate(x) for x in zip((slot, key, fp), more))
            cut = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cut))
            done = int(starts[-1])  # the last run may go on in the next batch
            if spilling and (slot[0], key[0]) == spilling:
                n = int(starts[1]) if len(starts) > 1 else len(fp)
                yield emit(fp[:n], fp[:n], slot[:n], key[:n])
                if len(starts) == 1:
                    slot, key, fp = slot[n:], key[n:], fp[n:]
                    continue
                starts, spilling = starts[1:], None
            yield from joined(fp, starts[:-1], np.diff(starts))
            slot, key, fp = slot[done:], key[done:], fp[done:]
            if len(fp) > bucket_limit:
                spilling = (slot[0], key[0])
                yield emit(fp, fp, slot, key)
                slot, key, fp = slot[:0], key[:0], fp[:0]
        if len(fp):
            if spilling and (slot[0], key[0]) == spilling:
                yield emit(fp, fp, slot, key)
            else:
                yield from joined(fp, np.array([0]), np.array([len(fp)]))

    def joined(fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = starts[sizes == 2]
        near = np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= radius
        a, b = [fp[pairs][near]], [fp[pairs + 1][near]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            members, sources = _forest(fp[s : s + n], radius)
            a += members
            b += sources
        if sum(map(len, a)):
            yield emit(np.concatenate(a), np.concatenate(b))

    def searched(buckets: DataFrame) -> DataFrame:
        buckets = buckets.repartition(F.col("slot"), F.col("key")).sortWithinPartitions("slot", "key")
        return stash(buckets.mapInArrow(run, "a long, b long, slot int, key long"), "simhash-links")

    masks = covering_masks(radius)
    found = searched(fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("slot", "key")))
    small, large = found.where("slot is null").select("a", "b"), found.where("slot is not null")
    if large.isEmpty():
        return small.distinct()

    # buckets beyond the limit: the bits that they share and those of a second family of masks
    kept = F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("slot") + 1)
    finer = F.posexplode(F.array(*[F.lit(m) for m in covering_masks(radius, 1)])).alias("finer", "mask")
    large = large.select(F.col("a").alias("fp"), kept.alias("kept"), "slot", finer)
    large = large.select("fp", (F.col("slot") * len(masks) + F.col("finer")).cast("int").alias("slot"), F.col("fp").bitwiseAND(F.col("kept").bitwiseOR(F.col("mask"))).alias("key"))
    found = searched(large)
    small = small.unionByName(found.where("slot is null").select("a", "b"))

    # those still beyond it: every pair of blocks meets once
    large = found.where("slot is not null").select("slot", "key", F.col("a").alias("fp"))
    if large.isEmpty():
        return small.distinct()
    sizes = stash(large.groupBy("slot", "key").agg(F.ceil(F.count("*") / (bucket_limit // 2)).cast("int").alias("blocks")), "simhash-sizes")
    large = large.join(sizes, ["slot", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def block_pair(t: pa.Table) -> pa.Table:
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in _forest(t.column("fp").to_numpy(), radius))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = large.groupBy("slot", "key", "i", "j").applyInArrow(block_pair, "a long, b long")
    return small.unionByName(pairs).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, shingle_words: int = 4) -> DataFrame:
    """doc_id, fp, component_id for each row of docs.

    component_id is the smallest doc_id that links of at most `radius`
    differing bits reach, the row's own included. Equal fingerprints are linked
    and are searched once. Null and empty texts have fingerprint 0 and link like
    others. Rows that repeat a doc_id each give a row; a null doc_id is never a
    component_id unless all of its component are null. Extra columns are
    ignored; an empty table gives an empty one.
    """
    rows = stash(simhash(docs, shingle_words), "simhash")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that the join has an exchange of its own on each side, which Spark can split at a root of very many
    least = stash(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-roots")
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4, shingle_words: int = 4) -> DataFrame:
    """The rows of docs whose doc_id stands for their component, with all their columns."""
    kept = near_duplicates(docs, radius, shingle_words).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def shingle_set(text: bytes, shingle_words: int = 5, seed: int = 42) -> list[int]:
    """Signed hashes of the text's distinct shingles; of the whole sequence if it has fewer words, none if it has no words."""
    return _distinct(_words(text), shingle_words, seed).tolist()


def _distinct(words: list[bytes], shingle_words: int, seed: int = 42) -> np.ndarray:
    """shingle_set of a text's words, sorted."""
    if not words:
        return np.empty(0, np.int64)
    hashes = np.sort(np.concatenate([b.view(np.int64) for b in _hashes(words, shingle_words, seed)[0]]))
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


#: A shingle that stands in the prefixes of more sets than this is compared by blocks. Twice as many as the sample finds
#: on average (LEAST), so that few shingles are neither put last nor met in pairs: groups of those grow together.
COMMON = 128
#: A shingle is frequent if it comes so often in a sample of one text in SAMPLED.
LEAST, SAMPLED = 4, 16
#: Shingles of the sets of a block, and sets of a block that is compared by parities, about.
BLOCK_SHINGLES, BLOCK_NODES = 400_000, 2048
#: Frequent shingles that are put last in the order of prefixes, at most (16 MB); the order decides on the time taken, not on the result.
FREQUENT = 2_000_000
#: Rows of the prefix table that are looked at together.
ROWS = 200_000
#: Pairs that are made of them at once.
PAIRS = 1 << 20


def _sorted_set(words: list[bytes], shingle_words: int) -> tuple[np.ndarray, int]:
    """The sorted set of the words' shingles, and its signed hash."""
    shingles = _distinct(words, shingle_words)
    node = xxhash.xxh64_intdigest(shingles.tobytes())
    return shingles, node - 2**64 if node >= 2**63 else node


def parity(shingles: np.ndarray) -> bytes:
    """Whether an even or odd number of the shingles falls into each cell; about a cell for each shingle, 64 at least.

    Two sets differ in as many shingles at least as in cells, which tells most
    dissimilar sets apart by an eighth of a byte for each shingle.
    """
    cells = max(64, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 64)
    counts = np.bincount((shingles & (cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _halved(cells: np.ndarray) -> np.ndarray:
    """Parities (rows of bytes) over half as many cells."""
    half = cells.shape[1] // 2
    return cells[:, :half] ^ cells[:, half:]


def _most_apart(na, nb, similarity: float):
    """In how many elements sets of na and nb can differ at most if they are that similar."""
    return (na + nb) * (1 - similarity) / (1 + similarity) + 1e-9


def _may_be_similar(a: bytes, na: int, b: bytes, nb: int, similarity: float) -> bool:
    x, y, width = _number(a), _number(b), 8 * min(len(a), len(b))
    return (_folded(x, 8 * len(a), width) ^ _folded(y, 8 * len(b), width)).bit_count() <= _most_apart(na, nb, similarity)


def _number(cells: bytes) -> int:
    return int.from_bytes(cells, "little")


def _folded(cells: int, bits: int, width: int) -> int:
    """Parities over `bits` cells (a power of two times the width) as parities over width cells."""
    while bits > width:
        bits //= 2
        cells = cells >> bits ^ cells & ((1 << bits) - 1)
    return cells


def _prefix(shingles: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's first shingles, frequent ones last, that no similar set is without all of them."""
    n = len(shingles)
    if not n:
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), max(len(frequent) - 1, 0))
    last = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    return np.concatenate([shingles[~last], shingles[last]])[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def _candidates(rows: tuple[np.ndarray, ...], starts: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[list[np.ndarray]]:
    """a, b, i, j, na, nb: all pairs of each run of rows (node, place, n) that can be similar by their n, in parts of about PAIRS."""
    node, place, n = rows
    for d in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == d]
        y, x = np.tril_indices(d, -1)
        step = max(1, PAIRS // len(x))
        for k in range(0, len(at), step):
            left, right = ((at[k : k + step, None] + side).ravel() for side in (x, y))
            close = n[left] >= similarity * n[right] - 1e-9  # runs are sorted by n
            left, right = left[close], right[close]
            swap = node[left] > node[right]
            a, b = np.where(swap, right, left), np.where(swap, left, right)
            yield [node[a], node[b], place[a], place[b], n[a], n[b]]


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    rows, count_of = rows[order], np.repeat(count, count)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for d in range(2, 9):  # rare elements by their pairs
        members = rows[count_of == d].reshape(-1, d)
        for y in range(1, d):
            for x in range(y):
                np.add.at(shared, (members[:, x], members[:, y]), 1)
    shared += shared.T
    many, width = count_of > 8, 1024
    rows, counts = rows[many], count[count > 8]
    ends = np.concatenate(([0], np.cumsum(counts)))
    for k in range(0, len(counts), width):  # others by products of 0/1 matrices
        part = slice(ends[k], ends[min(k + width, len(counts))])
        ones = np.zeros((len(sets), min(width, len(counts) - k)), np.float32)
        ones[rows[part], np.repeat(np.arange(ones.shape[1]), counts[k : k + width])] = 1
        shared += ones @ ones.T
    return shared


def similar_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Places of similar pairs that join whatever of the sets is connected, found by comparing each with each."""
    n, shared = np.array([len(s) for s in sets]), _shared_counts(sets)
    rest, members, sources = np.arange(len(sets)), [], []
    while len(rest) > 1:
        open_, rest = [int(rest[0])], rest[1:]
        while open_ and len(rest):
            at = open_.pop()
            both = shared[at, rest].astype(float)
            near = both >= similarity * (n[at] + n[rest] - both)
            new, rest = rest[near].tolist(), rest[~near]
            open_ += new
            members += new
            sources += [at] * len(new)
    return members, sources


def possible_forest(cells: list[bytes], n: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Places of pairs whose parities allow the similarity, which join whatever of the sets such pairs connect."""
    width = np.array([len(c) for c in cells])
    rows = {w: np.frombuffer(b"".join(c for c in cells if len(c) == w), np.uint8).reshape(-1, w) for w in np.unique(width).tolist()}
    place = np.zeros(len(cells), np.int64)
    for w in rows:
        place[width == w] = np.arange(len(rows[w]))
    rest, members, sources = np.arange(len(cells)), [], []
    while len(rest) > 1:
        open_, rest = [int(rest[0])], rest[1:]
        while open_ and len(rest):
            at = open_.pop()
            most = _most_apart(n[at], n[rest], similarity)
            near = np.zeros(len(rest), bool)
            for w, table in rows.items():
                own = np.flatnonzero((width[rest] == w) & (n[rest] >= similarity * n[at] - 1e-9) & (n[at] >= similarity * n[rest] - 1e-9))
                if len(own):
                    mine, theirs = rows[width[at]][place[at] : place[at] + 1], table[place[rest[own]]]
                    while mine.shape[1] > theirs.shape[1]:
                        mine = _halved(mine)
                    while theirs.shape[1] > mine.shape[1]:
                        theirs = _halved(theirs)
                    near[own] = np.bitwise_count(np.ascontiguousarray(mine ^ theirs).view(np.uint64)).sum(1, dtype=np.int64) <= most[own]
            new, rest = rest[near].tolist(), rest[~near]
            open_ += new
            members += new
            sources += [at] * len(new)
    return members, sources


def _meetings(prefixes: DataFrame, similarity: float) -> DataFrame:
    """a, b, i, j, na, nb, common: nodes that share a shingle of their prefixes, a row for each such shingle.

    Up to COMMON nodes of a shingle give all their pairs that can be similar by
    their sizes. More than these give a chain of links (common) that joins them.
    """
    schema = "a long, b long, i int, j int, na int, nb int, common boolean"
    names = ("shingle", "node", "place", "n")

    def emit(columns: list[np.ndarray], common: bool) -> pa.RecordBatch:
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4
        arrays = [pa.array(c.astype(np.int64), k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(columns[0]), common), pa.bool_())], ["a", "b", "i", "j", "na", "nb", "common"])

    def chains(node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Each row's link to the first row of its chain; a chain ends where the next size is too far off."""
        breaks = np.concatenate(([True], n[:-1] < similarity * n[1:] - 1e-9))
        first = np.flatnonzero(breaks)[np.cumsum(breaks) - 1]
        ends = np.unique(np.stack([node[first], node])[:, ~breaks], axis=1)
        return emit([*ends, *np.zeros((4, ends.shape[1]), np.int64)], True)

    def look(rows: list[np.ndarray], open_shingle: int | None, last: bool) -> tuple[Iterator[pa.RecordBatch], list[np.ndarray], int | None]:
        """Batches to emit, the rows of the unfinished run, and its shingle if it is known to be common."""
        shingle, node, place, n = rows
        starts = np.concatenate(([0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(shingle)))
        common = sizes > COMMON
        common[0] |= open_shingle is not None and shingle[0] == open_shingle
        out = [chains(node[s : s + k], n[s : s + k]) for s, k in zip(starts[common].tolist(), sizes[common].tolist()) if k > 1]
        ended = ~common
        if not last:
            ended[-1] = False
        pairs = (emit(columns, False) for columns in _candidates((node, place, n), starts[ended], sizes[ended], similarity) if len(columns[0]))
        keep = slice(len(shingle), None) if last else slice(len(shingle) - 1, None) if common[-1] else slice(int(starts[-1]), None)
        return chain(out, pairs), [c[keep] for c in rows], int(shingle[-1]) if common[-1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, open_shingle = [], 0, None
        for batch in batches:
            waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            held += batch.num_rows
            if held >= ROWS:
                out, rest, open_shingle = look([np.concatenate(x) for x in zip(*waiting)], open_shingle, False)
                yield from out
                waiting, held = [rest], len(rest[0])
        if held:
            yield from look([np.concatenate(x) for x in zip(*waiting)], open_shingle, True)[0]

    return prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(run, schema)


def _most_frequent(counts: DataFrame) -> np.ndarray:
    """The shingles with the greatest counts, sorted: as many steps of an eighth of a doubling as hold at most FREQUENT of them.

    The driver gets one number for each step and then those shingles, however
    many tasks count.
    """
    counts = counts.withColumn("step", F.floor(F.log2("count") * 8).cast("int"))
    least, held = 1 << 30, 0
    for row in counts.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        held += row["n"]
        if held > FREQUENT:
            break
        least = row["step"]
    return np.sort(counts.where(F.col("step") >= least).select("shingle").toArrow().column("shingle").to_numpy())


def _in_blocks(grouped: DataFrame, weight: Column, most: int) -> DataFrame:
    """grouped (node, group) with x, y: every two nodes of a group meet in some pair of blocks; a block weighs about `most`."""
    blocks = grouped.groupBy("group").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    # written, so that the join has an exchange of its own on each side, which Spark can split at a large group
    dealt = grouped.join(stash(blocks, "similar-blocks"), "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or block != other")
    return dealt.select("node", "group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def _near_nodes(marks: DataFrame, radius: int) -> DataFrame:
    """a, b: links between nodes with equal fingerprints, or ones within the radius; marks are node, fp."""
    first = stash(marks.groupBy("fp").agg(F.min("node").alias("first")), "similar-fingerprints")
    equal = marks.join(first, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp"), radius)
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    return equal.unionByName(near.where("a_node != b_node").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def similar_pairs(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, radius: int = 4) -> DataFrame:
    """a, b: doc_ids of pairs whose sets of shingles are similar (Jaccard), so many that they connect all groups of them.

    Texts whose SimHash fingerprints (as near_duplicates has them) differ in at
    most `radius` bits are candidates, and the exact check follows. Similar
    texts may lie further apart than that; these are found beside them, by what
    their sets share:

    Texts with equal sets are one node. Similar sets share a shingle among the
    first of each in any one order (prefix filter), so every similar pair of
    nodes meets there. Pairs that meet at rare shingles, but for those that are
    too far apart by the number of shingles met and left, are compared by
    their parities, and so are those of nodes that meet at common shingles, in
    groups, block against block. What the parities allow makes families, and
    within a family the whole sets are compared each with each, block against
    block; blocks give a spanning forest of their similar pairs. No similar pair
    is left unconnected, but for collisions of 64-bit hashes, and all pairs
    returned are similar.

    A null doc_id is never in a pair. Rows that repeat a doc_id count as one
    document that has all their texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_distinct(_words(t.as_py()), shingle_words) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else [], pa.int64())], ["shingle"])

    sample = texts.where(f"pmod(xxhash64(doc_id), {SAMPLED}) = 0").mapInArrow(all_shingles, "shingle long")
    frequent = _most_frequent(sample.groupBy("shingle").count().where(f"count >= {LEAST}"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_words(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            sets = [_sorted_set(words, shingle_words) for words in texts]
            first = pa.array([_prefix(s, frequent, similarity) for s, _ in sets], pa.list_(pa.int64()))
            cells = pa.array([parity(s) for s, _ in sets], pa.binary())
            fps = np.fromiter(map(_fingerprint, texts), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([k for _, k in sets], pa.int64()), pa.array([len(s) for s, _ in sets], pa.int32()), cells, first, pa.array(fps)], ["doc_id", "node", "n", "cells", "prefix", "fp"])

    rows = stash(texts.mapInArrow(prefixes, "doc_id long, node long, n int, cells binary, prefix array<long>, fp long"), "similar")
    nodes = stash(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("cells").alias("cells")), "similar-nodes")
    again = rows.join(nodes, "node").where("doc_id != least_id").select(F.col("least_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    single = rows.join(nodes.select("node", F.col("least_id").alias("doc_id")), ["node", "doc_id"], "left_semi")
    # a doc_id that repeats a text would be met with itself, which links nothing
    placed = single.select("node", "n", F.posexplode("prefix").alias("place", "shingle"))
    met = stash(_meetings(placed, similarity), "similar-met")

    # pairs that met at rare shingles
    total = F.col("na") + F.col("nb")
    least = F.ceil(total * (similarity / (1 + similarity)) - 1e-9)
    pairs = met.where("not common and a != b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"))
    pairs = pairs.where(F.col("shared") + F.least(F.col("na") - 1 - F.col("i"), F.col("nb") - 1 - F.col("j")) >= least).select("a", "b", "na", "nb")
    for name in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(name), F.col("cells").alias(f"{name}_cells")), name)

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a_cells", "na", "b_cells", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array([_may_be_similar(*row, similarity) for row in zip(*columns)], pa.bool_()))

    possible = pairs.mapInArrow(allowed, "a long, b long")

    # groups of those that met at common shingles
    def possible_in_blocks(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        members, sources = possible_forest(t.column("cells").to_pylist(), t.column("n").to_numpy(), similarity)
        return pa.table({"a": pa.array(node[members], pa.int64()), "b": pa.array(node[sources], pa.int64())})

    groups = connected_components(met.where("common and a != b").select("a", "b")).withColumnRenamed("root", "group")
    dealt = _in_blocks(groups, F.lit(1), BLOCK_NODES).join(nodes.select("node", "n", "cells"), "node")
    possible = possible.unionByName(dealt.groupBy("group", "x", "y").applyInArrow(possible_in_blocks, "a long, b long"))
    possible = possible.unionByName(_near_nodes(rows.select("node", "fp").distinct(), radius))

    # families of those that may be similar
    families = stash(connected_components(possible).withColumnRenamed("root", "group").join(nodes.select("node", "n", "least_id"), "node"), "similar-families")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [zstandard.ZstdCompressor(level=3).compress(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bodies, pa.binary())], ["doc_id", "body"])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_sorted_set(_words(zstandard.ZstdDecompressor().decompress(t.as_py())), shingle_words) for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in sets], pa.int64()), pa.array([s for s, _ in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    bodies = texts.mapInArrow(packed, "doc_id long, body binary")
    sets = bodies.join(families.select(F.col("least_id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(whole_sets, "node long, shingles array<long>")
    # a doc_id that repeats has other texts besides the node's
    sets = stash(sets.join(families.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "similar-sets")

    def similar_in_blocks(t: pa.Table) -> pa.Table:
        shingles, node = t.column("shingles").combine_chunks(), t.column("node").to_numpy()
        members, sources = similar_forest([s.values.to_numpy() for s in shingles], similarity)
        return pa.table({"a": pa.array(node[members], pa.int64()), "b": pa.array(node[sources], pa.int64())})

    dealt = _in_blocks(families.select("node", "group", "n"), F.col("n"), BLOCK_SHINGLES).join(sets, "node")
    linked = stash(dealt.groupBy("group", "x", "y").applyInArrow(similar_in_blocks, "a long, b long"), "similar-linked")
    named = linked.join(nodes.select(F.col("node").alias("a"), F.col("least_id").alias("a_id")), "a").join(nodes.select(F.col("node").alias("b"), F.col("least_id").alias("b_id")), "b")
    named = named.where("a_id != b_id").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return named.unionByName(again)


def drop_similar_documents(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5) -> DataFrame:
    """The rows of docs but for those that similar_pairs connect with a smaller doc_id, with all their columns."""
    roots = connected_components(similar_pairs(docs, similarity, shingle_words))
    gone = roots.where("node != root").select(F.col("node").alias("_gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
