"""Byte-level BPE over a global shuffle of distinct pre-tokens.

Documents become chunks: the chunk's distinct pre-tokens, and per document the
positions of its pre-tokens in that list. The distinct pre-tokens are packed
by a hash of the word and shuffled, so that each distinct word of the corpus is
encoded once; the ids return to their chunk, where the documents are put
together again by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import fixed_splits, from_files, small_batches, text_or_empty

#: Characters of text in a chunk; a longer document is a chunk of its own.
CHUNK_CHARS = 6_000_000
#: Pre-tokens put together at once.
BLOCK = 400_000


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """The token-rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _word_encoder(path: str) -> tiktoken.Encoding:
    """Encodes a string as one pre-token."""
    return tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte plane, which compress better than whole ones."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _zip(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_entries(codes: np.ndarray, lengths: np.ndarray, body: bytes) -> bytes:
    """Entries of a chunk's word list: ascending codes, lengths, and the words or their ids."""
    return _zip(np.uint32(len(codes)).tobytes(), _planes(np.diff(codes, prepend=0)), _planes(lengths), body)


def _unpack_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = _unzip(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.cumsum(_from_planes(raw[4 : 4 + 4 * n])), _from_planes(raw[4 + 4 * n : 4 + 8 * n]), raw[4 + 8 * n :]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each entry, one entry after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _chunks(pattern: str, n_buckets: int, doc_rows: bool):
    """Per chunk either its documents (positions) or its words by bucket.

    Both come from the same scan in the same order, so a chunk's numbers agree;
    they depend on nothing but the rows read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = regex.compile(pattern).findall
        at, made = 0, 0
        words = _Codes()
        ids, codes, chars = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal words, ids, codes, chars, made
            chunk = (at << 32) + made
            if doc_rows and ids:
                n = len(ids)
                for k in range(0, n, 1000):
                    part = slice(k, min(k + 1000, n))
                    size = part.stop - part.start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * size, pa.int64()), pa.array([-1] * size, pa.int32()), pa.array(ids[part], pa.int64()), pa.array(codes[part], pa.binary())],
                        ["chunk", "bucket", "doc_id", "packed"],
                    )
            elif words:
                by_bucket: dict[int, list[tuple[int, bytes]]] = {}
                for code, word in enumerate(words):
                    raw = word.encode()
                    by_bucket.setdefault(xxhash.xxh32_intdigest(raw) % n_buckets, []).append((code, raw))
                keys, packed = sorted(by_bucket), []
                for key in keys:
                    numbers, raws = zip(*by_bucket[key])
                    packed.append(_pack_entries(np.array(numbers), np.fromiter(map(len, raws), np.int64, len(raws)), b"".join(raws)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(keys), pa.int64()), pa.array(keys, pa.int32()), pa.nulls(len(keys), pa.int64()), pa.array(packed, pa.binary())],
                    ["chunk", "bucket", "doc_id", "packed"],
                )
            words, ids, codes, chars, made = _Codes(), [], [], 0, made + 1

        for batch in batches:
            at = batch.column("at")[0].as_py() if batch.num_rows else at
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if chars and chars + len(text) > CHUNK_CHARS:
                    yield from flush()
                found = np.fromiter(map(words.__getitem__, pieces(text)), np.uint32)
                chars += len(text)
                ids.append(doc_id)
                if doc_rows:
                    codes.append(_zip(_planes(found)))
        if ids:
            yield from flush()

    return run


def _encode_buckets(path: str):
    """Encode each distinct word of a bucket once; a bucket's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_encoder(path).encode_ordinary
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            packed = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if bucket != last:
                    known, last = {}, bucket
                codes, lengths, body = _unpack_entries(data)
                ends = np.cumsum(lengths).tolist()
                flat, sizes = [], []
                for s, e in zip([0, *ends], ends):
                    word = body[s:e]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word.decode())
                    flat += ids
                    sizes.append(len(ids))
                packed.append(_pack_entries(codes, np.array(sizes), _planes(np.array(flat, np.uint32))))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), batch.column("doc_id"), pa.array(packed, pa.binary())], ["chunk", "bucket", "doc_id", "packed"])

    return run


def _chunk_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each code's ids, and all ids."""
    if not entries:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    codes, lengths, bodies = zip(*map(_unpack_entries, entries))
    codes, lengths = np.concatenate(codes), np.concatenate(lengths)
    flat = np.concatenate([_from_planes(body) for body in bodies]).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    by_code = np.argsort(codes)
    return starts[by_code], lengths[by_code], flat


def _id_rows(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], ["doc_id", "ids"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk in order (its words' ids, then its documents) to documents with ids."""
    last, entries, table = None, [], None
    for batch in batches:
        docs, ids, held = [], [], 0
        for chunk, bucket, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "doc_id", "packed"))):
            if chunk != last:
                last, entries, table = chunk, [], None
            if bucket >= 0:
                entries.append(data)
                continue
            if table is None:
                table, entries = _chunk_table(entries), []
            starts, lengths, flat = table
            codes = _from_planes(_unzip(data))
            parts = [flat[_spread(starts[c], lengths[c])] for c in (codes[k : k + BLOCK] for k in range(0, len(codes), BLOCK))]
            docs.append(doc_id)
            ids.append(np.concatenate(parts) if parts else flat[:0])
            held += len(ids[-1])
            if held > 2_000_000:
                yield _id_rows(docs, ids)
                docs, ids, held = [], [], 0
        if docs:
            yield _id_rows(docs, ids)


def encode(docs: DataFrame, path: str, pattern: str, n_buckets: int | None = None) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs.

    path names the token-rank file, which executors must see under that path;
    pattern splits a text into pre-tokens, and each is encoded by itself, as
    tiktoken's encode_ordinary does. n_buckets spreads the distinct words;
    unset, it is the session's number of shuffle partitions, or two for each
    split of the input.

    Null and empty texts have no ids. Rows that repeat a doc_id give a row each,
    a null doc_id stays null, extra columns are ignored, an empty table gives an
    empty one. A word that is frequent everywhere crosses the shuffle once per
    chunk, not once per use. A chunk holds a bounded number of characters, or
    one document. docs is read twice and must give the same rows in the same
    order each time, as files do; what comes from elsewhere is written first, and
    what joins or groups rows of files is the caller's to write.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fixed_splits(spark)
    schema = "chunk long, bucket int, doc_id long, packed binary"
    texts = from_files(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))).withColumn("at", F.spark_partition_id())
    n_buckets = n_buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * texts.rdd.getNumPartitions())
    words = texts.mapInArrow(_chunks(pattern, n_buckets, False), schema)
    positions = texts.mapInArrow(_chunks(pattern, n_buckets, True), schema)
    known = words.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_buckets(path), schema)
    together = known.unionByName(positions).repartition("chunk").sortWithinPartitions("chunk", F.col("bucket") < 0)
    return together.mapInArrow(_assemble, "doc_id long, ids array<int>")


@lru_cache(maxsize=2)
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ranks = read_ranks(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    tokens = [b""] * len(lengths)
    for token, rank in ranks.items():
        tokens[rank], lengths[rank] = token, len(token)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(tokens), np.uint8)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with its bytes: doc_id, ids, body binary.

    The token-byte table has one row per id of the vocabulary, so its size is
    fixed: each task reads it once, and ids join it by a lookup where they are.
    A null array decodes to no bytes; an id that the vocabulary does not have,
    or a null in an array, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths, flat = _byte_table(path)
        for batch in batches:
            bodies = []
            for doc_id, ids in zip(batch.column("doc_id"), batch.column("ids")):
                if ids.is_valid and ids.values.null_count:
                    raise ValueError(f"null among the ids of document {doc_id}")
                numbers = ids.values.to_numpy() if ids.is_valid else np.empty(0, np.int32)
                known = (numbers >= 0) & (numbers < len(lengths))
                if not known.all() or not lengths[numbers].all():
                    raise ValueError(f"document {doc_id} has ids that the vocabulary does not have")
                blocks = (numbers[k : k + BLOCK] for k in range(0, len(numbers), BLOCK))
                bodies.append(b"".join(flat[_spread(starts[x], lengths[x])].tobytes() for x in blocks))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(bodies, pa.binary())], ["doc_id", "ids", "body"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, body binary")
