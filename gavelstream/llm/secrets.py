"""Secrets: fixed patterns, and a randomness test battery with false-discovery control.

Long tokens are tested for what a random key in their encoding would show:
uniform use of the alphabet (chi-squared), as many runs as chance gives, and no
serial correlation. The combined result of a candidate is compared with that of the
corpus's own text, joined and cut to pieces of like length in the candidate's
alphabet, and candidates are accepted so that few of them are expected to be
such text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gavelstream.llm.common import small_batches, stash, text_or_empty

# fixed values: the base patterns and their least lengths
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Access keys and hex strings lie inside these tokens, as do the candidates.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_ENCODINGS = (("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), ("base32", re.compile(r"[A-Z2-7]+"), 32), ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), 64))
_ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Lengths share a stratum from each of these on, and results a bin of a quarter decade.
BANDS, BINS = (16, 20, 24, 32, 48, 80), 32


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for token in _TOKEN.finditer(text):
        s, e = token.span()
        if e - s >= 20:
            found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text, s, e)]
            found += [(2, m.start(), m.end()) for m in _HEX.finditer(text, s, e)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def inferred_encoding(token: str) -> str | None:
    """The narrowest encoding that holds the token, if it mixes character classes as keys do."""
    digits = sum(map(str.isdigit, token))
    letters = sum(map(str.isalpha, token))
    if not letters or not digits and not (any(map(str.isupper, token[1:])) and any(map(str.islower, token))):
        return None
    return next(name for name, pattern, _ in _ENCODINGS if pattern.fullmatch(token))


_INDEX, _HELD = {}, {}
for _name, _letters in _ALPHABETS.items():
    _table = np.full(256, -1, np.int64)
    for _k in range(128):
        _c = chr(_k).lower() if _name == "hex" else chr(_k).upper() if _name == "base32" else {"_": "/", "-": "+"}.get(chr(_k), chr(_k))
        if chr(_k).isalnum() or _name == "base64":
            _table[_k] = _letters.find(_c)
    _INDEX[_name], _HELD[_name] = np.maximum(_table, 0), _table >= 0
_ALNUM = np.array([chr(k).isalnum() and k < 128 for k in range(256)])


def _erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of x >= 0, by the rational Chebyshev fit of relative error 1.2e-7."""
    # fixed values: coefficients of the fit, constant first
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = 1 / (1 + x / 2)
    return t * np.exp(-x * x + np.polynomial.polynomial.polyval(t, fit))


def _tail(z: np.ndarray) -> np.ndarray:
    """P(|Z| >= z) of a normal variable."""
    return _erfc(np.abs(z) / math.sqrt(2))


def battery(tokens: list[str], encoding: str) -> np.ndarray:
    """Combined p-value of each token under the hypothesis that it is random in the encoding."""
    raw = np.frombuffer("".join(tokens).encode("ascii"), np.uint8)
    return _battery(_INDEX[encoding][raw], np.fromiter(map(len, tokens), np.int64, len(tokens)), len(_ALPHABETS[encoding]))


def _battery(x: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """battery() of pieces of n letters each, x their numbers in an alphabet of m.

    Three tests, combined by Fisher's method: chi-squared over four equal parts
    of the alphabet, the number of runs above and below its middle, and the
    correlation of neighbours.
    """
    first = np.cumsum(n) - n
    total = lambda v: np.add.reduceat(v, first)

    parts = np.stack([total((x * 4 // m == k).astype(np.float64)) for k in range(4)])
    chi = ((parts - n / 4) ** 2 / (n / 4)).sum(0)
    uniform = _erfc(np.sqrt(chi / 2)) + np.sqrt(2 * chi / math.pi) * np.exp(-chi / 2)

    high = (x * 2 >= m).astype(np.float64)
    turns = np.append(high[1:] != high[:-1], False).astype(np.float64)
    turns[first + n - 1] = 0
    runs, up = total(turns) + 1, total(high)
    down = n - up
    mean = 2 * up * down / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
    runs_p = np.where((up == 0) | (down == 0), 2.0 ** (1 - n), _tail((runs - mean) / np.sqrt(var)))

    centred = x - np.repeat(total(x.astype(np.float64)) / n, n)
    product = np.append(centred[1:] * centred[:-1], 0.0)
    product[first + n - 1] = 0
    r = total(product) / np.maximum(total(centred**2), 1e-9)
    serial = _tail((r + 1 / n) * np.sqrt(n))

    half = -sum(np.log(np.maximum(p, 1e-12)) for p in (uniform, runs_p, serial))
    return np.exp(-half) * (1 + half + half**2 / 2)


def natural_pieces(texts: list[str], encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters and digits that the encoding holds, as numbers, and the lengths of the pieces that each text is cut into.

    A text's letters are joined and cut to pieces as long as each band's
    shortest token in turn, over and over; its last, shorter piece goes.
    """
    raw = np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    held = np.flatnonzero(_HELD[encoding][raw] & _ALNUM[raw])
    sizes = np.diff(np.searchsorted(held, bounds))
    ends_of = np.cumsum(BANDS)  # of the pieces of a turn
    whole, rest = np.divmod(sizes, int(ends_of[-1]))
    more = np.searchsorted(ends_of, rest, "right")
    pieces = whole * len(BANDS) + more
    used = whole * int(ends_of[-1]) + np.concatenate(([0], ends_of))[more]
    order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _INDEX[encoding][raw[held[place < np.repeat(used, sizes)]]], np.array(BANDS)[order % len(BANDS)]


def _bins(p: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.floor(-4 * np.log10(np.maximum(p, 1e-12)))).astype(int)


def _band(n):
    return np.searchsorted(BANDS, n, "right") - 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its base spans and candidates; per batch, with its first row, the results of the text around them."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans, rest = [base_spans(t) for t in texts], []
        by_encoding: dict[str, list[tuple[int, int, str]]] = {}
        for k, text in enumerate(texts):
            at, around = 0, []
            for m in _TOKEN.finditer(text):
                if encoding := inferred_encoding(m[0]):
                    by_encoding.setdefault(encoding, []).append((k, m.start(), m[0]))
                    around.append(text[at : m.start()])
                    at = m.end()
            rest.append("".join([*around, text[at:]]))
        rows: list[list[dict]] = [[] for _ in texts]
        for encoding, items in by_encoding.items():
            for (k, start, token), b in zip(items, _bins(battery([t for _, _, t in items], encoding))):
                rows[k].append({"start": start, "end": start + len(token), "encoding": encoding, "band": int(_band(len(token))), "bin": int(b)})
        counts: Counter = Counter()
        for encoding, letters in _ALPHABETS.items():
            x, n = natural_pieces(rest, encoding)
            if len(n):
                cells, times = np.unique(_band(n) * BINS + _bins(_battery(x, n, len(letters))), return_counts=True)
                for cell, n_pieces in zip(cells.tolist(), times.tolist()):
                    counts[encoding, cell // BINS, cell % BINS] += n_pieces
        found = [[] for _ in texts]
        if texts:
            found[0] = [{"encoding": e, "band": d, "bin": b, "n": n} for (e, d, b), n in counts.items()]
        ints = [("start", pa.int32()), ("end", pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], pa.list_(pa.struct([("kind", pa.int32()), *ints]))),
                pa.array(rows, pa.list_(pa.struct([*ints, ("encoding", pa.string()), ("band", pa.int32()), ("bin", pa.int32())]))),
                pa.array(found, pa.list_(pa.struct([("encoding", pa.string()), ("band", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))),
            ],
            ["doc_id", "base", "candidates", "natural"],
        )


def accepted(candidates: list[Row], natural: list[Row], rate: float = 0.05, few: int = 100) -> list[tuple[str, int, int]]:
    """The (encoding, band, bin) cells to accept at a false-discovery rate, from counts of candidates and of pieces of text.

    A cell's p-value is the share of pieces that look at least as random in its
    stratum (encoding and length band). Where the stratum has under `few`
    pieces, shorter ones count too, which look random more easily. p-values are
    weighted by length, as longer tokens tell more, with mean weight one, and go
    through the step-up procedure of Benjamini and Hochberg.
    """
    words: Counter = Counter()
    for r in natural:
        words[r["encoding"], r["band"], r["bin"]] += r["n"]

    def p_value(encoding: str, band: int, b: int) -> float:
        for least in range(band, -1, -1):
            own = {k: n for k, n in words.items() if k[0] == encoding and least <= k[1] <= band}
            if sum(own.values()) >= few:
                break
        return (1 + sum(n for k, n in own.items() if k[2] <= b)) / (1 + sum(own.values()))

    cells = [(r["encoding"], r["band"], r["bin"], r["n"]) for r in candidates]
    total = sum(n for *_, n in cells)
    if not total:
        return []
    mean = sum((1 + band) * n for _, band, _, n in cells) / total
    scored = sorted((p_value(e, d, b) * mean / (1 + d), e, d, b, n) for e, d, b, n in cells)
    seen, last = 0, -1
    for k, (p, *_, n) in enumerate(scored):
        seen += n
        if p <= rate * seen / total:
            last = k
    return [(e, d, b) for _, e, d, b, _ in scored[: last + 1]]


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, spans (array of kind, start, end; code points, end exclusive) for each row of docs.

    kind is a name of KINDS: the fixed patterns, all kept, and "random" for
    tokens that the test battery accepts and no fixed span overlaps. Spans are
    ordered by start, then kind. The counts that set the acceptance cover all
    rows; their table has a fixed size (encodings, bands, bins), and only that
    reaches the driver.

    Null and empty texts have no spans; rows that repeat a doc_id give a row
    each and count each; a null doc_id stays null; extra columns are ignored; an
    empty table gives an empty one, and one without other text accepts none.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cell = "encoding string, band int, bin int"
    scanned = texts.mapInArrow(
        _scan,
        "doc_id long, base array<struct<kind:int,start:int,end:int>>, candidates array<struct<start:int,end:int,encoding:string,band:int,bin:int>>, natural array<struct<encoding:string,band:int,bin:int,n:long>>",
    )
    scanned = stash(scanned, "secrets")
    keys = [c.split()[0] for c in cell.split(", ")]
    natural = scanned.select(F.inline("natural")).groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    candidates = scanned.select(F.inline("candidates")).groupBy(*keys).agg(F.count("*").alias("n")).collect()
    good = F.array(*[F.lit(f"{e}/{d}/{b}") for e, d, b in accepted(candidates, natural, rate)]).cast("array<string>")

    def is_new(c: Column) -> Column:
        cell_name = F.concat_ws("/", c["encoding"], c["band"].cast("string"), c["bin"].cast("string"))
        overlaps = F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return F.array_contains(good, cell_name) & ~overlaps

    random = F.transform(F.filter("candidates", is_new), lambda c: _span(F.lit(KINDS.index("random")), c))
    both = F.array_sort(F.concat(F.transform("base", lambda s: _span(s["kind"], s)), random))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(both, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.select("doc_id", named.alias("spans"))


def _span(kind: Column, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), kind.cast("int").alias("kind"), s["end"].alias("end"))
