"""Personal data: fixed patterns, and a character-level BiLSTM-CRF trained in numpy.

The tagger learns from labelled spans, which are the fixed patterns' finds in a
bounded sample of windows and written variants that the patterns miss. Texts
are read in overlapping windows around what every kind must hold; each
character takes its label from the window in whose middle it lies, and the
spans of all windows of a document are put together and reconciled with the
fixed ones, which all stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.llm.common import least_hashed, small_batches, stash, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns; possessive where backing off could not match either
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each @, so that long runs without one cost nothing."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# ---- the tagger ----

#: Window length and how far windows start apart; the halo on each side is read but not labelled.
WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 16, 12
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Character classes: padding, letters by case, each digit's class, the marks that matter, spaces, the rest.
_MARKS = "@.-+()_% :/,;\n[]#="
CLASSES = 2 + 26 + 1 + 1 + len(_MARKS) + 1


def _classes(text: str) -> np.ndarray:
    """Small letters apart, capitals as one, digits as one, marks apart, other letters and signs as one each."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _CLASS_OF[np.minimum(points, 128)]


_CLASS_OF = np.full(129, 1, np.int64)
_CLASS_OF[128] = CLASSES - 1
for _k in range(128):
    _c = chr(_k)
    if _c.islower():
        _CLASS_OF[_k] = 2 + _k - 97
    elif _c.isupper():
        _CLASS_OF[_k] = 28
    elif _c.isdigit():
        _CLASS_OF[_k] = 29
    elif _c in _MARKS:
        _CLASS_OF[_k] = 30 + _MARKS.index(_c)


@dataclass
class Tagger:
    """Parameters: per direction an input table (class by 4 gates), recurrent weights and bias; output; transitions."""

    p: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.p, x)[0]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi paths of a batch of windows (rows of classes)."""
        scores, move = self.emissions(x), self.p["move"]
        best, back = scores[:, 0], []
        for t in range(1, x.shape[1]):
            options = best[:, :, None] + move[None]
            back.append(options.argmax(1))
            best = options.max(1) + scores[:, t]
        path = [best.argmax(1)]
        for pointer in reversed(back):
            path.append(pointer[np.arange(len(x)), path[-1]])
        return np.stack(path[::-1], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(p: dict, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction over windows x, and what the backward pass needs."""
    table = p[f"in_{side}"]
    n, length = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, memory = np.empty((n, length, HIDDEN), np.float32), []
    for t in range(length) if side == "f" else range(length - 1, -1, -1):
        z = table[x[:, t]] + h @ p[f"rec_{side}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        tanh_c = np.tanh(c)
        h = o * tanh_c
        out[:, t] = h
        memory.append((t, i, f, o, g, before, h_before, tanh_c))
    return out, memory


def _forward(p: dict, x: np.ndarray) -> tuple:
    left, left_memory = _lstm(p, "f", x)
    right, right_memory = _lstm(p, "b", x)
    both = np.concatenate([left, right], 2)
    return both @ p["out"] + p["bias"], both, left_memory, right_memory


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _crf_gradient(scores: np.ndarray, move: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the labels, and its gradients by scores and transitions."""
    n, length, k = scores.shape
    ahead, behind = [scores[:, 0]], [np.zeros((n, k))]
    for t in range(1, length):
        ahead.append(_log_sum(ahead[-1][:, :, None] + move[None], 1) + scores[:, t])
    for t in range(length - 1, 0, -1):
        behind.append(_log_sum(move[None] + (scores[:, t] + behind[-1])[:, None, :], 2))
    behind = behind[::-1]
    norm = _log_sum(ahead[-1], 1)
    rows = np.arange(n)
    gold = scores[rows[:, None], np.arange(length), y].sum(1) + move[y[:, :-1], y[:, 1:]].sum(1)
    by_scores = np.stack([np.exp(a + b - norm[:, None]) for a, b in zip(ahead, behind)], 1)
    by_scores[rows[:, None], np.arange(length), y] -= 1
    by_move = np.zeros_like(move)
    for t in range(1, length):
        pair = ahead[t - 1][:, :, None] + move[None] + (scores[:, t] + behind[t])[:, None, :] - norm[:, None, None]
        by_move += np.exp(pair).sum(0)
    np.add.at(by_move, (y[:, :-1], y[:, 1:]), -1)
    return float((norm - gold).mean()), (by_scores / n).astype(np.float32), (by_move / n).astype(np.float32)


def _lstm_gradient(p: dict, side: str, x: np.ndarray, memory: list, by_out: np.ndarray, grad: dict) -> None:
    n = len(x)
    by_h, by_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    rec, by_rec, by_in = p[f"rec_{side}"], np.zeros_like(p[f"rec_{side}"]), np.zeros_like(p[f"in_{side}"])
    for t, i, f, o, g, before, h_before, tanh_c in reversed(memory):
        by_h = by_h + by_out[:, t]
        by_c = by_c + by_h * o * (1 - tanh_c**2)
        z = np.concatenate([by_c * g * i * (1 - i), by_c * before * f * (1 - f), by_h * tanh_c * o * (1 - o), by_c * i * (1 - g**2)], 1)
        by_rec += h_before.T @ z
        np.add.at(by_in, x[:, t], z)
        by_h, by_c = z @ rec.T, by_c * f
    grad[f"rec_{side}"], grad[f"in_{side}"] = by_rec, by_in


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], passes: int = 14, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Fit a tagger to windows (text, spans of (kind, start, end)) with Adam; deterministic."""
    rng = np.random.default_rng(seed)
    p = {"out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
    for side in "fb":
        p[f"in_{side}"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
        p[f"in_{side}"][:, HIDDEN : 2 * HIDDEN] += 1
        p[f"rec_{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["bias"][0] = 1
    if not windows:
        return Tagger(p)
    x = np.zeros((len(windows), WINDOW), np.int64)
    y = np.zeros((len(windows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(windows):
        text = text[:WINDOW]
        x[k, : len(text)] = _classes(text)
        for kind, s, e in spans:
            y[k, max(s, 0) : min(e, WINDOW)] = 2 + 2 * kind
            if 0 <= s < WINDOW:
                y[k, s] = 1 + 2 * kind
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for turn in range(passes):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at : at + batch]
            scores, both, left, right = _forward(p, x[own])
            _, by_scores, by_move = _crf_gradient(scores, p["move"], y[own])
            grad = {"move": by_move, "bias": by_scores.sum((0, 1)), "out": np.tensordot(both, by_scores, ((0, 1), (0, 1)))}
            by_both = by_scores @ p["out"].T
            _lstm_gradient(p, "f", x[own], left, by_both[:, :, :HIDDEN], grad)
            _lstm_gradient(p, "b", x[own], right, by_both[:, :, HIDDEN:], grad)
            step += 1
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                fit = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = (p[k] - rate * (1 - turn / passes) * fit).astype(np.float32)
    return Tagger(p)


def written_variants(n: int, seed: int = 9) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows around written examples: each kind as people also write it, and numbers that are no personal data."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(rng.choice(letters, rng.integers(low, high)))

    def number(k: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def one_of(*options: str) -> str:
        return options[rng.integers(len(options))]

    def card() -> str:
        body = number(15)
        last = next(str(d) for d in range(10) if _luhn(body + str(d)))
        return one_of(" ", "-", ".", "").join((body + last)[k : k + 4] for k in range(0, 16, 4))

    def datum(kind: int) -> str:
        if kind == 0:
            return word() + one_of("", ".", "_") + word() + one_of("@", "@", " (at) ", "[at]", " at ") + word() + one_of(".", ".", " dot ", "[dot]") + one_of("com", "org", "net", "example")
        if kind == 1:
            return one_of(".", ".", " . ").join(str(v) for v in rng.integers(0, 256, 4))
        if kind == 2:
            return card()
        return one_of(f"+{number(2)} {number(3)} {number(3)} {number(4)}", f"+1 ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"00{number(2)} {number(3)} {number(6)}", f"+{number(11)}")

    def other() -> str:
        return one_of(number(int(rng.integers(1, 7))), f"{number(1)}.{number(2)}", f"20{number(2)}-0{rng.integers(1, 10)}-1{number(1)}", f"v{number(1)}.{number(1)}.{number(2)}", f"{number(2)}:{number(2)}", f"20{number(2)}-0{rng.integers(1, 10)}-1{number(1)} 1{number(1)}:{number(2)}:{number(2)}", number(int(rng.integers(8, 15))), f"{number(3)} {number(3)} {number(3)}", f"{word()} at {word()} {word()}", f"{word()}{number(2)}", f"({number(1)})", "@" + word(), f"{number(3)}-{number(2)}", f"${number(2)}.{number(2)}", f"+{number(1)}")

    out = []
    for k in range(n):
        kind = k % 8
        text = datum(kind) if kind < 4 else other()
        before = " ".join(word() for _ in range(rng.integers(0, 7)))[-30:] + " "
        after = one_of(" ", ". ", ", ") + " ".join(word() for _ in range(8))
        whole = (before + text + after)[:WINDOW]
        out.append((whole, [(kind, len(before), min(len(before) + len(text), WINDOW))] if kind < 4 else []))
    return out


def _regions(text: str) -> list[tuple[int, int]]:
    """Where the tagger reads: a window's reach around every digit, @ and spelled-out at.

    Every kind that it labels holds one of these, so the rest of a text is
    outside by definition of the kinds.
    """
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_TRIGGER = re.compile(r"[0-9@]+|(?<=[\[( ])at(?=[\]) ])")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t)] for t in texts]
        parts = [[{"start": s, "text": t[s:e]} for s, e in _regions(t)] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(spans, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(parts, pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))),
            ],
            ["doc_id", "base", "regions"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of which all characters are labelled, with the fixed spans in them and a pseudorandom place.

    What the fixed patterns do not find may still be personal data: windows
    that hold enough for that beside the fixed spans have no certain label.
    """
    for batch in batches:
        out = []
        for doc_id, base, regions in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "regions"))):
            for region in regions:
                for at, text in windows_of(region["start"], region["text"]):
                    spans = [{"kind": b["kind"], "start": b["start"] - at, "end": b["end"] - at} for b in base if b["start"] < at + len(text) and b["end"] > at]
                    if not _may_hold_more(text, spans):
                        out.append({"place": xxhash.xxh64_intdigest(f"{doc_id} {at}") >> 1, "text": text, "spans": spans})
        yield pa.RecordBatch.from_pylist(out, _WINDOWS)


def _may_hold_more(text: str, spans: list[dict]) -> bool:
    rest = list(text)
    for span in spans:
        rest[max(0, span["start"]) : span["end"]] = " " * (min(len(text), span["end"]) - max(0, span["start"]))
    rest = "".join(rest)
    return len(_DIGIT.findall(rest)) >= 8 or bool(_AT.search(rest)) or len(_DOTTED.findall(rest)) >= 3


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_WINDOWS = pa.schema([("place", pa.int64()), ("text", pa.string()), ("spans", pa.list_(_SPAN))])


def labelled_windows(scanned: DataFrame, max_windows: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most max_windows windows of all documents, by a hash of their place, labelled by the fixed spans."""
    rows = scanned.mapInArrow(_windows, "place long, text string, spans array<struct<kind:int,start:int,end:int>>")
    # a region gives a window or more; a part of them has certain labels
    regions = scanned.agg(F.sum(F.size("regions"))).first()[0] or 0
    rows = least_hashed(rows, F.col("place"), max_windows, regions / 8).collect()
    return [(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows]


def windows_of(start: int, text: str) -> list[tuple[int, str]]:
    """Overlapping windows of a region: position and text."""
    last = max(0, len(text) - WINDOW)
    places = [*range(0, last, STRIDE), last]
    return [(start + k, text[k : k + WINDOW]) for k in places]


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the runs that a row of tags describes."""
    out: list[list[int]] = []
    for t in np.flatnonzero(labels).tolist():
        kind, begins = (labels[t] - 1) // 2, labels[t] % 2 == 1
        if out and out[-1][2] == t and out[-1][0] == kind and not begins:
            out[-1][2] = t + 1
        else:
            out.append([int(kind), t, t + 1])
    return [tuple(s) for s in out]


_AT, _NUMBERS, _DOTTED = re.compile(r"@|\bat\b", re.ASCII), re.compile(r"[0-9]+"), re.compile(r"[0-9] ?\.(?= ?[0-9])")


def _is_kind(kind: str, span: str) -> bool:
    """Whether a span of the tagger can be what it is called: an address has an at and a dot, an IP four parts, a card and a phone number as many digits as theirs have."""
    numbers = _NUMBERS.findall(span)
    digits = "".join(numbers)
    if kind == "email":
        return len(span) >= 7 and bool(_AT.search(span)) and ("." in span or "dot" in span)
    if any(map(str.isalpha, span)):
        return False
    if kind == "ip":
        return len(numbers) == 4 and all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return 8 <= len(digits) <= 15


#: The words of an address: one before its at, one after it, and those that dots join on.
_ADDRESS = re.compile(r"\S+(?: ?@ ?| ?[\[(]at[\])] ?| at )\S+(?: ?[\[(]dot[\])] ?\S+| dot \S+)*")
#: What people put around a datum, which is no part of it.
_AROUND = " \t\n,;:/"


def tag_document(tagger: Tagger, regions: list[tuple[int, str]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The tagger's spans of a document: each character labelled by the window it is most inside, then spans joined, checked, and dropped where a fixed one overlaps."""
    found = []
    for start, text in regions:
        windows = windows_of(start, text)
        x = np.zeros((len(windows), WINDOW), np.int64)
        for k, (_, part) in enumerate(windows):
            x[k, : len(part)] = _classes(part)
        found += _reconciled(tagger.decode(x), windows, start, text, base)
    return found


def _reconciled(paths: np.ndarray, windows: list[tuple[int, str]], start: int, text: str, base: list) -> list[tuple[int, int, int]]:
    labels, depth = np.zeros(len(text), np.int64), np.full(len(text), -1)
    for path, (at, part) in zip(paths, windows):
        n, k = len(part), at - start
        inside = np.minimum(np.arange(n) if k else np.full(n, WINDOW), np.arange(n)[::-1] if k + n < len(text) else np.full(n, WINDOW))
        better = inside > depth[k : k + n]
        labels[k : k + n][better] = path[:n][better]
        depth[k : k + n][better] = inside[better]
    out = []
    for kind, s, e in spans_of(labels):
        span = text[s:e].rstrip(_AROUND)
        e, span = s + len(span), span.lstrip(_AROUND)
        s = e - len(span)
        if KINDS[kind] == "email" and (core := _ADDRESS.search(span)):
            s, e, span = s + core.start(), s + core.end(), core[0]
        part_of_word = s > 0 and text[s - 1].isalnum() or e < len(text) and text[e].isalnum()
        if _is_kind(KINDS[kind], span) and not part_of_word and not any(b < start + e and start + s < f for _, b, f in base):
            out.append((kind, start + s, start + e))
    return out


def _tagging(tagger: Tagger, block: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("base").to_pylist(), batch.column("regions").to_pylist()))
            jobs = [(k, r["start"], r["text"], windows_of(r["start"], r["text"])) for k, (_, regions) in enumerate(rows) for r in regions]
            parts = [part for *_, windows in jobs for _, part in windows]
            paths = []
            for k in range(0, len(parts), block):
                x = np.zeros((min(block, len(parts) - k), WINDOW), np.int64)
                for j, part in enumerate(parts[k : k + block]):
                    x[j, : len(part)] = _classes(part)
                paths.append(tagger.decode(x))
            paths = np.concatenate(paths) if paths else None
            spans = [[(b["kind"], b["start"], b["end"], False) for b in base] for base, _ in rows]
            at = 0
            for k, start, text, windows in jobs:
                base = [s[:3] for s in spans[k] if not s[3]]
                spans[k] += [(*s, True) for s in _reconciled(paths[at : at + len(windows)], windows, start, text, base)]
                at += len(windows)
            out = [[{"kind": KINDS[k], "start": s, "end": e, "learned": m} for k, s, e, m in sorted(own)] for own in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("learned", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return run


def find_personal_data(docs: DataFrame, max_windows: int = 1500, variants: int = 1600) -> DataFrame:
    """doc_id, spans (array of kind, start, end, learned; code points, end exclusive) for each row of docs.

    learned tells the tagger's spans from the fixed patterns'. Spans are ordered
    by kind as in KINDS, then start. The tagger is trained on at most max_windows
    windows, taken from all documents by a hash of their place, and on `variants`
    written ones, which bound what reaches the driver; finding covers every row.

    Null and empty texts have no spans; rows that repeat a doc_id give a row
    each; a null doc_id stays null; extra columns are ignored; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scanned = stash(texts.mapInArrow(_scan, "doc_id long, base array<struct<kind:int,start:int,end:int>>, regions array<struct<start:int,text:string>>"), "pii")
    tagger = train(labelled_windows(scanned, max_windows) + written_variants(variants))
    # a region is short, but takes long to read: its file's few splits are dealt out again
    dealt = scanned.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(_tagging(tagger), "doc_id long, spans array<struct<kind:string,start:int,end:int,learned:boolean>>")
