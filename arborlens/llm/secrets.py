"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of ASCII letters and digits and of all letters beyond ASCII. Every token of a text is tagged as a
secret's begin (B), its inside (I) or outside (O), so a key with dots, slashes or dashes in it is a B and several I.
Features: the token's shape (letter classes, size, hexadecimal, shares of digits, vowels and capitals, changes of
class, the collapsed shape and the token itself), the token before and the one after, the marks between, and traits
of the file (share of digits, length, hint words). All are taken from whole tokens, gaps and texts of any length.

Emissions are sums of array look-ups by distinct token and gap. A bound on what a span can gain over all tags
outside shows where no span can be; what is left between is decoded by Viterbi, which is then the decoding of the
whole chain.

There are no labels, so the field learns from at most ``SAMPLE`` documents (those of the smallest hash of doc_id):
windows of ``WINDOW`` tokens around at most ``EACH`` finds of the base patterns and ``PLAIN`` other places a document,
and a secret made up at random, one a document, planted among its words in one of several frames; ``MOST`` windows in
all. Windows with a secret are also shown with the surroundings of their tokens hidden, and with their shapes hidden,
so that either alone counts and the patterns' own words are not needed. Trained in numpy by gradient steps on the
exact likelihood.

Null and empty texts have no spans. Texts of any length are scanned whole. Repeated rows give equal rows; an
empty table gives an empty result and an untrained field; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, columns_of, restored

SAMPLE, WINDOW, EACH, PLAIN, MOST = 3000, 16, 4, 2, 20_000
WIDTH, EPOCHS = 1 << 15, 25
#: Bytes of texts whose tokens are held at once, but for a longer text.
SCANNED = 1 << 20
O, B, I = 0, 1, 2
KINDS = ["assign", "access", "hex", "crf"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run can't hold a longer one
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What made-up secrets are spelt with, and what stands on either side of them.
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
FRAMES = [(" ", ""), (" ", "."), (' "', '"'), (" (", ")"), (" key ", ""), (" key=", ""), (" id: ", ","), (" bearer ", ""), (" pwd=", ";"), (" login:", ""), (' {"value": "', '"}')]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out, low = [], text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(2), m.end(2), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: Classes of bytes: no part of a token, small letter, capital, digit, beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 4
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VOWEL, _HEXA = np.isin(LOWER, list(b"aeiouy")), (CLASS == 3) | np.isin(np.arange(256), list(b"abcdef"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Features of a token's own, and all: with its neighbours, the gaps, and the file.
OWN, ALL = 10, 18
#: The feature that stands for a hidden one; it weighs nothing.
HIDDEN = WIDTH


def _mix(kind: int, value: np.ndarray) -> np.ndarray:
    """Feature numbers of values of one kind."""
    with np.errstate(over="ignore"):
        x = (np.asarray(value).astype(np.uint64) + np.uint64(kind) * np.uint64(0xD6E8FEB86659FD93)) * _BASE
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(49)).astype(np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def _hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each string of bytes: a polynomial in the byte's place."""
    sizes = np.diff(ends)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, _BASE | np.uint64(1)))
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(ends[:-1], sizes)]
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        return upto[ends[1:]] - upto[ends[:-1]]


def _share(part: np.ndarray, size: np.ndarray) -> np.ndarray:
    return 8 * part // np.maximum(size, 1)


def _own(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(tokens, OWN) feature numbers of tokens, from their bytes one after the other."""
    size, kind = np.diff(ends), CLASS[data]
    small, large, digit, other = (_sums(kind == k, ends) for k in (1, 2, 3, 4))
    first = np.zeros(len(data) + 1, bool)
    first[ends[:-1]] = True
    change = np.concatenate([[True], kind[1:] != kind[:-1]])[: len(data)] | first[:-1]
    kinds = (small > 0) + 2 * (large > 0) + 4 * (digit > 0) + 8 * (other > 0)
    wide = np.minimum(size // 4, 12)
    runs = _sums(change, ends)
    shape = _hashes(kind[change], np.concatenate([[0], np.cumsum(runs)]))
    hexa = _sums(_HEXA[data], ends) == size
    columns = [
        np.zeros(len(size)), kinds, wide * 16 + kinds, shape, hexa * 16 + wide, _share(digit, size) * 16 + wide,
        _share(_sums(_VOWEL[data], ends), size) * 16 + wide, np.minimum(runs, 15) * 16 + wide, _share(large, size) * 16 + np.minimum(runs, 15), _hashes(LOWER[data], ends),
    ]
    return np.stack([_mix(k, np.asarray(c).astype(np.uint64)) for k, c in enumerate(columns)], 1) if len(size) else np.zeros((0, OWN), np.int64)


def _distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings that stand one after the other: each one's number among the distinct ones, and those's bytes and ends."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    values = strings.dictionary
    ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    held = values.buffers()[2]
    return strings.indices.to_numpy(), np.frombuffer(held, np.uint8)[: ends[-1]] if held is not None else np.zeros(0, np.uint8), ends


class Tokens:
    """The tokens of a batch of texts, as arrays."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n, held = len(texts), texts.buffers()[2]
        self.bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        low, high = int(self.bounds[0]), int(self.bounds[-1])
        self.bounds = self.bounds - low
        self.data = np.frombuffer(held, np.uint8)[low:high] if held is not None else np.zeros(0, np.uint8)
        inside = CLASS[self.data] > 0
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.bounds] = True
        self.start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        self.end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        #: Where each text's tokens begin, and the last's end; the text of each.
        self.first = np.searchsorted(self.start, self.bounds)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        count = len(self.start)
        self.token, data, ends = _distinct(self.data[inside], self.end - self.start)
        self.own = _own(data, ends)
        word = _hashes(LOWER[data], ends)
        at = np.arange(count) + self.doc  # each text has a gap more than tokens
        begin, finish = np.empty(count + n, np.int64), np.empty(count + n, np.int64)
        begin[self.first[:-1] + np.arange(n)], finish[self.first[1:] + np.arange(n)] = self.bounds[:-1], self.bounds[1:]
        begin[at + 1], finish[at] = self.end, self.start
        gap, data, ends = _distinct(self.data[~inside], finish - begin)
        marks = _hashes(data, ends)
        self.before, self.after = gap[at], gap[at + 1]
        self.word_features = np.stack([_mix(21, word), _mix(22, word), _mix(23, word)], 1)  # before, after, two before
        self.gap_features = np.stack([_mix(24, marks), _mix(25, marks)], 1)
        self.edge = _mix(26, np.arange(3))
        upto = np.concatenate([[0], np.cumsum(CLASS[self.data] == 3)])
        size = np.diff(self.bounds)
        digits = np.minimum(5, (upto[self.bounds[1:]] - upto[self.bounds[:-1]]) * 50 // np.maximum(size, 1))
        small = pc.ascii_lower(texts)
        hint = np.zeros(n, bool)
        for h in HINTS:
            hint |= pc.match_substring(small, h).to_numpy(zero_copy_only=False)
        self.traits = np.stack([_mix(27, digits), _mix(28, np.log2(np.maximum(size, 1)).astype(np.int64) // 3), _mix(29, hint)], 1)

    def neighbours(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a token has one before it, one after it, and two before it."""
        doc = self.doc[t]
        return t > self.first[doc], t + 1 < self.first[doc + 1], t > self.first[doc] + 1

    def features(self, t: np.ndarray) -> np.ndarray:
        """(tokens, ALL) feature numbers."""
        parts = [self.own[self.token[t]]]
        for k, (has, step) in enumerate(zip(self.neighbours(t), (-1, 1, -2), strict=True)):
            other = self.token[np.where(has, t + step, t)]
            parts.append(np.where(has, self.word_features[other, k], self.edge[k])[:, None])
        parts += [self.gap_features[self.before[t], 0][:, None], self.gap_features[self.after[t], 1][:, None], self.traits[self.doc[t]]]
        return np.concatenate(parts, 1)

    def emissions(self, emit: np.ndarray) -> np.ndarray:
        """(tokens, 3): the sums of the weights of ``features``, looked up by distinct token and gap."""
        emit = emit.astype(np.float32)
        out = emit[self.own].sum(1)[self.token]
        t = np.arange(len(self.token))
        words = emit[self.word_features]
        for k, (has, step) in enumerate(zip(self.neighbours(t), (-1, 1, -2), strict=True)):
            out += np.where(has[:, None], words[:, k][self.token[np.where(has, t + step, t)]], emit[self.edge[k]])
        gaps = emit[self.gap_features]
        out += gaps[:, 0][self.before]
        out += gaps[:, 1][self.after]
        out += emit[self.traits].sum(1)[self.doc]
        return out


class Field:
    """Weights of features by tag, and of tag after tag."""

    def __init__(self) -> None:
        self.emit = np.zeros((WIDTH + 1, 3), np.float64)
        self.move = np.zeros((3, 3), np.float64)
        self.emit[_mix(0, np.zeros(1))[0], O] = 4.0  # untrained, all is outside

    def moves(self) -> np.ndarray:
        out = self.move.copy()
        out[O, I] = -1e9
        return out

    def tags(self, emit: np.ndarray) -> np.ndarray:
        """Viterbi: the best tags of a run between two O, from its emissions."""
        move = self.moves()
        best, back = move[O] + emit[0], np.empty((len(emit), 3), np.int8)
        for k in range(1, len(emit)):
            ways = best[:, None] + move
            back[k] = ways.argmax(axis=0)
            best = ways.max(axis=0) + emit[k]
        out = np.empty(len(emit), np.int64)
        out[-1] = (best + move[:, O]).argmax()
        for k in range(len(emit) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out

    def spans(self, tokens: Tokens) -> list[tuple[int, int]]:
        """(first, last) token of each span that the best tags of the whole chains have.

        Turning a span's tags to O loses at most ``gain_b`` of its first token plus ``gain_i`` of the others; a
        stretch where that is below nought has no span.
        """
        emit, move = tokens.emissions(self.emit), self.moves()
        leave = (move[[B, I]][:, [O, B]] - move[O][[O, B]]).max()
        gain_b = emit[:, B] - emit[:, O] + (move[:, B] - move[:, O]).max() + leave
        gain_i = emit[:, I] - emit[:, O] + max(move[B, I], move[I, I]) - move[O, O]
        out, done = [], len(emit)
        room: dict[int, float] = {}  # what tokens from here on can add to a span
        begins = []
        for t in np.flatnonzero((gain_b >= 0) | (gain_i > 0)).tolist()[::-1]:
            if t >= done:
                continue
            low = int(tokens.first[tokens.doc[t]])
            while t >= low:
                here = room.get(t + 1, 0.0) if t + 1 < tokens.first[tokens.doc[t] + 1] else 0.0
                if gain_b[t] + here >= 0:
                    begins.append(t)
                room[t] = max(0.0, float(gain_i[t]) + here)
                done = t
                if not room[t]:
                    break
                t -= 1
        begins.reverse()
        # a stretch goes to the last end that leaves its span a gain; a begin inside it looks only beyond that end
        upto = np.cumsum(gain_i)
        stretches: list[list[int]] = []
        for t in begins:
            high, least = int(tokens.first[tokens.doc[t] + 1]), float(upto[t] - gain_b[t]) - 1e-6  # a sum's rounding
            joins = bool(stretches) and t <= stretches[-1][1] + 1 and tokens.doc[stretches[-1][0]] == tokens.doc[t]
            e = max(t, stretches[-1][1]) if joins else t
            while e + 1 < high and upto[e + 1] + room.get(e + 2, 0.0) >= least:
                e += 1
            if joins:
                stretches[-1][1] = e
            else:
                stretches.append([t, e])
        for a, b in stretches:
            for t, tag in enumerate(self.tags(emit[a : b + 1].astype(np.float64)).tolist(), a):
                if tag == B:
                    out.append([t, t])
                elif tag == I:
                    out[-1][1] = t
        return [tuple(x) for x in out]

    def fit(self, features: np.ndarray, tags: np.ndarray) -> None:
        """Gradient steps (Adagrad) on the log likelihood of windows: features (windows, tokens, ALL), tags (windows,
        tokens)."""
        if not len(tags):
            return
        sums = [np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)]
        for _ in range(EPOCHS):
            grads = [np.zeros_like(self.emit), np.zeros_like(self.move)]
            for at in range(0, len(tags), 2048):
                self._add(grads, features[at : at + 2048], tags[at : at + 2048])
            for w, g, s in zip((self.emit, self.move), grads, sums, strict=True):
                g = g / tags.size - 1e-6 * w
                s += g * g
                w += 0.3 * g / np.sqrt(s)
            self.emit[HIDDEN] = 0

    def _add(self, grads: list[np.ndarray], f: np.ndarray, t: np.ndarray) -> None:
        n, length, _ = f.shape
        emit, move = self.emit[f].sum(axis=2), self.moves()
        ahead, behind = np.empty((length, n, 3)), np.empty((length, n, 3))
        ahead[0] = move[O] + emit[:, 0]
        for k in range(1, length):
            ahead[k] = _lse(ahead[k - 1][:, :, None] + move, 1) + emit[:, k]
        behind[-1] = move[:, O]
        for k in range(length - 2, -1, -1):
            behind[k] = _lse(move[None] + (emit[:, k + 1] + behind[k + 1])[:, None, :], 2)
        z = _lse(ahead[-1] + move[:, O], 1)
        for k in range(length):
            d = -np.exp(ahead[k] + behind[k] - z[:, None])
            d[np.arange(n), t[:, k]] += 1
            for tag in range(3):
                grads[0][:, tag] += np.bincount(f[:, k].ravel(), np.repeat(d[:, tag], f.shape[2]), WIDTH + 1)
            if k:
                p = np.exp(ahead[k - 1][:, :, None] + move + (emit[:, k] + behind[k])[:, None, :] - z[:, None, None])
                grads[1] -= p.sum(axis=0)
                np.add.at(grads[1], (t[:, k - 1], t[:, k]), 1)
        np.add.at(grads[1], (np.zeros(n, int), t[:, 0]), 1)
        grads[1][O] += -np.exp(ahead[0] + behind[0] - z[:, None]).sum(axis=0)
        np.add.at(grads[1], (t[:, -1], np.zeros(n, int)), 1)
        grads[1][:, O] -= np.exp(ahead[-1] + move[:, O] - z[:, None]).sum(axis=0)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _places(text: str, tokens: Tokens, doc: int) -> np.ndarray | None:
    """How many letters come before each byte of a text; None where bytes are letters."""
    data = tokens.data[tokens.bounds[doc] : tokens.bounds[doc + 1]]
    return None if len(data) == len(text) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def planted(text: str, pick: np.random.Generator) -> tuple[str, tuple[int, int]]:
    """A stretch of a text with a made-up secret in a made-up frame put in at a word's end, and the secret's place."""
    words = text.split()
    at = int(pick.integers(0, len(words)))
    alphabet = ALPHABETS[int(pick.integers(len(ALPHABETS)))]
    value = "".join(alphabet[k] for k in pick.integers(0, len(alphabet), int(pick.integers(16, 49))))
    if pick.random() < 0.25:
        value = "".join(alphabet[k] for k in pick.integers(0, len(alphabet), 3)) + "_-"[int(pick.integers(2))] + value
    elif pick.random() < 0.25:
        cut = int(pick.integers(5, len(value) - 5))
        value = value[:cut] + "._-/"[int(pick.integers(4))] + value[cut:]
    frame, close = FRAMES[int(pick.integers(len(FRAMES)))]
    left = " ".join([*words[max(0, at - WINDOW) : at], frame])
    return f"{left}{value}{close} {' '.join(words[at : at + WINDOW])}", (len(left), len(left) + len(value))


def windows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, features, tags) of windows of texts; tags from the base patterns, and of planted secrets. The key orders
    them the same each time."""
    real = [t for t in texts.to_pylist() if t and not t.isspace()]
    keys = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in real]
    made = [planted(t, np.random.default_rng(k)) for t, k in zip(real, keys, strict=True)]
    yield from _windows(real, keys, [[s[:2] for s in base_spans(t)] for t in real], PLAIN)
    yield from _windows([t for t, _ in made], keys, [[s] for _, s in made], 0)


def _windows(texts: list[str], keys: list[int], spans: list[list[tuple[int, int]]], plain: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    tokens = Tokens(pa.array(texts, pa.string()))
    for doc, (text, key) in enumerate(zip(texts, keys, strict=True)):
        low, high = int(tokens.first[doc]), int(tokens.first[doc + 1])
        if high - low < WINDOW:
            continue
        place, tags = _places(text, tokens, doc), np.zeros(high - low, np.int64)
        shift = tokens.bounds[doc]
        start, end = tokens.start[low:high] - shift, tokens.end[low:high] - shift
        if place is not None:
            start, end = place[start], place[end]
        found = []
        for a, b in spans[doc]:
            i, j = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
            if i < j and not tags[i:j].any():
                tags[i], tags[i + 1 : j] = B, I
                found.append(i)
        pick = np.random.default_rng(key)
        for m in [*pick.permutation(found).tolist()[:EACH], *pick.integers(0, high - low, plain).tolist()]:
            a = int(np.clip(m - int(pick.integers(4, WINDOW - 3)), 0, high - low - WINDOW))
            own = tags[a : a + WINDOW]
            if own[0] == I or a + WINDOW < len(tags) and tags[a + WINDOW] == I:
                continue  # a span that the window would cut
            yield key, tokens.features(np.arange(low + a, low + a + WINDOW)), own


def train(docs: DataFrame, most: int = SAMPLE) -> Field:
    """A field from the base patterns' finds in at most ``most`` documents, the same ones each time."""
    docs = columns_of(docs)
    ids = [r[0] for r in docs.select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(most).collect()]
    field = Field()
    if not ids:
        return field
    sample = docs.filter(F.xxhash64("doc_id") <= F.lit(ids[-1])).select("text").filter("text is not null")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 2048, SCANNED):
            got = list(windows(part.column("text")))
            yield pa.record_batch([pa.array([k for k, _, _ in got], pa.int64()), pa.array([f.astype("<i4").tobytes() for _, f, _ in got], pa.binary()), pa.array([t.astype("i1").tobytes() for _, _, t in got], pa.binary())], ["key", "features", "tags"])

    # rows that repeat an id, or a text, give the same windows
    rows = sample.mapInArrow(run, "key long, features binary, tags binary").distinct().orderBy("key", "tags", "features").limit(MOST).collect()
    if not rows:
        return field
    features = np.frombuffer(b"".join(r[1] for r in rows), "<i4").reshape(len(rows), WINDOW, ALL)
    tags = np.frombuffer(b"".join(r[2] for r in rows), "i1").reshape(len(rows), WINDOW)
    has = tags.any(axis=1)
    shapes, around = features[has], features[has]
    around[:, :, 1:OWN] = HIDDEN
    shapes[:, :, OWN:] = HIDDEN
    field.fit(np.concatenate([features, shapes, around]), np.concatenate([tags, tags[has], tags[has]]))
    return field


def spans_of(texts: pa.Array, field: Field) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text: those of the field that touch no base span are added."""
    tokens, strings = Tokens(texts), texts.to_pylist()
    extra: dict[int, list[tuple[int, int]]] = {}
    for first, last in field.spans(tokens):
        doc = int(tokens.doc[first])
        extra.setdefault(doc, []).append((int(tokens.start[first] - tokens.bounds[doc]), int(tokens.end[last] - tokens.bounds[doc])))
    out = []
    for doc, text in enumerate(strings):
        base = base_spans(text or "")
        more, k = [], 0
        if doc in extra:
            place = _places(text, tokens, doc)
            for a, b in extra[doc]:
                a, b = (a, b) if place is None else (int(place[a]), int(place[b]))
                while k < len(base) and base[k][1] <= a:
                    k += 1
                if not any(s[0] < b and a < s[1] for s in base[max(0, k - 2) : k + 3]):
                    more.append((a, b, "crf"))
        out.append((base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of one text."""
    return spans_of(pa.array([text], pa.string()), field)[0]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    field = field or train(docs)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 2048, SCANNED):
            rows = []
            for base, spans in spans_of(part.column("text"), field):
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(5)]
            yield pa.record_batch([part.column("doc_id"), *columns], names)

    return columns_of(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(docs: DataFrame, mark: str = "[secret]", field: Field | None = None) -> DataFrame:
    """The rows with each secret in their text replaced by ``mark``; other columns as they are, n_chars in step."""
    field = field or train(docs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 2048, SCANNED):
            texts = []
            for text, (_, spans) in zip(part.column("text").to_pylist(), spans_of(part.column("text"), field), strict=True):
                text, out, at = text or "", [], 0
                for a, b, _ in spans:
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                texts.append("".join([*out, text[at:]]))
            yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string()), part.column("rest")], ["doc_id", "text", "rest"])

    rows = carried(docs)
    return restored(rows.mapInArrow(run, rows.schema), docs)
