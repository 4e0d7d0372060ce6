"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into bags of ``BAG`` words one after the other. A word's features are itself and its character n-grams,
hashed into ``BUCKETS`` rows of an embedding, so a misspelling never seen shares most rows with its word; digits and
marks inside a word are part of it. A word is the average over its features, a bag the average over its words, and a
softmax of two classes reads it. A document's score is that of its most toxic bag, so a few telling words do not fade
in a long text. Embedding and softmax are trained together (gradient steps on small batches, through each document's
highest bag) on at most ``MAX_ROWS`` labelled documents, those of the smallest hash of doc_id, whose crc32(doc_id as
text) mod 5 isn't 0. Averages and softmax are linear, so for scoring the two fold into one number a bucket, which is
all that tasks carry.

Null texts count as empty; a text without words gets the score of the bias alone. Whole texts are read.
Labels that are null are left out; of a repeated label row the largest counts. Without labelled rows every
score is 0.5. Repeated rows are scored alike; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, columns_of

BUCKETS, DIM, GRAMS, BAG, MAX_ROWS, EPOCHS, SEED = 1 << 17, 8, (3, 4, 5), 8, 4000, 8, 7
MIN_DOCS, DECAY, RATE, CLASS = 5, 1e-4, 2000.0, 0.5
#: Characters at a word's two ends that are no part of it.
MARKS = ".,;:!?()[]{}\"'`|*_~<>=#&%$-+/\\"
#: Distinct words of a batch whose features are held at once.
WORDS_AT_ONCE = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def spread(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and of their character n-grams: (buckets one after the other, where each word's begin and
    the last's end). A bucket is that of a polynomial in the characters' numbers."""
    feats, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), WORDS_AT_ONCE):
        own = [w.strip(MARKS) or w for w in words[at : at + WORDS_AT_ONCE]]
        codes = np.frombuffer(("<" + "><".join(own) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, own), np.int64, len(own)) + 2
        start = np.concatenate([[0], np.cumsum(size)])
        word = np.repeat(np.arange(len(own)), size)
        place = np.arange(len(codes)) - start[word]
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(max(int(size.max()), *GRAMS) + 1, _BASE))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[place])])
            found = [(np.arange(len(own)), np.zeros(len(own), np.int64), upto[start[1:]] - upto[start[:-1]])]
            for n in GRAMS:
                k = np.flatnonzero((place + n <= size[word]) & (size[word] > n))
                found.append((word[k], place[k], sum((codes[k + i] * powers[i] for i in range(1, n)), codes[k] * powers[0])))
            found = [(w, p, (x ^ (x >> np.uint64(31))) * _BASE >> np.uint64(32)) for w, p, x in found]
        many = [np.bincount(w, minlength=len(own)) for w, _, _ in found]
        ends = np.concatenate([[0], np.cumsum(sum(many))])
        out, before = np.empty(int(ends[-1]), np.int32), ends[:-1].copy()
        for (w, p, x), m in zip(found, many, strict=True):
            out[before[w] + p] = x % np.uint64(BUCKETS)
            before += m
        feats.append(out)
        sizes.append(np.diff(ends))
    return np.concatenate(feats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class Bags:
    """Texts as bags of words: distinct words and their features, and which words stand in which bag of which text."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.string())))
        values = lists.values.dictionary_encode()
        lists = lists.offsets
        # Arrow now and then leaves white space at a text's end on the last word
        words, which = [w.strip() for w in values.dictionary.to_pylist()], values.indices.to_numpy()
        ends = lists.to_numpy().astype(np.int64)
        stand = np.array([bool(w) for w in words], bool)[which] if words else np.zeros(0, bool)  # splitting gives empty words at the ends
        before = np.concatenate([[0], np.cumsum(stand)])
        self.words, self.which, self.ends = words, which[stand], before[ends]
        sizes = np.diff(self.ends)
        #: Bags of each text; one at least, which may be empty.
        self.many = np.maximum(1, -(-sizes // BAG))
        self.first = np.concatenate([[0], np.cumsum(self.many)])
        text = np.repeat(np.arange(len(sizes)), self.many)
        k = np.arange(len(text)) - self.first[:-1][text]
        #: The words of a bag.
        self.start = self.ends[:-1][text] + k * BAG
        self.size = np.minimum(BAG, self.ends[1:][text] - self.start)

    def averages(self, by_word: np.ndarray) -> np.ndarray:
        """The average of each bag, from a number for each distinct word."""
        upto = np.concatenate([[0.0], np.cumsum(by_word[self.which], dtype=np.float64)])
        return (upto[self.start + self.size] - upto[self.start]) / np.maximum(self.size, 1)

    def highest(self, by_word: np.ndarray) -> np.ndarray:
        """The largest average among each text's bags."""
        return np.maximum.reduceat(self.averages(by_word), self.first[:-1]) if len(self.many) else np.zeros(0)


def counted(feats: np.ndarray, ends: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    """For each bucket the sum of a number of the words that have it."""
    out = np.zeros(BUCKETS)
    for at in range(0, len(by_word), WORDS_AT_ONCE):
        to = min(at + WORDS_AT_ONCE, len(by_word))
        out += np.bincount(feats[ends[at] : ends[to]], np.repeat(by_word[at:to], np.diff(ends[at : to + 1])), BUCKETS)
    return out


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): the log odds of a bag are the average weight of its words plus the bias."""
    if not texts or len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(SEED)
    bags, y = Bags(pa.array(texts, pa.string())), np.array(labels, np.int64)
    del texts
    (feats, ends), kinds = spread(bags.words), len(bags.words)
    bags.words = []
    size = np.diff(ends)
    # in how many texts a bucket is found: through the distinct (text, word) pairs
    text = np.repeat(np.arange(len(y)), np.diff(bags.ends))
    pairs = np.unique(text * kinds + bags.which)
    del text
    found = np.bincount(pairs % kinds, minlength=kinds)
    # what few texts hold stays at nought and needs no step; it still counts in the averages
    holds = counted(feats, ends, found)
    seen = holds >= MIN_DOCS
    table = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32) * seen[:, None]
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = ((len(y) / (2.0 * np.bincount(y, minlength=2))) ** CLASS).astype(np.float32)  # the rarer class counts more
    heads = ends[:-1]
    # which bag of a text comes first to be looked at: by how much oftener its features stand in toxic texts
    toxic = counted(feats, ends, np.bincount(pairs[y[pairs // kinds] == 1] % kinds, minlength=kinds))
    clean = holds - toxic
    del pairs
    guide = np.where(seen, np.log((toxic + 1) / (y.sum() + 2)) - np.log((clean + 1) / (len(y) - y.sum() + 2)), 0.0)
    for epoch in range(EPOCHS):
        fade = 1 - epoch / EPOCHS
        # each text's highest bag, as the weights stand at the epoch's start
        by_word = np.add.reduceat((table @ (soft[:, 1] - soft[:, 0]) if epoch else guide)[feats], heads) / size
        level = bags.averages(by_word)
        best = np.maximum.reduceat(level, bags.first[:-1])
        is_best = np.flatnonzero(level == np.repeat(best, bags.many))
        of = np.searchsorted(bags.first, is_best, "right") - 1
        chosen = is_best[np.searchsorted(of, np.arange(len(y)))]  # the first of equals
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            rows = order[lo : lo + 64]
            n = bags.size[chosen[rows]]
            at = np.repeat(bags.start[chosen[rows]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            words, doc = bags.which[at], np.repeat(np.arange(len(rows)), n)
            m = size[words]
            f = feats[np.repeat(heads[words] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())] if len(words) else np.zeros(0, np.int64)
            share = np.repeat(1.0 / (m * n[doc]), m)
            doc = np.repeat(doc, m)
            x = np.stack([np.bincount(doc, share * table[f, k], len(rows)) for k in range(DIM)], 1).astype(np.float32)
            z = x @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p * weight[y[rows]][:, None] / len(rows)
            used, place = np.unique(f, return_inverse=True)
            back = (g @ soft.T)[doc] * share[:, None]
            grad = np.stack([np.bincount(place, back[:, k], len(used)) for k in range(DIM)], 1)
            table[used] -= (RATE * fade * (grad + DECAY / RATE * table[used])).astype(np.float32) * seen[used, None]
            soft -= 0.05 * fade * (x.T @ g)
            bias -= (0.05 * fade * g.sum(0)).astype(np.float32)
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def odds(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The log odds of each text's most toxic bag. A batch's distinct words are weighed once each."""
    bags, by_word = Bags(texts), [np.zeros(0)]
    for at in range(0, len(bags.words), WORDS_AT_ONCE):
        feats, ends = spread(bags.words[at : at + WORDS_AT_ONCE])
        by_word.append(np.add.reduceat(weights[feats], ends[:-1]) / np.diff(ends))
    return bias + bags.highest(np.concatenate(by_word))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> tuple[list[str | None], list[int]]:
    """(texts, whether toxic) of at most ``most`` labelled documents outside the held-out fold, the same ones each time."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(fold(F.col("doc_id")) != 0)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # ids and labels only; of a bounded number
    rows = columns_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return [r[1] for r in rows], [r[2] for r in rows]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    weights, bias = train(*training_rows(docs, labels))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 4096):
            yield pa.record_batch([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds(part.column("text"), weights, bias), -50, 50))))], ["doc_id", "score"])

    scored = columns_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns as they are, whose score is under 0.5."""
    weights, bias = train(*training_rows(docs, labels))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 4096):
            yield part.filter(pa.array(odds(part.column("text"), weights, bias) < 0))

    rows = carried(docs, with_text=True)
    return rows.mapInArrow(run, rows.schema).select("rest.*")
