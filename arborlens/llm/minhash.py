"""MinHash near-dedup with sequential Bayesian verification.

1. A document's set is the hashes of its distinct word shingles; documents of equal sets are one class.
2. Classes get ``BANDS * ROWS`` MinHash values; classes that agree in a whole band meet in its bucket.
3. Candidates are the pairs of buckets of up to ``SMALL`` classes; in larger ones, each class with the one that
   has the least of its own, that is the fewest shingles that no other class of large buckets has.
4. A candidate's signatures are compared batch by batch; it goes once the posterior probability that its
   similarity reaches the threshold (uniform prior) falls below ``MISS``.
5. What survives is confirmed on the full sets. Links give components.
6. Larger buckets that still hold several components are taken up again: classes outside a bucket's largest
   component meet those of its classes, in other components, that they can be linked to by their sizes and
   by how many shingles each shares with any other class. Shingles of its own bound a class's similarity
   from above, so no link is lost, and a large bucket's pairs are not made in full.

A pair with similarity s shares no band with probability (1 - s**ROWS)**BANDS: 7e-9 at 0.85.

Null and empty texts have empty sets and are linked with nothing. A text with fewer words than a shingle is
one shingle. Rows that repeat an id are members each; the smallest id of a component names it, null ids
come last. Very long texts are read whole. An empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, columns_of, components, small_or_shuffled, write_table

BANDS, ROWS, STEP, MISS, SMALL, GROUPS = 32, 5, 32, 1e-6, 16, 32
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
#: Words remembered in a worker.
CACHE = 50_000


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array([known[t] for t in tokens], np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    x = ((own * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        y = x[at : at + 512, None] * _A
        y ^= y >> np.uint32(15)
        y += _B
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(low, y.min(axis=0), out=low)
    return low


def needed(threshold: float, step: int = STEP, miss: float = MISS) -> dict[int, int]:
    """After n hashes, the fewest matches with which a pair isn't given up: P(similarity >= threshold | matches)
    is a Beta tail, a binomial sum."""
    t, out = Fraction(threshold).limit_denominator(1000), {}
    for n in range(step, HASHES + 1, step):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * float(t) ** m * float(1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, cls (16 bytes, equal for equal sets; null for an empty one), sig."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in batches(parts):
            n, cls, sig = [], [], []
            for text in part.column("text").to_pylist():
                own = shingle_set(text, words, known)
                n.append(len(own))
                cls.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sig.append(signature(own).tobytes() if len(own) else None)
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "cls", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls binary, sig binary")


def _bands(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches(parts, 4096):
        if not part.num_rows:
            continue
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
        for k in range(ROWS):
            key = (key ^ sig[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        cls = part.column("cls").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
        yield pa.record_batch([pa.array(key.ravel().view(np.int64)), cls], ["bucket", "cls"])


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls, own (the sorted hashes as bytes) of some classes, from the text of the first document of each."""
    ends = write_table(wanted.join(classes.select("cls", "first_id"), "cls"), "ends")
    ids = small_or_shuffled(ends.select("first_id").distinct(), ends.count())

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in batches(parts):
            own = [s.tobytes() for s in (shingle_set(t, words, known) for t in part.column("text").to_pylist())]
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(s) for s in own], pa.binary()), pa.array(own, pa.binary())], ["cls", "own"])

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["first_id"]), "left_semi")
    return write_table(texts.mapInArrow(sets, "cls binary, own binary"), "sets").dropDuplicates(["cls"])


def shared_counts(full: DataFrame) -> DataFrame:
    """cls, n, s, s0, s1, ...: how many shingles a class has, how many of them another class of ``full`` has too, and
    these by a part of their hash."""

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 256):
            own = [np.frombuffer(x, np.int64) for x in part.column("own").to_pylist()]
            key = np.array([int.from_bytes(c[:8], "little", signed=True) for c in part.column("cls").to_pylist()], np.int64)
            if own:
                yield pa.record_batch([pa.array(np.concatenate(own)), pa.array(np.repeat(key, [len(x) for x in own]))], ["g", "key"])

    def key(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            cls = part.column("cls").to_pylist()
            each = np.array([np.bincount((np.frombuffer(x, np.int64) % GROUPS), minlength=GROUPS) for x in part.column("own").to_pylist()], np.int64).reshape(-1, GROUPS)
            yield pa.record_batch([part.column("cls"), pa.array([int.from_bytes(c[:8], "little", signed=True) for c in cls], pa.int64()), *(pa.array(each[:, k].copy()) for k in range(GROUPS))], ["cls", "key", *(f"n{k}" for k in range(GROUPS))])

    one = full.mapInArrow(spell, "g long, key long").groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("key")).filter("k = 1")
    alone = one.groupBy("key").agg(*[F.count_if(F.pmod("g", F.lit(GROUPS)) == k).alias(f"u{k}") for k in range(GROUPS)])
    counted = full.mapInArrow(key, f"cls binary, key long, {', '.join(f'n{k} long' for k in range(GROUPS))}").join(alone, "key", "left")
    total = lambda f: sum((f(k) for k in range(1, GROUPS)), f(0))
    shared = lambda k: F.col(f"n{k}") - F.coalesce(f"u{k}", F.lit(0))
    return write_table(counted.select("cls", total(lambda k: F.col(f"n{k}")).alias("n"), total(shared).alias("s"), *[shared(k).alias(f"s{k}") for k in range(GROUPS)]), "shared")


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) -> links (a, b): 100 * common >= percent * all."""
    least = needed(percent / 100)

    def prune(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 4096):
            if not part.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            left, matches, before = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, m in least.items():
                matches[left] += (x[left, before:n] == y[left, before:n]).sum(axis=1)
                left, before = left[matches[left] >= m], n
            at = pa.array(left)
            yield pa.record_batch([part.column("a").take(at), part.column("b").take(at)], ["a", "b"])

    sigs = classes.select("cls", "sig")
    with_sigs = pairs.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b")), "b")
    survivors = write_table(with_sigs.mapInArrow(prune, "a binary, b binary"), "survivors")
    ends = survivors.select(F.col("a").alias("cls")).unionByName(survivors.select(F.col("b").alias("cls"))).distinct()
    full = full_sets(docs, classes, ends, words)

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 256):
            keep = []
            for x, y in zip(part.column("own_a").to_pylist(), part.column("own_b").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.record_batch([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = survivors.join(full.select(F.col("cls").alias("a"), F.col("own").alias("own_a")), "a").join(full.select(F.col("cls").alias("b"), F.col("own").alias("own_b")), "b")
    return write_table(both.mapInArrow(exact, "a binary, b binary"), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, small: int = SMALL) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, class_links (confirmed links of its class)."""
    docs = columns_of(docs)
    rows = write_table(sets_of(docs, words), "minhash")
    ids = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    classes = write_table(rows.filter("cls is not null").join(ids.withColumnRenamed("cls", "c"), (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("cls", "first_id", "sig").dropDuplicates(["cls"]), "classes")
    bands = classes.select("sig", "cls").mapInArrow(_bands, "bucket long, cls binary")
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = write_table(bands.join(buckets, "bucket"), "members")

    few = members.filter(F.col("n") <= small).select("bucket", "cls")
    pairs = few.select("bucket", F.col("cls").alias("a")).join(few.select("bucket", F.col("cls").alias("b")), "bucket").filter("a < b").select("a", "b")
    large = write_table(members.filter(F.col("n") > small).select("bucket", "cls"), "large")
    if large.isEmpty():
        links = _confirm(write_table(_ordered(pairs), "pairs"), classes, docs, words, percent)
        labels = write_table(components(links), "labels")
    else:
        # large buckets: first with the class that has the fewest shingles of its own, which their members derive from if from any
        counts = shared_counts(full_sets(docs, classes, large.select("cls").distinct(), words))
        held = write_table(large.join(counts, "cls"), "held")
        centres = held.groupBy("bucket").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "cls")).alias("c")).select("bucket", F.col("c.cls").alias("a"))
        stars = held.select("bucket", F.col("cls").alias("b")).join(centres, "bucket").select("a", "b")
        links = _confirm(write_table(_ordered(stars.unionByName(pairs)), "pairs"), classes, docs, words, percent)
        labels = write_table(components(links), "labels")
        # then what lies outside a bucket's largest component with all that it can be linked to. Two classes
        # have at most o = min(s, s') shingles in common, at most the sum of such minima over parts of the hash,
        # and similarity is at most o / (n + n' - o)
        now = write_table(held.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "now")
        main = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("m")).select("bucket", F.col("m.label").alias("main"))
        ends = now.groupBy("bucket").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("s").alias("top"))
        rest = now.join(main, "bucket").filter("label <> main").join(ends, "bucket")
        o = F.least("s", "top")
        t = percent / 100
        # sizes that a partner may have, with room for rounding; what is left is tested exactly below
        low = F.greatest(F.col("lo"), F.ceil(F.col("n") * t - 1e-6)).cast("long")
        high = F.least(F.col("hi"), F.floor(F.col("n") / t + 1e-6), F.floor(o / t - F.col("n") + o + 1e-6)).cast("long")
        asked = rest.withColumn("low", low).withColumn("high", high).filter("low <= high").select("bucket", F.col("cls").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), *[F.col(f"s{k}").alias(f"a{k}") for k in range(GROUPS)], F.explode(F.sequence("low", "high")).alias("n"))
        others = now.select(F.col("bucket").alias("bucket_b"), F.col("n").alias("nb"), F.col("cls").alias("b"), F.col("label").alias("lb"), *[F.col(f"s{k}").alias(f"b{k}") for k in range(GROUPS)])
        common = sum((F.least(f"a{k}", f"b{k}") for k in range(1, GROUPS)), F.least("a0", "b0"))
        possible = (F.col("la") != F.col("lb")) & (100 * common >= percent * (F.col("na") + F.col("nb") - common))
        met = asked.join(others, (F.col("bucket") == F.col("bucket_b")) & (F.col("n") == F.col("nb")) & possible).select("a", "b")
        more = _confirm(write_table(_ordered(met), "pairs"), classes, docs, words, percent)
        links = write_table(links.unionByName(more).distinct(), "links")
        labels = write_table(components(links), "labels")

    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("class_links"))
    named = classes.select("cls", "first_id").join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = write_table(named.join(least, "label").join(degree, "cls", "left").select(F.col("cls").alias("c"), "component_id", F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links")), "of")
    out = rows.select("doc_id", "n_shingles", "cls").join(of, F.col("cls") == F.col("c"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("class_links", F.lit(0).cast("long")).alias("class_links"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns as they are, without those that a smaller id of their component stands for."""
    found = write_table(near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    side = small_or_shuffled(found, found.count())
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["gone"]), "left_anti")
