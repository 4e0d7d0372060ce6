"""Line dedup: a sharded minimal perfect hash over the distinct line hashes indexes compact fingerprint
and count arrays; documents' lines probe the arrays.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; its hash has 128 bits.
Lines found in ``min_docs`` documents (rows) or more go from all of them. The distinct hashes are dealt
into shards of bounded size, each with its own minimal perfect hash. Lines probe the shard that their hash
names. The few hashes that hold over a thousandth of all lines (at most a thousand of them) have a small table of
their own, carried to every task, so that no shard meets a hot line.

A null text is one empty line, as is an empty text. Keys shorter than ``min_chars`` code points stay.
Repeated rows are documents of their own. An empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, carried, columns_of, restored, small_or_shuffled, write_table

BLANK = b" \t\n\x0b\x0c\r"
#: Lines (with repeats) to a shard, on average.
EACH = 300_000
#: One line in so many makes a hash hot.
HOT = 1000


def keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The hash of each line, None where its key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(BLANK).lower()
        n = len(key) if len(key) < min_chars or min_chars <= 1 else len(key.decode("utf-8", "replace"))
        out.append(xxhash.xxh3_128_digest(key) if n >= min_chars else None)
    return out


class PerfectHash:
    """A minimal perfect hash with fingerprints and counts, in a few arrays.

    Level by level, keys that fall on a bit alone own it; the rest go on to the next level. A key's number
    is how many owned bits come before its own.
    """

    WIDE = 2  # bits a key, at each level

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @staticmethod
    def place(hi: np.ndarray, lo: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hi ^ (lo * np.uint64(2 * level + 1))) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(hi))
        numbers = np.empty(len(hi), np.int64)
        given = 0
        while len(left):
            bits = cls.WIDE * len(left) + 1
            at = cls.place(hi[left], lo[left], len(levels), bits)
            own = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(own) - own
            mine = own[at]
            numbers[left[mine]] = given + rank[at[mine]]
            given += int(mine.sum())
            levels.append(own)
            left = left[~mine]
        prints, n = np.empty(len(hi), np.uint64), np.empty(len(hi), np.int64)
        prints[numbers], n[numbers] = lo, counts
        return cls(levels, prints, n)

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The counts of keys; 0 for one that isn't in it."""
        out, left = np.zeros(len(hi), np.int64), np.arange(len(hi))
        for level, own in enumerate(self.levels):
            if not len(left):
                break
            at = self.place(hi[left], lo[left], level, len(own))
            mine = own[at]
            number = self.before[level] + self.ranks[level][at[mine]]
            at_home = self.prints[number] == lo[left[mine]]
            out[left[mine]] = np.where(at_home, self.counts[number], 0)
            left = left[~mine]
        return out

    def dump(self) -> bytes:
        heads = np.array([len(self.levels), *(len(x) for x in self.levels), len(self.prints)], np.int64)
        return b"".join([heads.tobytes(), *(np.packbits(x).tobytes() for x in self.levels), self.prints.tobytes(), self.counts.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n + 1, 8).tolist()
        at, levels = 8 * (n + 2), []
        for bits in sizes[:-1]:
            size = -(-bits // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=bits).astype(bool))
            at += size
        m = sizes[-1]
        return cls(levels, np.frombuffer(data[at : at + 8 * m], np.uint64), np.frombuffer(data[at + 8 * m : at + 16 * m], np.int64))


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _shard(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[:6], "little") % shards


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """digest, n: in how many documents each line hash is found."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            n: dict[bytes, int] = {}
            for text in part.column("text").to_pylist():
                for d in set(keys(text, min_chars)) - {None}:
                    n[d] = n.get(d, 0) + 1
            yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["digest", "n"])

    return docs.select("text").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))


def _build(table: pa.Table) -> pa.Table:
    made = PerfectHash.build(*_halves(table.column("digest").to_pylist()), table.column("n").to_numpy())
    return pa.table({"shard": table.column("shard").slice(0, 1), "arrays": pa.array([made.dump()], pa.binary())})


def index(counts: DataFrame, shards: int) -> DataFrame:
    """shard, arrays: the perfect hashes of a table of counts, one row a shard."""

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            to = [_shard(d, shards) for d in part.column("digest").to_pylist()]
            yield pa.record_batch([part.column("digest"), part.column("n"), pa.array(to, pa.int32())], ["digest", "n", "shard"])

    return counts.mapInArrow(deal, "digest binary, n long, shard int").groupBy("shard").applyInArrow(_build, "shard int, arrays binary")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, each: int = EACH) -> DataFrame:
    """Per document: doc_id, text (lines that stay), n_lines, n_dropped, rest (the row as it was)."""
    whole, docs = carried(docs), columns_of(docs)
    counts = write_table(line_counts(docs, min_chars), "linecounts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    above = max(total // HOT, 1)
    # fewer than HOT rows, as the counts add up to the total
    hot = {bytes(d): n for d, n in counts.filter(F.col("n") > above).collect()} if total > HOT else {}
    often = {d for d, n in hot.items() if n >= min_docs}
    shards = max(1, -(-total // each))
    arrays = index(counts.filter(F.col("n") <= above) if hot else counts, shards)

    def probes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            ids, digests = [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = [d for d in set(keys(text, min_chars)) if d is not None and d not in hot]
                ids += [doc_id] * len(own)
                digests += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([_shard(d, shards) for d in digests], pa.int32())], ["doc_id", "digest", "shard"])

    def probe(lines: pa.Table, arrays: pa.Table) -> pa.Table:
        if not lines.num_rows or not arrays.num_rows:
            return lines.select(["doc_id", "digest"]).slice(0, 0)
        found = PerfectHash.load(arrays.column("arrays")[0].as_py()).count(*_halves(lines.column("digest").to_pylist())) >= min_docs
        return lines.select(["doc_id", "digest"]).filter(pa.array(found))

    routed = docs.mapInArrow(probes, "doc_id long, digest binary, shard int")
    hits = routed.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(probe, "doc_id long, digest binary")
    by_doc = write_table(hits.groupBy("doc_id").agg(F.collect_set("digest").alias("gone")).withColumnRenamed("doc_id", "hit_id"), "hits")
    by_doc = small_or_shuffled(by_doc, by_doc.agg(F.sum(F.size("gone"))).first()[0] or 0)

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            texts, lines, dropped = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                digests, gone = keys(text, min_chars), set(gone or ())
                stay = [k for k, d in enumerate(digests) if d not in gone and d not in often]
                if len(stay) < len(digests):
                    own = (text or "").split("\n")
                    text = "\n".join([own[k] for k in stay])
                texts.append(text or "")
                lines.append(len(digests))
                dropped.append(len(digests) - len(stay))
            yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), part.column("rest")], ["doc_id", "text", "n_lines", "n_dropped", "rest"])

    joined = whole.join(by_doc, whole["doc_id"].eqNullSafe(by_doc["hit_id"]), "left").drop("hit_id")
    return joined.mapInArrow(keep, f"doc_id long, text string, n_lines long, n_dropped long, rest {whole.schema['rest'].dataType.simpleString()}")


def without_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows with repeated lines gone from their text; other columns as they are, n_chars in step."""
    return restored(dedup_lines(docs, min_docs, min_chars), docs)


def line_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs, min_docs, min_chars).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


__all__ = ["PerfectHash", "dedup_lines", "index", "keys", "line_counts", "line_digest", "without_lines"]
