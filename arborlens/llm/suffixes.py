"""Suffix-array dedup: bytes of 100-byte strings that start earlier elsewhere are removed.

Every ``length``-byte string names an anchor in itself: its first ``GRAM``-byte piece with the least hash.
Equal strings have equal anchors, so a run of strings with one anchor, kept as the bytes it spans, need only
meet the runs of equal anchors. Runs whose anchor is found once repeat nothing. Equal runs (by a 64-bit hash each of
the anchor and of all bytes) are one, kept by their first place. Runs with one anchor that hold an equal string agree
on three quarters of its other bytes around the anchor, in one of ``KEYS`` ways to share them out before and after it;
a run that agrees with none repeats nothing. What is left is dealt by anchor into shards, and each shard sorts the suffixes of its runs
column by column: round j inserts, for each run, the suffix of j symbols, at the place that the collection's
Burrows-Wheeler transform gives it, and brings the transform, the common prefixes (counted up to ``length``)
and the suffixes' owners up to date in sequential files beside each other. In the end suffixes with common
prefixes of ``length`` bytes stand next to each other; the earliest stays.

Sorting whole documents this way would take as many rounds as the longest has bytes, each over all that is
sorted so far; runs have under two hundred symbols. An anchor with over ``HOT`` different runs is not sorted
in one task: its strings themselves are grouped, place by place after the anchor.

A null text is empty; texts shorter than ``length`` lose nothing. Documents that repeat an id count as one
place: neither starts earlier. Null ids come last. An empty table gives an empty result; further columns of
the input are ignored. Matches never cross documents, as runs lie inside them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batches, columns_of, drop_table, release, write_table

LENGTH, GRAM, EACH, HOT, KEYS = 100, 24, 1500, 20_000, 4
#: Longer documents are looked at in blocks; a place in one takes the low 24 bits.
BLOCK, PLACE = 1 << 23, np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes: a polynomial, put together from halves."""
    out, done, part, size, power = None, 0, data, 1, _BASE
    with np.errstate(over="ignore"):
        while True:
            if gram & size:
                n = len(data) - gram + 1
                own = part[done : done + n]
                out = own.copy() if out is None else out * power + own
                done += size
            size *= 2
            if size > gram:
                break
            part = part[: -size // 2] * power + part[size // 2 :]
            power = power * power
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first start, last start, anchor's place) of each run of strings with one anchor."""
    parts = [_anchors(data[at : at + BLOCK + length - 1], at, length, gram) for at in range(0, max(1, len(data) - length + 1), BLOCK)]
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def _anchors(data: bytes, base: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(np.frombuffer(data, np.uint8).astype(np.uint64), gram)
    # hash, then place: the least of a window is its first least hash, and says where that is
    low = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, span = length - gram + 1, 1
    while 2 * span <= wide:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < wide:
        low = np.minimum(low[: len(h) - wide + 1], low[wide - span :])
    place = (low & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    return h[place[first]], first + base, last + base, place[first] + base


class Records:
    """The collection's records in a file, written anew in one sequential pass a round.

    A record is a suffix: its string (32 bits), its length, the bytes it shares with the one before, and the
    symbol that stands before it (16 bits; the transform).
    """

    def __init__(self, folder: str):
        self.folder, self.turn = folder, 0

    def _path(self, turn: int) -> str:
        return os.path.join(self.folder, f"records.{turn}")

    def read(self) -> np.ndarray:
        return np.fromfile(self._path(self.turn), np.uint64)

    def write(self, records: np.ndarray) -> None:
        records.tofile(self._path(self.turn + 1))
        if self.turn:
            os.remove(self._path(self.turn))
        self.turn += 1


_OWNER, _SIZE, _COMMON, _LOW, _BYTE = np.uint64(32), np.uint64(24), np.uint64(16), np.uint64(0xFFFF), np.uint64(0xFF)


def _ranks(transform: np.ndarray, place: np.ndarray, base: np.ndarray, kinds: int) -> np.ndarray:
    """For places in the transform, how many symbols (0 aside) sort before the one there: all smaller ones, and
    equal ones further up. Counted by blocks of 128."""
    n = len(transform)
    blocks = -(-n // 128)
    each = np.bincount(base[:n] + transform, minlength=blocks * kinds).reshape(blocks, kinds)
    upto = np.cumsum(each, axis=0)
    totals = upto[-1].copy()
    totals[0] = 0
    smaller = np.cumsum(totals) - totals
    padded = np.zeros(blocks * 128, transform.dtype)
    padded[:n] = transform
    own, block = transform[place], place >> 7
    within = (padded.reshape(blocks, 128)[block] == own[:, None]) & (np.arange(128) < (place & 127)[:, None])
    return smaller[own] + upto[block, own] - each[block, own] + within.sum(axis=1)


def sort_columns(strings: list[bytes], cap: int, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: (owner, length, common prefix with the one before, up to ``cap``).

    Strings have under 256 bytes. Equal suffixes are in the order of their strings.
    """
    n = len(strings)
    sizes = np.array([len(s) for s in strings])
    wide = int(sizes.max())
    text = np.zeros((n, wide + cap), np.uint8)  # right-aligned, then room for comparisons
    for i, s in enumerate(strings):
        text[i, wide - len(s) : wide] = np.frombuffer(s, np.uint8)
    flat = text.ravel()
    windows = np.lib.stride_tricks.sliding_window_view(flat, cap)
    row = np.arange(n, dtype=np.int64) * (wide + cap) + wide
    used = np.bincount(np.frombuffer(b"".join(strings), np.uint8), minlength=256) > 0
    number = np.cumsum(used)  # symbols from 1 on, in the order of bytes
    kinds = int(number[-1]) + 1
    small = np.uint8 if kinds <= 256 else np.uint16
    base = (np.arange(int(sizes.sum()) + n, dtype=np.int64) >> 7) * kinds

    def shared(i: np.ndarray, li: np.ndarray, j: np.ndarray, lj: np.ndarray) -> np.ndarray:
        differ = windows[row[i] - li] != windows[row[j] - lj]
        first = differ.argmax(axis=1)
        first[~differ[np.arange(len(first)), first]] = cap
        return np.minimum(first, np.minimum(li, lj))

    def symbol(i: np.ndarray, size: int) -> np.ndarray:
        """What stands before a suffix: 0 at its string's start."""
        return np.where(size < sizes[i], number[flat[row[i] - size - 1]], 0).astype(np.uint64)

    def owner_and_size(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (r >> _OWNER).astype(np.int64), ((r >> _SIZE) & _BYTE).astype(np.int64)

    everyone = np.arange(n)
    files = Records(folder)
    files.write(everyone.astype(np.uint64) << _OWNER | symbol(everyone, 0))
    place = everyone.copy()  # where each string's latest suffix stands
    for j in range(1, wide + 1):
        records = files.read()
        transform = (records & _LOW).astype(small)
        going = np.flatnonzero(sizes >= j)
        # a suffix's place: after the empty ones and all that begin with less, in the order of what it goes on with
        new = n + _ranks(transform, place[going], base, kinds)
        by_place = np.argsort(new)
        going, new = going[by_place], new[by_place]
        total = len(records) + len(going)
        old = np.ones(total, bool)
        old[new] = False
        out = np.empty(total, np.uint64)
        out[old] = records
        out[new] = going.astype(np.uint64) << _OWNER | np.uint64(j) << _SIZE | symbol(going, j)
        after = new[new + 1 < total] + 1
        at = np.concatenate([new, after[old[after]]])
        common = shared(*owner_and_size(out[at - 1]), *owner_and_size(out[at])).astype(np.uint64)
        out[at] = (out[at] & ~(_BYTE << _COMMON)) | common << _COMMON
        files.write(out)
        place[going] = new
    records = files.read()
    owner, size = owner_and_size(records)
    return owner, size, ((records >> _COMMON) & _BYTE).astype(np.int64)


def repeated_starts(strings: list[bytes], ids: np.ndarray, starts: np.ndarray, length: int) -> list[list[int]]:
    """For each string (first found in document ``ids`` at ``starts``), the offsets of its ``length``-byte strings
    that start earlier in the collection."""
    with tempfile.TemporaryDirectory() as folder:
        owner, size, common = sort_columns(strings, length, folder)
    sizes = np.array([len(s) for s in strings])
    long = size >= length
    group = np.cumsum(common < length)  # between two that share `length` bytes none is shorter
    owner, size, group = owner[long], size[long], group[long]
    offset = sizes[owner] - size
    order = np.lexsort((starts[owner] + offset, ids[owner], group))
    g, i, o = group[order], owner[order], offset[order]
    place = np.stack([g, ids[i], starts[i] + o], 1)
    head = np.concatenate([[True], g[1:] != g[:-1]])
    earliest = place[np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))]
    later = (place != earliest).any(axis=1)
    out: list[list[int]] = [[] for _ in strings]
    for a, b in zip(i[later].tolist(), o[later].tolist(), strict=True):
        out[a].append(b)
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _spread(first: np.ndarray, last: np.ndarray, data: bytes, length: int) -> np.ndarray:
    """A second hash of each run, of all its bytes."""
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))


def sides(own: bytes, anchor: int, length: int, gram: int = GRAM, keys: int = KEYS) -> list[int | None]:
    """Hashes of the bytes beside a run's anchor, None where the run has fewer: the k-th of k * step bytes before it
    and (keys - 1 - k) * step after it. An equal string in two runs of one anchor has a multiple of step bytes, and
    less than step more, before the anchor, so the runs agree in one of the hashes at least."""
    step, end, out = (length - gram) // keys, anchor + gram, []
    for k in range(keys):
        before, after = k * step, (keys - 1 - k) * step
        out.append(xxhash.xxh3_64_intdigest(own[anchor - before : end + after], k) - (1 << 63) if anchor >= before and len(own) - end >= after else None)
    return out


def removed_spans(docs: DataFrame, length: int = LENGTH, each: int = EACH, hot: int = HOT) -> DataFrame:
    """id, spans array<struct<a, b>>: byte spans to be removed, for documents that have any; id is NULL_ID for null.

    Runs travel as two 64-bit hashes, of the anchor and of the run; runs equal in both are taken as equal. Bytes are
    fetched only for runs that share an anchor and differ, one copy of each, and sorted only for those that agree with
    another on the bytes beside the anchor. Joins are shuffled at every size.
    """
    spark = docs.sparkSession

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            ids, found = [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = _bytes(text)
                h, a, b, place = anchors(data, length)
                ids.append(np.full(len(h), NULL_ID if doc_id is None else doc_id, np.int64))
                found.append((h, a, (b - a) << 8 | (place - a), _spread(a, b, data, length)))
            if found:
                h, a, c, d = (np.concatenate([f[k] for f in found]) for k in range(4))
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), pa.array(np.concatenate(ids)), pa.array(a, pa.int32()), pa.array(c, pa.int32())], ["h", "d", "id", "a", "c"])

    # c: how many starts follow the first (times 256), and how far the anchor is from it
    more = F.shiftright("c", 8)
    found = write_table(docs.mapInArrow(find, "h long, d long, id long, a int, c int"), "anchors")
    repeated = write_table(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated")
    release(spark)
    runs = write_table(found.join(repeated.hint("shuffle_hash"), "h"), "runs")
    drop_table(found)
    release(spark)
    different = write_table(runs.groupBy("h", "d").agg(F.min(F.struct("id", "a", "c")).alias("first")), "different")
    counts = different.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = different.join(counts.hint("shuffle_hash"), "h").select("h", "d", "first.id", "first.a", "first.c", "n")
    wanted = write_table(several.groupBy("id").agg(F.collect_list(F.struct("h", "d", "a", "c", "n")).alias("runs")), "wanted")
    release(spark)

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 128):
            rows = []
            for doc_id, text, runs in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                data = _bytes(text)
                for r in runs:
                    after = r["c"] >> 8
                    own = data[r["a"] : r["a"] + after + length]
                    # of rows that share an id, the one that the run came from
                    if len(own) == after + length and np.uint64(xxhash.xxh3_64_intdigest(own)).astype(np.int64) == r["d"]:
                        rows.append((r["h"], r["d"], own, doc_id, r["a"], r["n"], sides(own, r["c"] & 255, length)))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["h", "d", "own", "id", "a", "n", "beside"])

    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
    spelled = keyed.join(wanted.hint("shuffle_hash"), "id").mapInArrow(spell, "h long, d long, own binary, id long, a int, n long, beside array<long>")
    spelled = write_table(spelled.dropDuplicates(["h", "d"]), "spelled")
    release(spark)
    # only what agrees with another run beside the anchor
    beside = spelled.select("h", "d", F.posexplode("beside").alias("k", "s")).filter("s IS NOT NULL")
    often = beside.groupBy("h", "s", "k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    agree = beside.join(often.hint("shuffle_hash"), ["h", "s", "k"]).select("h", "d").distinct()
    agreeing = write_table(spelled.join(agree.hint("shuffle_hash"), ["h", "d"], "left_semi").drop("beside"), "agreeing")
    drop_table(spelled)
    spelled = agreeing
    shards = max(1, -(-spelled.filter(F.col("n") <= hot).count() // each))
    release(spark)

    def sort(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("d").to_numpy(), table.column("h").to_numpy()))
        table = table.take(pa.array(order))
        later = repeated_starts(table.column("own").to_pylist(), table.column("id").to_numpy(), table.column("a").to_numpy().astype(np.int64), length)
        return pa.table({"h": table.column("h"), "d": table.column("d"), "later": pa.array(later, pa.list_(pa.int32()))})

    dealt = spelled.filter(F.col("n") <= hot).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).drop("n")
    sorted_ = dealt.groupBy("shard").applyInArrow(sort, "h long, d long, later array<int>")
    # hot anchors: string by string, at each offset of the run
    strings = spelled.filter(F.col("n") > hot).select("h", "d", "id", "a", F.posexplode(F.expr(f"transform(sequence(1, octet_length(own) - {length - 1}), i -> substring(own, i, {length}))")).alias("o", "s"))
    place = F.struct(F.col("id"), (F.col("a") + F.col("o")).alias("p"))
    least = strings.groupBy("s").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    hot_later = strings.join(least, "s").filter(place != F.col("least")).groupBy("h", "d").agg(F.collect_set("o").alias("later"))
    later = write_table(sorted_.unionByName(hot_later).filter(F.size("later") > 0), "later")

    # a run that isn't the first of its equals goes whole; the first loses what starts earlier in others
    first = different.select("h", "d", F.col("first.id").alias("i"), F.col("first.a").alias("p"))
    marked = runs.join(first.hint("shuffle_hash"), ["h", "d"])
    is_first = (F.col("id") == F.col("i")) & (F.col("a") == F.col("p"))
    packed = lambda a, more: a.cast("long") * 256 + more  # noqa: E731  first start, and how many more follow it
    whole = marked.filter(~is_first).select("id", packed(F.col("a"), more).alias("s"))
    some = later.join(different, ["h", "d"]).select(F.col("first.id").alias("id"), F.explode("later").alias("o"), F.col("first.a").alias("a")).select("id", packed(F.col("a") + F.col("o"), F.lit(0)).alias("s"))
    starts = whole.unionByName(some).groupBy("id").agg(F.collect_list("s").alias("starts"))

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            starts = part.column("starts")
            values, ends = starts.values.to_numpy(), starts.offsets.to_numpy()
            spans = [[{"a": a, "b": b} for a, b in merged(values[x:y], length)] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([part.column("id"), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["id", "spans"])

    out = write_table(starts.mapInArrow(merge, "id long, spans array<struct<a int, b int>>"), "spans")
    for t in (repeated, runs, different, wanted, spelled, later):
        drop_table(t)
    release(spark)
    return out


def merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Packed starts of strings (256 * first + how many more), to the spans of bytes they cover."""
    starts = np.unique(starts)
    first = starts >> 8
    end = np.maximum.accumulate(first + (starts & 255) + length)
    head = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return list(zip(first[head].tolist(), end[np.concatenate([head[1:] - 1, [len(end) - 1]])].tolist(), strict=True))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, each: int = EACH, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), removed array<struct<start, end>>."""
    docs = columns_of(docs)
    spans = removed_spans(docs, length, each, hot)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            rows = []
            for text, own in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data, spans = _bytes(text), [(s["a"], s["b"]) for s in own or ()]
                ends = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.record_batch([part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    joined = docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))).join(spans.hint("shuffle_hash"), "id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start int, end int>>")


def byte_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup_bytes(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["anchors", "byte_digest", "dedup_bytes", "repeated_starts", "sort_columns"]
