"""Best-fit packing with certificates: documents' tokens into as few sequences as can be.

Pieces are dealt into partitions; each packs its own by best-fit decreasing and compares its number of
bins with lower bounds from dual feasible functions. A partition that meets its bound is certified and gives
away its emptiest bin at most; one with a gap gives away every bin that isn't full. What is given away is
dealt anew into fewer partitions, packed again, and so on down to one partition or until nothing is gained.

Null texts count as empty ones and hold the end token alone. Texts of any length are encoded whole; longer
ones than a sequence are cut. Repeated rows are pieces of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batches, columns_of, write_table

CAPACITY, END = 4096, 1
#: Pieces that a partition packs at a time.
EACH = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32 and a number to deal it by."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = bpe.Words(path), TaskContext.get().partitionId() << 40
        for part in batches(parts, 4096):
            ids, ends = words(part.column("text"))
            # the end token after each text
            ends = ends + np.arange(len(ends))
            all_ = np.empty(int(ends[-1]), "<u4")
            closing = np.zeros(len(all_), bool)
            closing[ends[1:] - 1] = True
            all_[closing], all_[~closing] = end, ids
            many = -(-np.diff(ends) // capacity)  # pieces of each text
            row = np.repeat(np.arange(part.num_rows), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(ends)[row] - start)
            first = (ends[:-1][row] + start) * 4
            data = memoryview(all_).cast("B")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.arange(n, n + len(row)))], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
            n += len(row)

    return columns_of(docs).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that no packing goes below; counts[n]: items of length n. The best of two families of dual
    feasible functions: thresholds (short items count 0, long ones a whole bin) and rounded fractions."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(capacity // 2 + 1, dtype=np.int64)  # shorter than t: 0; longer than capacity - t: a bin
    whole = number[-1] - number[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        # in units of 1 / (k * capacity) of a bin
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and place in it, each bin's free room."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    mask = 0  # bit r: there is a bin with r free
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], places[i] = b, capacity - r
        room[b] = left = r - n
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins, places, room


def _pack_part(table: pa.Table, capacity: int, prefix: int, last: bool) -> pa.Table:
    lengths = table.column("length").to_numpy()
    order = np.argsort(table.column("deal").to_numpy(), kind="stable")  # the same packing whatever order rows come in
    table, lengths = table.take(pa.array(order)), lengths[order]
    bins, places, room = best_fit(lengths, capacity)
    free = np.array(room)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    gap = len(room) - bound
    if last or not free.any():
        given = np.zeros(len(room), bool)
    elif gap:
        given = free > 0
    else:
        given = np.arange(len(room)) == int(free.argmax())
    part = table.column("part")[0].as_py()
    for name, column in (("sequence_id", (prefix << 56) + (part << 28) + bins), ("offset", places), ("part_bins", np.full(len(bins), len(room))), ("part_bound", np.full(len(bins), bound)), ("given", given[bins])):
        table = table.append_column(name, pa.array(column))
    return table.drop_columns(["part"])


def _packer(capacity: int, prefix: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        return _pack_part(table, capacity, prefix, last)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, each: int = EACH) -> DataFrame:
    """Items (length, deal and what else they carry) -> the same with sequence_id and offset, and the certificate of the
    partition that packed them last: its bins and its lower bound. ``items`` must be a written table: it is read more
    than once. Rounds go on while they leave fewer partitions."""
    done, pool, before = [], items, None
    for turn in count():
        n = pool.count()
        parts = max(1, -(-n // each))
        last = parts == 1 or parts == before
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(parts)))
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema)}, sequence_id long, offset long, part_bins long, part_bound long, given boolean"
        run = dealt.groupBy("part").applyInArrow(_packer(capacity, turn, last), schema)
        packed = write_table(run, "packed")
        done.append(packed.filter("not given").drop("given"))
        if last:
            break
        pool, before = packed.filter("given").drop("given", "sequence_id", "offset", "part_bins", "part_bound"), parts
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, each: int = EACH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound."""
    items = write_table(pieces(docs, path, capacity, end), "pieces")
    return pack(items, capacity, each).drop("deal")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used, and how many no packing goes below (from a histogram of ``capacity`` lengths)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    return packed.agg(F.count_distinct("sequence_id")).first()[0], lower_bound(counts, capacity)


__all__ = ["best_fit", "certificate", "lower_bound", "pack", "pack_documents", "pieces"]
