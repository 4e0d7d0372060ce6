"""Substring dedup by hashing units: paragraphs of consecutive lines and sentences.

A text is cut at line ends and after sentence marks; a stretch of over ``LONG`` words without either is also cut
before the words whose hash is a multiple of ``EVERY``, which are the same wherever the stretch stands. At each cut
begins a unit: the pieces from there on, across line ends, until they have ``MIN_WORDS`` words or more. So units
overlap, and a passage that stands elsewhere in other surroundings holds the same units. A unit's digest is taken of
its words, lower-cased and parted by one space. Of units with equal digests the earliest (doc_id, then place) stays
and the rest go; the offsets of what goes, in code points of the text, are kept.

What is shorter than ``MIN_WORDS`` words, such as a line that many documents share, is never a unit of its own:
chance repeats stay. The cut pieces at a passage's two ends, of which only a part repeats, stay too.

Null and empty texts, and those under ``MIN_WORDS`` words, have no units. Rows that repeat an id and a place are the
same occurrence and stay together; null ids count as one document that comes last. Texts are read whole. An empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batches, columns_of, drop_table, release, write_table

MIN_WORDS, LONG, EVERY = 14, 24, 8
PIECE = re.compile(r"[^\s.!?][^\n.!?]*[.!?]*|[.!?]+")
WORD = re.compile(r"\S+")  # what str.split gives


def pieces(text: str) -> tuple[list[int], list[int], list[int], list[str]]:
    """Starts, ends, numbers of words, and words as compared, of what the cuts part."""
    starts, ends, counts, keys = [], [], [], []
    low = text.lower()
    same = len(low) == len(text)  # then each letter has its own place in both
    for m in PIECE.finditer(low if same else text):
        words = (m[0] if same else m[0].lower()).split()
        if len(words) <= LONG:
            starts.append(m.start())
            ends.append(m.end())
            counts.append(len(words))
            keys.append(" ".join(words))
            continue
        at, first = m.start(), 0
        cuts = [k for k, w in enumerate(words) if crc32(w.encode()) % EVERY == 0 and k]
        places = None
        for k in [*cuts, len(words)]:
            key = " ".join(words[first:k])
            starts.append(at)
            counts.append(k - first)
            keys.append(key)
            if k == len(words):
                ends.append(m.end())
            elif same and low.startswith(key + " " + words[k], at):  # parted by one space each
                ends.append(at + len(key))
                at += len(key) + 1
            else:
                places = places or [(w.start() + m.start(), w.end() + m.start()) for w in WORD.finditer(text[m.start() : m.end()])]
                ends.append(places[k - 1][1])
                at = places[k][0]
            first = k
    return starts, ends, counts, keys


def units(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(digest, start, end) of the units of a text, in order."""
    starts, ends, counts, keys = pieces(text or "")
    out, upto, n = [], 0, 0
    total = len(keys)
    digest = xxhash.xxh3_128_digest
    for k in range(total):
        while n < min_words and upto < total:
            n += counts[upto]
            upto += 1
        if n < min_words:
            break
        out.append((digest(" ".join(keys[k:upto]).encode("utf-8", "surrogatepass")), starts[k], ends[upto - 1]))
        n -= counts[k]
    return out


def _occurrences(min_words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            ids, rows = [], []
            for doc_id, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                own = units(text, min_words)
                ids += [doc_id] * len(own)
                rows += own
            digest, start, end = zip(*rows, strict=True) if rows else ((), (), ())
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["d", "e", "id", "start", "end"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, text (what stays), removed array<struct<start, end>>, n_units_removed.

    Occurrences are computed once. Counting combines before it shuffles; of the joins, which are shuffled at every
    size, Spark may split what a digest found everywhere makes large. Texts move once, to meet their spans.
    """
    spark = docs.sparkSession
    docs = columns_of(docs).withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    found = write_table(docs.select("id", "text").mapInArrow(_occurrences(min_words), "d long, e long, id long, start int, end int"), "units")
    first = found.groupBy("d", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "start")).alias("first")).filter("n > 1")
    first = write_table(first.select("d", "e", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")), "repeated")
    release(spark)
    later = found.join(first.hint("shuffle_hash"), ["d", "e"]).filter("id > first_id OR start > first_start AND id = first_id")
    removed = write_table(later.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("gone")), "removed")
    for t in (found, first):
        drop_table(t)
    release(spark)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts):
            texts, spans, n = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                text, own = text or "", merged([(g["start"], g["end"]) for g in gone or ()])
                ends = [0, *(x for s in own for x in s), len(text)]
                texts.append("".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in own])
                n.append(len(gone or ()))
            yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(n, pa.int64())], ["doc_id", "text", "removed", "n_units_removed"])

    joined = docs.join(removed.hint("shuffle_hash"), "id", "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(cut, "doc_id long, text string, removed array<struct<start int, end int>>, n_units_removed long")


def passage_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_units_removed, n_spans, removed_spans, kept_sha256."""
    out = dedup_passages(docs)
    return out.select("doc_id", "n_units_removed", F.size("removed").cast("long").alias("n_spans"), F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed_spans"), F.sha2("text", 256).alias("kept_sha256"))


__all__ = ["dedup_passages", "merged", "passage_digest", "pieces", "units"]
