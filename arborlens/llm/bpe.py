"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

Which token ends at a symbol is decided by the symbols before it alone: a run of tokens is the encoding of
its text exactly if every two neighbours in it are one (``Merges.fits``). So the transducer keeps, for each
symbol, the token that ends the encoding there. No later token can begin further back than the longest
token is long, hence ``Merges.lookahead`` symbols suffice: where the back-pointers of the last ``lookahead``
symbols meet, all before is stable and is emitted. Memory is that window, whatever the text's length.

Nulls count as empty texts; an empty text has no tokens. Texts of any length, repeated rows and repeated
ids are encoded row by row; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import batches, columns_of

#: The white space of the tokenizer's patterns (the Unicode property); str.split also cuts at 1C to 1F.
SPACE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Chunks that each of a worker's two generations remembers.
CACHE = 350_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list: which neighbours become one, and how far ahead of a token one must look."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str = "</w>"):
        self.vocab, self.end = vocab, end
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for k, (a, b) in enumerate(merges):
            self.parts.setdefault(a + b, (a, b, k))
        self.size = {t: self.symbols(t) for t in vocab}
        #: Symbols after which a token's start is certain.
        self.lookahead = max(self.size[t] for t in self.parts) if self.parts else 1
        self._fits: dict[tuple[str, str], bool] = {}
        self._edge: dict[tuple[str, int], list[tuple[str, int, float]]] = {}

    def symbols(self, token: str) -> int:
        return len(token) - len(self.end) if token.endswith(self.end) and len(token) > len(self.end) else len(token)

    def edge(self, token: str, side: int) -> list[tuple[str, int, float]]:
        """The pieces that stand at a token's edge while it is merged: (piece, made at rank, gone at rank)."""
        key = (token, side)
        if key not in self._edge:
            found, gone = [], float("inf")
            while token in self.parts:
                split = self.parts[token]
                found.append((token, split[2], gone))
                token, gone = split[side], split[2]
            self._edge[key] = [*found, (token, -1, gone)]
        return self._edge[key]

    def fits(self, a: str, b: str) -> bool:
        """Whether ``a`` then ``b`` is how the two together are encoded: nothing merges across the seam."""
        key = (a, b)
        if (known := self._fits.get(key)) is None:
            known = True
            for x, made, gone in self.edge(a, 1):
                for y, made_y, gone_y in self.edge(b, 0):
                    r = self.rank.get((x, y))
                    # equal ranks merge from the left: x is taken by its left neighbour first, y by x
                    if r is not None and made < r < gone and made_y < r <= gone_y:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = known
        return known


class Transducer:
    """Feed symbols, get tokens once they are stable."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.reset()

    def reset(self) -> None:
        self.text = ""  # symbols that may still be part of a token
        self.tokens: list[str] = []  # the token that ends at each of them
        self.before: str | None = None  # the last token emitted

    def _last(self, i: int, tail: str) -> str:
        """The token that ends the encoding of the first ``i`` symbols."""
        m, text = self.m, self.text
        for k in range(max(0, i - m.lookahead), i):
            token = text[k:i] + tail
            if token in m.vocab:
                prior = self.tokens[k - 1] if k else self.before
                if prior is None or m.fits(prior, token):
                    if k and prior == "":
                        continue
                    return token
        return ""

    def push(self, symbol: str) -> list[str]:
        """Take a symbol that isn't a word's last; what has become stable."""
        self.text += symbol
        self.tokens.append(self._last(len(self.text), ""))
        return self._settle() if len(self.text) >= 2 * self.m.lookahead else []

    def finish(self, symbol: str) -> list[str]:
        """Take a word's last symbol; the rest of its tokens."""
        self.text += symbol
        self.tokens.append(self._last(len(self.text), self.m.end))
        out = self._back(len(self.text))
        self.reset()
        return out

    def _back(self, i: int) -> list[str]:
        out = []
        while i > 0:
            token = self.tokens[i - 1]
            out.append(token)
            i -= self.m.size[token]
        return out[::-1]

    def _settle(self) -> list[str]:
        n, common = len(self.text), None
        for i in range(n - self.m.lookahead, n + 1):
            if not (i and self.tokens[i - 1] == ""):
                ends, at = set(), i
                while at > 0:
                    ends.add(at)
                    at -= self.m.size[self.tokens[at - 1]]
                common = ends if common is None else common & ends
        cut = max((x for x in common or () if x <= n - self.m.lookahead), default=0)
        if not cut:
            return []
        out = self._back(cut)
        self.text, self.tokens, self.before = self.text[cut:], self.tokens[cut:], out[-1]
        return out


class Codec:
    """Normalises, splits and encodes as the vocabulary's file says; remembers the chunks it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.transducer = Transducer(self.merges)
        self.letters = byte_letters()
        self.latin = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(128, 0x400)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*spec["model"]["vocab"].items(), *self.special.items()]}
        self.is_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def word(self, letters: str) -> list[str]:
        """The tokens of one word, given as byte letters."""
        m, n = self.merges, len(letters)
        if n <= m.lookahead:  # nothing can settle before the end: one window is the whole word
            vocab, known, fits = m.vocab, m._fits, m.fits
            last: list[str] = [""] * n
            for i in range(1, n + 1):
                piece = letters[:i] if i < n else letters + m.end
                for k in range(i - 1, -1, -1):  # one token alone can stand here, so the shortest are tried first
                    token = piece[k:]
                    if token in vocab:
                        if not k:
                            last[i - 1] = token
                            break
                        prior = last[k - 1]
                        if prior and ((ok := known.get((prior, token))) or ok is None and fits(prior, token)):
                            last[i - 1] = token
                            break
            out = []
            while n:
                out.append(last[n - 1])
                n -= m.size[last[n - 1]]
            return out[::-1]
        out, t = [], self.transducer
        for symbol in letters[:-1]:
            out += t.push(symbol)
        return out + t.finish(letters[-1])

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a text without white space."""
        vocab, words = self.merges.vocab, self.words
        if len(words) > CACHE:
            words.clear()
        if max(chunk) < "\u0180" and chunk.isprintable():  # Latin letters: composed already, the same in all tables
            parts = self.pattern.findall(chunk.lower())
            if not chunk.isascii():
                parts = [w.translate(self.latin) for w in parts]
        else:  # by the library's own tables of letters, which differ from one Unicode version to the next
            parts = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        out: tuple[int, ...] = ()
        for w in parts:
            if (ids := words.get(w)) is None:
                ids = words[w] = tuple([vocab[t] for t in self.word(w)])
            out += ids
        return out

    def chunks(self, text: str) -> list[str]:
        """What white space and special tokens part; a special token is a chunk of its own."""
        if "<|" not in text or not self.is_special.search(text):
            return text.split() if not _ODD.search(text) else _CHUNK.findall(text)
        out = []
        for k, part in enumerate(self.is_special.split(text)):
            out += [part] if k % 2 else _CHUNK.findall(part)
        return out

    def of(self, chunk: str) -> tuple[int, ...]:
        return (self.special[chunk],) if chunk in self.special else self.chunk(chunk) if chunk else ()

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of texts as numbers of a dictionary of them; chunks may be empty."""
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _ODD.pattern))
        if not pc.any(odd).as_py():
            lists = pc.utf8_split_whitespace(texts)  # cuts where str.split does
        else:
            lists = pa.array([self.chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        return pa.ListArray.from_arrays(lists.offsets, lists.values.dictionary_encode())

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        known = self.cache
        if len(known) > CACHE:
            known.clear()
        out: list[int] = []
        for c in self.chunks(text or ""):
            if (ids := known.get(c)) is None:
                ids = known[c] = self.of(c)
            out += ids
        return out


class Decoder:
    """Ids to text, one at a time: tokens part by a space, bytes wait until they make a letter."""

    def __init__(self, names: dict[int, str]):
        self.names, self.first = names, True

    def push(self, token: int) -> str:
        """The text that one more id adds (an unknown id adds none)."""
        name = self.names.get(token)
        if name is None:
            return ""
        out = name if self.first else " " + name
        self.first = False
        return out


class Bytes:
    """Bytes to text, one at a time: a state machine that waits for a letter's last byte."""

    def __init__(self) -> None:
        self.need, self.held = 0, bytearray()

    def push(self, byte: int) -> str:
        out = ""
        if self.need:
            if byte & 0xC0 == 0x80:
                self.held.append(byte)
                self.need -= 1
                if self.need:
                    return ""
                out, self.held = self.held.decode("utf-8", "replace"), bytearray()
                return out
            out, self.held, self.need = "�", bytearray(), 0
        if byte < 0x80:
            return out + chr(byte)
        self.need = 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE0 <= byte <= 0xEF else 3 if 0xF0 <= byte <= 0xF4 else 0
        if not self.need:
            return out + "�"
        self.held.append(byte)
        return out

    def close(self) -> str:
        return "�" if self.need else ""


def restore(codec: Codec, ids: list[int]) -> str:
    """The normalised text: byte letters back to bytes, word ends to spaces."""
    back = {c: b for b, c in enumerate(codec.letters)}
    machine, out = Bytes(), []
    for i in ids:
        name = codec.names[i]
        if name in codec.special:
            out.append(name + " ")
            continue
        ends = name.endswith(codec.merges.end)
        for letter in name.removesuffix(codec.merges.end):
            out.append(machine.push(back[letter]))
        if ends:
            out.append(machine.close() + " ")
            machine = Bytes()
    return "".join(out).rstrip(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """A worker's codec."""
    return Codec(path)


class Remembered(dict):
    """Chunk -> its ids. Two generations: when one is full the older goes, and what is met again stays."""

    def __init__(self, path: str):
        self.codec, self.old = codec(path), {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.old.get(chunk)
        if found is None:
            found = self.codec.of(chunk)
        self.keep(chunk, found)
        return found

    def keep(self, chunk: str, found: tuple[int, ...]) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[chunk] = found

    def spread(self, texts: pa.Array) -> tuple[pa.ListArray, list[tuple[int, ...]]]:
        """Chunks as numbers, and the ids of each number: a chunk is looked up once, however often it stands."""
        lists = self.codec.split(pc.fill_null(texts, "").cast(pa.string()))
        chunks = lists.values.dictionary.to_pylist()
        self.learn(chunks)
        return lists, [self[c] for c in chunks]

    def learn(self, chunks: list[str]) -> None:
        """Make ready for many chunks at once."""


class Words:
    """The library's ids of many texts at once, for use where only ids are wanted; nothing is remembered from batch to
    batch, so memory is a batch's.

    Chunks are what white space parts. A batch's distinct chunks of printable Latin letters, marks and digits are
    split into words by the vocabulary's own pattern and merged by tiktoken's compiled merging; other chunks (letters
    that normalising may change, special tokens) go to the tokenizers library.

    A word's last byte and the word end are one symbol; a space after the word's bytes stands for the word end
    here, as words have no spaces. The vocabulary's ids rise with the merges, so they serve as tiktoken's
    ranks. tiktoken merges any two neighbours whose bytes together are a token, not the listed pair alone; that
    is the same exactly if every token's own bytes are encoded as that token, which tests check.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        back = {c: b for b, c in enumerate(byte_letters())}
        end = spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            closed = token.endswith(end) and token != end
            ranks[bytes(back[c] for c in (token.removesuffix(end) if closed else token)) + b" " * closed] = number
        self.merging = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[b"\n "]  # no chunk holds a line end
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.special = [t["content"] for t in spec["added_tokens"]]

    def distinct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, where each chunk's begin and the last's end)."""
        plain = [bool(c) and (c.isascii() or max(c) < "\u0180") and c.isprintable() and "<|" not in c for c in chunks]
        text = "\n".join([c for c, p in zip(chunks, plain, strict=True) if p])
        ids = self.merging.encode_to_numpy(" ".join(self.words.findall(text.lower())) + " ", disallowed_special=()) if text else np.zeros(0, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        first, last = np.concatenate([[0], marks + 1]), np.concatenate([marks, [len(ids)]])
        others = [c for c, p in zip(chunks, plain, strict=True) if not p]
        more = [e.ids for e in self.library.encode_batch_fast(others, add_special_tokens=False)] if others else []
        sizes, plain = np.empty(len(chunks), np.int64), np.array(plain, bool)
        sizes[plain], sizes[~plain] = (last - first)[: int(plain.sum())], [len(x) for x in more]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(ends[-1]), np.uint32)
        own = np.repeat(plain, sizes)
        out[own] = np.delete(ids, marks)
        out[~own] = np.concatenate([np.array(x, np.uint32) for x in more]) if more else []
        return out, ends

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of texts as numbers of a dictionary of them; chunks may be empty."""
        odd = pc.match_substring_regex(texts, _ODD.pattern)
        if not pc.any(odd).as_py():
            lists = pc.utf8_split_whitespace(texts)  # cuts where str.split does
        else:
            lists = pa.array([_CHUNK.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        return pa.ListArray.from_arrays(lists.offsets, lists.values.dictionary_encode())

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last's end)."""
        lists = self.split(pc.fill_null(texts, "").cast(pa.string()))
        ids, ends = self.distinct(lists.values.dictionary.to_pylist())
        which = lists.values.indices.to_numpy()
        sizes = (ends[1:] - ends[:-1])[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(ends[:-1][which] - upto[:-1], sizes)
        places += np.arange(len(places))
        offsets = lists.offsets.to_numpy()
        return ids[places], upto[offsets]


def _joined(lists: pa.ListArray, by_chunk: pa.Array, parted: str) -> pa.Array:
    """What each text's chunks stand for, joined; nulls are left out."""
    values = by_chunk.take(lists.values.indices)
    stay = values.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(stay)])[lists.offsets.to_numpy()].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values.drop_null()), parted)


@lru_cache(maxsize=1)
def remembered(path: str) -> Remembered:
    """A worker's own, kept from task to task."""
    return Remembered(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Encoded ids are decoded again."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path)
        names = known.codec.names
        for part in batches(parts):
            lists, ids = known.spread(part.column("text"))
            numbers = _joined(lists, pa.array([" ".join(map(str, x)) if x else None for x in ids], pa.string()), " ")
            decoded = _joined(lists, pa.array(["".join(map(Decoder(names).push, x)) if x else None for x in ids], pa.string()), " ")
            n = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[lists.values.indices.to_numpy()])])[lists.offsets.to_numpy()]
            digests = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in y.to_pylist()]) for y in (numbers, decoded)]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(n)), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return columns_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids array<int>, the general form."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in batches(parts):
            yield pa.record_batch([part.column("doc_id"), pa.array([own.encode(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return columns_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text: the tokens' own text (decoded) and the normalised text (restored)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in batches(parts):
            rows = [x or [] for x in part.column("ids").to_pylist()]
            texts = ["".join(map(Decoder(own.names).push, x)) for x in rows]
            yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string()), pa.array([restore(own, x) for x in rows], pa.string())], ["doc_id", "decoded", "restored"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string, restored string")
