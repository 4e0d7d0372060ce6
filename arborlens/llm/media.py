"""Media columns: AVI motion-JPEG written, parsed, decoded, and cut into shots.

A payload of n * 576 bytes is n grey 32 x 24 baseline JPEG frames of twelve 8 x 8 blocks. Each byte b is the
quantised coefficient 256 + b, forty-eight to a block: such a coefficient always takes nine bits, so with
the code lengths of ``HUFFMAN`` a block is 98 bytes and coding and decoding are array operations. Nothing is
lost, as entropy coding of quantised coefficients is exact. Frames of other makers with other tables go
through ``decode_scan``, the general bit-by-bit decoder.

A null text is an empty one, an empty payload one frame of padding. Texts of any length are stored whole.
Repeated rows give equal rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, columns_of

UNIT, WIDE, HIGH, BLOCKS, CARRIED, FPS = 576, 32, 24, 12, 48, 25
#: Fixed values of the format: the order in which a block's coefficients are stored.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
#: (class and number, how many codes of 1..16 bits, symbols): DC difference 0; run 0 size 9, end of block.
HUFFMAN = [(0x00, {8: [0x00]}), (0x10, {7: [0x09], 8: [0x00]})]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    tables = b"".join(_segment(0xC4, bytes([key, *(len(codes.get(n, ())) for n in range(1, 17)), *(x for n in sorted(codes) for x in codes[n])])) for key, codes in HUFFMAN)
    return b"\xff\xd8" + _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC0, struct.pack(">BHHBBBB", 8, HIGH, WIDE, 1, 1, 0x11, 0)) + tables + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


HEAD, TAIL = _head(), b"\xff\xd9"


def encode_frames(payload: bytes) -> list[bytes]:
    """A JPEG file for every 576 bytes."""
    n = len(payload) // UNIT
    scan = np.empty((n, BLOCKS, 2 * CARRIED + 2), np.uint8)
    scan[:, :, 0] = 0x00  # DC: no difference
    scan[:, :, 1:-1:2] = 0x01  # seven bits of code, and the coefficient's leading one
    scan[:, :, 2:-1:2] = np.frombuffer(payload, np.uint8).reshape(n, BLOCKS, CARRIED)
    scan[:, :, -1] = 0x02  # end of block
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + TAIL for row in scan]


def write_avi(frames: list[bytes]) -> bytes:
    """RIFF AVI with one MJPG stream and an idx1 index."""
    n = len(frames)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, WIDE, HIGH, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDE, HIGH)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDE, HIGH, 1, 8, b"MJPG", WIDE * HIGH, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    parts, entries, at = [b"movi"], [], 4
    for f in frames:
        parts.append(c := chunk(b"00dc", f))
        entries.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = head + chunk(b"LIST", b"".join(parts)) + chunk(b"idx1", b"".join(entries))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks between two places."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames per second and the frames that the index names; without an index, those in the movie list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, frames = float(FPS), None, None, []
    lists = [(12, len(data))]
    while lists:
        for name, at, size in chunks(data, *lists.pop()):
            if name == b"LIST" and data[at : at + 4] == b"movi":
                movi = (at, at + size)
            elif name == b"LIST":
                lists.append((at + 4, at + size))
            elif name == b"strh" and data[at : at + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = (at, size)
    if movi is None:
        return fps, []
    if index is None:
        return fps, [data[at : at + size] for name, at, size in chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    base = None
    for name, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]):
        if base is None:  # offsets count from the list's name or from the file's start
            base = movi[0] if data[movi[0] + offset : movi[0] + offset + 4] == name else 0
        if name[2:] in (b"dc", b"db"):
            frames.append(data[base + offset + 8 : base + offset + 8 + size])
    return fps, frames


def parse_jpeg(frame: bytes) -> dict:
    """Size, quantisation and Huffman tables, and the scan's bytes of a baseline frame with one component."""
    at, out = 2, {"huffman": {}, "quant": {}}
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            for k in range(0, len(body) - 64, 65):
                out["quant"][body[k] & 15] = np.frombuffer(body, np.uint8, 64, k + 1).astype(np.int32)
        elif marker == 0xC0:
            out["high"], out["wide"] = struct.unpack_from(">HH", body, 1)
            out["table"] = body[8]
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                code, codes, k = 0, {}, 17
                for bits, many in enumerate(counts, 1):
                    for _ in range(many):
                        codes[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                out["huffman"][body[0]] = codes
                body = body[17 + n :]
        elif marker == 0xDA:
            out["scan"] = frame[at : frame.rindex(TAIL)].replace(b"\xff\x00", b"\xff")
            return out
    raise ValueError("a frame without a scan")


def decode_scan(jpeg: dict) -> np.ndarray:
    """Quantised coefficients of the blocks, in zigzag order, bit by bit: any baseline grey scan."""
    data, at, last = jpeg["scan"], 0, 0
    blocks = -(-jpeg["high"] // 8) * -(-jpeg["wide"] // 8)
    out = np.zeros((blocks, 64), np.int32)

    def bits(n: int) -> int:
        nonlocal at
        value = 0
        for _ in range(n):
            value, at = value << 1 | data[at >> 3] >> (7 - (at & 7)) & 1, at + 1
        return value

    def symbol(codes: dict) -> int:
        code, n = 0, 0
        while (n, code) not in codes:
            code, n = code << 1 | bits(1), n + 1
            if n > 16:
                raise ValueError("no such code")
        return codes[n, code]

    def number(size: int) -> int:
        v = bits(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    dc, ac = jpeg["huffman"][0x00], jpeg["huffman"][0x10]
    for block in out:
        last += number(symbol(dc))
        block[0], k = last, 1
        while k < 64:
            run, size = divmod(symbol(ac), 16)
            if not size and run < 15:
                break
            k += run
            if size:
                block[k] = number(size)
            k += 1
    return out


def coefficients(frames: list[bytes]) -> np.ndarray:
    """(frames, blocks, 64) quantised coefficients; our own layout at once, others bit by bit."""
    if all(f.startswith(HEAD) for f in frames):
        scan = np.frombuffer(b"".join([f[len(HEAD) : -2].replace(b"\xff\x00", b"\xff") for f in frames]), np.uint8)
        if len(scan) == len(frames) * BLOCKS * (2 * CARRIED + 2):
            scan = scan.reshape(len(frames), BLOCKS, 2 * CARRIED + 2)
            if not scan[:, :, 0].any() and (scan[:, :, 1:-1:2] == 1).all() and (scan[:, :, -1] == 2).all():
                out = np.zeros((len(frames), BLOCKS, 64), np.int32)
                out[:, :, 1 : CARRIED + 1] = scan[:, :, 2:-1:2].astype(np.int32) + 256
                return out
    return np.stack([decode_scan(parse_jpeg(f)) for f in frames])


def _cosines() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c.astype(np.float32)


COSINES = _cosines()


def pixels(coefs: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """(frames, blocks, 8, 8) samples 0..255."""
    flat = np.zeros(coefs.shape, np.float32)
    flat[..., ZIGZAG] = coefs if quant is None else coefs * quant
    square = flat.reshape(*coefs.shape[:-1], 8, 8)
    return np.clip(np.rint(COSINES.T @ square @ COSINES + 128), 0, 255).astype(np.uint8)


def payload_of(coefs: np.ndarray) -> bytes:
    return (coefs[:, :, 1 : CARRIED + 1] - 256).astype(np.uint8).tobytes()


def histograms(shown: np.ndarray, bins: int = 16) -> np.ndarray:
    n = len(shown)
    levels = (shown.reshape(n, -1) >> 4).astype(np.int64) + bins * np.arange(n)[:, None]
    return np.bincount(levels.ravel(), minlength=n * bins).reshape(n, bins)


def shots(hist: np.ndarray, window: int = 8, times: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first, end) frames of each shot. A cut comes where the histograms' difference is over ``least`` and
    over the mean plus ``times`` deviations of the ``window`` differences before it in its shot."""
    if not len(hist):
        return []
    step = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * max(1, int(hist[0].sum())))
    starts, since = [0], []
    for k, d in enumerate(step.tolist(), 1):
        recent = since[-window:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > least and d > mean + times * spread and len(recent) >= 2:
            starts.append(k)
            since = []
        else:
            since.append(d)
    return list(zip(starts, [*starts[1:], len(hist)], strict=True))


def store(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, unpadded count, and the AVI file that holds them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)
    return len(raw), write_avi(encode_frames(padded))


def to_avi(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as an AVI file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 64):
            both = [store(t) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array([m for _, m in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return columns_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIPS = "doc_id long, clip int, first_frame int, end_frame int, start_s double, end_s double, mean_level double"


def clips(media: DataFrame) -> DataFrame:
    """doc_id, media -> a row for each shot with its times; a null or empty file gives none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 64):
            rows = []
            for doc_id, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                if not data:
                    continue
                fps, frames = parse_avi(data)
                shown = pixels(coefficients(frames)) if frames else np.zeros((0, 1, 8, 8), np.uint8)
                rows += [(doc_id, k, a, b, a / fps, b / fps, float(shown[a:b].mean())) for k, (a, b) in enumerate(shots(histograms(shown)))]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s", "mean_level"])

    return media.select("doc_id", "media").mapInArrow(run, CLIPS)


def media_digest(docs: DataFrame) -> DataFrame:
    """Per document, from the stored file read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (frames, shots' first frames, the mean histogram)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(parts, 256):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                n, media = store(text)
                _, frames = parse_avi(media)
                coefs = coefficients(frames)
                back = payload_of(coefs)
                hist = histograms(pixels(coefs))
                feature = f"frames={len(frames)};cuts={','.join(str(a) for a, _ in shots(hist))};levels={','.join(map(str, hist.sum(axis=0).tolist()))}"
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return columns_of(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
