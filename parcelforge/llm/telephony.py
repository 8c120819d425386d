"""Telephony audio columns: mu-law, A-law and block ADPCM in WAV files, expanded to PCM and resampled.

The codes of a call are kept as they are, behind a 44 to 60 byte RIFF header.  Reading back parses the header, expands
mu-law and A-law codes by tables of 256 values, decodes ADPCM blocks in step with each other (one numpy operation for the
same sample of all blocks of a batch), and resamples to the target rate by linear interpolation in integers.

Defined results: a null or empty payload has no samples; `pack_bytes` pads to a positive multiple of the block size, so
it always has some; equal payloads give equal files, samples and features; a file that isn't one of these formats gives
null samples, payload and feature.  Files above `LARGE` bytes are decoded and resampled in stretches, so that memory doesn't
grow with them.  Only the id and payload columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import SLICE_BYTES, id_and_text, text_slices

#: Format tags of RIFF WAVE files.
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
NAMES = {tag: name for name, tag in FORMATS.items()}
#: Bytes of a payload are padded to a positive multiple of this, which is also the ADPCM block: a header of 4 bytes, then 2 samples a byte.
BLOCK = 576
RATE, OUT_RATE = 8000, 16000
#: Files above so many bytes are gone through in stretches of as many.
LARGE = BLOCK * 1024

#: The quantiser steps of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
#: How the low three bits of a code move the step.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code (G.711)."""
    code = ~np.arange(256) & 0xFF
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = (((mantissa << 3) + 0x84) << exponent) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code (G.711)."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
#: Of each step (row) and code: the change of the predicted value, and the next step.
CODES = np.arange(16)
CHANGE = (STEPS[:, None] >> 3) + np.where(CODES & 4, STEPS[:, None], 0) + np.where(CODES & 2, STEPS[:, None] >> 1, 0) + np.where(CODES & 1, STEPS[:, None] >> 2, 0)
CHANGE = np.where(CODES & 8, -CHANGE, CHANGE).astype(np.int32).ravel()
NEXT = (np.clip(np.arange(len(STEPS))[:, None] + MOVES[CODES & 7], 0, len(STEPS) - 1) * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (rows: blocks) of IMA ADPCM blocks (rows of bytes: value, step index, unused, codes).  An index above the table counts as its last."""
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    at = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    out[0] = value
    for k, byte in enumerate(codes):
        for half, code in enumerate((byte & 15, byte >> 4)):
            pick = at + code
            value = np.clip(value + CHANGE.take(pick), -32768, 32767)
            at = NEXT.take(pick)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def wav(codes: bytes, codec: str) -> bytes:
    """The codes in a RIFF WAVE file of that codec, 8000 a second, one channel."""
    if codec == "adpcm":
        per_block = 2 * (BLOCK - 4) + 1
        form = struct.pack("<HHIIHHHH", FORMATS[codec], 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        form = struct.pack("<HHIIHHH", FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(codes)) + codes + b"\0" * (len(codes) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes | None) -> tuple[str, bytes] | None:
    """Codec and codes of a file, None if it isn't of a known format."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and size >= 2:
            codec = NAMES.get(struct.unpack_from("<H", media, at + 8)[0])
        elif kind == b"data":
            return (codec, media[at + 8 : at + 8 + size]) if codec else None
        at += 8 + size + (size & 1)
    return None


def resample(pcm: np.ndarray, rate: int = RATE, to: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation in whole numbers: sample k of the result lies at k * rate / to of the input."""
    if not len(pcm) or rate == to:
        return pcm
    spots = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = np.divmod(spots, to)
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (to - part) + wide[right] * part) // to).astype(np.int16)


def stretches(file: tuple[str, bytes]) -> Iterator[np.ndarray]:
    """The PCM samples of a large file, piece by piece."""
    for start in range(0, len(file[1]), LARGE):
        yield expand([(file[0], file[1][start : start + LARGE])])[0]


def resampled(pieces: Iterator[np.ndarray], rate: int = RATE, to: int = OUT_RATE) -> Iterator[np.ndarray]:
    """resample() of the pieces as one, piece by piece: a sample waits until the one to its right is known."""
    seen, done, held = 0, 0, np.empty(0, np.int16)
    for piece in pieces:
        held = np.concatenate((held, piece))
        seen += len(piece)
        # results whose left sample isn't the last one so far, and no more than so many samples give
        ready = max(done, min(-(-(seen - 1) * to // rate), seen * to // rate)) if seen else done
        yield from stretch(held, seen - len(held), done, ready, rate, to)
        done = ready
        first = done * rate // to
        held = held[max(0, first - (seen - len(held))) :]
    yield from stretch(held, seen - len(held), done, seen * to // rate, rate, to)


def stretch(held: np.ndarray, offset: int, start: int, end: int, rate: int, to: int) -> Iterator[np.ndarray]:
    """Results start to end; held: the samples from number `offset` on."""
    if end > start:
        left, part = np.divmod(np.arange(start, end, dtype=np.int64) * rate, to)
        left -= offset
        wide = held.astype(np.int64)
        yield ((wide[left] * (to - part) + wide[np.minimum(left + 1, len(held) - 1)] * part) // to).astype(np.int16)


def expand(files: list[tuple[str, bytes] | None]) -> list[np.ndarray | None]:
    """PCM samples of each file.  The ADPCM blocks of all files are decoded together."""
    whole = [np.frombuffer(f[1][: len(f[1]) // BLOCK * BLOCK], dtype=np.uint8).reshape(-1, BLOCK) for f in files if f and f[0] == "adpcm"]
    decoded = iter(np.split(decode_adpcm(np.concatenate(whole)), np.cumsum([len(b) for b in whole])[:-1])) if whole else iter(())
    tables = {"mulaw": MULAW, "alaw": ALAW}
    return [None if f is None else next(decoded).ravel() if f[0] == "adpcm" else tables[f[0]][np.frombuffer(f[1], dtype=np.uint8)] for f in files]


def codec_of(payload: bytes) -> str:
    """The codec a payload is taken to be in: one of the three, by its checksum."""
    return sorted(FORMATS)[zlib.crc32(payload) % len(FORMATS)]


def padded(data: bytes) -> bytes:
    """With bytes 255 appended up to a positive multiple of the block size."""
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def pack_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each whole text as the codes of a WAV file, losslessly.  No shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            data = [t.encode() for t in texts]
            media = [wav(p, codec_of(p)) for p in map(padded, data)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "doc_id long, n_bytes long, media binary")


def unpack_audio(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", to_rate: int = OUT_RATE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, codec, n_samples, pcm): the samples of each WAV file, little-endian 16 bit at `to_rate`.  Null if it isn't one.  No shuffle."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blobs in media_slices(batch, slice_bytes):
                files = [read_wav(b) for b in blobs]
                pcm = [None if p is None else np.concatenate([np.empty(0, np.int16), *p]) for p in samples_of(files, to_rate)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([f and f[0] for f in files], pa.string()), pa.array([None if p is None else len(p) for p in pcm], pa.int64()), pa.array([None if p is None else p.astype("<i2").tobytes() for p in pcm], pa.binary())],
                    names=["id", "codec", "n_samples", "pcm"],
                )

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(unpack, "id long, codec string, n_samples long, pcm binary")


def media_slices(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    start, held, blobs = 0, 0, []
    for i, blob in enumerate(batch.column("media")):
        blobs.append(blob.as_py())
        held += len(blobs[-1] or b"")
        if held >= limit or i + 1 == batch.num_rows:
            yield batch.column("id").slice(start, i + 1 - start), blobs
            start, held, blobs = i + 1, 0, []


def features(codec: str, pieces: Iterator[np.ndarray]) -> str:
    """Samples, peak, mean square, zero crossings and checksum of resampled PCM, with its codec."""
    n = peak = squares = crossings = crc = 0
    last = None
    for pcm in pieces:
        if not len(pcm):
            continue
        wide = pcm.astype(np.int64)
        below = pcm < 0
        crossings += int(np.count_nonzero(below[1:] != below[:-1])) + int(last is not None and last != below[0])
        n, peak, squares, last = n + len(pcm), max(peak, int(np.abs(wide).max())), squares + int(wide @ wide), below[-1]
        crc = zlib.crc32(pcm.astype("<i2").tobytes(), crc)
    return f"{codec}:{n}:{peak}:{squares // n if n else 0}:{crossings}:{crc:08x}"


def samples_of(files: list[tuple[str, bytes] | None], to_rate: int = OUT_RATE) -> Iterator[Iterator[np.ndarray] | None]:
    """The resampled PCM of each file, in pieces.  Files of usual size are decoded together."""
    small = iter(expand([f for f in files if f and len(f[1]) <= LARGE]))
    for f in files:
        if f is None:
            yield None
        elif len(f[1]) <= LARGE:
            yield iter((resample(next(small), RATE, to_rate),))
        else:
            yield resampled(stretches(f), RATE, to_rate)


def telephony_digest(media: DataFrame) -> DataFrame:
    """Of pack_bytes(): what is read back from each stored file, and features of its resampled PCM."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_bytes")
            done = 0
            for ids, blobs in media_slices(batch, SLICE_BYTES):
                files = [read_wav(b) for b in blobs]
                found = [p and features(f[0], p) for f, p in zip(files, samples_of(files), strict=True)]
                codes = [f and f[1] for f in files]
                of = lambda items, what, kind: pa.array([None if x is None else what(x) for x in items], kind)
                digest_of = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, sizes.slice(done, len(blobs)), of(codes, len, pa.int64()), of(codes, digest_of, pa.string()), of(codes, lambda x: zlib.crc32(x[-32:]), pa.int64()),
                        of(blobs, len, pa.int64()), of(blobs, digest_of, pa.string()), pa.array(found, pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )
                done += len(blobs)

    return media.select(F.col("doc_id").alias("id"), "n_bytes", "media").mapInArrow(
        digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
