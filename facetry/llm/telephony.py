"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE containers, and resampled PCM.

The companding laws are expanded through 256-entry lookup tables.  ADPCM blocks are decoded with numpy across
blocks: step ``k`` handles sample ``k`` of every block of the batch at once.  Decoded audio is resampled from 8 to
16 kHz by a four-tap half-band interpolator in integers, so results do not depend on the batch, and stored as
16-bit PCM.

Defined results: a null payload is an empty one (padded to one unit of 64 zero bytes where text is stored); bytes that
are not one of these containers give null; equal bytes give equal results; a payload of any length is one file, up to
the 4 GB that the container can say; an empty table gives an empty one.  The functions are of one column, so no other
column clashes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.llm import kernels as K

RATE, OUT_RATE = 8000, 16000
UNIT = 64
#: WAVE format tags.
ALAW, MULAW, IMA, PCM = 6, 7, 17, 1
NAMES = {MULAW: "mulaw", ALAW: "alaw", IMA: "ima_adpcm"}


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, size + 0x100 << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()

# Fixed values of the IMA ADPCM recommendation.
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + 2 * (size - 4)) of mono blocks (n, size): a header of 4 bytes, then nibbles, low one first."""
    blocks = np.ascontiguousarray(blocks)
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)  # sample by sample, so that each step writes one row
    value = blocks[:, :2].copy().view("<i2").reshape(n).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(IMA_STEPS) - 1)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (size - 4)):
        nibble = (columns[k // 2] >> (4 * (k % 2))) & 0x0F
        step = IMA_STEPS[index]
        change = step >> 3
        change = change + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_MOVES[nibble & 7], 0, len(IMA_STEPS) - 1)
        out[k + 1] = value
    return out.T


def resample(x: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and between two of them comes (-1, 9, 9, -1) / 16 of four; ends repeat."""
    wide = np.concatenate([x[:1], x, x[-1:], x[-1:]]).astype(np.int32)
    between = (9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def wave(tag: int, data: bytes, rate: int, bits: int, align: int, extra: bytes = b"") -> bytes:
    """A mono WAVE file."""
    per_second = rate * align if tag != IMA else rate * align // (1 + 2 * (align - 4))
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, per_second, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, int, bytes] | None:
    """Format tag, rate, block size and data of a WAVE file, or None."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            fmt = tag, rate, align
        elif name == b"data" and fmt:
            data = media[at + 8 : at + 8 + size]
            return (*fmt, data) if len(data) == size else None
        at += 8 + size + size % 2
    return None


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def store(payload: bytes, codec: int | None = None) -> bytes:
    """The payload's bytes as coded samples (for ADPCM: as blocks of 64 bytes), which keeps all of them.

    Without a codec one is taken by the payload's own checksum, so equal payloads are stored alike.
    """
    codec = (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3] if codec is None else codec
    if codec == IMA:
        return wave(IMA, payload, RATE, 4, UNIT, struct.pack("<H", 1 + 2 * (UNIT - 4)))
    return wave(codec, payload, RATE, 8, 1)


def decode_all(files: list[tuple[int, int, int, bytes] | None]) -> list[np.ndarray | None]:
    """16-bit samples of parsed files; all ADPCM blocks of one size are decoded together."""
    out: list[np.ndarray | None] = [None] * len(files)
    by_size: dict[int, list[int]] = {}
    for k, f in enumerate(files):
        if f is None:
            continue
        tag, _, align, data = f
        if tag in (MULAW, ALAW):
            out[k] = (MULAW_TABLE if tag == MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)]
        elif tag == IMA and align > 4 and len(data) % align == 0:
            by_size.setdefault(align, []).append(k)
        elif tag == PCM:
            out[k] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    for align, rows in by_size.items():
        blocks = np.frombuffer(b"".join(files[k][3] for k in rows), np.uint8).reshape(-1, align)
        samples, a = decode_ima(blocks), 0
        for k in rows:
            n = len(files[k][3]) // align
            out[k] = samples[a : a + n].reshape(-1)
            a += n
    return out


def to_pcm(samples: np.ndarray, rate: int) -> bytes:
    """A PCM WAVE file at 16 kHz (audio at 8 kHz is resampled)."""
    x = resample(samples) if rate == RATE and len(samples) else samples
    return wave(PCM, x.astype("<i2").tobytes(), OUT_RATE if rate == RATE else rate, 16, 2)


def _feature(tag: int, samples: np.ndarray) -> str:
    x = samples.astype(np.int64)
    power = int((x * x).sum()) // max(1, len(x))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    peak = int(np.abs(x).max()) if len(x) else 0
    return f"{NAMES[tag]};n={len(x)};power={power};crossings={crossings};peak={peak}"


#: Bytes of media that are decoded together; decoded and resampled samples take up to eight times as much.
PART_BYTES = 1 << 20


def stored(text: Column) -> Column:
    """A struct of the text's length in bytes and the stored media bytes."""

    @F.arrow_udf("struct<n_bytes:bigint,media:binary>")
    def run(t: pa.Array) -> pa.Array:
        n, media = [], []
        for part in K.parts(t, PART_BYTES):
            for x in part.to_pylist():
                length, payload = payload_of(x)
                n.append(length)
                media.append(store(payload))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["n_bytes", "media"])

    return run.asNondeterministic()(text.cast("string"))


def _decoded(t: pa.Array):
    """Each file's bytes, its parsed form, and its samples."""
    for part in K.parts(t, PART_BYTES):
        raw = part.to_pylist()
        files = [parse_wave(x) if x else None for x in raw]
        yield from zip(raw, files, decode_all(files), strict=True)
    K.release_memory()


def pcm(media: Column) -> Column:
    """The stored media decoded, resampled, and stored as a PCM WAVE file."""

    @F.arrow_udf("binary")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([None if s is None else to_pcm(s, f[1]) for _, f, s in _decoded(t)], pa.binary())

    return run.asNondeterministic()(media)


_FIELDS = (
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm_bytes", pa.int64()), ("pcm_sha256", pa.string()), ("pcm", pa.binary()),
)
_SQL_KIND = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}


def digest(media: Column, with_pcm: bool = False) -> Column:
    """What the stored bytes hold, read back: payload, its digests, features of the audio, and its resampled PCM form.

    ``with_pcm`` stores that form too, as a WAVE file; else its length and digest are all that is kept of it.
    """
    fields = _FIELDS if with_pcm else _FIELDS[:-1]

    @F.arrow_udf("struct<" + ",".join(f"{k}:{_SQL_KIND[t]}" for k, t in fields) + ">")
    def run(t: pa.Array) -> pa.Array:
        rows = []
        for x, f, s in _decoded(t):
            if f is None or s is None or f[0] not in NAMES:
                rows.append((None,) * len(fields))
                continue
            data, wav = f[3], to_pcm(s, f[1])
            found = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), _feature(f[0], s), len(wav), hashlib.sha256(wav).hexdigest(), wav)
            rows.append(found[: len(fields)])
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], names=[k for k, _ in fields])

    return run.asNondeterministic()(media)
