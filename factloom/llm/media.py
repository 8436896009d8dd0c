"""Operator 6: telephony audio columns.

8-bit telephony samples are kept in WAV files (mu-law, A-law) and decoded by
lookup tables; IMA ADPCM blocks are decoded in step, one numpy operation for
the same sample of all blocks. Decoded audio is resampled to 16 kHz PCM.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_arrow

#: Format tags of WAV files, bytes of one payload unit, sample rate.
PCM, ALAW, MULAW = 1, 6, 7
UNIT = 576
RATE = 8000
#: Index steps of IMA ADPCM, by the code's low three bits.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(seg == 0, low + 8, low + 264 << np.maximum(seg - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def _ima_steps() -> np.ndarray:
    """The 89 step sizes: each about 1.1 times the one before, from 7 on."""
    # The published table of step sizes.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


MULAW_PCM, ALAW_PCM, IMA_STEPS = _mulaw_table(), _alaw_table(), _ima_steps()


def wav(payload: bytes, tag: int = MULAW, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono WAV file with a fact chunk."""
    unit = bits // 8
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * unit, unit, bits, 0)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload) // unit) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and samples of a WAV file; chunks may come in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, data = 12, 0, 0, b""
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    return tag, rate, data


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one row for each block (a 4-byte head, then two samples a byte)."""
    n, width = blocks.shape
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    for i, both in enumerate(codes):
        for half in (0, 1):
            code = (both >> 4 if half else both & 15).astype(np.int32)
            step = IMA_STEPS[index]
            diff = (step >> 3) + (step & -(code >> 2 & 1)) + (step >> 1 & -(code >> 1 & 1)) + (step >> 2 & -(code & 1))
            value = np.where(code & 8, value - diff, value + diff)
            np.clip(value, -32768, 32767, out=value)
            index = index + INDEX_STEP[code & 7]
            np.clip(index, 0, 88, out=index)
            out[2 * i + half + 1] = value
    return out.T


def double_rate(x: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: the samples and, between them, a four-tap interpolation."""
    p = np.concatenate([x[:1], x, x[-1:], x[-1:]]).astype(np.int32)
    mid = (9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    out[1::2] = np.clip(mid, -32768, 32767)
    return out


def encode_media(docs: DataFrame, doc_id: str = "doc_id", data: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes and ``media``: the bytes, padded with 255 to a positive multiple of ``unit``, as a mu-law file.

    Null is empty, repeated rows are files each, other columns are not carried,
    an empty table gives no rows. A very long text is one file, held whole.
    """

    def run(b: pa.RecordBatch):
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            raw = part.column(1).to_pylist()
            files = [wav(x + b"\xff" * ((-len(x)) % unit or (0 if x else unit))) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, media binary")


def read_media(files: DataFrame, keep_pcm: bool = False, unit: int = UNIT) -> DataFrame:
    """What the stored files hold: payload (8-bit samples), feature and, if asked for, pcm: a 16 kHz WAV file.

    The feature has, of all samples: mean size of the mu-law and the A-law
    reading, sign changes, mean size of the reading as ADPCM blocks of ``unit``
    bytes, and the crc32 of the resampled PCM. It depends on the bytes alone.
    """

    def run(b: pa.RecordBatch):
        ids, sizes, media = b.column("doc_id"), b.column("n_bytes"), b.column("media").to_pylist()
        lo = 0
        while lo < len(media):
            hi, n = lo, 0
            while hi < len(media) and (hi == lo or n + len(media[hi]) <= 1 << 21):
                n += len(media[hi])
                hi += 1
            yield one(ids.slice(lo, hi - lo), sizes.slice(lo, hi - lo), media[lo:hi])
            lo = hi

    def one(ids: pa.Array, sizes: pa.Array, media: list[bytes]) -> pa.RecordBatch:
        payloads = [read_wav(m)[2] for m in media]
        all_bytes = np.frombuffer(b"".join(payloads), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype(np.int64)
        mu, al = MULAW_PCM[all_bytes], ALAW_PCM[all_bytes]
        at = starts[:-1]
        mean_mu = np.add.reduceat(np.abs(mu.astype(np.int64)), at) // np.diff(starts)
        mean_al = np.add.reduceat(np.abs(al.astype(np.int64)), at) // np.diff(starts)
        turns = np.zeros(len(mu), np.int64)
        turns[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
        turns[at] = 0
        changes = np.add.reduceat(turns, at)
        ima = np.abs(decode_ima(all_bytes.reshape(-1, unit)).astype(np.int64)).sum(axis=1)
        mean_ima = np.add.reduceat(ima, at // unit) // (np.diff(starts) // unit * (2 * (unit - 4) + 1))
        features, pcm = [], []
        for i, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            wide = double_rate(mu[a:z]).astype("<i2").tobytes()
            features.append(f"mu={mean_mu[i]};al={mean_al[i]};zc={changes[i]};ima={mean_ima[i]};pcm16k={zlib.crc32(wide):08x}")
            if keep_pcm:
                pcm.append(wav(wide, PCM, 2 * RATE, 16))
        cols = [ids, sizes, pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array(features, pa.string())]
        names = ["doc_id", "n_bytes", "media", "payload", "feature"]
        if keep_pcm:
            cols, names = [*cols, pa.array(pcm, pa.binary())], [*names, "pcm"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(files, run, "doc_id long, n_bytes long, media binary, payload binary, feature string" + ", pcm binary" * keep_pcm)
