"""Sound data: framing of MPEG layer III, PCM and ADPCM decoding, and wave files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.sources.bits import PastEnd, Reader

#: Bit rates in kbit/s by version (1; 2 and 2.5) and header index, and sample rates by version. Fixed values of the format.
_BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mp3_frames(data: bytes) -> list[dict]:
    """Frames from the start on, up to the first bytes that are none."""
    out, at = [], 0
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4], "big")
        version, layer, rate, sample = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
        if head >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or sample == 3:
            break
        kbits, hertz = _BITRATES[1 if version == 3 else 2][rate], _RATES[version][sample]
        samples = 1152 if version == 3 else 576
        size = samples // 8 * kbits * 1000 // hertz + (head >> 9 & 1)
        if size < 4 or at + size > len(data):
            break
        out.append({"offset": at, "length": size, "version": version, "kbits": kbits, "rate": hertz, "channels": 1 if head >> 6 & 3 == 3 else 2, "samples": samples})
        at += size
    return out


def pcm(data: bytes, bits: int, channels: int) -> np.ndarray:
    """Samples as 16-bit planes, one row per channel; 8-bit samples are unsigned around 128. A cut last sample goes."""
    x = (np.frombuffer(data, np.uint8).astype(np.int16) - 128) * 256 if bits == 8 else np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    return x[: len(x) // channels * channels].reshape(-1, channels).T.astype(np.int16)


#: Index changes by code, for codes of 2 to 5 bits. Fixed values of the format.
_INDEX = {2: (-1, 2), 3: (-1, -1, 2, 4), 4: (-1, -1, -1, -1, 2, 4, 6, 8), 5: (-1, -1, -1, -1, -1, -1, -1, -1, 1, 2, 4, 6, 8, 10, 13, 16)}
#: Step sizes by index. Fixed values of the format.
_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337,
    371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
PACKET = 4096


def code_delta(step: int, size: int, bits: int) -> int:
    """The change that a code's magnitude stands for: each of its terms is cut to a whole number on its own."""
    return (step >> (bits - 1)) + sum(step >> (bits - 2 - k) for k in range(bits - 1) if size >> k & 1)


def adpcm(data: bytes, channels: int, samples: int | None = None) -> np.ndarray:
    """Samples as 16-bit planes. A packet starts with a sample and a step index per channel and holds 4095 codes more."""
    r = Reader(data)
    out: list[list[int]] = [[] for _ in range(channels)]
    try:
        bits = r.ub(2) + 2
        top = 1 << (bits - 1)
        while samples is None or len(out[-1]) < samples:
            value, index = [], []
            for c in range(channels):
                value.append(r.sb(16))
                index.append(r.ub(6))
            for c in range(channels):
                out[c].append(value[c])
            for _ in range(PACKET - 1):
                if samples is not None and len(out[-1]) >= samples:
                    break
                for c in range(channels):
                    code = r.ub(bits)
                    size = code & (top - 1)
                    step = _STEPS[index[c]]
                    delta = code_delta(step, size, bits)
                    value[c] = max(-32768, min(32767, value[c] - delta if code & top else value[c] + delta))
                    index[c] = max(0, min(88, index[c] + _INDEX[bits][size]))
                    out[c].append(value[c])
    except PastEnd:
        pass
    n = min(len(x) for x in out)
    return np.array([x[:n] for x in out], np.int16)


def wav(planes: np.ndarray, rate: int) -> bytes:
    """A wave file of 16-bit planes."""
    channels, n = planes.shape
    data = planes.T.astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data))
    return head + data


def resample(plane: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear resampling by whole-number weights, rounded to the nearest, half away from zero; the length is rounded too."""
    if source == target or not len(plane):
        return plane.copy()
    n = (len(plane) * target + source // 2) // source
    k = np.arange(n, dtype=np.int64) * source
    base, w = np.minimum(k // target, len(plane) - 1), k % target
    w[base == len(plane) - 1] = 0
    x = plane.astype(np.int64)
    num = x[base] * (target - w) + x[np.minimum(base + 1, len(x) - 1)] * w
    return (np.sign(num) * ((np.abs(num) + target // 2) // target)).astype(np.int16)


def levels(plane: np.ndarray) -> dict:
    """Peak and root mean square of a 16-bit plane, and the level in decibels (None for silence)."""
    x = plane.astype(np.float64)
    rms = float(np.sqrt((x * x).mean())) / 32768 if len(x) else 0.0
    return {"peak": int(np.abs(x).max(initial=0)), "rms": rms, "dbfs": round(20 * float(np.log10(rms)), 2) if rms else None, "gated": rms <= 10 ** (-60 / 20)}


def sound_samples(sounds: DataFrame) -> DataFrame:
    """Decoded planes of sounds (`id`, `format`, `bits`, `channels`, `samples`, `data`): `id`, `channel`, `samples`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                if s["format"] in ("pcm", "pcm-le"):
                    planes = pcm(s["data"], s["bits"], s["channels"])
                elif s["format"] == "adpcm":
                    planes = adpcm(s["data"], s["channels"], s["samples"])
                else:
                    continue
                rows += [{"id": s["id"], "channel": c, "samples": p.tolist()} for c, p in enumerate(planes)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.string()), ("channel", pa.int32()), ("samples", pa.list_(pa.int16()))]))

    return sounds.select("id", "format", "bits", "channels", "samples", "data").mapInArrow(run, "id string, channel int, samples array<smallint>")


def frame_table(sounds: DataFrame) -> DataFrame:
    """MPEG frames of sounds (`id`, `data`), in order: `id`, `seq` and the fields of `mp3_frames`, with `changed`: whether version, bit rate, sample rate or channels differ from the frame before."""
    names = ("offset", "length", "version", "kbits", "rate", "channels", "samples")
    kinds = pa.schema([("id", pa.int64()), ("seq", pa.int32()), *((n, pa.int32()) for n in names), ("changed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = None
                for seq, frame in enumerate(mp3_frames(data or b"")):
                    now = tuple(frame[n] for n in ("version", "kbits", "rate", "channels"))
                    rows.append({"id": own, "seq": seq, "changed": last is not None and now != last} | frame)
                    last = now
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return sounds.selectExpr("CAST(id AS bigint) AS id", "data").mapInArrow(run, f"id long, seq int, {', '.join(f'{n} int' for n in names)}, changed boolean")
