"""Measures of decoded audio and images: loudness, level, clipping, luma, contrast, sharpness.

Samples are doubles from -1 to 1, pictures are rows of luma values. Each value is measured by itself,
in Arrow batches; what is measured of a recording is bounded by the recording.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO = "struct<rate:int,channels:int,samples:array<double>>"
LOUDNESS = "struct<integrated_loudness:double,loudness_range:double,sample_peak_dbfs:double,true_peak_dbtp:double,rms_dbfs:double,crest_factor:double,dc_offset:double,clipped_sample_count:bigint,clipped_ratio:double,sample_count:bigint>"
LUMA = "struct<width:int,height:int,mean:double,min:double,max:double,std:double,p01:double,p99:double,michelson_contrast:double,laplacian_variance:double,shadow_clipped_pixels:bigint,highlight_clipped_pixels:bigint>"

# Fixed values of the loudness recommendation: block and hop in seconds, gates, offset.
BLOCK, HOP, ABSOLUTE_GATE, RELATIVE_GATE, OFFSET = 0.4, 0.1, -70.0, -10.0, -0.691
#: Frequency, gain and quality of its two filters: a shelf for the head, a high pass.
SHELF, HIGH_PASS = (1681.974450955533, 3.999843853973347, 0.7071752369554196), (38.13547087602444, 0.5003270373238773)


def _batched(value: Column, kind: str, f) -> Column:
    """``f`` of every value, as a struct; null for null."""
    names = [x.split(":")[0] for x in kind[7:-1].split(",")]

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [None if x is None else f(x) for x in part]
            yield pd.DataFrame({n: pd.Series([None if x is None else x.get(n) for x in found], index=part.index, dtype=object) for n in names})

    return F.when(value.isNotNull(), run(value))


def read_wav(content: bytes) -> dict | None:
    """Rate, channels and samples (channels averaged) of a PCM file of 8 to 32 bits; none if it is none."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, n, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        x = ((x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16) ^ 0x800000).astype(float) - 0x800000
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float)
    return {"rate": rate, "channels": n, "samples": (x / 2 ** (8 * width - 1)).reshape(-1, n).mean(1).tolist()}


def decode_wav(content: Column) -> Column:
    """struct of :func:`read_wav`; its fields are null where the bytes are no such file."""
    return _batched(content, AUDIO, lambda x: read_wav(bytes(x)) or {})


def _weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """The samples behind both filters, by their response at every frequency."""
    size = 1 << (2 * len(x) - 1).bit_length()
    z = np.exp(-2j * np.pi * np.fft.rfftfreq(size))
    f0, gain, q = SHELF
    k, vh = math.tan(math.pi * f0 / rate), 10 ** (gain / 20)
    vb, norm = vh**0.4996667741545416, 1 + k / q + k * k
    response = ((vh + vb * k / q + k * k) + 2 * (k * k - vh) * z + (vh - vb * k / q + k * k) * z**2) / (norm + 2 * (k * k - 1) * z + (1 - k / q + k * k) * z**2)
    f0, q = HIGH_PASS
    k = math.tan(math.pi * f0 / rate)
    norm = 1 + k / q + k * k
    response *= (1 - 2 * z + z**2) / (1 + 2 * (k * k - 1) / norm * z + (1 - k / q + k * k) / norm * z**2)
    return np.fft.irfft(np.fft.rfft(x, size) * response, size)[: len(x)]


def _blocks(x: np.ndarray, rate: int, seconds: float) -> np.ndarray:
    """Loudness of overlapping blocks; a shorter recording is one block."""
    width, hop = max(int(rate * seconds), 1), max(int(rate * HOP), 1)
    total = np.concatenate([[0.0], np.cumsum(x * x)])
    starts = np.arange(0, max(len(x) - width, 0) + 1, hop)
    power = (total[np.minimum(starts + width, len(x))] - total[starts]) / min(width, len(x))
    return OFFSET + 10 * np.log10(np.maximum(power, 1e-30))


def _gated(blocks: np.ndarray, below: float) -> np.ndarray:
    """Blocks above the absolute gate and above their own mean less ``below``."""
    kept = blocks[blocks > ABSOLUTE_GATE]
    return kept[kept > 10 * np.log10(np.mean(10 ** (kept / 10))) + below] if len(kept) else kept


def _mean(x: np.ndarray) -> float:
    """Mean of a sum in the order of the recording, as SQL adds it up."""
    return float(np.cumsum(x)[-1] / len(x))


def _decibel(x: float) -> float | None:
    return 20 * math.log10(x) if x > 0 else None


def measure_audio(samples, rate: int, threshold: float = 1.0) -> dict:
    """Loudness (integrated and range, null where all is below the gates), peaks, level and clipping."""
    x = np.asarray(samples, float)
    if not len(x):
        return {"sample_count": 0, "clipped_sample_count": 0, "clipped_ratio": 0.0}
    weighted = _weighted(x, rate)
    whole, short = _gated(_blocks(weighted, rate, BLOCK), RELATIVE_GATE), _gated(_blocks(weighted, rate, 3.0), -20.0)
    peak, rms = float(np.abs(x).max()), math.sqrt(_mean(x * x))
    spectrum = np.fft.rfft(x)
    fine = np.fft.irfft(np.concatenate([spectrum, np.zeros(3 * (len(x) // 2))]), 4 * (len(x) // 2)) * (4 * (len(x) // 2) / len(x)) if len(x) > 3 else x
    clipped = int((np.abs(x) >= threshold).sum())
    return {
        "integrated_loudness": float(10 * np.log10(np.mean(10 ** (whole / 10)))) if len(whole) else None,
        "loudness_range": float(np.percentile(short, 95) - np.percentile(short, 10)) if len(short) else None,
        "sample_peak_dbfs": _decibel(peak), "true_peak_dbtp": _decibel(max(peak, float(np.abs(fine).max()))), "rms_dbfs": _decibel(rms), "crest_factor": peak / rms if rms else None, "dc_offset": _mean(x),
        "clipped_sample_count": clipped, "clipped_ratio": clipped / len(x), "sample_count": len(x),
    }


def audio_measures(samples: Column, rate: int, threshold: float = 1.0) -> Column:
    """struct of :func:`measure_audio` of array<double> samples."""
    return _batched(samples, LOUDNESS, lambda x: measure_audio(x, rate, threshold))


def luma_of(red: Column, green: Column, blue: Column) -> Column:
    """The luma of a colour."""
    return 0.299 * red + 0.587 * green + 0.114 * blue


def measure_luma(rows, shadow: float = 0.0, highlight: float = 255.0) -> dict | None:
    """Brightness, contrast between the first and last percentile, sharpness (variance of the Laplacian,
    0 at the border) and clipped pixels of rows of equal length; none if there is no pixel."""
    x = np.array([np.asarray(r, float) for r in rows])
    if x.ndim != 2 or not x.size:
        return None
    low, high = np.percentile(x, [1, 99])
    edges = np.zeros_like(x)
    if min(x.shape) > 2:
        edges[1:-1, 1:-1] = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    return {
        "width": x.shape[1], "height": x.shape[0], "mean": float(x.mean()), "min": float(x.min()), "max": float(x.max()), "std": float(x.std()), "p01": float(low), "p99": float(high),
        "michelson_contrast": float((high - low) / (high + low)) if high + low else 0.0, "laplacian_variance": float(edges.var()),
        "shadow_clipped_pixels": int((x <= shadow).sum()), "highlight_clipped_pixels": int((x >= highlight).sum()),
    }


def image_measures(rows: Column, shadow: float = 0.0, highlight: float = 255.0) -> Column:
    """struct of :func:`measure_luma` of array<array<double>> pictures."""
    return _batched(rows, LUMA, lambda x: measure_luma(x, shadow, highlight) or {})
