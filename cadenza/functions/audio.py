"""WAV headers and samples. Headers are parsed from bytes; samples become arrays in Arrow batches."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 16_000
HEADER = T.StructType([T.StructField(n, T.LongType()) for n in ("channels", "sample_width", "rate", "frames")] + [T.StructField("truncated", T.BooleanType())])


def canonical_header(content: Column) -> Column:
    """(channels, sample_width, rate, frames) of a WAV file with the plain 44-byte header, all in the JVM; null for others."""

    def number(at: int, size: int) -> Column:
        digits = F.concat(*[F.substring(F.hex(F.substring(content, at + 1, size)), 2 * i + 1, 2) for i in reversed(range(size))])
        return F.conv(digits, 16, 10).cast("long")

    plain = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 8)) == "57415645666D7420") & (F.hex(F.substring(content, 37, 4)) == "64617461")
    channels, width = number(22, 2), (number(34, 2) / 8).cast("long")
    return F.when(plain, F.struct(channels.alias("channels"), width.alias("sample_width"), number(24, 4).alias("rate"), (number(40, 4) / (channels * width)).cast("long").alias("frames")))


def parse(content: bytes | None) -> dict | None:
    """Header of a WAV file with any chunks, and its PCM bytes; None if it is no PCM WAV."""
    if not content or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = at + 8
        if name == b"fmt " and body + 16 <= len(content):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, body)
            form = (kind, channels, rate, bits)
        if name == b"data" and form:
            kind, channels, rate, bits = form
            if kind not in (1, 0xFFFE) or not channels or bits % 8 or not bits:
                return None
            step = channels * bits // 8
            return {"channels": channels, "sample_width": bits // 8, "rate": rate, "frames": size // step, "truncated": body + size > len(content), "pcm": content[body : body + size]}
        at = body + size + size % 2
    return None


def header(content: Column | str) -> Column:
    """Header of any PCM WAV; all null for other bytes. Files with the plain 44-byte header aren't sent to Python."""
    content = F.col(content) if isinstance(content, str) else content
    told = canonical_header(content)
    # PCM, and the data chunk is where the plain header has it: bytes 17 to 22 are the size of the format and its kind
    plain = told.isNotNull() & (F.hex(F.substring(content, 17, 6)) == "100000000100") & (told["channels"] > 0) & (told["sample_width"] > 0) & told["frames"].isNotNull()
    cut = F.length(content) < 44 + told["frames"] * told["channels"] * told["sample_width"]
    native = F.when(plain, F.struct(*[told[n].alias(n) for n in ("channels", "sample_width", "rate", "frames")], cut.alias("truncated")))
    return F.coalesce(native, _header(F.when(native.isNull(), content)))


@F.pandas_udf(HEADER)
def _header(content: pd.Series) -> pd.DataFrame:
    names = ["channels", "sample_width", "rate", "frames", "truncated"]
    found = [parse(c) or {} for c in content]
    return pd.DataFrame({n: [x.get(n) for x in found] for n in names}).astype({n: "Int64" for n in names[:4]} | {"truncated": "boolean"})


def is_standard(h: Column) -> Column:
    """Mono 16-bit at 24 kHz, whole, longer than nothing and up to two hours."""
    seconds = h["frames"] / h["rate"]
    return F.coalesce((h["channels"] == 1) & (h["sample_width"] == 2) & (h["rate"] == 24_000) & ~h["truncated"] & (seconds > 0) & (seconds <= 7200), F.lit(False))


def ratio(rate: int, target: int = RATE) -> tuple[int, int]:
    g = math.gcd(rate, target)
    return target // g, rate // g


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling with a Kaiser-windowed sinc; length is ceil(len * up / down)."""
    if up == down:
        return x.astype(np.float64)
    widest = max(up, down)
    half = 10 * widest
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    at = np.arange(n) * down + half
    out = np.zeros(n)
    phase, last = at % up, at // up
    for p in np.unique(phase):
        part, some = taps[p::up], phase == p
        place = last[some][:, None] - np.arange(len(part))
        inside = (place >= 0) & (place < len(x))
        out[some] = (np.where(inside, x[np.clip(place, 0, len(x) - 1)], 0.0) * part).sum(axis=1)
    return out


def samples(content: bytes | None, target: int = RATE, seconds: float | None = None, allow_silence: bool = True) -> np.ndarray:
    """Mono float samples at ``target`` Hz; raises ValueError for what can't be scored."""
    told = parse(content)
    if told is None or told["sample_width"] != 2:
        raise ValueError("no 16-bit PCM WAV")
    pcm = np.frombuffer(told["pcm"][: len(told["pcm"]) // (2 * told["channels"]) * 2 * told["channels"]], "<i2").reshape(-1, told["channels"])
    x = pcm.mean(axis=1) / 32768
    checked(x, allow_silence)
    x = resample(x, *ratio(told["rate"], target))
    return x if seconds is None else x[: round(seconds * target)]


def checked(x: np.ndarray, allow_silence: bool = True) -> np.ndarray:
    if not x.size or not np.isfinite(x).all() or (not allow_silence and not x.any()):
        raise ValueError("empty, non-finite or silent audio")
    return x


def unit_range(x: np.ndarray) -> np.ndarray:
    """Resampling may overshoot; scorers want [-1, 1] as 32-bit floats."""
    return np.clip(checked(np.asarray(x, float)), -1.0, 1.0).astype(np.float32)


def padded(clips: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Clips as rows of one matrix, zeros behind the shorter ones, and each one's length relative to the longest."""
    sizes = np.array([len(c) for c in clips])
    out = np.zeros((len(clips), int(sizes.max()) if len(clips) else 0), np.float32)
    for row, clip in zip(out, clips, strict=True):
        row[: len(clip)] = clip
    return out, (sizes / max(out.shape[1], 1)).astype(np.float32)


def scored(df: DataFrame, scorer: Callable[[], Callable[[np.ndarray], tuple[float, float]]], content: str = "content") -> DataFrame:
    """``df`` without its bytes, with ``p808``, ``ovrl`` and ``error_type``.

    ``scorer()`` is called once in a task and gives a function from samples to the two values. A clip
    that fails, or whose values aren't finite, has an error type and no values; others go on.
    """
    kept = [f for f in df.schema.fields if f.name != content]
    names = [f.name for f in kept]
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "p808 double, ovrl double, error_type string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for frame in frames:
            rows = []
            for raw in frame[content]:
                try:
                    a, b = map(float, score(unit_range(samples(raw))))
                    if not (math.isfinite(a) and math.isfinite(b)):
                        raise ValueError("non-finite score")
                    rows.append((a, b, None))
                except Exception as e:  # a clip's failure is data here
                    rows.append((None, None, type(e).__name__))
            yield pd.concat([frame[names].reset_index(drop=True), pd.DataFrame(rows, columns=["p808", "ovrl", "error_type"])], axis=1)

    return df.mapInPandas(run, shape)


def recognized(df: DataFrame, recognizer: Callable[[], Callable[[np.ndarray, str], str]], content: str = "content") -> DataFrame:
    """``df`` (with ``lang``) without its bytes, with ``transcript`` and ``error`` (300 characters at most).

    ``recognizer()`` gives a function from 16 kHz samples and a language to a transcript.
    """
    kept = [f for f in df.schema.fields if f.name != content]
    names = [f.name for f in kept]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognize = recognizer()
        for frame in frames:
            rows = []
            for raw, lang in zip(frame[content], frame["lang"], strict=True):
                try:
                    rows.append((recognize(samples(raw), lang), None))
                except Exception as e:  # a clip's failure is data here
                    rows.append((None, str(e)[:300]))
            yield pd.concat([frame[names].reset_index(drop=True), pd.DataFrame(rows, columns=["transcript", "error"])], axis=1)

    return df.mapInPandas(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "transcript string, error string"]))


def embedded(df: DataFrame, encoder: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], batch: int = 8, seconds: float = 6.0, content: str = "content") -> DataFrame:
    """``df`` without its bytes, with ``embedding``; clips are batched by size to save padding.

    ``encoder()`` gives a function from a list of sample arrays to one row each. A batch that doesn't
    fit (MemoryError) is encoded clip by clip.
    """
    kept = [f for f in df.schema.fields if f.name != content]
    names = [f.name for f in kept]
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "embedding array<double>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for frame in frames:
            frame = frame.iloc[np.argsort([len(x) for x in frame[content]], kind="stable")]
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                clips = [samples(x, seconds=seconds, allow_silence=False) for x in part[content]]
                try:
                    rows = np.asarray(encode(clips))
                except MemoryError:
                    rows = np.vstack([np.asarray(encode([c])) for c in clips])
                yield part[names].assign(embedding=[r.astype(float).tolist() for r in rows])

    return df.sortWithinPartitions(F.length(content)).mapInPandas(run, shape)
