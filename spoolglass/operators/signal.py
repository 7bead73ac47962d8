"""Audio frames of 30 ms: speech ratios, sliding windows, loudness envelopes, stereo checks, and the speech gate."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

# Fixed values of the gate.
SAMPLE_RATE, FRAME_MS, FRAME_BYTES = 16_000, 30, 960
WINDOW_FRAMES, MIN_WINDOW_RATIO = 40, 0.5
MIN_AUDIO_SECONDS, MAX_AUDIO_SECONDS = 1.5, 130.0
MIN_SPEECH_SECONDS, MIN_SPEECH_RATIO, MAX_SPEECH_RATIO = 0.6, 0.005, 0.98
MIN_NEAR_MONO, NEAR_MONO_SIDE, ACTIVE_RMS = 0.40, 0.20, 100
MIN_CV, MIN_VAD_DELTA, MIN_ENERGY_RATIO = 0.45, 0.15, 1.8


def speech_stats(frames: DataFrame, clip: str = "clip_id") -> DataFrame:
    """clip, n_frames, voiced, speech_seconds, speech_ratio, envelope_cv of frames with is_speech and rms."""
    flag = F.col("is_speech").cast("int")
    rows = frames.groupBy(clip).agg(F.count("*").alias("n_frames"), F.sum(flag).alias("voiced"), F.avg("rms").alias("mean"), F.stddev_pop("rms").alias("deviation"))
    cv = F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")).otherwise(0.0)
    return rows.select(clip, "n_frames", "voiced", (F.col("voiced") * FRAME_MS / 1000).alias("speech_seconds"), (F.col("voiced") / F.col("n_frames")).alias("speech_ratio"), cv.alias("envelope_cv"))


def sliding_speech(frames: DataFrame, clip: str = "clip_id", order: str | list[str] = "frame_ix", size: int = WINDOW_FRAMES) -> DataFrame:
    """clip, window_ratio, sustained: the greatest share of speech in a full window of frames; of all in a shorter clip."""
    orders = [order] if isinstance(order, str) else order
    window = Window.partitionBy(clip).orderBy(*orders).rowsBetween(1 - size, 0)
    flag = F.col("is_speech").cast("int")
    rows = frames.select(clip, flag.alias("flag"), F.count("*").over(window).alias("n"), F.avg(flag).over(window).alias("share"))
    best = F.coalesce(F.max(F.when(F.col("n") == size, F.col("share"))), F.avg("flag"))
    return rows.groupBy(clip).agg(best.alias("window_ratio")).withColumn("sustained", F.col("window_ratio") >= MIN_WINDOW_RATIO)


def near_mono(frames: DataFrame, clip: str = "clip_id") -> DataFrame:
    """clip, n_active, near_mono_ratio of frames with mid_rms and side_rms: active frames that are mostly mid."""
    active = F.greatest("mid_rms", "side_rms") >= ACTIVE_RMS
    near = active & (F.col("mid_rms") >= ACTIVE_RMS) & (F.col("side_rms") <= F.col("mid_rms") * NEAR_MONO_SIDE)
    rows = frames.groupBy(clip).agg(F.count_if(active).alias("n_active"), F.count_if(near).alias("near"))
    return rows.select(clip, "n_active", F.coalesce(F.try_divide("near", "n_active"), F.lit(0.0)).alias("near_mono_ratio"))


def dominant_speech(frames: DataFrame, clip: str = "clip_id") -> DataFrame:
    """clip, dominant: stereo whose speech is in the middle (is_speech, side_is_speech, rms, mid_rms, side_rms)."""
    voiced = F.col("is_speech")
    rows = frames.groupBy(clip).agg(
        F.avg(voiced.cast("int")).alias("mid_ratio"),
        F.avg(F.col("side_is_speech").cast("int")).alias("side_ratio"),
        F.coalesce(F.sum(F.when(voiced, F.col("mid_rms") * F.col("mid_rms"))), F.lit(0)).alias("mid"),
        F.coalesce(F.sum(F.when(voiced, F.col("side_rms") * F.col("side_rms"))), F.lit(0)).alias("side"),
        F.avg("rms").alias("mean"),
        F.stddev_pop("rms").alias("deviation"),
    )
    cv = F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")).otherwise(0.0)
    ok = (cv >= MIN_CV) & (F.col("mid_ratio") - F.col("side_ratio") >= MIN_VAD_DELTA) & (F.col("mid") > 0)
    return rows.select(clip, (ok & (F.sqrt(F.col("mid") / F.greatest(F.lit(1), F.col("side"))) >= MIN_ENERGY_RATIO)).alias("dominant"))


def speech_gate(duration: Column, seconds: Column, ratio: Column, sustained: Column, cv: Column, stereo: Column, near_mono_ratio: Column, dominant: Column) -> Column:
    """Why a clip's audio is not transcribed, null if it is; a null duration has no audio stream."""
    least = F.greatest(F.lit(MIN_SPEECH_SECONDS), F.least(F.lit(1.5), duration * 0.01))
    return (
        F.when(duration.isNull(), F.lit("no_stream"))
        .when(duration < MIN_AUDIO_SECONDS, F.lit("too_short"))
        .when(duration > MAX_AUDIO_SECONDS, F.lit("error_too_long"))
        .when((seconds < least) | (ratio < MIN_SPEECH_RATIO) | ~sustained, F.lit("little_speech"))
        .when((ratio > MAX_SPEECH_RATIO) & (cv < MIN_CV), F.lit("steady_noise"))
        .when(stereo & (near_mono_ratio < MIN_NEAR_MONO) & ~dominant, F.lit("wide_stereo"))
    )


def audio_metadata_error(duration: Column, channels: Column) -> Column:
    """Null for a usable stream or none at all."""
    ok = duration.between(0.1, 600) & channels.between(1, 32)
    return F.when(channels.isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit("invalid audio metadata"))


def pcm_frames(clips: DataFrame, clip: str = "clip_id", pcm: str = "pcm") -> DataFrame:
    """clip, frame_ix, pcm: the full 30 ms frames of mono 16-bit audio."""
    n = F.floor(F.length(pcm) / FRAME_BYTES).cast("int")
    rows = clips.filter(F.length(pcm) >= FRAME_BYTES).select(clip, pcm, F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_ix"))
    return rows.select(clip, "frame_ix", F.substring(pcm, F.col("frame_ix") * FRAME_BYTES + 1, F.lit(FRAME_BYTES)).alias("pcm"))


@F.pandas_udf(IntegerType())
def rms(pcm: pd.Series) -> pd.Series:
    """Root of the mean square of 16-bit samples, truncated."""

    def one(raw: bytes | None) -> int | None:
        if raw is None:
            return None
        x = np.frombuffer(raw, "<i2").astype(np.int64)
        return int(np.sqrt((x * x).mean())) if len(x) else 0

    return pcm.map(one).astype("Int32")


def mixed(stereo: bytes, sign: int) -> bytes:
    """Half of left plus or minus right, floored and clipped."""
    x = np.frombuffer(stereo, "<i2").astype(np.int64).reshape(-1, 2)
    return np.clip(np.floor((x[:, 0] + sign * x[:, 1]) / 2), -32768, 32767).astype("<i2").tobytes()


@F.pandas_udf(BinaryType())
def mid(stereo: pd.Series) -> pd.Series:
    return stereo.map(lambda raw: None if raw is None else mixed(raw, 1))


@F.pandas_udf(BinaryType())
def side(stereo: pd.Series) -> pd.Series:
    return stereo.map(lambda raw: None if raw is None else mixed(raw, -1))


@F.pandas_udf(BinaryType())
def wav(pcm: pd.Series) -> pd.Series:
    """A WAV file around 16 kHz mono samples."""

    def one(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(SAMPLE_RATE)
            w.writeframes(raw)
        return out.getvalue()

    return pcm.map(one)
