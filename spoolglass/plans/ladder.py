"""Which evidence a clip's facts come from, as columns: gates on the time left, then a ladder of what succeeded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolglass.functions.text import GENERIC_EXCLUSION, GENERIC_SUMMARY, bound, is_transient, lint_reasons

# Fixed values of the gates, in seconds and bytes.
MIN_REQUEST_SECONDS = 1.0
FULL_ENSEMBLE_SECONDS, POST_DOWNLOAD_SECONDS, NATIVE_VIDEO_SECONDS = 150, 125, 90
AUDIO_SECONDS, AUDIO_RESERVE_SECONDS = 25, 90
MAX_VIDEO_BYTES, MAX_BASE64_BYTES, MAX_NATIVE_BYTES = 160 << 20, 48 << 20, 24 << 20
STYLE_RETRIES, BACKOFF_SECONDS = 1, 0.35

#: A facts packet as a row; what a packet doesn't have is null.
FACTS_DDL = "struct<factual_summary:string,do_not_claim:array<string>,duration_seconds:double,scene_complexity:string,structured:variant>"


def remaining(deadline: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), deadline - now)


def request_timeout(left: Column, configured: Column | float, reserve: float = 1.0) -> Column:
    """Seconds a request may take: null if none are configured or less than one is left."""
    limit = F.lit(float(configured)) if isinstance(configured, int | float) else configured.cast("double")
    available = left - reserve
    return F.when((limit > 0) & (available >= MIN_REQUEST_SECONDS), F.least(limit, available))


def exhausted(left: Column, reserve: float = 1.0) -> Column:
    return left <= reserve


def first_path(url: Column, configured: Column, storyboard_first: Column, left: Column, downloaded: Column, left_after_download: Column) -> Column:
    """How a clip's facts are got.

    ``generic``: nothing can be asked; ``url``: the URL, then the clip itself;
    ``deadline_url``: there is time for one request with the URL, whatever it
    gives; ``download_failed``: the URL, as there are no frames;
    ``storyboard``: frames, then the URL, then the clip itself.  A null time
    left is no limit.
    """
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "generic")
        .when(~configured, "generic")
        .when(~storyboard_first, "url")
        .when(left < FULL_ENSEMBLE_SECONDS, "deadline_url")
        .when(~downloaded, "download_failed")
        .when(left_after_download < POST_DOWNLOAD_SECONDS, "deadline_url")
        .otherwise("storyboard")
    )


def facts(summary: Column, exclusions: Column, duration: Column | None = None, complexity: Column | None = None, structured: Column | None = None) -> Column:
    """A packet; null where the summary is (the request failed)."""
    parts = {"factual_summary": summary, "do_not_claim": exclusions, "duration_seconds": duration, "scene_complexity": complexity, "structured": structured}
    packet = F.struct(*[(F.lit(None) if c is None else c).alias(name) for name, c in parts.items()]).cast(FACTS_DDL)
    return F.when(summary.isNotNull(), packet)


def fallback_facts() -> Column:
    return facts(F.lit(GENERIC_SUMMARY), F.array(F.lit(GENERIC_EXCLUSION)))


def is_fallback(packet: Column) -> Column:
    """The fallback packet and nothing more: a generic summary with facts beside it is an answer."""
    more = reduce(Column.__or__, [packet[name].isNotNull() for name in ("duration_seconds", "scene_complexity", "structured")])
    same = (packet["factual_summary"] == GENERIC_SUMMARY) & (packet["do_not_claim"] == F.array(F.lit(GENERIC_EXCLUSION)))
    return F.coalesce(same & ~more, F.lit(False))


def is_generic(summary: Column) -> Column:
    return F.coalesce(summary == GENERIC_SUMMARY, F.lit(False))


def storyboard_request(duration: Column, frames: Column, transcript: Column, native_video: Column, timeout: Column) -> Column:
    """What is asked with a storyboard (frames: structs with frame_id and data_url); null if there is no time to ask."""
    slim = F.transform(frames, lambda f: F.struct(f["frame_id"].alias("id"), f["data_url"].alias("data_url")))
    fields = {"duration_seconds": duration, "frames": slim, "speech_transcript": transcript, "video_data_url": native_video, "timeout_seconds": timeout}
    return F.when(timeout.isNotNull(), F.struct(*[c.alias(name) for name, c in fields.items()]))


def storyboard_facts(received: Column, duration: Column) -> Column:
    """The facts of a storyboard: the clip's measured duration replaces what the answer says of it."""
    return F.when(received.isNotNull(), received.withField("duration_seconds", duration.cast("double")))


def facts_ladder(path: Column, storyboard: Column, url: Column, base64: Column, size: Column) -> Column:
    """The packet that a clip gets on its path; null packets are requests that failed.

    An answer that is not the fallback ends the ladder.  The clip itself is
    sent only where it is small enough, and the deadline and failed-download
    paths end with the URL.
    """

    def real(packet: Column) -> Column:
        return bound(packet, lambda p: F.when(~is_fallback(p), p))

    small = F.when(size <= MAX_BASE64_BYTES, base64)
    steps = {
        "storyboard": [real(storyboard), real(url), real(small)],
        "url": [real(url), real(small)],
        "deadline_url": [url],
        "download_failed": [url],
    }
    chosen = F.when(path == "generic", fallback_facts())
    for name, packets in steps.items():
        chosen = chosen.when(path == name, F.coalesce(*packets, fallback_facts()))
    return chosen


def native_video(left: Column, size: Column, transcoded_size: Column) -> Column:
    """original, transcoded or omitted."""
    return (
        F.when(left < NATIVE_VIDEO_SECONDS, "omitted")
        .when((size > 0) & (size <= MAX_NATIVE_BYTES), "original")
        .when((size > 0) & (transcoded_size > 0) & (transcoded_size <= MAX_NATIVE_BYTES), "transcoded")
        .otherwise("omitted")
    )


def transcript(left: Column, gate_reason: Column, received: Column) -> Column:
    """The transcript if there was time, the gate let the audio pass and it came back; failures are null."""
    return F.when((left >= AUDIO_SECONDS + AUDIO_RESERVE_SECONDS) & gate_reason.isNull(), received)


def style_outcome(first_caption: Column, first_error: Column, second_caption: Column, second_error: Column, style: Column) -> Column:
    """used_first, used_second or fallback: only a transient error is tried again, a bad caption is not."""

    def clean(c: Column) -> Column:
        return F.size(lint_reasons(c, style)) == 0

    return (
        F.when(first_error.isNull(), F.when(clean(first_caption), "used_first").otherwise("fallback"))
        .when(is_transient(first_error) & second_error.isNull() & clean(second_caption), "used_second")
        .otherwise("fallback")
    )


def isolated(rows: DataFrame, error: str, result: str, fallback: Column) -> DataFrame:
    """A row that failed keeps its place with the fallback as its result."""
    return rows.withColumn(result, F.when(F.col(error).isNotNull(), fallback).otherwise(F.col(result)))


def timings(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Per task: seconds of perception, styling and in all, its calls in order and the last one's model."""

    def took(stage: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("seconds"))), F.lit(0.0)).alias(f"{stage}_seconds")

    calls = F.transform(F.array_sort(F.collect_list(F.struct("seq", "model"))), lambda x: x["model"])
    return events.groupBy(key).agg(took("perception"), took("style"), F.sum("seconds").alias("total_seconds"), calls.alias("calls"), F.max_by("model", "seq").alias("last_model"))
