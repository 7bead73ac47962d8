"""A clip's storyboard: gate, scenes, budget, candidates on the sampled stream, distinct frames, final choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolglass.operators.timeline import MAX_FRAMES, admissible_frame, candidate_pool, choose_frames, desired_frames, distinct_frames, frame_id, quantized, scene_times, thumbnail_print, valid_duration


def plan(clips: DataFrame, max_frames: int = MAX_FRAMES) -> DataFrame:
    """clip_id, frame, ts, kind, width, desired: the frames to extract of clips with duration and scene_log."""
    clips = clips.filter(valid_duration(F.col("duration"))).select("clip_id", "duration", scene_times(F.coalesce("scene_log", F.lit("")), F.col("duration")).alias("scenes"))
    clips = clips.withColumn("desired", desired_frames(F.col("duration"), F.size("scenes"), max_frames))
    return quantized(candidate_pool(clips), clips).join(clips.select("clip_id", "desired"), "clip_id")


def select(extracted: DataFrame) -> DataFrame:
    """clip_id and frames, the storyboard, of extracted frames (clip_id, ts, kind, jpeg, gray, desired).

    Only the thumbnail's fingerprint goes through the shuffle, the picture is
    joined on at the sink by clip and frame_id.
    """
    rows = extracted.filter(admissible_frame(F.col("jpeg"), F.col("gray")))
    rows = rows.select("clip_id", "desired", F.struct("ts", F.col("kind").alias("kind"), frame_id(F.col("ts")).alias("frame_id"), thumbnail_print(F.col("gray")).alias("print")).alias("f"))
    clips = rows.groupBy("clip_id").agg(F.collect_list("f").alias("frames"), F.max("desired").alias("desired"))
    kept = clips.select("clip_id", "desired", distinct_frames(F.col("frames")).alias("kept"))
    slim = F.transform("kept", lambda f: F.struct(f["ts"].alias("ts"), f["kind"].alias("kind"), f["frame_id"].alias("frame_id")))
    return kept.select("clip_id", "desired", slim.alias("kept")).select("clip_id", choose_frames(F.col("kept"), F.col("desired")).alias("frames"))
