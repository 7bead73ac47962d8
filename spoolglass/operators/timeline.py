"""Timelines of clips: frame budgets, candidates, gaps, duplicates and the choice of frames.

A clip is a row with its duration and an array of scene times; candidate and
frame lists are bounded (some tens), so they are arrays and folds, not joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from spoolglass.functions.arrays import hamming, min_gap, spread, spread_places

MAX_FRAMES, MIN_FRAMES, MAX_FRAME_BYTES, THUMBNAIL_BYTES = 30, 1, 640 * 1024, 256
NEAR_DUPLICATE_BITS, SAMPLE_FPS = 8, 8
SCENE_MARGIN, SCENE_GAP = 0.05, 0.35
MIN_DURATION, MAX_DURATION = 0.1, 600.0
RANKS = {"uniform": 0, "burst": 1, "scene": 2, "key": 3}
WIDTH, KEY_WIDTH = 704, 1_024


def valid_duration(c: Column) -> Column:
    return F.coalesce(c.between(MIN_DURATION, MAX_DURATION), F.lit(False))


def scene_times(log: Column, duration: Column, gap: float = SCENE_GAP) -> Column:
    """Scene changes in a decoder's log: inside the clip's margins, rounded to milliseconds, ``gap`` apart."""
    found = F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda s: s.cast("double"))
    inside = F.filter(found, lambda t: (t > SCENE_MARGIN) & (t < duration - SCENE_MARGIN))
    return min_gap(F.transform(inside, lambda t: F.bround(t, 3)), gap)


def desired_frames(duration: Column, scenes: Column, maximum: Column | int = MAX_FRAMES) -> Column:
    """How many frames a clip of a duration and number of scene changes gets."""
    target = F.when(duration <= 10, 14).when(duration <= 30, 18).when(duration <= 60, 22).when(duration <= 120, 26).otherwise(28)
    few = F.when(duration <= 30, 14).otherwise(18)
    some = F.when(duration <= 30, 18).when(duration <= 120, 22).otherwise(24)
    target = F.when(scenes <= 1, F.least(target, few)).when(scenes <= 3, F.least(target, some)).when(scenes >= 12, 30).when(scenes >= 6, target + 2).otherwise(target)
    most = F.lit(maximum) if isinstance(maximum, int) else maximum
    return F.least(most, F.greatest(F.lit(MIN_FRAMES), target))


def rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), kind)


def candidate(ts: Column, kind: str, width: int = WIDTH) -> Column:
    return F.struct(ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(width).alias("width"))


def _anchors(duration: Column, scenes: Column, n: Column) -> Column:
    """Evenly spread scenes, or even parts of the clip if it has none."""
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: duration * (i + 1) / (n + 1))
    return F.when(F.size(scenes) > 0, spread(scenes, n)).otherwise(even)


def candidate_list(duration: Column, scenes: Column, desired: Column) -> Column:
    """All candidates in the order in which they are made: uniform, scene, burst, key."""
    n = desired + 8
    uniform = F.transform(F.sequence(F.lit(0), n - 1), lambda i: candidate(duration * (i + 0.5) / n, "uniform"))
    scene = F.transform(spread(scenes, F.least(F.lit(12), F.greatest(F.lit(2), F.floor(desired / 3).cast("int")))), lambda t: candidate(t, "scene"))
    offset = F.least(F.lit(0.35), F.greatest(F.lit(0.12), duration / 240))
    bursts = _anchors(duration, scenes, F.when(desired >= 22, 3).otherwise(2))
    burst = F.flatten(F.transform(bursts, lambda a: F.transform(F.array(-offset, offset), lambda o: candidate(F.least(duration - 0.02, F.greatest(F.lit(0.02), a + o)), "burst"))))
    key = F.transform(_anchors(duration, scenes, F.when(duration <= 30, 3).when(duration <= 60, 4).otherwise(5)), lambda t: candidate(t, "key", KEY_WIDTH))
    return F.concat(uniform, scene, burst, key)


def best_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of candidates with equal keys the one of highest rank, the first made among those: combined before the shuffle."""
    kept = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*kept), F.struct(rank(F.col("kind")), -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def candidate_pool(clips: DataFrame, clip: str = "clip_id") -> DataFrame:
    """clip, ms, ord, ts, kind, width of clips with duration, scenes and desired: one candidate per millisecond."""
    rows = clips.select(clip, F.posexplode(candidate_list(F.col("duration"), F.col("scenes"), F.col("desired"))).alias("ord", "c")).select(clip, "ord", "c.*")
    return best_of(rows.withColumn("ms", F.rint(F.col("ts") * 1000).cast("int")), [clip, "ms"], "ord")


def quantized(pool: DataFrame, durations: DataFrame, clip: str = "clip_id") -> DataFrame:
    """clip, frame, ts, kind, width: candidates on the sampled frames, one per frame; durations has clip and duration."""
    last = F.greatest(F.lit(0), F.floor(F.col("duration") * SAMPLE_FPS).cast("int") - 1)
    rows = pool.join(durations.select(clip, "duration"), clip)
    frame = F.least(last, F.greatest(F.lit(0), F.rint(F.col("ts") * SAMPLE_FPS).cast("int")))
    rows = rows.select(clip, frame.alias("frame"), F.col("ts").alias("asked"), "kind", "width", F.row_number().over(Window.partitionBy(clip).orderBy("ts", "ord")).alias("ord"))
    return best_of(rows, [clip, "frame"], "ord").select(clip, "frame", (F.col("frame") / F.lit(float(SAMPLE_FPS))).alias("ts"), "kind", "width")


def fallback_plan(candidates: DataFrame, clip: str = "clip_id", desired: str = "desired") -> DataFrame:
    """The candidates to seek one by one: all if few, else salient ones first and evenly spread uniform ones."""
    of_clip = Window.partitionBy(clip)
    salient = F.col("kind") != "uniform"
    order = F.when(salient, -rank(F.col("kind"))).otherwise(1)
    rows = candidates.withColumn("n", F.count("*").over(of_clip)).withColumn("n_salient", F.count_if(salient).over(of_clip))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(clip, salient).orderBy(order, "ts")) - 1)
    left = F.greatest(F.lit(0), F.col(desired) - F.col("n_salient"))
    places = spread(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - F.col("n_salient") - 1).cast("int")), left.cast("int"))
    chosen = F.when(salient, F.col("place") < F.col(desired)).otherwise(F.array_contains(places, F.col("place")))
    return rows.filter((F.col("n") <= F.col(desired)) | chosen).drop("n", "n_salient", "place")


def frame_id(ts: Column) -> Column:
    return F.format_string("t%06d", F.rint(ts * 1000).cast("int"))


def admissible_frame(jpeg: Column, thumbnail: Column) -> Column:
    return (F.length(jpeg) > 0) & (F.length(jpeg) <= MAX_FRAME_BYTES) & (F.length(thumbnail) == THUMBNAIL_BYTES)


@F.pandas_udf(ArrayType(LongType()))
def thumbnail_print(gray: pd.Series) -> pd.Series:
    """``bright_bits`` of the bytes of admissible thumbnails."""
    values = np.frombuffer(b"".join(gray), np.uint8).reshape(-1, THUMBNAIL_BYTES)
    bits = values >= values.mean(axis=1, keepdims=True, dtype=np.float64)
    return pd.Series(list(np.packbits(bits, axis=1, bitorder="little").view("<i8")))


def distinct_frames(frames: Column, bits: int = NEAR_DUPLICATE_BITS) -> Column:
    """Frames (structs with ts, ord and print) by time, without those within ``bits`` of any kept before.

    array_sort compares structs field by field: ts and ord come first.
    """
    start = F.slice(frames, 1, 0)
    return F.aggregate(
        F.array_sort(frames),
        start,
        lambda kept, x: F.when(F.exists(kept, lambda k: hamming(k["print"], x["print"]) <= bits), kept).otherwise(F.concat(kept, F.array(x))),
    )


def chosen_places(times: list[float], kinds: list[str], desired: int) -> list[int]:
    """Places of the chosen frames among frames in time order: ends and salient ones, then the farthest from those."""
    n = len(times)
    if n <= desired:
        return list(range(n))

    seeds = [0, n - 1]
    for kind, share in (("key", 6), ("scene", 3), ("burst", 6)):
        own = [i for i in range(n) if kinds[i] == kind]
        seeds += [own[i] for i in spread_places(len(own), max(2, desired // share))]
    chosen = list(dict.fromkeys(seeds))[:desired]
    t, gap = np.array(times), np.full(n, np.inf)
    for i in chosen:
        gap = np.minimum(gap, np.abs(t - t[i]))
    taken = np.zeros(n, bool)
    taken[chosen] = True
    while len(chosen) < desired:
        i = int(np.where(taken, -1.0, gap).argmax())
        chosen.append(i)
        taken[i] = True
        gap = np.minimum(gap, np.abs(t - t[i]))
    return sorted(chosen)


@F.pandas_udf(ArrayType(IntegerType()))
def chosen_udf(times: pd.Series, kinds: pd.Series, desired: pd.Series) -> pd.Series:
    return pd.Series([chosen_places(list(t), list(k), int(d)) for t, k, d in zip(times, kinds, desired, strict=True)])


# To the optimiser it is not deterministic: a filter on its result (explode adds one) would have to run the choice, and all it reads, in itself.
chosen_udf = chosen_udf.asNondeterministic()


def choose_frames(frames: Column, desired: Column) -> Column:
    """``desired`` of the frames (structs with ts first, and kind), by time; of equally far frames the earliest.

    A greedy choice of at most ``MAX_FRAMES`` steps over a clip's few frames,
    in batches of clips: as a fold of array functions it took ten times as long.
    """
    ordered = F.array_sort(frames)
    places = chosen_udf(F.transform(ordered, lambda f: f["ts"]), F.transform(ordered, lambda f: f["kind"]), desired)
    return F.transform(places, lambda i: F.get(ordered, i))


def complete_groups(extracted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """All or nothing: rows of those keys that have all ``expected`` frames with admissible sizes."""
    got = extracted.groupBy(*keys).agg(F.count_if(F.col("admissible")).alias("got"), F.count("*").alias("n"))
    whole = expected.join(got, keys).filter((F.col("got") == F.col("expected")) & (F.col("n") == F.col("expected"))).select(*keys)
    return extracted.join(whole, keys, "left_semi")
