"""Captions of tasks: lint, completion by fallbacks, missing ones, diversity."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolglass.functions.matching import ratios
from spoolglass.functions.text import avoid_excerpt, clean_summary, fallback_caption, lint_reasons, similarity, stripped
from spoolglass.plans.ladder import exhausted

DIVERSITY_THRESHOLD = 0.72
REPAIR_MARGIN = 0.03
#: Captions that a repair is told to keep away from, at most.
MAX_AVOIDED = 3
FORMAL = "formal"
#: Groups of captions that a worker repairs side by side.
GROUPS_AT_ONCE = 256


def requested(tasks: DataFrame) -> DataFrame:
    """idx, task_id, style_pos, style: one row for each style a task asks for; of repeated styles the first."""
    rows = tasks.select("idx", "task_id", F.posexplode("styles").alias("style_pos", "style"))
    return rows.groupBy("idx", "task_id", "style").agg(F.min("style_pos").alias("style_pos"))


def initial_results(tasks: DataFrame) -> DataFrame:
    """Every requested style with the generic fallback, before anything has run."""
    return requested(tasks).withColumn("caption", fallback_caption(F.col("style"), F.lit(None).cast("string")))


def fallback_captions(tasks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every requested style with the fallback on its task's summary (idx, factual_summary), cleaned once for all styles."""
    cleaned = summaries.select("idx", "factual_summary", clean_summary(F.col("factual_summary")).alias("cleaned"))
    rows = requested(tasks).join(cleaned, "idx", "left")
    base = F.coalesce("cleaned", clean_summary(F.lit(None).cast("string")))
    return rows.select("idx", "task_id", "style_pos", "style", fallback_caption(F.col("style"), F.col("factual_summary"), base).alias("caption"))


def complete_captions(wanted: DataFrame, candidates: DataFrame, keys: list[str], style: str = "style") -> DataFrame:
    """Left join of the wanted styles with candidate captions; those that lint rejects get the fallback.

    wanted has the keys and factual_summary, and may have ``cleaned``, its
    ``clean_summary`` (once for all styles of a task); candidates have the keys
    (unique) and caption.  Returns the keys, caption (stripped) and
    used_fallback.
    """
    judged = candidates.select(*keys, "caption", (F.size(lint_reasons(F.col("caption"), F.col(style))) > 0).alias("used_fallback"))
    rows = wanted.join(judged, keys, "left").withColumn("used_fallback", F.coalesce("used_fallback", F.lit(True)))
    cleaned = F.col("cleaned") if "cleaned" in wanted.columns else None
    fallback = fallback_caption(F.col(style), F.col("factual_summary"), cleaned)
    caption = F.when(F.col("used_fallback"), fallback).otherwise(F.col("caption"))
    return rows.select(*keys, stripped(caption).alias("caption"), "used_fallback")


def missing_captions(wanted: DataFrame, captions: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted styles without a caption that says something."""
    return wanted.join(captions.filter(stripped(F.col("caption")) != "").select(*keys), keys, "left_anti")


def dealt_out(rows: DataFrame, group: str) -> DataFrame:
    """The rows by group over all cores: what is done for each pair is costly, and the texts themselves are too few bytes to be split."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), group)


def caption_pairs(captions: DataFrame, group: str, pos: str, score) -> DataFrame:
    """Pairs of a group's captions in order, with ``score(left, right)``: a self-join on the group."""
    captions = dealt_out(captions, group)
    left = captions.select(group, *[F.col(c).alias(f"left_{c}") for c in captions.columns if c != group])
    right = captions.select(group, *[F.col(c).alias(f"right_{c}") for c in captions.columns if c != group])
    pairs = left.join(right, group).filter(F.col(f"left_{pos}") < F.col(f"right_{pos}"))
    return pairs.withColumn("score", score(F.col("left_caption"), F.col("right_caption")))


def repair_targets(captions: DataFrame, *, group: str = "task_id", pos: str = "style_pos", threshold: float = DIVERSITY_THRESHOLD, score=similarity) -> DataFrame:
    """Styles to render anew because two captions are alike: the right one, or the left one if the right is formal.

    Returns group, style and rank, in the order in which the pairs are seen.
    """
    pairs = caption_pairs(captions.select(group, pos, "style", "caption"), group, pos, score).filter(F.col("score") >= threshold)
    target = F.when(F.col("right_style") == FORMAL, F.col("left_style")).otherwise(F.col("right_style"))
    seen = pairs.groupBy(group, target.alias("style")).agg(F.min(F.struct(f"left_{pos}", f"right_{pos}")).alias("seen"))
    return seen.select(group, "style", F.row_number().over(Window.partitionBy(group).orderBy("seen")).alias("rank"))


def most_similar(captions: DataFrame, *, group: str = "task_id", pos: str = "style_pos", score=similarity) -> DataFrame:
    """group, pos, most: each caption's greatest similarity to another of its group."""
    captions = dealt_out(captions, group)
    other = captions.select(group, F.col(pos).alias("_pos"), F.col("caption").alias("_caption"))
    pairs = captions.join(other, group).filter(F.col(pos) != F.col("_pos"))
    return pairs.groupBy(group, pos).agg(F.max(score(F.col("caption"), F.col("_caption"))).alias("most"))


def accepts_repair(clean: Column, new_similarity: Column, old_similarity: Column) -> Column:
    """A repaired caption replaces the old one if lint is clean and it is clearly less alike."""
    return clean & (new_similarity + REPAIR_MARGIN < old_similarity)


def avoided_captions(captions: DataFrame, targets: DataFrame, *, group: str = "task_id", pos: str = "style_pos") -> DataFrame:
    """group, style, avoid: for each target (group, style) the excerpts of its group's first other captions, in order."""
    own = captions.select(group, F.struct(pos, F.col("style").alias("of"), avoid_excerpt(F.col("caption")).alias("excerpt")).alias("x"))
    rows = targets.select(group, "style").join(own, group).filter(F.col("style") != F.col("x.of"))
    first = F.slice(F.array_sort(F.collect_list("x")), 1, MAX_AVOIDED)
    return rows.groupBy(group, "style").agg(F.transform(first, lambda x: x["excerpt"]).alias("avoid"))


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """``similarity`` of each pair, on a worker."""
    tokens = [(a.lower().split(), b.lower().split()) for a, b in pairs]
    alike = np.maximum(ratios([(" ".join(a), " ".join(b)) for a, b in tokens]), ratios(tokens)).tolist()
    starts = [[x == y for x, y in zip(a[:8], b[:8], strict=False)] for a, b in tokens]
    return [max(x, (same.index(False) if False in same else len(same)) / max(1, len(same))) for x, same in zip(alike, starts, strict=True)]


def repaired(captions: DataFrame, proposals: DataFrame, *, group: str = "task_id", threshold: float = DIVERSITY_THRESHOLD) -> DataFrame:
    """Apply proposed captions one after the other: each is judged against what earlier repairs have left.

    captions: group, style_pos, style, caption; proposals: group, style,
    caption, and may have ``left``, the seconds that were left when the repair
    began (null: no limit): the first repair without time ends a group's
    repairs.  A group is a task's few styles, so a group fits a row.
    """
    late = F.coalesce(exhausted(F.col("left")), F.lit(False)) if "left" in proposals.columns else F.lit(False)
    found = F.collect_list(F.struct("style", F.col("caption").alias("proposed"), (F.size(lint_reasons(F.col("caption"), F.col("style"))) == 0).alias("clean"), late.alias("late")))
    own = dealt_out(captions, group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("style_pos", "style", "caption"))).alias("own"))
    rows = own.join(proposals.groupBy(group).agg(found.alias("offers")), group, "left")
    kind = captions.schema[group].dataType.simpleString()

    def repairs(order: list[str], now: dict[str, str], offered: dict[str, dict]) -> Generator[list[tuple[str, str]], list[float], None]:
        """The repairs of a group, made in ``now``; yields the pairs whose likeness it has to know next."""
        seen = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
        scores = yield [(now[a], now[b]) for a, b in seen]
        for style in dict.fromkeys(a if b == FORMAL else b for (a, b), score in zip(seen, scores, strict=True) if score >= threshold):
            offer = offered.get(style)
            if offer is not None and offer["late"]:
                break
            others = [now[s] for s in order if s != style]
            if offer is not None and offer["clean"] and others:
                scores = yield [(c, o) for c in (now[style], offer["proposed"]) for o in others]
                old, new = max(scores[: len(others)]), max(scores[len(others) :])
                if new + REPAIR_MARGIN < old:
                    now[style] = offer["proposed"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), GROUPS_AT_ONCE):
                groups, going = [], []
                for key, own, offers in whole.iloc[at : at + GROUPS_AT_ONCE].itertuples(index=False):
                    order, now = [x["style"] for x in own], {x["style"]: x["caption"] for x in own}
                    groups.append((key, order, {x["style"]: x["style_pos"] for x in own}, now))
                    steps = repairs(order, now, {x["style"]: x for x in offers} if offers is not None else {})
                    going.append((steps, next(steps), {}))
                # One step of all groups at a time, so that their pairs are scored together, each once.
                while going:
                    asked = [(known, pair) for _, pairs, known in going for pair in dict.fromkeys(pairs) if pair not in known]
                    for (known, pair), score in zip(asked, likeness([pair for _, pair in asked]), strict=True):
                        known[pair] = score
                    still = []
                    for steps, pairs, known in going:
                        with suppress(StopIteration):
                            still.append((steps, steps.send([known[pair] for pair in pairs]), known))
                    going = still
                out = [(key, pos[s], s, now[s]) for key, order, pos, now in groups for s in order]
                yield pd.DataFrame(out, columns=[group, "style_pos", "style", "caption"])

    return rows.mapInPandas(run, f"{group} {kind}, style_pos int, style string, caption string")
