"""Contracts of semi-structured rows, on VARIANT columns: the first broken rule as a message, null if none is.

VARIANT keeps JSON's types, so a number is never taken for a string and ``true``
never for a number; an absent key and a null one stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolglass.functions.arrays import bound
from spoolglass.functions.text import collapsed, stripped

# Fixed values of the contracts.
POLICY_VERSION = "style-spec-v9.7-private-evidence-led-r5-20260712"
PIPELINE_VERSION = "v9.7-private-adaptive-evidence-20260712"
FACT_FIELDS = ("factual_summary", "do_not_claim", "duration_seconds", "scene_complexity", "media_type", "events", "visible_text", "uncertain_details")
STRUCTURED_FIELDS = ("media_type", "events", "visible_text", "uncertain_details")
COMPLEXITIES = ("sustained", "developing", "montage")
SOURCE_KINDS = ("url", "base64", "storyboard", "audio")
STAGES = ("qwen_storyboard", "minimax_storyboard_fallback", "native_video", "reconciliation")
ENSEMBLE_MODES = ("disabled", "conditional", "always")
EVIDENCE = ("speech_used", "speech_context_used", "corroboration_used", "reconciliation_used", "native_video_included")
MAX_DURATION, MAX_PASSES, MAX_EXCERPT, MAX_TRANSCRIPT = 600, 6, 600, 6_000


class Json:
    """A VARIANT column and the questions the contracts ask of it."""

    def __init__(self, c: Column, kind: Column | None = None, fields: dict[str, Json] | None = None) -> None:
        self.c, self.kind, self.fields = c, kind, fields or {}

    def __getitem__(self, key: str) -> Json:
        return self.fields.get(key) or Json(F.call_function("variant_get", self.c, F.lit(f"$.{key}")))

    @property
    def type(self) -> Column:
        return F.coalesce(F.schema_of_variant(self.c), F.lit("ABSENT")) if self.kind is None else self.kind

    @property
    def present(self) -> Column:
        return self.c.isNotNull()

    @property
    def none(self) -> Column:
        """Absent or null."""
        return self.type.isin("ABSENT", "VOID")

    @property
    def is_object(self) -> Column:
        return self.type.startswith("OBJECT")

    @property
    def is_array(self) -> Column:
        return self.type.startswith("ARRAY")

    @property
    def is_string(self) -> Column:
        return self.type == "STRING"

    @property
    def is_bool(self) -> Column:
        return self.type == "BOOLEAN"

    @property
    def is_int(self) -> Column:
        """Integers beyond 64 bits are decimals of 19 digits or more; shorter ones without a scale were written as ``1.0``."""
        return self.type.rlike(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$")

    @property
    def is_number(self) -> Column:
        return self.is_int | self.type.rlike("^(DOUBLE|FLOAT|DECIMAL)")

    @property
    def text(self) -> Column:
        return F.when(self.is_string, F.try_variant_get(self.c, "$", "string"))

    @property
    def number(self) -> Column:
        return F.when(self.is_number, F.try_variant_get(self.c, "$", "double"))

    @property
    def flag(self) -> Column:
        return F.when(self.is_bool, F.try_variant_get(self.c, "$", "boolean"))

    @property
    def said(self) -> Column:
        """A string that is not blank."""
        return F.coalesce(stripped(self.text) != "", F.lit(False))

    @property
    def items(self) -> Column:
        return F.coalesce(F.when(self.is_array, F.try_variant_get(self.c, "$", "array<variant>")), F.array().cast("array<variant>"))

    @property
    def keys(self) -> Column:
        found = F.when(self.is_object, F.map_keys(F.try_variant_get(self.c, "$", "map<string,variant>")))
        return F.coalesce(found, F.array().cast("array<string>"))


def opened(value: Column, keys: tuple[str, ...], body: Callable[[Json], Column]) -> Column:
    """``body`` of a VARIANT that is parsed once, with these fields and their types read once, however often it asks."""

    def read(c: Column) -> Column:
        v = Json(c)
        return F.struct(c.alias("v"), v.type.alias("t"), *[x for k in keys for x in (v[k].c.alias(f"v_{k}"), v[k].type.alias(f"t_{k}"))])

    return bound(value, lambda c: bound(read(c), lambda x: body(Json(x["v"], x["t"], {k: Json(x[f"v_{k}"], x[f"t_{k}"]) for k in keys}))))


def first_broken(rules: list[tuple[Column, Column | str]]) -> Column:
    """The message of the first rule that is broken."""
    out = None
    for broken, message in rules:
        text = message if isinstance(message, Column) else F.lit(message)
        broken = F.coalesce(broken, F.lit(False))
        out = F.when(broken, text) if out is None else out.when(broken, text)
    return out


def sentence(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def task_error(task: Column, index: Column) -> Column:
    return opened(task, ("task_id", "video_url", "styles"), lambda t: _task_error(t, index.cast("string")))


def _task_error(t: Json, at: Column) -> Column:
    name = t["task_id"].text
    styles = t["styles"]
    return first_broken(
        [
            (~t.is_object, sentence("task at index ", at, " must be an object")),
            (~t["task_id"].said, sentence("task at index ", at, " must include task_id")),
            (~t["video_url"].said, sentence("task ", name, " must include video_url")),
            (~styles.is_array | (F.size(styles.items) == 0), sentence("task ", name, " must include styles")),
            (~F.forall(styles.items, lambda s: Json(s).said), sentence("task ", name, " styles must be strings")),
        ]
    )


def result_error(result: Column, index: Column, task_id: Column, styles: Column) -> Column:
    """A result against the task at the same position: its id and the array of styles it asked for."""
    return opened(result, ("task_id", "captions"), lambda r: _result_error(r, index.cast("string"), task_id, styles))


def _result_error(r: Json, at: Column, task_id: Column, styles: Column) -> Column:
    given = F.coalesce(F.when(r["captions"].is_object, F.try_variant_get(r["captions"].c, "$", "map<string,variant>")), F.create_map().cast("map<string,variant>"))
    lacking = F.filter(styles, lambda s: ~Json(F.try_element_at(given, s)).said)
    return first_broken(
        [
            (~r.is_object, sentence("result at index ", at, " must be an object")),
            (~r["task_id"].said, sentence("result at index ", at, " must include task_id")),
            (~r["task_id"].text.eqNullSafe(task_id), sentence("result at index ", at, " has unexpected task_id")),
            (~r["captions"].is_object, sentence("result ", r["task_id"].text, " must include captions")),
            (F.size(lacking) > 0, sentence("result ", r["task_id"].text, " missing caption for ", F.get(lacking, F.lit(0)))),
        ]
    )


def task_rows(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, idx, task (VARIANT), error: the tasks of each JSON array, with the first broken rule of each.

    A payload that is not an array gives one row without idx.
    """
    parsed = payloads.select(key, F.try_parse_json(F.col(payload)).alias("v"))
    v = Json(F.col("v"))
    rows = parsed.withColumn("items", F.when(v.is_array, v.items)).select(key, "items", F.posexplode_outer("items").alias("idx", "task"))
    broken = F.when(F.col("items").isNull(), F.lit("tasks.json must contain a JSON array")).otherwise(F.when(F.col("idx").isNotNull(), task_error(F.col("task"), F.col("idx"))))
    return rows.select(key, "idx", "task", broken.alias("error")).filter(F.col("idx").isNotNull() | F.col("error").isNotNull())


def first_error(rows: DataFrame, key: str, index: str = "idx", error: str = "error") -> DataFrame:
    """key, error: the first error by position, null where there is none."""
    return rows.groupBy(key).agg(F.min_by(F.col(error), F.when(F.col(error).isNotNull(), F.coalesce(F.col(index), F.lit(-1)))).alias(error))


def facts_error(facts: Column) -> Column:
    return opened(facts, ("factual_summary", "do_not_claim", "duration_seconds", "scene_complexity"), _facts_error)


def _facts_error(v: Json) -> Column:
    duration, complexity = v["duration_seconds"], v["scene_complexity"]
    present = F.size(F.array_intersect(v.keys, F.array(*map(F.lit, STRUCTURED_FIELDS))))
    return first_broken(
        [
            (~v.is_object, "proxy response missing facts"),
            (F.size(F.array_except(v.keys, F.array(*map(F.lit, FACT_FIELDS)))) > 0, "proxy response contains unknown fact fields"),
            (~v["factual_summary"].said | ~v["do_not_claim"].is_array, "proxy response contains invalid facts"),
            (~F.forall(v["do_not_claim"].items, lambda x: Json(x).said), "proxy response contains invalid do_not_claim values"),
            (~duration.none & (~duration.is_number | (duration.number <= 0) | (duration.number > MAX_DURATION)), "proxy response contains invalid duration_seconds"),
            (~complexity.none & ~F.coalesce(complexity.text.isin(*COMPLEXITIES), F.lit(False)), "proxy response contains invalid scene_complexity"),
            ((present > 0) & (present < len(STRUCTURED_FIELDS)), "proxy response contains incomplete structured facts"),
        ]
    )


def normal_facts(facts: Column) -> Column:
    """Facts without errors as a struct: strings stripped, the free fields kept as they are."""
    v = Json(facts)
    exclusions = F.transform(v["do_not_claim"].items, lambda x: stripped(Json(x).text))
    free = [v[f].c.alias(f) for f in STRUCTURED_FIELDS]
    return F.struct(stripped(v["factual_summary"].text).alias("factual_summary"), exclusions.alias("do_not_claim"), v["duration_seconds"].number.alias("duration_seconds"), v["scene_complexity"].text.alias("scene_complexity"), *free)


ATTEMPT_FIELDS = ("model", "outcome", "error", "validation_error", "finish_reason", "prompt_tokens", "completion_tokens", "reasoning_tokens", "audio_seconds", "cost_usd", "duration_ms", "stage", "response_excerpt")


def attempt_error(attempt: Column) -> Column:
    return opened(attempt, ATTEMPT_FIELDS, _attempt_error)


def _attempt_error(v: Json) -> Column:
    outcome, error, code = v["outcome"], v["error"], v["validation_error"]
    counts = [v[k] for k in ("prompt_tokens", "completion_tokens", "reasoning_tokens")]
    costs = [v[k] for k in ("audio_seconds", "cost_usd")]
    excerpt, duration = v["response_excerpt"], v["duration_ms"]

    def any_of(found: list[Column]) -> Column:
        return F.exists(F.array(*[F.coalesce(f, F.lit(False)) for f in found]), lambda x: x)

    return first_broken(
        [
            (~v.is_object, "proxy response contains invalid attempt metadata"),
            (~v["model"].said | ~F.coalesce(outcome.text.isin("used", "failed"), F.lit(False)), "proxy response contains invalid attempt metadata"),
            (~error.none & ~F.coalesce(error.text.startswith("upstream_"), F.lit(False)), "proxy response contains invalid attempt error metadata"),
            ((outcome.text == "used") & ~error.none, "proxy response contains inconsistent attempt metadata"),
            ((outcome.text == "failed") & error.none, "proxy response contains inconsistent attempt metadata"),
            (~code.none & ~F.coalesce(code.text.rlike(r"(?U)^_*[\p{Alnum}][\p{Alnum}_]*\z"), F.lit(False)), "proxy response contains invalid validation metadata"),
            (~code.none & ~error.text.eqNullSafe("upstream_invalid_caption"), "proxy response contains inconsistent validation metadata"),
            (~v["finish_reason"].none & ~v["finish_reason"].said, "proxy response contains invalid finish metadata"),
            (any_of([~c.none & (~c.is_int | (c.number < 0)) for c in counts]), "proxy response contains invalid token metadata"),
            (~duration.is_int | (duration.number < 0), "proxy response contains invalid attempt duration metadata"),
            (any_of([~c.none & (~c.is_number | (c.number < 0)) for c in costs]), "proxy response contains invalid cost metadata"),
            (~v["stage"].none & ~F.coalesce(v["stage"].text.isin(*STAGES), F.lit(False)), "proxy response contains invalid attempt stage metadata"),
            (~excerpt.none & (~excerpt.said | (F.length(excerpt.text) > MAX_EXCERPT)), "proxy response contains invalid attempt excerpt metadata"),
        ]
    )


METADATA_FIELDS = ("policy_version", "pipeline_version", "model", "fallback_used", "attempts", "perception_passes", "source_kind", "ensemble_mode", *EVIDENCE)


def metadata_error(response: Column, expected_source: str | None = None) -> Column:
    def judged(a: Column) -> Column:
        return F.struct(Json(a)["outcome"].text.alias("outcome"), stripped(Json(a)["model"].text).alias("model"), attempt_error(a).alias("error"))

    def of(v: Json) -> Column:
        lists = F.struct(*[F.transform(v[k].items, judged).alias(k) for k in ("attempts", "perception_passes")])
        return bound(lists, lambda x: _metadata_error(v, x["attempts"], x["perception_passes"], expected_source))

    return opened(response, METADATA_FIELDS, of)


def _metadata_error(v: Json, tried: Column, passed: Column, expected_source: str | None) -> Column:
    """tried and passed: outcome, model and error of each of the attempts and passes."""
    attempts, passes, kind = v["attempts"], v["perception_passes"], v["source_kind"]
    outcomes, models = F.transform(tried, lambda a: a["outcome"]), F.transform(tried, lambda a: a["model"])
    attempt_errors, pass_errors = (F.filter(F.transform(x, lambda a: a["error"]), lambda e: e.isNotNull()) for x in (tried, passed))
    used = F.filter(outcomes, lambda o: o == "used")
    last, first = F.try_element_at(models, F.lit(-1)), F.try_element_at(models, F.lit(1))
    inconsistent = "proxy response contains inconsistent evidence metadata"
    flag = {f: F.coalesce(v[f].flag, F.lit(False)) for f in EVIDENCE}
    rules: list[tuple[Column, Column | str]] = [
        (~v["policy_version"].text.eqNullSafe(POLICY_VERSION), sentence(f"proxy policy mismatch: expected {POLICY_VERSION}, received ", F.coalesce(F.nullif(v["policy_version"].text, F.lit("")), F.lit("missing")))),
        (~v["pipeline_version"].text.eqNullSafe(PIPELINE_VERSION), sentence(f"proxy pipeline mismatch: expected {PIPELINE_VERSION}, received ", F.coalesce(F.nullif(v["pipeline_version"].text, F.lit("")), F.lit("missing")))),
        (~v["model"].said, "proxy response missing model metadata"),
        (~v["fallback_used"].is_bool, "proxy response missing fallback metadata"),
        (~attempts.is_array | (F.size(tried) == 0), "proxy response missing attempt metadata"),
        (F.size(attempt_errors) > 0, F.get(attempt_errors, F.lit(0))),
        ((F.size(used) != 1) | ~F.try_element_at(outcomes, F.lit(-1)).eqNullSafe("used"), "proxy response contains inconsistent attempt metadata"),
        (~last.eqNullSafe(stripped(v["model"].text)) | (v["fallback_used"].flag != (last != first)), "proxy response contains inconsistent model metadata"),
    ]
    if expected_source is not None:
        rules.append((~kind.text.eqNullSafe(expected_source), "proxy response contains inconsistent source metadata"))
    rules += [
        (~kind.none & ~F.coalesce(kind.text.isin(*SOURCE_KINDS), F.lit(False)), "proxy response contains invalid source metadata"),
        (passes.present & ~passes.is_array, "proxy response contains invalid perception pass metadata"),
        (F.size(pass_errors) > 0, F.get(pass_errors, F.lit(0))),
    ]
    if expected_source == "storyboard":
        rules += [
            (~F.exists(passed, lambda a: a["outcome"] == "used"), "proxy response missing storyboard pass metadata"),
            (F.size(passed) > MAX_PASSES, "proxy response contains too many storyboard passes"),
            (F.exists(F.array(*[v[f].c.isNull() for f in EVIDENCE if f != "reconciliation_used"]), lambda x: x), "proxy response missing evidence metadata"),
        ]
    rules += [
        (F.exists(F.array(*[v[f].present & ~v[f].is_bool for f in EVIDENCE]), lambda x: x), "proxy response contains invalid evidence metadata"),
        (v["ensemble_mode"].present & ~F.coalesce(v["ensemble_mode"].text.isin(*ENSEMBLE_MODES), F.lit(False)), "proxy response contains invalid ensemble metadata"),
    ]
    if expected_source != "storyboard":
        rules.append((F.exists(F.array(*flag.values()), lambda x: x), inconsistent))
    rules += [
        (flag["speech_context_used"] & ~flag["speech_used"], inconsistent),
        (flag["reconciliation_used"] & ~flag["corroboration_used"], "proxy response contains inconsistent ensemble metadata"),
    ]
    return first_broken(rules)


def source_error(video_url: Column, video_data_url: Column) -> Column:
    """Exactly one of the two sources has to be given (blank counts as none)."""
    given = [F.coalesce(c != "", F.lit(False)) for c in (video_url, video_data_url)]
    return F.when(given[0] == given[1], F.lit("exactly one video source is required"))


def transcript_received(transcript: Column) -> Column:
    """A transcript as it is kept: white space collapsed, blank as null; see ``transcript_error`` for its limit."""
    return F.nullif(collapsed(transcript), F.lit(""))


def transcript_error(transcript: Column, sending: bool = False) -> Column:
    t = collapsed(transcript)
    if sending:
        return F.when((F.coalesce(transcript, F.lit("")) != "") & ((t == "") | (F.length(t) > MAX_TRANSCRIPT)), F.lit("speech transcript is invalid"))
    return F.when(transcript.isNull(), F.lit("proxy response missing transcript")).when(F.length(t) > MAX_TRANSCRIPT, F.lit("proxy response transcript is oversized"))


def data_url_error(url: Column, kind: str) -> Column:
    """``video``: base64 declared in the first 100 characters; ``audio``: WAV."""
    if kind == "audio":
        return F.when(~F.startswith(url, F.lit("data:audio/wav;base64,")), F.lit("speech audio must be a WAV data URL"))
    ok = F.startswith(url, F.lit("data:video/")) & F.contains(F.left(url, F.lit(100)), F.lit(";base64,"))
    return F.when((url != "") & ~ok, F.lit("native video must be a video data URL"))


def pair_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Full outer join by position: (idx, task_id, styles) with (idx, result); one row per position and its error."""
    rows = tasks.join(results.withColumn("has_result", F.lit(True)), "idx", "full_outer")
    unpaired = F.when(F.col("task_id").isNull() | F.col("has_result").isNull(), F.lit("result count must match task count"))
    return rows.withColumn("error", F.coalesce(unpaired, result_error(F.col("result"), F.col("idx"), F.col("task_id"), F.col("styles"))))


def attempt_summary(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """Per response: attempts, used ones, first and last model, tokens and cost, and whether they are consistent."""
    used = F.col("outcome") == "used"
    rows = attempts.groupBy(key).agg(
        F.count("*").alias("n_attempts"),
        F.count_if(used).alias("n_used"),
        F.min_by("model", order).alias("first_model"),
        F.max_by("model", order).alias("last_model"),
        F.max_by("outcome", order).alias("last_outcome"),
    )
    ok = (F.col("n_used") == 1) & (F.col("last_outcome") == "used")
    return rows.withColumn("consistent", ok).withColumn("fallback_used", F.col("first_model") != F.col("last_model"))
