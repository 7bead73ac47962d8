"""Registered queries of the caption engine over the driver's tables.

Documents stand for captions and summaries, orders for tasks, line items for
candidate captions, events for a clip's timeline, audio frames and updates.
``oracles.py`` has the SQL for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolglass import samples
from spoolglass.functions import text as T
from spoolglass.functions.arrays import min_gap, spread
from spoolglass.operators import captions as C
from spoolglass.operators import contracts as K
from spoolglass.operators import signal as S
from spoolglass.operators import timeline as L
from spoolglass.plans import ladder as P
from spoolglass.plans import storyboard
from spoolglass.sources import files, urls
from spoolglass.streaming.progress import latest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "documents":
        return df
    # Text functions are the work here: a file of few row groups is dealt out to all cores, a large table stays as it is.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# ---- captions and summaries


@query
def caption_word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"), T.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query
def caption_lint_reasons(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.lint_reasons(F.col("text")), "; ").alias("reasons"))


@query
def caption_lint_summary(spark, sf):
    reasons = F.explode_outer(T.lint_reasons(F.col("text")))
    return table(spark, sf, "documents").select("lang", reasons.alias("reason")).groupBy("lang", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query
def caption_lint_dialogue(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.lint_reasons(F.col("text"), F.col("role")), "; ").alias("reasons"))


@query
def style_prefix_check(spark, sf):
    kind = F.col("doc_id") % 5
    head = F.when(kind == 0, "Formal: ").when(kind == 1, " humorous-TECH\t: ").when(kind == 2, F.concat(F.upper("source"), F.lit(": "))).when(kind == 3, F.concat(F.lpad("source", 33, "x"), F.lit(": "))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", T.has_style_prefix(F.concat(head, F.col("text")), F.col("source")).alias("prefixed"))


@query
def sentence_stats(spark, sf):
    parts = T.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(parts).cast("long").alias("n_sentences"), F.md5(F.array_join(parts, "|").cast("binary")).alias("sentences_md5"))


@query
def clean_summary_stats(spark, sf):
    summary = T.clean_summary(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(summary.cast("binary")).alias("summary_md5"), T.token_count(summary).cast("long").alias("n_tokens"))


@query
def fallback_captions(spark, sf):
    styles = F.explode(F.array(*map(F.lit, (*T.STYLES, "unheard_of"))))
    rows = table(spark, sf, "documents").select("doc_id", "text", styles.alias("style"))
    return rows.select("doc_id", "style", F.md5(T.fallback_caption(F.col("style"), F.col("text")).cast("binary")).alias("caption_md5"))


@query
def avoid_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.avoid_excerpt(F.col("text")).alias("excerpt"))


@query
def initial_results(spark, sf):
    styles = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("formal"), F.lit("sarcastic"), F.lit("formal"))).otherwise(F.array(F.lit("humorous_tech")))
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").cast("string").alias("task_id"), styles.alias("styles"))
    return C.initial_results(tasks).select("idx", "style", F.col("style_pos").cast("long").alias("style_pos"), "caption")


@query
def transient_failures(spark, sf):
    kind = F.col("o_orderkey") % 6
    message = F.when(kind == 0, "proxy returned HTTP 503: busy").when(kind == 1, "Connection RESET by peer").when(kind == 2, "HTTP 404").when(kind == 3, "request timed out").when(kind == 4, "upstream_network_error").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", T.is_transient(message).alias("transient"))


# ---- URLs and sizes


def varied_url() -> Column:
    kind, url = F.col("page_id") % 7, F.col("url")
    tail = F.split(url, "://")[1]
    return (
        F.when(kind == 0, F.concat(F.lit("FTP://"), tail))
        .when(kind == 1, F.concat(F.lit("HTTPS://"), tail))
        .when(kind == 2, F.concat(F.regexp_extract(url, "^[^?#]*", 0), F.lit("/a%20b+c.MP4?x=1.mov")))
        .when(kind == 3, F.concat(F.regexp_extract(url, "^[^?#]*", 0), F.lit("/")))
        .when(kind == 4, F.regexp_extract(url, "^[a-z]+://[^/]*", 0))
        .when(kind == 5, F.concat(F.regexp_extract(url, "^[^?#]*", 0), F.lit("/.webm")))
        .otherwise(url)
    )


@query
def url_scheme_gate(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.admitted(varied_url()).alias("admitted"))


@query
def url_extension(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.extension(varied_url()).alias("extension"))


@query
def clip_label(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.clip_label(varied_url()).alias("label"))


@query
def proxy_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.joined_url(F.concat("url", F.lit("//")), F.lit("//perceive")).alias("joined"))


@query
def redacted_excerpt(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_excerpt(F.col("html"), F.lit("html")).alias("excerpt"))


@query
def data_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(files.data_url(F.col("html").cast("binary"), urls.mime_type(varied_url())).cast("binary")).alias("url_md5"))


@query
def byte_limits(spark, sf):
    size = F.octet_length("html")
    declared = F.when(F.col("page_id") % 3 == 0, F.lit(None).cast("int")).otherwise(size + 100)
    return table(spark, sf, "pages").select("page_id", urls.within_bytes(declared, size, 4_000).alias("within"), urls.analysis_route(size - 1_000, F.lit(3_000)).alias("route"))


# ---- tasks, results and metadata as JSON


@query
def task_errors(spark, sf):
    """Tasks made from orders, each seventh broken in another way."""
    kind, key = F.col("o_orderkey") % 7, F.col("o_orderkey").cast("string")
    task = (
        F.when(kind == 0, F.lit("[1]"))
        .when(kind == 1, F.concat(F.lit('{"task_id":'), key, F.lit(',"video_url":"u","styles":["a"]}')))
        .when(kind == 2, F.concat(F.lit('{"task_id":"'), key, F.lit('","video_url":" ","styles":["a"]}')))
        .when(kind == 3, F.concat(F.lit('{"task_id":"'), key, F.lit('","video_url":"u","styles":[]}')))
        .when(kind == 4, F.concat(F.lit('{"task_id":"'), key, F.lit('","video_url":"u","styles":["a",5]}')))
        .when(kind == 5, F.concat(F.lit('{"task_id":"'), key, F.lit('","video_url":"u"}')))
        .otherwise(F.concat(F.lit('{"task_id":"'), key, F.lit('","video_url":"u","styles":["a","a"],"more":true}')))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", F.parse_json(task).alias("task"))
    return rows.select("o_orderkey", K.task_error(F.col("task"), F.col("o_orderkey")).alias("error"))


@query
def first_task_errors(spark, sf):
    """A customer's orders as one JSON array: the first broken task by position."""
    task = F.struct(
        F.col("o_orderkey").cast("string").alias("task_id"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("u").alias("video_url"), F.array(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("formal")).alias("styles")
    )
    tasks = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", task.alias("t")))), lambda x: x["t"])).alias("payload"))
    return K.first_error(K.task_rows(tasks, "o_custkey", "payload"), "o_custkey").select("o_custkey", "error")


@query
def positional_pairing(spark, sf):
    """Tasks (orders by rank) against results at the same position, some swapped, some lacking a caption."""
    ranks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").cast("string").alias("task_id"))
    tasks = ranks.select("idx", "task_id", F.array(F.lit("formal"), F.lit("sarcastic")).alias("styles"))
    kind = F.col("idx") % 6
    given = F.when(kind == 1, F.concat("task_id", F.lit("x"))).otherwise(F.col("task_id"))
    said = F.when(kind == 2, '"captions":{"formal":"yes"}').when(kind == 3, '"captions":[]').when(kind == 4, '"captions":{"formal":"yes","sarcastic":" "}').otherwise('"captions":{"formal":"yes","sarcastic":"no","more":1}')
    results = ranks.filter(F.col("idx") % 11 != 5).select("idx", F.parse_json(F.concat(F.lit('{"task_id":"'), given, F.lit('",'), said, F.lit("}"))).alias("result"))
    return K.pair_results(tasks, results).select("idx", "error")


@query
def facts_errors(spark, sf):
    kind, n = F.col("event_id") % 9, F.get_json_object("props", "$.k")
    facts = (
        F.when(kind == 0, F.concat(F.lit('{"factual_summary":"s","do_not_claim":[],"k":'), n, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"factual_summary":"s","do_not_claim":[],"duration_seconds":'), (n.cast("int") * 10).cast("string"), F.lit("}")))
        .when(kind == 2, '{"factual_summary":"s","do_not_claim":[],"duration_seconds":true}')
        .when(kind == 3, '{"factual_summary":" ","do_not_claim":[]}')
        .when(kind == 4, '{"factual_summary":"s","do_not_claim":["a",""]}')
        .when(kind == 5, '{"factual_summary":"s","do_not_claim":[],"scene_complexity":"calm"}')
        .when(kind == 6, '{"factual_summary":"s","do_not_claim":[],"events":[],"media_type":null,"visible_text":1}')
        .when(kind == 7, '{"factual_summary":"s","do_not_claim":["a"],"scene_complexity":null,"duration_seconds":600,"events":[],"media_type":null,"visible_text":1,"uncertain_details":{}}')
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", K.facts_error(F.parse_json(facts)).alias("error"))


ATTEMPT = '{"model":"m","outcome":"used","duration_ms":5'


@query
def attempt_errors(spark, sf):
    kind, n = F.col("event_id") % 12, F.get_json_object("props", "$.k")
    failed = '{"model":"m","outcome":"failed","duration_ms":5,"error":"upstream_invalid_caption"'
    tails = [
        F.lit(ATTEMPT + "}"),
        F.concat(F.lit(ATTEMPT + ',"prompt_tokens":'), n, F.lit("}")),
        F.concat(F.lit(ATTEMPT + ',"prompt_tokens":'), n, F.lit(".5}")),
        F.lit(ATTEMPT + ',"reasoning_tokens":true}'),
        F.lit(ATTEMPT + ',"error":"upstream_x"}'),
        F.lit('{"model":"m","outcome":"failed","duration_ms":5}'),
        F.lit(failed + ',"validation_error":"too_short"}'),
        F.lit(failed + ',"validation_error":"___"}'),
        F.concat(F.lit(ATTEMPT + ',"cost_usd":'), n, F.lit(".25}")),
        F.lit(ATTEMPT + ',"stage":"elsewhere"}'),
        F.concat(F.lit(ATTEMPT + ',"response_excerpt":"'), F.repeat(F.lit("x"), (n.cast("int") + 550)), F.lit('"}')),
        F.lit('{"model":"m","outcome":"used","duration_ms":-1}'),
    ]
    attempt = F.element_at(F.array(*tails), (kind + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", K.attempt_error(F.parse_json(attempt)).alias("error"))


@query
def metadata_errors(spark, sf):
    kind = F.col("event_id") % 10
    head = f'{{"policy_version":"{K.POLICY_VERSION}","pipeline_version":"{K.PIPELINE_VERSION}","model":"m","fallback_used":false,"attempts":[{ATTEMPT}}}]'
    board = f',"source_kind":"storyboard","perception_passes":[{ATTEMPT}}}]'
    flags = ',"speech_used":true,"speech_context_used":false,"corroboration_used":false,"native_video_included":false'
    made = [
        head + board + flags + "}",
        head.replace("style-spec", "other") + "}",
        head.replace('"fallback_used":false', '"fallback_used":true') + board + flags + "}",
        head + ',"source_kind":"url"}',
        head + board + "}",
        head + board + flags + ',"reconciliation_used":true}',
        head + board + flags.replace('"speech_used":true', '"speech_used":null') + "}",
        head + board.replace(f"[{ATTEMPT}}}]", "[" + ",".join([ATTEMPT + "}"] * 7) + "]") + flags + "}",
        head.replace('"outcome":"used"', '"outcome":"failed","error":"upstream_x"') + board + flags + "}",
        head + board + flags + ',"ensemble_mode":"never"}',
    ]
    response = F.element_at(F.array(*map(F.lit, made)), (kind + 1).cast("int"))
    # The rules are the work, and a file of many rows has few row groups: the ids are dealt out to all cores.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf, "events").select("event_id").repartition(parts).select("event_id", K.metadata_error(F.parse_json(response), "storyboard").alias("error"))


@query
def json_props_validate(spark, sf):
    v = K.Json(F.try_parse_json(F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", r"(\d+)", '"$1"')).when(F.col("event_id") % 4 == 1, F.substring("props", 1, 5)).otherwise(F.col("props"))))
    verdict = F.when(v.c.isNull(), "broken").when(~v["k"].is_int, "not a count").when(v["k"].number < 50, "low").otherwise("high")
    return table(spark, sf, "events").select("event_id", verdict.alias("verdict"))


@query
def caption_lint_values(spark, sf):
    """Made-up captions that fire each rule, as JSON values of any type."""
    rows = spark.createDataFrame(samples.CAPTIONS, "id int, style string, caption string")
    return rows.select("id", F.array_join(T.lint_value(F.parse_json("caption"), F.col("style")), "; ").alias("reasons"))


@query
def source_checks(spark, sf):
    rows = spark.createDataFrame(samples.SOURCES, "id int, video_url string, video_data_url string, transcript string, media string")
    said = F.col("transcript")
    errors = {"source": K.source_error(F.col("video_url"), F.col("video_data_url")), "received": K.transcript_error(said), "sent": K.transcript_error(said, True), "video": K.data_url_error(F.col("media"), "video"), "audio": K.data_url_error(F.col("media"), "audio")}
    return rows.select("id", *[e.alias(name) for name, e in errors.items()], F.md5(K.transcript_received(said)).alias("kept_md5"))


@query
def frame_checks(spark, sf):
    rows = spark.createDataFrame(samples.FRAMES, "id int, picture int, thumbnail int")
    made = [F.repeat(F.lit("x"), F.col(c)).cast("binary") for c in ("picture", "thumbnail")]
    return rows.select("id", L.admissible_frame(*made).alias("admissible"))


@query
def audio_metadata(spark, sf):
    key = F.col("event_id")
    duration, channels = F.when(key % 5 != 0, (key % 700) / F.lit(1.1)), F.when(key % 7 != 0, key % 40)
    return table(spark, sf, "events").select("event_id", S.audio_metadata_error(duration, channels).alias("error"))


# ---- joins of tasks and captions


@query
def complete_results(spark, sf):
    styles = F.explode(F.array(F.lit("formal"), F.lit("sarcastic"), F.lit("humorous_tech"))).alias("style")
    summary = F.concat(F.lit("An order of status "), F.col("o_orderstatus"), F.lit(" with priority "), F.col("o_orderpriority"), F.lit(" is on the desk."))
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), summary.alias("factual_summary"))
    wanted = tasks.withColumn("cleaned", T.clean_summary(F.col("factual_summary"))).select("*", styles)
    style = F.element_at(F.create_map(F.lit(1), F.lit("formal"), F.lit(2), F.lit("sarcastic"), F.lit(3), F.lit("humorous_tech")), F.col("l_linenumber"))
    said = F.concat(F.lit("The line was returned as "), F.col("l_returnflag"), F.lit(" and shipped"), F.when(F.col("l_linestatus") == "O", " and.").otherwise(" yesterday."))
    lines = table(spark, sf, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("idx"), style.alias("style"), said.alias("caption"))
    return C.complete_captions(wanted, lines.groupBy("idx", "style").agg(F.min("caption").alias("caption")), ["idx", "style"])


@query
def missing_results(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.lit(1).alias("style"))
    said = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("style"), F.when(F.col("l_returnflag") == "A", " ").otherwise("x").alias("caption"))
    return C.missing_captions(wanted, said, ["idx", "style"]).select("idx")


def dialogue_captions(spark, sf) -> DataFrame:
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("The same five words begin "), F.col("text"))).otherwise(F.col("text"))
    style = F.when(F.col("turn") == 2, "formal").otherwise(F.concat(F.lit("s"), F.col("turn").cast("string")))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("style_pos"), style.alias("style"), said.alias("caption"))


@query
def diversity_targets_prefix(spark, sf):
    found = C.repair_targets(dialogue_captions(spark, sf), threshold=0.5, score=T.prefix_similarity)
    return found.select("task_id", "style", F.col("rank").cast("long").alias("rank"))


@query
def most_similar_prefix(spark, sf):
    return C.most_similar(dialogue_captions(spark, sf), score=T.prefix_similarity).select("task_id", "style_pos", F.round("most", 9).alias("most"))


@query
def repair_avoid_lists(spark, sf):
    captions = dialogue_captions(spark, sf)
    found = C.avoided_captions(captions, C.repair_targets(captions, threshold=0.5, score=T.prefix_similarity))
    return found.select("task_id", "style", F.size("avoid").cast("long").alias("n"), F.md5(F.array_join("avoid", "|")).alias("avoid_md5"))


@query
def most_similar(spark, sf):
    """With the full similarity, which no SQL has."""
    return C.most_similar(dialogue_captions(spark, sf)).select("task_id", "style_pos", F.round("most", 9).alias("most"))


@query
def diversity_targets(spark, sf):
    """With the full similarity, which no SQL has."""
    return C.repair_targets(dialogue_captions(spark, sf), threshold=0.3)


@query
def repaired_captions(spark, sf):
    captions = dialogue_captions(spark, sf).withColumn("style_pos", F.col("style_pos").cast("int"))
    offers = captions.select("task_id", "style", F.concat(F.lit("Another view of turn "), F.col("style_pos").cast("string"), F.lit(" is given here.")).alias("caption"))
    return C.repaired(captions, offers, threshold=0.3)


# ---- attempts, updates and calls


def event_attempts(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("response"), F.col("event_id").alias("seq"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.when(F.col("event_type") == "purchase", "used").otherwise("failed").alias("outcome"), F.col("value"))


@query
def attempt_consistency(spark, sf):
    return K.attempt_summary(event_attempts(spark, sf), "response", "seq")


@query
def attempt_costs(spark, sf):
    sets = event_attempts(spark, sf).groupingSets([["model", "outcome"], ["model"], []], "model", "outcome")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("cost"))


@query
def progressive_latest(spark, sf):
    return latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query
def task_timings(spark, sf):
    stage = F.when(F.col("event_type") == "view", "perception").when(F.col("event_type") == "click", "style").otherwise("other")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), stage.alias("stage"), F.col("value").alias("seconds"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"))
    out = P.timings(rows)
    seconds = [F.round(c, 6).alias(c) for c in ("perception_seconds", "style_seconds", "total_seconds")]
    return out.select("task_id", *seconds, F.array_join("calls", ",").alias("calls"), "last_model")


@query
def log_lines(spark, sf):
    line = files.log_line("MEDIA_STAGE", {"clip": F.col("user_id"), "stage": F.col("event_type"), "missing": F.when(F.col("event_id") % 2 == 0, F.col("event_id"))})
    parsed = files.parsed_log(line)
    return table(spark, sf, "events").select("event_id", line.alias("line"), parsed["key"].alias("key"), F.element_at(parsed["fields"], F.lit("stage")).alias("stage"))


# ---- timelines


def event_clips(spark, sf) -> DataFrame:
    """clip_id, duration, seconds and scenes of each user's events, 4,500 times as fast, and faster by the user's last digit."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("user_id", "event_id", micros.alias("at"), F.col("event_type").alias("kind"))
    user = rows.groupBy("user_id").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    speed = (F.col("user_id") % 10 + 1) / F.lit(10.0)
    second = (F.col("at") - F.col("first")) / F.lit(4.5e9) * speed
    duration = (F.col("last") - F.col("first")) / F.lit(4.5e9) * speed
    pick = (F.col("kind") == "signup") & (F.col("event_id") % (F.col("user_id") % 7 + 2) == 0)
    times = rows.join(user, "user_id").groupBy("user_id").agg(F.max(duration).alias("duration"), F.collect_list(F.when(pick, second)).alias("t"))
    inside = F.filter("t", lambda x: (x > L.SCENE_MARGIN) & (x < F.col("duration") - L.SCENE_MARGIN))
    return times.filter(L.valid_duration(F.col("duration"))).select(F.col("user_id").alias("clip_id"), "duration", F.col("t").alias("seconds"), min_gap(F.transform(inside, lambda x: F.bround(x, 3)), L.SCENE_GAP).alias("scenes"))


def decoder_log(before: str, after: str = "") -> Column:
    """The seconds as a decoder tells them, with every digit: margins and milliseconds are the reader's business."""
    return F.array_join(F.transform("seconds", lambda t: F.concat(F.lit(f"{before}pts_time:"), t.cast("decimal(38,20)").cast("string"), F.lit(after))), "\n")


def budgeted(spark, sf) -> DataFrame:
    return event_clips(spark, sf).withColumn("desired", L.desired_frames(F.col("duration"), F.size("scenes")).cast("int"))


@query
def scene_times(spark, sf):
    return event_clips(spark, sf).select("clip_id", F.round("duration", 6).alias("duration"), F.posexplode("scenes").alias("place", "ts")).select("clip_id", "duration", F.col("place").cast("long").alias("place"), F.round("ts", 6).alias("ts"))


@query
def scene_log_times(spark, sf):
    """The same times read back from a decoder's log."""
    log = decoder_log("[showinfo] n:0 ", " pos:1")
    rows = event_clips(spark, sf).select("clip_id", L.scene_times(log, F.col("duration")).alias("found"))
    return rows.select("clip_id", F.size("found").cast("long").alias("n"), F.round(F.aggregate("found", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query
def frame_budget(spark, sf):
    return budgeted(spark, sf).select("clip_id", F.size("scenes").cast("long").alias("n_scenes"), F.col("desired").cast("long").alias("desired"))


@query
def candidate_pool(spark, sf):
    return L.candidate_pool(budgeted(spark, sf)).select("clip_id", F.col("ms").cast("long").alias("ms"), "kind", F.col("width").cast("long").alias("width"))


@query
def quantized_candidates(spark, sf):
    clips = budgeted(spark, sf)
    return L.quantized(L.candidate_pool(clips), clips).select("clip_id", F.col("frame").cast("long").alias("frame"), "ts", "kind", F.col("width").cast("long").alias("width"))


@query
def fallback_plan(spark, sf):
    clips = budgeted(spark, sf)
    rows = L.quantized(L.candidate_pool(clips), clips).join(clips.select("clip_id", "desired"), "clip_id")
    return L.fallback_plan(rows).select("clip_id", F.col("frame").cast("long").alias("frame"), "kind")


@query
def frame_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", L.frame_id(F.col("value") + 0.0005).alias("frame_id"))


@query
def spread_sample(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    limit = (F.col("user_id") % 12).cast("int")
    return rows.select("user_id", F.explode(spread(F.col("ids"), limit)).alias("event_id"))


@query
def min_gap_events(spark, sf):
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(hours).alias("t"))
    return rows.select("user_id", F.explode(min_gap(F.col("t"), 3600.0)).alias("second")).select("user_id", F.col("second").cast("decimal(18,6)").cast("double").alias("second"))


@query
def near_duplicate_frames(spark, sf):
    """Embeddings as 64-bit fingerprints in blocks of 100, each block a clip: those not within 20 bits of one kept."""
    from spoolglass.functions.arrays import bright_bits

    rows = table(spark, sf, "embeddings").select((F.col("vec_id") / 100).cast("long").alias("clip_id"), F.struct(F.col("vec_id").alias("ts"), bright_bits(F.col("embedding")).alias("print")).alias("f"))
    kept = rows.groupBy("clip_id").agg(L.distinct_frames(F.collect_list("f"), 20).alias("kept"))
    return kept.select("clip_id", F.explode(F.transform("kept", lambda f: f["ts"])).alias("vec_id"))


@query
def choose_frames(spark, sf):
    """A bounded greedy choice, held against a plain loop in the tests."""
    clips = budgeted(spark, sf)
    frames = L.quantized(L.candidate_pool(clips), clips).groupBy("clip_id").agg(F.collect_list(F.struct("ts", "kind")).alias("frames"))
    chosen = L.choose_frames(F.col("frames"), F.least(F.col("desired"), F.lit(24)))
    return frames.join(clips.select("clip_id", "desired"), "clip_id").select("clip_id", F.explode(chosen).alias("f")).select("clip_id", "f.ts", "f.kind")


@query
def storyboards(spark, sf):
    """The whole plan and choice of frames; pictures stand for what a decoder gives, each fourth of a clip like the one before."""
    clips = event_clips(spark, sf)
    wanted = storyboard.plan(clips.select("clip_id", "duration", decoder_log("").alias("scene_log")))
    seed = F.sha2(F.concat_ws("-", F.col("clip_id").cast("string"), (F.col("frame") - F.when(F.col("frame") % 4 == 3, 1).otherwise(0)).cast("string")).cast("binary"), 512)
    frames = wanted.select("clip_id", "desired", "ts", "kind", F.lit("x").cast("binary").alias("jpeg"), F.repeat(seed, F.lit(2)).cast("binary").alias("gray"))
    return storyboard.select(frames).select("clip_id", F.explode("frames").alias("f")).select("clip_id", "f.frame_id", "f.kind")


# ---- audio frames


def event_frames(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", kind.isin("click", "view").alias("is_speech"), F.col("value").alias("rms"), (kind == "error").alias("side_is_speech"), (F.col("value") * 2).alias("mid_rms"), (F.col("event_id") % 50).cast("double").alias("side_rms")
    )


@query
def speech_stats(spark, sf):
    rows = S.speech_stats(event_frames(spark, sf))
    return rows.select("clip_id", "n_frames", "voiced", *[F.round(c, 9).alias(c) for c in ("speech_seconds", "speech_ratio", "envelope_cv")])


@query
def sliding_speech(spark, sf):
    return S.sliding_speech(event_frames(spark, sf), order="event_id").select("clip_id", F.round("window_ratio", 9).alias("window_ratio"), "sustained")


@query
def speech_gate(spark, sf):
    frames = event_frames(spark, sf)
    rows = S.speech_stats(frames).join(S.sliding_speech(frames, order="event_id"), "clip_id").join(S.near_mono(frames), "clip_id").join(S.dominant_speech(frames), "clip_id")
    duration = F.when(F.col("clip_id") % 7 == 0, F.lit(None).cast("double")).otherwise((F.col("clip_id") % 40) * 4.0)
    reason = S.speech_gate(duration, F.col("speech_seconds"), F.col("speech_ratio"), F.col("sustained"), F.col("envelope_cv"), F.col("clip_id") % 2 == 0, F.col("near_mono_ratio"), F.col("dominant"))
    return rows.select("clip_id", F.coalesce(reason, F.lit("transcribe")).alias("verdict"))


@query
def near_mono_ratio(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("clip_id"), (F.col("l_quantity") * 100).alias("mid_rms"), F.round(F.col("l_tax") * 10_000).alias("side_rms"))
    return S.near_mono(rows).select("clip_id", "n_active", F.round("near_mono_ratio", 9).alias("near_mono_ratio"))


@query
def dominant_speech(spark, sf):
    return S.dominant_speech(event_frames(spark, sf))


# ---- deadlines and ladders


@query
def budget_timeouts(spark, sf):
    left = P.remaining(F.col("o_totalprice"), F.lit(200_000.0))
    return table(spark, sf, "orders").select("o_orderkey", F.round(P.request_timeout(left, 135.0, 90.0), 6).alias("timeout"), P.exhausted(left).alias("exhausted"))


@query
def perception_ladder(spark, sf):
    """Packets of orders: answers, failed requests, the fallback itself, and generic summaries with something beside them."""
    key = F.col("o_orderkey")
    left = F.col("o_totalprice") % 300
    path = P.first_path(F.when(key % 13 == 0, "").otherwise("http://v"), key % 11 != 0, key % 5 != 0, left, key % 7 != 0, left - 20)
    none, generic = F.array(F.lit("none")), P.fallback_facts()
    board = F.when(key % 3 == 0, generic).when(key % 3 == 2, P.facts(F.lit("from storyboard"), none, F.lit(1.0)))
    other = P.facts(F.lit(T.GENERIC_SUMMARY), F.array(F.lit("other")))
    direct = F.when(key % 8 == 0, other).when(key % 4 == 0, generic).when(key % 4 != 1, P.facts(F.lit("from url"), none))
    whole = F.when(key % 5 == 0, generic).when(key % 5 != 1, P.facts(F.lit("from base64"), none))
    size = (key % 60) * (1 << 20)
    chosen = P.facts_ladder(path, P.storyboard_facts(board, key % 100), direct, whole, size)
    rows = table(spark, sf, "orders").select(
        "o_orderkey", path.alias("path"), chosen.alias("p"), P.native_video(left, size, size - (20 << 20)).alias("native_video"), P.transcript(left, F.when(key % 2 == 0, "noise"), F.lit("said")).alias("transcript")
    )
    packet = F.col("p")
    return rows.select(
        "o_orderkey", "path", packet["factual_summary"].alias("summary"), F.array_join(packet["do_not_claim"], ";").alias("exclusions"), packet["duration_seconds"].alias("duration"),
        P.is_generic(packet["factual_summary"]).alias("generic"), "native_video", "transcript",
    )


@query
def storyboard_requests(spark, sf):
    """What is asked with a storyboard, where there is time to ask."""
    key = F.col("o_orderkey")
    frames = F.transform(F.sequence(F.lit(0), (key % 3).cast("int")), lambda i: F.struct(L.frame_id(i * 1.5).alias("frame_id"), F.concat(F.lit("data:"), i.cast("string")).alias("data_url"), i.alias("rest")))
    timeout = P.request_timeout(F.col("o_totalprice") % 200, 135.0, 90.0)
    request = P.storyboard_request((key % 100).cast("double"), frames, F.when(key % 2 == 0, "said"), F.lit(None).cast("string"), timeout)
    asked = F.array_join(F.transform(request["frames"], lambda f: F.concat_ws("=", f["id"], f["data_url"])), ",")
    rows = table(spark, sf, "orders").filter(request.isNotNull())
    return rows.select("o_orderkey", request["duration_seconds"].alias("duration"), asked.alias("frames"), request["speech_transcript"].alias("transcript"), F.round(request["timeout_seconds"], 6).alias("timeout"))


@query
def isolated_results(spark, sf):
    """Tasks that failed get the fallback packet in their own place."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(key % 4 == 0, "broken").alias("error"), P.facts(F.concat(F.lit("Facts of "), key.cast("string")), F.array(F.lit("nothing"))).alias("facts"))
    out = P.isolated(rows, "error", "facts", P.fallback_facts())
    return out.select("o_orderkey", F.col("facts.factual_summary").alias("summary"), F.array_join("facts.do_not_claim", ";").alias("exclusions"))


@query
def style_outcomes(spark, sf):
    key = F.col("o_orderkey")
    good = F.lit("A caption of enough words that ends well.")
    first = F.when(key % 3 == 0, good).otherwise(F.lit("bad"))
    error = F.when(key % 4 == 1, F.lit("HTTP 429 slow down")).when(key % 4 == 2, F.lit("HTTP 400"))
    second = F.when(key % 5 == 0, F.lit("bad")).otherwise(good)
    again = F.when(key % 7 == 0, F.lit("HTTP 429"))
    return table(spark, sf, "orders").select("o_orderkey", P.style_outcome(first, error, second, again, F.lit("formal")).alias("outcome"))


EXCLUSION_WORDS, EXCLUSION_BYTES = 6, 8 << 20


@query
def exclusion_overlap(spark, sf):
    """Benchmark items as exclusions: how many documents hold a run of six of an item's words (all of a shorter one) as they stand."""

    def phrases(words: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " ")))

    words = F.split(T.collapsed(F.col("text")), " ")
    items = table(spark, sf, "benchmark").select("item_id", words.alias("w")).filter(F.col("w")[0] != "")
    items = items.select("item_id", F.least(F.size("w"), F.lit(EXCLUSION_WORDS)).alias("size"), F.explode(phrases(F.col("w"), EXCLUSION_WORDS)).alias("phrase"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())

    def runs(n: int) -> Column:
        found = F.transform(phrases(F.col("w"), n), lambda p: F.struct(F.lit(n).alias("size"), p.alias("phrase")))
        return F.when(F.size("w") >= n, found).otherwise(F.array().cast("array<struct<size:int,phrase:string>>"))

    docs = table(spark, sf, "documents").select("doc_id", words.alias("w"))
    docs = docs.select("doc_id", F.explode(F.flatten(F.array(*map(runs, sizes)))).alias("x")).select("doc_id", "x.*")
    few = (items.agg(F.sum(F.octet_length("phrase") + 16)).first()[0] or 0) <= EXCLUSION_BYTES
    found = docs.join(F.broadcast(items) if few else items, ["size", "phrase"]).select("item_id", "doc_id").distinct()
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return caption_lint_summary(spark, sf)
