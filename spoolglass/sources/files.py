"""Task files in, results and diagnostics out."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolglass.operators.contracts import first_error, pair_results, task_rows


class ContractError(ValueError):
    pass


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """idx, task_id, video_url, styles of a task file; the first broken rule raises ContractError."""
    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("file"), F.col("value").alias("payload"))
    rows = task_rows(text, "file", "payload")
    if (bad := first_error(rows, "file").filter("error is not null").first()) is not None:
        raise ContractError(bad["error"])
    fields = F.try_variant_get(F.col("task"), "$", "struct<task_id:string,video_url:string,styles:array<string>>")
    return rows.filter(F.col("idx").isNotNull()).select("idx", fields.alias("t")).select("idx", "t.*")


def write_results(results: DataFrame, tasks: DataFrame, path: str) -> None:
    """One JSON array of the results (idx, task_id, captions map) in the tasks' order.

    Rows are checked as a query before anything is written; the file then
    replaces the old one at once.  The rows of one batch of tasks are a small
    document by contract, so it is written by the driver.
    """
    named = results.select("idx", F.parse_json(F.to_json(F.struct("task_id", "captions"))).alias("result"))
    bad = pair_results(tasks.select("idx", "task_id", "styles"), named).filter("error is not null").orderBy("idx").first()
    if bad is not None:
        raise ContractError(bad["error"])
    rows = [{"task_id": r["task_id"], "captions": r["captions"]} for r in results.orderBy("idx").select("task_id", "captions").toLocalIterator()]
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".results-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False, indent=2)
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def append_diagnostics(traces: DataFrame, path: str) -> None:
    """One JSON object per task, added to those of earlier runs; the generic-facts flag goes with each."""
    traces.write.mode("append").json(path)


def data_url(content: Column, mime: Column) -> Column:
    """Base64 without line breaks; video/mp4 where no type is known."""
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("video/mp4")), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def log_line(key: Column | str, fields: dict[str, Column]) -> Column:
    parts = [F.lit(key) if isinstance(key, str) else key]
    for name, value in fields.items():
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("None"))))
    return F.concat_ws(" ", *parts)


def parsed_log(line: Column) -> Column:
    """Key and the map of k=v fields of a log line."""
    return F.struct(F.substring_index(line, " ", 1).alias("key"), F.str_to_map(F.regexp_replace(line, r"^\S+ ?", ""), F.lit(" "), F.lit("=")).alias("fields"))
